"""Small constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Constant rows as part of the plan.

    The optimizer then knows how small they are and sends them to the rows of the other side, instead
    of shuffling that side by a handful of keys.
    """
    fields = StructType.fromDDL(schema).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
