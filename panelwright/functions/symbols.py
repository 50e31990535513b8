"""Instrument names: quote suffix, base token and canonical symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import MIGRATIONS, QUOTE_SUFFIXES
from .literal import literal_table

SUFFIX_PATTERN = f"({'|'.join(QUOTE_SUFFIXES)})$"


def base_token(symbol) -> Column:
    return F.regexp_replace(F.upper(symbol), SUFFIX_PATTERN, "")


def quote_suffix(symbol) -> Column:
    return F.regexp_extract(F.upper(symbol), SUFFIX_PATTERN, 1)


def migration_table(spark: SparkSession, rows=MIGRATIONS) -> DataFrame:
    """Ticker migrations as (source, canonical, factor, effective). One row per migration ever made."""
    return (
        literal_table(spark, rows, "source string, canonical string, factor double, effective string")
        .withColumn("effective", F.to_timestamp("effective"))
    )


def with_canonical(df: DataFrame, migrations: DataFrame, symbol: str = "asset", out: str = "canonical") -> DataFrame:
    """Add the canonical symbol of ``symbol``: the base token renamed where it migrated."""
    renames = migrations.select(F.col("source").alias("renamed_base"), F.col("canonical").alias("renamed_to"))
    base = base_token(F.col(symbol))
    return (
        df.withColumn("renamed_base", base).join(renames, "renamed_base", "left")
        .withColumn(out, F.concat(F.coalesce("renamed_to", "renamed_base"), quote_suffix(F.col(symbol))))
        .drop("renamed_base", "renamed_to")
    )
