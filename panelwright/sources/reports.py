"""Report sinks and run identity."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = "run_id") -> str:
    """One table of a result, by run. Text formats carry a header."""
    writer = df.write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_reports(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    return {name: write_report(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def latest(df: DataFrame, key: str = "run_id", order: str = "timestamp") -> DataFrame:
    """The last row of each run."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def write_rejected(df: DataFrame, bad, path: str, dataset: str) -> DataFrame:
    """Write the rows failing ``bad`` with the dataset's name; return the rest."""
    df.where(bad).withColumn("dataset", F.lit(dataset)).write.mode("overwrite").option("header", True).csv(path)
    return df.where(~F.coalesce(bad, F.lit(False)))


def run_fingerprint(rows: DataFrame, key: str, text: str, config: dict) -> DataFrame:
    """Identity of a run: hash of its input rows in any order, of its settings, and of both with its name.

    Rows are summed as two 60-bit numbers each, so repeated rows count as often as they occur.
    """
    first, second = (F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16))
    settings = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return (
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("x"), F.sum(second).alias("y"))
        .select(key, F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")), 256).alias("input_sha256"), F.sha2(F.lit(settings), 256).alias("config_sha256"))
        .withColumn("run_id", F.sha2(F.concat_ws("|", "input_sha256", "config_sha256", key), 256))
    )
