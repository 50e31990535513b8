"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of every contract in this subpackage, as a byte set and as a regular-expression class.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) of any table of documents; a null text is empty. Other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: how many chunks or buckets an operator makes follows from this alone."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def by_id(column: str = "doc_id") -> Column:
    """Ascending, nulls last: the order of identifiers wherever the smallest one wins."""
    return F.col(column).asc_nulls_last()
