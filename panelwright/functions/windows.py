"""Window specifications over panels.

A panel has one row per ``(timestamp, asset)``, so a partition by asset holds at most one row per
bar of the calendar: it is bounded by history length, not by data volume. Cross sections are *not*
bounded that way; operators over one bar aggregate and join back or use ``functions.ranks``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from .numeric import col_of


def per_asset(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys, "asset").orderBy("timestamp")


def before(window: WindowSpec, bars: int) -> WindowSpec:
    """The ``bars`` rows before the current one."""
    return window.rowsBetween(-bars, -1)


def through(window: WindowSpec, bars: int) -> WindowSpec:
    """The current row and the ``bars - 1`` rows before it."""
    return window.rowsBetween(-(bars - 1), 0)


def running(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def full(aggregate, value, window: WindowSpec, bars: int) -> Column:
    """``aggregate(value)`` over a frame, missing unless the frame has ``bars`` values."""
    c = col_of(value)
    return F.when(F.count(c).over(window) == bars, aggregate(c).over(window))


def simple_return(price: str = "price", *keys: str) -> Column:
    return F.try_divide(F.col(price), F.lag(price).over(per_asset(*keys))) - 1


def previous_value(df, keys: list[str], order: list[str], value: str, bucket: Column, name: str):
    """``lag(value)`` per key for event-level rows, where one key may own a third of all rows.

    Rows are ordered inside time buckets; the first row of a bucket takes the last value of the key's
    previous bucket from a table with one row per key and bucket. ``bucket`` must follow ``order[0]``.
    """
    parts = df.withColumn("time_bucket", bucket)
    inside = Window.partitionBy(*keys, "time_bucket").orderBy(*order)
    ends = parts.groupBy(*keys, "time_bucket").agg(F.max_by(value, F.struct(*order)).alias("bucket_last"))
    carried = ends.select(*keys, "time_bucket", F.lag("bucket_last").over(Window.partitionBy(*keys).orderBy("time_bucket")).alias("carried"))
    numbered = parts.withColumns({"place": F.row_number().over(inside), "local": F.lag(value).over(inside)})
    return (
        numbered.join(carried, [*keys, "time_bucket"])
        .withColumn(name, F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("local")))
        .drop("time_bucket", "carried", "place", "local")
    )
