"""Joining points with the intervals that hold them, without comparing every pair.

Intervals are clipped to the span of the points. By its length an interval gets a level, whose buckets are so wide that it covers few of
them; points go to their bucket of every level that occurs. They meet by level and bucket, and the exact comparison decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Buckets that an interval covers, at most and about; the narrowest buckets are 2^-FINEST of the span.
COVERED = 32
FINEST = 20


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str) -> DataFrame:
    """Rows of both where ``start <= point < end``; an interval without an end is open. The columns are timestamps.

    A null point or start meets nothing, and so does an interval that ends where it starts or before. Names must not clash.
    """
    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    low, high = points.agg(F.min(micros(point)), F.max(micros(point))).first()
    low, high = low or 0, high or 0
    unit = max(-(-(high - low + 1) >> FINEST), 1)
    begin, stop = F.greatest(micros(start), F.lit(low)), F.least(F.coalesce(micros(end), F.lit(high + 1)), F.lit(high + 1))
    clipped = intervals.where(F.col(start).isNotNull()).withColumns({"_begin": begin, "_stop": stop}).where("_begin < _stop")
    level = F.greatest(F.ceil(F.log2((F.col("_stop") - F.col("_begin")) / F.lit(unit * COVERED))), F.lit(0)).cast("int")
    dealt = clipped.withColumn("_level", level)
    levels = sorted(r[0] for r in dealt.select("_level").distinct().collect())  # at most FINEST numbers
    width = F.lit(unit) * F.pow(F.lit(2.0), F.col("_level")).cast("bigint")
    bucket = lambda c: F.floor((c - F.lit(low)) / width)
    dealt = dealt.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_begin")), bucket(F.col("_stop") - 1)))).drop("_begin", "_stop")
    seen = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_bucket", bucket(micros(point)))
    inside = (F.col(start) <= F.col(point)) & (F.col(end).isNull() | (F.col(point) < F.col(end)))
    return seen.join(dealt, ["_level", "_bucket"]).where(inside).drop("_level", "_bucket")
