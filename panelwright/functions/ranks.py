"""Exact ranks and quantiles inside a cross section of any size.

A bar may hold a third of all rows, so its ranking must not need one task. Equal values are first
collapsed by a partial aggregation. The distinct values are then cut into ranges of about equally
many values, each range is ordered on its own, and a prefix sum over the few range counts turns
local positions into exact positions in the bar. The edges of the ranges are order statistics of a
sample that a hash of the value picks, so they follow the values however heavy their tails, and do not
depend on the order rows arrive in: a retried task lands on the same ranges.

A bar of fewer rows than a range has no edges; its ranks are taken by windows, without collapsing values or joining back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .numeric import ratio

#: Distinct values of a range, about, and how many of them the sample holds.
RANGE_ROWS = 100_000
SAMPLED = 64
#: Edges that are compared at a time.
STRIDE = 64


def range_edges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, edges) of every group of more than ``RANGE_ROWS`` rows: each range above an edge holds about as many distinct values."""
    picked = F.when(F.pmod(F.xxhash64(value), F.lit(max(RANGE_ROWS // SAMPLED, 1))) == 0, F.col(value))
    groups = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set(picked)).alias("sample"))
    edges = F.filter("sample", lambda v, i: (i + 1) % min(SAMPLED, RANGE_ROWS) == 0)
    return groups.where(F.col("rows") > RANGE_ROWS).select(*keys, edges.alias("edges"))


def _range_of(value: Column) -> Column:
    """How many edges lie at or below a value, by a stretch of edges and then within it; 0 without edges."""
    reached = F.size(F.filter("edges", lambda e, i: (i % STRIDE == STRIDE - 1) & (e <= value))) * STRIDE
    return F.when(F.col("edges").isNull(), 0).otherwise(reached + F.size(F.filter(F.slice("edges", reached + 1, STRIDE), lambda e: e <= value)))


def value_ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct value of a group: copies, and the range it lies in."""
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    return values.join(range_edges(df, keys, value), keys, "left").withColumn("value_range", _range_of(F.col(value))).drop("edges")


def value_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct value of a group: copies, rows before it, and rows in the group."""
    cut = value_ranges(df, keys, value)
    group = Window.partitionBy(*keys)
    before = group.orderBy("value_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "value_range").agg(F.sum("copies").alias("range_rows"))
        .select(*keys, "value_range", F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("offset"), F.sum("range_rows").over(group).alias("group_rows"))
    )
    inside = Window.partitionBy(*keys, "value_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*keys, "value_range"])
        .withColumn("rows_before", F.col("offset") + F.sum("copies").over(inside) - F.col("copies"))
        .select(*keys, value, "copies", "rows_before", "group_rows")
    )


def _ranks_beside(rows: DataFrame, keys: list[str], value: str, name: str, size: str | None) -> DataFrame:
    """Ranks of groups that fit a task: windows over one partitioning, nothing joined back."""
    group, known = Window.partitionBy(*keys), F.col(value).isNotNull()
    upto = F.count(value).over(group.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = upto - (F.count(value).over(Window.partitionBy(*keys, value)) - 1) / 2
    return rows.withColumns({name: F.when(known, rank)} | ({size: F.when(known, F.count(value).over(group))} if size else {}))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, size: str | None = None) -> DataFrame:
    """Add the 1-based rank with ties averaged, NULL for a NULL value, and the non-null count.

    Groups of at most ``RANGE_ROWS`` values are ranked where they lie; larger ones by ranges. Both give the same ranks.
    """
    edges = materialise(range_edges(df, keys, value))
    if edges.isEmpty():
        return _ranks_beside(df, keys, value, name, size)
    marked = df.join(edges.select(*keys, F.lit(True).alias("_cut")), keys, "left")
    large = marked.where("_cut").drop("_cut")
    ranked = value_positions(large, keys, value).select(
        *keys, value,
        (F.col("rows_before") + (F.col("copies") + 1) / 2).alias(name),
        *([F.col("group_rows").alias(size)] if size else []),
    )
    small = _ranks_beside(marked.where("_cut is null").drop("_cut"), keys, value, name, size)
    return small.unionByName(large.join(ranked, [*keys, value], "left"))


def percentile_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the average-tie rank divided by the non-null count."""
    return (
        average_ranks(df, keys, value, "rank_in_group", "rows_in_group")
        .withColumn(name, ratio("rank_in_group", "rows_in_group"))
        .drop("rank_in_group", "rows_in_group")
    )


def quantile_edges(df: DataFrame, keys: list[str], value: str, quantiles: int, name: str = "edges") -> DataFrame:
    """Linear-interpolation quantiles 0, 1/q, .., 1 of every group, without duplicates, ascending."""
    first, last = F.col("rows_before"), F.col("rows_before") + F.col("copies")
    picks = []
    for i in range(quantiles + 1):
        place = (F.col("group_rows") - 1) * F.lit(i / quantiles)
        low, high = F.floor(place), F.ceil(place)
        picks += [
            F.max(F.when((first <= low) & (low < last), F.col(value))).alias(f"low_{i}"),
            F.max(F.when((first <= high) & (high < last), F.col(value))).alias(f"high_{i}"),
            F.max(place - low).alias(f"part_{i}"),
        ]
    points = [F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * F.col(f"part_{i}") for i in range(quantiles + 1)]
    return (
        value_positions(df, keys, value).groupBy(*keys).agg(*picks)
        .select(*keys, F.array_sort(F.array_distinct(F.array(*points))).alias(name))
    )
