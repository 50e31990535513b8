"""Cross-sectional ranking: the ends of every bar, their gap, and liquidity ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import stable
from ..functions.ranks import percentile_ranks
from ..functions.windows import before, full, per_asset, through
from ..session import materialise


def lag_for_execution(rows: DataFrame, keys=(), smooth: int = 1, signal: str = "sig") -> DataFrame:
    """A signal known at bar t is ranked at the asset's next bar; optionally smoothed over full
    windows. Rows left without a value are dropped. Restarts inside every ``keys`` slice."""
    w = per_asset(*keys)
    lagged = rows.withColumn(signal, F.lag(signal).over(w)).where(F.col(signal).isNotNull())
    if smooth > 1:
        lagged = lagged.withColumn(signal, stable(full(F.avg, signal, through(w, smooth), smooth))).where(F.col(signal).isNotNull())
    return lagged


def bar_ends(rows: DataFrame, keys, top: int, bottom: int, signal: str = "sig") -> DataFrame:
    """The first ``top`` and last ``bottom`` rows of every bar in order signal desc, asset asc.

    Every row enters once per end, and each end is a ``row_number() <= k`` filter, which Spark turns
    into a partial limit before the shuffle: of a bar with a billion assets only k rows per task and
    end travel.
    """
    side, asset = F.col("side"), F.col("asset")
    order = Window.partitionBy(*keys, "timestamp", "side").orderBy(
        (F.col(signal) * side).desc(), F.when(side == 1, asset).asc(), F.when(side == -1, asset).desc())
    both = rows.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    depth = max(top, bottom)
    ends = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)
    return ends if top == bottom else ends.where(F.col("place") <= F.when(side == 1, top).otherwise(bottom))


def near_ends(rows: DataFrame, keys, depth: int, signal: str = "sig") -> DataFrame:
    """The rows that can be among the first or last ``depth`` of their bar; the ends of what is left are those of all rows.

    A bar's assets are dealt into buckets. Of the buckets' highest values the ``depth``-th is reached by at least ``depth``
    assets, so no row below it is among the first; the other end alike. Bars with fewer buckets keep all rows.
    """
    bucket = F.pmod(F.xxhash64("asset"), F.lit(8 * depth))
    peaks = rows.groupBy(*keys, "timestamp", bucket.alias("bucket")).agg(F.max(signal).alias("up"), F.max(F.col(signal) * -1).alias("down"))
    reach = lambda side: F.try_element_at(F.sort_array(F.collect_list(side), False), F.lit(depth)).alias(side)
    bounds = materialise(peaks.groupBy(*keys, "timestamp").agg(reach("up"), reach("down")))
    inside = F.col("up").isNull() | (F.col(signal) >= F.col("up")) | (F.col(signal) * -1 >= F.col("down"))
    return rows.join(bounds, [*keys, "timestamp"]).where(inside).drop("up", "down")


def contenders(rows: DataFrame, keys, depth: int, signal: str = "sig") -> DataFrame:
    """All rows of the assets that end at least one bar of their series: the only ones a book of that depth can ever hold.

    Their number is bounded by bars and depth, however many assets a bar has. Reads ``rows`` four times, so they should be stored.
    """
    narrow = rows.select(*keys, "timestamp", "asset", signal)
    ends = bar_ends(near_ends(narrow, keys, depth, signal), keys, depth, depth, signal)
    return rows.join(materialise(ends.select(*keys, "asset").distinct()), [*keys, "asset"], "left_semi")


def thin_bars(rows: DataFrame, keys, needed: int) -> DataFrame:
    """Bars with too few rankable assets."""
    return rows.groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("assets")).where(F.col("assets") < needed)


def drop_thin_bars(rows: DataFrame, keys, needed: int) -> DataFrame:
    return rows.join(thin_bars(rows, keys, needed), [*keys, "timestamp"], "left_anti")


def liquidity_percentile(rows: DataFrame, column: str, lookback: int = 30, keys=()) -> DataFrame:
    """Trailing mean liquidity before each bar, and its average-tie percentile within the bar."""
    score = stable(F.avg(column).over(before(per_asset(*keys), lookback)), 6)
    return percentile_ranks(rows.withColumn("liq_score", score), [*keys, "timestamp"], "liq_score", "liq_pct")


def tier_rates(rows: DataFrame, tiers, spreads: DataFrame | None = None) -> DataFrame:
    """Fee and slippage by descending percentile threshold; an unranked asset pays the last tier.

    ``spreads`` (asset, spread) raises slippage to the measured spread where one exists.
    """
    fee, slip = F.lit(float(tiers[-1][1])), F.lit(float(tiers[-1][2]))
    for threshold, tier_fee, tier_slip in reversed(tiers):
        hit = F.col("liq_pct") >= threshold
        fee = F.when(hit, F.lit(float(tier_fee))).otherwise(fee)
        slip = F.when(hit, F.lit(float(tier_slip))).otherwise(slip)
    priced = rows.withColumns({"fee_tier": fee, "slip_tier": slip})
    if spreads is not None:
        priced = (
            priced.join(spreads.select("asset", "spread"), "asset", "left")
            .withColumn("slip_tier", F.greatest("slip_tier", F.coalesce("spread", "slip_tier"))).drop("spread")
        )
    return priced
