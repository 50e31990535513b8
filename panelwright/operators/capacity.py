"""Capacity: participation, market impact, and how results change with capital."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import AUM_LEVELS
from ..functions.numeric import ratio
from ..functions.windows import per_asset, simple_return, through


def impact_bps(order, adv, volatility, coefficient: float = 1.0, model: str = "sqrt") -> Column:
    """Impact in basis points: coefficient x volatility x (order/adv)^p, p = 1/2 or 1; 0 if undefined."""
    size = ratio(order, adv)
    power = F.sqrt(size) if model == "sqrt" else size
    valid = (F.col(adv) > 0) & (F.col(order) > 0) & (F.col(volatility) >= 0)
    return F.when(valid, coefficient * F.col(volatility) * power * 10000.0).otherwise(F.lit(0.0))


def average_volume(panel: DataFrame, column: str = "quote_volume", bars: int = 90, exclude_outliers: bool = True) -> DataFrame:
    """Trailing mean of positive volume, leaving out bars above mean + 3 spreads of the same window.

    The window holds at most ``bars`` values, so the second look at it is a fold over a short array.
    """
    frame = through(per_asset(), bars)
    good = F.when((F.col(column) > 0) & (F.abs(column) < float("inf")), F.col(column))
    limit = F.when((F.col("adv_n") >= 3) & (F.col("adv_std") > 0), F.col("adv_mean") + 3 * F.col("adv_std"))
    kept = F.filter("adv_window", lambda v: F.col("adv_limit").isNull() | (v <= F.col("adv_limit")))
    total = F.aggregate(kept, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n")))
    out = panel.withColumns({
        "adv_n": F.count(good).over(frame), "adv_mean": F.avg(good).over(frame), "adv_std": F.stddev_samp(good).over(frame),
        "zero_volume_seen": F.count_if(F.coalesce(F.col(column), F.lit(0.0)) <= 0).over(frame) > 0,
    })
    if not exclude_outliers:
        return out.withColumn("adv", F.col("adv_mean")).drop("adv_n", "adv_mean", "adv_std")
    return (
        out.withColumns({"adv_limit": limit, "adv_window": F.collect_list(good).over(frame)})
        .withColumn("kept", total).withColumn("adv", ratio(F.col("kept.s"), F.col("kept.n").cast("double")))
        .drop("adv_n", "adv_mean", "adv_std", "adv_limit", "adv_window", "kept")
    )


def impact_overlay(trades: DataFrame, panel: DataFrame, column: str = "quote_volume", bars: int = 90, vol_bars: int = 30, model: str = "sqrt",
                   min_headroom: float = 1.5) -> DataFrame:
    """Participation, impact and headroom of each trade. A trade falls on a bar of its asset, or after
    its last bar; it then uses the asset's latest bar before it."""
    frame = average_volume(panel, column, bars).withColumn("bar_move", simple_return()).withColumn(
        "volatility", F.coalesce(F.stddev_samp("bar_move").over(through(per_asset(), vol_bars)), F.lit(0.0)))
    known = frame.select("asset", "timestamp", F.struct("adv", "volatility", "zero_volume_seen").alias("state"))
    marks = trades.select("asset", "timestamp").distinct()
    w = per_asset().rowsBetween(Window.unboundedPreceding, 0)
    dense = marks.join(known, ["asset", "timestamp"], "full").withColumn("state", F.last("state", True).over(w))
    priced = trades.join(dense, ["asset", "timestamp"]).select("*", "state.adv", "state.volatility", "state.zero_volume_seen").drop("state")
    return priced.where("adv is not null").withColumn("participation", ratio("notional", "adv")).withColumns({
        "impact_bps": impact_bps("notional", "adv", "volatility", model=model), "headroom": ratio(F.lit(min_headroom), F.col("participation"))})


def overlay_status(overlay: DataFrame, keys: list[str], min_headroom: float = 1.5) -> DataFrame:
    """Worst trade per group: SAFE, MARGINAL or BREACH."""
    worst = F.min("headroom")
    return overlay.groupBy(*keys).agg(
        F.max("impact_bps").alias("max_impact_bps"), F.max("participation").alias("max_participation_rate"),
        F.count_distinct(F.when(F.col("zero_volume_seen"), F.col("asset"))).alias("anomaly_assets"),
        F.when(worst >= min_headroom, "SAFE").when(worst >= 1.0, "MARGINAL").otherwise("BREACH").alias("status"))


def at_capital(trades: DataFrame, levels=AUM_LEVELS, base: float = 100_000.0) -> DataFrame:
    """The same trades at other capital: weights do not depend on it, notionals scale with it."""
    return trades.withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in levels]))).withColumn("notional", F.col("notional") * F.col("aum") / base)


def capacity_curve(trades: DataFrame, summary: DataFrame, overlay: DataFrame, column: str = "quote_volume", limit: float = 0.05) -> DataFrame:
    """Per capital level: breaches of the volume share, headroom, impact status and the unchanged returns.

    ``trades`` and ``overlay`` carry ``aum``; ``summary`` is one row of the run.
    """
    share = F.when(F.col(column) > 0, F.col("notional") / F.col(column))
    levels = trades.groupBy("aum").agg(
        F.count_if(share > limit).alias("breach_trades"), F.coalesce(F.sum(F.when(share > limit, F.col("notional"))), F.lit(0.0)).alias("breached_notional"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("max_participation_ratio"))
    status = overlay_status(overlay, ["aum"]).select("aum", "max_impact_bps", F.col("status").alias("impact_status"))
    kept = summary.select("total_return", "sharpe", "max_drawdown", "average_turnover")
    return levels.join(status, "aum", "left").join(kept, F.lit(True)).withColumns({
        "headroom_multiple": ratio(F.lit(limit), F.col("max_participation_ratio")), "sensible": F.col("breach_trades") == 0})
