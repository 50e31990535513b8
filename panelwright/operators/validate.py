"""Splits, segment metrics, benchmarks, regimes and series summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import STD_FLOOR
from ..functions.expanding import expanding_quantile
from ..functions.numeric import ratio
from ..functions.windows import full, per_asset, running, simple_return, through
from .factors import BENCHMARK, bar_index
from .portfolio import periods_per_year


def date_split(panel: DataFrame, train: float = 0.6, validation: float = 0.2, minimum: int = 30) -> DataFrame:
    """Bars with their segment by position; bar counts are truncated, short histories are refused."""
    bars = bar_index(panel)
    n = bars.agg(F.count(F.lit(1)).alias("n_bars"))
    placed = bars.join(n, F.lit(True))
    first = F.floor(F.col("n_bars") * train)
    second = F.floor(F.col("n_bars") * (train + validation))
    segment = F.when(F.col("idx") < first, "train").when(F.col("idx") < second, "validation").otherwise("out_of_sample")
    return placed.where((F.col("n_bars") >= minimum) & (first >= 1) & (second > first) & (second < F.col("n_bars"))).select(
        "timestamp", F.col("idx").alias("position"), segment.alias("segment"))


def sharpe(returns, ppy) -> Column:
    """Annualised mean over spread; 0 without spread."""
    spread = F.stddev_samp(returns)
    return F.coalesce(ratio(F.avg(returns), F.when(spread >= STD_FLOOR, spread)) * F.sqrt(ppy), F.lit(0.0))


def segment_metrics(returns: DataFrame, segments: DataFrame, breaches: DataFrame | None = None) -> DataFrame:
    """Metrics of each run in each segment of one continuous equity curve.

    The base is the equity before the segment, and the drawdown starts from it.
    """
    rows = returns.join(segments.select("timestamp", "segment"), "timestamp")
    whole = Window.partitionBy("run_id", "segment")
    order = whole.orderBy("idx")
    base = F.first("equity_before").over(order)
    step = (F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(order))) / 1e6
    rows = rows.withColumns({"base": base, "step": step}).withColumn(
        "seg_drawdown", F.col("equity") / F.greatest(F.col("base"), F.max("equity").over(running(order))) - 1)
    n, ppy = F.count(F.lit(1)), periods_per_year(F.median("step"))
    start, end = F.first("base"), F.max_by("equity", "idx")
    spread = F.stddev_samp("ret")
    out = rows.groupBy("run_id", "segment").agg(
        start.alias("initial_equity"), end.alias("final_equity"), (end / start - 1).alias("total_return"), n.alias("periods"),
        F.when(end / start > 0, F.pow(end / start, ppy / n) - 1).alias("annualized_return"),
        F.coalesce(F.when(spread >= STD_FLOOR, spread) * F.sqrt(ppy), F.lit(0.0)).alias("annualized_volatility"),
        sharpe(F.col("ret"), ppy).alias("sharpe"), F.min("seg_drawdown").alias("max_drawdown"),
        F.count_if(F.col("ret") > 0).alias("winning_periods"), F.count_if(F.col("ret") < 0).alias("losing_periods"),
        F.avg("turnover").alias("average_turnover"),
    ).withColumn("turnover_flag", F.when(F.col("average_turnover") > 0.15, "OVER").otherwise("OK"))
    if breaches is not None:
        counts = breaches.join(segments.select("timestamp", "segment"), "timestamp").groupBy("run_id", "segment").agg(
            F.count(F.lit(1)).alias("risk_violations"), F.count_if(F.col("type") == "capacity_limit").alias("capacity_violations"),
            F.count_if(F.col("type") == "forced_exit").alias("forced_exits"))
        out = out.join(counts, ["run_id", "segment"], "left").fillna(0, ["risk_violations", "capacity_violations", "forced_exits"])
    return out


def series_summary(returns: DataFrame, key: str, order, ppy: str = "ppy") -> DataFrame:
    """Summary of a plain return series. Its drawdown starts from the first compounded value."""
    w = Window.partitionBy(key).orderBy(*order)
    grown = returns.withColumn("growth", F.product(F.col("ret") + 1).over(running(w)))
    curve = grown.withColumn("curve_drawdown", F.col("growth") / F.max("growth").over(running(w)) - 1)
    n = F.count(F.lit(1))
    spread = F.stddev_samp("ret")
    return curve.groupBy(key).agg(
        (F.product(F.col("ret") + 1) - 1).alias("total_return"), n.alias("periods"), F.first(ppy).alias("periods_per_year"),
        F.coalesce(spread * F.sqrt(F.first(ppy)), F.lit(0.0)).alias("annualized_volatility"),
        sharpe(F.col("ret"), F.first(ppy)).alias("sharpe"),
        F.when(n < 2, F.lit(0.0)).otherwise(F.min("curve_drawdown")).alias("max_drawdown"))


def benchmarks(panel: DataFrame, buy_and_hold=(BENCHMARK, "ETHUSDT")) -> DataFrame:
    """Equal weight over all assets, each named asset alone, and the zero reference."""
    rets = panel.withColumn("r", simple_return()).where("r is not null")
    equal = rets.groupBy("timestamp").agg(F.avg("r").alias("r")).withColumn("benchmark", F.lit("equal_weight"))
    held = rets.where(F.col("asset").isin(*buy_and_hold)).select("timestamp", "r", F.lower("asset").alias("benchmark"))
    both = equal.select("benchmark", "r").unionByName(held.select("benchmark", "r")).groupBy("benchmark").agg(
        (F.product(F.col("r") + 1) - 1).alias("total_return"), F.count(F.lit(1)).alias("periods"))
    zero = equal.agg(F.count(F.lit(1)).alias("periods")).select(
        F.lit("market_neutral_reference").alias("benchmark"), F.lit(0.0).alias("total_return"), "periods")
    return both.unionByName(zero)


def regime_labels(panel: DataFrame, benchmark: str = BENCHMARK, trend_limit: float = 0.10, bars: int = 30) -> DataFrame:
    """Trend and volatility regime of the benchmark at each bar, from its past only."""
    w = per_asset()
    series = panel.where(F.col("asset") == benchmark).withColumn("r", simple_return()).withColumns({
        "trend": full(F.sum, "r", through(w, bars), bars), "vol": full(F.stddev_samp, "r", through(w, bars), bars),
    }).select("asset", "timestamp", F.round("trend", 12).alias("trend"), F.round("vol", 12).alias("vol"))
    cut = expanding_quantile(series, ["asset"], "vol", 0.66, "vol_cutoff")
    trend = F.when(F.col("trend") > trend_limit, "bull").when(F.col("trend") < -trend_limit, "bear").otherwise("sideways")
    vol = F.when(F.col("vol") > F.round("vol_cutoff", 12), "hi_vol").otherwise("lo_vol")
    return cut.select("timestamp", F.concat_ws("_", trend, vol).alias("regime"))


def regime_performance(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """Active bars of each run by regime of the bar."""
    return returns.where("idx > 0").join(labels, "timestamp").groupBy("run_id", "regime").agg(
        F.count(F.lit(1)).alias("days"), F.avg("ret").alias("mean_daily_return"), F.count_if(F.col("ret") > 0).alias("positive_days"),
        (F.product(F.col("ret") + 1) - 1).alias("total_return"))
