"""Point-in-time factors. Every value at a bar uses information up to the previous bar only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import SIGNAL_CANDIDATES, STD_FLOOR
from ..functions.folds import sliding_folds
from ..functions.literal import literal_table
from ..functions.numeric import nonzero_std, ratio, stable
from ..functions.windows import before, per_asset, simple_return
from ..session import materialise

LOOKBACKS = (7, 14, 30)
RESIDUAL_LOOKBACKS = (14, 30)
BENCHMARK = "BTCUSDT"
# Factors are rounded to ten digits, or so many.
DIGITS = {"funding_surprise": 12}


def asset_return(panel: DataFrame) -> DataFrame:
    return panel.withColumn("asset_return", simple_return())


def bar_index(panel: DataFrame, *keys: str) -> DataFrame:
    """The distinct bars with a dense 0-based index. One row per bar, so its window is small."""
    order = Window.partitionBy(*keys, F.lit(0)).orderBy("timestamp")
    return panel.select(*keys, "timestamp").distinct().withColumn("idx", F.row_number().over(order) - 1)


def _windowed(panel: DataFrame, windows: dict, formulas: dict) -> DataFrame:
    """Add ``formulas`` over ``windows``, each of which is computed once, however many formulas read it.

    A sliding frame is folded anew for every row, by every aggregate that names it, so factors share
    their frames: one pass over an asset's rows holds all aggregates of a lookback.
    """
    return _evaluated(panel.withColumns(windows), formulas).drop(*windows)


def _evaluated(frame: DataFrame, formulas: dict) -> DataFrame:
    """Add ``formulas``, rounded. The values of a row are rounded as arrays by one function: rounding names its argument several times,
    and written out for every factor it makes the generated method of a row longer than the JVM compiles."""
    def rounded(columns, digits):
        return F.transform(F.array(*columns), lambda value: stable(value, digits))

    alike: dict[int, list[str]] = {}
    for c in formulas:
        alike.setdefault(DIGITS.get(c, 10), []).append(c)
    arrays = {f"_rounded_{d}": rounded(columns, d) for d, columns in alike.items()}
    items = {c: F.col(f"_rounded_{d}")[i] for d, columns in alike.items() for i, c in enumerate(columns)}
    return frame.withColumns(formulas).withColumns(arrays).withColumns(items).drop(*arrays)


def _moment_windows(k: int) -> dict:
    """How many returns the ``k`` bars before have, their sum and their spread."""
    frame = before(per_asset(), k)
    return {f"_n_{k}": F.count("asset_return").over(frame), f"_sum_{k}": F.sum("asset_return").over(frame), f"_std_{k}": F.stddev_samp("asset_return").over(frame)}


def _full_moment(name: str, k: int) -> Column:
    return F.when(F.col(f"_n_{k}") == k, F.col(f"_{name}_{k}"))


def _price_windows() -> dict:
    windows = {"_return_lag": F.lag("asset_return").over(per_asset())}
    for k in LOOKBACKS:
        windows |= _moment_windows(k)
    return windows


def _price_formulas() -> dict:
    cols = {}
    for k in LOOKBACKS:
        total, spread = _full_moment("sum", k), _full_moment("std", k)
        cols[f"momentum_{k}"] = total
        cols[f"vol_adj_momentum_{k}"] = ratio(total, nonzero_std(spread))
        cols[f"low_vol_{k}"] = -spread
    cols["reversal_1"] = -F.col("_return_lag")
    return cols


def price_factors(panel: DataFrame) -> DataFrame:
    """momentum, vol-adjusted momentum, low volatility and one-bar reversal."""
    return _windowed(panel, _price_windows(), _price_formulas())


def _carry_windows() -> dict:
    w = per_asset()
    return _moment_windows(14) | {
        "_funding_lag": F.lag("funding_rate").over(w), "_n_funding": F.count("funding_rate").over(before(w, 14)),
        "_avg_funding": F.avg("funding_rate").over(before(w, 14))}


def _carry_formulas() -> dict:
    lagged = F.col("_funding_lag")
    mean = F.when(F.col("_n_funding") == 14, F.col("_avg_funding"))
    return {
        "carry": -lagged,
        "funding_surprise": -(lagged - mean),
        "vol_adj_carry": ratio(-lagged, nonzero_std(_full_moment("std", 14))),
    }


def carry_factors(panel: DataFrame) -> DataFrame:
    """carry, its surprise against the trailing mean, and carry per unit of volatility."""
    return _windowed(panel, _carry_windows(), _carry_formulas())


def _bars(panel: DataFrame, lookbacks, benchmark: str) -> DataFrame:
    """The bar index and what is the same for every asset at a bar: the benchmark's return, and of its ``k`` bars before how
    many returns there are, their sum and their variance. The bars are a small stored table, so the panel is not shuffled by bar
    to meet them, and the benchmark's moments are taken once per bar instead of once per row."""
    bench = panel.where(F.col("asset") == benchmark).select("timestamp", F.col("asset_return").alias("bench_return"))
    y, moments = F.col("bench_return"), {}
    for k in lookbacks:
        frame = before(Window.partitionBy(F.lit(0)).orderBy("idx"), k)
        moments |= {f"_bench_n_{k}": F.count(y).over(frame), f"_bench_sum_{k}": F.sum(y).over(frame), f"_bench_var_{k}": F.var_samp(y).over(frame)}
    return materialise(bar_index(panel).join(bench, "timestamp", "left").withColumns(moments))


def _with_bars(panel: DataFrame, lookbacks, benchmark: str) -> DataFrame:
    return panel.join(_bars(panel, lookbacks, benchmark), "timestamp")


def _without_bars(frame: DataFrame, lookbacks) -> DataFrame:
    return frame.drop("idx", "bench_return", *[f"_bench_{m}_{k}" for m in ("n", "sum", "var") for k in lookbacks])


def _residual_windows(lookbacks) -> dict:
    windows = {}
    for k in lookbacks:
        frame = before(per_asset(), k)
        windows |= _moment_windows(k) | {
            f"_first_idx_{k}": F.lag("idx", k).over(per_asset()), f"_covar_{k}": F.covar_samp("asset_return", "bench_return").over(frame)}
    return windows


def _residual_formulas(lookbacks, benchmark: str) -> dict:
    """A frame of k rows lies on consecutive bars when its first row, k rows back, lies k bars back; the benchmark's moments of
    these bars are then those of the frame."""
    cols = {}
    for k in lookbacks:
        complete = (F.col(f"_first_idx_{k}") == F.col("idx") - k) & (F.col(f"_n_{k}") == k) & (F.col(f"_bench_n_{k}") == k)
        beta = ratio(f"_covar_{k}", f"_bench_var_{k}")
        residual = F.col(f"_sum_{k}") - beta * F.col(f"_bench_sum_{k}")
        neutral = F.when(F.col("idx") >= k, F.lit(0.0))
        cols[f"resid_reversal_{k}"] = F.when(F.col("asset") == benchmark, neutral).otherwise(
            F.when(complete, -residual))
    return cols


def residual_reversal(panel: DataFrame, lookbacks=RESIDUAL_LOOKBACKS, benchmark: str = BENCHMARK) -> DataFrame:
    """Reversal of the return the benchmark does not explain.

    The definition runs on the dense bar x asset grid. A grid window of k bars is complete only when
    the asset has k rows on consecutive bars, so the same result follows from the asset's own rows
    and their bar index; the grid itself is never built.
    """
    frame = _with_bars(panel, lookbacks, benchmark)
    return _without_bars(_windowed(frame, _residual_windows(lookbacks), _residual_formulas(lookbacks, benchmark)), lookbacks)


def cross_sectional_z(panel: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Per-bar z-scores with the population spread; a bar without spread scores 0 throughout.

    Moments are aggregated per bar and joined back, so a crowded bar never meets in one task. The
    table of moments is stored first: its measured size lets the planner send it to the panel's rows.
    """
    moments = materialise(panel.groupBy("timestamp").agg(*[
        m for c in columns for m in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_spread"))]))
    scored = {
        f"{c}{suffix}": F.when(F.col(f"{c}_spread") < STD_FLOOR, F.lit(0.0))
        .otherwise((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_spread"))
        for c in columns
    }
    return (
        panel.join(moments, "timestamp").withColumns(scored)
        .drop(*[f"{c}_{m}" for c in columns for m in ("mean", "spread")])
    )


def combined_scores(panel: DataFrame) -> DataFrame:
    """carry_mom_z and carry_lowvol_z."""
    scored = cross_sectional_z(panel, ["vol_adj_carry", "vol_adj_momentum_14", "low_vol_14"])
    return scored.withColumns({
        "carry_mom_z": stable(F.col("vol_adj_carry_z") + F.col("vol_adj_momentum_14_z")),
        "carry_lowvol_z": stable(F.col("vol_adj_carry_z") + F.col("low_vol_14_z")),
    }).drop("vol_adj_carry_z", "vol_adj_momentum_14_z", "low_vol_14_z")


def build_signals(panel: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """All factors of a panel, from one pass over each asset's rows. Returns are always derived from
    price; stale columns are dropped."""
    frame = _with_bars(asset_return(panel.drop("asset_return", "signal")), RESIDUAL_LOOKBACKS, benchmark)
    windows, formulas = _price_windows() | _residual_windows(RESIDUAL_LOOKBACKS), _price_formulas()
    if "funding_rate" in panel.columns:
        windows, formulas = windows | _carry_windows(), formulas | _carry_formulas()
    frame = _without_bars(_windowed(frame, windows, formulas | _residual_formulas(RESIDUAL_LOOKBACKS, benchmark)), RESIDUAL_LOOKBACKS)
    return combined_scores(frame) if "funding_rate" in panel.columns else frame


def folded_signals(panel: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """``build_signals`` for a panel of many assets: the same factors, their frames folded over batches of rows instead of row by row.

    The frame is stored before its z-scores, which read it twice: for the moments of every bar, and for the scores. Columns of the
    panel that nobody reads behind this step are best left out before it.
    """
    panel = panel.drop("asset_return", "signal")
    bars = _bars(asset_return(panel), RESIDUAL_LOOKBACKS, benchmark)
    # The window of the return comes last: it puts the rows of an asset into one partition.
    ordered = asset_return(panel.join(bars.select("timestamp", "idx", "bench_return"), "timestamp"))
    formulas, funding = _price_formulas() | _residual_formulas(RESIDUAL_LOOKBACKS, benchmark), "funding_rate" in panel.columns
    folded = sliding_folds(ordered, LOOKBACKS, RESIDUAL_LOOKBACKS, 14 if funding else None)
    if funding:
        folded, formulas = folded.withColumn("_n_funding", F.when(F.col("_avg_funding").isNotNull(), 14)), formulas | _carry_formulas()
    frame = _evaluated(folded.join(bars.drop("idx", "bench_return"), "timestamp"), formulas)
    stored = materialise(frame.select(*panel.columns, "asset_return", *formulas))
    return combined_scores(stored) if funding else stored


def available_candidates(frame: DataFrame) -> DataFrame:
    """Candidate columns that exist and hold at least one value, with their order and count."""
    present = [c for c in SIGNAL_CANDIDATES if c in frame.columns]
    counts = frame.agg(*[F.count(c).alias(c) for c in present])
    return (
        counts.unpivot([], present, "signal", "values")
        .join(candidate_order(frame.sparkSession), "signal")
        .where("values > 0").select("signal", "ordinal", "values")
    )


def candidate_order(spark) -> DataFrame:
    return literal_table(spark, list(zip(SIGNAL_CANDIDATES, range(len(SIGNAL_CANDIDATES)))), "signal string, ordinal int")


def unpivot_signals(frame: DataFrame, candidates, keep=("timestamp", "asset")) -> DataFrame:
    """Wide factors to ``(signal, sig)`` rows, dropping missing values."""
    return frame.select(*keep, *candidates).unpivot(list(keep), list(candidates), "signal", "sig").where("sig is not null")
