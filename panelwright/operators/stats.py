"""Factor research statistics, multiple testing and the trial registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..constants import EULER_GAMMA, STD_FLOOR
from ..functions.normal import erfc, normal_cdf, normal_quantile
from ..functions.numeric import clean, stable
from ..functions.ranks import average_ranks, quantile_edges
from ..functions.windows import per_asset
from ..session import materialise
from .factors import unpivot_signals

MIN_IC_BARS = 30
MIN_OVERLAP = 30
# Rows of a bar that one task ranks: some MB per signal.
BAR_ROWS = 500_000
# Expected series and bars of a tile: two tiles of numbers fit a task many times over.
TILE_SERIES, TILE_BARS = 128, 512
# A spread below this share of the squares is what rounding leaves of none.
VARIES = 1e-13


def signal_returns(frame: DataFrame, candidates) -> DataFrame:
    """(signal, timestamp, asset, sig, next_return), complete rows only. Read several times by the
    rank statistics, so written once."""
    nexts = frame.withColumn("next_return", stable(F.lead("asset_return").over(per_asset())))
    rows = unpivot_signals(nexts, candidates, keep=("timestamp", "asset", "next_return"))
    return materialise(rows.where("next_return is not null"))


def bar_ic(rows: DataFrame) -> DataFrame:
    """Spearman correlation of signal and next return per bar, for bars of three rows and some spread."""
    keys = ["signal", "timestamp"]
    ranked = average_ranks(average_ranks(rows, keys, "sig", "sig_rank"), keys, "next_return", "return_rank")
    spread = (F.min("sig") < F.max("sig")) & (F.min("next_return") < F.max("next_return")) & (F.count(F.lit(1)) >= 3)
    # Not F.corr: under ANSI rules it fails on a bar whose ranks do not vary, also where its value is not taken.
    corr = F.try_divide(F.covar_pop("sig_rank", "return_rank"), F.stddev_pop("sig_rank") * F.stddev_pop("return_rank"))
    return ranked.groupBy(*keys).agg(F.when(spread, corr).alias("ic")).where("ic is not null")


def with_next_return(panel: DataFrame) -> DataFrame:
    """Add the return of the asset's next row, the one that ``signal_returns`` sets beside a signal."""
    return panel.withColumn("next_return", stable(F.try_divide(F.lead("price").over(per_asset()), F.col("price")) - 1))


def _sorted_ranks(ascending: np.ndarray) -> np.ndarray:
    """1-based ranks of values in order, ties averaged; NaN is one value, as it is to Spark."""
    new = np.ones(len(ascending), bool)
    new[1:] = (ascending[1:] != ascending[:-1]) & ~(np.isnan(ascending[1:]) & np.isnan(ascending[:-1]))
    first = np.flatnonzero(new)
    copies = np.diff(first, append=len(ascending))
    return np.repeat(first + (copies + 1) / 2, copies)


def _rank_correlations(bar: pa.Table, candidates) -> pa.Table:
    """One row: the rank correlation of every candidate with the next return over the rows that have both."""
    returns = bar.column("next_return").to_numpy()
    by_return = np.argsort(returns)
    ranks, last = np.empty((2, len(returns))), None

    def correlation(column):
        nonlocal last
        known = column.is_valid().to_numpy()
        rows = np.flatnonzero(known)
        if len(rows) < 3:
            return None
        if last is None or not np.array_equal(known, last):
            kept = by_return[known[by_return]]
            ranks[1, kept] = _sorted_ranks(returns[kept])
            last = known
        values = column.fill_null(0.0).to_numpy()[rows]
        order = np.argsort(values)
        ranks[0, rows[order]] = _sorted_ranks(values[order])
        a, b = ranks[:, rows] - (len(rows) + 1) / 2
        spread = np.sqrt(a @ a) * np.sqrt(b @ b)
        return a @ b / spread if spread > 0 else None

    return pa.table({"timestamp": bar.column("timestamp").slice(0, 1), **{c: pa.array([correlation(bar.column(c))], pa.float64()) for c in candidates}})


def panel_ic(frame: DataFrame, candidates) -> DataFrame:
    """``bar_ic`` of every candidate from rows that hold them all, beside ``next_return``.

    Nothing is stored or shuffled once per candidate: a bar's rows travel once and its columns are ranked in one task. A bar of
    more than ``BAR_ROWS`` rows goes to ``bar_ic``, which ranks it by ranges.
    """
    candidates = list(candidates)
    rows = frame.where("next_return is not null").select("timestamp", "next_return", *candidates)
    crowded = materialise(rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BAR_ROWS).select("timestamp"))
    schema = ", ".join(["timestamp timestamp", *[f"`{c}` double" for c in candidates]])

    def ranked(bars):
        wide = bars.groupBy("timestamp").applyInArrow(lambda bar: _rank_correlations(bar, candidates), schema)
        return wide.unpivot(["timestamp"], candidates, "signal", "ic").where("ic is not null").select("signal", "timestamp", "ic")

    if crowded.isEmpty():
        return ranked(rows)
    large = materialise(unpivot_signals(rows.join(crowded, "timestamp", "left_semi"), candidates, keep=("timestamp", "next_return")))
    return ranked(rows.join(crowded, "timestamp", "left_anti")).unionByName(bar_ic(large))


def ic_table(ics: DataFrame) -> DataFrame:
    """Mean, spread, t, ICIR and number of bars per signal; statistics need thirty bars."""
    n, mean, spread = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    enough = n >= MIN_IC_BARS
    sd = F.when(spread >= STD_FLOOR, spread)
    return ics.groupBy("signal").agg(
        F.when(enough, mean).alias("ic_mean"), F.when(enough, spread).alias("ic_std"),
        F.when(enough, mean / sd * F.sqrt(n)).alias("ic_tstat"), F.when(enough, mean / sd).alias("icir"), n.alias("ic_days"))


def ic_gate(table: DataFrame, minimum: float = 2.0) -> DataFrame:
    return table.withColumn("passed", F.coalesce(F.abs("ic_tstat") >= minimum, F.lit(False)))


def quantile_returns(rows: DataFrame, quantiles: int = 5) -> DataFrame:
    """Mean next return by within-bar quantile bucket; coinciding edges merge buckets."""
    keys = ["signal", "timestamp"]
    edges = quantile_edges(rows, keys, "sig", quantiles)
    edges = edges.withColumn("edges", F.array_distinct(F.transform("edges", lambda e: F.round(e, 12))))
    below = F.size(F.filter("edges", lambda e: e < F.col("sig")))
    bucket = F.when(F.size("edges") > 1, F.greatest(below - 1, F.lit(0)))
    return (
        rows.join(edges, keys).withColumn("quantile", bucket).where("quantile is not null")
        .groupBy("signal", "quantile").agg(F.avg("next_return").alias("mean_next_return"), F.count(F.lit(1)).alias("days"))
    )


def newey_west(series: DataFrame, key: str = "signal", value: str = "ic") -> DataFrame:
    """t statistic of a mean with autocovariances up to n^(1/4) lags, by a join of each bar with its
    few lagged bars."""
    order = Window.partitionBy(key).orderBy("timestamp")
    whole = Window.partitionBy(key)
    x = (
        series.where(F.col(value).isNotNull())
        .select(key, F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(whole).alias("n"),
                F.avg(value).over(whole).alias("mean"), (F.col(value) - F.avg(value).over(whole)).alias("dev"))
    )
    x = x.withColumn("lags", F.least(F.greatest(F.lit(1), F.floor(F.pow("n", F.lit(0.25)))), F.col("n") - 1))
    ahead = x.select(key, "n", "lags", "mean", F.col("dev").alias("later"), F.explode(F.sequence(F.lit(0), F.col("lags").cast("int"))).alias("lag"), (F.col("i") - F.col("lag")).alias("i"))
    products = ahead.join(x.select(key, "i", "dev"), [key, "i"]).groupBy(key, "n", "lags", "mean", "lag").agg(F.avg(F.col("dev") * F.col("later")).alias("cov"))
    weight = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1)))
    return products.groupBy(key, "n", "mean").agg(F.sum(weight * F.col("cov")).alias("variance")).select(
        key, F.col("n").alias("bars"), F.when(F.col("n") < 2, F.lit(0.0)).otherwise(
            F.col("mean") / F.sqrt(F.greatest("variance", F.lit(1e-18)) / F.col("n"))).alias("nw_tstat"))


def block_bootstrap(series: DataFrame, key: str = "signal", value: str = "ic", iterations: int = 2000, block: int = 5, seed: int = 7) -> DataFrame:
    """95% interval of the mean from resampled blocks. The draw sequence of one series is fixed by the
    seed, so each series (one value per bar) is resampled in one task."""
    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("timestamp")[value].dropna().to_numpy(dtype=float)
        starts = np.arange(0, len(x), block)
        draws = np.random.default_rng(seed)
        offsets = np.arange(block)
        means = np.empty(iterations)
        for i in range(iterations):
            places = (starts[draws.integers(0, len(starts), size=len(starts))][:, None] + offsets).ravel()
            means[i] = x[places[places < len(x)][:len(x)]].mean()
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({key: [rows[key].iloc[0]], "mean": [x.mean()], "lower_95": [low], "upper_95": [high], "iterations": [iterations]})

    return series.where(F.col(value).isNotNull()).select(key, "timestamp", value).groupBy(key).applyInPandas(
        resample, f"{key} string, mean double, lower_95 double, upper_95 double, iterations int")


def bonferroni(table: DataFrame, tests: int, tstat: str = "ic_tstat") -> DataFrame:
    return table.withColumn("adjusted_pvalue", F.least(F.lit(1.0), F.lit(float(tests)) * erfc(F.abs(tstat) / F.sqrt(F.lit(2.0)))))


def reality_check(table: DataFrame, hurdle: float = 3.0) -> DataFrame:
    best = F.coalesce(F.max(F.abs("ic_tstat")), F.lit(0.0))
    n = F.count(F.lit(1))
    return table.agg(
        n.alias("signals"), best.alias("best_ic_tstat"), (F.lit(0.05) / F.greatest(n, F.lit(1))).alias("bonferroni_alpha"),
        (n > 1).alias("multiple_testing_warning"), (best > hurdle).alias("pass"))


def adjusted_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Bias-adjusted skewness and Pearson kurtosis (3 for a normal) per group."""
    n = F.count(value).cast("double")
    g1, g2 = F.skewness(value), F.kurtosis(value)
    return df.groupBy(key).agg(n.cast("bigint").alias("n"), g1.alias("g1"), g2.alias("g2"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).withColumns({
        "skewness": F.when(F.col("n") >= 3, F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)),
        "kurtosis": F.when(F.col("n") >= 4, F.try_divide(F.col("n") - 1, (F.col("n") - 2) * (F.col("n") - 3)) * ((F.col("n") + 1) * F.col("g2") + 6) + 3),
    }).drop("g1", "g2")


def expected_null_sharpe(df: DataFrame, trials: str = "n_trials", variance: str = "trials_variance") -> DataFrame:
    """Expected best Sharpe of ``trials`` unskilled tries."""
    n = F.greatest(F.col(trials).cast("double"), F.lit(2.0))
    bar = F.sqrt(F.greatest(variance, F.lit(0.0))) * (
        (1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * F.exp(F.lit(1.0)))))
    searched = (F.col(trials) >= 2) & (F.coalesce(F.col(variance), F.lit(0.0)) > 0)
    return df.withColumn("expected_sharpe_null", F.when(searched, bar).otherwise(F.lit(0.0)))


def deflated_sharpe(df: DataFrame) -> DataFrame:
    """Probability that the true Sharpe beats the benchmark, given how many trials were made.

    Input: observed_sr, n_trials, skewness, kurtosis, n_obs, trials_variance[, benchmark_sr]. Too few
    observations or a degenerate spread score 0 with a note.
    """
    bench = F.col("benchmark_sr") if "benchmark_sr" in df.columns else F.lit(0.0)
    obs = F.col("observed_sr") - bench
    spread = 1 - F.col("skewness") * obs + (F.col("kurtosis") - 1) / 4 * obs * obs
    good = (F.col("n_obs") >= 2) & (F.coalesce(spread, F.lit(-1.0)) > 0)
    stat = (obs - F.col("expected_sharpe_null")) * F.sqrt(F.greatest(F.col("n_obs") - 1, F.lit(0))) / F.sqrt(F.when(good, spread))
    return expected_null_sharpe(df).withColumns({
        "dsr": F.coalesce(F.when(good, normal_cdf(stat)), F.lit(0.0)),
        "note": F.when(F.col("n_obs") < 2, "insufficient_observations").when(~good, "degenerate_return_distribution"),
    })


def deflated_sharpe_strict(df: DataFrame, use_adjustment: bool = True) -> DataFrame:
    """As ``deflated_sharpe`` with moments from the series; a row that cannot be scored says why and
    has no score. Input: observed_sr, n_trials, n, std, skewness, kurtosis, trials_variance."""
    obs = F.col("observed_sr")
    spread = (1 - F.col("skewness") * obs + (F.col("kurtosis") - 1) / 4 * obs * obs) if use_adjustment else F.lit(1.0)
    error = (
        F.when(F.col("n") < 4, "too_few_observations")
        .when(F.col("skewness").isNull() | F.col("kurtosis").isNull() | F.isnan("skewness") | F.isnan("kurtosis"), "moments_uncomputable")
        .when((F.col("std") < STD_FLOOR) & (obs != 0), "zero_variance_with_sharpe")
        .when(F.col("n_trials") < 1, "no_trials")
        .when((F.col("n_trials") > 1) & F.col("trials_variance").isNull(), "trial_variance_missing")
        .when(F.col("trials_variance") < 0, "trial_variance_negative")
        .when(spread <= 0, "degenerate_denominator")
    )
    scored = expected_null_sharpe(df.withColumn("error", error))
    stat = (obs - F.col("expected_sharpe_null")) * F.sqrt(F.greatest(F.col("n") - 1, F.lit(0))) / F.sqrt(F.when(F.col("error").isNull(), spread))
    return scored.withColumn("dsr", F.when(F.col("error").isNull(), normal_cdf(stat)))


# --- trials and members ----------------------------------------------------------------------

def trial_conflicts(trials: DataFrame) -> DataFrame:
    """Log rows that contradict themselves: neither a Sharpe nor a reason, or both."""
    has, why = F.col("sharpe").isNotNull(), F.col("exclusion_reason").isNotNull()
    return trials.where((has & why) | (~has & ~why))


def trial_counts(trials: DataFrame, key: str = "search") -> DataFrame:
    return trials.groupBy(key).agg(
        F.count(F.lit(1)).alias("raw_n_trials"), F.count("sharpe").alias("valid_n_trials"),
        F.count_if(F.col("exclusion_reason") == "data_error").alias("data_errors"),
        F.count_if(F.col("exclusion_reason") == "insufficient_sample").alias("insufficient_samples"))


def _pair_products(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts, sums and products of every two series of one group of tiles, by matrix products."""
    bars, at = np.unique(rows["at"].to_numpy(), return_inverse=True)
    block, ret, ids = rows["tile"].to_numpy(), rows["ret"].to_numpy(), rows["id"].to_numpy(dtype=object)

    def matrices(which):
        mine = block == which
        who, names = pd.factorize(ids[mine], sort=True)
        there, value = np.zeros((2, len(bars), len(names)))
        there[at[mine], who], value[at[mine], who] = 1.0, ret[mine]
        return names, there, value

    low, high = rows["low"].iat[0], rows["high"].iat[0]
    names, there, value = matrices(low)
    others, there_too, value_too = matrices(high) if high != low else (names, there, value)
    n = there.T @ there_too
    i, j = np.nonzero(np.triu(n, 1) if high == low else n)
    sums = {"n": n, "sum_a": value.T @ there_too, "sum_b": there.T @ value_too, "square_a": (value * value).T @ there_too,
            "square_b": there.T @ (value_too * value_too), "product": value.T @ value_too}
    out = pd.DataFrame({"a": names[i], "b": others[j], **{c: m[i, j] for c, m in sums.items()}})
    turned = (out["a"] > out["b"]).to_numpy(dtype=bool)
    for x, y in (("a", "b"), ("sum_a", "sum_b"), ("square_a", "square_b")):
        out[x], out[y] = out[y].where(turned, out[x]), out[x].where(turned, out[y])
    return out


def pairwise_correlation(series: DataFrame, keys=(), minimum: int = 0) -> DataFrame:
    """Correlation of every two series (id, timestamp, ret) on their common bars, and how many those are.

    Blocked Gram matrices: series and bars are dealt by hash into tiles whose number follows from the input, a tile meets
    every other tile of the same bars, and two tiles give the sums of all their pairs by matrix products. So there is no
    row of two series and a bar: a pair has one row per block of bars, and these are added up. Returns are measured from
    the mean of their series, which keeps the digits of the sums. A series has one row per bar; bars whose return is null
    or not finite do not count. Two series of which one does not vary on the common bars have no correlation.
    """
    keys = list(keys)
    known = series.select(*keys, "timestamp", "id", clean("ret").alias("ret")).where("ret is not null and id is not null and timestamp is not null")
    blocks = lambda c, size: F.ceil(F.approx_count_distinct(c) / size).cast("int")
    sizes = known.groupBy(*keys).agg(blocks("id", TILE_SERIES).alias("tiles"), blocks("timestamp", TILE_BARS).alias("spans"))
    dealt = known.withColumn("ret", F.col("ret") - F.avg("ret").over(Window.partitionBy(*keys, "id"))).join(sizes, keys or F.lit(True)).select(
        *keys, "id", "ret", F.unix_micros("timestamp").alias("at"), F.pmod(F.xxhash64("timestamp"), F.col("spans")).cast("int").alias("span"),
        F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = dealt.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other")

    def tile_pair(key, rows):
        return _pair_products(rows).assign(**dict(zip(keys, key)))

    sums = ("n", "sum_a", "sum_b", "square_a", "square_b", "product")
    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*keys).schema], "a string", "b string", *[f"{c} double" for c in sums]])
    parts = met.groupBy(*keys, "span", "low", "high").applyInPandas(tile_pair, types)
    added = parts.groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.col("n")

    def moment(x, y, total):
        return F.col(total) - F.col(x) * F.col(y) / n

    def varies(c):
        around = moment(f"sum_{c}", f"sum_{c}", f"square_{c}")
        return (n > 1) & (around > F.col(f"square_{c}") * VARIES) & (F.sqrt(around / (n - 1)) >= STD_FLOOR)

    corr = moment("sum_a", "sum_b", "product") / F.sqrt(moment("sum_a", "sum_a", "square_a")) / F.sqrt(moment("sum_b", "sum_b", "square_b"))
    kept = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))
    return added.select(*keys, "a", "b", F.when(varies("a") & varies("b") & (n >= minimum), kept).alias("corr"), n.cast("bigint").alias("overlap"))


def effective_trials(series: DataFrame, threshold: float = 0.9, key: str = "search") -> DataFrame:
    """Trials that count as distinct: in id order, each joins the first cluster all of whose members
    correlate with it above the threshold, or starts its own.

    Correlations are a distributed aggregation; only the close pairs of a search reach its fold.
    """
    close = pairwise_correlation(series, [key], MIN_OVERLAP).where(F.col("corr") > threshold).select(key, "a", "b")
    alone = series.select(key, F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).distinct()

    def first_fit(rows: pd.DataFrame) -> pd.DataFrame:
        linked = rows[rows["b"].notna()]
        near = set(zip(linked["a"], linked["b"])) | set(zip(linked["b"], linked["a"]))
        clusters: list[list[str]] = []
        for trial in sorted(rows.loc[rows["b"].isna(), "a"]):
            home = next((c for c in clusters if all((trial, other) in near for other in c)), None)
            if home is None:
                clusters.append([trial])
            else:
                home.append(trial)
        return pd.DataFrame({key: [rows[key].iloc[0]], "effective_n_trials": [len(clusters)]})

    return close.unionByName(alone).groupBy(key).applyInPandas(first_fit, f"{key} string, effective_n_trials long")


def common_bars(members: DataFrame, keys=()) -> DataFrame:
    """Rows on bars where every member of the group has a return."""
    size = members.groupBy(*keys).agg(F.count_distinct("id").alias("size")) if keys else members.agg(F.count_distinct("id").alias("size"))
    per_bar = members.groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("present"))
    on = list(keys) if keys else F.lit(True)
    full = per_bar.join(size, on).where("present = size").select(*keys, "timestamp")
    return members.join(full, [*keys, "timestamp"], "left_semi")


def ensemble_precheck(members: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """Whether the members of a group are diverse enough to average."""
    pairs = pairwise_correlation(common_bars(members, [key]), [key])
    count = members.groupBy(key).agg(F.count_distinct("id").alias("members"))
    close = pairs.groupBy(key).agg(F.max("corr").alias("max_corr"), F.count_if(F.col("corr") > threshold).alias("close_pairs"))
    all_pairs = F.col("members") * (F.col("members") - 1) / 2
    return count.join(close, key, "left").select(
        key, "members", F.coalesce("max_corr", F.lit(0.0)).alias("max_pairwise_corr"), F.coalesce("close_pairs", F.lit(0)).alias("redundant_pairs"),
        F.when((F.coalesce("close_pairs", F.lit(0)) > 0) & (F.col("close_pairs") >= all_pairs), "BLOCK_ENSEMBLE")
        .when(F.col("close_pairs") > 0, "DROP_REDUNDANT").otherwise("PROCEED").alias("recommendation"))


def ensemble_returns(members: DataFrame, key: str, precheck: DataFrame | None = None) -> DataFrame:
    """Equal-weight mean of the members on their common bars, without blocked groups."""
    rows = common_bars(members, [key])
    if precheck is not None:
        rows = rows.join(precheck.where("recommendation = 'BLOCK_ENSEMBLE'").select(key), key, "left_anti")
    return rows.groupBy(key, "timestamp").agg(F.avg("ret").alias("ret"))
