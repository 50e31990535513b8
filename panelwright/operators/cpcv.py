"""Combinatorial purged cross-validation."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import STD_FLOOR
from ..functions.expanding import expanding_rank
from ..functions.numeric import ratio
from ..functions.windows import full, running, through
from .factors import bar_index


def _group_bounds(n: Column, groups: int, group: Column) -> tuple[Column, Column]:
    """First and last position of a contiguous group when the remainder goes to the first groups."""
    size, extra = F.floor(n / groups), n % groups
    low = group * size + F.least(group, extra)
    return low, low + size + F.when(group < extra, F.lit(1)).otherwise(F.lit(0)) - 1


def group_choices(spark: SparkSession, n_groups: int, n_test: int) -> DataFrame:
    """(fold_id, test_groups): every choice of test groups in lexicographic order, each found from its number alone.

    Group by group, as many choices go with it as the groups behind it allow: a number below that takes the group, any
    other goes on without it and less by so many.
    """
    behind = F.array(*[F.array(*[F.lit(comb(n_groups - 1 - g, k - 1) if k else 0).cast("bigint") for k in range(n_test + 1)]) for g in range(n_groups)])

    def take(state, group):
        here = F.element_at(F.element_at(behind, group + 1), state["missing"] + 1)
        taken = (state["missing"] > 0) & (state["left"] < here)
        return F.when(taken, F.struct(state["left"].alias("left"), (state["missing"] - 1).alias("missing"), F.concat(state["groups"], F.array(group)).alias("groups"))).otherwise(
            F.struct((state["left"] - here).alias("left"), state["missing"].alias("missing"), state["groups"].alias("groups")))

    start = F.struct(F.col("id").alias("left"), F.lit(n_test).alias("missing"), F.array().cast("array<int>").alias("groups"))
    groups = F.aggregate(F.sequence(F.lit(0), F.lit(n_groups - 1)), start, take, lambda state: state["groups"])
    return spark.range(comb(n_groups, n_test)).select(F.col("id").cast("int").alias("fold_id"), groups.alias("test_groups"))


def cpcv_splits(panel: DataFrame, n_groups: int = 10, n_test: int = 2, embargo: float = 0.01, purge: float = 0.01) -> DataFrame:
    """(fold_id, timestamp, side) for every choice of test groups. Training bars within the purge of a
    test group, or in the embargo after it, belong to neither side.

    Groups are contiguous, so a bar is checked against the few bounds of its fold's test groups.
    """
    if n_groups < 2 or not 1 <= n_test < n_groups:
        raise ValueError("need 2 <= n_groups and 1 <= n_test < n_groups")
    bars = bar_index(panel)
    counted = bars.join(bars.agg(F.count(F.lit(1)).alias("n")), F.lit(True)).where(F.col("n") >= n_groups)
    folds = group_choices(panel.sparkSession, n_groups, n_test)

    def length(share):
        return F.greatest(F.lit(1), F.bround(F.col("n") * share)).cast("bigint") if share > 0 else F.lit(0)

    p = F.col("idx")

    def inside(before, after):
        def check(g):
            low, high = _group_bounds(F.col("n"), n_groups, g)
            return (p >= low - before) & (p <= high + after)
        return F.exists("test_groups", check)

    after = F.greatest(length(purge), length(embargo))
    side = F.when(inside(F.lit(0), F.lit(0)), "test").when(~inside(length(purge), after), "train")
    return counted.join(folds, F.lit(True)).withColumn("side", side).where("side is not null").select("fold_id", "timestamp", "idx", "side")


def vol_regime(panel: DataFrame, bars: int = 30) -> DataFrame:
    """Volatility regime of each bar by the expanding percentile of a reference price's volatility.

    The reference price of a bar is that of its last asset in name order.
    """
    ref = panel.groupBy("timestamp").agg(F.max_by("price", "asset").alias("price")).withColumn("series", F.lit("reference"))
    w = Window.partitionBy("series").orderBy("timestamp")
    rets = ref.withColumn("r", F.try_divide("price", F.lag("price").over(w)) - 1)
    vols = rets.withColumn("vol", F.round(full(F.stddev_samp, "r", through(w, bars), bars), 12)).select("series", "timestamp", "vol")
    rank = F.col("vol_rank")
    label = F.when(rank >= 2 / 3, "high_vol").when(rank <= 1 / 3, "low_vol").otherwise("mid_vol")
    ranked = expanding_rank(vols, ["series"], "vol", "vol_rank", bars).withColumn("vol_rank", F.nanvl("vol_rank", F.lit(None).cast("double")))
    return ranked.select("timestamp", "vol", "vol_rank", label.alias("regime"))


def cpcv_paths(returns: DataFrame, splits: DataFrame, regimes: DataFrame, ppy: float) -> DataFrame:
    """One row per fold from runs named ``<fold>|train`` and ``<fold>|test``."""
    parts = F.split("run_id", "\\|")
    rows = returns.withColumns({"fold_id": parts[0].cast("int"), "side": parts[1]})
    w = Window.partitionBy("run_id").orderBy("idx")
    rows = rows.withColumn("curve_drawdown", F.col("equity") / F.max("equity").over(running(w)) - 1)
    test, train = F.col("side") == "test", F.col("side") == "train"
    active = F.when(test & (F.col("idx") > 0), F.col("ret"))
    spread = F.stddev_samp(active)
    last, first = F.max_by("equity", F.when(test, F.col("idx"))), F.min_by("equity", F.when(test, F.col("idx")))
    paths = rows.groupBy("fold_id").agg(
        F.coalesce(ratio(F.avg(active), F.when(spread >= STD_FLOOR, spread)) * (ppy ** 0.5), F.lit(0.0)).alias("sharpe_oos"),
        (last / first - 1).alias("test_return"),
        F.min(F.when(train, F.col("curve_drawdown"))).alias("max_dd_train"), F.min(F.when(test, F.col("curve_drawdown"))).alias("max_dd_oos"))
    labelled = splits.where("side = 'test'").join(regimes.select("timestamp", "regime"), "timestamp").groupBy("fold_id").agg(
        F.mode("regime", True).alias("regime"))
    return paths.join(labelled, "fold_id", "left").fillna("unknown", ["regime"])


def cpcv_summary(paths: DataFrame, key: str | None = None) -> DataFrame:
    """Profitability, drawdowns, and whether one regime earns over 80% of all profit."""
    keys = [key] if key else []
    gain = F.greatest(F.col("test_return"), F.lit(0.0))
    by_regime = paths.groupBy(*keys, "regime").agg(
        F.sum(gain).alias("profit"), F.count(F.lit(1)).alias("folds"), F.count_if(F.col("test_return") > 0).alias("profitable"),
        F.sum("sharpe_oos").alias("sharpe_sum"), F.min("max_dd_train").alias("dd_train"), F.min("max_dd_oos").alias("dd_oos"))
    total = F.sum("profit")
    return by_regime.groupBy(*keys).agg(
        F.sum("folds").alias("n_folds"), (F.sum("profitable") / F.sum("folds")).alias("pct_profitable_folds"),
        (F.sum("sharpe_sum") / F.sum("folds")).alias("sharpe_mean"), F.min("dd_train").alias("max_dd_walk_forward"), F.min("dd_oos").alias("max_dd_oos"),
        F.coalesce(ratio(F.max("profit"), total) > 0.8, F.lit(False)).alias("regime_concentration_flag"),
        F.coalesce((F.min("dd_train") < -1) | (F.min("dd_oos") < -1), F.lit(False)).alias("ruin_flag"))


def gap_jump_audit(returns: DataFrame) -> DataFrame:
    """Drawdown of each run with and without the bars that jump over a hole in its slice."""
    w = Window.partitionBy("run_id").orderBy("idx")
    whole = Window.partitionBy("run_id")
    step = F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(w))
    rows = returns.withColumn("step", step).withColumn("jump", F.coalesce(F.col("step") > F.median("step").over(whole) * 1.5, F.lit(False)))
    first = F.col("idx") == 0
    rows = rows.withColumns({
        "raw": F.product(F.when(first, F.lit(1.0)).otherwise(F.col("ret") + 1)).over(running(w)),
        "flat": F.product(F.when(first | F.col("jump"), F.lit(1.0)).otherwise(F.col("ret") + 1)).over(running(w)),
    })
    rows = rows.withColumns({f"dd_{c}": F.col(c) / F.max(c).over(running(w)) - 1 for c in ("raw", "flat")})
    return rows.groupBy("run_id").agg(
        F.min("dd_raw").alias("dd_raw"), F.min("dd_flat").alias("dd_nogap"), F.count_if("jump").alias("gap_bars"),
        (F.min("dd_raw") - F.min("dd_flat")).alias("gap_contribution"))
