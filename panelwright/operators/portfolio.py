"""Long/short books over ranked bars, and their returns over a grid of runs.

Every profit and cost term of a bar is proportional to the equity before the bar, and weights do
not drift between rebalances. So the work splits in three levels, each far smaller than the last:

* ``series``: ranked rows, one per (series, bar, asset), prepared once per signal or slice;
* ``books``: which assets are held when, a few rows per bar, free of capital, costs and scale;
* ``runs``: scalars per bar and run. Costs, exposure, volatility target and capital only multiply
  per-bar sums of a book, so a hundred cost levels add a hundred rows per bar, not a hundred
  backtests.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import BAR_YEARS
from ..functions.numeric import ratio
from ..functions.windows import per_asset, running
from ..session import materialise
from .ranking import bar_ends, contenders

SECONDS_PER_YEAR = 365.25 * 86400.0

# Defaults of one run. A run row overrides any of them.
RUN_DEFAULTS = {
    "gross": 2.0, "fee_rate": 0.0004, "slip_rate": 0.0005, "cost_multiplier": 1.0, "tiered": False,
    "vol_target": 0.0, "vol_lookback": 30, "vol_warmup": 0.5, "initial_equity": 100_000.0,
    "funding_paid_by_long": True, "max_drawdown": 0.25, "daily_loss": 0.05, "max_participation": 0.05,
}
BOOK_DEFAULTS = {"n_long": 2, "n_short": 2, "rebalance_every": 1, "min_gap": 0.0}


# --- configuration ---------------------------------------------------------------------------

def run_grid(spark: SparkSession, **dimensions) -> DataFrame:
    """One row per combination of the given values; single values are constants of the grid."""
    settings = {**BOOK_DEFAULTS, **RUN_DEFAULTS, **dimensions}
    grid = spark.range(0, 1, 1, 1).select()
    for name, values in settings.items():
        options = list(values) if isinstance(values, (list, tuple)) else [values]
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return grid


def valid_run() -> Column:
    """The conditions a run row must meet."""
    c = F.col
    return (
        (c("n_long") >= 1) & (c("n_short") >= 1) & (c("initial_equity") > 0) & (c("gross") > 0)
        & (c("fee_rate") >= 0) & (c("slip_rate") >= 0) & (c("min_gap") >= 0) & (c("rebalance_every") >= 1)
        & (c("max_drawdown") > 0) & (c("max_drawdown") < 1) & (c("daily_loss") > 0) & (c("daily_loss") < 1)
        & (c("vol_target") >= 0) & (c("vol_lookback") >= 2) & (c("vol_warmup") > 0) & (c("vol_warmup") <= 1)
        & (c("max_participation") > 0) & (c("max_participation") <= 1) & (c("cost_multiplier") >= 0)
    )


# --- series ----------------------------------------------------------------------------------

def prepare_series(rows: DataFrame, keys=(), liquidity: str | None = None, deepest: int | None = None) -> DataFrame:
    """Index the bars of each series and attach what a position needs at a bar.

    Input: ranked rows (keys, timestamp, asset, sig, price, and optionally funding_rate, fee_tier,
    slip_tier). Rows without valid liquidity leave the bar, when a liquidity column is named.
    The bars are stored first, so that by their measured size they go to the rows and a crowded bar is
    not shuffled into one task. Output adds the columns of ``series_bars``, ``bar_return`` (price move since the previous bar, if
    the asset was there) and ``last_idx`` (the last bar of the asset's unbroken presence).

    With ``deepest``, which bounds n_long + n_short of all books, only assets that a book can hold are prepared; every bar that
    has rows keeps some. Worth it for many series, whose rows would otherwise be shuffled and stored once per series.
    """
    bars = materialise(series_bars(rows, keys))
    if liquidity:
        rows = rows.where((F.col(liquidity) > 0) & (F.abs(liquidity) < float("inf")))
    indexed = (contenders(rows, keys, deepest) if deepest else rows).join(bars, [*keys, "timestamp"])
    w = per_asset(*keys)
    follows = F.lag("idx").over(w) == F.col("idx") - 1
    optional = {c: F.lit(None).cast("double") for c in ("fee_tier", "slip_tier", "funding_rate") if c not in rows.columns}
    island = Window.partitionBy(*keys, "asset", "island")
    return (
        indexed.withColumns({
            **optional,
            "bar_return": F.when(follows, F.try_divide("price", F.lag("price").over(w)) - 1),
            "island": F.col("idx") - F.row_number().over(w),
        })
        .withColumn("last_idx", F.max("idx").over(island)).drop("island")
    )


def series_bars(rows: DataFrame, keys) -> DataFrame:
    """Bars of each series: number, next bar, how many there are, and periods per year.

    One row per series and bar, so its windows stay small.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("timestamp")
    following = F.lead("timestamp").over(order)
    step = (F.unix_micros("next_timestamp") - F.unix_micros("timestamp")) / 1e6
    return (
        rows.select(*keys, "timestamp").distinct()
        .withColumns({"idx": F.row_number().over(order).cast("bigint") - 1, "next_timestamp": following})
        .withColumns({"n_bars": F.count(F.lit(1)).over(whole), "ppy": periods_per_year(F.median(step).over(whole))})
    )


def periods_per_year(median_seconds: Column) -> Column:
    """365, 2190 and 8760 for bars within 1% of a day, four hours and an hour; otherwise continuous."""
    ppy = SECONDS_PER_YEAR / median_seconds
    for width, periods in reversed(BAR_YEARS):
        ppy = F.when(F.abs(median_seconds - width) / width <= 0.01, F.lit(periods)).otherwise(ppy)
    return F.when(median_seconds > 0, ppy).otherwise(F.lit(365.0))


def emptied_bars(series: DataFrame, keys) -> DataFrame:
    """Bars that kept no row of a series, one per stretch of them.

    A stretch is named by its first bar; one at the start of a series, which has no bar before it, by the first bar left.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    bars = series.select(*keys, "idx", "timestamp", "next_timestamp", "n_bars").distinct().withColumns({
        "opening": F.lag("idx").over(w).isNull() & (F.col("idx") > 0),
        "hole": F.coalesce(F.lead("idx").over(w), "n_bars") > F.col("idx") + 1})
    lost = F.array_compact(F.array(F.when(F.col("opening"), F.col("timestamp")), F.when(F.col("hole"), F.col("next_timestamp"))))
    return bars.select(*keys, F.explode(lost).alias("timestamp"))


# --- books -----------------------------------------------------------------------------------

def book_targets(series: DataFrame, books: DataFrame, keys, deepest: int) -> DataFrame:
    """Legs every book would take at every bar. ``deepest`` bounds n_long + n_short of all books."""
    ends = bar_ends(series, keys, deepest, deepest).select(
        *keys, "timestamp", "idx", "next_timestamp", "n_bars", "ppy", "asset", "sig", "side", "place", "last_idx")
    wanted = F.when(F.col("side") == 1, F.col("n_long")).otherwise(F.col("n_short"))
    return ends.join(books, list(keys)).withColumns({
        "is_leg": F.col("place") <= wanted,
        "unit": F.col("side") / wanted,
    }).where((F.col("side") == 1) | F.col("is_leg"))


def book_bars(targets: DataFrame, keys) -> DataFrame:
    """Per book and bar: signal gap, rebalance schedule, thin flag, and when all legs will be gone."""
    leg, long = F.col("is_leg"), F.col("side") == 1
    bar = ["book_id", *keys, "idx", "timestamp", "next_timestamp", "n_bars", "ppy"]
    state = targets.groupBy(*bar, "rebalance_every", "min_gap", "n_long", "n_short").agg(
        (F.min(F.when(leg & long, F.col("sig"))) - F.max(F.when(leg & ~long, F.col("sig")))).alias("signal_gap"),
        (F.max(F.when(leg, F.col("last_idx"))) + 1).alias("gone_idx"),
        F.count_if(long).alias("ranked"),
    )
    due = (F.col("idx") % F.col("rebalance_every") == 0) & (F.col("signal_gap") >= F.col("min_gap"))
    return state.select(*bar, "signal_gap", "gone_idx", due.alias("due"), (F.col("ranked") < F.col("n_long") + F.col("n_short")).alias("thin"))


def rebalances(bars: DataFrame) -> DataFrame:
    """Bars on which each book trades to its targets, and the bar the holding ends before.

    A holding ends at the next due bar, or at the bar on which its last leg has vanished. No step passes a due bar, so every due bar
    is traded, and only bars that such a break leads to are left to find. They follow by doubled pointers: every round takes what
    the books' bars reach by the pointers so far and joins the pointers with themselves, until no pointer is left.
    """
    book = Window.partitionBy("book_id")
    earlier, later = book.orderBy("idx"), book.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    marked = bars.select("book_id", "idx", "due", "gone_idx").withColumns({
        "next_due": F.min(F.when(F.col("due"), F.col("idx"))).over(later), "previous": F.lag("idx").over(earlier)})
    marked = materialise(marked.withColumn("until_idx", F.least("next_due", "gone_idx")))
    reached = marked.select("book_id", F.col("idx").alias("to"), F.explode(F.sequence(F.coalesce(F.col("previous") + 1, "idx"), "idx")).alias("gone_idx"))
    breaks = marked.where("next_due is null or gone_idx < next_due").join(reached, ["book_id", "gone_idx"])
    jumps = materialise(breaks.where("next_due is null or to < next_due").select("book_id", "idx", "to"))
    taken = marked.where("due or previous is null").select("book_id", "idx")
    while not jumps.isEmpty():
        taken = materialise(taken.union(taken.join(jumps, ["book_id", "idx"]).select("book_id", F.col("to").alias("idx"))).distinct())
        further = jumps.select("book_id", F.col("idx").alias("to"), F.col("to").alias("beyond"))
        jumps = materialise(jumps.join(further, ["book_id", "to"]).select("book_id", "idx", F.col("beyond").alias("to")))
    return marked.join(taken, ["book_id", "idx"]).select("book_id", "idx", "until_idx")


def holdings(targets: DataFrame, chain: DataFrame) -> DataFrame:
    """Legs held at each bar: from their rebalance until the next, or until they first vanish."""
    held = targets.where("is_leg").join(chain, ["book_id", "idx"])
    last = F.least(F.col("until_idx") - 1, F.col("last_idx"))
    return held.select(
        "book_id", "asset", "side", "unit", "last_idx", F.col("idx").alias("entry_idx"),
        F.explode(F.sequence("idx", last)).alias("idx"))


def moves(held: DataFrame) -> DataFrame:
    """Units of every (book, bar, asset) before and after the bar's trading.

    A leg held at a bar is what the book has after trading there and before trading at the next.
    """
    def at(shift, now, before):
        return F.struct((F.col("idx") + shift).alias("idx"), now.alias("unit_now"), before.alias("unit_before"))

    unit, none = F.col("unit"), F.lit(0.0)
    return (
        held.select("book_id", "asset", F.explode(F.array(at(0, unit, none), at(1, none, unit))).alias("at"))
        .groupBy("book_id", F.col("at.idx").alias("idx"), "asset")
        .agg(F.sum("at.unit_now").alias("unit_now"), F.sum("at.unit_before").alias("unit_before"))
    )


def priced_moves(moved: DataFrame, series: DataFrame, bars: DataFrame, keys) -> DataFrame:
    """Moves with the asset's own bar: return, funding and cost tiers; missing when it is absent."""
    extra = [c for c in ("quote_volume", "volume") if c in series.columns]
    rows = series.select(*keys, "idx", "asset", "price", "bar_return", "funding_rate", "fee_tier", "slip_tier", *extra)
    stamps = bars.select("book_id", *keys, "idx", "timestamp", "ppy", "rebalanced")
    return moved.join(stamps, ["book_id", "idx"]).join(rows, [*keys, "idx", "asset"], "left")


def book_terms(priced: DataFrame) -> DataFrame:
    """Per book and bar sums at unit weight: earnings, and amounts entered, left and kept.

    Kept legs cost only when the run's scale changes; a leg that changes side is left and entered.
    """
    kept = F.signum("unit_now") == F.signum("unit_before")
    enter = F.when(kept, F.lit(0.0)).otherwise(F.abs("unit_now"))
    leave = F.when(kept, F.lit(0.0)).otherwise(F.abs("unit_before"))
    stay = F.when(kept, F.abs("unit_now")).otherwise(F.lit(0.0))
    present = F.col("price").isNotNull()
    sums = [
        F.sum(F.col("unit_before") * F.coalesce("bar_return", F.lit(0.0))).alias("price_term"),
        F.sum(F.col("unit_before") * F.coalesce("funding_rate", F.lit(0.0))).alias("funding_term"),
        F.sum(F.when(present, F.lit(0.0)).otherwise(leave)).alias("leave_absent"),
    ]
    for name, amount in (("enter", enter), ("leave", leave), ("stay", stay)):
        sums.append(F.sum(amount).alias(name))
        for cost in ("fee", "slip"):
            tier = F.col(f"{cost}_tier")
            sums.append(F.sum(F.when(present, amount * F.coalesce(tier, F.lit(0.0))).otherwise(0.0)).alias(f"{name}_{cost}"))
            sums.append(F.sum(F.when(present & tier.isNull(), amount).otherwise(0.0)).alias(f"{name}_{cost}_flat"))
    return priced.groupBy("book_id", "idx", "timestamp", "ppy", "rebalanced").agg(*sums)


def stressed_multiplier(fee: float, slip: float) -> float:
    """What a flat cost level is as a multiple of the default rates: how tiered books are stressed."""
    return max(fee / RUN_DEFAULTS["fee_rate"], slip / RUN_DEFAULTS["slip_rate"])


# --- runs ------------------------------------------------------------------------------------

def _bar_cost(now: Column, before: Column, kind: str) -> Column:
    """Cost of one bar per unit of equity at half exposure one, tiered or flat. Legs without a tier pay the flat rate."""
    amount = lambda name: F.col(f"{name}_{kind}") + F.col(f"{name}_{kind}_flat") * F.col(f"{kind}_rate")
    flat = (F.col("enter") * now + F.col("leave") * before + F.col("stay") * F.abs(now - before)) * F.col(f"{kind}_rate")
    tier = (
        amount("enter") * now + amount("leave") * before
        + amount("stay") * F.abs(now - before) + F.col("leave_absent") * before * F.col(f"{kind}_rate")
    )
    return F.when(F.col("tiered"), tier).otherwise(flat) * F.col("cost_multiplier")


def _follow_scale(bars: pd.DataFrame) -> pd.DataFrame:
    """Volatility targeting of one run: the scale set at a rebalance comes from the run's own past
    returns, which depend on earlier scales, so the bars are folded in order."""
    bars = bars.sort_values("idx").reset_index(drop=True)
    first = bars.iloc[0]
    half, target = first["gross"] / 2.0, first["vol_target"] / first["ppy"] ** 0.5
    lookback, warmup = int(first["vol_lookback"]), float(first["vol_warmup"])
    kinds = ("fee", "slip")
    cost = {k: np.zeros((len(bars), 3)) for k in kinds}
    for k in kinds:
        for j, part in enumerate(("enter", "leave", "stay")):
            tier = bars[f"{part}_{k}"] + bars[f"{part}_{k}_flat"] * first[f"{k}_rate"]
            cost[k][:, j] = tier if first["tiered"] else bars[part] * first[f"{k}_rate"]
        if first["tiered"]:
            cost[k][:, 1] += bars["leave_absent"] * first[f"{k}_rate"]
    total = (cost["fee"] + cost["slip"]) * first["cost_multiplier"]
    sign = -1.0 if first["funding_paid_by_long"] else 1.0
    earn = (bars["price_term"] + sign * bars["funding_term"]).to_numpy()
    trades = bars["rebalanced"].to_numpy(dtype=bool)
    scales, returns, scale = np.empty(len(bars)), np.empty(len(bars)), 0.0
    for t in range(len(bars)):
        held = scale
        if trades[t]:
            scale = warmup
            if t >= lookback:
                spread = returns[t - lookback:t].std(ddof=1)
                scale = min(1.0, target / spread) if spread > 0 else 1.0
        scales[t] = scale
        returns[t] = half * (held * earn[t] - total[t] @ (scale, held, abs(scale - held)))
    return pd.DataFrame({"run_id": bars["run_id"], "idx": bars["idx"], "scale": scales})


def run_returns(terms: DataFrame, runs: DataFrame) -> DataFrame:
    """Returns of every run (run_id, book_id, settings) at every bar, split into price, funding, fee
    and slippage parts. Runs without a volatility target never leave the JVM."""
    rows = terms.join(runs, "book_id")
    fixed = rows.where("vol_target = 0").withColumn("scale", F.lit(1.0))
    targeted = rows.where("vol_target > 0")
    scales = targeted.groupBy("run_id").applyInPandas(_follow_scale, "run_id string, idx long, scale double")
    return _equity(fixed.unionByName(targeted.join(scales, ["run_id", "idx"])))


def _equity(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("idx")
    held = F.coalesce(F.lag("scale").over(w), F.lit(0.0))
    half = F.col("gross") / 2
    sign = F.when(F.col("funding_paid_by_long"), F.lit(-1.0)).otherwise(F.lit(1.0))
    now, past = F.col("scale"), F.col("held_scale")
    rated = rows.withColumn("held_scale", held).withColumns({
        "price_return": half * past * F.col("price_term"),
        "funding_return": half * sign * past * F.col("funding_term"),
        "fee_return": half * _bar_cost(now, past, "fee"),
        "slip_return": half * _bar_cost(now, past, "slip"),
        "turnover": half * (F.col("enter") * now + F.col("leave") * past + F.col("stay") * F.abs(now - past)),
    }).withColumn("ret", F.col("price_return") + F.col("funding_return") - F.col("fee_return") - F.col("slip_return"))
    growth = F.product(F.col("ret") + 1).over(running(w))
    return (
        rated.withColumn("growth", growth)
        .withColumns({
            "equity": F.col("initial_equity") * F.col("growth"),
            "equity_before": F.col("initial_equity") * F.coalesce(F.lag("growth").over(w), F.lit(1.0)),
        })
        .withColumn("peak", F.greatest(F.col("initial_equity"), F.max("equity").over(running(w))))
        .withColumns({
            "drawdown": F.col("equity") / F.col("peak") - 1,
            "price_pnl": F.col("price_return") * F.col("equity_before"),
            "funding_pnl": F.col("funding_return") * F.col("equity_before"),
            "fee_cost": F.col("fee_return") * F.col("equity_before"),
            "slippage_cost": F.col("slip_return") * F.col("equity_before"),
            "total_pnl": F.col("ret") * F.col("equity_before"),
        })
    )


def run_summary(returns: DataFrame) -> DataFrame:
    """One row per run. Return statistics leave out the entry bar; equity includes it."""
    active = F.col("idx") > 0
    r = F.when(active, F.col("ret"))
    n = F.count(r)
    spread = F.stddev_samp(r)
    final = F.max_by("equity", "idx")
    ppy, start = F.first("ppy"), F.first("initial_equity")
    return returns.groupBy("run_id").agg(
        start.alias("initial_equity"), final.alias("final_equity"),
        (final / start - 1).alias("total_return"), n.alias("periods"), ppy.alias("periods_per_year"),
        F.when(final > 0, F.pow(final / start, ppy / F.greatest(n, F.lit(1))) - 1).alias("annualized_return"),
        F.coalesce(spread * F.sqrt(ppy), F.lit(0.0)).alias("annualized_volatility"),
        F.coalesce(ratio(F.avg(r), F.when(spread > 1e-15, spread)) * F.sqrt(ppy), F.lit(0.0)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if(active & (F.col("ret") > 0)).alias("winning_periods"),
        F.count_if(active & (F.col("ret") < 0)).alias("losing_periods"),
        F.sum("fee_cost").alias("total_fees"), F.sum("slippage_cost").alias("total_slippage"),
        F.sum("price_pnl").alias("price_pnl"), F.sum("funding_pnl").alias("funding_pnl"),
        F.coalesce(F.avg(F.when(active, F.col("turnover"))), F.lit(0.0)).alias("average_turnover"),
    )


def run_positions(held: DataFrame, returns: DataFrame, bars: DataFrame) -> DataFrame:
    """Weights by run and bar with the bar they are filled on (the next one)."""
    scaled = returns.select("run_id", "book_id", "idx", "timestamp", (F.col("gross") / 2 * F.col("scale")).alias("half"))
    nexts = bars.select("book_id", "idx", F.col("next_timestamp").alias("execution_timestamp"))
    return (
        held.join(scaled, ["book_id", "idx"]).join(nexts, ["book_id", "idx"])
        .withColumn("weight", F.col("unit") * F.col("half"))
    )


def run_exposure(positions: DataFrame) -> DataFrame:
    w = F.col("weight")
    return positions.groupBy("run_id", "timestamp").agg(
        F.sum(F.greatest(w, F.lit(0.0))).alias("long_exposure"),
        F.sum(F.greatest(-w, F.lit(0.0))).alias("short_exposure"),
        F.sum(F.abs(w)).alias("gross_exposure"), F.sum(w).alias("net_exposure"))


def run_ranking(positions: DataFrame) -> DataFrame:
    """Held assets per bar as sorted lists; a bar holds at most n_long + n_short of them."""
    names = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("asset")))), ",")
    return positions.groupBy("run_id", "timestamp").agg(
        names(1).alias("long_assets"), names(-1).alias("short_assets"),
        F.count_if(F.col("side") == 1).alias("long_count"), F.count_if(F.col("side") == -1).alias("short_count"),
        (F.count(F.lit(1)) - F.count_distinct("asset")).alias("rank_overlap"))


def run_trades(priced: DataFrame, returns: DataFrame) -> DataFrame:
    """Weight changes by run, bar and asset, with their notional at the equity before the bar."""
    scaled = returns.select("run_id", "book_id", "idx", (F.col("gross") / 2).alias("half"), "scale", "held_scale",
                            "equity_before", "max_participation")
    change = F.col("half") * (F.col("unit_now") * F.col("scale") - F.col("unit_before") * F.col("held_scale"))
    return (
        priced.join(scaled, ["book_id", "idx"]).withColumn("weight_change", change).where("weight_change <> 0")
        .withColumn("notional", F.abs("weight_change") * F.col("equity_before"))
    )


def forced_exits(held: DataFrame, bars: DataFrame, series: DataFrame, keys) -> DataFrame:
    """Held legs that are absent at the next bar, with the last price seen."""
    stamps = bars.select("book_id", *keys, "idx", "n_bars", "next_timestamp")
    gone = held.where("idx = last_idx").join(stamps, ["book_id", "idx"]).where("idx < n_bars - 1")
    prices = series.select(*keys, "idx", "asset", F.col("price").alias("last_price"))
    return gone.join(prices, [*keys, "idx", "asset"]).select(
        "book_id", F.col("next_timestamp").alias("timestamp"), "asset", "last_price")


def limit_breaches(returns: DataFrame) -> DataFrame:
    """Daily loss and drawdown limits, one row per breach."""
    breaches = F.array_compact(F.array(
        F.when(F.col("ret") < -F.col("daily_loss"), F.struct(
            F.lit("daily_loss_limit").alias("type"), F.col("ret").alias("value"), (-F.col("daily_loss")).alias("limit"))),
        F.when(F.col("drawdown") < -F.col("max_drawdown"), F.struct(
            F.lit("max_drawdown_limit").alias("type"), F.col("drawdown").alias("value"), (-F.col("max_drawdown")).alias("limit"))),
    ))
    return returns.select("run_id", "timestamp", F.explode(breaches).alias("b")).select(
        "run_id", "timestamp", "b.type", F.lit(None).cast("string").alias("asset"), "b.value", "b.limit")


def capacity_breaches(trades: DataFrame, liquidity: str = "quote_volume") -> DataFrame:
    """Trades larger than the allowed share of the bar's volume."""
    allowed = F.col(liquidity) * F.col("max_participation")
    return trades.where(F.col("notional") > allowed).select(
        "run_id", "timestamp", F.lit("capacity_limit").alias("type"), "asset",
        F.col("notional").alias("value"), allowed.alias("limit"))


def violations(returns: DataFrame, trades: DataFrame, exits: DataFrame, runs: DataFrame,
               invalid: DataFrame | None = None, liquidity: str | None = None) -> DataFrame:
    """All rule breaches of all runs in one table."""
    zero = F.lit(0.0)
    forced = exits.join(runs.select("run_id", "book_id"), "book_id").select(
        "run_id", "timestamp", F.lit("forced_exit").alias("type"), "asset", zero.alias("value"), zero.alias("limit"))
    out = limit_breaches(returns).unionByName(forced)
    if liquidity:
        out = out.unionByName(capacity_breaches(trades.where("price is not null"), liquidity))
    if invalid is not None:
        out = out.unionByName(invalid.select("run_id", "timestamp", F.lit("invalid_liquidity").alias("type"), "asset", zero.alias("value"), zero.alias("limit")))
    return out


def first_breach(breaches: DataFrame) -> DataFrame:
    """The bar an enforced run halts at."""
    return breaches.groupBy("run_id").agg(F.min("timestamp").alias("halted_at"))


class Backtest:
    """The tables of a grid of runs over prepared series.

    ``books`` holds (book_id, *keys, n_long, n_short, rebalance_every, min_gap), ``runs`` holds
    (run_id, book_id) and the run settings. ``keys`` name a series, at least one column. How deep a
    bar is ranked follows from the books: the largest n_long + n_short. Tables that several steps read are written once: the series (read by
    the ranking and by the pricing of moves), the ranked legs (a few rows per bar and book) and the
    per-bar sums (one row per bar and book).
    """

    def __init__(self, series: DataFrame, books: DataFrame, runs: DataFrame, keys, deepest: int | None = None):
        self.source, self.books, self.runs, self.keys, self._deepest = series, books, runs, tuple(keys), deepest

    @cached_property
    def deepest(self) -> int:
        """Given by the caller, or read from the books, a small table."""
        return self._deepest or self.books.agg(F.max(F.col("n_long") + F.col("n_short"))).first()[0] or 1

    @cached_property
    def series(self) -> DataFrame:
        return materialise(self.source)

    @cached_property
    def targets(self) -> DataFrame:
        return materialise(book_targets(self.series, self.books, self.keys, self.deepest))

    @cached_property
    def chain(self) -> DataFrame:
        return rebalances(book_bars(self.targets, self.keys))

    @cached_property
    def bars(self) -> DataFrame:
        """Bars of every book, with the flag of a rebalance."""
        taken = self.chain.select("book_id", "idx", F.lit(True).alias("rebalanced"))
        return book_bars(self.targets, self.keys).join(taken, ["book_id", "idx"], "left").fillna(False, ["rebalanced"])

    @cached_property
    def held(self) -> DataFrame:
        return holdings(self.targets, self.chain)

    @cached_property
    def priced(self) -> DataFrame:
        return priced_moves(moves(self.held), self.series, self.bars, self.keys)

    @cached_property
    def terms(self) -> DataFrame:
        return materialise(book_terms(self.priced))

    @cached_property
    def returns(self) -> DataFrame:
        return run_returns(self.terms, self.runs)

    @property
    def positions(self) -> DataFrame:
        return run_positions(self.held, self.returns, self.bars)

    @property
    def trades(self) -> DataFrame:
        return run_trades(self.priced, self.returns)

    @property
    def exits(self) -> DataFrame:
        return forced_exits(self.held, self.bars, self.series, self.keys)

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.returns)

    @property
    def errors(self) -> DataFrame:
        """Bars of each book with too few assets to rank, none included, or with a held asset missing."""
        empty = emptied_bars(self.series, self.keys).join(self.books, list(self.keys)).select("book_id", "timestamp")
        thin = self.bars.where("thin").select("book_id", "timestamp").unionByName(empty).withColumn("error", F.lit("thin_bar"))
        missing = self.exits.select("book_id", "timestamp", F.lit("missing_price").alias("error"))
        return thin.unionByName(missing)

    def refusals(self, delist_mode: str = "error") -> DataFrame:
        """The errors for which a book is refused; with forced exits a vanished holding is none."""
        return self.errors if delist_mode == "error" else self.errors.where("error = 'thin_bar'")
