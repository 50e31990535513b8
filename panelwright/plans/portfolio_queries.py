"""Queries over long/short books: weights, trades, attribution, equity and violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as B
from ..operators.factors import asset_return, price_factors, unpivot_signals
from ..operators.ranking import drop_thin_bars, lag_for_execution, liquidity_percentile, tier_rates
from ..session import materialise
from .factor_queries import ranked
from .panels import brand_panel, market_panel, stored_market, table
from .registry import (BRAND_WEEK, FACTORS, MARKET, book_sql, count, day, equity_sql, exec_sql, q_day, q_round,
                       register, rounded, with_)

# Liquidity tiers (percentile threshold, fee, slippage) of the tiered-cost queries.
TIERS = ((0.75, 0.0005, 0.0005), (0.5, 0.0005, 0.001), (0.25, 0.0005, 0.002), (0.0, 0.0005, 0.004))
KEYS = ("signal",)
N, EVERY = 3, 5


def single_run(series, n=N, every=EVERY, **settings):
    """One book and one run of the momentum series."""
    grid = B.run_grid(series.sparkSession, signal="momentum_7", n_long=n, n_short=n, rebalance_every=every, **settings)
    config = grid.withColumns({"book_id": F.col("signal"), "run_id": F.col("signal")})
    return B.Backtest(
        series, config.select("book_id", *KEYS, *B.BOOK_DEFAULTS), config.select("run_id", "book_id", *B.RUN_DEFAULTS), KEYS, deepest=2 * n)


def momentum_book(spark, folder, n=N, every=EVERY, **settings):
    return single_run(B.prepare_series(ranked(spark, folder, panel=stored_market(spark, folder)), KEYS), n, every, **settings)


_BOOK = with_(MARKET, FACTORS, exec_sql(), book_sql(N, EVERY), equity_sql())


@register("weekly_long_short", with_(BRAND_WEEK, FACTORS, exec_sql(thin=6), book_sql(3, 1), equity_sql()) + f"""
SELECT {q_day('ts')} AS bar, {q_round('pr*equity_before', 2)} AS price_pnl, {q_round('fr*equity_before', 2)} AS funding_pnl,
  {q_round('(fee_r+slip_r)*equity_before', 2)} AS cost, {q_round('ret')} AS ret, {q_round('turnover')} AS turnover,
  {q_round('equity', 2)} AS equity, {q_round('drawdown')} AS drawdown FROM curve""")
def weekly_long_short(spark, folder):
    frame = price_factors(asset_return(materialise(brand_panel(spark, folder))))
    rows = lag_for_execution(unpivot_signals(frame, ["momentum_7"], keep=("timestamp", "asset", "price", "funding_rate")), KEYS)
    test = single_run(B.prepare_series(drop_thin_bars(rows, KEYS, 6), KEYS), 3, 1)
    return test.returns.select(
        day(), rounded("price_pnl", 2), rounded("funding_pnl", 2), rounded(F.col("fee_cost") + F.col("slippage_cost"), 2, "cost"),
        rounded("ret"), rounded("turnover"), rounded("equity", 2), rounded("drawdown"))


@register("run_grid", """
WITH g AS (SELECT signal, n, vt, cost.fee AS fee_rate, cost.slip AS slip_rate, every
  FROM (SELECT DISTINCT p_brand AS signal FROM part) s, (VALUES (0),(2),(3),(4)) n(n), (VALUES (0.0),(0.2)) v(vt),
  (SELECT unnest([{'fee':0.0004,'slip':0.0005},{'fee':0.0015,'slip':-0.004}]) AS cost) c, (VALUES (1),(5)) r(every))
SELECT signal, n::BIGINT AS n, vt::DOUBLE AS vol_target, fee_rate::DOUBLE AS fee_rate, every::BIGINT AS rebalance_every,
  (n >= 1 AND slip_rate >= 0) AS valid FROM g""")
def run_grid(spark, folder):
    brands = brand_names(spark, folder)
    costs = F.explode(F.array(*[F.struct(F.lit(f).alias("fee_rate"), F.lit(s).alias("slip_rate")) for f, s in ((0.0004, 0.0005), (0.0015, -0.004))]))
    grid = B.run_grid(spark, n_long=[0, 2, 3, 4], vol_target=[0.0, 0.2], rebalance_every=[1, 5])
    rows = brands.join(grid.drop("fee_rate", "slip_rate").withColumn("cost", costs), F.lit(True)).select("signal", "*", "cost.*")
    return rows.withColumn("n_short", F.col("n_long")).select(
        rows["signal"], count("n_long", "n"), rounded("vol_target"), rounded("fee_rate"), count("rebalance_every"), B.valid_run().alias("valid"))


def brand_names(spark, folder):
    return table(spark, folder, "part").select(F.col("p_brand").alias("signal")).distinct()


@register("signal_gap", with_(MARKET, FACTORS, exec_sql()) + f"""
SELECT {q_day('ts')} AS bar, {q_round(f'min(sig) FILTER (up <= {N}) - max(sig) FILTER (dn <= {N})')} AS signal_gap FROM legs GROUP BY ts""")
def signal_gap(spark, folder):
    return momentum_book(spark, folder).bars.select(day(), rounded("signal_gap"))


@register("rebalance_flag", with_(MARKET, FACTORS, exec_sql()) + f""", g AS (
  SELECT idx, ts, min(sig) FILTER (up <= {N}) - max(sig) FILTER (dn <= {N}) AS gap FROM legs GROUP BY 1,2)
SELECT {q_day('ts')} AS bar, (idx % {EVERY} = 0 AND gap >= 0.02) OR idx = 0 AS rebalanced FROM g""")
def rebalance_flag(spark, folder):
    return momentum_book(spark, folder, min_gap=0.02).bars.select(day(), "rebalanced")


@register("target_weights", with_(MARKET, FACTORS, exec_sql()) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round(f'CASE WHEN up <= {N} THEN 0.75/{N} ELSE -0.75/{N} END')} AS weight
FROM legs WHERE up <= {N} OR dn <= {N}""")
def target_weights(spark, folder):
    targets = momentum_book(spark, folder).targets.where("is_leg")
    return targets.select(day(), "asset", rounded(F.col("unit") * 1.5 / 2, name="weight"))


@register("positions", _BOOK + f"""
SELECT {q_day('ts')} AS bar, {q_day('next_ts')} AS execution_bar, asset, {q_round('u')} AS weight FROM pos""")
def positions(spark, folder):
    return momentum_book(spark, folder).positions.select(
        day(), day("execution_timestamp", "execution_bar"), "asset", rounded("weight"))


@register("exposure", _BOOK + f"""
SELECT {q_day('ts')} AS bar, {q_round('sum(greatest(u,0))')} AS long_exposure, {q_round('sum(greatest(-u,0))')} AS short_exposure,
  {q_round('sum(abs(u))')} AS gross_exposure, {q_round('sum(u)')} AS net_exposure FROM pos GROUP BY ts""")
def exposure(spark, folder):
    sums = B.run_exposure(momentum_book(spark, folder).positions)
    return sums.select(day(), *[rounded(f"{c}_exposure") for c in ("long", "short", "gross", "net")])


@register("ranking", _BOOK + f"""
SELECT {q_day('ts')} AS bar, coalesce(string_agg(asset, ',' ORDER BY asset) FILTER (u > 0),'') AS long_assets,
  coalesce(string_agg(asset, ',' ORDER BY asset) FILTER (u < 0),'') AS short_assets, count(*) FILTER (u > 0)::BIGINT AS long_count,
  count(*) FILTER (u < 0)::BIGINT AS short_count, (count(*) - count(DISTINCT asset))::BIGINT AS rank_overlap FROM pos GROUP BY ts""")
def ranking(spark, folder):
    lists = B.run_ranking(momentum_book(spark, folder).positions)
    return lists.select(day(), "long_assets", "short_assets", "long_count", "short_count", "rank_overlap")


@register("trades", _BOOK + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('un - up')} AS weight_change, {q_round('abs(un-up)*equity_before', 2)} AS notional
FROM mvp JOIN eq USING (idx, ts) WHERE abs(un - up) > 1e-12""")
def trades(spark, folder):
    return momentum_book(spark, folder).trades.select(day(), "asset", rounded("weight_change"), rounded("notional", 2))


@register("turnover", _BOOK + f"SELECT {q_day('ts')} AS bar, {q_round('turnover')} AS turnover FROM bar")
def turnover(spark, folder):
    return momentum_book(spark, folder).returns.select(day(), rounded("turnover"))


@register("price_pnl", _BOOK + f"SELECT {q_day('ts')} AS bar, {q_round('pr', 8)} AS price_return, {q_round('pr*equity_before', 2)} AS price_pnl FROM eq")
def price_pnl(spark, folder):
    return momentum_book(spark, folder).returns.select(day(), rounded("price_return", 8), rounded("price_pnl", 2))


@register("funding_pnl", _BOOK + f"SELECT {q_day('ts')} AS bar, {q_round('fr', 8)} AS funding_return, {q_round('fr*equity_before', 2)} AS funding_pnl FROM eq")
def funding_pnl(spark, folder):
    return momentum_book(spark, folder).returns.select(day(), rounded("funding_return", 8), rounded("funding_pnl", 2))


@register("flat_cost", with_(MARKET, FACTORS, exec_sql(), book_sql(N, EVERY), equity_sql(0.0004 * 2, 0.0005 * 2)) + f"""
SELECT {q_day('ts')} AS bar, {q_round('fee_r*equity_before', 2)} AS fee_cost, {q_round('slip_r*equity_before', 2)} AS slippage_cost FROM eq""")
def flat_cost(spark, folder):
    return momentum_book(spark, folder, cost_multiplier=2.0).returns.select(day(), rounded("fee_cost", 2), rounded("slippage_cost", 2))


def tier_sql(spread: bool = False) -> str:
    """Tier rates per ranked row, and the book's costs with them; an absent asset pays the flat rate."""
    slip = "greatest(t.slip, coalesce(s.spread, t.slip))" if spread else "t.slip"
    join = "LEFT JOIN spreads s ON s.asset = t.asset" if spread else ""
    fee_case = " ".join(f"WHEN pct >= {t} THEN {f}" for t, f, _ in TIERS)
    slip_case = " ".join(f"WHEN pct >= {t} THEN {s}" for t, _, s in TIERS)
    return f"""scored AS (
  SELECT *, round(avg(quote_volume) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),6) AS score FROM xs),
pcts AS (SELECT idx, asset, CASE WHEN score IS NOT NULL THEN (rank() OVER (PARTITION BY idx ORDER BY score NULLS LAST)
  + (count(*) OVER (PARTITION BY idx, score) - 1)/2.0)/count(score) OVER (PARTITION BY idx) END AS pct FROM scored),
tiers AS (SELECT idx, asset, CASE {fee_case} ELSE {TIERS[-1][1]} END AS fee, CASE {slip_case} ELSE {TIERS[-1][2]} END AS slip FROM pcts),
cost AS (
  SELECT m.idx, m.ts, sum(up*coalesce(r,0)) AS pr, -sum(up*coalesce(funding_rate,0)) AS fr, sum(abs(un-up)) AS turnover,
    sum(abs(un-up)*coalesce(t.fee, 0.0004)) AS fee_r, sum(abs(un-up)*coalesce({slip}, 0.0005)) AS slip_r
  FROM mvp m LEFT JOIN tiers t ON t.idx=m.idx AND t.asset=m.asset {join} GROUP BY 1,2),
grow AS (SELECT *, pr+fr-fee_r-slip_r AS ret, product(1+pr+fr-fee_r-slip_r) OVER (ORDER BY idx) AS g FROM cost),
eq AS (SELECT *, 100000.0*g AS equity, 100000.0*coalesce(lag(g) OVER (ORDER BY idx),1) AS equity_before FROM grow),
curve AS (SELECT *, equity/greatest(100000.0, max(equity) OVER (ORDER BY idx)) - 1 AS drawdown FROM eq)"""


def tiered_series(spark, folder, spreads=None):
    rows = liquidity_percentile(ranked(spark, folder, panel=stored_market(spark, folder)), "quote_volume", keys=KEYS)
    return B.prepare_series(tier_rates(rows, TIERS, spreads), KEYS, liquidity="quote_volume")


_COSTS = f"SELECT {q_day('ts')} AS bar, {q_round('fee_r*equity_before', 2)} AS fee_cost, {q_round('slip_r*equity_before', 2)} AS slippage_cost, {q_round('equity', 2)} AS equity FROM eq"


@register("tiered_cost", with_(MARKET, FACTORS, exec_sql(), book_sql(N, EVERY), tier_sql()) + _COSTS)
def tiered_cost(spark, folder):
    returns = single_run(tiered_series(spark, folder), tiered=True).returns
    return returns.select(day(), rounded("fee_cost", 2), rounded("slippage_cost", 2), rounded("equity", 2))


_SPREADS = """spreads AS (SELECT asset, round((max(price)-min(price))/avg(price)/20, 6) AS spread FROM panel WHERE asset <> 'BTCUSDT' GROUP BY asset)"""


def market_spreads(spark, folder):
    """A measured spread per asset, missing for one of them."""
    return market_panel(spark, folder).where("asset <> 'BTCUSDT'").groupBy("asset").agg(
        F.round((F.max("price") - F.min("price")) / F.avg("price") / 20, 6).alias("spread"))


@register("spread_cost", with_(MARKET, FACTORS, exec_sql(), book_sql(N, EVERY), _SPREADS, tier_sql(spread=True)) + _COSTS)
def spread_cost(spark, folder):
    returns = single_run(tiered_series(spark, folder, market_spreads(spark, folder)), tiered=True).returns
    return returns.select(day(), rounded("fee_cost", 2), rounded("slippage_cost", 2), rounded("equity", 2))


@register("equity_curve", _BOOK + f"SELECT {q_day('ts')} AS bar, {q_round('ret', 8)} AS ret, {q_round('equity', 2)} AS equity FROM eq")
def equity_curve(spark, folder):
    return momentum_book(spark, folder).returns.select(day(), rounded("ret", 8), rounded("equity", 2))


@register("drawdown", _BOOK + f"SELECT {q_day('ts')} AS bar, {q_round('drawdown')} AS drawdown FROM curve")
def drawdown(spark, folder):
    return momentum_book(spark, folder).returns.select(day(), rounded("drawdown"))
