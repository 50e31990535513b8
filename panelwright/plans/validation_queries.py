"""Queries over splits, regimes, cost stress, benchmarks and cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COST_STRESS_TIERS
from ..operators import cpcv as C
from ..operators import portfolio as B
from ..operators import validate as V
from ..operators.factors import asset_return, price_factors
from ..session import materialise
from .check import cost_runs, side_slices, signal_book
from .factor_queries import ranked
from .panels import market_panel, stored_market
from .portfolio_queries import EVERY, KEYS, N, _BOOK, momentum_book, single_run
from .registry import (FACTORS, MARKET, PPY, book_sql, count, day, equity_sql, exec_sql, q_day, q_round, register, rounded,
                       sliced_sql, summary_sql, with_)

SUMMARY = ("final_equity", "total_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "average_turnover")


def summary_columns(k="run_id", name="run"):
    return [F.col(k).alias(name), *[rounded(c, 2 if c == "final_equity" else 6) for c in SUMMARY], count("periods"), count("winning_periods"), count("losing_periods")]


def summary_select(name="run"):
    return f"k AS {name}, " + ", ".join(f"{q_round(c, 2 if c == 'final_equity' else 6)} AS {c}" for c in SUMMARY) + \
        ", periods::BIGINT AS periods, winning_periods::BIGINT AS winning_periods, losing_periods::BIGINT AS losing_periods"


@register("run_summary", _BOOK + ", s AS (" + summary_sql("(SELECT 'momentum_7' AS k, * FROM curve)") + f"""), m AS (
  SELECT sum(fee_r*equity_before) AS f, sum(slip_r*equity_before) AS p FROM curve)
SELECT {summary_select()}, {q_round('f', 2)} AS total_fees, {q_round('p', 2)} AS total_slippage FROM s, m""")
def run_summary(spark, folder):
    return momentum_book(spark, folder).summary.select(*summary_columns(), rounded("total_fees", 2), rounded("total_slippage", 2))


@register("periods_per_year", with_(MARKET) + f"""SELECT {q_round('365.25*86400/median(step)')} AS ppy FROM (
  SELECT epoch(lead(ts) OVER (ORDER BY ts)) - epoch(ts) AS step FROM (SELECT DISTINCT ts FROM panel))""")
def ppy(spark, folder):
    bars = B.series_bars(market_panel(spark, folder).withColumn("series", F.lit("market")), ["series"])
    return bars.where("idx = 0").select(rounded("ppy"))


@register("forced_exits", _BOOK + f"""SELECT {q_day('b.ts')} AS bar, p.asset, {q_round('x.price')} AS last_price
FROM pos p JOIN bars b ON b.idx = p.idx + 1 JOIN xs x ON x.idx = p.idx AND x.asset = p.asset
WHERE NOT EXISTS (SELECT 1 FROM xs y WHERE y.idx = b.idx AND y.asset = p.asset)""")
def forced_exits(spark, folder):
    return momentum_book(spark, folder).exits.select(day(), "asset", rounded("last_price"))


# Limits tight enough to fire on the bounded prices of the panel.
LOSS, DRAWDOWN, SHARE = 0.01, 0.05, 0.05
_DIRTY_VOLUME = "volume % 17 = 3"
_VIOL = with_(
    MARKET.replace("panel AS", "panel0 AS"),
    f"panel AS (SELECT * REPLACE (CASE WHEN {_DIRTY_VOLUME} THEN 0.0 ELSE quote_volume END AS quote_volume) FROM panel0)",
    FACTORS, exec_sql().replace("xs AS (SELECT x0.*, bars.idx FROM x0 JOIN bars USING (ts))", "xs AS (SELECT x0.*, bars.idx FROM x0 JOIN bars USING (ts) WHERE quote_volume > 0)"),
    book_sql(N, EVERY), equity_sql(),
    f"""viol AS (
  SELECT ts, 'daily_loss_limit' AS type, NULL AS asset, ret AS value, -{LOSS} AS lim FROM curve WHERE ret < -{LOSS}
  UNION ALL SELECT ts, 'max_drawdown_limit', NULL, drawdown, -{DRAWDOWN} FROM curve WHERE drawdown < -{DRAWDOWN}
  UNION ALL SELECT b.ts, 'forced_exit', p.asset, 0, 0 FROM pos p JOIN bars b ON b.idx = p.idx + 1
    WHERE NOT EXISTS (SELECT 1 FROM xs y WHERE y.idx = b.idx AND y.asset = p.asset)
  UNION ALL SELECT ts, 'capacity_limit', asset, abs(un-up)*equity_before, quote_volume*{SHARE} FROM mvp JOIN eq USING (idx, ts)
    WHERE abs(un-up)*equity_before > quote_volume*{SHARE}
  UNION ALL SELECT ts, 'invalid_liquidity', asset, 0, 0 FROM x0 WHERE quote_volume IS NULL OR quote_volume <= 0)""")


def violation_book(spark, folder):
    volume = F.when(F.col("volume") % 17 == 3, F.lit(0.0)).otherwise(F.col("quote_volume"))
    rows = materialise(ranked(spark, folder, panel=stored_market(spark, folder).withColumn("quote_volume", volume)))
    book = single_run(B.prepare_series(rows, KEYS, liquidity="quote_volume"), daily_loss=LOSS, max_drawdown=DRAWDOWN, max_participation=SHARE)
    invalid = rows.where("quote_volume is null or quote_volume <= 0").withColumn("run_id", F.col("signal"))
    return B.violations(book.returns, book.trades, book.exits, book.runs, invalid, "quote_volume")


@register("violations", _VIOL + f"SELECT {q_day('ts')} AS bar, type, asset, {q_round('value', 4)} AS value, {q_round('lim', 4)} AS \"limit\" FROM viol")
def violations(spark, folder):
    return violation_book(spark, folder).select(day(), "type", "asset", rounded("value", 4), rounded("limit", 4))


@register("first_breach", _VIOL + f"SELECT {q_day('min(ts)')} AS halted_at FROM viol")
def first_breach(spark, folder):
    return B.first_breach(violation_book(spark, folder)).select(day("halted_at", "halted_at"))



GROSS = (2.0, 1.5, 1.0, 0.7)


def _sweep_sql() -> str:
    """The return chain of every exposure level, over one book."""
    levels = ", ".join(f"({g}::DOUBLE)" for g in GROSS)
    return f"""lv(gross) AS (VALUES {levels}),
unit AS (SELECT gross, idx, gross/2*sum(up*coalesce(r,0)) AS pr, -gross/2*sum(up*coalesce(funding_rate,0)) AS fr, gross/2*sum(abs(un-up)) AS turnover
  FROM mvp, lv GROUP BY 1,2),
g AS (SELECT *, product(1+pr+fr-turnover*0.0009) OVER (PARTITION BY gross ORDER BY idx) AS g FROM unit),
c AS (SELECT *, 100000*g AS equity, 100000*coalesce(lag(g) OVER (PARTITION BY gross ORDER BY idx),1) AS before,
  g/greatest(1, max(g) OVER (PARTITION BY gross ORDER BY idx)) - 1 AS drawdown FROM g)"""


@register("exposure_sweep", with_(MARKET, FACTORS, exec_sql(), book_sql(N, EVERY), _sweep_sql()) + f"""
SELECT gross, {q_round('arg_max(equity, idx)/100000-1')} AS total_return, {q_round('min(drawdown)')} AS max_drawdown,
  {q_round('sum(pr*before)', 2)} AS price_pnl, {q_round('sum(fr*before)', 2)} AS funding_pnl,
  {q_round('sum(turnover*0.0004*before)', 2)} AS fee, {q_round('sum(turnover*0.0005*before)', 2)} AS slippage FROM c GROUP BY gross""")
def exposure_sweep(spark, folder):
    book = momentum_book(spark, folder)
    levels = F.explode(F.array(*[F.lit(g) for g in GROSS]))
    runs = book.runs.withColumn("gross", levels).withColumn("run_id", F.concat_ws("|", "run_id", "gross"))
    sums = B.run_summary(B.run_returns(book.terms, runs)).join(runs.select("run_id", "gross"), "run_id")
    return sums.select("gross", rounded("total_return"), rounded("max_drawdown"), rounded("price_pnl", 2), rounded("funding_pnl", 2),
                       rounded("total_fees", 2, "fee"), rounded("total_slippage", 2, "slippage"))


LOOKBACK, TARGET = 20, 0.02
_WALK = f"""parts AS (SELECT idx, sum(CASE WHEN sign(un)=sign(up) THEN 0 ELSE abs(un) END) AS enter, sum(CASE WHEN sign(un)=sign(up) THEN 0 ELSE abs(up) END) AS leave,
  sum(CASE WHEN sign(un)=sign(up) THEN abs(un) ELSE 0 END) AS stay FROM mvp GROUP BY 1),
steps AS MATERIALIZED (SELECT b.idx, b.ts, (b.pr+b.fr)::DOUBLE AS earn, enter::DOUBLE AS enter, leave::DOUBLE AS leave, stay::DOUBLE AS stay, b.idx % {EVERY} = 0 AS reb FROM bar b JOIN parts USING (idx)),
walk(idx, ts, scale, rets) AS (
  SELECT idx, ts, 0.5::DOUBLE, [-(enter*0.5*0.0009)] FROM steps WHERE idx = 0
  UNION ALL SELECT idx, ts, now, list_append(rets, scale*earn - 0.0009*(enter*now + leave*scale + stay*abs(now-scale))) FROM (
    SELECT n.*, w.scale, w.rets, CASE WHEN NOT reb THEN w.scale WHEN n.idx < {LOOKBACK} THEN 0.5
      ELSE least(1.0, {TARGET}/sqrt({PPY})/list_aggregate(w.rets[-{LOOKBACK}:], 'stddev_samp')) END AS now
    FROM walk w JOIN steps n ON n.idx = w.idx + 1)),
vt AS (SELECT idx, ts, scale, rets[-1] AS ret FROM walk)"""


@register("vol_target_run", _BOOK.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _WALK + f"""SELECT {q_day('ts')} AS bar, {q_round('scale')} AS scale, {q_round('ret')} AS ret,
  {q_round('100000*product(1+ret) OVER (ORDER BY idx)', 2)} AS equity FROM vt""")
def vol_target_run(spark, folder):
    returns = momentum_book(spark, folder, vol_target=TARGET, vol_lookback=LOOKBACK).returns
    return returns.select(day(), rounded("scale"), rounded("ret"), rounded("equity", 2))


# --- splits ----------------------------------------------------------------------------------

_SPLIT = """db AS (SELECT ts, row_number() OVER (ORDER BY ts)-1 AS i, count(*) OVER () AS nb FROM (SELECT DISTINCT ts FROM panel)),
seg AS (SELECT ts, i, CASE WHEN i < floor(nb*0.6) THEN 'train' WHEN i < floor(nb*0.8) THEN 'validation' ELSE 'out_of_sample' END AS segment FROM db)"""


@register("date_split", with_(MARKET, _SPLIT) + f"SELECT {q_day('ts')} AS bar, i::BIGINT AS position, segment FROM seg")
def date_split(spark, folder):
    return V.date_split(market_panel(spark, folder)).select(day(), count("position"), "segment")


@register("segment_metrics", _BOOK + ", " + _SPLIT + f""", sg AS (SELECT c.*, s.segment FROM curve c JOIN seg s USING (ts)),
sb AS (SELECT *, first_value(equity_before) OVER w AS base, max(equity) OVER w AS top FROM sg WINDOW w AS (PARTITION BY segment ORDER BY idx))
SELECT segment, {q_round('any_value(base)', 2)} AS initial_equity, {q_round('arg_max(equity, idx)', 2)} AS final_equity,
  {q_round('arg_max(equity, idx)/any_value(base)-1')} AS total_return, count(*)::BIGINT AS periods,
  {q_round(f'avg(ret)/stddev_samp(ret)*sqrt({PPY})')} AS sharpe, {q_round('min(equity/greatest(base, top)-1)')} AS max_drawdown,
  {q_round('avg(turnover)')} AS average_turnover, CASE WHEN avg(turnover) > 0.15 THEN 'OVER' ELSE 'OK' END AS turnover_flag,
  (SELECT count(*) FROM pos p JOIN bars b ON b.idx = p.idx+1 JOIN seg z ON z.ts = b.ts WHERE z.segment = sb.segment
    AND NOT EXISTS (SELECT 1 FROM xs y WHERE y.idx = b.idx AND y.asset = p.asset))::BIGINT AS forced_exits
FROM sb GROUP BY segment""")
def segment_metrics(spark, folder):
    panel = stored_market(spark, folder)
    book = single_run(B.prepare_series(ranked(spark, folder, panel=panel), KEYS))
    breaches = B.violations(book.returns, book.trades, book.exits, book.runs)
    m = V.segment_metrics(book.returns, V.date_split(panel), breaches)
    return m.select("segment", rounded("initial_equity", 2), rounded("final_equity", 2), rounded("total_return"), "periods", rounded("sharpe"),
                    rounded("max_drawdown"), rounded("average_turnover"), "turnover_flag", "forced_exits")


_OOS = """src AS (SELECT 'oos' AS k, 3 AS n, f.ts, f.asset, f.price, f.funding_rate, f.quote_volume, f.momentum_7 AS s
  FROM fac f JOIN seg USING (ts) WHERE segment = 'out_of_sample' AND momentum_7 IS NOT NULL)"""


@register("cost_stress", with_(MARKET, FACTORS, _SPLIT, _OOS, *[sliced_sql(f"t{i}", "src", EVERY, str(f), str(s)) for i, (f, s) in enumerate(COST_STRESS_TIERS)]) +
          " UNION ALL ".join(f"""SELECT {i}::BIGINT AS tier, {f}::DOUBLE AS fee_rate, {s}::DOUBLE AS slip_rate, {q_round('arg_max(equity, idx)/100000.0-1')} AS total_return,
  {q_round('min(drawdown)')} AS max_drawdown FROM t{i}_curve""" for i, (f, s) in enumerate(COST_STRESS_TIERS)))
def cost_stress(spark, folder):
    panel = stored_market(spark, folder)
    last = V.date_split(panel).where("segment = 'out_of_sample'")
    book = signal_book(price_factors(asset_return(panel)), "momentum_7", N, bars=last, rebalance_every=EVERY)
    runs = cost_runs(book)
    sums = B.run_summary(B.run_returns(book.terms, runs)).join(runs.select("run_id", "fee_rate", "slip_rate"), "run_id")
    return sums.select(F.col("run_id").cast("bigint").alias("tier"), "fee_rate", "slip_rate", rounded("total_return"), rounded("max_drawdown"))


@register("benchmarks", with_(MARKET, """ret AS (SELECT *, price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM panel QUALIFY r IS NOT NULL),
ew AS (SELECT ts, avg(r) AS r FROM ret GROUP BY 1)""") + f"""SELECT 'equal_weight' AS benchmark, {q_round('product(1+r)-1')} AS total_return, count(*)::BIGINT AS periods FROM ew
UNION ALL SELECT lower(asset), {q_round('product(1+r)-1')}, count(*)::BIGINT FROM ret WHERE asset IN ('BTCUSDT','ETHUSDT') GROUP BY asset
UNION ALL SELECT 'market_neutral_reference', 0.0, count(*)::BIGINT FROM ew""")
def benchmarks(spark, folder):
    return V.benchmarks(market_panel(spark, folder)).select("benchmark", rounded("total_return"), "periods")


TREND = 0.01
_REGIME = f"""bm0 AS (SELECT ts, asset, price/lag(price) OVER (ORDER BY ts) - 1 AS r FROM panel WHERE asset = 'BTCUSDT'),
bm AS (SELECT ts, CASE WHEN count(r) OVER w = 30 THEN round(sum(r) OVER w,12) END AS trend, CASE WHEN count(r) OVER w = 30 THEN round(stddev_samp(r) OVER w,12) END AS vol
  FROM bm0 WINDOW w AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
reg AS (SELECT ts, CASE WHEN trend > {TREND} THEN 'bull' WHEN trend < -{TREND} THEN 'bear' ELSE 'sideways' END || '_' ||
  CASE WHEN vol > round((SELECT quantile_cont(b.vol, 0.66::DOUBLE) FROM bm b WHERE b.ts <= bm.ts),12) THEN 'hi_vol' ELSE 'lo_vol' END AS regime FROM bm)"""


@register("regime_labels", with_(MARKET, _REGIME) + f"SELECT {q_day('ts')} AS bar, regime FROM reg")
def regime_labels(spark, folder):
    return V.regime_labels(market_panel(spark, folder), trend_limit=TREND).select(day(), "regime")


@register("regime_perf", _BOOK + ", " + _REGIME + f"""SELECT regime, count(*)::BIGINT AS days, {q_round('avg(ret)', 8)} AS mean_daily_return,
  count(*) FILTER (ret > 0)::BIGINT AS positive_days, {q_round('product(1+ret)-1')} AS total_return FROM curve JOIN reg USING (ts) WHERE idx > 0 GROUP BY 1""")
def regime_perf(spark, folder):
    panel = stored_market(spark, folder)
    book = single_run(B.prepare_series(ranked(spark, folder, panel=panel), KEYS))
    perf = V.regime_performance(book.returns, V.regime_labels(panel, trend_limit=TREND))
    return perf.select("regime", "days", rounded("mean_daily_return", 8), "positive_days", rounded("total_return"))


# --- cross-validation ------------------------------------------------------------------------

GROUPS, TEST_GROUPS = 6, 2
_CV = f"""cb AS (SELECT ts, row_number() OVER (ORDER BY ts)-1 AS p, count(*) OVER () AS nb FROM (SELECT DISTINCT ts FROM panel)),
gp AS (SELECT *, ntile({GROUPS}) OVER (ORDER BY p) - 1 AS g FROM cb),
combo AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold_id, a, b FROM range({GROUPS}) x(a), range({GROUPS}) y(b) WHERE a < b),
roles AS (SELECT fold_id, ts, p, nb, g IN (a, b) AS test, a, b FROM gp, combo),
tp AS (SELECT fold_id, p FROM roles WHERE test),
cv AS (SELECT r.fold_id, r.ts, CASE WHEN r.test THEN 'test' ELSE 'train' END AS side FROM roles r WHERE r.test OR NOT EXISTS (
  SELECT 1 FROM tp WHERE tp.fold_id = r.fold_id AND (abs(tp.p - r.p) <= greatest(1, round_even(0.02*r.nb, 0)) OR (r.p > tp.p AND r.p <= tp.p + greatest(1, round_even(0.03*r.nb, 0))))))"""


def cv_splits(panel):
    return C.cpcv_splits(panel, GROUPS, TEST_GROUPS, embargo=0.03, purge=0.02)


@register("cpcv_splits", with_(MARKET, _CV) + f"SELECT fold_id::BIGINT AS fold_id, {q_day('ts')} AS bar, side FROM cv")
def cpcv_splits(spark, folder):
    return cv_splits(market_panel(spark, folder)).select(count("fold_id"), day(), "side")


_VREG = """rp AS (SELECT ts, arg_max(price, asset) AS price FROM panel GROUP BY 1),
rr AS (SELECT ts, price/lag(price) OVER (ORDER BY ts)-1 AS r FROM rp),
rv AS (SELECT ts, CASE WHEN count(r) OVER w = 30 THEN round(stddev_samp(r) OVER w,12) END AS vol FROM rr WINDOW w AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
rx AS (SELECT a.ts, a.vol, (count(*) FILTER (b.vol < a.vol) + (count(*) FILTER (b.vol = a.vol) + 1)/2.0)/count(b.vol) AS pct, count(b.vol) AS k
  FROM rv a JOIN rv b ON b.ts <= a.ts GROUP BY 1,2),
vreg AS (SELECT ts, CASE WHEN vol IS NULL OR k < 30 THEN 'mid_vol' WHEN pct >= 2.0/3 THEN 'high_vol' WHEN pct <= 1.0/3 THEN 'low_vol' ELSE 'mid_vol' END AS regime FROM rx)"""


@register("vol_regime", with_(MARKET, _VREG) + f"SELECT {q_day('ts')} AS bar, regime FROM vreg")
def vol_regime(spark, folder):
    return C.vol_regime(market_panel(spark, folder)).select(day(), "regime")


_CVSRC = """cvsrc AS (SELECT cv.fold_id||'|'||side AS k, 3 AS n, f.ts, asset, price, funding_rate, quote_volume, momentum_7 AS s
  FROM fac f JOIN cv USING (ts) WHERE momentum_7 IS NOT NULL)"""
_PATHS = f"""curves AS (SELECT split_part(k,'|',1)::INT AS fold_id, split_part(k,'|',2) AS side, *, equity/max(equity) OVER (PARTITION BY k ORDER BY idx) - 1 AS dd FROM v_curve),
modes AS (SELECT fold_id, regime FROM (SELECT fold_id, regime, count(*) AS c FROM cv JOIN vreg USING (ts) WHERE side = 'test' GROUP BY 1,2)
  QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY c DESC, regime) = 1),
paths AS (SELECT c.fold_id, avg(ret) FILTER (side='test' AND idx > 0)/stddev_samp(ret) FILTER (side='test' AND idx > 0)*sqrt({PPY}) AS sharpe_oos,
  arg_max(equity, idx) FILTER (side='test')/arg_min(equity, idx) FILTER (side='test') - 1 AS test_return,
  min(dd) FILTER (side='train') AS max_dd_train, min(dd) FILTER (side='test') AS max_dd_oos FROM curves c GROUP BY 1)"""
_CPCV = with_(MARKET, FACTORS, _CV, _CVSRC, _VREG, sliced_sql("v", "cvsrc", 1), _PATHS)


def cv_book(panel):
    """Both sides of every fold as slices of one grid: state restarts inside each slice."""
    splits = materialise(side_slices(cv_splits(panel)))
    frame = price_factors(asset_return(panel))
    return signal_book(frame, "momentum_7", N, slices=splits), splits


def cv_paths(spark, folder):
    panel = stored_market(spark, folder)
    book, splits = cv_book(panel)
    return C.cpcv_paths(book.returns, splits, C.vol_regime(panel), 365.25 * 86400 / 604800)


@register("cpcv_paths", _CPCV + f"""SELECT fold_id::BIGINT AS fold_id, {q_round('sharpe_oos')} AS sharpe_oos, {q_round('test_return')} AS test_return,
  {q_round('max_dd_train')} AS max_dd_train, {q_round('max_dd_oos')} AS max_dd_oos, regime FROM paths JOIN modes USING (fold_id)""")
def cpcv_paths(spark, folder):
    return cv_paths(spark, folder).select(count("fold_id"), *[rounded(c) for c in ("sharpe_oos", "test_return", "max_dd_train", "max_dd_oos")], "regime")


@register("cpcv_summary", _CPCV + f""", pr AS (SELECT regime, sum(greatest(test_return,0)) AS profit FROM paths JOIN modes USING (fold_id) GROUP BY 1)
SELECT count(*)::BIGINT AS n_folds, {q_round('avg((test_return > 0)::INT)')} AS pct_profitable_folds, {q_round('avg(sharpe_oos)')} AS sharpe_mean,
  {q_round('min(max_dd_train)')} AS max_dd_walk_forward, {q_round('min(max_dd_oos)')} AS max_dd_oos,
  coalesce((SELECT max(profit)/nullif(sum(profit),0) FROM pr) > 0.8, false) AS regime_concentration_flag, min(max_dd_train) < -1 OR min(max_dd_oos) < -1 AS ruin_flag FROM paths""")
def cpcv_summary(spark, folder):
    s = C.cpcv_summary(cv_paths(spark, folder))
    return s.select("n_folds", rounded("pct_profitable_folds"), rounded("sharpe_mean"), rounded("max_dd_walk_forward"), rounded("max_dd_oos"), "regime_concentration_flag", "ruin_flag")


@register("gap_jump_audit", _CPCV + f""", st AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY k ORDER BY idx)) AS step FROM v_curve),
jm AS (SELECT st.*, coalesce(step > m.md*1.5, false) AS jump FROM st JOIN (SELECT k, median(step) AS md FROM st GROUP BY 1) m USING (k)),
gw AS (SELECT *, product(CASE WHEN idx=0 THEN 1.0 ELSE 1+ret END) OVER (PARTITION BY k ORDER BY idx) AS raw,
  product(CASE WHEN idx=0 OR jump THEN 1.0 ELSE 1+ret END) OVER (PARTITION BY k ORDER BY idx) AS flat FROM jm),
dw AS (SELECT *, raw/max(raw) OVER (PARTITION BY k ORDER BY idx)-1 AS d1, flat/max(flat) OVER (PARTITION BY k ORDER BY idx)-1 AS d2 FROM gw)
SELECT k AS slice, {q_round('min(d1)')} AS dd_raw, {q_round('min(d2)')} AS dd_nogap, count(*) FILTER (jump)::BIGINT AS gap_bars FROM dw GROUP BY k""")
def gap_jump_audit(spark, folder):
    book, _ = cv_book(stored_market(spark, folder))
    return C.gap_jump_audit(book.returns).select(F.col("run_id").alias("slice"), rounded("dd_raw"), rounded("dd_nogap"), "gap_bars")
