"""Queries over walk-forward search, capacity and the factor grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AUM_LEVELS
from ..operators import capacity as K
from ..operators import walkforward as W
from ..operators.factors import asset_return, price_factors
from .panels import market_panel, stored_market, table
from .portfolio_queries import EVERY, KEYS, _BOOK, single_run
from .factor_queries import ranked
from ..operators import portfolio as B
from .registry import (FACTORS, MARKET, PPY, count, day, q_day, q_round, register, rounded, sliced_sql, with_)

# A search small enough to write out in SQL: three price factors, two sizes.
CANDIDATES, SIZES, TRAIN_DAYS, TEST_DAYS = ("reversal_1", "momentum_7", "low_vol_14"), (2, 3), 730, 360


def small_search(spark, folder, **settings):
    frame = price_factors(asset_return(stored_market(spark, folder)))
    options = {"candidates": CANDIDATES, "n_sides": SIZES, "min_train_days": TRAIN_DAYS, "test_days": TEST_DAYS,
               "delist_mode": "forced_exit", "rebalance_every": EVERY, **settings}
    return W.WalkForward(frame, **options)


_TRAIN = f"greatest(1, round_even({TRAIN_DAYS}*{PPY}/365.0, 0))::INT"
_TEST = f"greatest(1, round_even({TEST_DAYS}*{PPY}/365.0, 0))::INT"
_FOLDS = f"""ab AS (SELECT ts, row_number() OVER (ORDER BY ts)-1 AS i, count(*) OVER () AS nb FROM (SELECT DISTINCT ts FROM panel)),
fold AS (SELECT row_number() OVER (ORDER BY c)-1 AS fold, c, (SELECT ts FROM ab WHERE i=c-1) AS train_end, (SELECT ts FROM ab WHERE i=c) AS test_start,
  (SELECT ts FROM ab WHERE i=c+{_TEST}-1) AS test_end FROM (SELECT unnest(generate_series({_TRAIN}, (SELECT max(nb) FROM ab) - {_TEST}, {_TEST})) AS c))"""
_UNPIVOT = "up AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS signal, {i} AS pref, ts, asset, price, funding_rate, quote_volume, {c} AS s FROM fac WHERE {c} IS NOT NULL" for i, c in enumerate(CANDIDATES)) + ")"
_SEARCH = f"""trsrc AS (SELECT signal||'|'||n AS k, n, ts, asset, price, funding_rate, quote_volume, s FROM up, (VALUES (2),(3)) z(n)),
{sliced_sql("w", "trsrc", EVERY)},
fails AS (SELECT k, min(ts) AS bad FROM w_thin GROUP BY 1),
scored AS (SELECT f.fold, c.k, count(*) AS nr, avg(ret)/stddev_samp(ret) AS sh, product(1+ret)-1 AS tr
  FROM w_curve c JOIN fold f ON c.ts <= f.train_end WHERE idx > 0 GROUP BY 1,2),
trial AS (SELECT s.fold, s.k, split_part(s.k,'|',1) AS signal, split_part(s.k,'|',2)::INT AS n, nr, sh, tr,
   CASE WHEN fl.bad <= f.train_end THEN 'data_error' WHEN nr < 60 THEN 'insufficient_sample' END AS why
  FROM scored s JOIN fold f USING (fold) LEFT JOIN fails fl ON fl.k = s.k),
ok AS (SELECT t.*, p.pref FROM trial t JOIN (SELECT DISTINCT signal, pref FROM up) p USING (signal) WHERE why IS NULL),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sh DESC, pref, n) = 1)"""
_WF = with_(MARKET, FACTORS, _FOLDS, _UNPIVOT, _SEARCH)
_TESTS = f"""tesrc AS (SELECT b.fold AS k, b.n, u.ts, asset, price, funding_rate, quote_volume, s FROM up u JOIN best b USING (signal) JOIN fold f ON f.fold=b.fold
  WHERE u.ts BETWEEN f.test_start AND f.test_end),
{sliced_sql("b", "tesrc", EVERY)}, {sliced_sql("c", "tesrc", EVERY, "0.0008", "0.001")}, {sliced_sql("d", "tesrc", EVERY, "0.0015", "0.002")},
oos AS (SELECT 'base' AS variant, * FROM b_curve WHERE idx > 0 UNION ALL SELECT 'fee_0.0008_slippage_0.001', * FROM c_curve WHERE idx > 0
  UNION ALL SELECT 'fee_0.0015_slippage_0.002', * FROM d_curve WHERE idx > 0),
grown AS (SELECT *, product(1+ret) OVER (PARTITION BY variant ORDER BY k, idx) AS gg FROM oos),
wsum AS (SELECT variant, product(1+ret)-1 AS total_return, count(*) AS periods, avg(ret)/stddev_samp(ret)*sqrt({PPY}) AS sharpe, min(dd) AS max_drawdown
  FROM (SELECT *, gg/max(gg) OVER (PARTITION BY variant ORDER BY k, idx)-1 AS dd FROM grown) GROUP BY 1)"""


@register("wf_folds", with_(MARKET, _FOLDS) + f"""SELECT fold::BIGINT AS fold, c::BIGINT AS train_bars, {q_day('train_end')} AS train_end, {q_day('test_start')} AS test_start, {q_day('test_end')} AS test_end FROM fold""")
def wf_folds(spark, folder):
    folds = W.wf_folds(market_panel(spark, folder), TRAIN_DAYS, TEST_DAYS)
    return folds.select(count("fold"), count("train_bars"), *[day(c, c) for c in ("train_end", "test_start", "test_end")])


@register("wf_trials", _WF + f"""SELECT fold::BIGINT AS fold, signal, n::BIGINT AS n, nr::BIGINT AS n_returns, {q_round('CASE WHEN why IS NULL THEN sh END')} AS sharpe,
  {q_round('CASE WHEN why IS NULL THEN tr END')} AS train_return, why AS exclusion_reason FROM trial""")
def wf_trials(spark, folder):
    t = small_search(spark, folder).trials
    return t.select(count("fold"), "signal", count("n_long", "n"), "n_returns", rounded("sharpe"), rounded("train_return"), "exclusion_reason")


@register("best_trial", _WF + f"SELECT fold::BIGINT AS fold, signal, n::BIGINT AS n, {q_round('sh')} AS sharpe FROM best")
def best_trial(spark, folder):
    return small_search(spark, folder).choices.select(count("fold"), "signal", count("n_long", "n"), rounded("sharpe"))


@register("topk_signals", _WF + f""", lead AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY fold, signal ORDER BY sh DESC, pref, n) = 1)
SELECT fold::BIGINT AS fold, signal, n::BIGINT AS n, {q_round('sh')} AS sharpe, row_number() OVER (PARTITION BY fold ORDER BY sh DESC, pref, n)::BIGINT AS place
FROM lead QUALIFY place <= 2""")
def topk_signals(spark, folder):
    top = W.top_signals(small_search(spark, folder).trials, 2)
    return top.select(count("fold"), "signal", count("n_long", "n"), rounded("sharpe"), count("place"))


@register("mode_choice", _WF + """, c AS (SELECT signal, count(*) AS k FROM best GROUP BY 1), d AS (SELECT n, count(*) AS k FROM best GROUP BY 1)
SELECT (SELECT min(signal) FROM c WHERE k = (SELECT max(k) FROM c)) AS signal, (SELECT min(n) FROM d WHERE k = (SELECT max(k) FROM d))::BIGINT AS n_sides""")
def mode_choice(spark, folder):
    return W.mode_choice(small_search(spark, folder).choices).select("signal", count("n_sides"))


@register("walk_forward", _WF + ", " + _TESTS + f"""SELECT b.fold::BIGINT AS fold, b.signal, b.n::BIGINT AS n, {q_round('b.sh')} AS train_sharpe, {q_round('b.tr')} AS train_return,
  {q_round("CASE WHEN t.k IS NULL THEN (SELECT product(1+ret)-1 FROM oos WHERE variant = 'base' AND k = b.fold) END")} AS test_return,
  CASE WHEN t.k IS NOT NULL THEN 'data_error' END AS exclusion_reason FROM best b LEFT JOIN (SELECT DISTINCT k FROM b_thin) t ON t.k = b.fold""")
def walk_forward(spark, folder):
    r = small_search(spark, folder).fold_results
    return r.select(count("fold"), "signal", count("n_long", "n"), rounded("sharpe", name="train_sharpe"), rounded("train_return"), rounded("test_return"), "exclusion_reason")


@register("wf_summary", _WF + ", " + _TESTS + f"""SELECT variant, {q_round('total_return')} AS total_return, periods::BIGINT AS periods, {q_round('sharpe')} AS sharpe, {q_round('max_drawdown')} AS max_drawdown FROM wsum""")
def wf_summary(spark, folder):
    return small_search(spark, folder).summary.select("variant", rounded("total_return"), "periods", rounded("sharpe"), rounded("max_drawdown"))


@register("data_mining")
def data_mining(spark, folder):
    m = small_search(spark, folder, vol_targets=(0.0, 0.02)).data_mining
    return m.select("raw_n_trials", "valid_n_trials", "effective_n_trials", "n_obs", "observed_sr", "skewness", "kurtosis", "expected_sharpe_null", "dsr", "note")


# --- capacity --------------------------------------------------------------------------------

_ADV = """hist AS (SELECT p.ts, p.asset, h.quote_volume AS v, row_number() OVER (PARTITION BY p.asset, p.ts ORDER BY h.ts DESC) AS back
  FROM panel p JOIN panel h ON h.asset = p.asset AND h.ts <= p.ts QUALIFY back <= 90),
ms AS (SELECT ts, asset, avg(v) AS m, stddev_samp(v) AS sd, count(v) AS n FROM hist WHERE v > 0 GROUP BY 1,2),
advs AS (SELECT h.ts, h.asset, avg(v) AS adv FROM hist h JOIN ms USING (ts, asset) WHERE v > 0 AND (n < 3 OR coalesce(sd,0) = 0 OR v <= m + 3*sd) GROUP BY 1,2)"""


@register("adv", with_(MARKET, _ADV) + f"SELECT {q_day('ts')} AS bar, asset, {q_round('ln(adv)', 8)} AS log_adv FROM advs")
def adv(spark, folder):
    return K.average_volume(market_panel(spark, folder)).select(day(), "asset", rounded(F.ln("adv"), 8, "log_adv"))


@register("impact_bps", f"""SELECT l_suppkey::BIGINT AS supplier, {q_round('avg(CASE WHEN l_quantity > 0 AND l_extendedprice > 0 THEN 1.0*l_discount*sqrt(l_quantity/l_extendedprice)*10000 ELSE 0 END)', 4)} AS sqrt_bps,
  {q_round('avg(l_discount*(l_quantity/l_extendedprice)*10000)', 4)} AS linear_bps FROM lineitem GROUP BY 1""")
def impact_bps(spark, folder):
    lines = table(spark, folder, "lineitem").withColumns({
        "sqrt_bps": K.impact_bps("l_quantity", "l_extendedprice", "l_discount"),
        "linear_bps": K.impact_bps("l_quantity", "l_extendedprice", "l_discount", model="linear")})
    return lines.groupBy(F.col("l_suppkey").alias("supplier")).agg(rounded(F.avg("sqrt_bps"), 4, "sqrt_bps"), rounded(F.avg("linear_bps"), 4, "linear_bps"))


_OVERLAY = f"""{_ADV},
mvr AS (SELECT ts, asset, price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS mr FROM panel),
vol AS (SELECT ts, asset, coalesce(stddev_samp(mr) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),0) AS sd FROM mvr),
st AS (SELECT v.ts, v.asset, a.adv, v.sd FROM vol v JOIN advs a USING (ts, asset)),
tr AS (SELECT idx, ts, asset, abs(un-up)*equity_before AS notional, quote_volume FROM mvp JOIN eq USING (idx, ts) WHERE abs(un-up) > 1e-12),
ov AS (SELECT t.*, s.adv, s.sd, t.notional/s.adv AS part, s.sd*sqrt(t.notional/s.adv)*10000 AS bps FROM tr t
  JOIN st s ON s.asset=t.asset AND s.ts = (SELECT max(z.ts) FROM st z WHERE z.asset=t.asset AND z.ts <= t.ts))"""


@register("impact_overlay", _BOOK + ", " + _OVERLAY + f"""SELECT {q_day('ts')} AS bar, asset, {q_round('notional', 2)} AS notional, {q_round('adv', 2)} AS adv,
  {q_round('part', 6)} AS participation, {q_round('bps', 4)} AS impact_bps, {q_round('1.5/part', 4)} AS headroom FROM ov""")
def impact_overlay(spark, folder):
    panel = stored_market(spark, folder)
    book = single_run(B.prepare_series(ranked(spark, folder, panel=panel), KEYS))
    o = K.impact_overlay(book.trades.select("timestamp", "asset", "notional"), panel)
    return o.select(day(), "asset", rounded("notional", 2), rounded("adv", 2), rounded("participation"), rounded("impact_bps", 4), rounded("headroom", 4))


_LEVELS = ", ".join(f"({a}::DOUBLE)" for a in AUM_LEVELS)


@register("capacity_curve", _BOOK + ", " + _OVERLAY + f""", lv(aum) AS (VALUES {_LEVELS}),
sc AS (SELECT aum, notional*aum/100000 AS notional, CASE WHEN quote_volume > 0 THEN notional*aum/100000/quote_volume END AS share FROM tr, lv),
a AS (SELECT aum, count(*) FILTER (share > 0.05) AS bt, coalesce(sum(notional) FILTER (share > 0.05),0) AS bn, coalesce(max(share),0) AS mx FROM sc GROUP BY 1),
o AS (SELECT aum, max(sd*sqrt(notional*aum/100000/adv)*10000) AS bps, min(1.5/(part*aum/100000)) AS hd FROM ov, lv GROUP BY 1)
SELECT a.aum, bt::BIGINT AS breach_trades, {q_round('bn', 2)} AS breached_notional, {q_round('mx')} AS max_participation_ratio, {q_round('0.05/mx', 4)} AS headroom_multiple,
  bt = 0 AS sensible, {q_round('bps', 4)} AS max_impact_bps, CASE WHEN hd >= 1.5 THEN 'SAFE' WHEN hd >= 1 THEN 'MARGINAL' ELSE 'BREACH' END AS impact_status,
  {q_round('(SELECT arg_max(equity, idx)/100000-1 FROM curve)')} AS total_return FROM a JOIN o USING (aum)""")
def capacity_curve(spark, folder):
    panel = stored_market(spark, folder)
    book = single_run(B.prepare_series(ranked(spark, folder, panel=panel), KEYS))
    trades = K.at_capital(book.trades.select("timestamp", "asset", "notional", "quote_volume"))
    c = K.capacity_curve(trades, book.summary, K.impact_overlay(trades, panel))
    return c.select("aum", "breach_trades", rounded("breached_notional", 2), rounded("max_participation_ratio"), rounded("headroom_multiple", 4), "sensible",
                    rounded("max_impact_bps", 4), "impact_status", rounded("total_return"))
