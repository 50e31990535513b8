"""Queries over factor statistics, multiple testing and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SIGNAL_CANDIDATES
from ..operators import stats as S
from ..operators.factors import asset_return, build_signals
from .panels import market_panel, stored_market, supplier_panel, table
from .registry import (ALL_FACTORS, MARKET, RETURNS, SUPPLIER_WEEK, count, day, q_cdf, q_day, q_quantile, q_round, register, rounded, with_)

_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS signal, ts, asset, {c} AS sig, nr FROM nx WHERE {c} IS NOT NULL AND nr IS NOT NULL" for c in SIGNAL_CANDIDATES) + ")"
_NEXT = "nx AS (SELECT *, round(lead(r) OVER (PARTITION BY asset ORDER BY ts), 10) AS nr FROM allfac)"
_ICS = """rk AS (SELECT signal, ts, sig, nr,
   rank() OVER (PARTITION BY signal, ts ORDER BY sig) + (count(*) OVER (PARTITION BY signal, ts, sig) - 1)/2.0 AS ra,
   rank() OVER (PARTITION BY signal, ts ORDER BY nr) + (count(*) OVER (PARTITION BY signal, ts, nr) - 1)/2.0 AS rb FROM long),
ics AS (SELECT signal, ts, corr(ra, rb) AS ic FROM rk GROUP BY 1,2
  HAVING count(*) >= 3 AND min(sig) < max(sig) AND min(nr) < max(nr)),
ictab AS (SELECT signal, avg(ic) AS m, stddev_samp(ic) AS sd, count(*) AS n, avg(ic)/stddev_samp(ic)*sqrt(count(*)) AS t FROM ics GROUP BY 1)"""
_RESEARCH = with_(MARKET, ALL_FACTORS, _NEXT, _LONG, _ICS)


def long_rows(spark, folder):
    return S.signal_returns(build_signals(stored_market(spark, folder)), SIGNAL_CANDIDATES)


def ics(spark, folder):
    return S.bar_ic(long_rows(spark, folder))


@register("rank_ic", _RESEARCH + f"""SELECT signal, {q_round('m')} AS ic_mean, {q_round('sd')} AS ic_std, {q_round('t')} AS ic_tstat,
  {q_round('m/sd')} AS icir, n::BIGINT AS ic_days FROM ictab""")
def rank_ic(spark, folder):
    t = S.ic_table(ics(spark, folder))
    return t.select("signal", rounded("ic_mean"), rounded("ic_std"), rounded("ic_tstat"), rounded("icir"), "ic_days")


@register("ic_gate", _RESEARCH + "SELECT signal, abs(t) >= 1.0 AS passed FROM ictab")
def ic_gate(spark, folder):
    return S.ic_gate(S.ic_table(ics(spark, folder)), 1.0).select("signal", "passed")


@register("reality_check", _RESEARCH + f"""SELECT count(*)::BIGINT AS signals, {q_round('max(abs(t))')} AS best_ic_tstat, {q_round('0.05/count(*)', 8)} AS bonferroni_alpha,
  count(*) > 1 AS multiple_testing_warning, max(abs(t)) > 3.0 AS pass FROM ictab""")
def reality_check(spark, folder):
    r = S.reality_check(S.ic_table(ics(spark, folder)))
    return r.select("signals", rounded("best_ic_tstat"), rounded("bonferroni_alpha", 8), "multiple_testing_warning", "pass")


_EDGES = ", ".join(f"round(quantile_cont(sig, {i}/5.0),12)" for i in range(6))


@register("quantile_returns", with_(MARKET, ALL_FACTORS, _NEXT, _LONG) + f""", e AS (
  SELECT signal, ts, list_distinct([{_EDGES}]) AS edges FROM (SELECT signal, ts, sig::DOUBLE AS sig FROM long) GROUP BY 1,2),
b AS (SELECT l.signal, l.nr, CASE WHEN len(edges) > 1 THEN greatest(len(list_filter(edges, lambda q: q < l.sig)) - 1, 0) END AS bucket
  FROM long l JOIN e USING (signal, ts))
SELECT signal, bucket::BIGINT AS quantile, {q_round('avg(nr)', 8)} AS mean_next_return, count(*)::BIGINT AS days FROM b WHERE bucket IS NOT NULL GROUP BY 1,2""")
def quantile_returns(spark, folder):
    t = S.quantile_returns(long_rows(spark, folder))
    return t.select("signal", count("quantile"), rounded("mean_next_return", 8), "days")


@register("newey_west", _RESEARCH + f""", d AS (SELECT signal, row_number() OVER (PARTITION BY signal ORDER BY ts) AS i, count(*) OVER (PARTITION BY signal) AS n,
   ic - avg(ic) OVER (PARTITION BY signal) AS x, avg(ic) OVER (PARTITION BY signal) AS m FROM ics),
g AS (SELECT a.signal, a.n, a.m, b.i - a.i AS lag, avg(a.x*b.x) AS cov, least(greatest(1, floor(power(a.n, 0.25))), a.n-1) AS lags
  FROM d a JOIN d b ON a.signal=b.signal AND b.i - a.i BETWEEN 0 AND least(greatest(1, floor(power(a.n, 0.25))), a.n-1) GROUP BY 1,2,3,4)
SELECT signal, n::BIGINT AS bars, {q_round('m/sqrt(greatest(sum(CASE WHEN lag=0 THEN 1.0 ELSE 2*(1 - lag/(lags+1)) END * cov), 1e-18)/n)', 5)} AS nw_tstat FROM g GROUP BY signal, n, m""")
def newey_west(spark, folder):
    return S.newey_west(ics(spark, folder)).select("signal", "bars", rounded("nw_tstat", 5))


@register("bootstrap_ci")
def bootstrap_ci(spark, folder):
    return S.block_bootstrap(ics(spark, folder))


@register("bonferroni", _RESEARCH + f"""SELECT signal, {q_round('t')} AS ic_tstat, {q_round(f"least(1.0, {len(SIGNAL_CANDIDATES)}*2*(1-{q_cdf('abs(t)')}))", 5)} AS adjusted_pvalue FROM ictab""")
def bonferroni(spark, folder):
    t = S.bonferroni(S.ic_table(ics(spark, folder)), len(SIGNAL_CANDIDATES))
    return t.select("signal", rounded("ic_tstat"), rounded("adjusted_pvalue", 5))


def supplier_returns(spark, folder):
    return asset_return(supplier_panel(spark, folder)).where("asset_return is not null")


_SUPP = with_(SUPPLIER_WEEK, RETURNS)


@register("adj_moments", _SUPP + f"""SELECT asset, count(*)::BIGINT AS n, {q_round('skewness(r)')} AS skewness, {q_round('kurtosis(r) + 3')} AS kurtosis FROM ret WHERE r IS NOT NULL GROUP BY 1""")
def adj_moments(spark, folder):
    return S.adjusted_moments(supplier_returns(spark, folder), "asset", "asset_return").select("asset", "n", rounded("skewness"), rounded("kurtosis"))


def _scored_suppliers(spark, folder):
    """Each supplier's weekly returns as one tried strategy, selected out of all of them."""
    moments = S.adjusted_moments(supplier_returns(spark, folder), "asset", "asset_return").withColumn("observed_sr", F.col("mean") / F.col("std"))
    search = moments.agg(F.count(F.lit(1)).alias("n_trials"), F.var_samp("observed_sr").alias("trials_variance"))
    return moments.join(search, F.lit(True))


_DSR = with_(SUPPLIER_WEEK, RETURNS, """mo AS (SELECT asset, count(*) AS n, avg(r)/stddev_samp(r) AS sr, skewness(r) AS sk, kurtosis(r)+3 AS ku FROM ret WHERE r IS NOT NULL GROUP BY 1),
br AS (SELECT count(*) AS trials, var_samp(sr) AS v FROM mo)""", q_quantile("qa", "(SELECT 1 - 1.0/trials FROM br)"), q_quantile("qb", "(SELECT 1 - 1.0/(trials*exp(1.0)) FROM br)"), """
null_bar AS (SELECT trials, sqrt(v)*((1-0.5772156649015329)*qa.x + 0.5772156649015329*qb.x) AS e FROM br, qa, qb),
sc AS (SELECT mo.*, trials, e, 1 - sk*sr + (ku-1)/4*sr*sr AS den FROM mo, null_bar)""").replace("WITH ", "WITH RECURSIVE ", 1)
_SCORE = q_cdf("(sr-e)*sqrt(n-1)/sqrt(den)")
_DSR_COLUMNS = f"asset, {q_round('sr')} AS observed_sr, trials::BIGINT AS n_trials, {q_round('e')} AS expected_sharpe_null"


@register("dsr", _DSR + f"SELECT {_DSR_COLUMNS}, {q_round(f'CASE WHEN den > 0 THEN {_SCORE} ELSE 0 END')} AS dsr, den <= 0 AS degenerate FROM sc")
def dsr(spark, folder):
    rows = _scored_suppliers(spark, folder).withColumn("n_obs", F.col("n"))
    scored = S.deflated_sharpe(rows)
    return scored.select("asset", rounded("observed_sr"), "n_trials", rounded("expected_sharpe_null"), rounded("dsr"), F.col("note").isNotNull().alias("degenerate"))


@register("dsr_v2", _DSR + f"SELECT {_DSR_COLUMNS}, {q_round(f'CASE WHEN den > 0 THEN {_SCORE} END')} AS dsr, CASE WHEN den <= 0 THEN 'degenerate_denominator' END AS error FROM sc")
def dsr_v2(spark, folder):
    scored = S.deflated_sharpe_strict(_scored_suppliers(spark, folder))
    return scored.select("asset", rounded("observed_sr"), "n_trials", rounded("expected_sharpe_null"), rounded("dsr"), "error")


# Trials: every customer nation is a search, every order a logged attempt.
@register("trial_counts", """WITH t AS (SELECT o_orderpriority AS search, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS sharpe,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'data_error' ELSE 'insufficient_sample' END END AS why FROM orders)
SELECT search, count(*)::BIGINT AS raw_n_trials, count(sharpe)::BIGINT AS valid_n_trials, count(*) FILTER (why = 'data_error')::BIGINT AS data_errors,
  count(*) FILTER (why = 'insufficient_sample')::BIGINT AS insufficient_samples FROM t GROUP BY 1""")
def trial_counts(spark, folder):
    failed = F.col("o_orderstatus") == "F"
    trials = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("search"), F.when(~failed, F.col("o_totalprice")).alias("sharpe"),
        F.when(failed, F.when(F.col("o_custkey") % 2 == 0, "data_error").otherwise("insufficient_sample")).alias("exclusion_reason"))
    return S.trial_counts(trials)


def asset_series(spark, folder):
    return asset_return(market_panel(spark, folder)).where("asset_return is not null").select(
        "timestamp", F.col("asset").alias("id"), F.col("asset_return").alias("ret"))


_PAIRS = """pairs AS (SELECT x.asset AS a, y.asset AS b, corr(x.r, y.r) AS c, count(*) AS n FROM ret x JOIN ret y ON x.ts=y.ts AND x.asset < y.asset
  WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1,2)"""


@register("pairwise_corr", with_(MARKET, RETURNS, _PAIRS) + f"SELECT a, b, {q_round('c')} AS corr, n::BIGINT AS overlap FROM pairs")
def pairwise_corr(spark, folder):
    return S.pairwise_correlation(asset_series(spark, folder)).select("a", "b", rounded("corr"), "overlap")


_FIRST_FIT = """ids AS (SELECT row_number() OVER (ORDER BY id) AS k, id FROM (SELECT DISTINCT asset AS id FROM both_sets)),
near AS (SELECT list(x.asset||'|'||y.asset) AS pairs FROM (SELECT a.asset, b.asset AS other, corr(a.r, b.r) AS c, count(*) AS n FROM both_sets a JOIN both_sets b ON a.ts=b.ts AND a.asset<>b.asset GROUP BY 1,2) x,
  LATERAL (SELECT x.other AS asset) y WHERE x.c > 0.9 AND x.n >= 30),
fit(k, clusters) AS (SELECT 0, []::VARCHAR[][] UNION ALL
  SELECT k+1, CASE WHEN home IS NULL OR home = 0 THEN list_append(clusters, [id]) ELSE list_transform(clusters, lambda c, i: CASE WHEN i = home THEN list_append(c, id) ELSE c END) END
  FROM (SELECT f.k, f.clusters, i.id, list_position(list_transform(f.clusters, lambda c: len(list_filter(c, lambda m: NOT list_contains(n.pairs, i.id||'|'||m))) = 0), true) AS home
    FROM fit f JOIN ids i ON i.k = f.k+1, near n))"""


@register("effective_trials", with_(MARKET, RETURNS, "both_sets AS (SELECT ts, asset, r FROM ret WHERE r IS NOT NULL UNION ALL SELECT ts, asset||'_twin', r FROM ret WHERE r IS NOT NULL)", _FIRST_FIT)
          .replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT 'all' AS search, len(clusters)::BIGINT AS effective_n_trials FROM fit ORDER BY k DESC LIMIT 1")
def effective_trials(spark, folder):
    series = asset_series(spark, folder).withColumn("search", F.lit("all"))
    twin = series.withColumn("id", F.concat("id", F.lit("_twin")))
    return S.effective_trials(series.unionByName(twin))


# Members of a group: assets by the length of their symbol.
_GROUPS = """grp AS (SELECT length(asset)::VARCHAR AS g, asset, ts, r FROM ret WHERE r IS NOT NULL),
full_bars AS (SELECT g, ts FROM grp GROUP BY 1,2 HAVING count(*) = (SELECT count(DISTINCT asset) FROM grp z WHERE z.g = grp.g)),
common AS (SELECT grp.* FROM grp JOIN full_bars USING (g, ts))"""


def members(spark, folder):
    return asset_series(spark, folder).withColumn("group", F.length("id").cast("string"))


@register("ensemble_returns", with_(MARKET, RETURNS, _GROUPS) + f'SELECT g AS "group", {q_day("ts")} AS bar, {q_round("avg(r)", 8)} AS ret FROM common GROUP BY g, ts')
def ensemble_returns(spark, folder):
    return S.ensemble_returns(members(spark, folder), "group").select("group", day(), rounded("ret", 8))


@register("ensemble_precheck", with_(MARKET, RETURNS, _GROUPS) + f""", pc AS (
  SELECT x.g, x.asset AS a, y.asset AS b, corr(x.r, y.r) AS c FROM common x JOIN common y ON x.g=y.g AND x.ts=y.ts AND x.asset<y.asset GROUP BY 1,2,3),
m AS (SELECT g, count(DISTINCT asset) AS k FROM grp GROUP BY 1),
s AS (SELECT m.g, m.k, coalesce(max(c),0) AS mx, count(*) FILTER (c > 0.05) AS close FROM m LEFT JOIN pc ON pc.g=m.g GROUP BY 1,2)
SELECT g AS "group", k::BIGINT AS members, {q_round('mx')} AS max_pairwise_corr, close::BIGINT AS redundant_pairs,
  CASE WHEN close > 0 AND close >= k*(k-1)/2 THEN 'BLOCK_ENSEMBLE' WHEN close > 0 THEN 'DROP_REDUNDANT' ELSE 'PROCEED' END AS recommendation FROM s""")
def ensemble_precheck(spark, folder):
    r = S.ensemble_precheck(members(spark, folder), "group", 0.05)
    return r.select("group", "members", rounded("max_pairwise_corr"), "redundant_pairs", "recommendation")
