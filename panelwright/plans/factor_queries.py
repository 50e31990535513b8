"""Queries over factors and cross-sectional ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SIGNAL_CANDIDATES
from ..operators import factors as A
from ..operators.ranking import bar_ends, lag_for_execution, liquidity_percentile, thin_bars
from .panels import brand_panel, market_panel, stored_market
from .registry import (ALL_FACTORS, BRAND_WEEK, FACTORS, MARKET, count, day, exec_sql, q_day, q_round, register, rounded,
                       with_)


def wide(spark, folder):
    return A.build_signals(stored_market(spark, folder))


def price_only(spark, folder):
    return A.price_factors(A.asset_return(market_panel(spark, folder)))


def carries(spark, folder):
    return A.carry_factors(A.asset_return(market_panel(spark, folder)))


def _simple(name, columns, build):
    measures = ", ".join(f"{q_round(c, 12)} AS {c}" for c in columns)

    @register(name, with_(MARKET, FACTORS) + f"SELECT {q_day('ts')} AS bar, asset, {measures} FROM fac")
    def query(spark, folder):
        return build(spark, folder).select(day(), "asset", *[rounded(c, 12) for c in columns])


_simple("momentum", ["momentum_7", "momentum_14", "momentum_30"], price_only)
_simple("vol_adj_momentum", ["vol_adj_momentum_7", "vol_adj_momentum_14", "vol_adj_momentum_30"], price_only)
_simple("low_vol", ["low_vol_7", "low_vol_14", "low_vol_30"], price_only)
_simple("reversal_1", ["reversal_1"], price_only)
_simple("carry", ["carry"], carries)
_simple("funding_surprise", ["funding_surprise"], carries)
_simple("vol_adj_carry", ["vol_adj_carry"], carries)


@register("resid_reversal", with_(MARKET, ALL_FACTORS) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('resid_reversal_14', 10)} AS resid_reversal_14, {q_round('resid_reversal_30', 10)} AS resid_reversal_30 FROM allfac""")
def resid_reversal(spark, folder):
    frame = A.residual_reversal(A.asset_return(stored_market(spark, folder)))
    return frame.select(day(), "asset", rounded("resid_reversal_14", 10), rounded("resid_reversal_30", 10))


@register("xs_zscore", with_(MARKET, FACTORS) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round("CASE WHEN stddev_pop(momentum_14) OVER (PARTITION BY ts) < 1e-12 THEN 0.0 ELSE (momentum_14 - avg(momentum_14) OVER (PARTITION BY ts)) / stddev_pop(momentum_14) OVER (PARTITION BY ts) END")} AS z
FROM fac""")
def xs_zscore(spark, folder):
    frame = A.price_factors(A.asset_return(stored_market(spark, folder)))
    return A.cross_sectional_z(frame, ["momentum_14"]).select(day(), "asset", rounded("momentum_14_z", name="z"))


@register("combo_z", with_(MARKET, ALL_FACTORS) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('carry_mom_z', 10)} AS carry_mom_z, {q_round('carry_lowvol_z', 10)} AS carry_lowvol_z FROM allfac""")
def combo_z(spark, folder):
    return wide(spark, folder).select(day(), "asset", rounded("carry_mom_z", 10), rounded("carry_lowvol_z", 10))


@register("build_signals", with_(MARKET, ALL_FACTORS) + f"""
SELECT {q_day('ts')} AS bar, asset, {', '.join(f'{q_round(c, 12)} AS {c}' for c in SIGNAL_CANDIDATES)} FROM allfac""")
def build_signals(spark, folder):
    return wide(spark, folder).select(day(), "asset", *[rounded(c, 12) for c in SIGNAL_CANDIDATES])


@register("available_candidates", with_(MARKET, ALL_FACTORS) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS signal, {i}::BIGINT AS ordinal, count({c})::BIGINT AS values FROM allfac" for i, c in enumerate(SIGNAL_CANDIDATES)) + ") WHERE values > 0")
def available_candidates(spark, folder):
    return A.available_candidates(wide(spark, folder)).select("signal", count("ordinal"), "values")


def ranked(spark, folder, signal="momentum_7", panel=None):
    """Executable rows of one price factor of the market panel."""
    frame = A.price_factors(A.asset_return(panel if panel is not None else market_panel(spark, folder)))
    rows = A.unpivot_signals(frame, [signal], keep=("timestamp", "asset", "price", "funding_rate", "quote_volume"))
    return lag_for_execution(rows, ["signal"])


@register("top_bottom_n", with_(MARKET, FACTORS, exec_sql()) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('sig', 10)} AS sig, CASE WHEN up <= 3 THEN 'long' ELSE 'short' END AS leg,
  CASE WHEN up <= 3 THEN up ELSE dn END::BIGINT AS place FROM legs WHERE up <= 3 OR dn <= 3""")
def top_bottom_n(spark, folder):
    ends = bar_ends(ranked(spark, folder), ["signal"], 3, 3)
    return ends.select(day(), "asset", rounded("sig", 10), F.when(F.col("side") == 1, "long").otherwise("short").alias("leg"), count("place"))


@register("thin_bars", with_(BRAND_WEEK, FACTORS, exec_sql("momentum_30")) + f"""
SELECT {q_day('ts')} AS bar, count(*)::BIGINT AS assets FROM xs GROUP BY ts HAVING count(*) < 25""")
def thin(spark, folder):
    frame = A.price_factors(A.asset_return(brand_panel(spark, folder)))
    rows = lag_for_execution(A.unpivot_signals(frame, ["momentum_30"]), ["signal"])
    return thin_bars(rows, ["signal"], 25).select(day(), "assets")


@register("liquidity_pct", with_(MARKET, """scored AS (
  SELECT *, round(avg(quote_volume) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),6) AS score FROM panel),
rk AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY score NULLS LAST) AS k, count(*) OVER (PARTITION BY ts, score) AS ties,
  count(score) OVER (PARTITION BY ts) AS n FROM scored)""") + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('CASE WHEN score IS NOT NULL THEN (k + (ties-1)/2.0)/n END')} AS liq_pct FROM rk""")
def liquidity_pct(spark, folder):
    return liquidity_percentile(market_panel(spark, folder), "quote_volume").select(day(), "asset", rounded("liq_pct"))
