"""Queries over raw and canonical panels: normalisation, filters, repair and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators.factors import asset_return
from ..operators.ranking import lag_for_execution
from .panels import brand_panel, market_panel, migrations, raw_feed, user_panel
from .registry import (CANON, COLLAPSED, FEED, MARKET, MIGRATION_DIM, BRAND_WEEK, RETURNS, count, day, q_day,
                       q_round, register, rounded, with_)


@register("scan_panel", with_(BRAND_WEEK) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('price', 8)} AS price, volume, {q_round('quote_volume', 2)} AS quote_volume,
       {q_round('funding_rate', 10)} AS funding_rate FROM panel""")
def scan_panel(spark, folder):
    return P.ingest(brand_panel(spark, folder)).select(day(), "asset", rounded("price", 8), "volume", rounded("quote_volume", 2), rounded("funding_rate", 10))


@register("canonical_asset", with_(MARKET, FEED, CANON) + """
SELECT source_asset, asset, count(*)::BIGINT AS rows FROM canon GROUP BY 1,2""")
def canonical_asset(spark, folder):
    named = P.canonical_assets(raw_feed(spark, folder), migrations(spark))
    return named.groupBy("source_asset", "asset").agg(F.count(F.lit(1)).alias("rows"))


@register("price_adjust", with_(MARKET, FEED, CANON) + f"""
SELECT {q_day('ts')} AS bar, source_asset, {q_round('price', 8)} AS price, price_adjustment_factor FROM canon""")
def price_adjust(spark, folder):
    dim = migrations(spark)
    adjusted = P.adjust_prices(P.canonical_assets(raw_feed(spark, folder), dim), dim)
    return adjusted.select(day(), "source_asset", rounded("price", 8), "price_adjustment_factor")


@register("canonical_panel", with_(MARKET, FEED, CANON, COLLAPSED) + f"""
SELECT {q_day('ts')} AS bar, asset, source_asset, {q_round('price', 8)} AS price, {q_round('funding_rate', 10)} AS funding_rate,
       {q_round('price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1')} AS asset_return FROM clean""")
def canonical_panel(spark, folder):
    panel = P.canonical_panel(raw_feed(spark, folder), migrations(spark))
    return panel.select(day(), "asset", "source_asset", rounded("price", 8), rounded("funding_rate", 10), rounded("asset_return"))


@register("asset_return", with_(BRAND_WEEK, RETURNS) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('r')} AS asset_return FROM ret""")
def simple_returns(spark, folder):
    return asset_return(brand_panel(spark, folder)).select(day(), "asset", rounded("asset_return"))


@register("panel_violations", with_(MARKET, FEED, CANON) + """, dirty AS (
  SELECT ts, asset, CASE WHEN volume % 13 = 4 THEN 0.0 ELSE price END AS price,
         CASE WHEN volume % 5 = 2 THEN NULL ELSE volume END AS signal, funding_rate FROM canon)
SELECT 'bad_price' AS rule, count(*) FILTER (price IS NULL OR price <= 0)::BIGINT AS violations FROM dirty
UNION ALL SELECT 'bad_signal', count(*) FILTER (signal IS NULL)::BIGINT FROM dirty
UNION ALL SELECT 'infinite_funding', count(*) FILTER (isinf(funding_rate))::BIGINT FROM dirty
UNION ALL SELECT 'duplicate_key', coalesce(sum(n-1),0)::BIGINT FROM (SELECT count(*) AS n FROM dirty GROUP BY ts, asset)""")
def panel_violations(spark, folder):
    dim = migrations(spark)
    rows = P.canonical_assets(raw_feed(spark, folder), dim)
    dirty = rows.withColumns({
        "price": F.when(F.col("volume") % 13 == 4, F.lit(0.0)).otherwise(F.col("price")),
        "signal": F.when(F.col("volume") % 5 != 2, F.col("volume")),
    })
    return P.panel_violations(dirty).select("rule", count("violations"))


@register("exec_lag", with_(BRAND_WEEK, RETURNS) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('s')} AS signal FROM (
  SELECT ts, asset, lag(r) OVER (PARTITION BY asset ORDER BY ts) AS s FROM ret) WHERE s IS NOT NULL""")
def exec_lag(spark, folder):
    rows = asset_return(brand_panel(spark, folder)).withColumn("sig", F.col("asset_return"))
    return lag_for_execution(rows).select(day(), "asset", rounded("sig", name="signal"))


@register("signal_smooth", with_(BRAND_WEEK, RETURNS) + f""", lagged AS (
  SELECT ts, asset, lag(r) OVER (PARTITION BY asset ORDER BY ts) AS s FROM ret QUALIFY s IS NOT NULL),
sm AS (SELECT ts, asset, CASE WHEN count(s) OVER w = 4 THEN avg(s) OVER w END AS s FROM lagged
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT {q_day('ts')} AS bar, asset, {q_round('s')} AS signal FROM sm WHERE s IS NOT NULL""")
def signal_smooth(spark, folder):
    rows = asset_return(brand_panel(spark, folder)).withColumn("sig", F.col("asset_return"))
    return lag_for_execution(rows, smooth=4).select(day(), "asset", rounded("sig", name="signal"))


def cutovers(spark):
    suffix = F.lit("USDT")
    return migrations(spark).where("effective is not null").select(
        F.concat("canonical", suffix).alias("target"), F.concat("source", suffix).alias("source"), F.col("effective").alias("cutover"))


_RELABELLED = f"""{MIGRATION_DIM},
stale AS (SELECT ts, asset, price, CASE WHEN volume % 11 = 5 THEN 0 WHEN volume % 11 = 6 THEN NULL ELSE volume END AS volume FROM panel),
rel AS (SELECT s.ts, s.price, s.volume, CASE WHEN s.ts < m.effective THEN m.source||'USDT' ELSE s.asset END AS asset,
        coalesce(s.ts < m.effective, false) AS relabelled, s.asset AS target
        FROM stale s LEFT JOIN mig m ON s.asset = m.canonical||'USDT')"""


def _stale_panel(spark, folder):
    volume = F.when(F.col("volume") % 11 == 5, F.lit(0.0)).when(F.col("volume") % 11 != 6, F.col("volume"))
    return market_panel(spark, folder).withColumn("volume", volume)


@register("relabel", with_(MARKET, _RELABELLED) + f"""
SELECT target, asset AS source, count(*)::BIGINT AS rows, {q_day('max(ts)')} AS last_bar FROM rel WHERE relabelled GROUP BY 1,2""")
def relabel(spark, folder):
    rows = _stale_panel(spark, folder).withColumn("was", F.col("asset"))
    changed = P.relabel_history(rows, cutovers(spark)).where("relabelled")
    return changed.groupBy(F.col("was").alias("target"), F.col("asset").alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), day(F.max("timestamp"), "last_bar"))


@register("drop_stale", with_(MARKET, _RELABELLED) + f"""
SELECT asset, count(*) FILTER (volume > 0)::BIGINT AS kept, count(*) FILTER (volume IS NULL OR volume <= 0)::BIGINT AS dropped
FROM stale GROUP BY 1""")
def drop_stale(spark, folder):
    rows = _stale_panel(spark, folder)
    kept = P.drop_stale(rows).groupBy("asset").agg(F.count(F.lit(1)).alias("kept"))
    dropped = P.stale_counts(rows).select("asset", F.col("rows").alias("dropped"))
    return kept.join(dropped, "asset", "full").select("asset", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


@register("dup_rows", with_(MARKET, FEED, CANON) + f"""
SELECT {q_day('ts')} AS bar, asset, count(*)::BIGINT AS copies FROM canon GROUP BY ts, asset HAVING count(*) > 1""")
def dup_rows(spark, folder):
    rows = P.canonical_assets(raw_feed(spark, folder), migrations(spark))
    return P.duplicate_keys(rows).select(day(), "asset", "copies")


@register("repair_panel", with_(MARKET, _RELABELLED) + """
SELECT count(*)::BIGINT AS input_rows, count(*) FILTER (relabelled)::BIGINT AS relabelled_rows,
       count(*) FILTER (volume IS NULL OR volume <= 0)::BIGINT AS stale_rows, count(*) FILTER (volume > 0)::BIGINT AS output_rows FROM rel""")
def repair_panel(spark, folder):
    return P.repair_panel(_stale_panel(spark, folder), cutovers(spark))[1]


_LEGACY = f"""{MIGRATION_DIM},
legacy AS (SELECT p.ts, p.asset, CASE WHEN p.ts < m.effective THEN p.price*m.factor ELSE p.price END AS price,
  CASE WHEN p.volume % 11 = 5 THEN 0 ELSE p.volume END AS volume, m.factor, date_trunc('day', m.effective) AS cutoff
  FROM panel p LEFT JOIN mig m ON p.asset = m.canonical||'USDT' AND m.factor IS NOT NULL),
fixed AS (SELECT ts, asset, volume, cutoff, CASE WHEN date_trunc('day', ts) < cutoff THEN price/factor ELSE price END AS price
  FROM legacy WHERE volume > 0)"""


def _legacy_panel(spark, folder):
    """Canonical names on old prices: the old scale is kept before each migration instant."""
    dim = migrations(spark)
    rows = P.legacy_factor(market_panel(spark, folder), dim).drop("cutoff").join(
        dim.select(F.concat("canonical", F.lit("USDT")).alias("asset"), "effective"), "asset", "left")
    old = F.col("timestamp") < F.col("effective")
    return rows.withColumns({
        "price": F.when(old, F.col("price") * F.col("factor")).otherwise(F.col("price")),
        "volume": F.when(F.col("volume") % 11 == 5, F.lit(0.0)).otherwise(F.col("volume")),
    }).drop("factor", "effective")


@register("repair_klines", with_(MARKET, _LEGACY) + f"""
SELECT {q_day('ts')} AS bar, asset, {q_round('price', 8)} AS price, volume FROM fixed""")
def repair_klines(spark, folder):
    return P.repair_klines(_legacy_panel(spark, folder), migrations(spark)).select(day(), "asset", rounded("price", 8), "volume")


@register("seam_return", with_(MARKET, _LEGACY) + f"""
SELECT asset, {q_day('max(ts) FILTER (ts < cutoff)')} AS last_legacy, {q_day('min(ts) FILTER (ts >= cutoff)')} AS first_new,
  {q_round('arg_min(price, ts) FILTER (ts >= cutoff) / arg_max(price, ts) FILTER (ts < cutoff) - 1')} AS seam_return
FROM fixed WHERE cutoff IS NOT NULL GROUP BY asset""")
def seam_return(spark, folder):
    dim = migrations(spark)
    seams = P.migration_seams(P.repair_klines(_legacy_panel(spark, folder), dim), dim)
    return seams.select("asset", day("last_legacy", "last_legacy"), day("first_new", "first_new"), rounded("seam_return"))


@register("asset_coverage", f"""WITH panel AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS ts, user_id::VARCHAR AS asset FROM events GROUP BY 1,2)
SELECT asset, {q_day('min(ts)')} AS first_seen, {q_day('max(ts)')} AS last_seen, count(DISTINCT ts)::BIGINT AS periods,
  max(ts) < (SELECT max(ts) FROM panel) - INTERVAL 2 DAY AS suspect,
  CASE WHEN count(DISTINCT ts) = (SELECT count(DISTINCT ts) FROM panel) THEN 'active_full_period' ELSE 'partial_history_or_delisted' END AS status
FROM panel GROUP BY asset""")
def asset_coverage(spark, folder):
    cover = P.asset_coverage(user_panel(spark, folder), suspect_days=2)
    return cover.select("asset", day("first_seen", "first_seen"), day("last_seen", "last_seen"), "periods", "suspect", "status")


@register("membership", with_(MARKET, FEED, CANON) + f"""
SELECT {q_day('ts')} AS bar, asset, count(*)::BIGINT AS rows FROM canon GROUP BY ts, asset""")
def membership(spark, folder):
    rows = P.canonical_assets(raw_feed(spark, folder), migrations(spark))
    return P.membership(rows).select(day(), "asset", "rows")
