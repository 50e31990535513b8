"""Queries over data quality, funding and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.literal import literal_table
from ..operators import audit as Q
from ..operators import panel as P
from ..session import materialise
from .panels import market_panel, migrations, raw_feed, stored_market, table, user_panel
from .registry import (CANON, COLLAPSED, FEED, MARKET, MARKET_DAY, MIGRATION_DIM, USER_DAY, count, day, q_day,
                       q_round, register, rounded, with_)

# --- gaps ------------------------------------------------------------------------------------

_SPAN = "(SELECT asset, min(ts) AS a, max(ts) AS b FROM panel GROUP BY asset HAVING count(DISTINCT ts) > 1)"
_MISSING = f"""missing AS (
  SELECT asset, g.ts FROM (SELECT asset, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM {_SPAN}) g
  WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.asset=g.asset AND p.ts=g.ts)),
isl AS (SELECT asset, ts, ts - INTERVAL 1 DAY * row_number() OVER (PARTITION BY asset ORDER BY ts) AS island FROM missing),
blocks AS (SELECT b.asset, gap_start, gap_end, gap_steps,
  CASE WHEN m.effective BETWEEN gap_start - INTERVAL 7 DAY AND gap_end + INTERVAL 7 DAY THEN 'migration_halt' ELSE 'unexplained_interior' END AS reason
  FROM (SELECT asset, min(ts) AS gap_start, max(ts) AS gap_end, count(*)::BIGINT AS gap_steps FROM isl GROUP BY asset, island) b
  LEFT JOIN mig m ON b.asset = m.canonical||'USDT' AND m.effective IS NOT NULL)"""


def day_market(spark, folder):
    return market_panel(spark, folder, "day")


@register("gap_blocks", with_(MARKET_DAY, MIGRATION_DIM, _MISSING) + f"""
SELECT asset, {q_day('gap_start')} AS gap_start, {q_day('gap_end')} AS gap_end, gap_steps, reason FROM blocks""")
def gap_blocks(spark, folder):
    blocks = Q.gap_blocks(day_market(spark, folder), migrations(spark))
    return blocks.select("asset", day("gap_start", "gap_start"), day("gap_end", "gap_end"), count("gap_steps"), "reason")


@register("calendar_gaps", with_(MARKET_DAY, MIGRATION_DIM, _MISSING) + f"SELECT asset, {q_day('ts')} AS bar FROM missing")
def calendar_gaps(spark, folder):
    return Q.calendar_gaps(Q.gap_blocks(day_market(spark, folder), migrations(spark))).select("asset", day())


@register("gap_summary", with_(MARKET_DAY, MIGRATION_DIM, _MISSING) + f""", near AS (
  SELECT x.asset, count(*)::BIGINT AS missing, count(*) FILTER (abs(epoch(x.ts) - epoch(m.effective)) <= 7*86400)::BIGINT AS near_migration
  FROM missing x LEFT JOIN mig m ON x.asset = m.canonical||'USDT' AND m.effective IS NOT NULL GROUP BY 1)
SELECT n.asset, bars, first_seen, last_seen, missing, near_migration, missing - near_migration AS interior FROM near n JOIN (
  SELECT asset, count(DISTINCT ts)::BIGINT AS bars, {q_day('min(ts)')} AS first_seen, {q_day('max(ts)')} AS last_seen FROM panel GROUP BY 1) USING (asset)""")
def gap_summary(spark, folder):
    panel, dim = materialise(day_market(spark, folder)), migrations(spark)
    table_ = Q.gap_summary(panel, Q.gap_blocks(panel, dim), dim)
    return table_.select("asset", "bars", day("first_seen", "first_seen"), day("last_seen", "last_seen"), "missing", "near_migration", "interior")


# --- funding ---------------------------------------------------------------------------------

_GAPS = """prints AS (SELECT asset, min(ts) AS first_print, max(ts) AS last_print FROM canon WHERE funding_rate IS NOT NULL GROUP BY 1),
fgaps AS (
  SELECT c.ts, c.asset, CASE
    WHEN abs(epoch(c.ts) - epoch(m.effective)) <= 7*86400 THEN 'migration'
    WHEN p.asset IS NULL OR c.ts < p.first_print THEN 'not_listed'
    WHEN c.ts > p.last_print THEN 'delisted'
    WHEN NOT coalesce(c.price > 0, false) OR NOT coalesce(c.volume > 0, false) THEN 'delisted' ELSE 'active' END AS reason
  FROM canon c LEFT JOIN prints p ON p.asset=c.asset LEFT JOIN mig m ON c.asset = m.canonical||'USDT' AND m.effective IS NOT NULL
  WHERE c.funding_rate IS NULL)"""


@register("funding_gaps", with_(MARKET, FEED, CANON, _GAPS) + f"SELECT {q_day('ts')} AS bar, asset, reason FROM fgaps")
def funding_gaps(spark, folder):
    return Q.funding_gaps(raw_feed(spark, folder), migrations(spark)).select(day(), "asset", "reason")


@register("funding_gap_split", with_(MARKET, FEED, CANON, _GAPS) + """
SELECT reason, reason IN ('not_listed','delisted','migration') AS expected, count(*)::BIGINT AS rows FROM fgaps GROUP BY 1,2""")
def funding_gap_split(spark, folder):
    gaps = Q.split_funding_gaps(Q.funding_gaps(raw_feed(spark, folder), migrations(spark)))
    return gaps.groupBy("reason", "expected").agg(F.count(F.lit(1)).alias("rows"))


# Event-level prints: one per order line, settled at an hour taken from the order key.
_PRINTS = """prints AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 1 HOUR * (l_orderkey % 24) AS ts, 'SUPP'||(l_suppkey % 25)||'USDT' AS asset,
    (l_tax - 0.04)/100 AS rate FROM lineitem),
daily AS (SELECT date_trunc('day', ts)::TIMESTAMP AS date, asset, round(sum(rate),10) AS rate, count(*)::BIGINT AS prints FROM prints GROUP BY 1,2)"""


def funding_prints(spark, folder):
    hour = F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))
    return table(spark, folder, "lineitem").select(
        (F.date_trunc("day", F.col("l_shipdate").cast("timestamp")) + hour).alias("timestamp"),
        F.concat(F.lit("SUPP"), (F.col("l_suppkey") % 25).cast("string"), F.lit("USDT")).alias("asset"),
        ((F.col("l_tax") - 0.04) / 100).alias("funding_rate"))


@register("funding_frequency", with_(_PRINTS) + f"""
SELECT asset, max(prints)::BIGINT AS max_settlements_per_day, {q_round('max(abs(rate))', 8)} AS max_abs_daily_rate FROM daily GROUP BY 1""")
def funding_frequency(spark, folder):
    report = Q.funding_frequency(funding_prints(spark, folder))
    return report.select("asset", "max_settlements_per_day", rounded(F.abs("max_abs_daily_rate"), 8, "max_abs_daily_rate"))


@register("funding_conflicts", with_(_PRINTS) + f"""
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, asset, count(DISTINCT rate)::BIGINT AS rates, count(*)::BIGINT AS prints
FROM prints GROUP BY ts, asset HAVING count(DISTINCT rate) > 1""")
def funding_conflicts(spark, folder):
    found = Q.funding_conflicts(funding_prints(spark, folder))
    return found.select(F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour"), "asset", "rates", "prints")


@register("funding_join", with_(MARKET_DAY, _PRINTS) + f""", named AS (SELECT ts, volume, 'SUPP'||regexp_extract(asset, '([0-9]+)', 1)||'USDT' AS asset FROM panel WHERE asset LIKE 'BRAND%')
SELECT {q_day('n.ts')} AS bar, n.asset, n.volume, {q_round('d.rate', 8)} AS funding_rate FROM named n LEFT JOIN daily d ON d.date = n.ts AND d.asset = n.asset""")
def funding_join(spark, folder):
    number = F.regexp_extract("asset", "([0-9]+)", 1)
    panel = day_market(spark, folder).where("asset like 'BRAND%'").withColumn("asset", F.concat(F.lit("SUPP"), number, F.lit("USDT")))
    joined = Q.join_funding(panel, funding_prints(spark, folder))
    return joined.select(day(), "asset", "volume", rounded("funding_rate", 8))


@register("cutover_split", with_(MARKET, FEED, CANON) + """, feeds AS (SELECT asset, count(DISTINCT source_asset) AS k FROM canon GROUP BY 1),
s AS (SELECT c.asset, c.source_asset, CASE WHEN k = 1 OR m.effective IS NULL THEN true
  WHEN c.source_asset = m.source||'USDT' THEN c.ts < date_trunc('day', m.effective) ELSE c.ts >= date_trunc('day', m.effective) END AS kept
  FROM canon c JOIN feeds USING (asset) LEFT JOIN mig m ON c.asset = m.canonical||'USDT' AND m.effective IS NOT NULL)
SELECT asset, source_asset AS source, count(*) FILTER (kept)::BIGINT AS kept, count(*) FILTER (NOT kept)::BIGINT AS dropped FROM s GROUP BY 1,2""")
def cutover_split(spark, folder):
    prints = raw_feed(spark, folder).withColumnRenamed("asset", "source")
    split = Q.cutover_split(prints, migrations(spark))
    return split.groupBy("asset", "source").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@register("funding_coverage", with_(MARKET, FEED, CANON) + """
SELECT asset, count(funding_rate)::BIGINT AS have, count(*)::BIGINT AS rows FROM canon GROUP BY 1""")
def funding_coverage(spark, folder):
    return Q.funding_coverage(P.canonical_assets(raw_feed(spark, folder), migrations(spark)))


# --- identity and lifecycle ------------------------------------------------------------------

@register("collisions", with_(MARKET, FEED, CANON) + f"""
SELECT {q_day('ts')} AS bar, asset, string_agg(DISTINCT source_asset, ',' ORDER BY source_asset) AS source_assets
FROM canon GROUP BY ts, asset HAVING count(DISTINCT source_asset) > 1""")
def collisions(spark, folder):
    found = Q.collisions(P.canonical_assets(raw_feed(spark, folder), migrations(spark)))
    return found.select(day(), "asset", "source_assets")


@register("discontinuities", with_(MARKET, FEED, CANON) + f""", one AS (
  SELECT ts, base_asset AS asset, source_asset, price FROM (
    SELECT n.ts, coalesce(m.canonical, n.base)||n.quote AS base_asset, n.source_asset, n.price FROM named n LEFT JOIN mig m ON m.source=n.base)
  QUALIFY row_number() OVER (PARTITION BY ts, base_asset ORDER BY source_asset DESC) = 1),
st AS (SELECT *, price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS jump,
  row_number() OVER (PARTITION BY asset, source_asset ORDER BY ts) AS k FROM one)
SELECT asset, source_asset, {q_day('ts')} AS bar, {q_round('jump')} AS price_jump FROM st WHERE k = 1 AND abs(jump) > 0.2""")
def discontinuities(spark, folder):
    dim = migrations(spark)
    rows = P.canonical_assets(raw_feed(spark, folder), dim)
    latest = rows.groupBy("timestamp", "asset").agg(F.max_by("price", "source_asset").alias("price"), F.max("source_asset").alias("source_asset"))
    return Q.discontinuities(latest).select("asset", "source_asset", day(), rounded("price_jump"))


_LIFE = """seen AS (
  SELECT asset AS canonical, source_asset AS symbol, base, min(ts) AS first_seen, max(ts) AS last_seen, median(step) AS step FROM (
    SELECT c.ts, c.asset, c.source_asset, regexp_replace(c.source_asset, '(USDT|USDC|BUSD|BTC|ETH)$', '') AS base,
      epoch(lead(c.ts) OVER (PARTITION BY c.asset, c.source_asset ORDER BY c.ts)) - epoch(c.ts) AS step FROM src c) GROUP BY 1,2,3),
life AS (
  SELECT s.canonical, s.symbol,
    CASE WHEN o.source IS NULL AND t.effective IS NOT NULL THEN t.effective ELSE first_seen END AS listed_at,
    CASE WHEN o.source IS NOT NULL THEN o.effective WHEN last_seen < (SELECT max(ts) FROM src) - INTERVAL 7 DAY
      THEN last_seen + to_seconds(coalesce(step, 86400)::BIGINT) END AS delisted_at,
    CASE WHEN o.source IS NOT NULL THEN 'migration_source' WHEN t.source IS NOT NULL THEN 'migration_target'
      WHEN last_seen < (SELECT max(ts) FROM src) - INTERVAL 7 DAY THEN 'delisting' ELSE 'active' END AS event
  FROM seen s LEFT JOIN mig o ON o.source = s.base AND o.effective IS NOT NULL LEFT JOIN mig t ON t.canonical = s.base)"""


@register("lifecycle", with_(MARKET, FEED, CANON, "src AS (SELECT ts, asset, source_asset FROM canon)", _LIFE) + f"""
SELECT canonical, symbol, {q_day('listed_at')} AS listed_at, {q_day('delisted_at')} AS delisted_at, event FROM life""")
def lifecycle(spark, folder):
    dim = migrations(spark)
    segments = Q.lifecycle(P.canonical_assets(raw_feed(spark, folder), dim), dim)
    return segments.select("canonical", "symbol", day("listed_at", "listed_at"), day("delisted_at", "delisted_at"), "event")


# First and last week per brand (delisted at its last week for every third brand), and dead symbols.
DEAD_SYMBOLS = (("LUNAUSDT", "1996-03-04", "1998-05-11"), ("FTTUSDT", "1999-01-04", "1999-11-08"), ("OLDUSDT", "1990-01-01", "1992-06-01"))
_DEAD = ", ".join(f"('{s}', TIMESTAMP '{a}', TIMESTAMP '{b}', 'NOT_TRADING', 'inline')" for s, a, b in DEAD_SYMBOLS)
_MANIFEST = f"""man AS (
  SELECT asset AS symbol, min(ts) + INTERVAL 30 DAY AS listed_at, CASE WHEN length(asset) = 11 THEN max(ts) - INTERVAL 400 DAY END AS delisted_at,
    'TRADING' AS status, 'weekly_files' AS source FROM panel GROUP BY 1
  UNION ALL SELECT * FROM (VALUES {_DEAD}, ('NEWUSDT', TIMESTAMP '1997-02-03', NULL, 'TRADING', 'inline')))"""


def manifest(spark, panel):
    listed = panel.groupBy("asset").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).select(
        F.col("asset").alias("symbol"), (F.col("first") + Q.days(30)).alias("listed_at"),
        F.when(F.length("asset") == 11, F.col("last") - Q.days(400)).alias("delisted_at"),
        F.lit("TRADING").alias("status"), F.lit("weekly_files").alias("source"))
    rows = [(s, a, b, "NOT_TRADING", "inline") for s, a, b in DEAD_SYMBOLS] + [("NEWUSDT", "1997-02-03", None, "TRADING", "inline")]
    dead = literal_table(spark, rows, "symbol string, listed_at string, delisted_at string, status string, source string")
    return listed.unionByName(dead.withColumns({"listed_at": F.to_timestamp("listed_at"), "delisted_at": F.to_timestamp("delisted_at")}))


@register("manifest_segments", with_(MARKET, MIGRATION_DIM, _MANIFEST) + f"""
SELECT coalesce(m.canonical||'USDT', symbol) AS canonical, symbol, {q_day('listed_at')} AS listed_at, {q_day('delisted_at')} AS delisted_at,
  CASE WHEN delisted_at IS NULL THEN 'active' ELSE 'delisting' END AS event, 'listing_manifest:'||man.source AS source
FROM man LEFT JOIN mig m ON m.source||'USDT' = symbol""")
def manifest_segments(spark, folder):
    segments = Q.manifest_segments(manifest(spark, market_panel(spark, folder)), migrations(spark))
    return segments.select("canonical", "symbol", day("listed_at", "listed_at"), day("delisted_at", "delisted_at"), "event", "source")


@register("active_assets", with_(MARKET, _MANIFEST) + f"""
SELECT {q_day('d')} AS instant, symbol AS canonical FROM (SELECT DISTINCT date_trunc('month', ts)::TIMESTAMP AS d FROM panel)
JOIN man ON listed_at <= d AND (delisted_at IS NULL OR d < delisted_at)""")
def active_assets(spark, folder):
    panel = stored_market(spark, folder)
    instants = panel.select(F.date_trunc("month", "timestamp").alias("instant")).distinct()
    live = Q.active_assets(Q.manifest_segments(manifest(spark, panel), migrations(spark)), instants)
    return live.select(day("instant", "instant"), "canonical")


@register("universe_audit", with_(MARKET, FEED, CANON, _MANIFEST) + f""", rows AS (SELECT row_number() OVER () AS id, ts, asset, source_asset FROM canon),
seg AS (SELECT r.id, bool_or(s.symbol = r.source_asset) AS own FROM rows r JOIN man s ON s.symbol = r.asset GROUP BY 1),
chk AS (SELECT r.id, r.ts, r.asset, count(s.symbol) AS k,
   coalesce(bool_or(s.listed_at <= r.ts AND (s.delisted_at IS NULL OR r.ts < s.delisted_at)), false) AS live, coalesce(bool_or(s.listed_at > r.ts), false) AS early
  FROM rows r LEFT JOIN seg USING (id) LEFT JOIN man s ON s.symbol = r.asset AND (NOT seg.own OR s.symbol = r.source_asset) GROUP BY 1,2,3)
SELECT {q_day('ts')} AS bar, asset, CASE WHEN k = 0 THEN 'no_lifecycle_segment' WHEN early THEN 'trading_before_listing' ELSE 'trading_after_delisting' END AS reason
FROM chk WHERE NOT live""")
def universe_audit(spark, folder):
    dim, panel = migrations(spark), stored_market(spark, folder)
    rows = P.canonical_assets(raw_feed(spark, folder), dim)
    return Q.universe_audit(rows, Q.manifest_segments(manifest(spark, panel), dim), dim).select(day(), "asset", "reason")


_INSIDE = """win AS (SELECT min(ts) AS a, max(ts) AS b FROM early),
inw AS (SELECT man.*, a, b FROM man, win WHERE listed_at <= b AND (delisted_at IS NULL OR delisted_at >= a)),
have AS (SELECT DISTINCT asset FROM early),
miss AS (SELECT *, delisted_at IS NOT NULL AS dead, greatest((epoch(least(delisted_at, b)) - epoch(greatest(listed_at, a)))/86400.0, 0) + 1 AS days
  FROM inw WHERE symbol NOT IN (SELECT asset FROM have))"""
_EARLY = "early AS (SELECT * FROM panel WHERE asset <> 'BRAND20USDT' AND asset <> 'ETHUSDT')"


def _partial(spark, folder):
    panel = stored_market(spark, folder)
    kept = panel.where("asset <> 'BRAND20USDT' and asset <> 'ETHUSDT'")
    return Q.survivorship(kept, manifest(spark, panel), migrations(spark))


@register("survivorship_gap", with_(MARKET, _MANIFEST, _EARLY, _INSIDE) + f"""
SELECT (SELECT count(DISTINCT symbol) FROM inw)::BIGINT AS n_manifest_in_window, (SELECT count(*) FROM have)::BIGINT AS n_dataset,
  {q_round('(SELECT count(DISTINCT symbol) FROM inw WHERE symbol IN (SELECT asset FROM have))::DOUBLE / (SELECT count(DISTINCT symbol) FROM inw)')} AS coverage_ratio,
  (SELECT count(DISTINCT symbol) FROM miss WHERE dead)::BIGINT AS n_missing_dead, (SELECT count(DISTINCT symbol) FROM miss WHERE NOT dead)::BIGINT AS n_missing_alive,
  (SELECT floor(sum(days) FILTER (dead)) FROM miss)::BIGINT AS missing_dead_asset_days""")
def survivorship_gap(spark, folder):
    row = _partial(spark, folder)[0]
    return row.select("n_manifest_in_window", "n_dataset", rounded("coverage_ratio"), "n_missing_dead", "n_missing_alive", count("missing_dead_asset_days"))


@register("missing_dead", with_(MARKET, _MANIFEST, _EARLY, _INSIDE) + f"SELECT symbol, {q_round('days')} AS overlap_days FROM miss WHERE dead")
def missing_dead(spark, folder):
    return _partial(spark, folder)[1].where("dead").select("symbol", rounded("overlap_days"))


@register("listing_manifest", f"""SELECT 'USER'||user_id AS symbol, {q_day('min(ts)')} AS listed_at,
  CASE WHEN user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30') THEN {q_day('max(ts)')} END AS delisted_at,
  CASE WHEN user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30') THEN 'TRADING' ELSE 'NOT_TRADING' END AS status
FROM events GROUP BY user_id""")
def listing_manifest(spark, folder):
    events = table(spark, folder, "events").select(
        F.concat(F.lit("USER"), F.col("user_id").cast("string")).alias("symbol"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("file_date"))
    live = events.where(F.col("file_date") >= F.lit("2024-01-30").cast("timestamp")).select("symbol").distinct()
    return Q.listing_manifest(events, live).select("symbol", day("listed_at", "listed_at"), day("delisted_at", "delisted_at"), "status")


# --- reports ---------------------------------------------------------------------------------

@register("signal_audit", with_(USER_DAY) + f""", d AS (SELECT *, volume - lag(volume) OVER (PARTITION BY asset ORDER BY ts) AS ch FROM panel)
SELECT asset, count(volume)::BIGINT AS rows, count(DISTINCT volume)::BIGINT AS unique_signal, {q_round('stddev_samp(volume)')} AS signal_std,
  min(volume) AS signal_min, max(volume) AS signal_max, count(*) FILTER (ch = 0)::BIGINT AS zero_changes, max(abs(volume)) > 10 AS cumulative,
  count(DISTINCT volume) <= 1 OR count(*) FILTER (ch = 0) > 0 OR max(abs(volume)) > 10 AS failed FROM d GROUP BY asset""")
def signal_audit(spark, folder):
    report = Q.signal_audit(user_panel(spark, folder), "volume")
    return report.select("asset", "rows", "unique_signal", rounded("signal_std"), "signal_min", "signal_max", "zero_changes", "cumulative", "failed")


_PREFLIGHT = with_(MARKET_DAY, FEED, CANON, COLLAPSED.replace("clean AS", "clean0 AS"), _GAPS) + f""",
clean AS (SELECT *, price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS signal FROM clean0),
missing AS (SELECT asset, g.ts FROM (SELECT asset, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM
    (SELECT asset, min(ts) AS a, max(ts) AS b FROM clean GROUP BY asset)) g
  WHERE NOT EXISTS (SELECT 1 FROM clean p WHERE p.asset=g.asset AND p.ts=g.ts)),
isl AS (SELECT asset, ts, ts - INTERVAL 1 DAY * row_number() OVER (PARTITION BY asset ORDER BY ts) AS island FROM missing),
blocks AS (SELECT b.*, coalesce(m.effective BETWEEN gap_start - INTERVAL 7 DAY AND gap_end + INTERVAL 7 DAY, false) AS halt
  FROM (SELECT asset, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS gap_steps FROM isl GROUP BY asset, island) b
  LEFT JOIN mig m ON b.asset = m.canonical||'USDT' AND m.effective IS NOT NULL),
jumps AS (SELECT price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS jump, row_number() OVER (PARTITION BY asset, source_asset ORDER BY ts) AS k FROM clean),
cover AS (SELECT asset, max(ts) AS last_seen, count(*) AS periods FROM clean GROUP BY 1),
src AS (SELECT ts, asset, source_asset FROM clean), {_LIFE},"""


@register("preflight_rules", _PREFLIGHT + """
r AS (
  SELECT 'duplicate_raw_key' AS rule, 'error' AS severity, (SELECT count(*) FROM (SELECT 1 FROM feed GROUP BY ts, asset HAVING count(*) > 1)) AS n
  UNION ALL SELECT 'collision', 'error', (SELECT count(*) FROM (SELECT 1 FROM canon GROUP BY ts, asset HAVING count(DISTINCT source_asset) > 1))
  UNION ALL SELECT 'discontinuity', 'error', (SELECT count(*) FROM jumps WHERE k = 1 AND abs(jump) > 0.2)
  UNION ALL SELECT 'too_few_assets', 'error', (SELECT (count(DISTINCT asset) < 30)::INT FROM clean)
  UNION ALL SELECT 'too_few_periods', 'error', (SELECT (count(DISTINCT ts) < 2)::INT FROM clean)
  UNION ALL SELECT 'large_gap_steps', 'error', (SELECT coalesce(sum(gap_steps),0) FROM blocks WHERE NOT halt AND gap_steps > 1)
  UNION ALL SELECT 'tolerated_gap_steps', 'warning', (SELECT coalesce(sum(gap_steps),0) FROM blocks WHERE NOT halt AND gap_steps <= 1)
  UNION ALL SELECT 'halt_steps', 'warning', (SELECT coalesce(sum(gap_steps),0) FROM blocks WHERE halt)
  UNION ALL SELECT 'inferred_listing', 'warning', (SELECT count(DISTINCT canonical) FROM life WHERE event <> 'migration_target' OR delisted_at IS NOT NULL)
  UNION ALL SELECT 'delisting_suspect', 'warning', (SELECT count(*) FROM cover WHERE last_seen < (SELECT max(ts) FROM clean) - INTERVAL 7 DAY)
  UNION ALL SELECT 'unequal_coverage', 'warning', (SELECT (max(periods) <> min(periods))::INT FROM cover)
  UNION ALL SELECT 'bad_price', 'error', (SELECT count(*) FROM clean WHERE price IS NULL OR price <= 0)
  UNION ALL SELECT 'bad_signal', 'error', (SELECT count(*) FROM clean WHERE signal IS NULL)
  UNION ALL SELECT 'infinite_funding', 'error', 0
  UNION ALL SELECT 'active_funding_gap', 'warning', (SELECT count(*) FROM fgaps WHERE reason = 'active')
  UNION ALL SELECT 'expected_funding_gap', 'warning', (SELECT count(*) FROM fgaps WHERE reason <> 'active'))
SELECT rule, CASE WHEN n > 0 THEN severity ELSE 'ok' END AS severity, n::BIGINT AS n FROM r""")
def preflight_rules(spark, folder):
    rows = materialise(raw_feed(spark, folder, "day"))
    return Q.preflight_rules(rows, migrations(spark), min_assets=30, require_funding=True)


_FINDINGS = """
f AS (
  SELECT 'duplicate_raw_key' AS rule, asset, ts, 0 AS steps FROM feed GROUP BY ts, asset HAVING count(*) > 1
  UNION ALL SELECT 'collision', asset, ts, 0 FROM canon GROUP BY ts, asset HAVING count(DISTINCT source_asset) > 1
  UNION ALL SELECT 'discontinuity', asset, ts, 0 FROM jumped WHERE k = 1 AND abs(jump) > 0.2
  UNION ALL SELECT CASE WHEN halt THEN 'halt_steps' WHEN gap_steps <= 1 THEN 'tolerated_gap_steps' ELSE 'large_gap_steps' END, asset, gap_start, gap_steps FROM blocks
  UNION ALL SELECT DISTINCT 'inferred_listing', canonical, NULL::TIMESTAMP, 0 FROM life WHERE event <> 'migration_target' OR delisted_at IS NOT NULL
  UNION ALL SELECT 'delisting_suspect', asset, last_seen, 0 FROM cover WHERE last_seen < (SELECT max(ts) FROM clean) - INTERVAL 7 DAY
  UNION ALL SELECT CASE WHEN reason = 'active' THEN 'active_funding_gap' ELSE 'expected_funding_gap' END, asset, ts, 0 FROM fgaps)
"""
_JUMPED = """
jumped AS (SELECT asset, ts, price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS jump,
  row_number() OVER (PARTITION BY asset, source_asset ORDER BY ts) AS k FROM clean),"""


def day_findings(spark, folder):
    return Q.preflight_findings(materialise(raw_feed(spark, folder, "day")), migrations(spark))


@register("preflight_findings", _PREFLIGHT + _JUMPED + _FINDINGS + f"SELECT rule, asset, {q_day('ts')} AS bar, steps::BIGINT AS steps FROM f")
def preflight_findings(spark, folder):
    return day_findings(spark, folder).select("rule", "asset", day(), "steps")


@register("preflight_samples", _PREFLIGHT + _JUMPED + _FINDINGS + f"""
SELECT rule, place::INT AS place, asset, {q_day('ts')} AS bar, steps::BIGINT AS steps FROM (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY asset, ts NULLS LAST, steps) AS place FROM f) WHERE place <= 10""")
def preflight_samples(spark, folder):
    return Q.finding_samples(day_findings(spark, folder)).select("rule", "place", "asset", day(), "steps")


@register("dq_report", with_(MARKET_DAY, MIGRATION_DIM, _MISSING, _MANIFEST, _EARLY, _INSIDE) + """
SELECT count(*) FILTER (reason = 'migration_halt')::BIGINT AS halt_count, count(*) FILTER (reason <> 'migration_halt')::BIGINT AS halt_unexplained_count,
  count(*) FILTER (reason <> 'migration_halt' AND gap_steps <= 1)::BIGINT AS halt_tolerated_count,
  coalesce(sum(gap_steps) FILTER (reason = 'migration_halt'),0)::BIGINT AS migration_halt_steps,
  coalesce(sum(gap_steps) FILTER (reason <> 'migration_halt'),0)::BIGINT AS unexplained_interior_steps,
  (SELECT count(DISTINCT asset) FROM panel)::BIGINT AS universe_size, (SELECT count(DISTINCT ts) FROM panel)::BIGINT AS lookback_periods,
  (SELECT floor(sum(days) FILTER (dead)) FROM miss)::BIGINT AS dead_asset_days, (SELECT count(DISTINCT symbol) FROM miss WHERE dead)::BIGINT AS dead_asset_count,
  CASE WHEN count(*) FILTER (reason <> 'migration_halt') > 0 THEN 'FLAG_REVIEW' ELSE 'OK' END AS status FROM blocks""")
def dq_report(spark, folder):
    panel, dim = materialise(day_market(spark, folder)), migrations(spark)
    kept = panel.where("asset <> 'BRAND20USDT' and asset <> 'ETHUSDT'")
    row = Q.survivorship(kept, manifest(spark, panel), dim)[0]
    report = Q.quality_report(panel, Q.gap_blocks(panel, dim), row)
    return report.select(*[count(c) for c in report.columns if c != "status"], "status")


@register("spread_bps", """WITH book AS (SELECT 'SUPP'||l_suppkey||'USDT' AS symbol, min(l_extendedprice/l_quantity) AS bid, avg(l_extendedprice/l_quantity) AS ask,
  max(l_suppkey) AS k FROM lineitem GROUP BY 1)
SELECT symbol AS asset, """ + f"""{q_round('(ask-bid)/((ask+bid)/2)*10000', 4)} AS spread_bps FROM book WHERE k % 3 <> 0 AND bid > 0 AND ask >= bid""")
def spread_bps(spark, folder):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    tickers = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.min(unit).alias("bid"), F.avg(unit).alias("ask")).withColumn(
        "symbol", F.concat(F.lit("SUPP"), F.col("l_suppkey").cast("string"), F.lit("USDT")))
    wanted = table(spark, folder, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("supp"), F.col("s_suppkey").cast("string"), F.lit("usdt")).alias("symbol"))
    return Q.spread_bps(tickers, wanted).select("asset", rounded("spread_bps", 4))
