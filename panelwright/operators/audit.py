"""Data-quality and lifecycle audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import EXPECTED_FUNDING_REASONS, MIGRATION_WINDOW_DAYS
from ..functions.intervals import interval_join
from ..functions.symbols import base_token, with_canonical
from ..functions.windows import per_asset
from ..session import materialise

DAY = 86400
#: An asset that stops this many steps before the panel ends is a suspect.
SUSPECT_STEPS = 7.0


def days(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * DAY))


def _effective_by_canonical(migrations: DataFrame) -> DataFrame:
    """(base, instants): one row per asset, however many tickers moved into it."""
    return migrations.where("effective is not null").groupBy(F.col("canonical").alias("base")).agg(F.collect_set("effective").alias("instants"))


def _any_instant(test) -> Column:
    """Whether one of an asset's migrations passes; false where it has none."""
    return F.coalesce(F.exists("instants", test), F.lit(False))


# --- calendar gaps ---------------------------------------------------------------------------

def gap_blocks(df: DataFrame, migrations: DataFrame, step_seconds: int = DAY, adjacency_days: int = MIGRATION_WINDOW_DAYS) -> DataFrame:
    """Blocks of missing grid points between an asset's first and last bar, with their reason.

    Grid points are numbered from the asset's first bar, so the missing ones between two bars follow
    from arithmetic; no calendar is generated, and the result grows with the gaps only. A block goes
    on across a bar that lies off the grid.
    """
    w = Window.partitionBy("asset").orderBy("timestamp")
    micros = F.unix_micros("timestamp")
    step = step_seconds * 1_000_000
    stamped = df.select("asset", "timestamp").distinct().withColumns({
        "offset": micros - F.min(micros).over(Window.partitionBy("asset")),
        "first_bar": F.min("timestamp").over(Window.partitionBy("asset")),
    }).withColumn("next_offset", F.lead("offset").over(w))
    low = F.floor(F.col("offset") / step) + 1
    high = F.ceil(F.col("next_offset") / step) - 1
    holes = stamped.withColumns({"low": low, "high": high}).where("high >= low")
    joined = F.coalesce(F.lag("high").over(w) + 1 < F.col("low"), F.lit(True)).cast("int")
    blocks = (
        holes.withColumn("new_block", joined)
        .withColumn("block", F.sum("new_block").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("asset", "first_bar", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )

    def at(position):
        return F.timestamp_micros(F.unix_micros("first_bar") + F.col(position) * step)

    dated = blocks.select(
        "asset", at("low").alias("gap_start"), at("high").alias("gap_end"),
        (F.col("high") - F.col("low") + 1).alias("gap_steps"))
    near = _any_instant(lambda at: (at >= F.col("gap_start") - days(adjacency_days)) & (at <= F.col("gap_end") + days(adjacency_days)))
    return (
        dated.withColumn("base", base_token(F.col("asset"))).join(_effective_by_canonical(migrations), "base", "left")
        .withColumn("reason", F.when(near, "migration_halt").otherwise("unexplained_interior"))
        .drop("base", "instants")
    )


def calendar_gaps(blocks: DataFrame, step_seconds: int = DAY) -> DataFrame:
    """Every missing grid point of the blocks."""
    return blocks.select("asset", F.explode(F.sequence("gap_start", "gap_end", F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(float(step_seconds))))).alias("timestamp"))


def gap_summary(df: DataFrame, blocks: DataFrame, migrations: DataFrame, window_days: int = MIGRATION_WINDOW_DAYS, step_seconds: int = DAY) -> DataFrame:
    """Per asset: rows, span, missing points, and how many lie near a migration.

    No point is listed: each migration covers a range of a block's grid, and a sweep over the ranges counts their union.
    """
    known = blocks.withColumn("base", base_token(F.col("asset"))).join(_effective_by_canonical(migrations), "base", "left")
    step, reach = step_seconds * 1_000_000, window_days * DAY * 1_000_000
    start = F.unix_micros("gap_start")
    known = known.withColumn("last", F.floor((F.unix_micros("gap_end") - start) / step))

    def covered(at):
        low, high = F.ceil((F.unix_micros(at) - reach - start) / step), F.floor((F.unix_micros(at) + reach - start) / step)
        return F.struct(F.greatest(low, F.lit(0)).alias("low"), F.least(high, F.col("last")).alias("high"))

    def sweep(state, part):
        fresh = F.greatest(part["high"] - F.greatest(part["low"] - 1, state["seen"]), F.lit(0))
        return F.struct(F.greatest(state["seen"], part["high"]).alias("seen"), (state["points"] + fresh).alias("points"))

    nothing = F.struct(F.lit(-1).cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("points"))
    near = F.aggregate(F.array_sort(F.transform("instants", covered)), nothing, sweep, lambda state: state["points"])
    counted = known.groupBy("asset").agg(F.sum(F.col("last") + 1).alias("missing"), F.sum(F.coalesce(near, F.lit(0))).cast("bigint").alias("near_migration"))
    span = df.groupBy("asset").agg(
        F.count_distinct("timestamp").alias("bars"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return span.join(counted, "asset").withColumn("interior", F.col("missing") - F.col("near_migration"))


# --- funding ---------------------------------------------------------------------------------

def funding_gaps(df: DataFrame, migrations: DataFrame) -> DataFrame:
    """Every row without funding and why: near a migration, not yet or no longer listed, or active.

    Runs on raw rows under canonical names, before duplicates are collapsed. A panel without a funding
    column has no gaps.
    """
    if "funding_rate" not in df.columns:
        return df.where(F.lit(False)).select("timestamp", "asset", F.lit("").alias("reason"))
    rows = with_canonical(df, migrations, "asset", "canonical").withColumn("base", base_token(F.col("canonical")))
    seen = rows.where("funding_rate is not null").groupBy("canonical").agg(
        F.min("timestamp").alias("first_print"), F.max("timestamp").alias("last_print"))
    any_print = seen.agg((F.count(F.lit(1)) > 0).alias("any_print"))
    volumes = [F.col(c) for c in ("volume", "quote_volume") if c in df.columns]
    traded = F.coalesce(F.coalesce(*volumes) > 0, F.lit(False)) if volumes else F.lit(True)
    priced = F.coalesce(F.col("price") > 0, F.lit(False))
    ts = F.col("timestamp")
    near = _any_instant(lambda at: F.abs(F.unix_micros("timestamp") - F.unix_micros(at)) <= MIGRATION_WINDOW_DAYS * DAY * 1_000_000)
    by_price = F.when(priced, "active").otherwise("delisted")
    reason = (
        F.when(ts.isNull(), by_price).when(near, "migration").when(~F.col("any_print"), by_price)
        .when(F.col("first_print").isNull() | (ts < F.col("first_print")), "not_listed")
        .when((ts > F.col("last_print")) | ~priced | ~traded, "delisted").otherwise("active")
    )
    return (
        rows.where("funding_rate is null").join(seen, "canonical", "left")
        .join(_effective_by_canonical(migrations), "base", "left").join(any_print, F.lit(True))
        .select("timestamp", F.col("canonical").alias("asset"), reason.alias("reason"))
    )


def split_funding_gaps(gaps: DataFrame) -> DataFrame:
    """Mark gaps that need no investigation."""
    return gaps.withColumn("expected", F.col("reason").isin(*EXPECTED_FUNDING_REASONS))


def daily_funding(prints: DataFrame) -> DataFrame:
    return prints.groupBy(F.date_trunc("day", "timestamp").alias("date"), "asset").agg(
        F.sum("funding_rate").alias("funding_rate"), F.count(F.lit(1)).alias("prints"))


def join_funding(panel: DataFrame, prints: DataFrame, daily: bool = True) -> DataFrame:
    """Attach funding: daily sums by calendar day, or exact prints for shorter bars."""
    panel = panel.drop("funding_rate")
    if daily:
        sums = daily_funding(prints).drop("prints")
        return panel.withColumn("date", F.date_trunc("day", "timestamp")).join(sums, ["date", "asset"], "left").drop("date")
    return panel.join(prints.select("timestamp", "asset", "funding_rate"), ["timestamp", "asset"], "left")


def funding_frequency(prints: DataFrame) -> DataFrame:
    """Most prints on one day, and the day with the largest absolute daily rate (the first on ties)."""
    daily = daily_funding(prints)
    size = F.struct(F.abs("funding_rate").alias("size"), (-F.unix_micros("date")).alias("early"))
    known = F.col("funding_rate").isNotNull()
    return daily.groupBy("asset").agg(
        F.max("prints").alias("max_settlements_per_day"),
        F.max_by("date", F.when(known, size)).alias("max_abs_daily_rate_date"),
        F.max_by("funding_rate", F.when(known, size)).alias("max_abs_daily_rate"))


def funding_conflicts(prints: DataFrame) -> DataFrame:
    """Keys whose prints disagree once exact copies are dropped."""
    return (
        prints.groupBy("timestamp", "asset").agg(
            F.count_distinct(F.coalesce("funding_rate", F.lit(float("inf")))).alias("rates"), F.count(F.lit(1)).alias("prints"))
        .where("rates > 1")
    )


def cutover_split(prints: DataFrame, migrations: DataFrame) -> DataFrame:
    """Where several tickers feed one asset, old-ticker rows count only before the migration day and
    new-ticker rows only from it on. ``kept`` marks the rows that stay."""
    # A ticker that is listed with several days moves on the last of them.
    moves = migrations.groupBy("source", "canonical").agg(F.max("effective").alias("effective"))
    rows = with_canonical(prints, moves, "source", "asset")
    feeds = rows.groupBy("asset").agg((F.min("source") != F.max("source")).alias("several"))
    # One row per asset: the days its old tickers move, and the last of them, from which on the new ticker counts.
    old = moves.where("effective is not null").select("source", F.col("canonical").alias("base"), F.date_trunc("day", "effective").alias("cut"))
    old = old.groupBy("base").agg(F.map_from_entries(F.collect_set(F.struct("source", "cut"))).alias("cuts"), F.max("cut").alias("last_cut"))
    dated = rows.withColumns({"base": base_token(F.col("asset")), "source_base": base_token(F.col("source"))}).join(feeds, "asset").join(old, "base", "left")
    own, day = F.try_element_at("cuts", F.col("source_base")), F.date_trunc("day", "timestamp")
    kept = ~F.col("several") | F.col("last_cut").isNull() | F.when(own.isNotNull(), day < own).otherwise(day >= F.col("last_cut"))
    return dated.withColumn("kept", kept).drop("base", "source_base", "cuts", "last_cut", "several")


def funding_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("asset").agg(F.count("funding_rate").alias("have"), F.count(F.lit(1)).alias("rows"))


# --- symbol identity -------------------------------------------------------------------------

def collisions(df: DataFrame) -> DataFrame:
    """Keys fed by more than one source ticker. An asset has a handful of tickers, so the list is short."""
    return (
        df.groupBy("timestamp", "asset").agg(F.array_sort(F.collect_set("source_asset")).alias("sources"))
        .where(F.size("sources") > 1).select("timestamp", "asset", F.array_join("sources", ",").alias("source_assets"))
    )


def discontinuities(df: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """Price jumps above ``tolerance`` where a new source ticker first appears in an asset."""
    w = per_asset()
    starts = F.row_number().over(Window.partitionBy("asset", "source_asset").orderBy("timestamp")) == 1
    return (
        df.withColumns({"starts": starts, "previous": F.lag("price").over(w)})
        .withColumn("price_jump", F.try_divide("price", "previous") - 1)
        .where(F.col("starts") & (F.abs("price_jump") > tolerance))
        .select("asset", "source_asset", "timestamp", "price_jump")
    )


# --- lifecycle -------------------------------------------------------------------------------

def lifecycle(df: DataFrame, migrations: DataFrame, buffer_days: int = 7) -> DataFrame:
    """Tradable segments per (canonical, symbol): official bounds from migrations, others inferred."""
    rows = with_canonical(df.withColumn("symbol", F.upper("source_asset")), migrations, "symbol", "canonical")
    w = Window.partitionBy("canonical", "symbol").orderBy("timestamp")
    steps = rows.select("canonical", "symbol", "timestamp").distinct().withColumn(
        "step", (F.unix_micros(F.lead("timestamp").over(w)) - F.unix_micros("timestamp")) / 1e6)
    seen = steps.groupBy("canonical", "symbol").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.median("step").alias("step"))
    end = df.agg(F.max("timestamp").alias("data_end"))
    out_of = migrations.where("effective is not null").select(F.col("source").alias("base"), F.col("effective").alias("left_at"))
    into = migrations.groupBy(F.col("canonical").alias("base")).agg(F.min("effective").alias("joined_at"), F.lit(True).alias("is_target"))
    s = (
        seen.join(end, F.lit(True)).withColumn("base", base_token(F.col("symbol")))
        .join(out_of, "base", "left").join(into, "base", "left")
    )
    source, target = F.col("left_at").isNotNull(), F.coalesce("is_target", F.lit(False))
    over = F.col("last_seen") < F.col("data_end") - days(buffer_days)
    official = target & F.col("joined_at").isNotNull()
    step = F.coalesce(F.when(F.col("step") > 0, F.col("step")), F.lit(float(DAY)))
    after_last = F.timestamp_micros(F.unix_micros("last_seen") + (step * 1e6).cast("bigint"))
    listed_source = F.when(official, "official").otherwise("inferred_from_data")
    return s.select(
        "canonical", "symbol",
        F.when(official & ~source, F.col("joined_at")).otherwise(F.col("first_seen")).alias("listed_at"),
        F.when(source, F.col("left_at")).when(over, after_last).alias("delisted_at"),
        F.when(source, "migration_source").when(target, "migration_target").when(over, "delisting").otherwise("active").alias("event"),
        F.when(source, F.lit("delisted:official;listed:inferred_from_data"))
        .when(over, F.concat(F.lit("listed:"), listed_source, F.lit(";delisted:inferred_from_data")))
        .otherwise(F.concat(F.lit("listed:"), listed_source, F.lit(";delisted:still_tradable"))).alias("source"))


def manifest_segments(manifest: DataFrame, migrations: DataFrame) -> DataFrame:
    """A listing manifest (symbol, listed_at, delisted_at, source) as lifecycle segments."""
    alive = F.col("delisted_at").isNull()
    return with_canonical(manifest.withColumn("symbol", F.upper("symbol")), migrations, "symbol", "canonical").select(
        "canonical", "symbol", "listed_at", "delisted_at",
        F.when(alive, "active").otherwise("delisting").alias("event"),
        F.concat(F.lit("listing_manifest:"), F.coalesce("source", F.lit("unknown"))).alias("source"))


def active_assets(segments: DataFrame, instants: DataFrame) -> DataFrame:
    """Assets tradable at each instant: listed at or before it, not yet delisted."""
    return interval_join(instants, segments, "instant", "listed_at", "delisted_at").select("instant", "canonical").distinct()


def universe_audit(df: DataFrame, segments: DataFrame, migrations: DataFrame) -> DataFrame:
    """Rows outside the tradable segments of their symbol, or of their asset if the symbol has none.

    Segments per asset are few; they are folded into one short list per asset, so that every row
    meets its segments in one equi-join and none is multiplied.
    """
    lists = segments.groupBy("canonical").agg(F.collect_list(F.struct(F.upper("symbol").alias("symbol"), "listed_at", "delisted_at")).alias("segments"))
    rows = with_canonical(df.withColumn("symbol", F.upper("source_asset")), migrations, "symbol", "canonical").join(lists, "canonical", "left")
    own = F.filter("segments", lambda s: s["symbol"] == F.col("symbol"))
    pool = F.when(F.size(own) > 0, own).otherwise(F.col("segments"))
    ts = F.col("timestamp")
    live = F.exists("pool", lambda s: (s["listed_at"] <= ts) & (s["delisted_at"].isNull() | (ts < s["delisted_at"])))
    early = F.exists("pool", lambda s: s["listed_at"] > ts)
    reason = F.when(F.col("segments").isNull(), "no_lifecycle_segment").when(live, None).when(early, "trading_before_listing").otherwise("trading_after_delisting")
    return rows.withColumn("pool", pool).withColumn("reason", reason).where("reason is not null").select("timestamp", "asset", "reason")


def survivorship(df: DataFrame, manifest: DataFrame, migrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest symbols tradable inside the data window but absent from it: one summary row, and the
    missing symbols with their days of overlap."""
    window = df.agg(F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"))
    have = with_canonical(df.select("asset").distinct(), migrations, "asset", "canonical").select("canonical").distinct()
    overlap = (F.col("listed_at") <= F.col("window_end")) & (F.col("delisted_at").isNull() | (F.col("delisted_at") >= F.col("window_start")))
    inside = with_canonical(manifest.withColumn("symbol", F.upper("symbol")), migrations, "symbol", "canonical").join(window, overlap)
    marked = inside.join(have.withColumn("present", F.lit(True)), "canonical", "left")
    dead = F.col("delisted_at").isNotNull()
    seconds = F.unix_micros(F.least("delisted_at", "window_end")) - F.unix_micros(F.greatest("listed_at", "window_start"))
    missing = marked.where("present is null").select(
        "canonical", "symbol", dead.alias("dead"), F.when(dead, F.greatest(seconds / (DAY * 1e6), F.lit(0.0)) + 1).alias("overlap_days"))
    absent = F.col("present").isNull()
    totals = marked.agg(
        F.count_distinct("canonical").alias("n_manifest_in_window"),
        F.count_distinct(F.when(~absent, F.col("canonical"))).alias("covered"),
        F.count_distinct(F.when(absent & dead, F.col("canonical"))).alias("n_missing_dead"),
        F.count_distinct(F.when(absent & ~dead, F.col("canonical"))).alias("n_missing_alive"),
        F.coalesce(F.floor(F.sum(F.when(absent & dead, F.greatest(seconds / (DAY * 1e6), F.lit(0.0)) + 1))), F.lit(0)).alias("missing_dead_asset_days"))
    summary = totals.join(have.agg(F.count(F.lit(1)).alias("n_dataset")), F.lit(True)).withColumn(
        "coverage_ratio", F.col("covered") / F.greatest(F.col("n_manifest_in_window"), F.lit(1))).drop("covered")
    return summary, missing


def listing_manifest(files: DataFrame, live: DataFrame) -> DataFrame:
    """First and last published file per symbol; symbols still live have no delisting date."""
    seen = files.groupBy("symbol").agg(F.min("file_date").alias("listed_at"), F.max("file_date").alias("last_file"))
    marked = seen.join(live.select("symbol", F.lit(True).alias("live")), "symbol", "left")
    alive = F.col("live").isNotNull()
    return marked.select(
        "symbol", "listed_at", F.when(~alive, F.col("last_file")).alias("delisted_at"),
        F.when(alive, "TRADING").otherwise("NOT_TRADING").alias("status"),
        F.lit("inferred_first_seen;live_list").alias("source"))


# --- reports ---------------------------------------------------------------------------------

def signal_audit(df: DataFrame, signal: str = "signal") -> DataFrame:
    """Per asset: distinct values, spread, range, unchanged steps, and whether the signal fails."""
    change = F.col(signal) - F.lag(signal).over(per_asset())
    stats = df.withColumn("change", change).groupBy("asset").agg(
        F.count(signal).alias("rows"), F.count_distinct(signal).alias("unique_signal"), F.stddev_samp(signal).alias("signal_std"),
        F.min(signal).alias("signal_min"), F.max(signal).alias("signal_max"),
        F.count_if(F.col("change") == 0).alias("zero_changes"), F.count_if(F.col("change") == 0).alias("forward_fill_rows"),
        F.coalesce(F.max(F.abs(signal)) > 10, F.lit(False)).alias("cumulative"))
    return stats.withColumn("failed", (F.col("unique_signal") <= 1) | (F.col("forward_fill_rows") > 0) | F.col("cumulative"))


def preflight_rules(df: DataFrame, migrations: DataFrame, manifest: DataFrame | None = None, *, min_assets: int = 2,
                    min_periods: int = 2, step_seconds: int = DAY, tolerated_gap_steps: int = 1, allow_gaps: bool = False,
                    require_funding: bool = False, require_liquidity: bool = False) -> DataFrame:
    """Every preflight rule with its severity (error, warning or ok) and how often it fires.

    ``df`` is raw rows with ``ingest_seq``. The panel is valid when no row says error.
    """
    from .panel import asset_coverage, canonical_assets, canonical_panel, panel_violations

    spark = df.sparkSession
    named = canonical_assets(df, migrations)
    panel = materialise(canonical_panel(df, migrations))  # every rule below reads it

    def rule(name, severity, frame, measure=F.count(F.lit(1))):
        return frame.agg(F.coalesce(measure, F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "n")

    raw_copies = df.groupBy("timestamp", F.upper("asset").alias("asset")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    blocks = materialise(gap_blocks(panel, migrations, step_seconds))
    gaps = funding_gaps(df, migrations)
    segments = lifecycle(panel, migrations)
    coverage = asset_coverage(panel, SUSPECT_STEPS * step_seconds / DAY)
    steps = F.sum("gap_steps")
    unexplained = blocks.where("reason = 'unexplained_interior'")
    parts = [
        rule("duplicate_raw_key", "error", raw_copies),
        rule("collision", "error", collisions(named)),
        rule("discontinuity", "error", discontinuities(panel)),
        rule("too_few_assets", "error", panel.agg(F.count_distinct("asset").alias("k")).where(F.col("k") < min_assets)),
        rule("too_few_periods", "error", panel.agg(F.count_distinct("timestamp").alias("k")).where(F.col("k") < min_periods)),
        rule("large_gap_steps", "warning" if allow_gaps else "error", unexplained.where(F.col("gap_steps") > tolerated_gap_steps), steps),
        rule("tolerated_gap_steps", "warning", unexplained.where(F.col("gap_steps") <= tolerated_gap_steps), steps),
        rule("halt_steps", "warning", blocks.where("reason = 'migration_halt'"), steps),
        rule("inferred_listing", "warning", segments.where(F.col("source").contains("inferred_from_data")), F.count_distinct("canonical")),
        rule("delisting_suspect", "warning", coverage.where("suspect")),
        rule("unequal_coverage", "warning", coverage.agg((F.max("periods") != F.min("periods")).alias("k")).where("k")),
    ]
    invalid = panel_violations(panel).where("rule <> 'duplicate_key'").select(
        "rule", F.lit("error").alias("severity"), F.col("violations").cast("bigint").alias("n"))
    parts.append(invalid)
    if require_funding:
        parts += [rule("active_funding_gap", "warning", gaps.where("reason = 'active'")),
                  rule("expected_funding_gap", "warning", gaps.where("reason <> 'active'"))]
    if require_liquidity and "quote_volume" not in df.columns:
        parts.append(spark.range(1).select(F.lit("no_liquidity").alias("rule"), F.lit("error").alias("severity"), F.lit(1).cast("bigint").alias("n")))
    if manifest is not None:
        missing = survivorship(panel, manifest, migrations)[1]
        parts.append(rule("missing_dead", "warning", missing.where("dead"), F.count_distinct("canonical")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("severity", F.when(F.col("n") > 0, F.col("severity")).otherwise("ok"))


def preflight_findings(df: DataFrame, migrations: DataFrame, manifest: DataFrame | None = None, *, step_seconds: int = DAY, tolerated_gap_steps: int = 1) -> DataFrame:
    """What the preflight rules count, in full: (rule, asset, timestamp, steps).

    ``timestamp`` is the first missing bar of a gap and the last bar of a suspect; it is null where a whole asset is
    meant. ``steps`` is the length of a gap, else 0. Rules on the size of a panel name no rows and have no finding here.
    """
    from .panel import asset_coverage, canonical_assets, canonical_panel

    panel = materialise(canonical_panel(df, migrations))

    def found(rule, frame, asset="asset", at=F.col("timestamp"), steps=F.lit(0)):
        rule = rule if isinstance(rule, Column) else F.lit(rule)
        return frame.select(rule.alias("rule"), F.col(asset).alias("asset"), at.cast("timestamp").alias("timestamp"), steps.cast("bigint").alias("steps"))

    copies = df.groupBy("timestamp", F.upper("asset").alias("asset")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    tolerated = F.col("gap_steps") <= tolerated_gap_steps
    gap_rule = F.when(F.col("reason") == "migration_halt", "halt_steps").when(tolerated, "tolerated_gap_steps").otherwise("large_gap_steps")
    inferred = lifecycle(panel, migrations).where(F.col("source").contains("inferred_from_data")).select("canonical").distinct()
    funding_rule = F.when(F.col("reason") == "active", "active_funding_gap").otherwise("expected_funding_gap")
    parts = [
        found("duplicate_raw_key", copies), found("collision", collisions(canonical_assets(df, migrations))), found("discontinuity", discontinuities(panel)),
        found(gap_rule, gap_blocks(panel, migrations, step_seconds), at=F.col("gap_start"), steps=F.col("gap_steps")),
        found("inferred_listing", inferred, "canonical", F.lit(None)),
        found("delisting_suspect", asset_coverage(panel, SUSPECT_STEPS * step_seconds / DAY).where("suspect"), at=F.col("last_seen")),
        found(funding_rule, funding_gaps(df, migrations)),
    ]
    if manifest is not None:
        missing = survivorship(panel, manifest, migrations)[1].where("dead").select("canonical").distinct()
        parts.append(found("missing_dead", missing, "canonical", F.lit(None)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def finding_samples(findings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` findings of each rule by asset and time; Spark limits them before the shuffle."""
    order = Window.partitionBy("rule").orderBy("asset", F.col("timestamp").asc_nulls_last(), "steps")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def quality_report(panel: DataFrame, blocks: DataFrame, survivorship_row: DataFrame, tolerated: int = 1, max_unexplained: int = 0) -> DataFrame:
    """Halts, unexplained and tolerated blocks, and dead-asset exposure in explicit units."""
    unexplained = F.col("reason") == "unexplained_interior"
    counts = blocks.agg(
        F.count_if(~unexplained).alias("halt_count"), F.count_if(unexplained).alias("halt_unexplained_count"),
        F.count_if(unexplained & (F.col("gap_steps") <= tolerated)).alias("halt_tolerated_count"),
        F.coalesce(F.sum(F.when(~unexplained, F.col("gap_steps"))), F.lit(0)).alias("migration_halt_steps"),
        F.coalesce(F.sum(F.when(unexplained, F.col("gap_steps"))), F.lit(0)).alias("unexplained_interior_steps"))
    size = panel.agg(F.count_distinct("asset").alias("universe_size"), F.count_distinct("timestamp").alias("lookback_periods"))
    return (
        counts.join(size, F.lit(True))
        .join(survivorship_row.select(F.col("missing_dead_asset_days").alias("dead_asset_days"), F.col("n_missing_dead").alias("dead_asset_count")), F.lit(True))
        .withColumn("status", F.when(F.col("halt_unexplained_count") > max_unexplained, "FLAG_REVIEW").otherwise("OK"))
    )


def spread_bps(tickers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Quoted spread of wanted symbols in basis points of the middle; crossed or empty books drop out."""
    mid = (F.col("bid") + F.col("ask")) / 2
    return (
        tickers.withColumn("asset", F.upper("symbol")).where("bid > 0 and ask > 0 and ask >= bid")
        .join(wanted.select(F.upper("symbol").alias("asset")).distinct(), "asset", "left_semi")
        .select("asset", "bid", "ask", mid.alias("mid"), ((F.col("ask") - F.col("bid")) / mid * 1e4).alias("spread_bps"))
    )
