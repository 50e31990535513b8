"""Panel normalisation: canonical symbols, price adjustment, duplicate collapse and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import clean, ratio
from ..functions.symbols import base_token, with_canonical
from ..functions.windows import simple_return

NUMERIC = ("open", "high", "low", "price", "volume", "quote_volume")


def ingest(df: DataFrame) -> DataFrame:
    """UTC instants, doubles, and NULL instead of NaN or infinity; infinite funding stays, for the rules to refuse."""
    numbers = {c: clean(c) for c in (*NUMERIC, "signal") if c in df.columns}
    if "funding_rate" in df.columns:
        numbers["funding_rate"] = F.nanvl(F.col("funding_rate").cast("double"), F.lit(None).cast("double"))
    return df.withColumns({"timestamp": F.col("timestamp").cast("timestamp"), **numbers})


def canonical_assets(df: DataFrame, migrations: DataFrame) -> DataFrame:
    """Keep the quoted symbol as ``source_asset`` and name the row by its canonical symbol."""
    return with_canonical(df.withColumn("source_asset", F.upper("asset")), migrations, "source_asset", "asset")


def adjust_prices(df: DataFrame, migrations: DataFrame) -> DataFrame:
    """Divide prices quoted on the old ticker's scale before its migration by the official factor."""
    dim = migrations.where("factor is not null and effective is not null").select(
        F.col("source").alias("base"), "factor", "effective")
    hit = F.col("timestamp") < F.col("effective")
    factor = F.when(hit, F.col("factor")).otherwise(F.lit(1.0))
    return (
        df.withColumn("base", base_token(F.col("source_asset"))).join(dim, "base", "left")
        .withColumn("price_adjustment_factor", factor)
        .withColumn("price", F.col("price") / F.col("price_adjustment_factor"))
        .drop("base", "factor", "effective")
    )


def collapse_duplicates(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row per (timestamp, asset): the last non-null value of each number, the sum of funding.

    Missing funding counts as zero in the sum, once any key of the panel is duplicated.
    """
    def last(column):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column)

    plain = [c for c in df.columns if c not in ("timestamp", "asset", order, "funding_rate")]
    funding = "funding_rate" in df.columns
    grouped = df.groupBy("timestamp", "asset").agg(
        *[last(c) for c in plain], *([F.sum("funding_rate").alias("funding_rate")] if funding else []),
        F.count(F.lit(1)).alias("copies"))
    if funding:
        any_copies = grouped.agg((F.max("copies") > 1).alias("collapsed"))
        grouped = grouped.join(any_copies, F.lit(True)).withColumn(
            "funding_rate", F.when(F.col("collapsed"), F.coalesce("funding_rate", F.lit(0.0))).otherwise(F.col("funding_rate"))
        ).drop("collapsed")
    return grouped.drop("copies")


def canonical_panel(df: DataFrame, migrations: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Canonical, adjusted, duplicate-free panel with returns; ``signal`` defaults to the return."""
    panel = collapse_duplicates(adjust_prices(canonical_assets(df, migrations), migrations), order)
    panel = panel.withColumn("asset_return", simple_return())
    return panel if "signal" in panel.columns else panel.withColumn("signal", F.col("asset_return"))


def panel_violations(df: DataFrame, signal: str = "signal") -> DataFrame:
    """Rows breaking each validity rule, from one pass over the rows and one over the keys."""
    funding = F.col("funding_rate") if "funding_rate" in df.columns else F.lit(None).cast("double")

    def infinite(c):
        return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))

    price, sig = F.col("price"), F.col(signal)
    rules = {
        "bad_price": F.count_if(price.isNull() | (price <= 0) | infinite(price)),
        "bad_signal": F.count_if(sig.isNull() | infinite(sig)),
        "infinite_funding": F.count_if(funding.isNotNull() & infinite(funding)),
    }
    counts = df.agg(*[v.alias(k) for k, v in rules.items()]).unpivot([], list(rules), "rule", "violations")
    copies = df.groupBy("timestamp", "asset").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(
        F.lit("duplicate_key").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return counts.unionByName(copies)


def relabel_history(df: DataFrame, cutovers: DataFrame) -> DataFrame:
    """Rows of a target ticker before its cutover get the source ticker back.

    ``cutovers``: (target, source, cutover). ``relabelled`` marks the changed rows.
    """
    dim = cutovers.select(F.upper("target").alias("target"), F.upper("source").alias("restored"), "cutover")
    hit = F.coalesce(F.col("timestamp") < F.col("cutover"), F.lit(False))
    return (
        df.join(dim, F.upper(df["asset"]) == dim["target"], "left")
        .withColumn("relabelled", hit)
        .withColumn("asset", F.when(hit, F.col("restored")).otherwise(F.col("asset")))
        .drop("target", "restored", "cutover")
    )


def drop_stale(df: DataFrame) -> DataFrame:
    """Keep rows with a trade behind them; without a volume column nothing is a trade."""
    return df.where(F.col("volume") > 0) if "volume" in df.columns else df.where(F.lit(False))


def stale_counts(df: DataFrame) -> DataFrame:
    traded = F.coalesce(F.col("volume") > 0, F.lit(False))
    return df.where(~traded).groupBy("asset").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("timestamp", "asset").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, sample: int = 20) -> DataFrame:
    """Refuse a panel that still has duplicate keys, naming at most ``sample`` of them."""
    found = duplicate_keys(df).limit(sample).collect()
    if found:
        raise ValueError(f"duplicate (timestamp, asset) keys remain: {[(str(r['timestamp']), r['asset'], r['copies']) for r in found]}")
    return df


def repair_panel(df: DataFrame, cutovers: DataFrame, stale: bool = True) -> tuple[DataFrame, DataFrame]:
    """Relabel, then drop stale rows. Returns the panel and a one-row log from a single pass."""
    labelled = relabel_history(df, cutovers)
    traded = F.coalesce(F.col("volume") > 0, F.lit(False)) if "volume" in df.columns else F.lit(False)
    log = labelled.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if("relabelled").alias("relabelled_rows"),
        (F.count_if(~traded) if stale else F.lit(0).cast("bigint")).alias("stale_rows"),
    ).withColumn("output_rows", F.col("input_rows") - F.col("stale_rows"))
    repaired = labelled.drop("relabelled")
    return (drop_stale(repaired) if stale else repaired), log


def legacy_factor(df: DataFrame, migrations: DataFrame) -> DataFrame:
    """Rows under a canonical ticker with the calendar day and factor of the migration that lies next ahead of them.

    An asset that took in several tickers has one row of migrations, so no row of the panel is doubled.
    """
    dim = migrations.where("factor is not null and effective is not null").select(F.col("canonical").alias("base"), F.struct(F.date_trunc("day", "effective").alias("cutoff"), "factor").alias("move"))
    dim = dim.groupBy("base").agg(F.array_sort(F.collect_set("move")).alias("moves"))
    day = F.date_trunc("day", "timestamp")
    ahead = F.coalesce(F.try_element_at(F.filter("moves", lambda m: day < m["cutoff"]), F.lit(1)), F.try_element_at("moves", F.lit(-1)))
    rows = df.withColumn("base", base_token(F.col("asset"))).join(dim, "base", "left").withColumn("move", ahead)
    return rows.withColumns({"factor": F.col("move.factor"), "cutoff": F.col("move.cutoff")}).drop("base", "moves", "move")


def repair_klines(df: DataFrame, migrations: DataFrame) -> DataFrame:
    """Drop zero-volume rows, bring legacy prices to the new scale by calendar day, and drop columns
    derived from the old prices."""
    rows = legacy_factor(df.where("volume > 0"), migrations)
    legacy = F.date_trunc("day", "timestamp") < F.col("cutoff")
    scale = F.when(legacy, F.col("factor")).otherwise(F.lit(1.0))
    prices = [c for c in ("open", "high", "low", "price") if c in df.columns]
    return (
        rows.withColumn("scale", scale).withColumns({c: F.col(c) / F.col("scale") for c in prices})
        .drop("scale", "factor", "cutoff", "asset_return", "signal")
    )


def migration_seams(df: DataFrame, migrations: DataFrame) -> DataFrame:
    """Last price before and first price after each migration day, and the move between them."""
    dim = migrations.where("effective is not null").select(
        F.col("canonical").alias("base"), F.date_trunc("day", "effective").alias("cutoff"))
    legacy = F.date_trunc("day", "timestamp") < F.col("cutoff")
    stamp_old, stamp_new = F.when(legacy, F.col("timestamp")), F.when(~legacy, F.col("timestamp"))
    return (
        df.withColumn("base", base_token(F.col("asset"))).join(dim.distinct(), "base").groupBy("asset", "cutoff")
        .agg(F.max(stamp_old).alias("last_legacy"), F.min(stamp_new).alias("first_new"),
             F.max_by("price", stamp_old).alias("old_price"), F.min_by("price", stamp_new).alias("new_price"))
        .where("last_legacy is not null and first_new is not null")
        .withColumn("seam_return", ratio("new_price", "old_price") - 1).drop("cutoff")
    )


def without_broken_seams(df: DataFrame, seams: DataFrame, tolerance: float = 0.20) -> DataFrame:
    return df.join(seams.where(F.abs("seam_return") > tolerance).select("asset").distinct(), "asset", "left_anti")


def asset_coverage(df: DataFrame, suspect_days: float = 7.0) -> DataFrame:
    """First and last bar and bar count per asset; assets that stop early are forced-exit suspects."""
    per_asset = df.groupBy("asset").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_distinct("timestamp").alias("periods"))
    overall = df.agg(F.max("timestamp").alias("end"), F.count_distinct("timestamp").alias("all_periods"))
    return per_asset.join(overall, F.lit(True)).select(
        "asset", "first_seen", "last_seen", "periods",
        (F.col("last_seen") < F.col("end") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(suspect_days * 86400))).alias("suspect"),
        F.when(F.col("periods") == F.col("all_periods"), "active_full_period").otherwise("partial_history_or_delisted").alias("status"))


def membership(df: DataFrame) -> DataFrame:
    return df.groupBy("timestamp", "asset").agg(F.count(F.lit(1)).alias("rows"))
