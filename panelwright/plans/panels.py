"""Panels derived from the given tables. Each is one scan, one partial-then-final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import half_up
from ..functions.symbols import migration_table
from ..session import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _panel_measures():
    return [
        half_up(100 * (1 + F.avg("l_discount")), 8).alias("price"),
        F.sum("l_quantity").alias("volume"),
        half_up(F.sum("l_extendedprice"), 2).alias("quote_volume"),
        half_up((F.avg("l_tax") - 0.04) / 100, 10).alias("funding_rate"),
    ]


def brand_panel(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """Asset = part brand. Prices stay near 100, so returns are bounded.

    Lines meet parts in one join (AQE picks broadcast by measured size, or splits a hot part), and
    the aggregation combines on the map side, so a brand that owns a third of all lines is no slower.
    """
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    lines = table(spark, folder, "lineitem")
    return (
        lines.join(parts, "l_partkey")
        .groupBy(F.date_trunc(unit, F.col("l_shipdate").cast("timestamp")).alias("timestamp"), "asset")
        .agg(*_panel_measures())
    )


def supplier_panel(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """Asset = supplier key: 10, 100 and 1,000 assets at the three scales."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.date_trunc(unit, F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
                 F.col("l_suppkey").cast("string").alias("asset"))
        .agg(*_panel_measures())
    )


def user_panel(spark: SparkSession, folder: str, unit: str = "day") -> DataFrame:
    """Asset = user of the event stream; for coverage audits only, prices are too wild for equity."""
    return (
        table(spark, folder, "events")
        .groupBy(F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("timestamp"),
                 F.col("user_id").cast("string").alias("asset"))
        .agg(F.round(F.avg("value") + 1, 8).alias("price"), F.count(F.lit(1)).cast("double").alias("volume"))
    )


# Fixture values: the brand that plays each symbol, and the tickers that migrate inside the data.
SYMBOL_OF_BRAND = {
    "Brand#11": "GUSDT", "Brand#12": "NOMUSDT", "Brand#13": "POLUSDT",
    "Brand#21": "BTCUSDT", "Brand#22": "ETHUSDT",
}
# (source, canonical, factor, effective instant); the instants lie inside the data.
FIXTURE_MIGRATIONS = (
    ("GAL", "G", 60.0, "1997-06-05 08:00:00"),
    ("OMNI", "NOM", 75.0, "1999-01-06 08:00:00"),
    ("MATIC", "POL", 1.0, "1998-03-04 10:00:00"),
    ("BCC", "BCH", None, None),
)
OVERLAP_DAYS = 21


def migrations(spark: SparkSession) -> DataFrame:
    return migration_table(spark, FIXTURE_MIGRATIONS)


def market_panel(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """Brands under canonical symbols: a clean panel with two named benchmark assets."""
    named = F.create_map(*[F.lit(v) for pair in SYMBOL_OF_BRAND.items() for v in pair])
    symbol = F.coalesce(F.try_element_at(named, F.col("asset")),
                        F.concat(F.upper(F.replace(F.col("asset"), F.lit("#"), F.lit(""))), F.lit("USDT")))
    return brand_panel(spark, folder, unit).withColumn("asset", symbol)


def stored_market(spark: SparkSession, folder: str) -> DataFrame:
    """The market panel written once, for queries that pass over it several times: the tables it
    comes from are far larger and are scanned a single time."""
    return materialise(market_panel(spark, folder))


def raw_feed(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """The market as it arrives: old tickers on the old price scale before each migration, both
    tickers during an overlap after it, and funding missing on some rows."""
    panel = market_panel(spark, folder, unit)
    dim = migrations(spark).where("effective is not null").select(
        F.concat("canonical", F.lit("USDT")).alias("asset"), F.concat("source", F.lit("USDT")).alias("old"),
        "factor", "effective")
    joined = panel.join(dim, "asset", "left")
    stays = F.col("effective").isNull() | (F.col("timestamp") >= F.col("effective"))
    overlap = (F.col("timestamp") >= F.col("effective")) & (
        F.col("timestamp") < F.col("effective") + F.make_dt_interval(F.lit(OVERLAP_DAYS)))
    feeds = F.array_compact(F.array(
        F.when(~stays | overlap, F.struct(F.col("old").alias("asset"), (F.col("price") * F.col("factor")).alias("price"), F.lit(0).alias("ingest_seq"))),
        F.when(stays, F.struct(F.col("asset"), F.col("price"), F.lit(1).alias("ingest_seq"))),
    ))
    dropped = (F.col("volume") % 7 == 3)
    return (
        joined.select("timestamp", "volume", "quote_volume", "funding_rate", F.explode(feeds).alias("feed"))
        .select("timestamp", "feed.asset", "feed.price", "volume", "quote_volume",
                F.when(~dropped, F.col("funding_rate")).alias("funding_rate"), "feed.ingest_seq")
    )
