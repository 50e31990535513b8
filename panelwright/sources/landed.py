"""Readers of landed market files. Schemas are explicit; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Columns of a kline file without header, and the names under which funding arrives.
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignore")
FUNDING_TIME_NAMES = ("calctime", "fundingtime", "fundingtimestamp")
FUNDING_RATE_NAMES = ("lastfundingrate", "fundingrate", "funding")
MICROSECOND_EPOCH = 10**14

LIFECYCLE_COLUMNS = ("canonical", "symbol", "listed_at", "delisted_at", "event", "source")


def _symbol_from_path() -> Column:
    """Symbol of a file named <SYMBOL>-<interval>-<date>.<ext>."""
    return F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+?)-[^/]*$", 1))


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Kline files as raw panel rows. Header lines drop out; each file's epochs are micro- or
    milliseconds as its largest says."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in KLINE_COLUMNS)).csv(path)
    timed = raw.withColumns({"epoch": F.col("open_time").try_cast("bigint"), "file": F.input_file_name(), "asset": _symbol_from_path()}).where("epoch is not null")
    units = timed.groupBy("file").agg((F.max(F.abs("epoch")) > MICROSECOND_EPOCH).alias("micros"))
    stamp = F.when(F.col("micros"), F.timestamp_micros("epoch")).otherwise(F.timestamp_millis("epoch"))
    double = lambda c: F.col(c).try_cast("double")
    return timed.join(units, "file").select(
        stamp.alias("timestamp"), "asset", double("open").alias("open"), double("high").alias("high"), double("low").alias("low"),
        double("close").alias("price"), double("volume").alias("volume"), double("quote_volume").alias("quote_volume"))


def _plain(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit(""))


def _first_of(names, values: Column, labels: Column) -> Column:
    """The value under the first of several names that a header has."""
    at = lambda n: F.greatest(F.array_position(labels, F.lit(n)).cast("int"), F.lit(1))
    return F.coalesce(*[F.when(F.array_contains(labels, n), F.element_at(values, at(n))) for n in names])


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    """Funding files by the symbol in the file name; every file is read under its own header line.

    Files of one folder may order and name their columns differently, and have any number of them. A file whose header has no known time or rate
    refuses the folder.
    """
    commas = spark.read.text(path).agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0]
    columns = [f"c{i}" for i in range((commas or 0) + 1)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path)
    lines = raw.select(F.input_file_name().alias("file"), _symbol_from_path().alias("source"), F.array(*columns).alias("cells"))
    labels = F.transform("cells", lambda c: F.coalesce(_plain(c), F.lit("")))
    is_header = F.arrays_overlap(labels, F.array(*[F.lit(n) for n in (*FUNDING_TIME_NAMES, *FUNDING_RATE_NAMES)]))
    headers = lines.where(is_header).groupBy("file").agg(F.first(labels).alias("labels"))
    known = lambda names: F.exists("labels", lambda c: c.isin(*names))
    good = headers.where(known(FUNDING_TIME_NAMES) & known(FUNDING_RATE_NAMES))
    bad = lines.select("file").distinct().join(good, "file", "left_anti").limit(5).collect()
    if bad:
        raise ValueError(f"no funding time or rate in the header of {[r['file'] for r in bad]}")
    rows = lines.where(~is_header).join(good, "file")
    cells, names = F.col("cells"), F.col("labels")
    return rows.select(F.timestamp_millis(_first_of(FUNDING_TIME_NAMES, cells, names).cast("bigint")).alias("timestamp"), "source",
                       _first_of(FUNDING_RATE_NAMES, cells, names).cast("double").alias("funding_rate"))


def read_book_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Best quotes landed as JSON."""
    raw = spark.read.schema("symbol string, bidPrice string, askPrice string").option("multiLine", True).json(path)
    return raw.select("symbol", F.col("bidPrice").try_cast("double").alias("bid"), F.col("askPrice").try_cast("double").alias("ask"))


def spread_dimension(raw: DataFrame) -> DataFrame:
    """(asset, spread_bps) as a fraction per asset; a missing or negative spread refuses the table."""
    missing = {"asset", "spread_bps"} - set(raw.columns)
    if missing:
        raise ValueError(f"spread table lacks {sorted(missing)}")
    table = raw.select("asset", F.col("spread_bps").try_cast("double").alias("bps"))
    if not table.where("bps is null or isnan(bps) or bps < 0").isEmpty():
        raise ValueError("spread table has non-numeric or negative spread_bps")
    return table.groupBy("asset").agg((F.max("bps") / 10000).alias("spread"))


def write_manifest(segments: DataFrame, path: str) -> str:
    segments.select(*LIFECYCLE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in LIFECYCLE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"lifecycle manifest lacks {missing}")
    stamps = {c: F.try_to_timestamp(F.col(c)) for c in ("listed_at", "delisted_at")}
    return raw.withColumns(stamps).select(*LIFECYCLE_COLUMNS)
