"""Panel normalisation and audits on small literal panels."""

import pytest
from pyspark.sql import functions as F

from panelwright.functions.symbols import migration_table, with_canonical
from panelwright.operators import audit as Q
from panelwright.operators import panel as P
from panelwright.operators import validate as V
from panelwright.operators.portfolio import series_bars


def names(df, *cols):
    return sorted(tuple(r[c] if not hasattr(r[c], "isoformat") else str(r[c]) for c in cols) for r in df.collect())


def test_known_tickers_map_to_their_canonical_symbol(spark):
    pairs = {"GALUSDT": "GUSDT", "gusdt": "GUSDT", "OMNIUSDC": "NOMUSDC", "MATICBTC": "POLBTC", "NANOETH": "XNOETH", "VENUSDT": "VETUSDT", "BCCBUSD": "BCHBUSD", "ANTOLDUSDT": "ANTUSDT", "BTC": "BTC", "XRP": "XRP"}
    df = spark.createDataFrame([(k,) for k in pairs], "asset string")
    got = {r["asset"]: r["canonical"] for r in with_canonical(df, migration_table(spark)).collect()}
    assert got == pairs


def test_official_ratio_adjusts_the_old_price(frame, spark):
    df = frame([("2024-01-01", "GALUSDT", 60), ("2024-01-02", "GUSDT", 1)], ("timestamp", "asset", "price")).withColumn("ingest_seq", F.lit(1))
    rows = P.canonical_panel(df, migration_table(spark)).orderBy("timestamp").collect()
    assert [r["price"] for r in rows] == [1.0, 1.0] and rows[0]["price_adjustment_factor"] == 60.0
    assert rows[1]["asset_return"] == 0.0 and rows[1]["signal"] == 0.0


def test_duplicates_collapse_to_last_value_and_summed_funding(frame, spark):
    df = frame([("2024-01-01", "MATICUSDT", 1.0, 0.01), ("2024-01-01", "POLUSDT", 1.1, None), ("2024-01-02", "POLUSDT", 1.2, None)], ("timestamp", "asset", "price", "funding_rate"))
    df = df.withColumn("ingest_seq", F.when(F.col("asset") == "MATICUSDT", 0).otherwise(1))
    rows = P.canonical_panel(df, migration_table(spark)).orderBy("timestamp").collect()
    assert [(r["price"], r["funding_rate"]) for r in rows] == [(1.1, 0.01), (1.2, 0.0)]
    assert Q.collisions(P.canonical_assets(df, migration_table(spark))).first()["source_assets"] == "MATICUSDT,POLUSDT"


def test_calendar_day_decides_the_scale_of_a_candle(frame, spark):
    # The move is at eight in the morning of the 19th; that day's candle, stamped at midnight, is on the new scale.
    dim = migration_table(spark)
    rows = [("2024-07-15", "GUSDT", 2.4, 7), ("2024-07-19", "GUSDT", 0.03, 7), ("2024-07-21", "GUSDT", 0.05, 0), ("2024-07-19", "OTHER", 8.0, 7)]
    repaired = P.repair_klines(frame(rows, ("timestamp", "asset", "price", "volume")), dim)
    assert [r["price"] for r in repaired.where("asset = 'GUSDT'").orderBy("timestamp").collect()] == pytest.approx([0.04, 0.03])
    seams = P.migration_seams(repaired, dim)
    assert [(r["asset"], round(r["seam_return"], 9)) for r in seams.collect()] == [("GUSDT", -0.25)]
    assert names(P.without_broken_seams(repaired, seams), "asset") == [("OTHER",)]
    assert P.without_broken_seams(repaired, seams, 0.3).count() == 3


def test_repair_restores_tickers_and_drops_dead_prints(frame, spark):
    rows = [(f"2024-07-{d:02d}", "GUSDT", 5.0, 100.0) for d in range(1, 20)] + [(f"2024-07-{d:02d}", "GUSDT", 0.08, 100.0) for d in range(20, 25)] + [("2024-07-20", "GALUSDT", 5.0, 0.0)]
    cut = spark.createDataFrame([("GUSDT", "GALUSDT", "2024-07-20")], "target string, source string, cutover string").withColumn("cutover", F.to_timestamp("cutover"))
    panel, log = P.repair_panel(frame(rows, ("timestamp", "asset", "price", "volume")), cut)
    row = log.first()
    assert (row["relabelled_rows"], row["stale_rows"], row["output_rows"]) == (19, 1, 24)
    assert P.require_unique(panel).where("asset = 'GALUSDT'").count() == 19
    with pytest.raises(ValueError, match="duplicate"):
        P.require_unique(panel.unionByName(panel))


def test_funding_gap_reasons(frame, spark):
    # Prints by day from 3 March 2025; None is a missing rate. IDLE does not trade on the day it misses.
    prints = {"LATE": [None, None, None, 0.4, 0.4, 0.4], "GONE": [0.1, 0.1, None, None, None, None], "HOLE": [0.2, 0.2, None, 0.2, 0.2, 0.2], "IDLE": [0.3, 0.3, 0.3, 0.3, None, 0.3]}
    rows = [(f"2025-03-{3 + i:02d}", a, 7.5, 0.0 if a == "IDLE" and i == 4 else 60.0, rate) for a, series in prints.items() for i, rate in enumerate(series)]
    rows += [(day, "POLUSDT", 0.5, 60.0, rate) for day, rate in (("2024-09-01", 0.1), ("2024-09-14", None), ("2024-10-20", 0.1))]
    gaps = Q.funding_gaps(frame(rows, ("timestamp", "asset", "price", "volume", "funding_rate")), migration_table(spark))
    found = sorted((r["asset"], r["reason"], r["count"]) for r in gaps.groupBy("asset", "reason").count().collect())
    assert found == [("GONE", "delisted", 4), ("HOLE", "active", 1), ("IDLE", "delisted", 1), ("LATE", "not_listed", 3), ("POLUSDT", "migration", 1)]
    assert names(Q.split_funding_gaps(gaps).where("not expected"), "asset") == [("HOLE",)]


def test_funding_frequency_sums_the_prints_of_a_day(frame):
    rows = [(f"2025-05-{d:02d} {h:02d}:00:00", "P", 0.002 if d == 7 else -0.001) for d in (6, 7, 8) for h in range(0, 24, 4)]
    rows += [("2025-05-06 00:00:00", "Q", -0.03), ("2025-05-07 00:00:00", "Q", 0.03), ("2025-05-07 12:00:00", "Q", None)]
    report = {r["asset"]: r for r in Q.funding_frequency(frame(rows, ("timestamp", "asset", "funding_rate"))).collect()}
    assert report["P"]["max_settlements_per_day"] == 6 and report["Q"]["max_settlements_per_day"] == 2
    assert report["P"]["max_abs_daily_rate"] == pytest.approx(0.012) and str(report["P"]["max_abs_daily_rate_date"])[:10] == "2025-05-07"
    assert report["Q"]["max_abs_daily_rate"] == pytest.approx(-0.03) and str(report["Q"]["max_abs_daily_rate_date"])[:10] == "2025-05-06"


def test_two_tickers_that_move_into_one_asset_double_no_row(frame, spark):
    moves = spark.createDataFrame([("OLDA", "G", 10.0, "2024-03-05"), ("OLDB", "G", 2.0, "2024-03-09")], "source string, canonical string, factor double, effective string")
    moves = moves.withColumn("effective", F.to_timestamp("effective"))
    rows = [(f"2024-03-{d:02d}", "GUSDT", 100.0, 1.0, None) for d in (1, 2, 6, 7, 12)]
    df = frame(rows, ("timestamp", "asset", "price", "volume", "funding_rate"))
    assert [r["price"] for r in P.repair_klines(df, moves).orderBy("timestamp").collect()] == [10.0, 10.0, 50.0, 50.0, 100.0]
    assert Q.funding_gaps(df, moves).count() == 5
    blocks = Q.gap_blocks(df, moves, adjacency_days=1)
    assert names(blocks, "asset", "gap_steps", "reason") == [("GUSDT", 3, "migration_halt"), ("GUSDT", 4, "migration_halt")]
    assert [(r["asset"], r["missing"]) for r in Q.gap_summary(df, blocks, moves).collect()] == [("GUSDT", 7)]
    assert sorted(str(r["first_new"])[:10] for r in P.migration_seams(df, moves).collect()) == ["2024-03-06", "2024-03-12"]
    prints = frame([(d, s, 0.01) for d in ("2024-03-04", "2024-03-07", "2024-03-10") for s in ("OLDAUSDT", "OLDBUSDT", "GUSDT")], ("timestamp", "source", "funding_rate"))
    kept = [(str(r["timestamp"])[8:10], r["source"]) for r in Q.cutover_split(prints, moves).where("kept").orderBy("timestamp", "source").collect()]
    assert kept == [("04", "OLDAUSDT"), ("04", "OLDBUSDT"), ("07", "OLDBUSDT"), ("10", "GUSDT")]
    # A ticker that is listed with two days moves on the later one.
    again = moves.unionByName(moves.where("source = 'OLDA'").withColumn("effective", F.to_timestamp(F.lit("2024-03-08"))))
    kept = [(str(r["timestamp"])[8:10], r["source"]) for r in Q.cutover_split(prints, again).where("kept").orderBy("timestamp", "source").collect()]
    assert kept == [("04", "OLDAUSDT"), ("04", "OLDBUSDT"), ("07", "OLDAUSDT"), ("07", "OLDBUSDT"), ("10", "GUSDT")]


def test_gap_blocks_near_a_migration_and_elsewhere(frame, spark):
    days = [f"2024-06-{d:02d}" for d in (1, 2)] + [f"2024-07-{d:02d}" for d in (7, 8)]
    rows = [(d, "GUSDT", 1.0) for d in days] + [(f"2024-01-{d:02d}", "AUSDT", 1.0) for d in (1, 2, 4, 5)] + [("2024-01-02 06:00:00", "AUSDT", 1.0)]
    blocks = Q.gap_blocks(frame(rows, ("timestamp", "asset", "price")), migration_table(spark), adjacency_days=14)
    assert names(blocks, "asset", "gap_steps", "reason") == [("AUSDT", 1, "unexplained_interior"), ("GUSDT", 34, "migration_halt")]
    assert Q.calendar_gaps(blocks).count() == 35


def test_lifecycle_segments_and_membership(frame, spark):
    rows = [(f"2025-09-{d}", "OMNIUSDT", 3.0) for d in (26, 28)] + [(f"2025-10-0{d}", "NOMUSDT", 0.04) for d in (3, 6, 8)] + [(d, "ETHUSDT", 4000.0) for d in ("2025-09-26", "2025-10-08")]
    data, dim = frame(rows, ("timestamp", "source_asset", "price")), migration_table(spark)
    life = Q.lifecycle(data, dim)
    by_symbol = {r["symbol"]: r for r in life.collect()}
    assert by_symbol["OMNIUSDT"]["event"] == "migration_source" and str(by_symbol["OMNIUSDT"]["delisted_at"]) == "2025-10-01 08:00:00"
    assert by_symbol["NOMUSDT"]["event"] == "migration_target" and str(by_symbol["NOMUSDT"]["listed_at"]) == "2025-10-01 08:00:00"
    assert by_symbol["ETHUSDT"]["event"] == "active" and by_symbol["ETHUSDT"]["delisted_at"] is None
    when = spark.createDataFrame([("2025-09-27",), ("2025-10-05",)], "instant string").withColumn("instant", F.to_timestamp("instant"))
    assert [r[1] for r in names(Q.active_assets(life, when), "instant", "canonical")] == ["ETHUSDT", "NOMUSDT"] * 2
    early = frame([("2025-09-20", "NOMUSDT", 0.04), ("2025-10-04", "NOMUSDT", 0.04), ("2025-10-04", "ZUSDT", 1)], ("timestamp", "source_asset", "price")).withColumn("asset", F.col("source_asset"))
    assert names(Q.universe_audit(early, life.where("symbol = 'NOMUSDT'"), dim), "asset", "reason") == [("NOMUSDT", "trading_before_listing"), ("ZUSDT", "no_lifecycle_segment")]


def test_survivorship_counts_the_missing_dead(frame, spark):
    data = frame([(f"2024-01-{d:02d}", a, 1.0) for d in range(1, 11) for a in ("AUSDT", "BUSDT")], ("timestamp", "asset", "price"))
    manifest = spark.createDataFrame(
        [("AUSDT", "2023-01-01", None), ("BUSDT", "2023-01-01", None), ("DEADUSDT", "2023-01-01", "2024-01-05"), ("GONEUSDT", "2020-01-01", "2021-01-01")],
        "symbol string, listed_at string, delisted_at string").withColumns({"listed_at": F.to_timestamp("listed_at"), "delisted_at": F.to_timestamp("delisted_at")})
    row = Q.survivorship(data, manifest, migration_table(spark))[0].first()
    assert (row["n_missing_dead"], row["missing_dead_asset_days"], row["n_manifest_in_window"]) == (1, 5, 3)
    assert row["coverage_ratio"] == pytest.approx(2 / 3)


def test_preflight_tolerates_one_missing_step_only(frame, spark):
    def severity(days):
        rows = [(f"2024-01-{d:02d}", a, 100.0, 1.0) for a in ("AUSDT", "BUSDT") for d in (days if a == "AUSDT" else range(1, 13))]
        df = frame(rows, ("timestamp", "asset", "price", "signal")).withColumn("ingest_seq", F.lit(0))
        return {r["rule"]: (r["severity"], r["n"]) for r in Q.preflight_rules(df, migration_table(spark)).collect()}

    one = severity([d for d in range(1, 13) if d != 6])
    assert one["tolerated_gap_steps"] == ("warning", 1) and not [r for r in one.values() if r[0] == "error"]
    assert severity([d for d in range(1, 13) if d not in (6, 7)])["large_gap_steps"] == ("error", 2)


def test_findings_name_every_row_and_samples_stop_at_n(frame, spark):
    rows = [(f"2024-01-{d:02d}", a, 100.0, 1.0) for a, days in (("AUSDT", (1, 3, 6)), ("BUSDT", (1, 2, 2, 5, 6))) for d in days]
    df = frame(rows, ("timestamp", "asset", "price", "signal")).withColumn("ingest_seq", F.monotonically_increasing_id())
    found = Q.preflight_findings(df, migration_table(spark))
    got = {(r["rule"], r["asset"], r["timestamp"] and r["timestamp"].day, r["steps"]) for r in found.collect()}
    assert got == {("duplicate_raw_key", "BUSDT", 2, 0), ("tolerated_gap_steps", "AUSDT", 2, 1), ("large_gap_steps", "AUSDT", 4, 2),
                   ("large_gap_steps", "BUSDT", 3, 2), ("inferred_listing", "AUSDT", None, 0), ("inferred_listing", "BUSDT", None, 0)}
    first = {(r["rule"], r["asset"]) for r in Q.finding_samples(found, 1).collect()}
    assert first == {("duplicate_raw_key", "BUSDT"), ("tolerated_gap_steps", "AUSDT"), ("large_gap_steps", "AUSDT"), ("inferred_listing", "AUSDT")}


@pytest.mark.parametrize("stamps, expected", [
    ([f"2026-01-{d:02d}" for d in range(1, 9)], 365.0), ([f"2026-01-01 {h:02d}:00:00" for h in range(9)], 8760.0),
    ([f"2026-01-01 {h:02d}:00:00" for h in range(0, 24, 4)], 2190.0), (["2026-01-01"], 365.0)])
def test_periods_per_year(frame, stamps, expected):
    bars = series_bars(frame([(s, "A") for s in stamps], ("timestamp", "asset")).withColumn("k", F.lit(1)), ["k"])
    assert bars.first()["ppy"] == expected


def test_regime_labels_ignore_the_future(frame):
    rows = [(f"2026-{1 + i // 28:02d}-{1 + i % 28:02d}", "BTCUSDT", 100 + i * 0.5 + (i % 7)) for i in range(90)]
    whole = names(V.regime_labels(frame(rows, ("timestamp", "asset", "price"))), "timestamp", "regime")
    part = names(V.regime_labels(frame(rows[:60], ("timestamp", "asset", "price"))), "timestamp", "regime")
    assert whole[:60] == part
