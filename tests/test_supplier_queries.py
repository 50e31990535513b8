"""Queries on the supplier panel, next to their SQL and to literal results."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from panelwright.functions import folds, numeric
from panelwright.operators import stats
from panelwright.operators.factors import build_signals, folded_signals, unpivot_signals
from panelwright.operators.ranking import bar_ends, contenders, lag_for_execution, near_ends
from panelwright.operators.walkforward import WalkForward
from panelwright.plans.panels import supplier_panel
from panelwright.plans.oracles import ORACLES
from panelwright.plans.queries import QUERIES
from panelwright.session import scratch_folder


def lines(spark, folder, suppliers=6, weeks=42, seed=5, skip=lambda s, w: False):
    """A lineitem table with one or two lines per supplier and week."""
    rng = random.Random(seed)
    rows = [(s, datetime(1995, 1, 2) + timedelta(weeks=w), float(rng.randrange(1, 50)), float(rng.randrange(900, 90000)), rng.randrange(11) / 100, rng.randrange(9) / 100)
            for s in range(suppliers) for w in range(weeks) for _ in range(rng.randrange(1, 3)) if not skip(s, w)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(
        f"{folder}/lineitem.parquet")
    return str(folder)


def by_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    return {r[0]: r[1:] for r in con.execute(ORACLES[name]).fetchall()}


def test_rank_ic_and_its_sql_give_no_statistics_below_thirty_bars(spark, tmp_path):
    folder = lines(spark, tmp_path)
    got = {r[0]: tuple(r[1:]) for r in QUERIES["supplier_rank_ic"](spark, folder).collect()}
    want = by_sql("supplier_rank_ic", folder)
    assert got.keys() == want.keys()
    for signal, row in want.items():
        assert got[signal] == pytest.approx(row, abs=2e-6), signal
    short = {s for s, row in want.items() if row[3] < 30}
    assert {"momentum_30", "low_vol_30"} <= short and "carry" not in short
    assert all(want[s][:3] == (None, None, None) for s in short)


def test_factors_fold_every_sliding_frame_once(spark, tmp_path):
    folder = lines(spark, tmp_path, suppliers=3, weeks=5)
    plan = build_signals(supplier_panel(spark, folder), benchmark="1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stddev_samp(") == 3
    assert plan.count("covar_samp(") == 2 and plan.count("var_samp(bench_return") == 0


def test_supplier_signals_match_their_sql_with_gaps_in_the_benchmark_and_in_assets(spark, tmp_path):
    folder = lines(spark, tmp_path, weeks=60, skip=lambda s, w: (s, w) in {(1, 20), (2, 30), (2, 31), (4, 0)} or (s == 5 and w > 40))
    got = {tuple(r[:2]): tuple(r[2:]) for r in QUERIES["supplier_signals"](spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    want = {r[:2]: r[2:] for r in con.execute(ORACLES["supplier_signals"]).fetchall()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=2e-10), key


def test_rounding_by_arithmetic_equals_rounding_by_decimals(spark):
    rng = random.Random(2)
    ties = [sign * n / 2 ** k for n in (1, 3, 5, 12345, 10**9 + 1) for k in range(0, 14) for sign in (1, -1)]
    rows = [*ties, *(rng.gauss(0, 10 ** rng.randrange(-12, 14)) for _ in range(3000)), *(rng.randrange(10**6) / 10**4 + 5e-11 for _ in range(300)),
            0.0, -0.0, -4e-11, 1e300, -1e17, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in rows], "v double")
    for digits in (0, 2, 8, 10, 12):
        wrong = df.where(~(numeric.half_up("v", digits) + F.lit(0.0)).eqNullSafe(F.round("v", digits) + F.lit(0.0)))
        assert wrong.collect() == []


def test_rows_near_the_ends_hold_the_ends_of_crowded_bars_with_ties(spark):
    rng = random.Random(4)
    rows = [("tied" if t % 2 else "spread", datetime(1995, 1, 2 + t), f"a{i}", float(rng.randrange(3)) if t % 2 else rng.gauss(0, 1))
            for t in range(4) for i in range(400 if t else 5)]
    df = spark.createDataFrame(rows, "signal string, timestamp timestamp, asset string, sig double")
    near = near_ends(df, ["signal"], 3)
    ends = lambda d: {(r["timestamp"], r["side"], r["place"], r["asset"]) for r in bar_ends(d, ["signal"], 3, 3).collect()}
    assert ends(near) == ends(df) == ends(contenders(df, ["signal"], 3))
    assert near.where("signal = 'spread'").count() < 60


def test_a_search_stores_no_row_per_candidate_and_executes_what_the_lag_gives(spark, tmp_path):
    folder = lines(spark, tmp_path, suppliers=5, weeks=50, skip=lambda s, w: (s + w) % 9 == 0)
    frame = build_signals(supplier_panel(spark, folder), benchmark="1").withColumn(
        "carry", F.when(F.col("volume") % 3 > 0, F.col("carry")))
    names = ("momentum_7", "carry", "low_vol_14")
    search = WalkForward(frame, names, (2,), delist_mode="forced_exit")
    assert search.table.count() == frame.count()
    got = {tuple(r) for r in search.executed.select("signal", "timestamp", "asset", "sig").collect()}
    want = lag_for_execution(unpivot_signals(frame, names), ["signal"]).select("signal", "timestamp", "asset", "sig")
    assert got == {tuple(r) for r in want.collect()} and len(got) > 300


def test_rank_ic_stores_no_row_per_signal(spark, tmp_path):
    folder = lines(spark, tmp_path)
    panel = supplier_panel(spark, folder).count()
    scratch = Path(scratch_folder(spark))
    before = set(scratch.glob("table-*"))
    QUERIES["supplier_rank_ic"](spark, folder).collect()
    stored = [spark.read.parquet(str(t)).count() for t in set(scratch.glob("table-*")) - before]
    assert max(stored) == panel


def test_folded_frames_equal_windows_across_batches_gaps_and_missing_values(spark, tmp_path):
    folder = lines(spark, tmp_path, weeks=60, skip=lambda s, w: (s, w) in {(1, 20), (2, 30), (2, 31), (4, 0)} or (s == 5 and w > 4))
    panel = supplier_panel(spark, folder).withColumns({
        "price": F.when((F.col("asset") == "3") & (F.col("volume") % 11 == 0), F.lit(0.0)).when((F.col("asset") != "4") | (F.col("volume") % 13 > 0), F.col("price")),
        "funding_rate": F.when(F.col("asset") == "0", F.lit(float("inf"))).when((F.col("asset") != "2") | (F.col("volume") % 5 > 0), F.col("funding_rate"))})
    for frame in (panel, panel.drop("funding_rate")):
        want = build_signals(frame, benchmark="1")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
        try:
            got = {tuple(map(repr, r)) for r in folded_signals(frame, benchmark="1").select(*want.columns).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {tuple(map(repr, r)) for r in want.collect()} and len(got) > 300


def test_rows_of_an_asset_out_of_order_are_refused():
    at = pa.array([2, 1], pa.timestamp("us"))
    with pytest.raises(ValueError, match="order"):
        folds._ages(pa.record_batch({"asset": ["a", "a"], "timestamp": at}))
    assert folds._ages(pa.record_batch({"asset": pa.array([None, None], pa.string()), "timestamp": at[::-1]})).tolist() == [0, 1]


def test_bars_ranked_in_one_task_equal_bars_ranked_by_signal_with_ties_and_missing_values(spark, monkeypatch):
    rng = random.Random(8)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    some = lambda t: rng.choice(odd) if rng.random() < 0.2 else float(rng.randrange(6)) if t % 2 else rng.gauss(0, 1)
    # Bars of one row up to forty; one whose signals do not vary, one whose returns do not.
    rows = [(datetime(1995, 1, 2 + t), f"a{i}", 1.0 if t == 5 else some(t), None if t == 7 else some(t), 2.0 if t == 6 else some(t)) for t in range(9) for i in range((1, 2, 3, 4)[t] if t < 4 else 40)]
    frame = spark.createDataFrame(rows, "timestamp timestamp, asset string, x double, y double, next_return double")
    want = stats.bar_ic(unpivot_signals(frame.where("next_return is not null"), ("x", "y"), keep=("timestamp", "asset", "next_return")))
    want = {(r["signal"], r["timestamp"]): pytest.approx(r["ic"], abs=1e-12) for r in want.collect()}
    for crowd in (500, 10, 0):
        monkeypatch.setattr(stats, "BAR_ROWS", crowd)
        got = {(r["signal"], r["timestamp"]): r["ic"] for r in stats.panel_ic(frame, ("x", "y")).collect()}
        assert got == want and len(got) > 8
