"""Ranks, research statistics, cross-validation, capacity and decisions."""

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ranks as R
from panelwright.operators import capacity as K
from panelwright.operators import cpcv as C
from panelwright.operators import decision as D
from panelwright.operators import stats as S
from panelwright.operators.factors import build_signals
from panelwright.sources import landed, reports


def values(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(4)}", i, rng.choice([None, 0.0, -1.0, rng.gauss(0, 1), rng.gauss(0, 1) * 1e6])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id int, v double")


@pytest.mark.parametrize("range_rows", [10**6, 7])
def test_ranks_and_quantiles_do_not_depend_on_how_a_group_is_cut(spark, monkeypatch, range_rows):
    monkeypatch.setattr(R, "RANGE_ROWS", range_rows)
    rows, df = values(spark)
    pdf = pd.DataFrame(rows, columns=["g", "id", "v"])
    want = dict(zip(pdf["id"], pdf.groupby("g")["v"].rank(pct=True)))
    ranked = R.average_ranks(df, ["g"], "v", "k", "n")
    for r in ranked.collect():
        assert (r["k"] is None and math.isnan(want[r["id"]])) or r["k"] / r["n"] == pytest.approx(want[r["id"]])
    edges = {r["g"]: r["edges"] for r in R.quantile_edges(df, ["g"], "v", 5).collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert edges[g] == pytest.approx(sorted(set(np.quantile(part["v"], [0, .2, .4, .6, .8, 1]))))


def test_research_statistics_match_a_direct_computation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.02, 0.2, 120)
    days = pd.date_range("2026-01-01", periods=120)
    df = spark.createDataFrame(pd.DataFrame({"signal": "s", "timestamp": days, "ic": x}))
    lags, dev = int(120 ** 0.25), x - x.mean()
    var = (dev ** 2).mean() + sum(2 * (1 - k / (lags + 1)) * (dev[k:] * dev[:-k]).mean() for k in range(1, lags + 1))
    assert S.newey_west(df).first()["nw_tstat"] == pytest.approx(x.mean() / math.sqrt(var / 120))
    ci = S.block_bootstrap(df).first()
    assert ci["lower_95"] < x.mean() < ci["upper_95"] and ci["mean"] == pytest.approx(x.mean())
    table = S.bonferroni(S.ic_table(df), 10).first()
    assert table["adjusted_pvalue"] == pytest.approx(min(1, 10 * math.erfc(abs(table["ic_tstat"]) / math.sqrt(2))))
    moments = S.adjusted_moments(df, "signal", "ic").first()
    assert moments["skewness"] == pytest.approx(pd.Series(x).skew()) and moments["kurtosis"] == pytest.approx(pd.Series(x).kurt() + 3)


def test_deflated_sharpe(spark):
    schema = "observed_sr double, n_trials int, skewness double, kurtosis double, n_obs int, trials_variance double"
    rows = [(0.3, 1, 0.0, 3.0, 120, 0.04), (0.3, 50, 0.0, 3.0, 120, 0.04), (0.3, 200, 0.0, 3.0, 120, 0.04), (0.3, 1, 0.0, 3.0, 1, 0.0), (3.0, 1, 5.0, 3.0, 100, 0.0)]
    out = [r for r in S.deflated_sharpe(spark.createDataFrame(rows, schema)).collect()]
    by = {(r["observed_sr"], r["n_trials"], r["n_obs"]): r for r in out}
    plain = by[(0.3, 1, 120)]
    assert plain["dsr"] == pytest.approx(NormalDist().cdf(0.3 * math.sqrt(119) / math.sqrt(1 + 0.3 ** 2 / 2)))
    assert plain["dsr"] > by[(0.3, 50, 120)]["dsr"] > by[(0.3, 200, 120)]["dsr"]
    assert by[(0.3, 1, 1)]["note"] == "insufficient_observations" and by[(3.0, 1, 100)]["note"] == "degenerate_return_distribution"
    strict = "observed_sr double, n_trials int, n int, std double, skewness double, kurtosis double, trials_variance double"
    checked = S.deflated_sharpe_strict(spark.createDataFrame([(0.1, 1, 3, 0.1, 0.0, 3.0, None), (0.1, 5, 90, 0.1, 0.0, 3.0, None), (0.1, 5, 90, 0.1, 0.0, 3.0, 0.01)], strict)).collect()
    assert sorted((r["error"] or "", r["dsr"] is None) for r in checked) == [("", False), ("too_few_observations", True), ("trial_variance_missing", True)]


def test_copies_of_a_trial_count_once(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("2026-01-01", periods=60)
    base, other = rng.normal(size=60), rng.normal(size=60)
    parts = [pd.DataFrame({"search": "s", "id": i, "timestamp": days, "ret": v}) for i, v in (("a", base), ("b", base * 2 + 1), ("c", other))]
    short = pd.DataFrame({"search": "s", "id": "d", "timestamp": days[:20], "ret": base[:20]})
    df = spark.createDataFrame(pd.concat([*parts, short]))
    assert S.effective_trials(df).first()["effective_n_trials"] == 3
    check = S.ensemble_precheck(spark.createDataFrame(pd.concat(parts[:2])), "search").first()
    assert check["recommendation"] == "BLOCK_ENSEMBLE" and check["max_pairwise_corr"] == pytest.approx(1.0)
    bad = spark.createDataFrame([("x", 1.0, "data_error"), ("y", None, None), ("z", 1.0, None)], "trial string, sharpe double, exclusion_reason string")
    assert {r["trial"] for r in S.trial_conflicts(bad).collect()} == {"x", "y"}


@pytest.mark.parametrize("series, bars", [(3, 7), (128, 512)])
def test_correlations_of_uneven_series_by_tiles_are_those_of_their_common_bars(spark, monkeypatch, series, bars):
    """Small tiles and large ones; far from zero, constant, with holes, without a common bar, with bad returns, in two groups."""
    monkeypatch.setattr(S, "TILE_SERIES", series)
    monkeypatch.setattr(S, "TILE_BARS", bars)
    rng = np.random.default_rng(6)
    days = pd.date_range("2025-02-01", periods=60)
    made = {f"s{i}": pd.Series(rng.normal(1000 if i == 2 else 0, 0.01, 60), days).sample(frac=1 - i / 12, random_state=i) for i in range(9)}
    made |= {"still": pd.Series(0.1, days), "head": pd.Series(rng.normal(size=20), days[:20]), "tail": pd.Series(rng.normal(size=20), days[40:]), "lone": pd.Series([0.2], days[:1])}
    made["step"] = pd.Series([0.3] * 20 + list(rng.normal(size=40)), days)  # does not vary where head is
    rows = [(g, k, t.to_pydatetime(), float(v)) for g in ("x", "y") for k, s in made.items() for t, v in s.items() if g == "x" or k < "s5"]
    bad = [("x", "head", days[30].to_pydatetime(), float("nan")), ("x", "tail", days[0].to_pydatetime(), None), ("x", "lone", days[5].to_pydatetime(), float("inf")), (None, "a", days[0].to_pydatetime(), 1.0)]
    df = spark.createDataFrame(rows + bad, "search string, id string, timestamp timestamp, ret double")
    got = {(r["search"], r["a"], r["b"]): (r["corr"], r["overlap"]) for r in S.pairwise_correlation(df, ["search"], 5).collect() if r["search"]}
    expected = {}
    for g, known in (("x", sorted(made)), ("y", sorted(k for k in made if k < "s5"))):
        for a, b in ((a, b) for a in known for b in known if a < b):
            both = pd.concat([made[a], made[b]], axis=1, join="inner")
            if len(both):
                flat = len(both) < 5 or min(both.nunique()) == 1
                expected[g, a, b] = (None if flat else both.corr().iloc[0, 1], len(both))
    assert got.keys() == expected.keys() and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in expected.items()}
    assert {k for k, v in got.items() if v[0] is None} == {k for k, v in expected.items() if v[0] is None}
    assert all(v[0] is None or v[0] == pytest.approx(expected[k][0], abs=1e-9) for k, v in got.items())
    alone = S.pairwise_correlation(df.where("search = 'y'").drop("search"))
    assert alone.count() == sum(g == "y" for g, *_ in expected)
    assert S.pairwise_correlation(df.where("1 = 0"), ["search"]).count() == 0


def test_future_bars_never_change_earlier_factors(spark):
    rng = random.Random(4)
    days = [d.strftime("%Y-%m-%d") for d in pd.date_range("2026-01-01", periods=50)]
    rows = [(d, a, 100 * math.exp(rng.gauss(0, 0.02)), rng.gauss(0, 0.001)) for d in days for a in ("BTCUSDT", "A", "B", "C") if a == "BTCUSDT" or rng.random() > 0.03]
    df = spark.createDataFrame(rows, "timestamp string, asset string, price double, funding_rate double").withColumn("timestamp", F.to_timestamp("timestamp"))
    cut = F.col("timestamp") < F.lit(days[40])
    order = ["timestamp", "asset"]
    cols = sorted(build_signals(df).columns)
    whole = [tuple(r) for r in build_signals(df).where(cut).select(cols).orderBy(order).collect()]
    part = [tuple(r) for r in build_signals(df.where(cut)).select(cols).orderBy(order).collect()]
    assert whole == part


def test_cross_validation_splits(spark):
    df = spark.createDataFrame([(d.strftime("%Y-%m-%d"),) for d in pd.date_range("2026-01-01", periods=100)], "timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    free = C.cpcv_splits(df, 5, 2, 0.0, 0.0)
    assert {(r["side"], r["count"]) for r in free.groupBy("fold_id", "side").count().collect()} == {("test", 40), ("train", 60)}
    assert free.select("fold_id").distinct().count() == 10
    purged = C.cpcv_splits(df, 5, 2, 0.05, 0.02).collect()
    for fold in range(10):
        test = {r["idx"] for r in purged if r["fold_id"] == fold and r["side"] == "test"}
        train = {r["idx"] for r in purged if r["fold_id"] == fold and r["side"] == "train"}
        want = {p for p in range(100) if p not in test and min(abs(p - t) for t in test) > 2 and not any(t < p <= t + 5 for t in test)}
        assert train == want


def test_cross_validation_summary_flags_concentrated_profit(spark):
    paths = spark.createDataFrame([("low", 1.0, 0.30, -0.1, -0.1), ("high", 0.5, 0.01, -0.1, -1.2), ("high", -0.5, -0.02, -0.1, -0.1)],
                                  "regime string, sharpe_oos double, test_return double, max_dd_train double, max_dd_oos double")
    row = C.cpcv_summary(paths).first()
    assert row["regime_concentration_flag"] and row["ruin_flag"] and row["pct_profitable_folds"] == pytest.approx(2 / 3)


def test_average_volume_leaves_out_a_spike_and_status_follows_headroom(frame):
    rows = [(d.strftime("%Y-%m-%d"), "A", 100.0, 50e6 if i == 95 else 1e6) for i, d in enumerate(pd.date_range("2026-01-01", periods=100))]
    panel = frame(rows, ("timestamp", "asset", "price", "quote_volume"))
    last = F.col("timestamp") == F.lit("2026-04-10").cast("timestamp")
    assert K.average_volume(panel).where(last).first()["adv"] == pytest.approx(1e6)
    trades = frame([("2026-04-10", "A", 10_000), ("2026-05-01", "A", 2e6)], ("timestamp", "asset", "notional"))
    seen = K.impact_overlay(trades, panel).orderBy("notional").collect()
    assert [r["participation"] for r in seen] == pytest.approx([0.01, 2.0]) and seen[1]["headroom"] == pytest.approx(0.75)
    status = {r["asset"]: r["status"] for r in K.overlay_status(K.impact_overlay(trades, panel), ["asset"]).collect()}
    assert status == {"A": "BREACH"}


def test_gate_and_review(spark):
    schema = ("strategy_id string, dsr double, sharpe_mean double, max_dd_walk_forward double, max_dd_oos double, regime_concentration_flag boolean, "
              "max_pairwise_corr double, capacity map<double,string>, halt_unexplained_count int")
    cases = [("low", 0.2, 1.0, -0.1, -0.1), ("gray", 0.7, 1.0, -0.1, -0.1), ("good", 0.97, 1.0, -0.1, -0.1), ("deep", 0.97, 1.0, -0.3, -0.1)]
    rows = spark.createDataFrame([(*c, False, None, {1e4: "BREACH"}, 0) for c in cases], schema)
    got = {r["strategy_id"]: (r["status"], r["reasons"]) for r in D.gate_status(rows).collect()}
    assert {k: v[0] for k, v in got.items()} == {"low": "REJECTED", "gray": "FLAG_REVIEW", "good": "APPROVED_CANDIDATE", "deep": "REJECTED"}
    assert got["good"][1] == ["capacity_breach"]
    assert {r["status"] for r in D.gate_status(rows, final=False).collect()} == {"REJECTED"}
    reviews = spark.createDataFrame([("gray", "ann", "APPROVE", "2026"), ("good", "ann", "APPROVE", "2026"), ("gray", "", "REJECT", "2026")],
                                    "strategy_id string, reviewed_by string, review_decision string, review_timestamp string")
    done = sorted((r["strategy_id"], r["error"] or "", r["final"] or "") for r in D.apply_reviews(D.gate_status(rows), reviews).collect())
    assert done == [("good", "not_under_review", ""), ("gray", "", "APPROVED"), ("gray", "incomplete_review", "")]
    gates = spark.createDataFrame([("a", {g: True for g in D.HARD_GATES}), ("b", {"wf_positive": True})], "strategy_id string, gates map<string,boolean>")
    assert {r["strategy_id"]: r["deployable"] for r in D.hard_gates(gates).collect()} == {"a": True, "b": False}


def test_landed_files_round_trip(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "galusdt-1d-2024-01-01.csv").write_text("open_time,open,high,low,close,volume,x,q,n,a,b,i\n1704067200000,1,2,0.5,1.5,10,0,15,1,1,1,0\n")
    (tmp_path / "k" / "XUSDT-1d-2025-01-01.csv").write_text("1735689600000000,1,2,0.5,1.5,10,0,15,1,1,1,0\n")
    rows = {r["asset"]: r for r in landed.read_klines(spark, str(tmp_path / "k")).collect()}
    assert str(rows["GALUSDT"]["timestamp"]) == "2024-01-01 00:00:00" and str(rows["XUSDT"]["timestamp"]) == "2025-01-01 00:00:00"
    assert rows["XUSDT"]["price"] == 1.5 and rows["XUSDT"]["quote_volume"] == 15
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "XUSDT-fundingRate-2024-01.csv").write_text("calc_time,interval,last_funding_rate\n1704067200000,8,0.0001\n")
    (tmp_path / "f" / "YUSDT-fundingRate-2024-02.csv").write_text("symbol,fundingRate,fundingTime,mark\nYUSDT,-0.0002,1704067200000,5\n")
    prints = {r["source"]: (str(r["timestamp"]), r["funding_rate"]) for r in landed.read_funding(spark, str(tmp_path / "f")).collect()}
    assert prints == {"XUSDT": ("2024-01-01 00:00:00", 0.0001), "YUSDT": ("2024-01-01 00:00:00", -0.0002)}
    (tmp_path / "f" / "ZUSDT-fundingRate-2024-02.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="funding"):
        landed.read_funding(spark, str(tmp_path / "f"))
    twins = [reports.run_fingerprint(spark.createDataFrame([("k", t), ("k", t)], "k string, t string"), "k", "t", {}).first()["run_id"] for t in ("a", "b")]
    assert twins[0] != twins[1]
    segments = spark.createDataFrame([("AUSDT", "AUSDT", "2024-01-01", None, "active", "official")], "canonical string, symbol string, listed_at string, delisted_at string, event string, source string")
    back = landed.read_manifest(spark, landed.write_manifest(segments, str(tmp_path / "m"))).first()
    assert str(back["listed_at"]) == "2024-01-01 00:00:00" and back["delisted_at"] is None
    spreads = spark.createDataFrame([("A", "100"), ("B", "x")], "asset string, spread_bps string")
    with pytest.raises(ValueError, match="spread"):
        landed.spread_dimension(spreads)
    assert landed.spread_dimension(spreads.where("asset = 'A'")).first()["spread"] == pytest.approx(0.01)
    table = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 3.0)], "run_id string, timestamp int, v double")
    reports.write_reports({"t": table}, str(tmp_path / "out"))
    assert reports.latest(spark.read.parquet(str(tmp_path / "out" / "t"))).first()["v"] == 3.0
    assert reports.write_rejected(table, F.col("v") > 2.5, str(tmp_path / "bad"), "d").count() == 1
