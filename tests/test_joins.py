"""Interval joins, equi-depth ranges and rebalance schedules against plain loops."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from panelwright.functions import ranks as R
from panelwright.functions.intervals import interval_join
from panelwright.operators.audit import active_assets, gap_summary
from panelwright.operators.cpcv import group_choices
from panelwright.operators.portfolio import rebalances
from panelwright.sources.landed import read_funding

START = datetime(2021, 3, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_with_open_empty_and_clipped_intervals(spark, seed):
    rng = random.Random(seed)
    day = lambda n: START + timedelta(days=n, seconds=rng.choice([0, 0, 1, -1]))
    points = [(day(rng.randrange(400)), i) for i in range(150)] + [(None, -1), (day(0), 900), (day(0), 900)]
    spans = []
    for i in range(200):
        a = rng.randrange(-100, 500)
        spans.append((f"A{i}", day(a), rng.choice([None, day(a + rng.choice([0, -3, 1, 2, 30, 700]))])))
    spans += [("null start", None, day(9)), ("all", day(-900), None), ("instant", points[0][0], points[0][0]), ("tiny", points[0][0], points[0][0] + timedelta(microseconds=1))]
    got = interval_join(spark.createDataFrame(points, "instant timestamp, n int"), spark.createDataFrame(spans, "canonical string, listed_at timestamp, delisted_at timestamp"),
                        "instant", "listed_at", "delisted_at")
    want = Counter((p, n, c, s, e) for p, n in points for c, s, e in spans if p and s and s <= p and (e is None or p < e))
    assert Counter(tuple(r) for r in got.select("instant", "n", "canonical", "listed_at", "delisted_at").collect()) == want and len(want) > 1000


def test_active_assets_compare_no_pairs_of_rows(spark):
    instants = spark.createDataFrame([(START + timedelta(days=i),) for i in range(30)], "instant timestamp")
    segments = spark.createDataFrame([(f"A{i}", START + timedelta(days=i), None) for i in range(40)], "canonical string, listed_at timestamp, delisted_at timestamp")
    live = active_assets(segments, instants)
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert live.count() == sum(i + 1 for i in range(30))
    assert active_assets(segments.limit(0), instants).count() == active_assets(segments, instants.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [64, 100, 640])
def test_ranges_are_even_whatever_the_outlier(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "RANGE_ROWS", rows)
    rng = random.Random(rows)
    values = [1 + rng.random() * 1e-9 for _ in range(6000)] + [1e12, -1e12, float("inf")] + [1.0] * 3000
    frame = spark.createDataFrame([("bar", v) for v in values] + [("small", 1.0), ("small", None)], "g string, v double")
    ranges = R.value_ranges(frame, ["g"], "v").collect()
    sizes = Counter(r.value_range for r in ranges if r.g == "bar")
    assert max(sizes.values()) <= 2 * rows and len(sizes) >= len(set(values)) // rows // 2
    order = sorted(set(values))
    assert [r.v for r in sorted((r for r in ranges if r.g == "bar"), key=lambda r: (r.value_range, r.v))] == order
    placed = {r.v: r.rows_before for r in R.value_positions(frame, ["g"], "v").where("g = 'bar'").collect()}
    copies, before, want = Counter(values), 0, {}
    for v in order:
        want[v] = before
        before += copies[v]
    assert placed == want


def walk(bars):
    """Bar by bar: a holding ends at the next due bar or where its last leg has vanished."""
    out = []
    for book in {b[0] for b in bars}:
        own = sorted(b[1:] for b in bars if b[0] == book)
        at = 0
        while at < len(own):
            idx, _, gone = own[at]
            ends = [i for i, due, _ in own if due and i > idx][:1] + ([gone] if gone is not None else [])
            stop = min(ends, default=None)
            out.append((book, idx, stop))
            if stop is None:
                break
            at = next((k for k, b in enumerate(own) if b[0] >= stop), len(own))
    return Counter(out)


def test_rebalances_follow_the_walk(spark):
    rng = random.Random(5)
    bars = []
    for book in range(60):
        due, gone = rng.choice([0, .05, .3, 1]), rng.choice([1, 2, 9, 60])
        for i in range(80):
            if rng.random() < .9:
                bars.append((f"b{book}", i, rng.random() < due, i + rng.randint(1, gone) if rng.random() < .98 else None))
    got = rebalances(spark.createDataFrame(bars, "book_id string, idx long, due boolean, gone_idx long"))
    want = walk(bars)
    assert Counter(map(tuple, got.collect())) == want and max(Counter(b for b, _, _ in want).values()) > 40
    assert rebalances(spark.createDataFrame([], "book_id string, idx long, due boolean, gone_idx long")).count() == 0


def test_choices_of_groups_follow_from_their_numbers(spark):
    for g in range(2, 13):
        for k in range(1, g):
            got = group_choices(spark, g, k).collect()
            assert [r["fold_id"] for r in got] == list(range(len(got))) and [tuple(r["test_groups"]) for r in got] == list(itertools.combinations(range(g), k)), (g, k)


def test_gap_points_near_overlapping_migrations_are_counted_once(spark):
    rng = random.Random(5)
    day = datetime(2021, 1, 1)
    for step_hours in (24, 8, 5):
        step = timedelta(hours=step_hours)
        moves = [(f"OLD{i}USDT", "AAA", day + timedelta(hours=rng.randrange(0, 24 * 90))) for i in range(6)]
        blocks = [(a, day + step * s, day + step * (s + n - 1)) for a in ("AAAUSDT", "BBBUSDT") for s, n in ((3, 1), (10, 40), (70, 25))]
        dim = spark.createDataFrame(moves, "legacy string, canonical string, effective timestamp")
        bars = spark.createDataFrame([("AAAUSDT", day), ("BBBUSDT", day)], "asset string, timestamp timestamp")
        frame = spark.createDataFrame(blocks, "asset string, gap_start timestamp, gap_end timestamp")
        got = {r["asset"]: (r["missing"], r["near_migration"]) for r in gap_summary(bars, frame, dim, 7, step_hours * 3600).collect()}
        points = [low + step * i for a, low, high in blocks if a == "AAAUSDT" for i in range((high - low) // step + 1)]
        near = sum(any(abs(p - at) <= timedelta(days=7) for _, _, at in moves) for p in points)
        assert got == {"AAAUSDT": (66, near), "BBBUSDT": (66, 0)} and 0 < near < 66


def test_funding_files_of_any_width(spark, tmp_path):
    more = ",".join(f"x{i}" for i in range(30))
    (tmp_path / "AAAUSDT-fundingRate-2021-01.csv").write_text(f"{more},calc_time,last_funding_rate\n" + ",".join("9" * 30) + ",1609459200000,0.25\n")
    (tmp_path / "BBBUSDT-fundingRate-2021-01.csv").write_text("fundingRate,fundingTime\n0.5,1609459200000\n")
    assert {r["source"]: r["funding_rate"] for r in read_funding(spark, str(tmp_path)).collect()} == {"AAAUSDT": 0.25, "BBBUSDT": 0.5}
