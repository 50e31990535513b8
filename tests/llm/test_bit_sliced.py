"""Top-k over the bit-sliced index against all inner products."""

import math
import random

from panelwright.llm import bit_sliced as bs

SCHEMA = "vec_id long, embedding array<float>, label int, block long, ids string, values string"


def brute(rows, every, k):
    own = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows
           if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, q in own:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in own if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_ties_signs_lengths_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(bs, "BLOCK_ROWS", 60)
    rng = random.Random(4)
    grid = lambda: rng.choice([-1, 1]) * rng.choice([0.0, .25, .5, .125, 2.0, 0.0625])
    rows = [(i, [grid() for _ in range(6)], 1, 2, "x", "y") for i in range(300)]
    rows += [(1000 + i, [1.0] * 6, 1, 2, "x", "y") for i in range(40)] + [(2000 + i, [grid() for _ in range(3)], None, None, None, None) for i in range(3)]
    rows += [(-10, [-3.0] * 6, 1, 2, "x", "y"), (3000, None, 1, 2, "x", "y"), (3010, [1.0, None] * 3, 1, 2, "x", "y"), (3020, [float("nan")] * 6, 1, 2, "x", "y"),
             (3030, [float("inf")] * 6, 1, 2, "x", "y"), (None, [9.0] * 6, 1, 2, "x", "y"), (4000, [0.0] * 6, 1, 2, "x", "y"), (5000, [1.0] * 700, 1, 2, "x", "y"), (5010, [-120000.5] * 700, 1, 2, "x", "y")]
    got = bs.top_k(spark.createDataFrame(rows, SCHEMA), every=10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 10, 5)


def test_an_empty_table(spark):
    assert bs.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
