"""Repeated byte windows against a dictionary of all windows."""

import random

import pytest

from panelwright.llm import repeated_windows as rw

SCHEMA = "doc_id long, text string, chunk string, bucket long, removed string"


def brute(rows, depth):
    least = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        key = (i is None, i or 0)
        for p in range(len(data) - depth + 1):
            w = data[p:p + depth]
            least[w] = min(least.get(w, key), key)
    out = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - depth + 1):
            if least[data[p:p + depth]] < (i is None, i or 0):
                gone[p:p + depth] = b"\1" * depth
        spans, p = [], 0
        while p < len(data):
            q = p
            while q < len(data) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((i, len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, depth):
    got = rw.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), depth).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in got), key=repr)


@pytest.mark.parametrize("depth,seed", [(50, 1), (20, 2), (64, 3)])
def test_random_texts_with_shared_passages(spark, monkeypatch, depth, seed):
    monkeypatch.setattr(rw, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(rw, "BUCKET_BYTES", 9000)
    rng = random.Random(seed)
    word = lambda: rng.choice(["der", "été", "a", "ing", "the", "ou", "\n", "é"]) + rng.choice([" ", "", "tion"])
    passages = ["".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for i in range(90):
        text = "".join(rng.choice(passages)[rng.randrange(9):] if rng.random() < .2 else word() for _ in range(rng.randrange(40)))
        rows.append((rng.randrange(60), text, "x", i, "y"))
    rows += [(None, passages[0] * 2, "x", 1, "y"), (None, passages[0], "x", 1, "y"), (7, None, "x", 1, "y"), (8, "", None, None, None), (1000, rows[3][1], "x", 0, "y"),
             (1000, rows[3][1], "x", 0, "y"), (-5, "a" * 300, "x", 0, "y"), (3, "b" + "a" * 400, "x", 0, "y"), (2000, "a" * depth, "x", 0, "y"), (2001, "a" * (depth - 1), "x", 0, "y")]
    assert run(spark, rows, depth) == brute(rows, depth)


def test_a_very_long_text_and_pieces(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, long, "x", 0, "y"), (2, "zz" + long[1_048_500:1_048_700] + "zz", "x", 0, "y"), (3, long, "x", 0, "y")]
    got = run(spark, rows, 50)
    assert [(r[0], r[2]) for r in got] == [(1, []), (2, [(2, 202)]), (3, [(0, len(long))])]


def test_an_empty_table(spark):
    assert run(spark, [], 50) == []
