"""The shingle join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from panelwright.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, id string, component long, a long"


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, num, den):
    sets = [(r[0], shingle_set(r[1], n)) for r in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    named = [(i, s) for i, s in sets if i is not None and s]
    for (i, s), (j, t) in combinations(named, 2):
        if den * len(s & t) >= num * len(s | t):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("n,num,seed", [(4, 85, 1), (5, 80, 2)])
def test_near_copies_of_all_sizes(spark, monkeypatch, n, num, seed):
    monkeypatch.setattr(jj, "BATCH_DOCS", 40)
    monkeypatch.setattr(jj, "BUCKET_BYTES", 20000)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    common = [word() for _ in range(40)]
    rows, ids = [], list(range(400))
    rng.shuffle(ids)
    while len(ids) > 10:
        words = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 11, 15, 20, 40, 90, 300]))] + common * rng.randrange(2)
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            if len(ids) > 10:
                copy = list(words)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 4]) * (1 + len(words) // 60)):
                    at = rng.randrange(len(copy)) if copy else 0
                    copy[at:at + 1] = rng.choice([[word()], [], [word(), word()]])
                rows.append((ids.pop(), rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < .1 and w.isascii() else w for w in copy), "x", 1, 2))
    rows += [(ids.pop(), None, "x", 1, 2), (ids.pop(), "", "x", 1, 2), (ids.pop(), " \n", "x", 1, 2), (None, rows[0][1], "x", 1, 2), (None, None, "x", None, 2), rows[5],
             (ids.pop(), "x" * 200000, None, None, None), (ids.pop(), " ".join(word() for _ in range(60000)), "x", 1, 2)]
    got = jj.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), n, num).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n, num, 100)


def test_any_two_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for size in [*range(1, 60), 80, 150, 400, 1000]:
        for _ in range(30):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            most = len(base) * 15 // 85
            cut = rng.integers(0, most + 1)
            other = np.delete(base, rng.choice(len(base), min(cut, len(base) - 1), replace=False))
            other = np.unique(np.r_[other, rng.integers(0, 2**63, rng.integers(0, most + 1), dtype=np.uint64)])
            both = len(np.intersect1d(base, other))
            if 100 * both >= 85 * (len(base) + len(other) - both):
                assert len(np.intersect1d(jj.signatures(base, 85, 100), jj.signatures(other, 85, 100)))


def test_an_empty_table(spark):
    assert jj.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bitmaps_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    for size in (1, 3, 50, 700, 5000):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        other = np.unique(np.r_[base[rng.integers(0, size // 2 + 1):], rng.integers(0, 2**63, rng.integers(0, size), dtype=np.uint64)])
        bits = int(np.bitwise_count((jj.bitmap(base) ^ jj.bitmap(other)).view("<u8")).sum())
        assert bits <= len(np.setxor1d(base, other))
