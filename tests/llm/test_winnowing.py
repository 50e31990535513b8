"""Hits against every window of every item, by brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.llm.winnowing import decontaminate, fingerprints

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, k1 long, words string, at int, begin int"
ITEMS = "item_id long, text string, doc_id int, span string, gram int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, items, span=10):
    doc, hit, ids = words(text), set(), set()
    for item, own in items:
        own = words(own)
        n = min(len(own), span)
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if n and tuple(doc[i:i + n]) in grams:
                hit.update(range(i, i + n))
                ids |= {str(item)} if item is not None else set()
    return len(doc), sorted(hit), sorted(ids)


def data(seed, short):
    rng = random.Random(seed)
    vocabulary = ["A", "the", "Of", "née", "É", "x1", "日本", "ab-cd", "é", "w" * 30] + [f"t{i}" for i in range(25)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 25, 40]))) for i in range(12)] + [(12, "the " * 30), (3, text(12)), (None, text(15)), (13, None), (14, "?!")]
    items += [(20 + i, text(n)) for i, n in enumerate((1, 2, 3, 5, 8, 9))] if short else []
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            own = words(rng.choice(items)[1])
            a = rng.randrange(max(len(own), 1))
            parts += [" ".join(own[a:a + rng.choice([4, 9, 10, 11, 50])]).upper() if rng.random() < .5 else " ".join(own[a:]), text(rng.randrange(5))]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "the " * 400), (None, items[0][1]), (103, items[1][1]), (103, items[1][1]), (103, items[2][1]), (104, "z " * 5000 + items[4][1])]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
def test_hits_and_items_are_those_of_brute_force(spark, short):
    docs, items = data(7 + short, short)
    got = decontaminate(spark.createDataFrame([(*d, "i", 1, "w", 2, 3) for d in docs], DOCS), spark.createDataFrame([(*i, 1, "s", 2) for i in items], ITEMS))
    assert got.columns == ["doc_id", "n_words", "hits", "items"]
    have = Counter((r.doc_id, r.n_words, tuple(p for b, e in r.hits for p in range(b - 1, e - 1)), tuple(r["items"])) for r in got.collect())
    want = Counter((d, n, tuple(hit), tuple(ids)) for d, t in docs for n, hit, ids in [brute(t, items)])
    assert have == want
    assert sum(bool(k[2]) for k in want) > 12


def test_every_span_keeps_a_fingerprint_in_common(spark):
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(10)]
    rows = [(i, 0, [f"a{rng.randrange(99)}" for _ in range(rng.randrange(30))] + shared + [f"b{rng.randrange(99)}" for _ in range(rng.randrange(30))]) for i in range(50)]
    found = fingerprints(spark.createDataFrame(rows, "k1 long, k2 long, words array<string>"), F.col("words"), 10)
    of = {}
    for r in found.collect():
        of.setdefault(r.k1, set()).add(r.f)
    assert len(of) == 50 and set.intersection(*of.values())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate(docs, items).collect()] == [(1, 2, [], [])]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
