"""Patricia-trie owners against a dictionary."""

import hashlib
import random
from collections import defaultdict

from panelwright.llm.exact_dedup import SPACE, Trie, exact_dedup, keep_one_of_each

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, kept boolean"


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in (r[1] or "") if c.encode() not in [bytes([b]) for b in SPACE])].append(r)
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            out.append((r[0], best[0], len(members), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_a_trie_with_no_memory_spills_every_subtree_and_loses_nothing():
    rng = random.Random(7)
    keys = [b"".join(rng.choice([b"a", b"b", b"ab", b"common prefix "]) for _ in range(rng.randrange(9))) for _ in range(3000)] + [b"", b"x" * 5000, b"x" * 5000 + b"y"]
    want: dict = {}
    trie = Trie(limit=3000)
    for i, key in enumerate(keys):
        end = (rng.randrange(4), rng.choice([None, i]), 1)
        trie.insert(key, end)
        want.setdefault(key, []).append(end)
    assert trie.spilled
    got = dict(trie.owners())
    assert set(got) == set(want)
    for key, ends in want.items():
        points, owner, _ = min(ends, key=lambda e: (-e[0], e[1] is None, e[1] or 0))
        assert got[key] == (points, owner, len(ends))


def test_blank_null_long_and_repeated_rows(spark):
    long = "wörter " * 40000
    rows = [(3, "a b", "en", "s", 1, 9, True), (2, "ab", "en", "s", 1, 9, True), (5, "a  b", None, None, None, None, None), (1, None, "en", "s", 1, 9, True),
            (4, " \t\n\x0b\x0c\r", "en", "s", 1, 9, True), (None, "zz", "en", "s", 1, 9, True), (9, "zz", "en", "s", 1, 9, True), (7, long, "en", "s", 1, 9, True),
            (8, long.strip(), "en", "s", 1, 9, True), (6, "tie", "en", "s", 1, 9, True), (6, "tie", "en", "s", 1, 9, True), (10, "a\u00a0b", "en", "s", 1, 9, True), (None, "alone", "x", "y", 1, 1, False)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    assert sorted((r.doc_id for r in got if r.kept), key=repr) == sorted([5, 4, 9, 7, 6, 10, None], key=repr)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([5, 4, 9, 7, 6, 10, None], key=repr)


def test_an_empty_table_gives_an_empty_result(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
