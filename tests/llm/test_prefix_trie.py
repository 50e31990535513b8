"""The trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from panelwright.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, shard int, n long"


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -((-c) % 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in sorted(built.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        worth = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += worth
    return Counter((who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(str(c) for c in who if len(built[c]) == len(node)).encode()).hexdigest()) for node, who in members.items())


def data(seed, n=120):
    rng = random.Random(seed)
    texts = ["", "a", "b", "é", None, "long " * 50]
    rows = []
    for c in rng.sample(range(-60, 200), n):
        same = rng.random() < .4
        rows += [(c, None if i == 0 and rng.random() < .3 else i, ("user", "assistant", None)[i % 2 if rng.random() < .9 else 2], "same" if same else rng.choice(texts)) for i in range(rng.choice([1, 2, 3, 8, 9, 14]))]
    rows += [(1000, 1, "user", "x")] * 3 + [(None, 1, "user", "x"), (1001, 5, "b", "t"), (1001, 5, "a", "t"), (1001, 5, "a", None), (2000, 0, "user", "only")]
    rows += [(c, i, "user", f"step {i}" if i < 37 or c == 3000 else f"other {c % 2} {i}") for c in (3000, 3005, 3006, 3007) for i in range(41)]
    return rows


@pytest.mark.parametrize("segment,shard", [(256, 4096), (4, 7)])
def test_every_node(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(pt, "SEGMENT", segment)
    monkeypatch.setattr(pt, "SHARD", shard)
    rows = data(4)
    got = pt.conversation_trie(spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    have, want = Counter(map(tuple, got.collect())), brute(rows)
    assert have == want and len(want) > 300


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", "hot") for c in range(300) for t in range(9)]
    assert Counter(map(tuple, pt.conversation_trie(spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA)).collect())) == brute(rows)


def test_an_empty_table(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
