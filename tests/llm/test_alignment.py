"""Alignment of whole texts, without units, by brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
import tokenizers

from panelwright.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, links string, n_a int, lang string"


def texts(seed, n=250):
    rng = random.Random(seed)
    parts = ["th", "er", "ing", "é", "ße", "tion", "ñ", "日本", "語", "\n", "\t", "  ", " ", ".", "'s", "'", "😀", "X", "\x1c", "\x85", " ", "　", ";\r", "\r\n", "<s>", "<|endoftext|>", "12", "​", "👩‍👩‍👧", "½", "é", "İ"]
    fixed = ["", " ", "\n", "   ", " lead", "trail  \n", "a▁b", "▁", "hello  world\n\n  foo\t", "x" * 3000, " " * 500 + "y", "日本語" * 300, "a\x00b", "<0x41> <unk>", "it's  'quoted' \n's", "ab " * 4000]
    return fixed + ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(50))) for _ in range(n)]


def brute(data):
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    char = al.byte_of_char()
    out, counts = [], Counter()
    for doc, text in data:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ra = [bytes(char[c] for c in a.id_to_token(i)) for i in ia]
        rb = [bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or not b"".join(ra) == b"".join(rb) == (" " + text).encode():
            out.append((doc, 0, 0, [], ""))
            continue
        ends = [[sum(map(len, r[:i + 1])) for i in range(len(r))] if len(r) < 500 else list(__import__("itertools").accumulate(map(len, r))) for r in (ra, rb)]
        where = [dict(zip(e, range(len(e)))) for e in ends]
        links, groups, x, y = [], [], 0, 0
        for end in sorted(where[0].keys() & where[1].keys()):
            p, q = where[0][end], where[1][end]
            links.append((ia[p], ib[q]))
            groups.append(",".join(map(str, ia[x:p + 1])) + "|" + ",".join(map(str, ib[y:q + 1])))
            x, y = p + 1, q + 1
        counts.update(links)
        out.append((doc, len(ia), len(ib), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (i, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(d, n, m, len(k), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), s) for d, n, m, k, s in out], [k for *_, k, _ in out]


def test_whole_texts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(al, "PART", 2000)
    data = list(enumerate(texts(5))) + [(None, "one two"), (900, None), (901, "one two"), (901, "one two")]
    got = al.align_tokens(spark.createDataFrame([(d, t, "x", 1, "en") for d, t in data], SCHEMA).repartition(3), A, B)
    want, links = brute([(d, t or "") for d, t in data])
    assert Counter(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == Counter(want)
    assert Counter((r.doc_id, tuple((k.a, k.b) for k in r.links)) for r in got.collect()) == Counter((w[0], tuple(k)) for w, k in zip(want, links))
    assert sum(w[1] > 0 for w in want) > 200 and sum(w[1] == 0 for w in want) > 3


def test_forgetting_changes_nothing():
    own, some = al.Aligner(A, B), texts(9, 60)
    whole = list(own.align(some))
    own._forget()
    al_remembered, al.REMEMBERED = al.REMEMBERED, 5
    try:
        assert [r for t in some for r in own.align([t])] == whole
    finally:
        al.REMEMBERED = al_remembered


def test_pairs_are_bounded_by_the_vocabularies():
    assert al.possible_pairs([b"a", b"ba", b"c"], [b"a", b"xa", b"xba"]) == 2 + 1 + 2
    assert al.possible_pairs(*al.vocabularies(A, B)[2:]) < al.MOST_PAIRS


def test_an_empty_table(spark):
    assert al.align_tokens(spark.createDataFrame([], SCHEMA), A, B).count() == 0
