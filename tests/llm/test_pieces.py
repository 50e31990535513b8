"""Merge dropout: the model's own segmentation without it, a plain agenda with it, and exact round trips."""

import random

import numpy as np
import pytest
import sentencepiece

from panelwright.llm import pieces as pc

PATH = pc.model_path()
SCHEMA = "doc_id long, text string, pieces string, lossless int, pass string"


def texts(seed=1):
    rng = random.Random(seed)
    syllables = ["th", "er", "ing", "é", "ße", "tion", "ñ", "ou", "日本", "▁", "\n", "\t", "  ", " ", ".", "😀", "X", "\x00", " ", "(\r", "1"]
    return ["", " ", "▁", " lead", "trail  ", "a▁b ▁", "hello  world", "ﬁ ½ Ａ", "      x", "x" * 3000, " " * 500, "ab" * 400 + "é"] + [
        "".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_whole_table_with_odd_rows(spark):
    rows = [(i, t, "x", 1, "x") for i, t in enumerate(texts(3))] + [(None, "null id", "x", 1, "y"), (7, None, None, None, None), (8, "same", "x", 1, "a"), (8, "same", "x", 1, "b"), (9, "wörd " * 40000, "x", 1, "z")]
    got = pc.encode_occurrences(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert {len(r.pieces) for r in got if not r.text} == {0}
    own = pc.OccurrenceEncoder(PATH, 0.1, 17)
    for r in got:
        assert r.pieces == own.encode([r.doc_id], [r.text])[0].tolist()


def test_an_empty_table(spark):
    assert pc.encode_occurrences(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_a_wrong_cut_is_not_lossless():
    own = pc.OccurrenceEncoder(PATH, 0.1, 17)
    parts = own.encode([1, 2, 3], ["one two", "", "é▁"])
    assert own.lossless(parts, ["one two", "", "é▁"]) == [True] * 3 and own.lossless(parts, ["one tw", "a", "é "]) == [False] * 3


def plainly(m, unit, key, rate):
    """The cut of one occurrence: the best candidate of each step is kept or skipped for good."""
    left = [(i, k) for k, i in enumerate(m.symbols([unit])[0].tolist())] + [(None, -1)]
    skipped, step, nth = set(), 0, 0
    skip_at = pc.kept_before_skip(key, 0, rate)[0]
    while True:
        found = [(m.rank[p], k, a) for a, ((i, k), (j, k2), (_, k3)) in enumerate(zip(left, left[1:], [*left[2:], (None, -2)]))
                 if (p := m.pairs.get((i, j))) is not None and (k, k2, k3) not in skipped]
        if not found:
            return [m.byte[i - m.size] if i >= m.size else i for i, _ in left[:-1]]
        a = min(found)[2]
        if step == skip_at:
            skipped.add((left[a][1], left[a + 1][1], left[a + 2][1]))
            nth += 1
            skip_at = step + 1 + pc.kept_before_skip(key, nth, rate)[0]
        else:
            left[a:a + 2] = [(m.pairs[left[a][0], left[a + 1][0]], left[a][1])]
        step += 1


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_occurrences_against_a_plain_agenda(rate, monkeypatch):
    some = texts(4)
    got = pc.OccurrenceEncoder(PATH, rate, 3).encode(list(range(len(some))), some)
    m = pc.model(PATH)
    for i, (text, cut) in enumerate(zip(some, got)):
        assert pc.decode(m, cut.tolist()) == text
        units = pc.units_of(text)
        if all(len(u) < 1000 for u in units):
            keys = [pc.stir(pc.document_keys([i], [text], [0], 3) + pc.stir(np.array([k], np.uint64))) for k in range(len(units))]
            assert cut.tolist() == [p for u, key in zip(units, keys) for p in plainly(m, u, key, rate)], text
    monkeypatch.setattr(pc, "CUTS", 50)
    forgetful = pc.OccurrenceEncoder(PATH, rate, 3)
    assert all(forgetful.encode([i], [t])[0].tolist() == got[i].tolist() for i, t in enumerate(some))
    if not rate:
        library = sentencepiece.SentencePieceProcessor(model_file=PATH)
        assert all(g.tolist() == library.encode(t) for t, g in zip(some, got) if "▁" not in t)


def test_occurrences_documents_and_passes_are_cut_differently(spark):
    word = "internationalization"
    docs = spark.createDataFrame([(i, " ".join([word] * 200), p) for i in range(3) for p in (0, 1)] + [(None, f"{word} {word}", 0)], "doc_id long, text string, pass long")
    rows = {(r.doc_id, n): r for n, r in enumerate(pc.encode_occurrences(docs, PATH, pass_col="pass").collect())}
    assert all(r.lossless for r in rows.values()) and len({tuple(r.pieces) for r in rows.values()}) == 7
    m, cuts = pc.model(PATH), set()
    for r in rows.values():
        line = []
        for p in r.pieces:
            if m.bytes[p].startswith(b" ") and line:
                cuts.add(tuple(line))
                line = []
            line.append(p)
    assert len(cuts) > 10
    assert [r.pieces for r in pc.encode_occurrences(docs.repartition(5), PATH, pass_col="pass").orderBy("doc_id", "pieces").collect()] == [r.pieces for r in pc.encode_occurrences(docs, PATH, pass_col="pass").orderBy("doc_id", "pieces").collect()]


def test_registered_queries_and_the_mix_cut_anew(spark, tmp_path):
    import corpus_pipeline as cp
    from panelwright.llm.queries import QUERIES

    text = "internationalization " * 60
    spark.createDataFrame([(i, text, "en", "s0", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op10_merge_dropout"](spark, str(tmp_path)).collect()
    assert len({tuple(r.pieces) for r in got}) == 4
    docs = spark.createDataFrame([(i, f"{text}w{i}", "en", "s0", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    mix = cp.mixture(spark, docs, str(tmp_path))
    assert len(mix.columns) == 6
    whole = [r for r in cp.pieces(spark, mix, str(tmp_path)).collect()]
    twice = [i for i in range(4) if sum(r.doc_id == i for r in whole) == 2]
    assert twice and len({tuple(r.pieces) for r in whole}) == len(whole)
