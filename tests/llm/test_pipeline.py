"""Every stage of the pipeline against a plain version, on a small table with nulls, blanks, copies and toxic rows."""

import random
from collections import Counter

import corpus_pipeline as cp
from panelwright.llm import toxicity as tx
from panelwright.llm.pieces import decode, model

from .test_exact_dedup import SPACE
from .test_jaccard_join import brute as near
from .test_mixing import water


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(260):
        words = [rng.choice(["der", "the", "und", "été", "w%d" % rng.randrange(4000)]) for _ in range(rng.choice([3, 30, 120, 600]))]
        toxic = rng.random() < .2
        if toxic:
            words[1:1] = [rng.choice(["idiot", "scum", "trash", "loser"]) for _ in range(5)]
        rows.append((i, " ".join(words), "en", f"s{rng.randrange(4)}", 7, toxic))
    for i in range(260, 330):
        words = rows[rng.randrange(40)][1].split()
        if i % 2:
            words[-1:] = ["changed"]
        rows.append((i, rng.choice([" ", "\n"]).join(words), "en", rng.choice(["s0", None]), 7, rows[0][5]))
    rows += [(400, None, "en", "s1", 0, False), (401, "", "en", "s1", 0, False), (None, "a null id", None, None, None, False), (402, "lone" * 30000, "en", "s2", 1, False), (403, "word " * 30000, "en", "s2", 1, False)]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in rows], ddl).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[5])) for r in rows[:260]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, docs, names = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact dedup", "near duplicates", "mixture", "pieces"]
    outs = []
    for name, stage in cp.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs.append(docs.collect())
    key = lambda r: (r[0] is None, r[0] or 0)
    clean, exact, one, mix, encoded = [sorted(o, key=key) for o in outs]
    truth = {r[0]: r[5] for r in rows[:260]}
    assert all(not truth[r.doc_id] for r in clean if r.doc_id in truth and r.doc_id % 1 == 0) and {r[0] for r in rows[:260] if not r[5]} <= {r.doc_id for r in clean}
    blank = str.maketrans("", "", SPACE.decode())
    best = {}
    for r in clean:
        t = (r.text or "").translate(blank)
        if t not in best or (-len(r.text or ""), key(r)) < (-len(best[t].text or ""), key(best[t])):
            best[t] = r
    assert exact == sorted(best.values(), key=key)
    component = {i: c for i, _, c in near([tuple(r) for r in exact], 5, 80, 100)}
    assert one == [r for r in exact if r.doc_id is None or component[r.doc_id] == r.doc_id]
    sizes, taken, whole = Counter(), Counter(), {r.doc_id: r for r in one}
    for r in one:
        sizes[r.source] += len((r.text or "").split())
    for r in mix:
        taken[r.source] += len(r.text.split())
        assert r.lang == whole[r.doc_id].lang and r.n_chars == len(r.text)
    for s, want in water(sizes).items():
        assert abs(taken[s] - want) <= 0.5 + 1e-6
    m = model(cp.model_path())
    assert Counter((r.doc_id, r.text) for r in mix) == Counter((r.doc_id, decode(m, r.pieces)) for r in encoded) and all(r.lossless and r.n_pieces == len(r.pieces) for r in encoded)
    again = cp.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.pieces)) for r in again) == Counter((r.doc_id, tuple(r.pieces)) for r in encoded)


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
