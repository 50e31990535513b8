"""Segments against all intervals, and held-out accuracy."""

import random

import numpy as np

from panelwright.llm import toxicity as tx
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, toxic int, score string, labelled long"


def brute_segments(values):
    """Split at the best interval, then look left and right of it, as maximal segments are defined."""
    def best(low, high):
        top = (0.0, None)
        for a in range(low, high):
            total = 0.0
            for z in range(a, high):
                total += values[z]
                if total > top[0] + 1e-9 or (top[1] and abs(total - top[0]) < 1e-9 and z + 1 - a < top[1][1] - top[1][0]):
                    top = (total, (a, z + 1))
        return top

    out, todo = [], [(0, len(values))]
    while todo:
        low, high = todo.pop()
        score, at = best(low, high)
        if at:
            out.append((*at, round(score, 6)))
            todo += [(low, at[0]), (at[1], high)]
    return sorted(out)


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        rest = -rng.choice([0.31, 0.97])
        values = [rng.choice([rest, rest, rest, rng.uniform(0.1, 4)]) for _ in range(rng.randrange(30))]
        place = np.array([i for i, v in enumerate(values) if v != rest], int)
        got = tx.maximal_segments(place, np.array([values[i] for i in place]), rest)
        assert sorted((a, z, round(s, 6)) for a, z, s in got) == brute_segments(values)


def corpus(n=500):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["der", "the", "und", "été", "ing", "on", "w%d" % rng.randrange(3000)]) for _ in range(rng.choice([5, 40, 300, 2000]))]
        toxic = rng.random() < .2
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["Idiot!", "(scum)", "trash,", "loser", "verblödet" + rng.choice("abcde")]) for _ in range(4)]
        rows.append((i, " ".join(words), 1, "x", 9))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(None, "you idiot scum loser trash", 1, "x", 9), (9000, None, None, None, None), (9001, "", 1, "x", 9), (9002, "the " * 200000, 1, "x", 9), (9002, "the " * 10, 1, "x", 9), (9003, " \n!?", 1, "x", 9)]
    label = spark.createDataFrame(labels + [(3, None), (None, 1), (4, 7), (77777, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = tx.toxicity(docs, label).withColumn("held", tx.held_out()).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held and r.doc_id in truth]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    assert len(held) > 60 and right >= 0.97 * len(held)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert by[None, 5].score > 0.5 and by[None, 5].passages and all(by[k].score < 0.5 for k in ((9000, 0), (9001, 0), (9002, 200000), (9002, 10), (9003, 0)))
    again = {(r.doc_id, r.n_tokens): r.score for r in tx.toxicity(docs.repartition(5), label).collect()}
    assert again == {k: r.score for k, r in by.items()}


def test_held_out_labels_do_not_change_a_score(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    label = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = label.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    runs = [sorted((r.doc_id, r.score) for r in tx.toxicity(docs, x).collect()) for x in (label, flipped)]
    assert runs[0] == runs[1]


def test_empty_tables_and_one_class(spark):
    label = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.toxicity(spark.createDataFrame([], SCHEMA), label).count() == 0
    docs = spark.createDataFrame([(1, "a b", 1, "x", 9)], SCHEMA)
    for x in (label, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")):
        assert [r.score < 0.5 for r in tx.toxicity(docs, x).collect()] == [True]


def test_only_labels_that_can_be_in_the_sample_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(tx, "SAMPLE_DOCS", 200)
    label = spark.range(6000).select(F.col("id").alias("labelled"), (F.col("id") % 20 == 0).cast("int").alias("toxic"))
    ranked = tx._least_hashes(label).collect()
    rows = label.withColumn("hash", F.xxhash64("labelled")).collect()
    for toxic in (0, 1):
        own = sorted((r.hash, r.labelled) for r in ranked if r.toxic == toxic)
        assert own[:200] == sorted((r.hash, r.labelled) for r in rows if r.toxic == toxic)[:200] and 200 <= len(own) < 400
    few = label.where("labelled < 100")
    assert tx._least_hashes(few).count() == 100 and tx._least_hashes(few.where("toxic = 7")).count() == 0


def test_repeated_rows_of_a_labelled_document_count_once(spark):
    rows, labels = corpus(200)
    label = spark.createDataFrame(labels, "doc_id long, toxic int")
    again = rows + [r for r in rows[:20] for _ in range(30)] + [(rows[0][0], None, *rows[0][2:])]
    models = [tx.fit(tx.id_and_text(spark.createDataFrame(x, SCHEMA)), label) for x in (rows, again[:-1])]
    assert (models[0].tokens == models[1].tokens).all() and (models[0].weights == models[1].weights).all() and models[0].middle == models[1].middle
    assert len(tx.fit(tx.id_and_text(spark.createDataFrame(again, SCHEMA)), label).tokens)
