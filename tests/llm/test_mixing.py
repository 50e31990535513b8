"""Targets against water-filling by rounds; exact totals, caps and reruns of a mix."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from panelwright.llm.mixing import Mix, part_of, permuted, round_keys, shard_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, block long, src int"


def water(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        over = [s for s in free if left * weight[s] / sum(weight[t] for t in free) > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())


def rows(seed):
    rng = random.Random(seed)
    out = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 70, 400]))), "en", rng.choice(["a", "a", "a", "b", "é", "Z", None]), 1, "x", 2, 3) for i in range(150)]
    return out + [out[7], out[7], (None, "one two", None, None, None, None, None, None), (500, None, "en", "a", 1, "x", 2, 3), (501, "", "en", "tiny", 1, "x", 2, 3), (502, "lone", "en", "small", 1, "x", 2, 3),
                  (503, "  many\tblanks \n", "en", "b", 1, "x", 2, 3), (504, "word " * 30000, "en", "long", 1, "x", 2, 3)]


def test_targets_totals_and_caps(spark):
    data = rows(1)
    got = Mix(spark.createDataFrame(data, SCHEMA)).counts().collect()
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len((r[1] or "").split())
    want = water(sizes)
    source = {r[0]: r[3] for r in data}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in data)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_reruns_agree_however_the_rows_are_dealt(spark):
    frame = spark.createDataFrame(rows(2), SCHEMA)
    runs = [sorted(map(tuple, Mix(f).pieces().select("shard", "slot", "pass", "src", "start", "from", "to").collect())) for f in (frame, frame.repartition(7))]
    assert runs[0] == runs[1] and len({r[0] for r in runs[0]}) >= 1


def test_the_mix_as_documents_holds_the_words_taken(spark):
    data = rows(3)
    mix = Mix(spark.createDataFrame(data, SCHEMA))
    out = mix.documents()
    assert out.columns == mix.docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").split())
        assert r.n_chars == len(r.text)
    taken = Counter()
    for r in mix.counts().collect():
        taken[r.doc_id] += r.taken
    assert +words == +taken


def test_an_empty_table(spark):
    mix = Mix(spark.createDataFrame([], SCHEMA))
    assert mix.counts().count() == 0 and mix.documents().count() == 0


def test_permutations_of_any_length(spark):
    rows = [(s, n) for s in (1, 2, 900) for n in (1, 2, 3, 64, 331, 1000, 1386)]
    keys = round_keys(F.col("src"), 1, 17)
    at = spark.createDataFrame(rows, "src long, n long").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    there = permuted(F.col("at"), F.col("n"), keys)
    got = defaultdict(dict)
    for r in at.withColumn("there", there).withColumn("back", permuted(F.col("there"), F.col("n"), F.reverse(keys))).collect():
        assert r.back == r["at"]
        got[r.src, r.n][r["at"]] = r.there
    assert all(sorted(p.values()) == list(range(n)) for (_, n), p in got.items())
    for (_, n), p in got.items():
        if n > 300:  # neighbours do not stay together, and half a pass reaches all parts of the stream
            assert sum(abs(p[i + 1] - p[i]) <= 2 for i in range(n - 1)) < n / 20
            assert all(n / 20 < sum(p[i] * 4 // n == q for i in range(n // 2)) < n / 5 for q in range(4))


def test_shards_draw_their_sources_and_totals_are_exact(spark):
    need = {1: 30_000, 2: 7, 3: 9_000, 4: 1, 5: 0, 6: 993}
    got = shard_counts(spark.createDataFrame(list(need.items()), "src int, count long"), seed=3, per_shard=1000).collect()
    numbers, shards = defaultdict(list), defaultdict(Counter)
    for r in got:
        numbers[r.src] += range(r.low, r.high)
        shards[r.shard][r.src] += r.high - r.low
    assert all(sorted(numbers[s]) == list(range(n)) for s, n in need.items())
    assert len(shards) == 41 and all(sum(shards[k].values()) == 1000 for k in range(40)) and sum(shards[40].values()) == 1
    # 1,000 draws at odds of 0.75: standard deviation 13.7. The first shards are drawn freely, the last ones are balanced.
    free = [shards[k][1] for k in range(30)]
    assert all(abs(n - 750) < 70 for n in free) and len(set(free)) > 10
    assert shard_counts(spark.createDataFrame([], "src int, count long")).count() == 0


def test_null_ids_and_multiples_spread_over_the_parts(spark):
    data = [(None if i % 2 else i * 64, f"w{i} x", "en", "a", 1, "x", 2, 3) for i in range(2000)]
    mix = Mix(spark.createDataFrame(data, SCHEMA))
    part = Counter(r[0] for r in mix.sizes.select(part_of(F.col("doc_id"), F.col("text_key"), 64)).collect())
    assert len(part) > 50 and max(part.values()) < 120
