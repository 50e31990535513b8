"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every window of ``w`` successive k-grams the least hash is kept. A span of ``span`` = k + w - 1 words holds one such window, so two texts
that share it keep the same hash there. Hashes of documents meet those of the benchmark; where they do, the words of the window decide.
An item of fewer words than ``span`` is one window of all its words, found in the same way with a span of its own length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.session import materialise

#: Words of a shared window.
SPAN = 10
#: What separates words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda word: word != "")


def shape(span: int) -> tuple[int, int]:
    """Words of a gram, and grams of a window, for spans of so many words."""
    k = (span + 1) // 2
    return k, span - k + 1


def least_hashes(words: Column, span: int) -> Column:
    """For every window of ``span`` words, in order, the least hash of its grams."""
    k, w = shape(span)
    several = lambda values: F.least(*values) if len(values) > 1 else values[0]
    gram = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
    least = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: several([g[i + j] for j in range(w)]))
    return F.when(F.size(words) >= span, let(F.transform(words, lambda word: F.xxhash64(word)), lambda h: let(gram(h), least))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(rows: DataFrame, words: Column, span: int) -> DataFrame:
    """(k1, k2, span, f, at): ``f`` is the least hash of the window that begins at ``at``, and of some of the w - 1 windows before it.

    A hash is kept where the next window has another one, and at every w-th window of a long run.
    """
    w = shape(span)[1]
    kept = lambda m: F.transform(m, lambda f, i: F.when(F.get(m, i + 1).isNull() | (f != F.get(m, i + 1)) | (i % w == 0), f))
    each = rows.select("k1", "k2", F.posexplode(let(let(words, lambda x: least_hashes(x, span)), kept)))
    return each.where("col is not null").select("k1", "k2", F.lit(span).alias("span"), F.col("col").alias("f"), (F.col("pos") + 1).alias("at"))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(span, gram, f, items): every distinct window of the items, its fingerprint and the ids of the items that hold it."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), words_of(benchmark[text_col]).alias("words")).where("size(words) > 0")
    size = F.least(F.size("words"), F.lit(span))
    grams = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("words"))
    windows = grams.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("span", F.size("words"))
    own = F.coalesce(*[F.when(F.col("span") == n, least_hashes(F.col("words"), n)[0]) for n in range(1, span + 1)])
    return windows.select("span", F.array_join("words", " ").alias("gram"), own.alias("f"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", benchmark_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hits (array of (begin, end) in words, merged), items (sorted ids as strings) for every row.

    * A null or empty text has no words, and no hits. An item without words is in no document.
    * An item without an id makes hits but is not listed.
    * A null doc_id is a document like any other; rows that repeat doc_id and text get the same result each.
    * An empty table of documents gives an empty result, an empty benchmark no hits. Other columns, whatever their names, are left behind.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(13), "text", "doc_id").alias("k2"))
    windows = materialise(benchmark_windows(benchmark, span, item_col, benchmark_text_col))
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most ``span`` numbers
    sizes = rows.select("doc_id", "k1", "k2", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    if not spans:
        none = F.array().cast("array<struct<begin:int,end:int>>")
        return sizes.select("doc_id", "n_words", none.alias("hits"), F.array().cast("array<string>").alias("items"))

    prints = reduce(DataFrame.union, [fingerprints(rows, words_of(F.col("text")), n) for n in spans])
    met = prints.join(windows.select("span", "f").distinct(), ["span", "f"])
    met = materialise(met.groupBy("k1", "k2").agg(F.collect_set(F.struct("span", "at")).alias("met")))

    # Joined in one way at every size: what is dealt out then grows as the input does.
    suspects = rows.join(met.hint("merge"), ["k1", "k2"]).select("k1", "k2", words_of(F.col("text")).alias("words"), "met")
    begins = F.array_distinct(F.flatten(F.transform("met", lambda m: F.transform(
        F.sequence(F.greatest(F.lit(1), m["at"] - m["span"] + F.floor((m["span"] + 1) / 2).cast("int")), m["at"]), lambda i: F.struct(i.alias("begin"), m["span"].alias("span"))))))
    starts = suspects.select("k1", "k2", F.explode(let(F.col("words"), lambda words: F.transform(begins, lambda at: F.struct(
        at["begin"].alias("begin"), at["span"].alias("span"), F.array_join(F.slice(words, at["begin"], at["span"]), " ").alias("gram"))))).alias("window"))
    hits = starts.select("k1", "k2", "window.*").join(windows.select("span", "gram", "items"), ["span", "gram"])
    hits = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("span")).alias("end")))).alias("spans"),
                                        F.collect_set("items").alias("items"))
    fresh = F.filter(F.transform("spans", lambda s, i: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), i.alias("i"))),
                     lambda s: (s["i"] == 0) | (s["begin"] > F.get("reach", s["i"] - 1)))
    # How far the spans up to each one reach: a window begins at a word once per length, and lengths are at most ``span``.
    hits = hits.select("k1", "k2", "spans", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    reach = F.transform("spans", lambda s, i: F.array_max(F.transform(F.slice("spans", F.greatest(i + 2 - span * len(spans), F.lit(1)), F.least(i + 1, F.lit(span * len(spans)))), lambda t: t["end"])))
    hits = hits.withColumn("reach", reach).withColumn("fresh", fresh)
    merged = F.transform("fresh", lambda s, j: F.struct(s["begin"].alias("begin"), F.get("reach", F.coalesce(F.get("fresh", j + 1)["i"], F.size("spans")) - 1).alias("end")))
    hits = hits.select("k1", "k2", merged.alias("hits"), "items")
    out = sizes.join(hits, ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<struct<begin:int,end:int>>")).alias("hits"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))
