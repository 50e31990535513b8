"""Mixing sources to target weights, with DataFrame functions only.

The documents of a source form one stream of words, cut into blocks of fixed length. A source's target becomes slots: whole
passes over its blocks and a last partial pass. The mix is written in output shards of equally many slots; every shard draws the source of each of
its slots (together: multinomial counts per source). Slots of a source are numbered by cumulated counts of the shards; those drawn
beyond its target, all in its last shards, go to the sources that lack slots, so totals are exact. A keyed permutation of each pass maps
numbers to blocks, and blocks are joined to slots by index. The last slot of a partial pass is cut, so a source gives its target to
the word, and a document is never taken more than ``cap`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import WORD

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Slots of a task that lists them, and shards whose counts are summed together.
TASK_SLOTS = 500_000
SHARD_GROUP = 1024
#: The keyed hash of the permutation: v * (v + ADD) modulo a prime; ROUNDS swaps, each decided by one bit of it.
PRIME = 2147483647
ADD = 715827883
ROUNDS = 24


def _mixed(v):
    return ((v % PRIME) * ((v + ADD) % PRIME)) % PRIME


def round_keys(src: Column, number: int, seed: int) -> Column:
    """The keys of the rounds of one pass of a source."""
    key = lambda r: _mixed(_mixed(_mixed(src * 69069 + (number * 10007 + seed * 1000003 + r * 104729))))
    return F.array(*[key(r) for r in range(ROUNDS)])


def permuted(at: Column, n: Column, keys: Column) -> Column:
    """``at`` of 0..n-1 in a pseudorandom permutation of any n: a round pairs x with key - x, and both swap or both stay.

    Every round undoes itself, so the keys in reverse order give the inverse.
    """
    def swap(x, key):
        other = (key % n + n - x) % n
        return F.when(F.shiftright(_mixed(F.greatest(x, other) + key), 15) % 2 == 1, other).otherwise(x)
    return F.aggregate(keys, at.cast("bigint"), swap)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, block: int = BLOCK_WORDS) -> DataFrame:
    """src, source, source_size, target, blocks, passes, rest: one row per source, by code point, null last.

    Sources that reach ``cap`` times their size stay there; the others share what is left by weight. The windows below hold
    one row per source.
    """
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    source = source.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1)
    source = source.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("bend", F.col("most") / F.col("weight"))
    order = Window.orderBy("bend", "src")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    source = source.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / behind)
    level = F.max(F.when(F.col("level") <= F.col("bend"), F.col("level"))).over(everything)
    source = source.withColumn("target", F.least(F.col("most"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    words = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("bigint")
    return (source.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint")).withColumn("passes", passes)
            .withColumn("rest", words - F.col("passes") * F.col("source_size"))
            .select("src", "source", "source_size", "target", "blocks", "passes", "rest"))


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier shards of the source: sums by groups of shards, then inside a group."""
    rows = rows.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    sums = rows.groupBy("src", "group").agg(F.sum(value).alias("whole"))
    ahead = F.sum("whole").over(Window.partitionBy("src").orderBy("group")) - F.col("whole")
    sums = sums.select("src", "group", ahead.alias("ahead"))
    within = F.sum(value).over(Window.partitionBy("src", "group").orderBy("shard")) - F.col(value)
    return rows.join(sums, ["src", "group"]).withColumn(name, (F.col("ahead") + within).cast("bigint")).drop("group", "ahead")


def shard_counts(need: DataFrame, seed: int = 17, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """shard, src, low, high: the numbers of the slots of a source that a shard takes, by a draw per shard.

    ``need`` (src, count) is the number of slots of every source. Each slot of a shard draws its source with the odds of the counts.
    """
    spark = need.sparkSession
    need = need.where("count > 0").select("src", "count")
    total = int(need.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    ends = need.withColumn("end", F.sum("count").over(Window.orderBy("src"))).withColumn("begin", F.col("end") - F.col("count"))
    bucket = lambda c: F.floor(c / per_shard)
    ends = ends.withColumn("bucket", F.explode(F.sequence(bucket(F.col("begin")), bucket(F.col("end") - 1)))).drop("count")
    drawn = spark.range(0, total, 1, total // TASK_SLOTS + 1).select(F.floor(F.col("id") / per_shard).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("at"))
    # The planner takes an exploded side for as small as its source and would broadcast it.
    met = drawn.withColumn("bucket", bucket(F.col("at"))).hint("merge").join(ends.hint("merge"), "bucket").where("begin <= at and at < end")
    drawn = materialise(met.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("n")))

    rows = _before(drawn, "n", "first").join(need, "src").withColumn("behind", F.col("first") + F.col("n"))
    kept = rows.where("first < count").select("shard", "src", F.col("first").alias("low"), F.least("behind", "count").alias("high"))
    # Beyond the targets: about the square root of all slots. One row per source and shard that has some is ordered below, then one per slot is joined.
    spare = rows.where("behind > count").select("shard", "src", (F.col("behind") - F.greatest("first", "count")).alias("n"))
    spare = spare.withColumn("end", F.sum("n").over(Window.orderBy("shard", "src")))
    spare = spare.select("shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("place"))
    lack = need.join(drawn.groupBy("src").agg(F.sum("n").alias("has")), "src", "left").fillna(0, ["has"]).where("has < count")
    lack = lack.withColumn("n", F.col("count") - F.col("has")).withColumn("end", F.sum("n").over(Window.orderBy("src")))
    lack = lack.withColumn("place", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)))
    number = F.col("count") - F.col("end") + F.col("place")
    balanced = spare.hint("merge").join(lack.select("src", "place", number.alias("low")).hint("merge"), "place")
    return kept.unionByName(balanced.select("shard", "src", "low", (F.col("low") + 1).alias("high")))


def slots(target: DataFrame, block: int = BLOCK_WORDS, seed: int = 17, cap: int = 2, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """shard, src, slot, pass, block, take: which block fills a slot, and how many of its first words."""
    n, rest = F.col("blocks"), F.col("rest")
    partial = F.when(rest > 0, F.least(n, F.floor((rest + block - 1) / block) + 1)).otherwise(0)
    t = target.where("blocks > 0").withColumn("count", (n * F.col("passes") + partial).cast("bigint")).where("count > 0")
    keys = F.array(*[round_keys(F.col("src").cast("bigint"), number, seed) for number in range(cap + 1)])
    t = t.withColumn("keys", keys)
    # Where the short last block comes in the partial pass.
    t = materialise(t.withColumn("short", permuted(n - 1, n, F.reverse(F.element_at("keys", (F.col("passes") + 1).cast("int"))))))
    total = int(t.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    dealt = shard_counts(t, seed, per_shard).repartition(total // TASK_SLOTS + 1, "shard", "src").join(t, "src")
    dealt = dealt.withColumn("slot", F.explode(F.sequence("low", F.col("high") - 1)))
    dealt = dealt.withColumn("pass", F.floor(F.col("slot") / n)).withColumn("at", F.pmod("slot", n))
    dealt = dealt.withColumn("block", permuted(F.col("at"), n, F.element_at("keys", (F.col("pass") + 1).cast("int"))))
    tail = F.col("source_size") - (n - 1) * block
    before = F.col("at") * block - F.when(F.col("at") > F.col("short"), F.lit(block) - tail).otherwise(0)
    length = F.when(F.col("block") == n - 1, tail).otherwise(block)
    take = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, rest - before))
    return dealt.select("shard", "src", "slot", "pass", "block", take.cast("bigint").alias("take")).where("take > 0")


def part_of(doc_id: Column, text_key: Column, parts: int) -> Column:
    """The part of a document: by its doc_id, or by its text where that is null."""
    return F.pmod(_mixed(_mixed(F.coalesce(F.pmod(doc_id, F.lit(PRIME)), F.pmod(text_key, F.lit(PRIME))))), F.lit(parts))


def placed(sizes: DataFrame, target: DataFrame, parts: int) -> DataFrame:
    """Rows of ``sizes`` with src, and the first word and the word behind the last in the stream of their source.

    A stream goes by parts of the documents, then by doc_id; a part is a fixed share of a source, so a large source is
    summed by many tasks and only one number per part meets in the window over a source.
    """
    rows = sizes.withColumn("part", part_of(F.col("doc_id"), F.col("text_key"), parts))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), offset.alias("offset"))
    sums = sums.join(target, sums["s"].eqNullSafe(target["source"])).select("s", "p", "offset", "src", "source_size", "target")
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["part"] == sums["p"]))
    within = Window.partitionBy("src", "part").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_key")
    end = F.col("offset") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "source", "text_key", "size", "src", "source_size", "target", end.alias("end"), (end - F.col("size")).alias("start"))


class Mix:
    """A mix of documents (doc_id, text, source).

    * A null text has no words: the row is returned and never taken. A null source is a source, the last one.
    * Null doc_ids come last in their stream. Rows that repeat a doc_id are placed one by one.
    * An empty table gives an empty mix. Other columns are carried by ``documents`` and otherwise ignored.
    * Reruns agree: nothing depends on the number of tasks. A source may have 2**31 blocks.
    """

    def __init__(self, docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, block: int = BLOCK_WORDS, seed: int = 17):
        text = F.coalesce(docs["text"], F.lit(""))
        self.docs, self.block = docs, block
        self.sizes = materialise(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"], word_count(docs["text"]).alias("size"), F.xxhash64(text).alias("text_key")))
        self.targets = materialise(targets(self.sizes, weights, share, cap, block))
        self.slots = slots(self.targets, block, seed, cap)
        self.placed = placed(self.sizes, self.targets, max(64, self.sizes.count() // 10_000))

    def pieces(self) -> DataFrame:
        """shard, slot, pass, and the words [from, to) of a document that a slot takes."""
        block = self.block
        doc = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
        at = F.col("block") * block
        doc = doc.withColumn("low", F.greatest("start", at)).withColumn("high", F.least(F.col("end"), at + block))
        # The planner takes an exploded side for as small as its source and would broadcast it.
        met = doc.hint("merge").join(self.slots.hint("merge"), ["src", "block"])
        high = F.least(F.col("high"), F.col("block") * block + F.col("take"))
        return (met.withColumn("high", high).where("high > low")
                .select("shard", "slot", "pass", "src", "start", "doc_id", "source", "text_key", "size", (F.col("low") - F.col("start")).alias("from"), (F.col("high") - F.col("start")).alias("to")))

    def counts(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for every row."""
        taken = self.pieces().groupBy(F.col("src").alias("s"), F.col("start").alias("first")).agg(F.sum(F.col("to") - F.col("from")).alias("words"))
        rows = self.placed
        met = rows.join(taken, (rows["src"] == taken["s"]) & (rows["start"] == taken["first"]) & (rows["size"] > 0), "left")
        return met.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken"))

    def documents(self, pass_col: str | None = None) -> DataFrame:
        """The mix as documents: one row per pass that takes a document; a part of it where the pass takes a part.

        ``pass_col`` names a column for the number of the pass.
        """
        spans = F.array_sort(F.collect_list(F.struct("from", "to")))
        passes = (self.pieces().groupBy("src", "start", "pass", "doc_id", "source", "text_key", "size")
                  .agg(F.sum(F.col("to") - F.col("from")).alias("words"), spans.alias("spans")))
        passes = passes.select(*[F.col(c).alias(f"{c} of the mix") for c in ("doc_id", "source", "text_key", "size", "words", "spans", "pass")])
        docs, key = self.docs, "key of the text"
        docs = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "source", key])
        met = docs.join(passes, docs["doc_id"].eqNullSafe(passes["doc_id of the mix"]) & docs["source"].eqNullSafe(passes["source of the mix"]) & (docs[key] == passes["text_key of the mix"]))
        words = F.regexp_extract_all("text", F.lit(WORD), 0)
        part = F.array_join(F.flatten(F.transform(F.col("spans of the mix"), lambda s: F.slice(words, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " ")
        met = met.withColumn("text", F.when(F.col("words of the mix") == F.col("size of the mix"), F.col("text")).otherwise(part))
        if "n_chars" in met.columns:
            met = met.withColumn("n_chars", F.length("text").cast("bigint"))
        return met.select(*[met[c] for c in self.docs.columns if c != pass_col], *([F.col("pass of the mix").cast("bigint").alias(pass_col)] if pass_col else []))
