"""The prefix trie of conversations by vertical bitmaps.

Conversations are dealt by ranges of their ids into shards. A shard keeps, for every (position, turn), the bitset of its conversations with that
turn there. From a node, whose bitset is known, each child is the intersection with one posting of the next position; its popcount, its least bit
and the conversations that end there follow. A node's key is the exclusive or of 128-bit hashes of its (position, turn) pairs, so shards agree on
keys and their counts add up. Conversations longer than ``SEGMENT`` turns go on in further groups, each from its own inner nodes.

What lies below a node needs no walk along the tree: every node belongs to its least conversation, from some depth to that conversation's end.
Below a node lie the nodes of its own conversation that are deeper, and all nodes of its other members: a second pass adds those up by bitset.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.session import materialise

#: Conversations and turns of a shard, about, and turns of a conversation in one group.
SHARD = 4096
SHARD_TURNS = 1 << 16
SEGMENT = 256
_KEY = ["k1", "k2", "depth"]
PART = "k1 long, k2 long, p1 long, p2 long, depth long, bytes long, n long, conv_id long, ends array<long>"
WEIGHED = "k1 long, k2 long, depth long, n_leaves long, saved decimal(38,0)"


def ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, t1, t2, bytes): the turns of each conversation in order, as hashes; turns that tie are ordered by role and text."""
    c = conversations
    rows = c.select(c[conv_col].cast("bigint").alias("conv_id"), c[turn_col].alias("turn"), F.coalesce(c[role_col], F.lit("")).alias("role"),
                    F.coalesce(c[text_col], F.lit("")).alias("text")).where("conv_id is not null")
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(by) - 1)
    return rows.select("conv_id", "at", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(7), "text", "role").alias("t2"), F.octet_length("text").cast("bigint").alias("bytes"))


def rebuild(turns: DataFrame, base, head) -> tuple[DataFrame, DataFrame]:
    """Conversations, and their rows (conv_id, depth, c1, c2, bytes, last): the first ``head`` turns of conversation ``base``, then their own after ``head``.

    ``base`` and ``head`` are columns of conv_id. Every conversation has a row at depth 0.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    own = own.select("conv_id", base(F.col("conv_id")).alias("base"), head(F.col("conv_id")).alias("head"), "length")
    theirs = own.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = own.join(theirs, "base", "left").withColumn("shared", F.least("head", F.coalesce("base_length", F.lit(0))))
    convs = convs.select("conv_id", "base", "head", "shared", (F.col("shared") + F.greatest(F.col("length") - F.col("head"), F.lit(0))).alias("n_turns"))
    size = turns.agg(F.count("*"), F.count_distinct("conv_id")).first()
    shards = max(1, -(-size[1] // SHARD), -(-size[0] // SHARD_TURNS))
    convs = materialise(convs.repartitionByRange(shards, "conv_id").withColumn("shard", F.spark_partition_id()))

    mine = turns.join(convs, "conv_id").where("at >= head").select("conv_id", "shard", "n_turns", (F.col("shared") + F.col("at") - F.col("head") + 1).alias("depth"), "t1", "t2", "bytes")
    first = turns.where(F.col("at") < F.lit(convs.agg(F.max("head")).first()[0] or 0)).withColumnRenamed("conv_id", "base")
    given = first.join(convs, "base").where("at < head").select("conv_id", "shard", "n_turns", (F.col("at") + 1).alias("depth"), "t1", "t2", "bytes")
    both = mine.union(given).select("conv_id", "shard", "n_turns", "depth", F.xxhash64("t1", "t2", "depth").alias("c1"), F.xxhash64(F.lit(3), "depth", "t2", "t1").alias("c2"), "bytes")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", "shard", "n_turns", zero.alias("depth"), zero.alias("c1"), zero.alias("c2"), zero.alias("bytes"))
    return convs, both.union(roots).withColumn("last", F.col("depth") == F.col("n_turns"))


def _segments(rows: DataFrame) -> DataFrame:
    """Rows with the segment they belong to; behind the first, a segment begins with a row that holds the key so far."""
    rows = rows.withColumn("segment", F.greatest(F.floor((F.col("depth") - 1) / SEGMENT), F.lit(0)))
    # One row per segment of a long conversation.
    ends = rows.where(F.col("n_turns") > SEGMENT).groupBy("conv_id", "shard", "n_turns", "segment").agg(F.bit_xor("c1").alias("c1"), F.bit_xor("c2").alias("c2"))
    so_far = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    begins = ends.select("conv_id", "shard", "n_turns", ((F.col("segment") + 1) * SEGMENT).alias("depth"), F.bit_xor("c1").over(so_far).alias("c1"), F.bit_xor("c2").over(so_far).alias("c2"),
                         F.lit(0).cast("bigint").alias("bytes"), F.lit(False).alias("last"), (F.col("segment") + 1).alias("segment"))
    return rows.unionByName(begins.where("depth < n_turns"))


def _bits(members: np.ndarray, size: int) -> int:
    if len(members) == 1:
        return 1 << int(members[0])
    flags = np.zeros(size, np.uint8)
    flags[members] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _members(bits: int, size: int) -> np.ndarray:
    if bits.bit_count() == 1:
        return np.array([bits.bit_length() - 1])
    raw = np.frombuffer(bits.to_bytes((size + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _nodes(table: pa.Table):
    """Every node of one group of a shard: key, parent's key, depth, bytes of its last text, bitset and the bitset that ends there; then the ids."""
    conv, depth, c1, c2, size_of, last = (table.column(c).to_numpy() for c in ("conv_id", "depth", "c1", "c2", "bytes", "last"))
    ids, own = np.unique(conv, return_inverse=True)
    top = int(depth.min())
    order = np.lexsort((c2, c1, depth))
    own, depth, c1, c2, size_of, last = (x[order] for x in (own, depth, c1, c2, size_of, last))
    fresh = np.r_[True, (np.diff(depth) != 0) | (np.diff(c1) != 0) | (np.diff(c2) != 0)]
    heads = np.flatnonzero(fresh)
    posting = [_bits(part, len(ids)) for part in np.split(own, heads[1:])]
    level, keys, sizes = depth[heads].tolist(), list(zip(c1[heads].tolist(), c2[heads].tolist())), size_of[heads].tolist()
    number = np.cumsum(fresh) - 1
    turn, there, ending = {}, {}, {}
    for i, d, n in zip(own.tolist(), depth.tolist(), number.tolist()):
        turn[i, d] = n
    edges = np.flatnonzero(np.r_[True, np.diff(depth) != 0, True])
    for a, b in zip(edges[:-1], edges[1:]):
        there[int(depth[a])] = _bits(own[a:b], len(ids))
        done = own[a:b][last[a:b]]
        ending[int(depth[a])] = _bits(done, len(ids)) if len(done) else 0
    stack = []
    for n, (d, bits) in enumerate(zip(level, posting)):
        if d == top:
            stack.append((bits, d, *keys[n]))
            if d == 0:
                yield (*keys[n], None, None, 0, 0, bits, bits & ending[0])
    while stack:
        bits, d, k1, k2 = stack.pop()
        rest = bits & there.get(d + 1, 0)
        while rest:
            n = turn[(rest & -rest).bit_length() - 1, d + 1]
            child = bits & posting[n]
            rest &= ~child
            a, b = k1 ^ keys[n][0], k2 ^ keys[n][1]
            yield a, b, k1, k2, d + 1, sizes[n], child, child & ending[d + 1]
            stack.append((child, d + 1, a, b))
    yield ids


def _part(table: pa.Table) -> pa.Table:
    *nodes, ids = _nodes(table)
    rows = [(a, b, p, q, d, size, bits.bit_count(), int(ids[(bits & -bits).bit_length() - 1]), ids[_members(done, len(ids))].tolist() if done else [])
            for a, b, p, q, d, size, bits, done in nodes]
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
    names = ["k1", "k2", "p1", "p2", "depth", "bytes", "n", "conv_id", "ends"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def _weighed(table: pa.Table) -> pa.Table:
    """For every node the weights of its members, added up."""
    *nodes, ids = _nodes(table)
    conv = table.column("conv_id").to_numpy()
    _, first = np.unique(conv, return_index=True)
    leaves = table.column("own_leaves").to_numpy()[first]
    saved = np.array(table.column("own_saved").take(pa.array(first)).to_pylist(), object)
    rows = []
    for a, b, _, _, d, _, bits, _ in nodes:
        some = _members(bits, len(ids))
        rows.append((a, b, d, int(leaves[some].sum()), saved[some].sum()))
    kinds = [pa.int64()] * 4 + [pa.decimal128(38, 0)]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["k1", "k2", "depth", "n_leaves", "saved"])


def _sealed(batches):
    """The digest of the ids that end at each node; runs of a node come one after another, in order."""
    now, digest, out = None, None, []
    for batch in batches:
        for k1, k2, depth, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = ",".join(map(str, ends)).encode()
            if (k1, k2, depth) == now:
                digest.update(b"," + text)
                continue
            if now:
                out.append((*now, digest.hexdigest()))
            now, digest = (k1, k2, depth), hashlib.sha256(text)
        if len(out) > 10_000:
            yield _digests(out)
            out = []
    if now:
        out.append((*now, digest.hexdigest()))
    if out:
        yield _digests(out)


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k1", "k2", "depth", "ends_sha256"])


def prefix_trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node; see ``rebuild`` for the input."""
    rows = materialise(_segments(rows))
    parts = materialise(rows.groupBy("shard", "segment").applyInArrow(_part, PART))
    sums = parts.groupBy(*_KEY).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    sums = materialise(sums)
    children = sums.where("depth > 0").groupBy("p1", "p2", "depth").agg(F.count("*").alias("n_children"))
    children = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"), "n_children")
    nodes = sums.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = nodes.withColumn("saves", ((F.col("n_convs") - 1) * F.col("bytes")).cast("decimal(38,0)")).withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
    # A conversation owns its nodes from some depth to its end: below a node lie the deeper ones of its owner ...
    chain = Window.partitionBy("conv_id")
    above = chain.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    up = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    nodes = materialise(nodes.withColumns({"saves_above": up("saves"), "leaves_above": up("leaf"), "own_saves": F.sum("saves").over(chain), "own_leaves": F.sum("leaf").over(chain)}))
    # ... and all that its members own, its owner's without what the owner has above the node.
    own = nodes.groupBy("conv_id").agg(F.max("own_saves").cast("decimal(38,0)").alias("own_saved"), F.max("own_leaves").alias("own_leaves"))
    weighed = rows.join(own, "conv_id", "left").withColumns({"own_saved": F.coalesce("own_saved", F.lit(0).cast("decimal(38,0)")), "own_leaves": F.coalesce("own_leaves", F.lit(0).cast("bigint"))})
    below = weighed.groupBy("shard", "segment").applyInArrow(_weighed, WEIGHED).groupBy(*_KEY).agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
    ends = parts.where("size(ends) > 0").select(*_KEY, "ends").repartition(*_KEY).sortWithinPartitions(*_KEY, F.col("ends")[0])
    sealed = ends.mapInArrow(_sealed, "k1 long, k2 long, depth long, ends_sha256 string")
    parents = sums.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, _KEY).join(sealed, _KEY, "left").join(parents, ["p1", "p2", "depth"], "left")
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", (F.col("leaves_below") - F.col("leaves_above")).cast("bigint").alias("n_leaves"),
                      (F.col("saved_below") - F.col("saves_above")).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """The trie of the conversations rebuilt: conversation c begins with the first h turns of conversation c - c % group, h = crc32(c) % heads.

    * A null role or text is empty; turns are ordered by turn, null first, and where they tie by role and text; repeated rows are turns.
    * A row without conv_id belongs to no conversation. A conversation that is rebuilt to no turns is a member of the root and ends there.
    * An empty table has no root, so no rows. Other columns, whatever their names, are left behind.
    """
    turns = materialise(ordered(conversations))
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    return prefix_trie(*rebuild(turns, lambda c: c - c % group, head))
