"""N-gram Jaccard join by a pigeonhole over a partition of the shingle universe.

Sizes fall into bands so wide that two similar sets lie in one band or in neighbours. The pairs whose smaller set lies in
a band are its scheme; a set takes part in the scheme of its own band and of the one below. A scheme bounds how many
shingles two similar sets of it can differ in (H) and cuts the universe of shingle hashes into more than H segments, so that
similar sets agree in a whole segment. The hash of a segment's content is a signature.

Empty segments say nothing and would bring thousands of sets together. A set pays for what is cheapest and still enough:
its filled segments, if they are more than H; else these and their one-deletion neighbourhoods, if segments of two and
more shingles are more than H / 2; else everything. The three prices rise in that order, and any pair of choices keeps the
pigeonhole: a set with more than H filled segments agrees with a similar one in a filled segment; without it, some segment
differs in at most one shingle.

Signatures travel as 4-byte numbers to buckets of the hash range, each once for all sets that share it in a batch. A bucket
does not list all pairs: every set is paired with the smallest of its signature, and where that leaves different components
with the largest; those pairs are verified exactly and joined into components, and only sets of one signature that are then
still in different components are paired as well. Sizes and
parity bitmaps, which bound the number of shingles two sets differ in from below, rule most such pairs out before they exist. So a group of
n near copies costs about n pairs, and no link between different components is missed. Sets with equal shingles
count as one within a batch.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import id_and_text, text_bytes
from .components import components
from .words import shingles, stir, word_hashes

#: Bytes of text for each bucket of signatures.
BUCKET_BYTES = 8 << 20
#: Documents of a batch, at most.
BATCH_DOCS = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SENT = pa.schema([("bucket", pa.int64()), ("reps", pa.binary()), ("low", pa.binary()), ("who", pa.binary()), ("crowded", pa.binary()),
                   ("members", pa.binary()), ("pairs", pa.binary()), ("crowd", pa.binary()), ("bitmaps", pa.binary())])
_SENT_DDL = "bucket long, reps binary, low binary, who binary, crowded binary, members binary, pairs binary, crowd binary, bitmaps binary"
#: Bits of a set's bitmap, in numbers of 64.
BITMAP = 16
_SETS = "id long, shingles array<long>"


@lru_cache(maxsize=None)
def _bands(num: int, den: int) -> list[int]:
    """Where each band of sizes begins; similar sets lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * den // num + 1)
    return edges


@lru_cache(maxsize=None)
def scheme(band: int, num: int, den: int) -> tuple[int, int]:
    """(H, segments) of the pairs whose smaller set lies in the band."""
    low, largest = _bands(num, den)[band], _bands(num, den)[band + 1] - 1
    most = largest * (den - num) // num
    if not most:
        return 0, 1
    return most, most + 3 + math.ceil(1.2 * (most + 1) * math.exp(-low / (most + 1)))


def signatures(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of one set, given as ascending distinct hashes."""
    out = []
    band = int(np.searchsorted(_bands(num, den), len(own), "right")) - 1
    mixed = stir(own * _ODD)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed)]
    for b in (band, band - 1):
        if b < 0:
            continue
        most, segments = scheme(b, num, den)
        of = ((own >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        edges = np.searchsorted(of, np.arange(segments + 1))
        held = np.diff(edges)
        content = total[edges[1:]] - total[edges[:-1]]
        name = stir((np.uint64(b) << np.uint64(32)) + np.arange(segments, dtype=np.uint64) + np.uint64(1))
        if np.count_nonzero(held) > most:
            out.append(stir(content[held > 0] + name[held > 0]))
            continue
        several = np.count_nonzero(held > 1)
        out.append(stir(content + name)[(held > 0) | (2 * several <= most)])
        drop = held[of] > 1
        out.append(stir((content + name)[of[drop]] - mixed[drop]))
    return np.concatenate(out)


def bitmap(own: np.ndarray) -> np.ndarray:
    """For each of the bits, whether an odd number of shingles falls on it: two bitmaps differ in no more bits than the sets in shingles."""
    odd = np.bincount((stir(own + _ODD) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pack(columns, edges, b):
    return np.stack([c[edges[b]:edges[b + 1]] for c in columns], 1).astype("<i8").tobytes()


def _send_batch(ids: list, texts: list, n: int, num: int, den: int, buckets: int):
    known: dict = {}
    reps, kept, members, bitmaps = [], [], [], []
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    for i, words in zip(order, word_hashes([texts[i] for i in order])):
        own = shingles(words, n)
        doc = ids[i]
        if doc is None or not len(own):
            members.append((doc, doc, len(own)))
            continue
        key = own.tobytes() if len(own) < 3 else (len(own), int(stir(own).sum()), int(stir(own * _ODD).sum()))
        if key not in known:
            known[key] = doc
            reps.append(doc)
            kept.append(signatures(own, num, den))
            bitmaps.append(np.r_[np.array([doc, len(own)], "<i8"), bitmap(own)])
        members.append((doc, known[key], len(own)))
    # Signatures of this batch, each once; sets that share one here are paired here.
    who = np.repeat(np.arange(len(kept)), [len(k) for k in kept]) if kept else np.zeros(0, np.int64)
    keys = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
    by = np.lexsort((who, keys))
    keys, who = keys[by], who[by]
    if len(keys):
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])]
        keys, who = keys[fresh], who[fresh]
    start = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    heads = np.flatnonzero(start)
    size = np.diff(np.r_[heads, len(keys)])
    ids_of = np.array(reps, np.int64)
    bucket = _bucket(keys, buckets).astype(np.int64)
    place = (bucket << 32) | (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    several = size[group] > 1
    crowd = np.stack([place[several], ids_of[who[several]]], 1) if len(keys) else np.zeros((0, 2), np.int64)
    pairs = np.stack([ids_of[who[several]], ids_of[who[heads][group[several]]]], 1) if len(keys) else np.zeros((0, 2), np.int64)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    edges = np.searchsorted(bucket[heads], np.arange(buckets + 1)) if len(keys) else np.zeros(buckets + 1, np.int64)
    crowd_edges = np.searchsorted(crowd[:, 0] >> 32, np.arange(buckets + 1))
    spread = lambda rows, b: rows[b::buckets]  # noqa: E731  rows without a place of their own go round the buckets
    rows = []
    for b in range(buckets):
        a, z = edges[b], edges[b + 1]
        used, back = np.unique(who[heads[a:z]], return_inverse=True) if z > a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        own, two = spread(members, b), spread(pairs, b)  # bitmaps are never more than members
        if z == a and not own and not len(two):
            continue
        rows.append((b, ids_of[used].astype("<i8").tobytes() if z > a else b"", (keys[heads[a:z]] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                     back.astype("<u2").tobytes(), np.packbits(size[a:z] > 1).tobytes(), _members(own), two.astype("<i8").tobytes(),
                     crowd[crowd_edges[b]:crowd_edges[b + 1]].astype("<i8").tobytes(), b"".join(x.tobytes() for x in spread(bitmaps, b))))
    columns = list(zip(*rows)) if rows else [()] * len(_SENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _members(own: list) -> bytes:
    """(null flag, doc_id, representative, set size) of each row."""
    return np.array([(d is None, d or 0, r or 0, n) for d, r, n in own], "<i8").tobytes()


def _send(batches, n: int, num: int, den: int, buckets: int):
    ids, texts = [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        while len(ids) >= BATCH_DOCS:
            yield _send_batch(ids[:BATCH_DOCS], texts[:BATCH_DOCS], n, num, den, buckets)
            ids, texts = ids[BATCH_DOCS:], texts[BATCH_DOCS:]
    if ids:
        yield _send_batch(ids, texts, n, num, den, buckets)


_OUT = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bits", pa.list_(pa.int64()))])
_OUT_DDL = "kind string, a long, b long, n long, bits array<long>"


def _find(sent: pa.Table) -> pa.Table:
    """Pairs of a bucket, signatures that more than two sets share, and the members, which only pass through."""
    column = lambda name, kind: [np.frombuffer(x, kind) for x in sent.column(name).to_pylist()]
    low, who, reps = column("low", "<u4"), column("who", "<u2"), column("reps", "<i8")
    bucket = sent.column("bucket")[0].as_py()
    keys = np.concatenate(low)
    sets = np.concatenate([r[w] if len(w) else np.zeros(0, np.int64) for r, w in zip(reps, who)])
    crowded = np.concatenate([np.unpackbits(c, count=len(x)) for c, x in zip(column("crowded", np.uint8), low)]).astype(bool)
    by = np.lexsort((sets, keys))
    keys, sets, crowded = keys[by], sets[by], crowded[by]
    start = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    heads, group = np.flatnonzero(start), np.cumsum(start) - 1
    size = np.diff(np.r_[heads, len(keys)])
    pairs = np.stack([sets, sets[heads][group]], 1) if len(keys) else np.zeros((0, 2), np.int64)
    pairs = np.concatenate([pairs[pairs[:, 0] != pairs[:, 1]], *(x.reshape(-1, 2) for x in column("pairs", "<i8"))])
    pairs = np.unique(pairs, axis=0)
    many = ((size > 2) | ((size > 1) & np.logical_or.reduceat(crowded, heads)))[group] if len(keys) else start
    crowd = np.stack([(np.int64(bucket) << 32) | keys[many].astype(np.int64), sets[many]], 1)
    crowd = np.concatenate([crowd, *(x.reshape(-1, 2) for x in column("crowd", "<i8"))])
    members = np.concatenate([x.reshape(-1, 4) for x in column("members", "<i8")])
    sets = np.concatenate([x.reshape(-1, 2 + BITMAP) for x in column("bitmaps", "<i8")])
    none = np.zeros(len(pairs) + len(crowd), np.int64)
    a = np.concatenate([pairs[:, 0], crowd[:, 0], members[:, 1], sets[:, 0]])
    b = np.concatenate([pairs[:, 1], crowd[:, 1], members[:, 2], sets[:, 0]])
    lost = np.concatenate([none, members[:, 0], 0 * sets[:, 0]]) == 1
    kind = np.repeat(np.array(["pair", "crowd", "member", "set"]), [len(pairs), len(crowd), len(members), len(sets)])
    size = np.concatenate([none, members[:, 3], sets[:, 1]])
    offsets = np.r_[np.zeros(len(none) + len(members), np.int64), np.arange(len(sets) + 1) * BITMAP].astype(np.int32)
    bits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(sets[:, 2:]).reshape(-1)))
    return pa.table([pa.array(kind, pa.string()), pa.array(a, mask=lost), pa.array(b, mask=lost), pa.array(size), bits], schema=_OUT)


def _sets(batches, n: int):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for low in range(0, len(texts), 500):
            part = [shingles(w, n).view(np.int64) for w in word_hashes(texts[low:low + 500])]
            offsets = np.r_[0, np.cumsum([len(p) for p in part])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids[low:low + 500], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))], names=["id", "shingles"])


def _possible(num: int, den: int) -> Column:
    """Whether two sets can be similar by their sizes and bitmaps; columns of the second have a mark."""
    apart = sum((F.bit_count(F.col(f"bits{i}").bitwiseXOR(F.col(f"bits{i}'"))) for i in range(1, BITMAP)), F.bit_count(F.col("bits0").bitwiseXOR(F.col("bits0'"))))
    most = (F.col("size") + F.col("size'")) * (den - num)
    return (apart * (den + num) <= most) & (F.abs(F.col("size") - F.col("size'")) * (den + num) <= most)


def _marked(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(c).alias(c + "'") for c in frame.columns])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    common = F.size(F.array_intersect("left", "right"))
    near = (pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
            .select("a", "b", common.alias("common"), (F.size("left") + F.size("right") - common).alias("either")))
    return near.where(f"{den} * common >= {num} * either").select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id that is reachable by links.

    Two documents link when ``den * common shingles >= num * all shingles`` of the two.

    * A null, empty or blank text has no shingles and links with nothing.
    * Rows with a null doc_id have no name a component could carry: they link with nothing, their component_id is null.
    * Rows that repeat a doc_id are one document whose links are those of all its texts; each row keeps its own set size.
    * An empty table gives an empty result. Other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    buckets = text_bytes(rows) // BUCKET_BYTES + 1
    found = materialise(rows.mapInArrow(lambda batches: _send(batches, n, num, den, buckets), _SENT_DDL)
                        .groupBy("bucket").applyInArrow(_find, _OUT_DDL))
    bitmaps = found.where("kind = 'set'").select(F.col("a").alias("id"), F.col("n").alias("size"), *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITMAP)])
    pairs = found.where("kind = 'pair'").select("a", "b").distinct()
    crowd = found.where("kind = 'crowd'").select(F.col("a").alias("signature"), F.col("b").alias("id"))
    near = pairs.join(bitmaps, pairs["a"] == bitmaps["id"]).drop("id")
    second = _marked(bitmaps)
    near = materialise(near.join(second, near["b"] == second["id'"]).where(_possible(num, den)).select("a", "b").distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        needed = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "needed").hint("merge")
        sets = rows.join(needed, rows["doc_id"] == needed["needed"], "left_semi").mapInArrow(lambda batches: _sets(batches, n), _SETS)
        return materialise(_verified(pairs, sets, num, den))

    def split(label: DataFrame) -> DataFrame:
        """Sets of signatures whose sets are in different components so far, with what rules most of their pairs out."""
        held = crowd.join(label, "id", "left").select("signature", "id", F.coalesce("component", "id").alias("component"))
        open_ones = held.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("id").alias("last")).where("low < high").select("signature", "last")
        return held.join(open_ones, "signature").join(bitmaps, "id")

    crowd = materialise(crowd.distinct())
    links = linked(near)
    label = components(links)
    # A second centre, the largest set of a signature, joins most of what the smallest did not, still one pair per set.
    second_pairs = split(label).where("id <> last").select(F.col("id").alias("a"), F.col("last").alias("b"), *bitmaps.columns[1:]).join(_marked(bitmaps), F.col("b") == F.col("id'"))
    second_pairs = materialise(second_pairs.where(_possible(num, den)).select("a", "b").distinct().join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
    if second_pairs.first():
        links = links.union(linked(second_pairs))
        label = components(links)
    left = split(label)
    right = _marked(left)
    met = (left["signature"] == right["signature'"]) & (left["component"] != right["component'"]) & (left["id"] > right["id'"])
    across = left.join(right, met & _possible(num, den)).select(F.col("id").alias("a"), F.col("id'").alias("b")).distinct()
    across = across.join(near, ["a", "b"], "left_anti").join(second_pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    across = materialise(across)
    if across.first():
        label = components(links.union(linked(across)))
    members = found.where("kind = 'member'").select(F.col("a").alias("doc_id"), F.col("b").alias("id"), F.col("n").alias("n_shingles"))
    return members.join(label, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one_of_each_component(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, and those without a doc_id, with all their columns."""
    linked = jaccard_components(docs, n, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("linked")).distinct()
    return docs.join(linked, docs["doc_id"] == linked["linked"], "left_anti")
