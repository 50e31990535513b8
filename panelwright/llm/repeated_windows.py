"""Removal of byte strings that repeat across documents: a suffix order cut off at the threshold depth.

Suffixes are ordered only through ``depth`` bytes (50), by most-significant-digit radix passes; suffixes that are still
equal at that depth are exactly the repeated windows, and every suffix that is alone in its group leaves at once.

1. First digit. The leading digit of a window is its anchor: of the byte strings of length ``depth * 14 // 25`` in it
   (28), the leftmost with the least hash. Equal windows have equal anchors at equal places. Consecutive windows with one
   anchor form a run, so the first pass sorts about one entry for 12 bytes of text, as 4-byte digits. Each chunk of
   documents sends the distinct digits of its anchors to radix buckets; a bucket answers which of them other chunks hold too.
2. Remaining digits. Runs whose anchor is shared go to the buckets with their bytes, each distinct run once per chunk with
   its smallest doc_id. In a bucket, equal runs collapse; where different runs share an anchor, their windows are ordered by
   eight-byte digits down to ``depth``, and groups of one leave after each digit. The answer to a run is a bit per
   window: does a smaller document hold it.
3. Every chunk turns these bits into removed byte ranges.

A chunk is a fixed share of the documents by hash, so all three steps read one and the same shuffle of the texts. Chunk and
bucket sizes are constants and their numbers follow the input. A passage that a third of all documents share is
sent once by each chunk: no group grows with its number of copies. Hashes only place things; bytes decide what is equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, text_bytes

#: Bytes of text in a chunk, and bytes of text for each radix bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Window starts that are hashed at a time.
PIECE = 1 << 20
#: A null doc_id is larger than every other.
NO_ID = np.iinfo(np.int64).max
#: Odd multipliers of the hash.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("digits", pa.binary())])
_HELD = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("marks", pa.binary())])
_RUNS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("runs", pa.binary()), ("last", pa.binary()), ("at", pa.binary()),
                   ("least", pa.binary()), ("places", pa.binary()), ("run_of", pa.binary()), ("whole", pa.binary())])
_BITS = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("bits", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_DDL = {id(_ASKED): "chunk long, bucket long, digits binary", id(_HELD): "chunk long, bucket long, marks binary",
        id(_RUNS): "chunk long, bucket long, runs binary, last binary, at binary, least binary, places binary, run_of binary, whole binary",
        id(_BITS): "chunk long, places binary, bits binary",
        id(_OUT): "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"}


def _rows(rows: list, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[4]
    return h ^ (h >> np.uint64(29))


class _Chunk:
    """The documents of a chunk in one buffer, in an order that does not depend on how the rows arrive."""

    def __init__(self, docs: pa.Table, depth: int):
        ids, texts = docs.column("doc_id").to_pylist(), [t.encode("utf-8") for t in docs.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts, self.depth = [ids[i] for i in order], [texts[i] for i in order], depth
        self.sort_ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1  # one byte between documents
        self.bytes = np.frombuffer(b"\0".join(self.texts) + b"\0" * (depth + 8), np.uint8)
        self.anchor = depth * 14 // 25
        self._find_runs()

    def _find_runs(self) -> None:
        """first, last: window starts of each run; at: its anchor; doc: its document; key: hash of the anchor."""
        depth, k, n = self.depth, self.anchor, len(self.bytes) - 8 - self.depth
        owner = np.full(n + depth, -1, np.int32)
        for d in range(len(self.starts)):
            owner[self.starts[d]:self.starts[d] + self.lengths[d]] = d
        words = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes.data, strides=(1,))
        parts = []
        for low in range(0, n, PIECE):
            count = min(PIECE, n - low)
            places = count + depth - k
            h = words[low:low + places] * _ODD[0]
            for odd, step in zip(_ODD[1:4], (8, 16, k - 8)):
                h += words[low + min(step, k - 8):low + min(step, k - 8) + places] * odd
                h ^= h >> np.uint64(32)
            h = _stir(h)
            least = (h & ~np.uint64((1 << 22) - 1)) | np.arange(places, dtype=np.uint64)
            width, span = depth - k + 1, 1
            while span * 2 <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
            at = (least[:count] & np.uint64((1 << 22) - 1)).astype(np.int64)
            valid = (owner[low:low + count] == owner[low + depth - 1:low + depth - 1 + count]) & (owner[low:low + count] >= 0)
            new = np.ones(count, bool)
            new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
            end = np.ones(count, bool)
            end[:-1] = (at[1:] != at[:-1]) | ~valid[1:]
            first, last = np.flatnonzero(new & valid), np.flatnonzero(end & valid)
            parts.append((first + low, last + low, at[first] + low, owner[first + low], _stir(h[at[first]] * _ODD[2])))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
        self.first, self.last, self.at, self.doc, self.key = (np.concatenate(x) for x in zip(*(parts or [empty])))

    def digits(self, buckets: int):
        """Distinct anchor hashes in order, the runs' order by them, where each starts, and where each bucket starts."""
        order = np.argsort(self.key, kind="stable")
        sorted_keys = self.key[order]
        new = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(order) else np.zeros(0, np.int64)
        distinct = sorted_keys[new]
        edges = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
        return distinct, order, new, edges

    def bytes_of(self, runs: np.ndarray) -> np.ndarray:
        """One row of fixed width per run, zeros behind its end."""
        width = 2 * self.depth - self.anchor
        width += -width % 8
        behind = np.minimum(self.first[runs][:, None] + np.arange(width), len(self.bytes) - 1)
        out = self.bytes[behind]
        out[np.arange(width) >= (self.last[runs] - self.first[runs] + self.depth)[:, None]] = 0
        return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _row_hash(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h = _stir(h + words[:, i] * _ODD[i % 4])
    for x in more:
        h = _stir(h + x.astype(np.uint64) * _ODD[3])
    return h


def _ask(docs: pa.Table, depth: int, buckets: int) -> pa.Table:
    chunk = docs.column("chunk")[0].as_py()
    distinct, _, _, edges = _Chunk(docs, depth).digits(buckets)
    low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
    return _rows([(chunk, b, low[edges[b]:edges[b + 1]].tobytes()) for b in range(buckets) if edges[b] < edges[b + 1]], _ASKED)


def _answer(asked: pa.Table) -> pa.Table:
    """Which digits of a bucket at least two chunks hold."""
    own = [np.frombuffer(x, "<u4") for x in asked.column("digits").to_pylist()]
    ordered = np.sort(np.concatenate(own))
    shared = ordered[1:][ordered[1:] == ordered[:-1]]
    rows = []
    for chunk, bucket, digits in zip(asked.column("chunk").to_pylist(), asked.column("bucket").to_pylist(), own):
        at = np.searchsorted(shared, digits)
        marks = shared[np.minimum(at, len(shared) - 1)] == digits if len(shared) else np.zeros(len(digits), bool)
        if marks.any():
            rows.append((chunk, bucket, np.packbits(marks).tobytes()))
    return _rows(rows, _HELD)


def _send(docs: pa.Table, held: pa.Table, depth: int, buckets: int) -> pa.Table:
    """The runs of a chunk whose anchors are shared, each distinct run once."""
    if not docs.num_rows:
        return _rows([], _RUNS)
    chunk, own = docs.column("chunk")[0].as_py(), _Chunk(docs, depth)
    distinct, order, new, edges = own.digits(buckets)
    if not len(order):
        return _rows([], _RUNS)
    after = np.r_[new[1:], len(order)]
    shared = own.doc[order[new]] != own.doc[order[after - 1]]  # by two documents of this chunk
    for bucket, marks in zip(held.column("bucket").to_pylist(), held.column("marks").to_pylist()):
        a, b = edges[bucket], edges[bucket + 1]
        shared[a:b] |= np.unpackbits(np.frombuffer(marks, np.uint8), count=b - a).astype(bool)
    runs = order[np.repeat(shared, after - new)]
    rows, last, at = own.bytes_of(runs), (own.last - own.first)[runs], (own.at - own.first)[runs]
    same = _row_hash(rows, last, at)
    bucket = _bucket(own.key[runs], buckets)
    ids = own.sort_ids[own.doc[runs]]
    by = np.lexsort((ids, same, bucket))
    runs, rows, last, at, same, bucket, ids = runs[by], rows[by], last[by], at[by], same[by], bucket[by], ids[by]
    start = np.r_[True, (same[1:] != same[:-1]) | (bucket[1:] != bucket[:-1]) | (last[1:] != last[:-1]) | (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]).any(1)]
    group = np.cumsum(start) - 1
    least = ids[start][group] if len(ids) else ids
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    out = []
    for b in range(buckets):
        a, z = edges[b], edges[b + 1]
        if a == z:
            continue
        s, first_holder = start[a:z], ids[a:z] == least[a:z]
        of = np.cumsum(s) - 1
        out.append((chunk, b, pa.compress(rows[a:z][s].tobytes(), "zstd", asbytes=True), last[a:z][s].astype(np.uint8).tobytes(), at[a:z][s].astype(np.uint8).tobytes(),
                    least[a:z][s].astype("<i8").tobytes(), runs[a:z][first_holder].astype("<u4").tobytes(), of[first_holder].astype("<u4").tobytes(),
                    runs[a:z][~first_holder].astype("<u4").tobytes()))
    return _rows(out, _RUNS)


def _order(sent: pa.Table, depth: int) -> pa.Table:
    """The remaining radix passes over the runs of a bucket."""
    k = depth * 14 // 25
    width = 2 * depth - k
    width += -width % 8
    column = lambda name, kind: [np.frombuffer(x, kind) for x in sent.column(name).to_pylist()]
    counts = [len(x) for x in sent.column("last").to_pylist()]
    parts = [pa.decompress(x, n * width, "zstd") for x, n in zip(sent.column("runs").to_pylist(), counts)]
    rows = np.concatenate([np.frombuffer(x, np.uint8) for x in parts]).reshape(-1, width)
    last, at, least = (np.concatenate(column(c, t)).astype(np.int64) for c, t in (("last", np.uint8), ("at", np.uint8), ("least", "<i8")))
    flat = np.r_[rows.reshape(-1), np.zeros(8, np.uint8)]
    words = np.ndarray((len(flat) - 7,), "<u8", flat.data, strides=(1,))
    base = np.arange(len(rows)) * width

    anchor = np.zeros(len(rows), np.uint64)
    for i, step in enumerate((*range(0, k - 7, 8), k - 8)):
        anchor = _stir(anchor + words[base + at + step] * _ODD[i % 4])
    # Equal runs collapse.
    by = np.lexsort((_row_hash(rows, last, at), anchor))
    r, g = rows[by], anchor[by]
    start = np.r_[True, (g[1:] != g[:-1]) | (last[by][1:] != last[by][:-1]) | (at[by][1:] != at[by][:-1]) | (r[1:] != r[:-1]).any(1)]
    heads = np.flatnonzero(start)
    smallest = np.minimum.reduceat(least[by], heads)
    run_of = np.empty(len(rows), np.int64)
    run_of[by] = np.cumsum(start) - 1
    first = by[start]  # a row of each distinct run
    # Different runs with one anchor: order their windows, one place of the anchor in the window at a time.
    group = np.cumsum(np.r_[True, anchor[first][1:] != anchor[first][:-1]]) - 1
    crowded = np.flatnonzero(np.bincount(group)[group] > 1)
    less = np.zeros(len(first), np.uint64)
    for place in range(depth - k + 1):
        window = at[first[crowded]] - place
        mine = crowded[(window >= 0) & (window <= last[first[crowded]])]
        where = base[first[mine]] + at[first[mine]] - place
        label = group[mine]
        for step in (*range(0, depth - 7, 8), depth - 8):
            digit = words[where + step].byteswap()
            by = np.lexsort((digit, label))
            mine, where, label, digit = mine[by], where[by], label[by], digit[by]
            new = np.r_[True, (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])] if len(by) else np.zeros(0, bool)
            label = np.cumsum(new) - 1
            more = np.bincount(label)[label] > 1 if len(by) else new
            mine, where, label = mine[more], where[more], label[more]
        if len(mine):
            heads = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            best = np.minimum.reduceat(smallest[mine], heads)
            best = np.repeat(best, np.diff(np.r_[heads, len(mine)]))
            bit = np.uint64(1) << (at[first[mine]] - place).astype(np.uint64)
            less[mine] |= np.where(best < smallest[mine], bit, np.uint64(0))
    bits = np.where(smallest[run_of] < least, np.uint64(0xFFFFFFFFFFFFFFFF), less[run_of])
    out, low = [], 0
    for i, (chunk, count) in enumerate(zip(sent.column("chunk").to_pylist(), counts)):
        own = bits[low:low + count][np.frombuffer(sent.column("run_of")[i].as_py(), "<u4")]
        places = np.frombuffer(sent.column("places")[i].as_py(), "<u4")
        whole = np.frombuffer(sent.column("whole")[i].as_py(), "<u4")
        places, own = np.r_[places[own != 0], whole], np.r_[own[own != 0], np.full(len(whole), 0xFFFFFFFFFFFFFFFF, np.uint64)]
        if len(places):
            out.append((chunk, places.tobytes(), own.astype("<u8").tobytes()))
        low += count
    return _rows(out, _BITS)


def _cut(docs: pa.Table, answers: pa.Table, depth: int) -> pa.Table:
    if not docs.num_rows:
        return _OUT.empty_table()
    own = _Chunk(docs, depth)
    change = np.zeros(len(own.bytes) + 1, np.int32)
    for places, bits in zip(answers.column("places").to_pylist(), answers.column("bits").to_pylist()):
        runs, bits = np.frombuffer(places, "<u4"), np.frombuffer(bits, "<u8")
        for t in range(int((own.last[runs] - own.first[runs]).max()) + 1):
            hit = (((bits >> np.uint64(t)) & np.uint64(1)) == 1) & (own.first[runs] + t <= own.last[runs])
            np.add.at(change, own.first[runs[hit]] + t, 1)
            np.add.at(change, own.first[runs[hit]] + t + depth, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
    low, high = edges[0::2], edges[1::2]
    doc = np.searchsorted(own.starts, low, "right") - 1
    # An empty document starts where the gap byte of the one before it is; a span never does.
    spans = pa.StructArray.from_arrays([pa.array(low - own.starts[doc], pa.int64()), pa.array(high - own.starts[doc], pa.int64())], ["start", "end"])
    offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(own.ids)))].astype(np.int32)
    kept = []
    for d, text in enumerate(own.texts):
        a, b = offsets[d], offsets[d + 1]
        if a == b:
            kept.append(text)
            continue
        cuts = np.r_[0, np.c_[low[a:b], high[a:b]].reshape(-1) - own.starts[d], len(text)]
        kept.append(b"".join(text[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2)))
    return pa.table([pa.array(own.ids, pa.int64()), pa.array(own.lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans),
                     pa.array(kept, pa.binary())], schema=_OUT)


def remove_repeats(docs: DataFrame, depth: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (byte ranges, maximal, in order), kept (the remaining bytes) for every row.

    A byte goes if a string of ``depth`` bytes that covers it also starts in a document with a smaller doc_id.

    * A null text counts as empty: no bytes, no ranges. Texts shorter than ``depth`` keep everything.
    * A null doc_id is larger than every number. Rows with equal doc_ids remove nothing from each other.
    * An empty table gives an empty result. Other columns are ignored. ``depth`` is 16 to 70.
    """
    if not 16 <= depth <= 70:
        raise ValueError("depth must be 16 to 70 bytes")
    rows = id_and_text(docs, id_col, text_col)
    total = text_bytes(rows)
    chunks, buckets = total // CHUNK_BYTES + 1, total // BUCKET_BYTES + 1
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    own = rows.repartition(chunks // 2 + 1, "chunk").groupBy("chunk")
    held = (own.applyInArrow(lambda t: _ask(t, depth, buckets), _DDL[id(_ASKED)])
            .groupBy("bucket").applyInArrow(_answer, _DDL[id(_HELD)]))
    bits = (own.cogroup(held.groupBy("chunk")).applyInArrow(lambda t, h: _send(t, h, depth, buckets), _DDL[id(_RUNS)])
            .groupBy("bucket").applyInArrow(lambda t: _order(t, depth), _DDL[id(_BITS)]))
    return own.cogroup(bits.groupBy("chunk")).applyInArrow(lambda t, b: _cut(t, b, depth), _DDL[id(_OUT)])
