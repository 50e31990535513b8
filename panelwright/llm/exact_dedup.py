"""Exact deduplication with Patricia-trie owners.

Texts are dealt out by the length and a hash of their normalised bytes. Each partition inserts the full byte
strings into a compressed radix trie whose terminal nodes hold the owner of the text: the longest original, then
the smallest identifier. Equality is decided by the trie's bytes, never by a hash. A trie that outgrows its memory
writes its largest subtrees to the task's scratch file and finishes them one by one.

A text that many rows share is collapsed by every map task before the shuffle, so a hot text costs one row per task.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import SPACE, SPACE_CLASS, id_and_text

#: Bytes of distinct texts that a combiner or a trie holds in memory.
HELD_BYTES = 48 << 20
_COMBINED = "length long, content long, body binary, points long, owner long, copies long"
_OWNERS = "text_sha256 string, keep_id long, keep_points long, group_size long"
_ROW, _KEY = "row among those of one doc_id and text", "doc_id and text"
_RECORD = struct.Struct("<q?qqq")


def normalised(text: str) -> bytes:
    return text.encode("utf-8").translate(None, SPACE)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (points, owner): more code points, then the smaller identifier; a null identifier comes last."""
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    if a[1] is None or b[1] is None:
        return b if a[1] is None else a
    return a if a[1] <= b[1] else b


def _combine(batches):
    """One row for each distinct text among as many rows as fit in memory."""
    held: dict[bytes, tuple] = {}
    size = 0

    def flush():
        rows = [(len(k), zlib.crc32(k), k, *v) for k, v in held.items()]
        for at in range(0, len(rows), 2000):
            yield _batch(rows[at:at + 2000], _COMBINED_SCHEMA)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = normalised(text)
            old = held.get(key)
            mine = (len(text), doc_id)
            if old is None:
                size += len(key) + 200
                held[key] = (*mine, 1)
            else:
                held[key] = (*_better(mine, old[:2]), old[2] + 1)
            if size > HELD_BYTES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


_COMBINED_SCHEMA = pa.schema([("length", pa.int64()), ("content", pa.int64()), ("body", pa.binary()), ("points", pa.int64()),
                              ("owner", pa.int64()), ("copies", pa.int64())])
_OWNER_SCHEMA = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("keep_points", pa.int64()), ("group_size", pa.int64())])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Node:
    __slots__ = ("label", "children", "end")

    def __init__(self, label: bytes, end=None):
        self.label, self.children, self.end = label, {}, end


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A radix trie over the bytes behind a prefix that all its keys share; subtrees under the first byte can be spilled."""

    def __init__(self, limit: int = HELD_BYTES, depth: int = 0):
        self.limit, self.depth = limit, depth
        self.root, self.bytes, self.ends = _Node(b""), 0, 0
        self.spilled: dict[bytes, list] = {}

    def insert(self, key: bytes, end: tuple) -> None:
        """``end``: (points, owner, copies)."""
        branch = key[self.depth:self.depth + 1]
        if branch in self.spilled:
            self._append(branch, key[self.depth:], end)
            return
        node, at = self.root, self.depth
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], end)
                self.bytes += len(key) - at + 200
                self.ends += 1
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = _shared(child.label, key, at)
            upper = _Node(child.label[:cut])
            child.label = child.label[cut:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.bytes += 200
            node, at = upper, at + cut
        else:
            if node.end is None:
                node.end, self.ends = end, self.ends + 1
            else:
                node.end = (*_better(end[:2], node.end[:2]), end[2] + node.end[2])
        if self.bytes > self.limit and self.ends > 1 and len(self.root.children):
            self._spill()

    def _spill(self) -> None:
        """Write the largest subtree under the root to a scratch file of this task."""
        first, child = max(self.root.children.items(), key=lambda x: _weight(x[1]))
        branch = bytes([first])
        self.spilled[branch] = [tempfile.TemporaryFile(), None, None]
        for tail, end in _walk(child):
            self._append(branch, tail, end)
        del self.root.children[first]
        self.bytes -= _weight(child)

    def _append(self, branch: bytes, tail: bytes, end: tuple) -> None:
        """Write what follows the shared prefix, and note how much of it all tails of the branch share."""
        file, first, shared = self.spilled[branch]
        self.spilled[branch][1:] = (tail, len(tail)) if first is None else (first, min(shared, _shared(first[:shared], tail, 0)))
        points, owner, copies = end
        file.write(_RECORD.pack(len(tail), owner is None, points, owner or 0, copies) + tail)

    def owners(self, head: bytes = b""):
        """All (key, end), subtree by subtree."""
        for tail, end in _walk(self.root):
            yield head + tail, end
        self.root = _Node(b"")
        for file, _, shared in self.spilled.values():
            file.seek(0)
            part = Trie(self.limit, shared)
            prefix = b""
            while record := file.read(_RECORD.size):
                length, null, points, owner, copies = _RECORD.unpack(record)
                tail = file.read(length)
                prefix = tail[:shared]
                part.insert(tail, (points, None if null else owner, copies))
            file.close()
            yield from part.owners(head + prefix)
        self.spilled = {}


def _walk(node: _Node):
    """(bytes below and with this node's label, end) of every terminal node."""
    stack = [(node, b"")]
    while stack:
        node, head = stack.pop()
        head += node.label
        if node.end is not None:
            yield head, node.end
        stack += [(c, head) for c in node.children.values()]


def _weight(node: _Node) -> int:
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node.label) + 200
        stack += node.children.values()
    return total


def _own(batches):
    trie = Trie()
    for batch in batches:
        body, points, owner, copies = (batch.column(i).to_pylist() for i in range(2, 6))
        for row in zip(body, points, owner, copies):
            trie.insert(bytes(row[0]), row[1:])
    rows = []
    for key, (points, owner, copies) in trie.owners():
        rows.append((hashlib.sha256(key).hexdigest(), owner, points, copies))
        if len(rows) == 5000:
            yield _batch(rows, _OWNER_SCHEMA)
            rows = []
    yield _batch(rows, _OWNER_SCHEMA)


def _digests(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(normalised(t)).hexdigest() for t in texts])],
            names=["doc_id", "points", "text_sha256"])


def text_owners(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, keep_points, group_size. ``docs`` has (doc_id, text)."""
    combined = docs.mapInArrow(_combine, _COMBINED)
    return combined.repartition("length", "content").mapInArrow(_own, _OWNERS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    * A null text counts as empty; empty and all-blank texts are one group.
    * A null doc_id is a document like any other; it loses ties against any number.
    * Rows that repeat doc_id and text are counted as copies; exactly one of them can be kept.
    * An empty table gives an empty result. Other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    # Rows under one doc_id and text are numbered first: that key is never hot, while the text alone may be.
    repeats = Window.partitionBy("text_sha256", "doc_id").orderBy(F.desc("points"))
    marked = rows.mapInArrow(_digests, "doc_id long, points long, text_sha256 string").withColumn("repeat", F.row_number().over(repeats))
    return (marked.join(text_owners(rows), "text_sha256")
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & (F.col("repeat") == 1)).alias("kept"),
                    "text_sha256"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; rows that repeat doc_id and text stay once."""
    kept = exact_dedup(docs).where("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("key kept"))
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.withColumn(_KEY, _row_key(docs["doc_id"], F.sha2(F.regexp_replace(text, SPACE_CLASS + "+", ""), 256)))
    # One key for the join and the window: the texts move once.
    first = Window.partitionBy(_KEY).orderBy(F.length(F.coalesce("text", F.lit(""))).desc())
    one = keyed.join(kept, keyed[_KEY] == kept["key kept"], "left_semi").withColumn(_ROW, F.row_number().over(first))
    return one.where(F.col(_ROW) == 1).drop(_ROW, _KEY)


def _row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)
