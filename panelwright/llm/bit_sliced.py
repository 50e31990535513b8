"""Exact top-k inner products over a bit-sliced index.

The index keeps every vector, block by block: for each attribute, one bitmap of the block's rows per bit of the quantised
value. A query multiplies by adding: the bits of its own attributes say at which weight a slice (or, for a negative factor,
its complement) is added, three bitmaps to a sum and a carry until one bitmap is left per weight. The k best rows are then read
from the most significant slice downward; rows that are still equal after the last one are the boundary, and the smallest
identifiers of it fill the places left. Scores are whole numbers throughout, so nothing is approximate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 8192
QUERY_BLOCK = 64
_VECTORS = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("values", pa.binary())])
_INDEX_DDL = "dim int, block long, ids binary, low long, bits int, slices binary"
_INDEX = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("low", pa.int64()), ("bits", pa.int32()), ("slices", pa.binary())])
_PACKED = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("query_ids", pa.binary()), ("queries", pa.binary())])
_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("vec_id").to_numpy()
    dim = rows.column("dim")[0].as_py()
    values = rows.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    by = np.argsort(ids, kind="stable")
    return ids[by], values[by]


def _build(rows: pa.Table) -> pa.Table:
    """The slices of a block, rows in the order of their identifiers."""
    ids, values = _matrix(rows)
    low = int(values.min()) if values.size else 0
    shifted = (values - low).T
    bits = max(int(shifted.max()).bit_length(), 1) if values.size else 1
    size = -(-len(ids) // 64) * 8
    slices = np.zeros((len(shifted), bits, size), np.uint8)
    for b in range(bits):
        packed = np.packbits((shifted >> b) & 1, axis=1, bitorder="little")
        slices[:, b, :packed.shape[1]] = packed
    return pa.table([[rows.column("dim")[0].as_py()], [rows.column("block")[0].as_py()], [ids.astype("<i8").tobytes()], [low], [bits], [slices.tobytes()]], schema=_INDEX)


def _pack(rows: pa.Table) -> pa.Table:
    ids, values = _matrix(rows)
    return pa.table([[rows.column("dim")[0].as_py()], [rows.column("part")[0].as_py()], [ids.astype("<i8").tobytes()], [values.astype("<i8").tobytes()]], schema=_PACKED)


class BitSliced:
    def __init__(self, dim: int, ids: bytes, low: int, bits: int, slices: bytes):
        self.ids, self.low, self.bits = np.frombuffer(ids, "<i8"), low, bits
        plain = np.frombuffer(slices, "<u8").reshape(dim, bits, -1)
        self.slices = np.stack([plain, ~plain])
        self.rows = np.zeros(plain.shape[2] * 64, np.uint8)
        self.rows[:len(self.ids)] = 1
        self.rows = np.packbits(self.rows, bitorder="little").view("<u8")

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the shifted scores, from the least weight up."""
        factor, negative = np.abs(query), (query < 0).astype(np.int64)
        of_bit = [np.flatnonzero((factor >> j) & 1) for j in range(int(factor.max(initial=0)).bit_length())]
        out, carried, weight = [], [], 0
        while weight < len(of_bit) + self.bits - 1 or carried:
            stack = carried + [self.slices[negative[d], d, weight - j] for j, d in enumerate(of_bit) if len(d) and 0 <= weight - j < self.bits]
            carried = []
            level = np.concatenate(stack) if stack else np.zeros((0, len(self.rows)), "<u8")
            while len(level) > 1:
                third = len(level) // 3
                if third:
                    a, b, c, rest = level[:third], level[third:2 * third], level[2 * third:3 * third], level[3 * third:]
                    odd = a ^ b
                    carried.append((a & b) | (odd & c))
                    level = np.concatenate([odd ^ c, rest])
                else:
                    carried.append((level[:1] & level[1:]))
                    level = level[:1] ^ level[1:]
            out.append(level[0] if len(level) else np.zeros(len(self.rows), "<u8"))
            weight += 1
        return out

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of the k best rows but those called ``own_id``, in no order."""
        slices = self.sums(query)
        open_rows = self.rows.copy()
        for own in range(*np.searchsorted(self.ids, [own_id, own_id + 1])):
            open_rows[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure = np.zeros_like(open_rows)
        for bitmap in reversed(slices):
            higher = open_rows & bitmap
            count = int(np.bitwise_count(sure | higher).sum())
            if count > k:
                open_rows = higher
            else:
                sure |= higher
                open_rows = open_rows & ~bitmap
        rows = [np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, open_rows)]
        best = np.r_[rows[0], rows[1][:max(k - len(rows[0]), 0)]]  # rows are in the order of identifiers
        score = np.zeros(len(best), np.int64)
        for weight, bitmap in enumerate(slices):
            score += (((bitmap[best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64)) << weight
        return self.ids[best], score + self.low * int(query.sum()) - int(-query[query < 0].sum()) * ((1 << self.bits) - 1)


def _search(batches, k: int):
    for batch in batches:
        for row in batch.to_pylist():
            index = BitSliced(row["dim"], row["ids"], row["low"], row["bits"], row["slices"])
            names, queries = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["queries"], "<i8").reshape(-1, row["dim"])
            found = [(name, *index.top(q, int(name), k)) for name, q in zip(names, queries)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])),
                                              pa.array(np.concatenate([f[2] for f in found]))], schema=_BEST)


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, values): floor(scale * x) of the vectors that take part."""
    x = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (x.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)
            .select("vec_id", F.size("vector").alias("dim"), F.transform("vector", lambda v: F.floor(v * scale).cast("bigint")).alias("values")))


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block of all vectors of one length; ``rows`` comes from ``quantised``."""
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block").applyInArrow(_build, _INDEX_DDL)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products for each vector whose identifier is divisible by ``every``.

    * Vectors that are null or hold null or non-finite components take no part, nor do rows without an identifier.
    * Ties go to the smaller vec_id. Vectors of different lengths are not compared. A query never finds rows of its own identifier.
    * Rows that repeat an identifier are searched one by one. With fewer than k candidates all are returned; an empty table gives
      an empty result. Scores must fit 64 bits. Other columns are ignored.
    """
    rows = quantised(vectors, scale, id_col, vector_col)
    blocks = rows.count() // BLOCK_ROWS + 1
    queries = rows.where(F.col("vec_id") % every == 0)
    parts = blocks * BLOCK_ROWS // every // QUERY_BLOCK + 1
    packed = (queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).groupBy("dim", "part")
              .applyInArrow(_pack, "dim int, part long, query_ids binary, queries binary")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))))
    found = build_index(rows, blocks).hint("merge").join(packed.hint("merge"), ["dim", "block"]).mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
