"""Alignment of two tokenizers over the same bytes.

Text is cut into units, white space with what follows it, where both tokenizers surely have a border: in front of a blank behind a character
that is not white space (white space at the end stays with what is before it). Character offsets of the first tokenizer and byte spans of the second are coarse cuts of a unit; tokens whose cut
differs in width from their own bytes (parts of a character, byte pieces) are placed by their decoded bytes. What a unit becomes is the same
everywhere, so a worker remembers it.

A pair of tokens can only end together where one's bytes end with the other's, so the number of pairs is bounded by the two vocabularies,
whatever the corpus. Their counts are broadcast within that bound.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelwright.session import materialise

#: Characters of text that are aligned at a time, and units that a worker remembers.
PART = 1 << 19
REMEMBERED = 200_000
#: Links that are judged at a time, and new units that are encoded as one text.
LINKS = 1 << 19
JOINED = 100
#: Pairs of two vocabularies that may be broadcast (16 bytes each).
MOST_PAIRS = 1 << 24
#: Unicode white space.
SPACES = "\t-\r \x85\xa0  -     　"
_OTHER = SPACES.replace(" ", "")
_UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+(?:[{_OTHER}][{SPACES}]*[^{SPACES}]+)*(?:[{SPACES}]+\\Z)?|[{SPACES}]+")

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str):
    """Both tokenizers and the bytes of each of their tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    of_char = byte_of_char()
    of_a = [b""] * a.get_vocab_size()
    for token, i in a.get_vocab().items():
        of_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return a, b, of_a, of_b


def possible_pairs(of_a: list[bytes], of_b: list[bytes]) -> int:
    """How many pairs of tokens may end together: one's bytes end with the other's."""
    from collections import Counter

    ends_a = Counter(t[i:] for t in of_a for i in range(len(t)))
    whole_a = Counter(of_a)
    return sum(ends_a[t] for t in of_b) + sum(whole_a[t[i:]] for t in of_b for i in range(1, len(t)))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> "Aligner":
    return Aligner(path_a, path_b)


class Aligner:
    """Remembers the units a worker has met, up to a bound; what it remembers never changes a result."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.of_a, self.of_b = vocabularies(path_a, path_b)
        self.length = [np.array([len(t) for t in of], np.int64) for of in (self.of_a, self.of_b)]
        self.begin = [np.cumsum(n) - n for n in self.length]
        self.flat = [np.frombuffer(b"".join(of), np.uint8) for of in (self.of_a, self.of_b)]
        self.names = [str(i).encode() + end for of, ends in ((self.of_a, (b",", b"|")), (self.of_b, (b",", b";"))) for i in range(len(of)) for end in ends]
        self._forget()

    def _forget(self) -> None:
        self.slot, self.shown = {}, []
        self.n_a, self.n_b, self.n_links, self.first, self.links = ([np.zeros(0, np.int64)] for _ in range(5))

    def _columns(self):
        for name in ("n_a", "n_b", "n_links", "first", "links"):
            parts = getattr(self, name)
            if len(parts) > 1:
                setattr(self, name, [np.concatenate(parts)])
        return self.n_a[0], self.n_b[0], self.n_links[0], self.first[0], self.links[0]

    def _learn(self, units: list[str]) -> None:
        """The tokens, their ends and the groups of new units; a unit whose tokens are not its bytes gets -1 tokens."""
        # Units follow one another in a text as they are, but for white space at the end and U+2581, which may join what comes next.
        alone = [u[-1] in SPACES or "▁" in u for u in units]
        order = [i for i, own in enumerate(alone) if not own]
        texts = ["".join([units[i] for i in order[k:k + JOINED]]) for k in range(0, len(order), JOINED)]
        order += [i for i, own in enumerate(alone) if own]
        texts += [u for u, own in zip(units, alone) if own]
        raw = [units[i].encode() for i in order]
        size = np.array([len(r) for r in raw])
        base = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.base, self.size, self.data = base, size, data
        ids_a, ends_a, of_a, good_a = self._placed(*self._first(texts), self.length[0], self.flat[0], self.begin[0])
        ids_b, ends_b, of_b, good_b = self._placed(*self._second(texts), self.length[1], self.flat[1], self.begin[1])
        good = good_a & good_b
        count_a, count_b = (np.bincount(of, minlength=len(raw)) for of in (of_a, of_b))
        in_a, in_b = good[of_a], good[of_b]
        ids_a, ends_a, of_a, ids_b, ends_b, of_b = ids_a[in_a], ends_a[in_a], of_a[in_a], ids_b[in_b], ends_b[in_b], of_b[in_b]
        # Ends are places in all units in a row, so they ascend, and an end in both lists is a common border.
        ends, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        links = ids_b[at_b] * len(self.of_a) + ids_a[at_a]
        n_links = np.bincount(of_a[at_a], minlength=len(raw)).astype(np.int64)
        # A token is followed by a comma; the last ones of a group by a bar and a semicolon.
        group = np.r_[2 * np.searchsorted(ends, ends_a), 2 * np.searchsorted(ends, ends_b) + 1]
        name = np.r_[2 * ids_a, 2 * (len(self.of_a) + ids_b)]
        name[np.r_[at_a, len(ids_a) + at_b]] += 1
        names = self.names
        shown = [names[i] for i in name[np.argsort(group, kind="stable")].tolist()]
        edges = np.r_[0, np.cumsum(np.where(good, count_a + count_b, 0))].tolist()
        text = [b"".join(shown[i:j])[:-1] for i, j in zip(edges[:-1], edges[1:])]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.shown += [text[i] for i in back.tolist()]
        self.first.append((self.links_held + np.cumsum(n_links) - n_links)[back])
        self.links_held += len(links)
        self.n_a.append(np.where(good, count_a, -1)[back])
        self.n_b.append(np.where(good, count_b, -1)[back])
        self.n_links.append(n_links[back])
        self.links.append(links)

    def _first(self, texts: list[str]):
        """Ids of the first tokenizer, and the bytes at which its character offsets begin and end, in all texts in a row."""
        encoded = self.a.encode_batch(texts, add_special_tokens=False)
        ids = np.array([i for e in encoded for i in e.ids], np.int64)
        cuts = np.array([x for e in encoded for cut in e.offsets for x in cut], np.int64).reshape(-1, 2)
        chars = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        place = np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))]
        head = np.repeat(np.cumsum(chars) - chars, [len(e) for e in encoded])
        return ids, place[head + cuts[:, 0]], place[head + cuts[:, 1]]

    def _second(self, texts: list[str]):
        """Ids of the second tokenizer, and its spans in bytes; the blank in front of a text belongs to its first piece."""
        encoded = [e.pieces for e in self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)]
        rows = np.array([x for pieces in encoded for p in pieces for x in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3)
        count, size = np.array([len(x) for x in encoded]), np.array([len(t.encode()) for t in texts])
        head = np.repeat(np.cumsum(size) - size, count)
        begin = head + rows[:, 1] + 1
        heads = (np.cumsum(count) - count)[count > 0]
        begin[heads] = head[heads]
        return rows[:, 0], begin, head + rows[:, 2] + 1

    def _placed(self, ids, begin, end, length, flat, at):
        """Ids, ends and units of all tokens in a row, and whether the tokens of a unit are its bytes."""
        own = length[ids]
        # A part of a character has the cut of the whole character; a byte piece may have an empty one.
        of = np.searchsorted(self.base, begin, "right") - 1
        total = np.cumsum(own)
        sums = np.bincount(of, weights=own, minlength=len(self.size)).astype(np.int64)
        heads = np.cumsum(sums) - sums
        decoded = self.base[of] + total - heads[of]
        ends = np.where(end - begin == own, end, decoded)
        good = sums == self.size
        fits = good[of]
        some, start = own[fits], (decoded - own)[fits]
        place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        wrong = flat[np.repeat(at[ids[fits]], some) + place] != self.data[np.repeat(start, some) + place]
        good[np.repeat(of[fits], some)[wrong]] = False
        return ids, np.where(good[of], ends, decoded), of, good

    def align(self, texts: list[str]):
        """For each text: tokens of both, groups, digest and links."""
        if len(self.slot) > REMEMBERED:
            self._forget()
        if not self.slot:
            self.links_held = 0
        slots, sizes, fresh, known = [], [], [], self.slot
        for text in texts:
            units = _UNIT.findall(" " + text) if text else []
            for unit in units:
                at = known.get(unit)
                if at is None:
                    known[unit] = at = len(known)
                    fresh.append(unit)
                slots.append(at)
            sizes.append(len(units))
        if fresh:
            self._learn(fresh)
        n_a, n_b, n_links, first, links = self._columns()
        edges = np.r_[0, np.cumsum(np.array(sizes, np.int64))]
        at = np.array(slots, np.int64)
        bad = np.r_[0, np.cumsum(n_a[at] < 0)]
        sums = [np.r_[0, np.cumsum(column[at])] for column in (n_a, n_b, n_links)]
        total = sums[2]
        pairs = links[np.repeat(first[at] - total[:-1], n_links[at]) + np.arange(total[-1])]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if low == high or bad[high] > bad[low]:
                yield 0, 0, 0, "", b""
                continue
            shown = hashlib.sha256(b";".join([self.shown[s] for s in slots[low:high]])).hexdigest()
            yield *(int(s[high] - s[low]) for s in sums), shown, pairs[total[low]:total[high]].astype("<u4" if self.small else "<i8").tobytes()

    @property
    def small(self) -> bool:
        return len(self.of_a) * len(self.of_b) <= 1 << 32


def _batches(batches, path_a: str, path_b: str):
    own = aligner(path_a, path_b)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    for batch in batches:
        for part in _parts(batch, pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), PART):
            rows = own.align(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Runs of rows of about so much each; a larger row is a part of its own."""
    if batch.num_rows:
        edges = np.unique(np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1, batch.num_rows])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield batch.slice(low, high - low)


def _links(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch in a row, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([np.zeros(0, kind), *parts]), np.array([len(p) for p in parts], np.int64)


def _in_parts(batches, column: int, kind: str):
    for batch in batches:
        yield from _parts(batch, pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize, LINKS)


def _count(batches, kind: str):
    for batch in _in_parts(batches, 0, kind):
        pairs, counts = np.unique(_links(batch.column(0), kind)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_links: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, links (optional) for every row; ``links`` holds ids of both tokenizers.

    A group runs from one place where tokens of both end to the next; the two tokens that end there are linked, so a group has one link. An
    id pair's count is the number of links of the whole table that hold it; ``n_best`` counts links whose pair is (or ties as) the most frequent
    of its second id.

    * A null or empty text has no tokens, nor has one whose tokens do not join to its bytes (a literal U+2581 becomes a blank).
    * A null doc_id is a document like any other; repeated rows count each time.
    * An empty table gives an empty result. Other columns, whatever their names, are left behind.
    """
    a, b, of_a, of_b = vocabularies(path_a, path_b)
    bound = possible_pairs(of_a, of_b)
    if bound > MOST_PAIRS:
        raise ValueError(f"{bound} pairs of tokens may end together; at most {MOST_PAIRS} are broadcast")
    kind, size_a = ("<u4" if len(of_a) * len(of_b) <= 1 << 32 else "<i8"), len(of_a)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    aligned = materialise(rows.mapInArrow(lambda batches: _batches(batches, path_a, path_b), SCHEMA))
    counts = aligned.select("links").mapInArrow(lambda batches: _count(batches, kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs, n = counts.column("pair").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    heads = np.flatnonzero(np.r_[True, np.diff(pairs // size_a) != 0]) if len(pairs) else np.zeros(0, np.int64)
    best = n == np.repeat(np.maximum.reduceat(n, heads), np.diff(np.r_[heads, len(n)])) if len(n) else np.zeros(0, bool)
    shared = docs.sparkSession.sparkContext.broadcast((pairs.astype(kind), n, best))

    def judged(batches):
        known, n, best = shared.value
        for batch in _in_parts(batches, 5, kind):
            flat, sizes = _links(batch.column(5), kind)
            at, edge = np.searchsorted(known, flat), np.r_[0, np.cumsum(sizes)]
            good, many = (np.diff(np.r_[0, np.cumsum(x[at], dtype=np.int64)][edge]) for x in (best, n))
            columns = [batch.column(i) for i in range(4)] + [batch.column(3), pa.array(good), pa.array(many), batch.column(4)]
            if with_links:
                ids = flat.astype(np.int64)
                pair = [pa.array((ids % size_a).astype(np.int32)), pa.array((ids // size_a).astype(np.int32))]
                columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays(pair, ["a", "b"])))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", links array<struct<a:int,b:int>>" * with_links
    names = [field.split()[0] for field in schema.split(", ")]
    return aligned.mapInArrow(judged, schema)
