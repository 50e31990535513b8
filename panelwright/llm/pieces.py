"""SentencePiece encoding with seeded merge dropout, and decoding without loss.

A text is a sequence of units: a run of spaces with the word behind it. No piece of a merge-type model spans two units. Within a unit the
agenda always takes the best merge, the leftmost of equals. ``encode_occurrences`` decides anew at every place: what the agenda skips
follows from a hash of seed, document, pass and place of the unit, so every rerun, task and machine cuts a text alike, while two
occurrences of a word are cut independently. Characters that the model lacks become bytes.

What a unit becomes when the agenda skips a given set of its steps is the same everywhere, and only this is remembered. Units of usual
length are merged all at once, one merge per unit and round, in arrays; longer ones by a heap, under the same rule.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import stir

#: Symbols up to which a unit has fewer than 64 candidates, n - 1 at first and two per merge, and cuts that a worker remembers.
SHORT_UNIT = 20
CUTS = 250_000
#: Characters of text that are encoded at a time.
PART = 1 << 19
_UNIT = re.compile("▁*[^▁]+|▁+")
#: Stands for a literal U+2581, which must not come back as a space: no text holds a lone surrogate.
_LITERAL = "\udfff"
_LITERAL_CODE = 0xDFFF
_NONE = np.int64(1 << 40)


@lru_cache(maxsize=4)
def model(path: str) -> "Model":
    return Model(path)


class Model:
    def __init__(self, path: str):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [loaded.id_to_piece(i) for i in range(loaded.get_piece_size())]
        plain = [i for i, p in enumerate(pieces) if not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_byte(i))]
        self.id_of = {pieces[i]: i for i in plain}
        self.byte = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if loaded.is_byte(i)}
        of_byte = {i: b for b, i in self.byte.items()}
        self.bytes = [bytes([of_byte[i]]) if i in of_byte else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        order = sorted(plain, key=lambda i: -loaded.get_score(i))
        # Pieces of one score are equal in the agenda.
        self.rank, last, rank = {}, None, -1
        for i in order:
            if loaded.get_score(i) != last:
                last, rank = loaded.get_score(i), rank + 1
            self.rank[i] = rank
        pairs = {}
        for i in plain:
            p = pieces[i]
            for cut in range(1, len(p)):
                left, right = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.pairs = pairs
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.merged = keys[by], np.array(list(pairs.values()), np.int64)[by]
        self.ranks = np.array([self.rank[i] for i in self.merged])
        self.size = len(pieces)
        # Where a pair may stand among the keys, by a hash; pairs whose place another one took are looked up by search.
        self.place = np.full(1 << 21, -1, np.int32)
        self.place[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        self.shared = np.bincount(self._slot(self.keys), minlength=1 << 21) > 1

        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each pair among the merges, and whether it is one."""
        slot = self._slot(pairs)
        found = self.place[slot]
        fits = self.keys[found] == pairs
        again = np.flatnonzero(self.shared[slot] & ~fits)
        if len(again):
            found[again] = np.minimum(np.searchsorted(self.keys, pairs[again]), len(self.keys) - 1)
            fits[again] = self.keys[found[again]] == pairs[again]
        return found, fits

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the single characters of all units in a row, how many each unit has, and a number for each unit's text.

        A character that the model lacks becomes bytes, numbered behind the pieces so that they never merge.
        """
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        count = np.array([len(u) for u in units])
        heads = np.cumsum(count) - count
        place = np.arange(len(chars)) - np.repeat(heads, count)
        number = np.add.reduceat(stir(chars.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))), heads)
        ids = self.of_char[chars]
        lacking = np.flatnonzero(ids < 0)
        if len(lacking):
            raw = [("▁" if chars[k] == _LITERAL_CODE else chr(chars[k])).encode() for k in lacking]
            width = np.ones(len(ids), np.int64)
            width[lacking] = [len(r) for r in raw]
            ids = np.repeat(ids, width)
            ids[ids < 0] = self.size + np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
            count = np.add.reduceat(width, heads)
        return ids, count, number


def units_of(text: str) -> list[str]:
    return _UNIT.findall("▁" + text.replace("▁", _LITERAL).replace(" ", "▁")) if text else []


def agenda(m: Model, ids: list[int], key: int, rate: float) -> list[int]:
    """The symbols of one unit of any length by a heap of candidates; the agenda skips the steps that the key says."""
    n = len(ids)
    before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    heap = []

    def offer(a):
        b = after[a] if a >= 0 else n
        if a >= 0 and b < n and (merged := m.pairs.get((ids[a], ids[b]))) is not None:
            heapq.heappush(heap, (m.rank[merged], a, b, end[b], merged))

    for a in range(n - 1):
        offer(a)
    gone = [False] * n
    key, nth, step = np.array([key], np.uint64), 0, 0
    skip_at = int(kept_before_skip(key, 0, rate)[0])
    while heap:
        _, a, b, stop, merged = heapq.heappop(heap)
        if gone[a] or gone[b] or after[a] != b or end[b] != stop:
            continue
        step += 1
        if step > skip_at:
            nth += 1
            skip_at = step + int(kept_before_skip(key, nth, rate)[0])
            continue
        gone[b], ids[a], end[a], after[a] = True, merged, stop, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(before[a])
        offer(a)
    return [i for i, dead in zip(ids, gone) if not dead]


def _with_skips(m: Model, ids: np.ndarray, size: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of up to SHORT_UNIT symbols, one row each, whose agenda skips the steps of a bit mask: pieces, how many, and steps."""
    width, n = len(size), int(size.max())
    ids = ids[:, :n].T.copy()
    column = np.arange(width)
    alive = np.arange(n)[:, None] < size
    after = np.repeat(np.arange(1, n + 1), width).reshape(n, width)
    before = after - 2
    after[size - 1, column] = n
    value = np.full((n, width), _NONE)
    steps = np.zeros(width, np.int64)

    def offer(a, column):
        b = after[a, column]
        real = np.flatnonzero(b < n)
        a, b, column = a[real], b[real], column[real]
        found, fits = m.find((ids[a, column] << 20) | ids[b, column])
        value[a, column] = np.where(fits, (m.ranks[found] << 20) | a, _NONE)

    for a in range(n - 1):
        some = np.flatnonzero(size > a + 1)
        offer(np.full(len(some), a), some)
    active, step = column, 0
    while True:
        best = value[:, active].min(axis=0)
        active, best = active[best < _NONE], best[best < _NONE]
        if not len(active):
            return ids.T[alive.T], alive.sum(axis=0), steps
        a = best & ((1 << 20) - 1)
        steps[active] += 1
        skip = (skips[active] >> np.uint64(step)) & np.uint64(1) == 1
        step += 1
        value[a[skip], active[skip]] = _NONE
        a, c = a[~skip], active[~skip]
        b = after[a, c]
        behind = after[b, c]
        found = m.find((ids[a, c] << 20) | ids[b, c])[0]
        ids[a, c], alive[b, c], after[a, c] = m.merged[found], False, behind
        value[a, c] = value[b, c] = _NONE
        inner = behind < n
        before[behind[inner], c[inner]] = a[inner]
        offer(a, c)
        p = before[a, c]
        value[p[p >= 0], c[p >= 0]] = _NONE
        offer(p[p >= 0], c[p >= 0])


def document_keys(ids: list, texts: list[str], turns: list[int], seed: int) -> np.ndarray:
    """What all choices within each document depend on; the text tells documents without a doc_id apart."""
    own = [(zlib.crc32(str(i).encode()) << 32) | zlib.crc32(t.encode("utf-8", "surrogatepass")) for i, t in zip(ids, texts)]
    return stir(stir(np.array(own, np.uint64)) + np.array([(seed << 32) + turn for turn in turns], np.uint64))


#: More steps than a unit has.
_NEVER = 1 << 40


def kept_before_skip(keys: np.ndarray, nth: int, rate: float) -> np.ndarray:
    """How many candidates the agenda keeps between the ``nth`` skipped one and the next: each is skipped with ``rate``."""
    if rate <= 0:
        return np.full(len(keys), _NEVER)
    u = ((stir(keys + np.uint64(nth + 1)) >> np.uint64(11)).astype(float) + 1) / (1 << 53)
    return np.zeros(len(keys), np.int64) if rate >= 1 else np.minimum(np.log(u) / np.log1p(-rate), _NEVER).astype(np.int64)


class OccurrenceEncoder:
    """Cuts every occurrence of a unit by choices of its own.

    A cut is a unit with the set of agenda steps that are skipped; it holds the pieces and the number of steps. From a cut an occurrence
    goes on to the one that skips one more step, until the next step to skip lies behind the last. What is remembered of the cuts
    never changes a result.
    """

    def __init__(self, path: str, rate: float, seed: int):
        self.model, self.rate, self.seed = model(path), rate, seed
        self.byte = np.array([self.model.byte[b] for b in range(256)])
        own = np.array([len(b) for b in self.model.bytes], np.int64)
        self.bytes = np.frombuffer(b"".join(self.model.bytes), np.uint8), own, np.cumsum(own) - own
        self._forget()

    def _forget(self):
        self.unit, self.names, self.root = {}, [], np.zeros(0, np.int64)
        # The ways from one cut to another, in order: cut and step, and the cut that skips this step as well.
        self.ways, self.way_to = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.symbols, self.size = np.zeros((0, SHORT_UNIT), np.int32), np.zeros(0, np.int64)
        self.flat, self.first, self.count, self.steps, self.of, self.skips = (np.zeros(0, t) for t in (np.uint16, np.int64, np.int64, np.int64, np.int64, np.uint64))

    def _bytes(self, rows: np.ndarray) -> np.ndarray:
        return np.where(rows >= self.model.size, self.byte[np.maximum(rows - self.model.size, 0) % 256], rows)

    def _learn(self, units: np.ndarray, skips: np.ndarray) -> None:
        """New cuts, in the order given."""
        first, counts, steps = (np.zeros(len(units), np.int64) for _ in range(3))
        size, flat, held = self.size[units], [self.flat], len(self.flat)
        for low, high in ((0, 8), (8, SHORT_UNIT)):
            some = np.flatnonzero((size > low) & (size <= high))
            if len(some):
                rows, counts[some], steps[some] = _with_skips(self.model, self.symbols[units[some]].astype(np.int64), size[some], skips[some])
                first[some] = held + np.cumsum(counts[some]) - counts[some]
                flat.append(self._bytes(rows).astype(np.uint16))
                held += len(rows)
        self.flat, self.first = np.concatenate(flat), np.r_[self.first, first]
        self.count, self.steps = np.r_[self.count, counts], np.r_[self.steps, steps]
        self.of, self.skips = np.r_[self.of, units], np.r_[self.skips, skips]

    def _cut(self, roots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The cut of each occurrence, from that of its unit without skips."""
        cut = roots.copy()
        going, at, nth = np.arange(len(cut)), np.zeros(len(cut), np.int64), 0
        while len(going):
            at = at + kept_before_skip(keys[going], nth, self.rate)
            on = at < self.steps[cut[going]]
            going, at, nth = going[on], at[on], nth + 1
            if not len(going):
                break
            ways, which = np.unique(cut[going] * 64 + at, return_inverse=True)
            place = np.searchsorted(self.ways, ways)
            fresh = np.ones(len(ways), bool)
            old = np.flatnonzero(place < len(self.ways))
            fresh[old] = self.ways[place[old]] != ways[old]
            to = np.zeros(len(ways), np.int64)
            to[~fresh] = self.way_to[place[~fresh]]
            if fresh.any():
                new = ways[fresh]
                to[fresh] = len(self.steps) + np.arange(len(new))
                self.ways, self.way_to = np.insert(self.ways, place[fresh], new), np.insert(self.way_to, place[fresh], to[fresh])
                self._learn(self.of[new // 64], self.skips[new // 64] | (np.uint64(1) << (new % 64).astype(np.uint64)))
            cut[going] = to[which]
            at = at + 1
        return cut

    def encode(self, ids: list, texts: list[str], turns: list[int] | None = None) -> list[np.ndarray]:
        """``turns``: the pass in which each document is taken."""
        if len(self.steps) > CUTS or len(self.unit) > CUTS:
            self._forget()
        slots, sizes, fresh = [], [], []
        for text in texts:
            units = units_of(text)
            for unit in units:
                at = self.unit.get(unit)
                if at is None:
                    self.unit[unit] = at = len(self.unit)
                    fresh.append(unit)
                slots.append(at)
            sizes.append(len(units))
        sizes, slots = np.array(sizes, np.int64), np.array(slots, np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        own = document_keys(ids, texts, turns or [0] * len(texts), self.seed)
        keys = stir(np.repeat(own, sizes) + stir((np.arange(len(slots)) - np.repeat(edges[:-1], sizes)).astype(np.uint64)))
        if fresh:
            self.names += fresh
            # Every unit has a row; those that are too long for it have an empty one and no cut.
            symbols, size, _ = self.model.symbols(fresh)
            row, short = np.repeat(np.arange(len(fresh)), size), np.repeat(size <= SHORT_UNIT, size)
            table = np.zeros((len(fresh), SHORT_UNIT), np.int32)
            table[row[short], (np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size))[short]] = symbols[short]
            begin = len(self.size)
            self.symbols, self.size = np.concatenate([self.symbols, table]), np.r_[self.size, size]
            self.root = np.r_[self.root, np.full(len(fresh), -1)]
            learnt = begin + np.flatnonzero(size <= SHORT_UNIT)
            if len(learnt):
                self.root[learnt] = len(self.steps) + np.arange(len(learnt))
                self._learn(learnt, np.zeros(len(learnt), np.uint64))
        if not len(slots):
            return [np.zeros(0, np.uint16) for _ in texts]
        long = np.flatnonzero(self.size[slots] > SHORT_UNIT)
        short = np.flatnonzero(self.size[slots] <= SHORT_UNIT)
        first, count = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        cut = self._cut(self.root[slots[short]], keys[short])
        flat = self.flat
        first[short], count[short] = self.first[cut], self.count[cut]
        if len(long):
            rows, count[long] = self._long([self.names[k] for k in slots[long]], keys[long])
            first[long] = len(flat) + np.cumsum(count[long]) - count[long]
            flat = np.r_[flat, rows]
        total = np.r_[0, np.cumsum(count)]
        out = flat[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        return [out[total[a]:total[b]] for a, b in zip(edges[:-1], edges[1:])]

    def _long(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, size, _ = self.model.symbols(units)
        edges = np.r_[0, np.cumsum(size)]
        parts = [np.array(agenda(self.model, symbols[a:b].tolist(), key, self.rate), np.int64) for a, b, key in zip(edges[:-1], edges[1:], keys)]
        return self._bytes(np.concatenate(parts)).astype(np.uint16), np.array([len(p) for p in parts])

    def lossless(self, parts: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the bytes of the pieces are those of each text behind the model's first blank."""
        flat, own, begin = self.bytes
        ids = np.concatenate(parts).astype(np.int64)
        size = own[ids]
        total = np.r_[0, np.cumsum(size)]
        data = flat[np.repeat(begin[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        edges = total[np.r_[0, np.cumsum([len(p) for p in parts])]].tolist()
        return [data[a + 1:b] == t.encode() for a, b, t in zip(edges[:-1], edges[1:], texts)]


def decode(m: Model, ids) -> str:
    """The text that was encoded, to the last character."""
    return b"".join([m.bytes[i] for i in ids])[1:].decode("utf-8")


@lru_cache(maxsize=1)
def encoder(path: str, rate: float, seed: int) -> OccurrenceEncoder:
    """A worker keeps what it has learnt from one task to the next."""
    return OccurrenceEncoder(path, rate, seed)


def _encode(batches, path: str, rate: float, seed: int):
    own = encoder(path, rate, seed)
    for batch in batches:
        names, texts, turns = (batch.column(i).to_pylist() for i in range(3))
        low, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= PART or i == len(texts) - 1:
                parts = own.encode(names[low:i + 1], texts[low:i + 1], turns[low:i + 1])
                offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:i + 1], batch.column(1)[low:i + 1], pieces, pa.array(own.lossless(parts, texts[low:i + 1]))],
                                                 names=["doc_id", "text", "pieces", "lossless"])
                low, size = i + 1, 0


def encode_occurrences(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", pass_col: str | None = None) -> DataFrame:
    """doc_id, text, pieces (array of ids), lossless (decoding gives the text back) for every row; each occurrence of a unit is cut by itself.

    ``path`` names the model file on every machine. ``rate`` is the share of candidate merges that are skipped; 0 gives the model's own
    segmentation. ``pass_col``, if given, names the pass in which a mix takes the document: two passes are cut differently.

    * A null text counts as empty; an empty text has no pieces. Any other text decodes to itself, blanks and U+2581 included.
    * A null doc_id is a document like any other; rows that repeat doc_id, text and pass are encoded alike.
    * An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    turn = F.coalesce(docs[pass_col].cast("bigint"), F.lit(0)) if pass_col else F.lit(0)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), turn.cast("bigint").alias("pass"))
    return rows.mapInArrow(lambda b: _encode(b, path, rate, seed), "doc_id long, text string, pieces array<int>, lossless boolean")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed collection of public tokenizers keeps a model."""
    import public_tokenizers

    return public_tokenizers.path(name)
