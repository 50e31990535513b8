"""Hashes of the words and word shingles of many texts at once.

The result depends on the text alone: any task, any batch and any machine gives a word the same hash.
"""

from __future__ import annotations

import numpy as np

from .common import SPACE

#: Texts are hashed together up to so many bytes; a longer text is hashed by itself.
PIECE_BYTES = 1 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IS_SPACE = np.isin(np.arange(256), list(SPACE))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _POWERS[name] = np.cumprod(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _hash_words(texts: list[bytes], stem: int = 0) -> tuple:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up, out=total[1:])
    words = stir((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    lengths = np.array([len(t) + 1 for t in texts])
    edges = np.searchsorted(start, np.r_[0, np.cumsum(lengths)])
    if not stem:
        return words, edges
    begin = stir((total[np.minimum(start + stem, end)] - total[start]) * down[start] + np.uint64(1 << 32))
    return words, edges, np.where(end - start > stem, begin, np.uint64(0))


def pieces(texts: list[bytes]):
    """Runs of texts of about PIECE_BYTES: (first, after the last)."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE_BYTES:
            yield low, i
            low, size = i, 0
        size += len(t) + 1
    if low < len(texts):
        yield low, len(texts)


def token_hashes(texts: list[bytes], stem: int):
    """For each text the hashes of its words, and of the words' first ``stem`` bytes where they are longer (else of nothing)."""
    for low, high in pieces(texts):
        words, edges, stems = _hash_words(texts[low:high], stem)
        for i in range(high - low):
            yield words[edges[i]:edges[i + 1]], stems[edges[i]:edges[i + 1]]


def hash_tokens(tokens: list[bytes], stem: int) -> tuple[list, list]:
    """Hashes of single tokens, and of each as a stem."""
    whole = [w[0] for w, _ in token_hashes(tokens, stem)]
    return whole, [s[0] for _, s in token_hashes([t + b"." for t in tokens], stem)]


def word_hashes(texts: list[str]):
    """For each text, in order, the hashes of its words; A-Z count as a-z."""
    raw = [t.encode("utf-8").translate(_LOWER) for t in texts]
    for low, high in pieces(raw):
        words, edges = _hash_words(raw[low:high])
        for i in range(high - low):
            yield words[edges[i]:edges[i + 1]]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of all runs of ``n`` words, ascending; fewer words are one run; none give nothing."""
    if not len(words):
        return words
    runs = max(len(words) - n + 1, 1)
    h = np.full(runs, min(n, len(words)), np.uint64)
    for i in range(min(n, len(words))):
        h = stir(h * np.uint64(_BASE) + words[i:i + runs])
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]
