"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: bytes, words: int, seed: int = 0) -> np.ndarray:
    """XXH64 of a text's shingles in order, repeats included: of `words` words each, of all words where there are fewer, none without a word.

    A shingle is its words, lower-cased in A-Z, joined by single spaces; bytes.split() parts words at 0x20 and 0x09-0x0D.
    """
    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


class _Known(dict):
    """XXH64 of words, kept for those met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _Known()
#: odd factors of a shingle's places, powers of one of them
_PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: of `words` words each (64 at most), of all words where there are fewer, none without a word.

    A shingle's hash is the sum of its words' XXH64, each times the factor of its place, and of its length, mixed.
    """
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    own, k = np.fromiter(map(_known.__getitem__, w), np.uint64, len(w)), min(words, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64)
    for place in range(k):
        total += own[place : place + n] * _PLACES[place]
    return np.unique(mix64(total))
