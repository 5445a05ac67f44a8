"""Sets of word shingles as sorted 64-bit hashes, computed a shard of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from marketloom.llm.common import LOWER

_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1) for i in range(64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's words: A-Z in lower case, parted by ASCII white space."""
    number: dict[bytes, int] = {}
    per_text = []
    for t in texts:
        words = t.translate(LOWER).split()
        for w in words:
            if w not in number:
                number[w] = len(number)
        per_text.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    return [table[x] for x in per_text]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words, in order; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * _ODD[k] + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    # a short sequence is no part of a longer one
    return out if n == size else mixed(out ^ _ODD[32 + n])


def shingles_of(texts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """shingle_hashes() of each text, worked out over all of them laid end to end: short texts cost no calls of their own."""
    all_ = shingle_hashes(np.concatenate(texts), size) if texts else None
    starts = np.cumsum([0, *map(len, texts)]).tolist()
    return [all_[a : a + len(t) - size + 1] if len(t) >= size else shingle_hashes(t, size) for a, t in zip(starts, texts)]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    s = np.sort(shingle_hashes(words, size))
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def set_key(tokens: np.ndarray) -> bytes:
    """16 bytes that name a set: equal for equal sets."""
    return xxhash.xxh3_128_digest(tokens.tobytes())
