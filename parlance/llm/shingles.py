"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(5).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_CHUNK = 100_000  # words hashed at once, which bounds the memory of a long text
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; only ASCII white space divides them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one run, one without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    found = []
    for at in range(0, len(words) - width + 1, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        buffer = np.frombuffer(b" ".join(part), np.uint8)
        ends = np.append(np.flatnonzero(buffer == 32), len(buffer))
        starts = np.append(0, ends[:-1] + 1)
        power, inverse = _power(len(buffer) + 1)
        total = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_BYTE[buffer] * power[: len(buffer)], out=total[1:])
        n = len(starts) - width + 1
        found.append(np.unique(mixed((total[ends[width - 1 :]] - total[starts[:n]]) * inverse[starts[:n]])))
    if len(_powers[0]) > 4_000_000:  # keep no tables for an unusual text
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def set_id(hashes: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signature(hashes: np.ndarray, k: int = 32) -> np.ndarray:
    """For each of ``k`` orders of all shingles, the first of the set, as one number per coordinate and value."""
    rng = np.random.default_rng(75)
    flip = rng.integers(0, _MASK, k, dtype=np.uint64)
    factor = rng.integers(0, _MASK, k, dtype=np.uint64) | np.uint64(1)
    least = np.full(k, _MASK, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ flip) * factor).min(axis=0))
    return mixed(least + np.arange(k, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)
