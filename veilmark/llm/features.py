"""Vectorised text features for tasks: code points of many texts in one array, hashed character n-grams and words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters handled at once; bounds the memory of a task whatever the rows are.
BLOCK_CHARS = 500_000
PAD = "\x00\x00\x00\x00"
_MULT = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters together, at least one text each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t) + len(PAD)
    if begin < len(texts):
        yield begin, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by padding, and where each text starts."""
    joined = PAD.join([*texts, ""])
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + len(PAD) for t in texts[:-1]], out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def inside(texts: list[str], starts: np.ndarray, size: int) -> np.ndarray:
    """Which places of ``codes`` lie in a text and not in the padding after it."""
    out = np.ones(size, dtype=bool)
    ends = starts + np.array([len(t) for t in texts], dtype=np.int64)
    for k in range(len(PAD)):
        out[ends + k] = False
    return out


def char_ngrams(c: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of ``bits`` bits of the n-gram that begins at each place; the last places wrap into padding."""
    h = (c + np.uint32(n)) * _MULT[0]
    for j in range(1, n):
        h ^= h >> np.uint32(15)
        h *= _MULT[j % 4]
        h[:-j] += (c[j:] + np.uint32(j)) * _MULT[(j + 1) % 4]
    h ^= h >> np.uint32(13)
    h *= _MULT[1]
    return h >> np.uint32(32 - bits)


def word_hashes(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of characters beyond the space, and where it starts."""
    inside = c > 32
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(begins):
        return np.zeros(0, dtype=np.uint32), begins
    place = np.arange(len(c), dtype=np.int64)
    since = place - np.repeat(np.concatenate(([0], begins)), np.diff(np.concatenate(([0], begins, [len(c)]))))
    power = np.cumprod(np.full(64, 2654435761 | 1, dtype=np.uint32), dtype=np.uint32)
    mixed = np.where(inside, (c + np.uint32(7)) * power[since & 63], np.uint32(0))
    h = np.add.reduceat(mixed, begins, dtype=np.uint32)
    h ^= h >> np.uint32(15)
    h *= _MULT[2]
    h ^= h >> np.uint32(13)
    return (h * _MULT[0]) >> np.uint32(32 - bits), begins
