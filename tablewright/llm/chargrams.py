"""Hashed character n-grams of texts, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = 32


def codes(text: str) -> np.ndarray:
    """Unicode code points as unsigned 32-bit numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def buckets(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash bucket, below 2**bits, of the n-gram that starts at each place but the last n - 1."""
    if len(points) < n:
        return np.empty(0, dtype=np.uint32)
    size = len(points) - n + 1
    made = np.full(size, (0x9E3779B9 * n) & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        made ^= points[k : k + size]
        made *= np.uint32(0x85EBCA6B)
        made ^= made >> np.uint32(15)
    return made >> np.uint32(32 - bits)


def _word_table() -> np.ndarray:
    """For code points under 0x250, what each becomes in ``words_only``: itself, or a space."""
    table = np.arange(0x250, dtype=np.uint32)
    for k in range(0x250):
        if not (chr(k).isalnum() or chr(k) in "*@$_"):
            table[k] = _SPACE
    return table


_WORD_TABLE = _word_table()


def words_only(text: str) -> np.ndarray:
    """Lower-cased code points between two spaces; what is no letter, digit or mark of disguise (* @ $ _) is a space."""
    points = codes(f" {text.lower()} ").copy()
    low = points < 0x250
    points[low] = _WORD_TABLE[points[low]]
    points[(points >= 0x2000) & (points < 0x2070)] = _SPACE
    return points


class WordGrams:
    """Each word's n-grams, its borders counting as a space, and the word itself: ``bucket[i]`` belongs to word ``word[i]`` of ``words``."""

    def __init__(self, points: np.ndarray, orders: tuple[int, ...], bits: int):
        space = points == _SPACE
        starts = ~space[1:] & space[:-1]
        number = np.concatenate(([0], np.cumsum(starts)))  # at a place: words begun so far
        self.words = int(number[-1])
        self.at = np.flatnonzero(starts) + 1
        seen = np.concatenate(([0], np.cumsum(space)))
        bucket, word = [], []
        for n in orders:
            made = buckets(points, n, bits)
            inner = seen[n - 1 : n - 1 + len(made)] - seen[1 : 1 + len(made)]
            fine = inner == 0
            if n == 2:
                fine &= ~(space[: len(made)] & space[1 : 1 + len(made)])
            bucket.append(made[fine])
            word.append((number[1 : 1 + len(made)][fine] - 1).astype(np.int32))
        letters = np.flatnonzero(~space)
        if len(letters):
            own = number[letters] - 1
            mixed = (points[letters].astype(np.uint64) + ((letters - self.at[own]).astype(np.uint64) << np.uint64(21)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.searchsorted(letters, self.at)) * np.uint64(0xD6E8FEB86659FD93)
            bucket.append((whole >> np.uint64(64 - bits)).astype(np.uint32))
            word.append(np.arange(self.words, dtype=np.int32))
        self.bucket, self.word = np.concatenate(bucket), np.concatenate(word)

    def means(self, value: np.ndarray, prior: int = 0) -> np.ndarray:
        """For each word, the mean of ``value`` over its n-grams and ``prior`` zeros."""
        total = np.bincount(self.word, value[self.bucket], self.words)
        return total / np.maximum(1, np.bincount(self.word, minlength=self.words) + prior)
