"""Hashes of word shingles, for a slice of texts at once."""

from __future__ import annotations

import numpy as np

from .tokens import Words


def shingle_hashes(words: Words, n: int):
    """64-bit hash of each shingle: (first word, last word + 1, text, hash)."""
    data, off = words.bytes()
    size = np.diff(off)
    power = np.multiply.accumulate(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    if len(size):
        at = np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)
        h = np.add.reduceat((data[off[0] : off[-1]].astype(np.uint64) + np.uint64(1)) * power[at], off[:-1] - off[0])
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    else:
        h = np.zeros(0, np.uint64)
    w = np.append(h, np.uint64(0))[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    count = np.diff(words.at)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), per)
    first = words.at[:-1][text] + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    width = np.minimum(count[text], n)
    out = np.zeros(len(text), np.uint64)
    for j in range(n):
        on = j < width
        out[on] = out[on] * np.uint64(0x94D049BB133111EB) + w[first[on] + j] + np.uint64(1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return first, first + width, text, out
