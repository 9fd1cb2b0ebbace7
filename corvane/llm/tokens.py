"""Columnar tokenising of Arrow text batches, for the operators that run in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a single longer text is worked on alone.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of a batch with about limit bytes of text each."""
    if not batch.num_rows:
        return
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin, held = 0, 0
    for i, x in enumerate(n):
        if held and held + x > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(x)
    yield batch.slice(begin)


def _whole(texts: pa.Array, lower: bool) -> pa.Array:
    """Texts in buffers of their own, from offset 0, with A-Z in lower case on request; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    if lower:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(off - off[0])), pa.py_buffer(np.ascontiguousarray(data)))


class Words:
    """Words of a slice: codes into the slice's distinct words, and the offsets of each text's words."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        lists = pc.ascii_split_whitespace(_whole(texts, lower))
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(at[0], at[-1] - at[0])
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        at = at - at[0]
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        if len(size) and (size == 0).any():  # white space at either end of a text leaves empty words
            full = size[codes] > 0
            at = np.concatenate([[0], np.cumsum(full)])[at]
            codes = (np.cumsum(size > 0) - 1)[codes[full]]
            words = words.filter(pa.array(size > 0))
        self.codes, self.at, self.words = codes, at, words
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))

    def bytes(self):
        """The distinct words' bytes, and where each begins and ends."""
        bufs = self.words.buffers()
        off = np.frombuffer(bufs[1], dtype=np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and len(off) and off[-1] else np.zeros(0, np.uint8)
        return data, off


def ngrams(data: np.ndarray, off: np.ndarray, sizes=(1, 2, 3), space: int = 1 << 16):
    """Hashed byte n-grams of words with a mark at both ends: (word of each n-gram, its bucket)."""
    n = np.diff(off)
    words = len(n)
    wide = np.zeros(int(n.sum()) + 2 * words, dtype=np.uint64)
    start = off[:-1] - off[0] + 2 * np.arange(words)
    owner = np.repeat(np.arange(words), n + 2)
    inner = np.ones(len(wide), bool)
    inner[start] = inner[start + n + 1] = False
    wide[inner] = data[off[0] : off[-1]].astype(np.uint64) + 1
    owners, buckets = [], []
    for k in sizes:
        if len(wide) < k:
            continue
        h = np.zeros(len(wide) - k + 1, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[j : len(wide) - k + 1 + j] + np.uint64(k)
        whole = owner[: len(h)] == owner[k - 1 :]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[: len(h)][whole])
        buckets.append(((h >> np.uint64(32)) % np.uint64(space))[whole].astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def word_hash(data: np.ndarray, off: np.ndarray, space: int) -> np.ndarray:
    """Bucket of each word by a polynomial hash of its bytes."""
    n = np.diff(off)
    if not len(n):
        return np.zeros(0, np.int64)
    at = np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], n)
    power = np.multiply.accumulate(np.full(int(n.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((data[off[0] : off[-1]].astype(np.uint64) + np.uint64(1)) * power[at], off[:-1] - off[0])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(24)) % np.uint64(space)).astype(np.int64)
