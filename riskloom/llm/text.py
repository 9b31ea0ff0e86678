"""Words and word hashes of whole Arrow batches, without Python objects per word.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, so the
words are those of ``[^\\x20\\x09-\\x0D]+`` on code points. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words of letters, and of letters and digits; all bytes beyond ASCII count as letters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[0x30:0x3A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_R = [np.uint64(x) for x in (29, 31, 32)]
#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20
#: Where a worker process keeps an operator's tables between its tasks.
KEPT = "_riskloom_chunk_ids"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> _R[1])) * _B
    h = (h ^ (h >> _R[0])) * _C
    return h ^ (h >> _R[2])


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence that a stands for followed by the one of b."""
    return mix(a * _A + (b ^ (b >> _R[1])) * _C + _B)


def forget(name: str = KEPT) -> None:
    """Lets go of what a worker process keeps between the tasks of one operator, and of its memory."""
    if sys.modules.pop(name, None) is not None:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere freed memory is the allocator's
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut at row bounds so that each holds about ``most`` bytes of the column.

    keep: the operator goes on with what its worker keeps between tasks; others' workers let go of it.
    """
    if not keep:
        forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """df with a column's bytes compressed value by value, for a shuffle that unsqueeze() follows."""
    plain = df.withColumn(column, F.col(f"`{column}`").cast("binary"))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            small = [None if x is None else press.compress(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(small, pa.binary()), *batch.columns[at + 1 :]], batch.schema.names)

    return plain.mapInArrow(run, plain.schema)


def unsqueeze(values: pa.Array) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if x is None else press.decompress(x) for x in values.to_pylist()]


class Words:
    """The words of an array of texts.

    raw: all bytes with 8 more zeros; at: each text's bounds in raw; start, end: each
    word's; first: each text's bounds among the words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray = ~SPACE):
        """inside: which bytes belong to words, as a table; lower: A-Z become a-z."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        self.raw = np.concatenate([LOWER[body] if lower else body, np.zeros(8, np.uint8)])
        self.at = at - at[0]
        n = int(self.at[-1])
        ink = inside[self.raw[:n]]
        begins, ends = ink.copy(), ink.copy()
        if n:
            begins[1:] &= ~ink[:-1]
            ends[:-1] &= ~ink[1:]
            edges = self.at[(self.at > 0) & (self.at < n)]
            begins[edges] = ink[edges]
            ends[edges - 1] = ink[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Each word's text, as its row."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        eight = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        size = self.end - self.start
        if most:
            size = np.minimum(size, most)
        h = mix(size.astype(np.uint64) * _A + _B)
        h = mix(h ^ (eight[self.start] & _KEEP[np.minimum(size, 8)]))
        more, k = np.flatnonzero(size > 8), 8
        while len(more):
            left = size[more] - k
            h[more] = mix(h[more] * _A ^ (eight[self.start[more] + k] & _KEEP[np.minimum(left, 8)]))
            more, k = more[left > 8], k + 8
        return h

    def equal(self, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
        """Whether words i have the very bytes of the other's words j."""
        mine, theirs = (np.ndarray((len(w.raw) - 7,), "<u8", w.raw, strides=(1,)) for w in (self, other))
        a, b = self.start[i], other.start[j]
        size = self.end[i] - a
        same = size == other.end[j] - b
        more, k = np.flatnonzero(same), 0
        while len(more):
            keep = _KEEP[np.minimum(size[more] - k, 8)]
            ok = ((mine[a[more] + k] ^ theirs[b[more] + k]) & keep) == 0
            same[more[~ok]] = False
            k += 8
            more = more[ok & (size[more] > k)]
        return same

    def array(self, i: np.ndarray) -> pa.Array:
        """Words i as strings."""
        size = self.end[i] - self.start[i]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[i] - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(i), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.raw[at]))

    def text(self, i: int) -> bytes:
        return self.raw[self.at[i] : self.at[i + 1]].tobytes()

    def list(self, i: int) -> list[bytes]:
        return self.text(i).split()


class Vocabulary:
    """Distinct terms, numbered in the order of their hashes; find() compares bytes too."""

    def __init__(self, terms: list[bytes]):
        terms = sorted(set(terms))
        words = Words(pa.array(terms, pa.large_binary()), inside=np.ones(256, bool))
        h = words.hashes()
        order = np.argsort(h)
        self.words, self.order, self.h = words, order, h[order]
        self.terms = [terms[i] for i in order]

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 for none."""
        out = np.full(len(words), -1, np.int64)
        if not len(self) or not len(words):
            return out
        h = words.hashes()
        at = np.searchsorted(self.h, h)
        left = np.arange(len(words))
        while len(left):  # a second time only for terms of equal hashes
            left = left[at[left] < len(self)]
            left = left[self.h[at[left]] == h[left]]
            same = words.equal(left, self.words, self.order[at[left]])
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes; runs that cross texts are for the caller to leave out."""
    if len(h) < n:
        return h[:0]
    whole, size, power, done = None, 0, h, 1
    while n:
        if n & 1:
            whole = power if whole is None else join_hash(whole[: len(h) - size - done + 1], power[size : len(h) - done + 1])
            size += done
        n >>= 1
        if n:
            power, done = join_hash(power[: len(power) - done], power[done:]), done * 2
    return whole


def starts_in(first: np.ndarray, n: int) -> np.ndarray:
    """Rows of grams(h, n) that lie in one text, given the texts' bounds among the words."""
    counts = np.diff(first)
    room = np.maximum(counts - n + 1, 0)
    if not room.sum():
        return np.empty(0, np.int64)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
