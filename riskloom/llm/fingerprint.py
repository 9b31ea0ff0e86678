"""Homomorphic multiset hashes of paragraphs.

A paragraph is a stretch between line feeds. Its vector has EQUAL lanes hashed from its
bytes, and NEAR lanes that count its pairs of neighbouring words (with the first word
itself), each pair hashed to a lane and a sign. A text's fingerprint is the sum of its
paragraphs' vectors, lanes modulo 2**64 and 2**32: the order of paragraphs does not
matter, and adding or subtracting a paragraph's vector inserts or deletes it. Equal
multisets of paragraphs agree in all lanes; the cosine of the NEAR lanes, read as signed
numbers, estimates how much two texts have in common.

Null texts are empty. Rows are ordered by (doc_id, hash of the text), nulls first, so that
repeated ids have an order too; an only row is its own next one; an empty table has no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .text import Words, join_hash, mix, slices

EQUAL, NEAR = 16, 128
#: Text bytes of one range of doc_id.
RANGE_BYTES = 8 << 20
#: Ranges grow where there would be more of them: 17 bytes each go to every worker.
MOST_RANGES = 1 << 17
_LANES = mix(np.arange(1, EQUAL + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of an array of texts: (n, EQUAL) and (n, NEAR) unsigned lanes."""
    w = Words(texts)
    n = len(w.at) - 1
    size = int(w.at[-1])
    breaks = np.flatnonzero(w.raw[:size] == 10)
    # paragraphs: each text's begin and what follows each line feed
    begin = np.sort(np.concatenate([w.at[:-1], breaks + 1]), kind="stable")
    doc = np.searchsorted(w.at[1:], begin, side="right")
    ends_doc = np.searchsorted(w.at[1:], breaks, side="right")
    doc = np.sort(np.concatenate([np.arange(n), ends_doc]), kind="stable")
    begin = np.concatenate([w.at[:-1], breaks + 1])[np.lexsort((np.concatenate([w.at[:-1], breaks + 1]), np.concatenate([np.arange(n), ends_doc])))]
    end = np.empty_like(begin)
    if len(begin):
        end[:-1] = begin[1:] - 1
        last = np.flatnonzero(np.diff(doc, append=n))
        end[last] = w.at[1:][doc[last]]
    p = Words.__new__(Words)
    p.raw, p.start, p.end = w.raw, begin, np.maximum(end, begin)
    h = p.hashes()
    equal = np.zeros((n, EQUAL), np.uint64)
    if n:
        edge = np.searchsorted(doc, np.arange(n))
        for k, lane in enumerate(_LANES):
            equal[:, k] = np.add.reduceat(mix(h ^ lane), edge)
    near = np.zeros(n * NEAR, np.int64)
    if len(w):
        words = w.hashes()
        before = np.concatenate([np.zeros(1, np.uint64), words[:-1]])
        paragraph = np.searchsorted(begin, w.start, side="right")
        before[np.flatnonzero(np.diff(paragraph, prepend=-1))] = 0
        before[w.first[:-1][w.first[:-1] < len(w)]] = 0
        pair = join_hash(before, words)
        cell = w.doc() * NEAR + (pair & np.uint64(NEAR - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((pair >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        near = np.bincount(cell, sign, n * NEAR).astype(np.int64)
    return equal, near.reshape(n, NEAR).astype(np.uint32)


def to_bytes(equal: np.ndarray, near: np.ndarray) -> list[bytes]:
    return [a.tobytes() + b.tobytes() for a, b in zip(equal.astype("<u8"), near.astype("<u4"), strict=True)]


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, "<u8", EQUAL), np.frombuffer(data, "<u4", NEAR, 8 * EQUAL)


def fingerprint(text: str | bytes | None) -> bytes:
    return to_bytes(*vectors(pa.array([text if isinstance(text, bytes) else (text or "").encode()], pa.binary())))[0]


def insert(data: bytes, paragraph: str, times: int = 1) -> bytes:
    """With a paragraph put in, or taken out with times = -1; of the empty multiset, zeros."""
    a, b = from_bytes(data), from_bytes(fingerprint(paragraph))
    with np.errstate(over="ignore"):
        return to_bytes((a[0] + np.int64(times).astype(np.uint64) * b[0])[None], (a[1] + np.int32(times).astype(np.uint32) * b[1])[None])[0]


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Rows of NEAR lanes; 1 where ``same``, else a cosine, not below 0."""
    a, b = a.astype(np.uint32).view(np.int32).astype(np.float64), b.astype(np.uint32).view(np.int32).astype(np.float64)
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def _write(data: list[bytes]) -> list[str]:
    return [base64.b64encode(x).decode() for x in data]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [x.decode() for x in batch.column(1).fill_null(b"").to_pylist()]
            data = to_bytes(*vectors(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(_write(data))], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _order_keys(ids: pa.Array, h: pa.Array) -> np.ndarray:
    """17 bytes a row that sort as (doc_id, h) do, null ids first."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = ids.is_valid().to_numpy(zero_copy_only=False)
    for at, values in ((1, ids.fill_null(0)), (9, h)):
        signed = values.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at : at + 8] = signed.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _bounds(docs: DataFrame, range_bytes: int, most: int) -> np.ndarray:
    """The first key of each range of about range_bytes of text, sorted."""
    about = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    size = max(range_bytes, about["b"] // most)
    parts = max(1, about["b"] // size // 64, about["n"] // 4_000_000)
    keys = docs.select("doc_id", "h", F.length("text").cast("long").alias("b")).repartitionByRange(int(parts), F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, last = None, None
        for batch in batches:
            found = []
            keys = _order_keys(batch.column(0), batch.column(1))
            for k, b in zip(keys.tolist(), batch.column(2).fill_null(0).to_pylist(), strict=True):
                # equal keys stay in one range
                if full is None or full >= size and k != last:
                    found.append(k.ljust(17, b"\0"))
                    full = 0
                full, last = full + b, k
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["k"])

    rows = keys.mapInArrow(cut, "k binary").toArrow()["k"].to_pylist()  # a row for each range, ``most`` and one a partition at most
    return np.sort(np.array(rows, "S17"))


def compare_with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows in order of (doc_id, hash of the text) are dealt into ranges of about range_bytes,
    compressed, in one shuffle; the ranges' first keys come from a pass over keys and
    lengths, and a row finds its range among them by bisection. A range is read row by row,
    each with the next one; its last row is followed by the next range's first, of which it
    gets a copy, and the last range by the first of all.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("h", F.xxhash64("text"))
    bounds = _bounds(docs, range_bytes, most_ranges)
    n = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch in slices(batches, "text", 8 << 20):
            keys = _order_keys(batch.column(0), batch.column(2))
            at = np.searchsorted(bounds, keys, side="right") - 1
            opens = np.flatnonzero(bounds[at] == keys)
            texts = pa.array([press.compress(x) for x in batch.column(1).to_pylist()], pa.binary())
            rows = np.concatenate([np.arange(batch.num_rows), opens])
            to = np.concatenate([at, np.where(at[opens] > 0, at[opens] - 1, n - 1)])
            after = np.arange(len(rows)) >= batch.num_rows
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), texts.take(take), batch.column(2).take(take), pa.array(to, pa.int64()), pa.array(after)], ["doc_id", "text", "h", "t", "after"])

    dealt = docs.mapInArrow(deal, f"doc_id {kind}, text binary, h long, t long, after boolean")
    out = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(id, text, next text) of each row of the ranges; of the copies at a range's end only the first is of use."""
        press = zstandard.ZstdDecompressor()
        held, t = None, None
        for batch in batches:
            for i, x, r, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and r == t:
                    text = press.decompress(x)
                    yield (*held, text)
                    held = None if after else (i, text)
                elif not after:
                    held, t = (i, press.decompress(x)), r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in pairs(batches):
            held.append(row)
            size += len(row[1])
            if size > 2 << 20 or len(held) >= 2000:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        texts = [x[1].decode() for x in held]
        changed = [edited(a, x[2].decode()).encode() for a, x in zip(texts, held, strict=True)]
        e, v = vectors(pa.array([x[1] for x in held], pa.binary()))
        ce, cv = vectors(pa.array(changed, pa.binary()))
        # the next text is the next row's, but at a range's end
        ends = [k for k in range(len(held)) if k + 1 == len(held) or held[k + 1][1] is not held[k][2]]
        ne, nv = np.roll(e, -1, 0), np.roll(v, -1, 0)
        ne[ends], nv[ends] = vectors(pa.array([held[k][2] for k in ends], pa.binary()))
        columns = [
            pa.array([x[0] for x in held], pa.int64()),
            pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
            pa.array(_write(to_bytes(e, v))),
            pa.array(_write(to_bytes(ce, cv))),
            pa.array(likeness(v, cv, (e == ce).all(1) & (v == cv).all(1))),
            pa.array(likeness(v, nv, (e == ne).all(1) & (v == nv).all(1))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    columns = dealt.repartition(max(1, n), "t").sortWithinPartitions("t", "after", F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text", "t", "after")
    return columns.mapInArrow(run, f"doc_id long, {out}")
