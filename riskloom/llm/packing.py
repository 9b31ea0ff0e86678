"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A document's ids (with a closing id) are cut into full sequences and then powers of two
down to ``least_cut``; what is left, shorter than that, stays whole. A piece of length n
is of class k = capacity div n: any k of a class fit in one sequence. Each shard numbers
its own pieces of a class; shards meet only in a table of counts, from which each piece
gets its place in the class, and place div k is its sequence. Every class has at most one
sequence that is not full of k pieces: these remainders, fewer than capacity * (1 + ln
least_cut) pieces whatever the input, are packed together, longest first, into the first
sequence with room.

Null texts are empty documents and have the closing id only; null ids of documents are
kept; repeated rows are documents of their own; other columns are ignored; an empty table
has no pieces.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import by_shuffle
from .scratch import save
from .text import KEPT, Words, slices

CAPACITY = 2048
LEAST_CUT = 64
CLOSING = 1
#: Stems whose ids a worker remembers at most, and a third of the stretches.
REMEMBERED = 400_000
#: ASCII punctuation but the apostrophe.
CLOSERS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Text bytes tokenized at once.
SLICE = 2 << 20
#: Documents of one shard, about, and shards that are rolled up together.
SHARD, GATHER = 256, 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkIds:
    """Ids of whole texts, by their stretches between white space.

    The tokenizer lowers case, never joins across white space, and ends a piece between an
    ASCII letter or digit and ASCII punctuation (but the apostrophe). So the ids of a
    stretch are those of its stem and of its closing punctuation; each is encoded once and
    remembered, stretches by their 64-bit hashes. Stretches with "<|" may hold special
    tokens and are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.stems: dict[bytes, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def thin(self) -> None:
        """Keeps the stretches that have been met most often: a half at most, none met only once."""
        least = max(2, int(np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]) + 1)
        keep = self.uses >= least
        size, begin = self.size[keep], self.begin[keep]
        end = np.cumsum(size)
        self.flat = self.flat[np.repeat(begin - (end - size), size) + np.arange(int(size.sum()))]
        self.keys, self.begin, self.size, self.uses = self.keys[keep], end - size, size, self.uses[keep] // 2

    def parts(self, chunk: bytes) -> tuple[bytes, bytes]:
        if b"<|" in chunk:
            return chunk, b""
        stem = chunk.rstrip(CLOSERS)
        if stem and stem[-1:].isalnum():
            return stem.lower(), chunk[len(stem) :]
        return chunk.lower(), b""

    def learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        split = [self.parts(x) for x in chunks]
        unknown = list({y for x in split for y in x}.difference(self.stems))
        for a in range(0, len(unknown), 10_000):
            part = unknown[a : a + 10_000]
            for stem, found in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                self.stems[stem] = np.array(found.ids, np.uint32).tobytes()
        made = [self.stems[stem] + self.stems[rest] for stem, rest in split]
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        begin = len(self.flat) + np.cumsum(size) - size
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), np.uint32)])
        self.keys, self.begin, self.size, self.uses = (np.concatenate(x)[order] for x in ((self.keys, keys), (self.begin, begin), (self.size, size), (self.uses, np.zeros(len(keys), np.int32))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's bounds among them."""
        if len(self.keys) > 3 * REMEMBERED:
            self.thin()
        if len(self.stems) > REMEMBERED:
            self.stems.clear()
        words = Words(texts)
        keys, one, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = words.raw.tobytes()
            self.learn(keys[new], [raw[a:b] for a, b in zip(words.start[one[new]].tolist(), words.end[one[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        self.uses[at] += 1
        size, begin = self.size[at][which], self.begin[at][which]
        end = np.cumsum(size)
        flat = self.flat[np.repeat(begin - (end - size), size) + np.arange(end[-1])] if len(end) else np.empty(0, np.uint32)
        return flat, np.concatenate([[0], end])[words.first]


def known_ids(path: str) -> ChunkIds:
    """The worker process's own, kept between its tasks."""
    kept = sys.modules.setdefault(KEPT, ModuleType(KEPT)).__dict__
    if path not in kept:
        kept[path] = ChunkIds(path)
    return kept[path]


def cuts(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of n ids, longest first."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= least:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return [*out, n] if n else out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, least_cut: int = LEAST_CUT, closing: int = CLOSING) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens."""
    fields = "start long, length long, ids_crc32 long, doc_tokens long"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = known_ids(path), np.array([closing], "<u4").tobytes()
        for batch in slices(batches, "text", SLICE, keep=True):
            rows, table = [], [[], [], [], []]
            flat, bounds = known.ids(batch.column(1))
            flat, bounds = memoryview(flat.astype("<u4").tobytes()), bounds.tolist()
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                data, n, at = flat[4 * a : 4 * b], b - a + 1, 0
                for length in cuts(n, capacity, least_cut):
                    crc = zlib.crc32(data[4 * at : 4 * (at + length)])
                    if at + length == n:
                        crc = zlib.crc32(end, crc)
                    rows.append(i)
                    for column, value in zip(table, (at, length, crc, n), strict=True):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in table)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, f"doc_id {kind}, {fields}")


def first_fit(capacity: int):
    def pack(rows):
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        free, ids, offsets, least = [], [], [], 0
        for n in rows["length"]:
            k = next((k for k, room in enumerate(free) if room >= n), len(free))
            if k == len(free):
                free.append(capacity)
            ids.append(k)
            offsets.append(capacity - free[k])
            free[k] -= n
        rows["sequence_id"] = rows["base"] + np.array(ids, np.int64)
        rows["offset"] = np.array(offsets, np.int64)
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pack


def arrange(cut: DataFrame, n_shards: int, capacity: int = CAPACITY) -> DataFrame:
    """cut: a stored table of pieces. Adds sequence_id and offset."""
    rows = cut.withColumn("k", (F.lit(capacity) / F.col("length")).cast("int")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_shards)).cast("int"))
    counts = rows.groupBy("k", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("many", F.expr(f"shard div {GATHER}"))
    # shards are rolled up in two levels, so that no task walks all shards of a class
    upto = lambda n, *by: F.coalesce(F.sum(n).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("k", "many").agg(F.sum("n").alias("m"))
    groups = groups.select("k", "many", upto("m", "k", "many").alias("base"))
    within = counts.select("k", "many", "shard", upto("n", "k", "many", "shard").alias("within"))
    starts = within.join(by_shuffle(groups), ["k", "many"]).select("k", "shard", (F.col("base") + F.col("within")).alias("before"))
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"))
    every = W.partitionBy(F.lit(0)).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    classes = totals.withColumn("full", F.expr("total div k")).select("k", "full", F.coalesce(F.sum("full").over(every), F.lit(0)).alias("first"))
    end = classes.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("k", "shard").orderBy("doc_id", "start", "length", "ids_crc32")) - 1
    placed = rows.withColumn("place", place).join(by_shuffle(starts), ["k", "shard"]).join(F.broadcast(classes), "k")  # at most as many classes as the capacity
    placed = placed.withColumn("place", F.col("place") + F.col("before")).withColumn("bin", F.expr("place div k"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    sequence = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    full = placed.where("bin < full").withColumn("sequence_id", F.col("first") + F.col("bin"))
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(sequence), F.lit(0))).select(*names, "sequence_id", "offset")
    rest = placed.where("bin >= full").crossJoin(F.broadcast(end)).select(*names, "base")  # one row
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema)
    return full.unionByName(rest.groupBy("base").applyInPandas(first_fit(capacity), kinds))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, least_cut: int = LEAST_CUT, closing: int = CLOSING) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = save(pieces(docs, path or default_tokenizer(), capacity, least_cut, closing), "pieces")
    n = cut.where("start = 0").count()
    return arrange(cut, max(16, n // SHARD), capacity)
