"""Substring dedup by relative Lempel-Ziv parsing of documents against the whole corpus.

The corpus is the reference, cut into blocks: each task's own texts, and an index dealt by
hashes of what it holds, so that a document meets every block that could have a factor
for it. In a block every run of WINDOW words has one place, where it starts first.

1. Anchors: the least hashed run of ANCHOR words in each window of WINDOW words. Equal
   windows have equal anchors, so windows whose anchor stands in one place only are done.
   Repeated anchors go into a filter; with more of them than a filter of bounded size
   holds, windows are joined with the table of repeated anchors instead.
2. A task walks its documents and takes from its own block the longest match at each word:
   windows whose places there follow one another are one factor, with its source. What its
   block does not hold goes to the index, the windows of one anchor as one row; windows of
   anchors with more than OFTEN places go there each by itself, so that no anchor is too
   frequent for a task. Index blocks are walked in the same way.
3. A document's factors are put together across blocks where one's source goes on in the
   next's. A window that begins in one factor and ends in another has been looked up like
   all others, so nothing is lost at factor boundaries. Every factor has at least WINDOW
   words; factors are the duplicate spans.

Windows are named by 64-bit hashes: of n candidate windows two are confused with a chance
of n * n / 2**65. Null texts have no words. Documents of fewer than WINDOW words keep all.
Rows that share an id are documents in the order of their texts (first bytes, then a hash); rows with a null id are
neither indexed nor changed; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from . import bits
from .components import by_shuffle
from .scratch import release, save
from .text import Words, grams, slices, squeezed, starts_in, unsqueeze

WINDOW = 20
ANCHOR = 8
#: Places of an anchor up to which its windows stay together in the index.
OFTEN = 64
#: Windows in a row of the index at most.
ROW = 64
#: Windows of its own block that a task remembers; it then starts a new block.
REMEMBERED = 400_000
#: Rows of a range in which keys are given where ids repeat, and bytes of text that order them.
KEY_ROWS, HEAD = 500_000, 64
FACTORS = "key long, begin int, n int, source long, at int"


def slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least or greatest of each n neighbours."""
    f, done = (np.minimum if least else np.maximum), 1
    while done * 2 <= n:
        x, done = f(x[: len(x) - done], x[done:]), done * 2
    return f(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def windows(texts: pa.Array, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows: row, start word, hash, anchor; and the anchors, one for each place."""
    w = Words(texts)
    at = starts_in(w.first, window)
    none = np.empty(0, np.uint64)
    if not len(at):
        return at, at, none, none, none
    h = w.hashes()
    runs = grams(h, anchor)
    room = window - anchor + 1
    least = slide(runs, room, True)
    seen = np.zeros(len(runs) + room - 1, np.uint64)
    seen[room - 1 + at] = least[at]
    chosen = slide(seen, room, False)[: len(runs)] == runs
    doc = np.repeat(np.arange(len(w.counts)), np.maximum(w.counts - window + 1, 0))
    return doc, at - w.first[doc], grams(h, window)[at], least[at], runs[chosen]


class Block:
    """A reference block: the first place (key, start) of each window it holds."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.h, self.key, self.start = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    def take(self, h: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds windows. Whether each now has an earlier place in the block, and its first place (key, start)."""
        order = np.lexsort((start, key, h))
        fresh = np.ones(len(order), bool)
        fresh[1:] = h[order[1:]] != h[order[:-1]]
        lead = order[fresh]
        at = np.searchsorted(self.h, h[lead])
        held = np.zeros(len(lead), bool)
        held[at < len(self.h)] = self.h[at[at < len(self.h)]] == h[lead[at < len(self.h)]]
        old = at[held]
        before = np.zeros(len(lead), bool)
        mine = lead[held]
        before[held] = (self.key[old] < key[mine]) | ((self.key[old] == key[mine]) & (self.start[old] < start[mine]))
        first_key, first_start = key[lead], start[lead]
        first_key[before], first_start[before] = self.key[at[before]], self.start[at[before]]
        self.key[old], self.start[old] = first_key[held], first_start[held]
        new = lead[~held]
        self.h, self.key, self.start = (np.insert(x, at[~held], y) for x, y in ((self.h, h[new]), (self.key, key[new]), (self.start, start[new])))
        late = np.ones(len(order), bool)
        late[lead] = before
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        return late, first_key[group], first_start[group]


def chained(key: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Windows with their places -> factors: key, begin, number of windows, source, place in it."""
    order = np.lexsort((start, key))
    key, start, source, at = key[order], start[order], source[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(start) != 1) | (np.diff(source) != 0) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    return [key[begin], start[begin].astype(np.int32), np.diff(begin, append=len(key)).astype(np.int32), source[begin], at[begin].astype(np.int32)]


def parse(begin: np.ndarray, n: np.ndarray, source: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A document's factors of all blocks, in any order -> rows of (begin, words, source, place), put together across blocks."""
    order = np.lexsort((-n, begin))
    begin, n, source, at = (np.asarray(x, np.int64)[order] for x in (begin, n, source, at))
    on = np.zeros(len(begin), bool)
    on[1:] = (begin[1:] == begin[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + n[:-1])
    first = np.flatnonzero(~on)
    total = np.add.reduceat(n, first) if len(first) else n
    return np.stack([begin[first], total + window - 1, source[first], at[first]], 1)


def covered(begin: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors in order of begin -> spans [begin, end) of words, apart from one another."""
    reach = np.maximum.accumulate(begin + words)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return begin[new], reach[np.append(new[1:], len(begin)) - 1]


def unused(names: list[str], name: str) -> str:
    """A column name that is not among the names."""
    while name.lower() in {n.lower() for n in names}:
        name = f"_{name}"
    return name


def with_keys(docs: DataFrame, key: str) -> DataFrame:
    """docs and a key that no other row has: doc_id, or where ids repeat the row's place in the order of (doc_id, text); null where doc_id is.

    Places are found by ranges of (doc_id, first characters, hash of the text), so an id that many rows share is split.
    """
    about = docs.where("doc_id is not null").groupBy("doc_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    own = F.col("doc_id").cast("bigint")
    if (about["most"] or 1) == 1:
        return docs.withColumn(key, own)
    part, before, at = (unused([*docs.columns, key], x) for x in ("part", "before", "at"))
    # equal texts of one id are told apart by their other columns; rows equal in all can change places
    others = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    text = F.col("text").cast("binary")
    order = [own, F.substring(text, 1, HEAD), F.xxhash64(text), others]
    ranges = max(1, about["n"] // KEY_ROWS)
    # a table, so that ranges stay what they are
    dealt = save(docs.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(ranges, *order, at).withColumn(part, F.spark_partition_id()), "keyed")
    counts = dealt.groupBy(part).count().select(part, F.coalesce(F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    place = F.row_number().over(W.partitionBy(part).orderBy(*order, at))
    placed = dealt.withColumn(key, place).join(F.broadcast(counts), part)  # one row a range
    return save(placed.withColumn(key, F.when(own.isNotNull(), F.col(key) + F.col(before))).drop(part, before, at), "keyed")


def without_keys(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of docs whose bigint key is not in gone, a stored table of one column; null keys stay.

    A filter over gone tells which rows may go, and only these are sent to meet it; the others stay where they are.
    """
    (column,) = gone.columns
    taken = [*docs.columns, column]
    log_bits = bits.log_bits_for(gone.count())
    pages = save(bits.pages(gone.select(F.xxhash64(column).alias("h")), "h", log_bits), "filter")  # 16 MB at most
    rows, may = docs, F.col(key).isNotNull()
    for which in (0, 1):
        page, has = (unused(taken, f"{x}_{which}") for x in ("page", "bits"))
        at, place = bits.page_of(F.xxhash64(key), log_bits, which)
        rows = rows.join(F.broadcast(pages.toDF(page, has)), at == F.col(page), "left")
        may = may & bits.bit(F.col(has), place)
    own = [F.col(f"`{c}`") for c in docs.columns]
    sent = rows.where(may).select(own).join(by_shuffle(gone), F.col(key) == F.col(column), "left_anti")
    return rows.where(~may).select(own).unionByName(sent)


def _index_rows(a: np.ndarray, h: np.ndarray, key: np.ndarray, start: np.ndarray, often: np.ndarray) -> list[pa.Array]:
    """Windows -> rows g, key, begin, hashes: those of one anchor together, those of an anchor found often each by its hash."""
    order = np.lexsort((start, key))
    a, h, key, start, often = a[order], h[order], key[order], start[order], often[order]
    new = np.ones(len(a), bool)
    new[1:] = often[1:] | (a[1:] != a[:-1]) | (key[1:] != key[:-1]) | (np.diff(start) != 1)
    begin = np.flatnonzero(new)
    place = np.arange(len(a)) - np.repeat(begin, np.diff(begin, append=len(a)))
    begin = np.flatnonzero(new | (place % ROW == 0))
    data = np.ascontiguousarray(h).view(np.uint8)
    bounds = np.append(begin, len(a)).astype(np.int32) * 8
    hashes = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    group = np.where(often[begin], h[begin], a[begin])
    return [pa.array(group.view(np.int64)), pa.array(key[begin]), pa.array(start[begin].astype(np.int32)), hashes]


def _index_windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows g, key, begin, hashes -> g, hash, key, start of their windows."""
    values = batch.column(3)
    n = pc.binary_length(values).to_numpy().astype(np.int64) // 8
    h = np.frombuffer(b"".join(values.to_pylist()), np.uint64)
    each = np.repeat(np.arange(len(n)), n)
    g, key, begin = (batch.column(k).to_numpy().astype(np.int64)[each] for k in range(3))
    return g, h, key, begin + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)


def matches(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, often: int = OFTEN, most_keys: int = bits.MOST_KEYS) -> DataFrame:
    """keyed: key (unique), text. Returns FACTORS: a document's windows begin .. begin + n - 1 stand earlier, from word ``at`` of source."""
    keyed = keyed.where("key is not null").select("key", "text")
    spark = keyed.sparkSession

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            a, c = np.unique(windows(batch.column(0), window, anchor)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.astype(np.int32))], ["a", "c"])

    found = keyed.select("text").mapInArrow(anchors, "a long, c int")
    repeated = save(found.groupBy("a").agg(F.sum("c").alias("c")).where("c > 1"), "anchors")
    release(spark)
    n = repeated.count()
    filters = None
    if n <= most_keys:
        frequent = repeated.where(F.col("c") > often)
        made = [bits.build(x, "a", bits.log_bits_for(k)) for x, k in ((repeated, n), (frequent, frequent.count()))]
        filters = spark.sparkContext.broadcast(made)  # 16 MB each at most

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Factors from the task's own block (with n, source and at), and rows for the index (with hashes)."""
        block = Block()
        for batch in slices(batches, "text"):
            doc, start, h, a, _ = windows(batch.column(1), window, anchor)
            if filters is not None and len(a):
                some = np.flatnonzero(bits.holds(filters.value[0], a))
                doc, start, h, a = doc[some], start[some], h[some], a[some]
            if not len(a):
                continue
            key = batch.column(0).to_numpy().astype(np.int64)[doc]
            late, source, at = block.take(h, key, start)
            if len(block.h) > REMEMBERED:
                block.forget()
            k, b, m, s, t = chained(key[late], start[late], source[late], at[late])
            rest = ~late
            many = bits.holds(filters.value[1], a[rest]) if filters is not None else np.zeros(int(rest.sum()), bool)
            rows = _index_rows(a[rest], h[rest], key[rest], start[rest], many)
            none = [pa.nulls(len(rows[0]), kind) for kind in (pa.int32(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows, *none], names)
            # they pass through the shuffle of the index, dealt by document
            yield pa.RecordBatch.from_arrays([pa.array(k * np.int64(0x9E3779B97F4A7)), pa.array(k), pa.array(b), pa.nulls(len(k), pa.binary()), pa.array(m), pa.array(s), pa.array(t)], names)

    names = ["g", "key", "begin", "hashes", "n", "source", "at"]
    kinds = "g long, key long, begin int, hashes binary, n int, source long, at int"
    rows = keyed.mapInArrow(look, kinds)
    if filters is None:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of the index whose anchor is found often, window by window."""
            for batch in batches:
                whole = batch.filter(pa.array(batch.column(7).is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays(whole.columns[:7], names)
                if whole.num_rows < batch.num_rows:
                    cut = batch.filter(batch.column(7).is_valid())
                    g, h, key, start = _index_windows(cut)
                    out = _index_rows(g.view(np.uint64), h, key, start, np.ones(len(h), bool))
                    yield pa.RecordBatch.from_arrays([*out, *[pa.nulls(len(out[0]), kind) for kind in (pa.int32(), pa.int64(), pa.int32())]], names)

        counts = repeated.select(F.col("a").alias("g"), F.lit(True).alias("held"), F.when(F.col("c") > often, F.col("c")).alias("c"))
        kept = rows.join(by_shuffle(counts), "g", "left").where("hashes is null or held")
        rows = kept.select(*names, "c").mapInArrow(split, kinds)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the index, sorted by g, key, begin."""
        block, last = Block(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.filter(batch.column(3).is_null())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(k) for k in (1, 2, 4, 5, 6)], FIELDS)
            held = batch.filter(batch.column(3).is_valid())
            if not held.num_rows:
                continue
            g, h, key, start = _index_windows(held)
            if g[0] != last:
                block.forget()
            late, source, at = block.take(h, key, start)
            last = g[-1]
            tail = np.unique(h[g == last])
            mine = np.searchsorted(block.h, tail) if g[0] != last else np.arange(len(block.h))
            block.h, block.key, block.start = block.h[mine], block.key[mine], block.start[mine]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in chained(key[late], start[late], source[late], at[late])], FIELDS)

    FIELDS = ["key", "begin", "n", "source", "at"]
    return rows.repartition("g").sortWithinPartitions("g", "key", "begin").mapInArrow(walk, FACTORS)


def _of_documents(found: DataFrame) -> DataFrame:
    """key, runs: the factors of a document as one array."""
    return found.groupBy("key").agg(F.collect_list(F.struct("begin", "n", "source", "at")).alias("runs"))


def _parsed(runs: pa.StructArray, window: int) -> np.ndarray:
    return parse(*(runs.field(k).to_numpy() for k in range(4)), window)


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The parse: doc_id, begin, words, source_id, source_begin of each factor, in words; ids are keys where doc_ids repeat.

    A block knows the first place of a window only, so a match that goes on at later places is
    told in several factors, and where it is cut depends on the blocks, that is on the splits of
    docs. The words that factors cover do not.
    """
    keyed = with_keys(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = _parsed(batch.column(1)[i].values, window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), batch.column(0)[i].as_py())), *[pa.array(f[:, k]) for k in range(4)]], ["doc_id", "begin", "words", "source_id", "source_begin"])

    return _of_documents(matches(keyed, window)).mapInArrow(run, "doc_id long, begin long, words long, source_id long, source_begin long")


def _removed(words: list[bytes], runs: pa.StructArray, window: int) -> list[bytes]:
    f = _parsed(runs, window)
    begin, end = covered(f[:, 0], f[:, 1])
    keep = bytearray(b"\x01") * len(words)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        keep[a:b] = bytes(b - a)
    return list(compress(words, keep))


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    docs = with_keys(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), "key")
    runs = _of_documents(matches(docs, window))
    joined = squeezed(docs, "text").join(by_shuffle(runs), "key", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            total, removed, sha = [], [], []
            runs = batch.column(2)
            for i, text in enumerate(unsqueeze(batch.column(1))):
                words = (text or b"").split()
                kept = _removed(words, runs[i].values, window) if runs[i].is_valid else words
                total.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with duplicate spans cut from text (and n_chars, if there, counted anew); other rows stay as they are.

    Of equal rows the first keeps its text; null texts and rows with a null id stay as they are.
    """
    names, schema = docs.columns, docs.schema
    mine, key = unused(names, "runs"), unused(names, "key")
    docs = with_keys(docs, key)
    runs = _of_documents(matches(docs.select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text")), window)).select(F.col("key").alias(key), F.col("runs").alias(mine))
    left = squeezed(docs, "text").join(by_shuffle(runs), key, "left").select(*[F.col(f"`{c}`") for c in names], mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = [None if x is None else x.decode() for x in unsqueeze(batch["text"])]
            columns = {c: batch[c] for c in names}
            sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * len(texts)
            for i, r in enumerate(batch[mine]):
                if r.is_valid and texts[i] is not None:
                    texts[i] = b" ".join(_removed(texts[i].encode().split(), r.values, window)).decode()
                    sizes[i] = len(texts[i])
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(sizes, batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return left.mapInArrow(run, schema)
