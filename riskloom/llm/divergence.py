"""How far the word distributions of a language's sources lie apart, in whole numbers.

1. Batches of texts are one buffer of UTF-8 bytes; a table of 256 entries finds the bounds
   of words (runs of letters; all bytes beyond ASCII count as letters, A-Z become a-z).
2. Words are grouped by XXH64 of their bytes; each is compared byte by byte with the first
   of its group, and those that differ are grouped again under another seed.
3. A task adds up (lang, source, term) for the rows it reads and passes on sums; one shuffle
   by (lang, term) brings a term's sources together, whose document frequency then decides.
4. The kept terms of a language are dealt by hash to shards of about SHARD_ENTRIES counts. A
   shard is a matrix of sources x terms in compressed rows. Divergences of all pairs of
   sources are sums over its rows by reduceat, with the smoothed share of absent terms taken
   from the source; sums of shards are added by shuffle. Leading terms of shards are ranked.

p = 1 + floor(SCALE (count + 2) / (N + 2 V)) by long division, so it is exact as long as
N + 2 V < 2**53; f(p, q) = floor((p - q)**2 / (p + q)).

Null texts, langs and sources count as ''. Rows are documents: rows that share an id count
one by one. Languages without kept terms have pairs of value 0. An empty table has no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import save
from .text import LETTERS, Words, slices

SCALE, SMOOTH = 1_000_000_000, 2
#: Documents of its language that a term needs, and terms reported for a source.
LEAST_DOCUMENTS, TOP = 10, 10
#: Rows of sums that a task holds before it adds them up, and before it passes them on.
HELD, PASSED = 900_000, 600_000
#: Counts of one shard.
SHARD_ENTRIES = 200_000
COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"

#: The five primes of XXH64.
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(words: Words, i: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of the bytes of words i: short ones at once, those of 32 bytes and more one by one."""
    eight = np.ndarray((len(words.raw) - 7,), "<u8", words.raw, strides=(1,))
    at, size = words.start[i], words.end[i] - words.start[i]
    h = np.uint64(seed) + _P[4] + size.astype(np.uint64)
    for k in (0, 8, 16):
        m = np.flatnonzero(size >= k + 8)
        if not len(m):
            break
        lane = _rotl(eight[at[m] + k] * _P[1], 31) * _P[0]
        h[m] = _rotl(h[m] ^ lane, 27) * _P[0] + _P[3]
    done = size & ~7
    m = np.flatnonzero(size - done >= 4)
    four = (eight[at[m] + done[m]] & np.uint64(0xFFFFFFFF)) * _P[0]
    h[m] = _rotl(h[m] ^ four, 23) * _P[1] + _P[2]
    done[m] += 4
    for _ in range(3):
        m = np.flatnonzero(size > done)
        h[m] = _rotl(h[m] ^ (words.raw[at[m] + done[m]].astype(np.uint64) * _P[4]), 11) * _P[0]
        done[m] += 1
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(words.raw[at[k] : at[k] + size[k]].tobytes(), seed)
    return h


def grouped(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal bytes only, and a word of each number."""
    number, first = np.empty(len(words), np.int64), []
    left, seed, n = np.arange(len(words)), 0, 0
    while len(left):
        _, lead, of = np.unique(xxh64(words, left, seed), return_index=True, return_inverse=True)
        lead = left[lead]
        same = words.equal(left, words, lead[of])
        number[left[same]] = n + of[same]
        first.append(lead)
        n += len(lead)
        left, seed = left[~same], seed + 1
    return number, np.concatenate(first) if first else left


_EVERY = np.ones(256, bool)
_TALLY = ["lang", "source", "term", "n", "docs"]


def tally(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences n and documents docs of each (lang, source, term) of a batch lang, source, text."""
    words = Words(batch["text"], lower=True, inside=LETTERS)
    number, first = grouped(words)
    pair, times = np.unique(words.doc() * max(1, len(first)) + number, return_counts=True)
    doc, number = pair // max(1, len(first)), pair % max(1, len(first))
    lang, source = (pc.fill_null(batch[c].cast(pa.string()), "").dictionary_encode().take(pa.array(doc)) for c in ("lang", "source"))
    return _sums(lang, source, words, number, first, times.astype(np.int64), np.ones(len(doc), np.int64))


def add_up(tables: list[pa.Table]) -> pa.Table:
    """Several tallies as one."""
    table = pa.concat_tables(tables).combine_chunks()
    words = Words(table["term"].combine_chunks(), inside=_EVERY)
    lang, source = (table[c].cast(pa.string()).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    return _sums(lang, source, words, *grouped(words), table["n"].to_numpy(), table["docs"].to_numpy())


def _sums(lang: pa.DictionaryArray, source: pa.DictionaryArray, words: Words, number: np.ndarray, first: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    """Rows of equal lang, term number and source added up."""
    terms, sources = max(1, len(first)), max(1, len(source.dictionary))
    key = (lang.indices.to_numpy().astype(np.int64) * terms + number) * sources + source.indices.to_numpy()
    order = np.argsort(key)
    key = key[order]
    lead = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    sums = [np.add.reduceat(x[order], lead) if len(lead) else x for x in (n, docs)]
    key = key[lead]
    take = lambda d, k: d.dictionary.take(pa.array(k))
    return pa.table([take(lang, key // (terms * sources)), take(source, key % sources), words.array(first[key // sources % terms]).cast(pa.string()), *map(pa.array, sums)], _TALLY)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in slices(batches, "text"):
        held.append(tally(batch))
        n += held[-1].num_rows
        if n > HELD:
            held = [add_up(held)]
            n = held[0].num_rows
            if n > PASSED:
                yield from held[0].to_batches(max_chunksize=100_000)
                held, n = [], 0
    if n:
        yield from add_up(held).to_batches(max_chunksize=100_000)


def share(count: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + SMOOTH) / total), three digits of the quotient at a time."""
    rest = np.asarray(count, np.int64) + SMOOTH
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Shard:
    """Counts of some terms (in order) in all sources of a language, in compressed rows."""

    def __init__(self, sources: list[str], totals: np.ndarray, kept: int, terms: list[str], source: np.ndarray, term: np.ndarray, n: np.ndarray):
        order = np.lexsort((term, source))
        self.sources, self.terms, self.row, self.term, self.n = sources, terms, source[order], term[order], n[order]
        self.start = np.searchsorted(self.row, np.arange(len(sources)))
        self.size = np.bincount(self.row, minlength=len(sources))
        self.filled = np.flatnonzero(self.size)
        whole = totals + SMOOTH * kept
        self.p = share(self.n, whole[self.row])
        self.absent = share(np.zeros(len(sources), np.int64), whole)
        everywhere = np.zeros(len(terms), np.int64)
        np.add.at(everywhere, self.term, self.n)
        self.language = share(everywhere, int(totals.sum()) + SMOOTH * kept)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each row."""
        out = np.zeros(len(self.sources), np.int64)
        out[self.filled] = np.add.reduceat(values, self.start[self.filled])
        return out

    def pairs(self, s: int) -> np.ndarray:
        """Sum over the terms of the divergence of source s and each source."""
        mine = slice(self.start[s], self.start[s] + self.size[s])
        dense = np.full(len(self.terms), self.absent[s])
        dense[self.term[mine]] = self.p[mine]
        out = divergence(self.absent[s], self.absent) * (len(self.terms) - self.size[s])
        own, times = np.unique(self.p[mine], return_counts=True)
        for p, k in zip(own.tolist(), times.tolist(), strict=True):
            out += divergence(p, self.absent) * k
        there = dense[self.term]
        return out + self.sums(divergence(there, self.p) - divergence(there, self.absent[self.row]))

    def leading(self, s: int, top: int = TOP) -> list[tuple[str, int]]:
        """Terms of source s whose share is greater than in the language, the most divergent first."""
        mine = slice(self.start[s], self.start[s] + self.size[s])
        term, p = self.term[mine], self.p[mine]
        q = self.language[term]
        more = p > q
        term, f = term[more], divergence(p[more], q[more])
        return [(self.terms[term[k]], int(f[k])) for k in np.lexsort((term, -f))[:top]]


def _measure(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One shard: its counts, and all sources of its language."""
    lang, kept = groups["lang"][0].as_py(), groups["kept"][0].as_py()
    sources = sorted(groups["source"].to_pylist(), key=str.encode)
    totals = dict(zip(groups["source"].to_pylist(), groups["total"].to_pylist(), strict=True))
    place = {s: k for k, s in enumerate(sources)}
    coded = counts["term"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda k: names[k].encode())
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    source = np.array([place[s] for s in counts["source"].to_pylist()], np.int64)
    shard = Shard(sources, np.array([totals[s] for s in sources], np.int64), kept, [names[k] for k in order], source, rank[coded.indices.to_numpy()], counts["n"].to_numpy())
    heads = ["lang", "source", "part", "item", "value"]
    types = [pa.string()] * 4 + [pa.int64()]
    out = []
    for s, name in enumerate(sources):
        pairs, leading = shard.pairs(s), shard.leading(s)
        item = [t for t in sources if t != name] + [t for t, _ in leading]
        value = np.delete(pairs, s).tolist() + [v for _, v in leading]
        part = ["pair"] * (len(sources) - 1) + ["term"] * len(leading)
        columns = [[lang] * len(item), [name] * len(item), part, item, value]
        out.append(pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], heads))
    return pa.concat_tables(out)


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; several rows of each, to be added up."""
    return docs.select("lang", "source", "text").mapInArrow(_counts, COUNTS)


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, n of the terms in at least that many documents of their language."""
    sums = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.withColumn("docs", F.sum("docs").over(W.partitionBy("lang", "term"))).where(F.col("docs") >= least).drop("docs")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: sources by divergence (``pair``), telling terms (``term``)."""
    kept = save(kept_counts(docs, least), "audit")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    occurring = docs.select(blank("lang"), blank("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ENTRIES)).alias("shards"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = save(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("shards", F.lit(0)).cast("bigint").alias("shards")), "groups")
    dealt = kept.join(groups.select("lang", "shards").distinct(), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    each = groups.where("shards > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    measured = dealt.select("lang", "shard", "term", "source", "n").groupBy("lang", "shard").cogroup(each.select("lang", "shard", "source", "total", "kept").groupBy("lang", "shard")).applyInArrow(_measure, PARTS)
    measured = save(measured, "measured")
    other = groups.select("lang", F.col("source").alias("item"))
    bare = groups.where("shards = 0").select("lang", "source").join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    pairs = measured.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(bare)
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = measured.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
