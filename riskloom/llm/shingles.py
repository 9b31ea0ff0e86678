"""Links between documents of high Jaccard similarity by a prefix-tree join.

A document's set holds its distinct shingles of 4 words (A-Z lowered); with fewer words,
the whole sequence. Sets are ordered by one global order: shingles that are frequent among
the least hashes of all documents come last, by frequency, the others by hash. Two sets
that link share a shingle within the prefixes that their sizes and the threshold leave.

1. Documents of equal sets are one node, named by a hash of the set.
2. Prefix shingles that another prefix may hold (by filters, while these are of bounded
   size) meet in lists; a list gives the pairs that sizes and places in the order allow. A list of more than LIST nodes is "hot" and gives its nodes instead.
   Pairs that the counts of their sets in cells of hashes rule out are left: the overlap
   is at most the sum, over cells, of the lesser count.
3. The partners of a node are stored in a trie of their ordered sets, which the node's
   own set walks once, carrying the overlap on shared paths and leaving subtrees that the
   remaining lengths rule out. Each node meets its least partner first; other pairs are
   looked at only where that has not connected them.
4. Nodes of hot lists are dealt, twice, into blocks of about BLOCK nodes of one list, and
   each block is joined through its trie. Hot lists whose nodes are then not all connected
   are finished exactly: the nodes outside a list's largest component meet all its nodes.

Only links between nodes are verified and returned, as trees that hold linked nodes
together. Null and empty texts have empty sets and link with nothing; rows with a null id
are returned with a null component; rows with equal ids are documents of their own that
share an id, and link by their texts alone; an empty table has no rows; other columns are
ignored. Joins are by shuffle; keys that many rows share meet rows of a few numbers there,
which Spark's adaptive execution splits.

Shingles and sets are named by 64-bit hashes; for n different sets the chance that any
two are confused is n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bits
from .components import FEW_LINKS, Union, by_shuffle, components, forest, look_up
from .scratch import release, save
from .text import Words, grams, mix, slices, starts_in

WORDS = 4
PERCENT = 85
LIST = 64
BLOCK = 256
#: Where a hot list is finished, blocks are so many times as large: nodes are sent to fewer of them.
FINISH = 4
#: Frequent shingles that every worker knows: the most frequent ones, 16 bytes each.
FREQUENT = 200_000
#: Lists longer than this are what frequent shingles make.
LONG = 32


def sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at = starts_in(w.first, n)
    g = grams(h, n)[at]
    room = np.concatenate([[0], np.cumsum(np.maximum(w.counts - n + 1, 0))])
    out = []
    for i, count in enumerate(w.counts.tolist()):
        if count >= n:
            out.append(np.unique(g[room[i] : room[i + 1]]))
        elif count:
            value = np.uint64(xxhash.xxh3_64_intdigest(b" ".join(w.list(i)), seed=count))
            out.append(mix(np.array([value])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def least_overlap(a, b, percent: int = PERCENT):
    """The least overlap with which sets of sizes a and b link: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of the prefix: a partner shares at least percent/100 n of n."""
    return n - -(-percent * n // 100) + 1


def cell_counts(s: np.ndarray) -> bytes | None:
    """How many of a set's hashes lie in each of 2**k equal cells, about two a cell; null if a count passes a byte."""
    if not len(s):
        return None
    k = min(14, max(4, (len(s) - 1).bit_length() - 1))
    counts = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def possible(a: bytes | None, b: bytes | None, percent: int = PERCENT) -> bool:
    """Whether sets of these counts may link."""
    if a is None or b is None:
        return True
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    size = int(x.sum()), int(y.sum())
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(1)
    return int(np.minimum(x, y).sum()) >= least_overlap(*size, percent)


class Order:
    """Frequent shingles by frequency after all others by hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.counts = frequent[order], counts[order]

    def sort(self, s: np.ndarray) -> np.ndarray:
        """s by hash -> s in the global order."""
        if not len(self.frequent) or not len(s):
            return s
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        weight = np.where(self.frequent[at] == s, self.counts[at], 0)
        return s if not weight.any() else s[np.lexsort((s, weight))]


class Trie:
    """Ordered sets that share the paths of their common beginnings.

    A node is [shingles, children by first shingle, members that end here, most and least size below].
    """

    def __init__(self):
        self.root = [np.empty(0, np.uint64), {}, [], 0, 1 << 60]

    def add(self, s: np.ndarray, member: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node[3], node[4] = max(node[3], n), min(node[4], n)
            if at == n:
                node[2].append((member, n))
                return
            child = node[1].get(int(s[at]))
            if child is None:
                node[1][int(s[at])] = [s[at:], {}, [(member, n)], n, n]
                return
            path = child[0]
            m = min(len(path), n - at)
            apart = np.flatnonzero(path[:m] != s[at : at + m])
            k = int(apart[0]) if len(apart) else m
            if k < len(path):
                lower = [path[k:], child[1], child[2], child[3], child[4]]
                child[0], child[1], child[2] = path[:k], {int(path[k]): lower}, []
            node, at = child, at + k

    def partners(self, s: np.ndarray, percent: int = PERCENT) -> list[int]:
        """Members that link with s (sorted by hash)."""
        out, n = [], len(s)
        todo = [(x, 0, 0) for x in self.root[1].values()]
        while todo:
            node, overlap, depth = todo.pop()
            most, least = node[3], node[4]
            if 100 * least < percent * n and 100 * most < percent * n or percent * least > 100 * n:
                continue
            path = node[0]
            overlap += int((s[np.minimum(np.searchsorted(s, path), n - 1)] == path).sum())
            depth += len(path)
            # no set below can share more than what remains of it and of s
            if overlap + min(most - depth, n - overlap) < least_overlap(n, max(least, -(-percent * n // 100)), percent):
                continue
            for member, size in node[2]:
                if 100 * overlap >= percent * (n + size - overlap):
                    out.append(member)
            todo += [(x, overlap, depth) for x in node[1].values()]
        return out


def _array(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)


def join_block(members: list[np.ndarray], left: np.ndarray | None = None, label: np.ndarray | None = None, order: Order | None = None, percent: int = PERCENT, keys: list | None = None, key: int = 0) -> np.ndarray:
    """Roots of the members (sorted sets) by links within the block.

    left: rows that look for partners (all if None); label: rows of one label are taken as
    linked; keys: the lists of each row, of which a pair is looked at in the first common one.
    """
    union, trie = Union(len(members)), None
    if label is not None:
        first: dict = {}
        for i, x in enumerate(label.tolist()):
            union.join(first.setdefault(x, i), i)
    sizes = np.array([len(s) for s in members])
    cells = np.stack([np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=128) for s in members]).astype(np.int32)
    if keys is not None:
        names, of = np.unique(np.concatenate([np.asarray(k, np.int64) for k in keys]), return_inverse=True)
        held = np.zeros((len(members), len(names)), bool)
        held[np.repeat(np.arange(len(keys)), [len(k) for k in keys]), of] = True
        here = int(np.searchsorted(names, key))
    for i in range(len(members)) if left is None else left.tolist():
        # only partners that counts allow and that are not connected yet need a look
        able = np.minimum(cells[i], cells).sum(1) >= least_overlap(sizes[i], sizes, percent)
        if keys is not None:
            able &= (held[i] & held).argmax(1) == here
        mine = union.root(i)
        open_ = [j for j in np.flatnonzero(able).tolist() if union.root(j) != mine]
        if not open_:
            continue
        if len(open_) <= 4:
            s = members[i]
            for j in open_:
                t = members[j]
                overlap = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
                if 100 * overlap >= percent * (len(s) + len(t) - overlap):
                    union.join(i, j)
            continue
        if trie is None:
            trie = Trie()
            for k, s in enumerate(members):
                trie.add(order.sort(s) if order else s, k)
        for j in trie.partners(members[i], percent):
            union.join(i, j)
    return union.roots()


def _filter(keys: DataFrame, column: str, most_keys: int) -> np.ndarray | None:
    """A filter of a stored table's hashes, or none where they are too many for one of bounded size."""
    count = keys.count()
    return bits.build(keys, column, bits.log_bits_for(count)) if count <= most_keys else None


def link(docs: DataFrame, percent: int = PERCENT, n: int = WORDS, longest_list: int = LIST, block: int = BLOCK, most_keys: int = bits.MOST_KEYS, few_links: int = FEW_LINKS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    # how often the least hashes of documents occur
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            found = []
            for s in sets(batch.column(0), n):
                name = set_name(s)
                if name not in seen and len(s):
                    seen.add(name)
                    found.append(s[: prefix_length(len(s), percent)])
            if found:
                s, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c.astype(np.int64))], ["s", "c"])

    counts = save(docs.select("text").mapInArrow(least, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where("c > 1"), "repeated")
    top = counts.where(F.col("c") > LONG).orderBy(F.desc("c"), "s").limit(FREQUENT).toPandas()
    release(spark)
    known = _filter(counts, "s", most_keys)
    order = Order(top["s"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            size, name, prefix, extra, cells = [], [], [], [], []
            for s in sets(batch.column(1), n):
                size.append(len(s))
                name.append(set_name(s))
                fresh = len(s) and name[-1] not in seen  # copies in one task send one prefix
                seen.add(name[-1])
                first = order.sort(s)[: prefix_length(len(s), percent)] if fresh else s[:0]
                beyond = first[first > s[prefix_length(len(s), percent) - 1]] if fresh else first
                prefix.append(first.view(np.int64) if fresh else None)
                extra.append(beyond.view(np.int64) if len(beyond) else None)
                cells.append(cell_counts(s) if fresh else None)
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(name, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (prefix, extra)], pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "prefix", "extra", "cells"])

    named = save(docs.mapInArrow(prefixes, "doc_id long, n long, node long, prefix array<long>, extra array<long>, cells binary"), "named")
    # a shingle in two prefixes was counted twice among least hashes, or is beyond those of one of the sets
    beyond = _filter(save(named.where("extra is not null").select(F.explode("extra").alias("s")).distinct(), "beyond"), "s", most_keys)
    filters = spark.sparkContext.broadcast([known, beyond]) if known is not None and beyond is not None else None  # 16 MB each at most

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shingle of a prefix that other prefixes may hold."""
        for batch in batches:
            if batch.num_rows:
                key = batch.column(2).flatten().to_numpy()
                many = np.diff(batch.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), many)
                at = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
                if filters is not None:
                    ok = bits.holds(filters.value[0], key.view(np.uint64)) | bits.holds(filters.value[1], key.view(np.uint64))
                    key, row, at = key[ok], row[ok], at[ok]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at.astype(np.int32))], ["key", "node", "n", "at"])

    entries = named.where("prefix is not null").select("node", F.col("n").cast("int").alias("n"), "prefix").mapInArrow(shared, "key long, node long, n int, at int")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key, node -> pairs of small lists (hot = false), entries of hot ones (key, node, true)."""
        kept: list[np.ndarray] = []
        hot: int | None = None

        def close(rows: np.ndarray) -> tuple[list, list]:
            """Complete lists: rows of key, node, n, at."""
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            rows = rows[:, fresh]
            begin = np.flatnonzero(np.diff(rows[0], prepend=~rows[0, :1]))
            length = np.diff(begin, append=rows.shape[1])
            pairs, listed = [], []
            for b, m in zip(begin[length > 1].tolist(), length[length > 1].tolist(), strict=True):
                key, node, size, at = rows[:, b : b + m]
                if m > longest_list:
                    listed.append(np.stack([key, node]))
                    continue
                i, j = np.triu_indices(m, 1)
                need = least_overlap(size[i], size[j], percent)
                ok = 1 + np.minimum(size[i] - at[i], size[j] - at[j]) - 1 >= need
                ok &= np.minimum(size[i], size[j]) >= need
                pairs.append(np.stack([node[i[ok]], node[j[ok]]]))
            return pairs, listed

        def rows_of(pairs: list, listed: list) -> Iterator[pa.RecordBatch]:
            for found, is_hot in ((pairs, False), (listed, True)):
                if found:
                    both = np.concatenate(found, 1)
                    if both.shape[1]:
                        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.full(both.shape[1], is_hot))], ["a", "b", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if hot is not None:  # the rest of a list that was too long to keep
                m = int(np.searchsorted(rows[0], hot, side="right"))
                yield from rows_of([], [rows[:2, :m]])
                rows = rows[:, m:]
                if not rows.shape[1]:
                    continue
                hot = None
            rows = np.concatenate([*kept, rows], 1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            yield from rows_of(*close(rows[:, :cut])) if cut else ()
            tail = rows[:, cut:]
            if len(np.unique(tail[1])) > longest_list:
                hot = int(tail[0, 0])
                yield from rows_of([], [tail[:2]])
                kept = []
            else:
                kept = [tail]
        if kept:
            yield from rows_of(*close(kept[0]))

    met = entries.select("key", "node", "n", "at").repartition("key").sortWithinPartitions("key", "node").mapInArrow(lists, "a long, b long, hot boolean")
    met = save(met, "met")
    release(spark)
    pairs = met.where("not hot").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    listed = save(met.where("hot").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct(), "listed")
    cells = named.where("prefix is not null").groupBy("node").agg(F.first("cells").alias("cells"))

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [possible(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    with_cells = pairs.join(by_shuffle(cells.select(F.col("node").alias("a"), F.col("cells").alias("x"))), "a").join(by_shuffle(cells.select(F.col("node").alias("b"), F.col("cells").alias("y"))), "b")
    pairs = save(with_cells.select("a", "b", "x", "y").mapInArrow(may_link, "a long, b long"), "pairs")
    reps = save(named.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")

    # the sets of nodes that have a partner to look at, from their first documents
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(listed.select("node")).distinct().join(by_shuffle(reps), "node")
    asked = save(asked.select(F.xxhash64("rep").alias("h")), "asked")
    filtered = spark.sparkContext.broadcast(bits.build(asked, "h", bits.log_bits_for(asked.count())))  # 16 MB at most

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yes = bits.holds(filtered.value, spark_xxhash64(batch.column(0).fill_null(0).to_pylist()))
            found = [s for s in sets(batch.column(1).filter(pa.array(yes)), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "s"])

    one = save(docs.where("doc_id is not null").mapInArrow(whole, "node long, s array<long>"), "sets")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        """A node's partners in a trie."""
        group = group.drop_duplicates("b")
        a = group["a"].iloc[0]
        mine = group["b"] == a
        if not mine.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        probe = _array(group.loc[mine, "s"].iloc[0])
        others = group[~mine]
        trie = Trie()
        for k, s in enumerate(others["s"]):
            trie.add(order.sort(_array(s)), k)
        found = others["b"].to_numpy()[trie.partners(probe, percent)]
        return pd.DataFrame({"a": np.full(len(found), a), "b": found})

    def verified(pairs: DataFrame) -> DataFrame:
        with_sets = pairs.join(by_shuffle(one.withColumnRenamed("node", "b")), "b").select("a", "b", "s")
        own = pairs.select("a").distinct().join(by_shuffle(one.withColumnRenamed("node", "a")), "a").select("a", F.col("a").alias("b"), "s")
        return with_sets.unionByName(own).groupBy("a").applyInPandas(verify, "a long, b long")

    # small lists: each node with its least partner first, then the pairs that are not connected by that
    least_pairs = save(pairs.groupBy("b").agg(F.min("a").alias("a")), "least")
    links = verified(least_pairs.select("a", "b"))

    # hot lists: two deals into blocks of one list
    sizes = save(listed.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "sizes")
    sized = listed.join(by_shuffle(sizes), "key")
    home = sized.groupBy("node").agg(F.max_by(F.struct("key", "m"), F.struct("m", "key")).alias("h")).select("node", "h.key", "h.m")
    deal = F.explode(F.array(F.lit(0), F.lit(1)))
    blocks = home.select("node", "key", "m", deal.alias("deal"))
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("node", "deal"), F.ceil(F.col("m") / block).cast("bigint")))
    blocks = blocks.select("node", F.xxhash64("key", "deal", "part").alias("block"))

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        node = group["node"].to_numpy()
        a, b = forest(node, join_block([_array(s) for s in group["s"]], order=order, percent=percent))
        return pd.DataFrame({"a": a, "b": b})

    hot_links = blocks.join(by_shuffle(one), "node").groupBy("block").applyInPandas(within, "a long, b long")
    links = save(links.unionByName(hot_links), "links")
    release(spark)
    label = components(links, few=few_links)
    ends = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    rest = pairs.join(by_shuffle(least_pairs.withColumnRenamed("a", "tried")), "b").where("a <> tried").select("a", "b")
    rest = rest.join(by_shuffle(ends("a")), "a", "left").join(by_shuffle(ends("b")), "b", "left").where("not a_label <=> b_label or a_label is null").select("a", "b")
    rest = save(rest, "rest")
    if rest.limit(1).count():
        links = save(links.unionByName(verified(rest)), "links")
        release(spark)
        label = components(links, few=few_links)

    # hot lists that are not connected yet
    known = listed.join(by_shuffle(label), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    known = save(known, "known")
    share = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    per_key = share.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("all")).where("most < all")
    open_keys = save(per_key, "open")
    if open_keys.limit(1).count():
        rest = known.join(by_shuffle(open_keys), "key").withColumn("minor", F.col("label") != F.col("main"))
        parts = F.ceil(F.col("all") / (FINISH * block)).cast("int")
        minors = F.ceil((F.col("all") - F.col("most")) / (FINISH * block)).cast("int")
        rest = rest.withColumn("i", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), minors).cast("int"))
        seek = rest.where("minor").select("key", "node", "label", "j", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"), F.lit(True).alias("seeks"))
        stay = rest.select("key", "node", "label", F.explode(F.sequence(F.lit(0), minors - 1)).alias("j"), "i", F.lit(False).alias("seeks"))
        meetings = seek.unionByName(stay).groupBy("key", "i", "j", "node", "label").agg(F.max("seeks").alias("seeks"))
        meetings = meetings.select("node", "key", "label", "seeks", F.xxhash64("key", "i", "j").alias("block"))
        with_keys = save(one.join(by_shuffle(listed.groupBy("node").agg(F.collect_set("key").alias("keys"))), "node"), "hot")

        def finish(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("seeks", ascending=False).drop_duplicates("node")
            node, label = group["node"].to_numpy(), group["label"].to_numpy()
            roots = join_block([_array(s) for s in group["s"]], np.flatnonzero(group["seeks"].to_numpy()), label, order, percent, list(group["keys"]), int(group["key"].iloc[0]))
            new = np.unique(label, return_index=True)[1]
            new = new[roots[new] != new]  # labels that have become linked
            return pd.DataFrame({"a": node[roots[new]], "b": node[new]})

        more = meetings.join(by_shuffle(with_keys), "node").groupBy("block").applyInPandas(finish, "a long, b long")
        label = components(save(links.unionByName(more), "links"), few=few_links)

    # components of sets, named by the least id of a document that has one of them
    linked = save(label.join(by_shuffle(reps), "node"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = look_up(linked.select("node", "component"), "component", least, "node", linked.count()).select("node", "component_id")
    final = save(reps.join(by_shuffle(joined), "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")), "final")
    out = named.where("n > 0").join(by_shuffle(final), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def spark_xxhash64(values: list[int]) -> np.ndarray:
    """What Spark's xxhash64 gives for bigint values (XXH64 of 8 bytes, seed 42), as unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=42) for v in values), np.uint64, len(values))
