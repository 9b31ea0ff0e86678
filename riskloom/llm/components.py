"""Connected components of undirected links: trees in tasks, contraction by coins, and what is left in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import save

#: Children of a node in the tree that stands for a linked group.
FAN = 32
#: Rows of one key that a task may meet in a lookup; more of them are dealt to more shares.
SHARE_ROWS = 200_000
#: Links that one task unites (some 100 MB there).
FEW_LINKS = 500_000
#: Links that a task turns into trees at once, at least.
LEAST_SLICE = 1000


class Union:
    """Disjoint sets over 0..n-1 with the least member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(x) for x in range(len(self.up))), np.int64, len(self.up))


def forest(nodes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that hold each group of equal roots together, as trees of few children a node."""
    order = np.lexsort((nodes, roots))
    nodes, roots = nodes[order], roots[order]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(roots)) + 1]) if len(nodes) else np.empty(0, np.int64)
    base = np.repeat(begin, np.diff(np.concatenate([begin, [len(nodes)]])))
    rank = np.arange(len(nodes)) - base
    child = np.flatnonzero(rank > 0)
    return nodes[base[child] + (rank[child] - 1) // FAN], nodes[child]


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast, whatever its size looks like."""
    return df.hint("shuffle_merge")


def look_up(rows: DataFrame, key: str, table: DataFrame, spread: str, n: int) -> DataFrame:
    """rows with the columns of table, which has one row a key; inner.

    A key may stand in most of the n rows: both sides are dealt to shares by ``spread``,
    a column of rows. table should be small against rows, as it is repeated for each share.
    """
    shares = max(4, n // SHARE_ROWS)
    asked = rows.withColumn("_share", F.pmod(F.hash(spread), F.lit(shares)))
    told = table.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return asked.join(by_shuffle(told), [key, "_share"]).drop("_share")


def _parts(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and least linked nodes of each ``most`` links or somewhat more, or of all."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
        if held and most and n >= most:
            yield _unite(held)
            held, n = [], 0
    if held:
        yield _unite(held)


def _unite(ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
    union = Union(len(nodes))
    for a, b in zip(*at.reshape(2, -1).tolist(), strict=True):
        union.join(a, b)
    return nodes, nodes[union.roots()]


def _trees(links: DataFrame, most: int) -> DataFrame:
    """Fewer links a < b that connect the same nodes: trees of what each ``most`` links of a task connect."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, roots in _parts(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(nodes, roots)], ["a", "b"])

    return links.mapInArrow(trees, "a long, b long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links a, b -> node, component."""
    for nodes, roots in _parts(batches, None):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "component"])


def components(links: DataFrame, rounds: int = 1000, few: int = FEW_LINKS) -> DataFrame:
    """links: a stored table of bigint a, b. Returns node, component (its least reachable node) for nodes with links.

    Null ends link nothing, a link of a node to itself adds nothing, repeats count once.
    While there are more than ``few`` links, tasks turn theirs into trees, and nodes that have
    drawn tails join the least of their lesser neighbours that have drawn heads, which then
    stands for them: a quarter of the nodes that have a lesser neighbour, or more, each time.
    One task unites what is left, and nodes that have joined others take over their components,
    last ones first. The least node of a component never joins another, so it is its name.
    """
    rows, n = links.where("a is not null and b is not null and a <> b").select("a", "b"), links.count()
    slice_of = max(few, LEAST_SLICE)
    joined: list[DataFrame] = []
    for k in range(rounds):
        if n <= few:
            break
        if not k:
            rows = save(_trees(rows, slice_of), "edges")
        else:
            heads = lambda c: F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(1)) == 1  # noqa: E731, B023
            pairs = rows.where(heads("a") & ~heads("b")).groupBy("b").agg(F.min("a").alias("a"))
            joined.append(save(pairs.select(F.col("b").alias("node"), F.col("a").alias("to")), "joined"))
            for end in ("a", "b"):
                rows = rows.join(by_shuffle(joined[-1].toDF(end, "to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            rows = save(_trees(rows.where("a <> b").select("a", "b"), slice_of), "edges")
        n = rows.count()
    else:
        raise RuntimeError("components did not settle")
    label = save(rows.coalesce(1).mapInArrow(_united, "node long, component long"), "labels")
    for pairs in reversed(joined):
        told = save(pairs.join(by_shuffle(label.toDF("to", "component")), "to", "left"), "told")
        alone = told.where("component is null").select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
        label = save(label.unionByName(told.select("node", F.coalesce("component", "to").alias("component"))).unionByName(alone), "labels")
    return label
