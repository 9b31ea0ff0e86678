"""Links between vectors of high cosine by an epsilon grid order join.

Unit vectors link at a distance of at most sqrt(2 - 2 cosine) = epsilon. They are turned to
principal axes, cut into cells of width epsilon on the leading axes, and sorted by these
cells (the epsilon grid order). The sequence is cut into intervals of INTERVAL vectors, the
most that one task holds of each side, however many there are; two intervals meet unless
the boxes around them, or around the GATHER intervals they belong to, are further apart
than epsilon (which Spark finds level by level, by shuffle), and within a meeting halves are joined recursively, leaving out pairs of
blocks whose boxes are too far apart. Leaves compare by a product in double precision.

Exact copies are joined as one vector with their number. A meeting returns each vector's
number of links and trees that hold linked vectors together, never its pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing and
are returned with 0 links as their own component. Only vectors of one length link: each
length has a join of its own, and lengths of at most INTERVAL vectors share one, in which
each is one interval. Rows with a null id are left out of links and returned as their own
component null. Repeated rows (equal ids) are copies of one another. An empty table has
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import Union, by_shuffle, components, forest
from .scratch import save

COSINE = 0.95
INTERVAL = 4096
#: Vectors of one range of the grid order when it is sorted.
RANGE = 65_536
#: Intervals whose boxes are first looked at as one, and as many of these again, until one is around all.
GATHER = 256
LEAF = 512
FOUND = "a long, b long, links long"
#: Vectors from which the axes are found; axes only order the join, any would be right.
AXES_SAMPLE = 4000
CELLS = 8


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal directions of unit vectors as columns, leading first."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])
    x = sample - sample.mean(0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def far(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, eps: float) -> np.ndarray:
    """Whether two boxes are further apart than eps (with some room for rounding)."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0.0)
    return (gap * gap).sum(-1) > eps * eps * (1 + 1e-9) + 1e-12


def meet(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, cosine: float, eps: float, same: bool, leaf: int = LEAF) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Linked pairs of rows of two intervals in grid order: unit vectors, and turned ones for the boxes.

    Yields (offset in a, offset in b, rows, rows) a leaf at a time. same: a is b, each pair once.
    """
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k < i:
            continue
        if far(ta[i:j].min(0), ta[i:j].max(0), tb[k:m].min(0), tb[k:m].max(0), eps):
            continue
        if j - i <= leaf and m - k <= leaf:
            hit = a[i:j] @ b[k:m].T >= cosine
            if same and i == k:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            if len(x):
                yield i, k, x, y
            continue
        half = lambda p, q: [(p, (p + q) // 2), ((p + q) // 2, q)] if q - p > leaf else [(p, q)]
        todo += [(p, q, r, s) for p, q in half(i, j) for r, s in half(k, m)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linked(x: np.ndarray, t: np.ndarray, rep: np.ndarray, times: np.ndarray, split: int, cosine: float, eps: float, same: bool) -> pa.Table:
    """A meeting's result: of two intervals at split, or of one."""
    found, union = np.zeros(len(x), np.int64), Union(len(x))
    for i, k, p, q in meet(x[:split] if split else x, x[split:], t[:split] if split else t, t[split:], cosine, eps, same):
        p, q = p + i, q + k + split
        np.add.at(found, p, times[q])
        np.add.at(found, q, times[p])
        roots = union.roots()
        apart = roots[p] != roots[q]
        for u, v in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
            union.join(u, v)
    roots = union.roots()
    tree = forest(rep, rep[roots])
    some = np.flatnonzero(found)
    columns = {
        "a": np.concatenate([rep[some], tree[0]]),
        "b": np.concatenate([np.full(len(some), -1), tree[1]]),
        "links": np.concatenate([found[some], np.zeros(len(tree[0]), np.int64)]),
    }
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _typed(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """Rows as a batch of these types, also where there are none."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _in_order(reps: DataFrame, turn: np.ndarray, lead: int, eps: float, n: int, interval: int) -> DataFrame:
    """rep, times, v, part: the vectors in grid order, cut into intervals of ``interval`` rows."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spot = unit(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)) @ turn[:, :lead]
                cells = np.floor(spot / eps).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(cells[:, k])) for k in range(lead)], pa.array(np.ascontiguousarray(spot[:, 0]))], ["rep", "times", "v", *grid])

    grid = [*(f"c{k}" for k in range(lead)), "x"]
    kinds = "rep long, times long, v array<double>, " + ", ".join(f"c{k} long" for k in range(lead)) + ", x double"
    spotted = reps.select("rep", "times", "v").mapInArrow(spots, kinds)
    # a table: the ranges that Spark samples stay what they are
    dealt = save(spotted.repartitionByRange(max(1, -(-n // RANGE)), *grid, "rep").withColumn("pid", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("pid").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("pid", before.alias("before"))  # one row for RANGE vectors
    place = F.row_number().over(W.partitionBy("pid").orderBy(*grid, "rep")) - 1
    placed = dealt.withColumn("place", place).join(F.broadcast(starts), "pid")
    return save(placed.select("rep", "times", "v", F.expr(f"(place + before) div {interval}").alias("part")), "placed")


def _boxes(placed: DataFrame, turn: np.ndarray) -> DataFrame:
    """part, low, high: the box around each interval."""
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = ["part", "low", "high"]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            t = unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)) @ turn
            for p in np.unique(part).tolist():
                mine = t[part == p]
                low[p] = np.minimum(low[p], mine.min(0)) if p in low else mine.min(0)
                high[p] = np.maximum(high[p], mine.max(0)) if p in high else mine.max(0)
        yield _typed([(p, low[p].tolist(), high[p].tolist()) for p in low], kinds, names)

    def whole(group: pa.Table) -> pa.Table:
        low, high = (np.stack([np.asarray(x) for x in group[c].to_pylist()]) for c in ("low", "high"))
        return pa.Table.from_batches([_typed([(group["part"][0].as_py(), low.min(0).tolist(), high.max(0).tolist())], kinds, names)])

    schema = "part long, low array<double>, high array<double>"
    return placed.select("part", "v").mapInArrow(some, schema).groupBy("part").applyInArrow(whole, schema)


BOX = "part long, low array<double>, high array<double>"


def _around(boxes: DataFrame, gather: int) -> DataFrame:
    """part, low, high: the box around each ``gather`` boxes."""
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def around(group: pa.Table) -> pa.Table:
        low, high = (np.stack([np.asarray(x) for x in group[c].to_pylist()]) for c in ("low", "high"))
        return pa.Table.from_batches([_typed([(group["many"][0].as_py(), low.min(0).tolist(), high.max(0).tolist())], kinds, ["part", "low", "high"])])

    return boxes.withColumn("many", F.expr(f"part div {gather}")).groupBy("many").applyInArrow(around, BOX)


def _close(boxes: DataFrame, meetings: DataFrame, eps: float, gather: int) -> DataFrame:
    """a, b: pairs of near boxes, each once and each box with itself, where the gathered boxes p, q that hold them meet."""

    def near(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        part, mine = group["part"].to_numpy(), group["many"].to_numpy()
        low, high = (np.array(group[c].to_pylist(), np.float64) for c in ("low", "high"))
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        out = []
        for i in left.tolist():
            other = right[part[right] >= part[i]] if p == q else right
            for j in other[~far(low[i], high[i], low[other], high[other], eps)].tolist():
                out.append(tuple(sorted((int(part[i]), int(part[j])))))
        return pa.Table.from_batches([_typed(out, [pa.int64(), pa.int64()], ["a", "b"])])

    ends = F.explode(F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q")))
    dealt = boxes.withColumn("many", F.expr(f"part div {gather}")).join(by_shuffle(meetings.select("p", "q", ends.alias("many"))), "many")
    return dealt.groupBy("p", "q").applyInArrow(near, "a long, b long")


def _near(boxes: DataFrame, eps: float, count: int) -> DataFrame:
    """a, b: the pairs of the ``count`` intervals whose boxes are near, each once, and each interval with itself.

    Boxes are gathered level by level until one is around all; from there on down, boxes
    are compared only where those around them are near, at most GATHER with GATHER in a task.
    """
    gather, levels = GATHER, [save(boxes, "boxes")]
    while count > gather:
        levels.append(save(_around(levels[-1], gather), "boxes"))
        count = -(-count // gather)
    pairs = boxes.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels):
        pairs = _close(level, pairs.toDF("p", "q"), eps, gather)
    return pairs


def _found(reps: DataFrame, d: int, n: int, cosine: float, interval: int) -> DataFrame:
    """Numbers of links (a, links) and trees (a, b) among n vectors of length d."""
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(AXES_SAMPLE).select("v").toArrow()["v"].to_pylist()
    turn = axes(unit(np.array(sample, np.float64)))
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    lead = min(CELLS, d)
    placed = _in_order(reps, turn, lead, eps, n, interval)
    meetings = save(_near(_boxes(placed, turn), eps, -(-n // interval)), "meetings")
    ends = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b")))
    dealt = placed.join(by_shuffle(meetings.select("a", "b", ends.alias("part"))), "part")

    def join(group: pa.Table) -> pa.Table:
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        part, rep, times = (group[c].to_numpy() for c in ("part", "rep", "times"))
        x = unit(group["v"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1))
        t = x @ turn
        cells = np.floor(t[:, :lead] / eps)
        order = np.lexsort(np.concatenate([rep[None], t[:, :1].T, cells.T[::-1], (part == b)[None] if a != b else np.zeros((1, len(t)))]))
        x, t, rep, times = x[order], t[order], rep[order], times[order]
        split = int((part == a).sum()) if a != b else 0
        return _linked(x, t, rep, times, split, cosine, eps, a == b)

    return save(dealt.groupBy("a", "b").applyInArrow(join, FOUND), "found")


def _found_in_rare(reps: DataFrame, cosine: float) -> DataFrame:
    """As _found, for lengths of one interval each."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        x = unit(group["v"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1))
        return _linked(x, x, group["rep"].to_numpy(), group["times"].to_numpy(), 0, cosine, eps, True)

    return save(reps.select("d", "rep", "times", "v").groupBy("d").applyInArrow(join, FOUND), "found")


def link(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = save(rows.select("vec_id", F.when(fine, F.col("v")).alias("v")).withColumn("copy", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)), "vectors")
    # copies stand together under their least id
    reps = rows.where("v is not null").groupBy("copy").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.min("v").alias("v"))
    reps = save(reps.withColumn("d", F.size("v")), "reps")
    # at most one in interval vectors has a length with a join of its own
    sizes = reps.groupBy("d").count().withColumn("place", F.row_number().over(W.orderBy(F.desc("count"), "d"))).where((F.col("place") == 1) | (F.col("count") > interval)).orderBy("place").collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = [_found(reps.where(F.col("d") == x["d"]), x["d"], x["count"], cosine, interval) for x in sizes]
    rare = reps.where(~F.col("d").isin([x["d"] for x in sizes]))
    if rare.limit(1).count():
        found.append(_found_in_rare(rare, cosine))
    found = reduce(DataFrame.unionByName, found)
    counts = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    label = components(found.where("links = 0").select("a", "b"))
    named = reps.join(by_shuffle(counts), reps["rep"] == counts["a"], "left").join(by_shuffle(label), reps["rep"] == label["node"], "left")
    named = save(named.select("copy", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    out = rows.where("copy is not null").select("vec_id", "copy").join(by_shuffle(named), "copy").drop("copy")
    out = out.unionByName(rows.where("copy is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
