"""Boosted trees from histograms of gradients and hessians, grown by levels, by leaves or obliviously.

Rows are stored once as bin numbers (0: missing) with label, weight and margin; rows that are
alike in all of these are one, with their weights and numbers added up, unless a round takes
a share of the rows. A pass over them gives, for nodes of a tree that is being grown, sums of gradients and hessians by
feature and bin: tasks add up their rows, sums of tasks are added by feature in a shuffle
(in two steps where there are many tasks), and the task that has a feature's sums finds its
best split of each node. The driver sees one row a feature and node. Trees made since
margins were last stored are applied to bins on the way, so a round costs no extra scan.

* by levels (``xgboost``): every node whose best split gains enough, down to a depth.
* by leaves (``lightgbm``): always the leaf of greatest gain, up to a number of leaves. Splits of
  all leaves that may still be chosen are looked up in one pass, which leaves the order as it is.
* obliviously (``catboost``): one split for all nodes of a level; missing values are the least.

A split sends values below a cut to the left and missing ones to the side that gains more.
Gain is score(left) + score(right) - score(node), score(G, H) = soft(G, l1)**2 / (H + l2), a leaf's
value -rate * soft(G, l1) / (H + l2). Gains that differ by less than one part in 10**9 count as
equal; of those the first feature, the lowest cut and missing to the right win, so sums that
are added in another order give the same tree. Cuts are exact quantiles. Margins start from the
weighted mean, or its log odds.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import ValidationError
from ..functions.basics import col, fresh
from ..functions.quantiles import _together, lower_quantiles, running
from ..sources.shared import shared_path
from . import metrics
from .attribution import Leaf

#: Trees that are applied to bins before margins are stored again, and where there are more than MANY_ROWS.
KEEP, KEEP_MANY, MANY_ROWS = 10, 2, 1_000_000
#: Rows up to which a sketch gives exact quantiles; beyond they are searched by digits.
SKETCHED = 20_000
#: Tasks beyond which their sums are added in two steps.
MANY_TASKS = 256
#: Relative difference below which gains are equal.
EQUAL = 1e-9
#: What the libraries of these names take where nothing is said.
DEFAULTS = {
    "xgboost": {"grow": "level", "rounds": 100, "rate": 0.3, "depth": 6, "l2": 1.0, "min_hessian": 1.0, "bins": 256},
    "lightgbm": {"grow": "leaf", "rounds": 100, "rate": 0.1, "depth": -1, "leaves": 31, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20, "bins": 255},
    "catboost": {"grow": "oblivious", "rounds": 1000, "rate": 0.03, "depth": 6, "l2": 3.0, "min_hessian": 0.0, "bins": 255},
}
#: Names of parameters in those libraries.
NAMES = {
    "n_estimators": "rounds", "iterations": "rounds", "num_iterations": "rounds", "num_boost_round": "rounds", "num_trees": "rounds", "learning_rate": "rate", "eta": "rate",
    "max_depth": "depth", "depth": "depth", "num_leaves": "leaves", "max_leaves": "leaves", "reg_alpha": "l1", "alpha": "l1", "lambda_l1": "l1", "reg_lambda": "l2", "lambda": "l2",
    "lambda_l2": "l2", "l2_leaf_reg": "l2", "gamma": "gain", "min_split_loss": "gain", "min_split_gain": "gain", "min_gain_to_split": "gain", "min_child_weight": "min_hessian",
    "min_sum_hessian_in_leaf": "min_hessian", "min_child_samples": "min_rows", "min_data_in_leaf": "min_rows", "min_samples_leaf": "min_rows", "max_bin": "bins", "border_count": "bins",
    "subsample": "row_share", "bagging_fraction": "row_share", "colsample_bytree": "column_share", "feature_fraction": "column_share", "rsm": "column_share",
    "random_state": "seed", "random_seed": "seed", "early_stopping_rounds": "stop", "eval_metric": "metric",
}
METRICS = {"logloss": 1, "binary_logloss": 1, "error": 1, "rmse": 1, "mae": 1, "auc": -1}
STATE = "y double, w double, n double, held boolean, h long, bins binary, margin double"


@dataclass(frozen=True)
class Settings:
    grow: str = "level"
    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    leaves: int = 0
    l1: float = 0.0
    l2: float = 1.0
    gain: float = 0.0
    min_hessian: float = 1.0
    min_rows: int = 1
    bins: int = 256
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42
    stop: int | None = None
    metric: str | None = None
    task: str = "classification"

    @classmethod
    def of(cls, model_type: str, task: str, params: dict, unused: set = frozenset()) -> Settings:
        """Parameters under the names of the libraries, over the library's defaults."""
        known = set(cls.__dataclass_fields__) - {"grow", "task"}
        given = {NAMES.get(k, k): v for k, v in params.items() if k == "eval_metric" or k not in unused}
        if strange := [k for k in given if k not in known]:
            raise ValidationError(f"{model_type} has no such parameters: {strange}")
        out = cls(**(DEFAULTS[model_type] | {k: v for k, v in given.items() if v is not None} | {"task": task}))
        metric = out.metric or ("logloss" if task == "classification" else "rmse")
        if metric not in METRICS:
            raise ValidationError(f"no such metric: {metric}")
        if not 2 <= out.bins <= 60_000 or out.rounds < 1:
            raise ValidationError("bins lie in 2 to 60000, rounds are at least 1")
        if out.grow == "oblivious" and out.depth > 16:
            raise ValidationError("oblivious trees have at most 16 levels")
        return cls(**(out.__dict__ | {"metric": metric}))

    def score(self, g, h):
        h = h + self.l2
        return np.where(h > 0, self.soft(g) ** 2 / np.where(h > 0, h, 1), 0.0)

    def soft(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0)

    def value(self, g: float, h: float) -> float:
        return float(-self.rate * self.soft(g) / (h + self.l2)) if h + self.l2 > 0 else 0.0


@dataclass
class Tree:
    """Nodes in the order they were made; feature -1 for a leaf. bin: the last one that goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, last: int, cut: float, missing_left: bool, gain: float) -> tuple[int, int]:
        for name in self.__dataclass_fields__:
            getattr(self, name).extend([{"feature": -1, "missing_left": False, "left": 0, "right": 0, "bin": 0}.get(name, 0.0)] * 2)
        n = len(self.feature)
        self.feature[node], self.bin[node], self.cut[node], self.missing_left[node], self.gain[node] = feature, last, cut, missing_left, gain
        self.left[node], self.right[node] = n - 2, n - 1
        return n - 2, n - 1

    def place(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of each row, of bin numbers or of values."""
        if levels := self.levels():
            return self._place_by_levels(x, binned, levels)
        node, todo = np.zeros(len(x), np.int64), [(0, None)]
        while todo:
            at, rows = todo.pop()
            f = self.feature[at]
            if f < 0:
                node[slice(None) if rows is None else rows] = at
                continue
            v = x[:, f] if rows is None else x[rows, f]
            if binned:
                to_left = v <= self.bin[at]
                if not self.missing_left[at]:
                    to_left &= v != 0
            else:
                to_left = v < self.cut[at]
                if self.missing_left[at]:
                    to_left |= np.isnan(v)
            for child, side in ((self.left[at], to_left), (self.right[at], ~to_left)):
                todo.append((child, np.flatnonzero(side) if rows is None else rows[side]))
        return node

    def levels(self) -> list[list[int]]:
        """The nodes of each level, from the left, if all of a level have one split (an oblivious tree); else none."""
        out = [[0]]
        split = lambda v: (self.feature[v], self.bin[v], self.cut[v], self.missing_left[v])
        while self.feature[out[-1][0]] >= 0:
            if any(split(v) != split(out[-1][0]) for v in out[-1]):
                return []
            out.append([c for v in out[-1] for c in (self.left[v], self.right[v])])
        return out if all(self.feature[v] < 0 for v in out[-1]) else []

    def _place_by_levels(self, x: np.ndarray, binned: bool, levels: list[list[int]]) -> np.ndarray:
        """A comparison a level for all rows at once: its bits are the leaf's number from the left."""
        at = np.zeros(len(x), np.int32)
        for nodes in levels[:-1]:
            v, one = x[:, self.feature[nodes[0]]], nodes[0]
            if binned:
                right = v > self.bin[one]
                if not self.missing_left[one]:
                    right |= v == 0
            else:
                right = ~(v < self.cut[one])
                if self.missing_left[one]:
                    right &= ~np.isnan(v)
            at += at
            at += right
        return np.array(levels[-1], np.int64)[at]

    def leaves(self) -> list[Leaf]:
        """Leaves with the intervals of their paths, for contributions."""
        out, todo = [], [(0, 1.0, {}, frozenset())]
        while todo:
            node, reach, path, missing = todo.pop()
            f = self.feature[node]
            if f < 0:
                out.append(Leaf(self.value[node], reach, path, missing))
                continue
            low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
            top = math.nextafter(self.cut[node], -math.inf)
            for child, bounds, stays in ((self.left[node], (low, min(high, top)), self.missing_left[node]), (self.right[node], (max(low, top), high), not self.missing_left[node])):
                part = self.cover[child] / self.cover[node] if self.cover[node] else 0.5
                here = stays and (f in missing or f not in path)
                todo.append((child, reach * part, path | {f: (*bounds, share * part)}, missing | {f} if here else missing - {f}))
        return out


class Boosted:
    """A fitted model: numbers for rows of features, missing ones as NaN."""

    def __init__(self, task: str, features: list[str], base: float, trees: list[Tree], history: list[float] = (), best: int | None = None):
        self.task, self.features, self.base, self.trees = task, list(features), base, trees
        #: The held sample's metric after each round, and the round that was kept (from 0).
        self.history, self.best_round = list(history), best

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.place(x, False)]
        return out

    def output(self, columns: list[Column]) -> Column:
        """The probability of class 1, or the number, of columns in the order of the features."""
        model = self

        def run(x: pd.DataFrame) -> pd.Series:
            m = model.margin(x.to_numpy(np.float64))
            return pd.Series(_chance(m) if model.task == "classification" else m)

        return F.pandas_udf(run, "double")(F.struct(*[c.alias(f"f{k}") for k, c in enumerate(columns)]))

    def importance(self) -> list[float]:
        """Shares of the features in all gains."""
        out = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[f] += g
        return (out / out.sum() if out.sum() else out).tolist()

    def to_json(self) -> str:
        return json.dumps({"task": self.task, "features": self.features, "base": self.base, "trees": [t.__dict__ for t in self.trees], "history": self.history, "best": self.best_round})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        return cls(d["task"], d["features"], d["base"], [Tree(**t) for t in d["trees"]], d["history"], d["best"])


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def cuts(df: DataFrame, columns: list[Column], bins: int) -> list[list[float]]:
    """Distinct quantiles of each column's values above its least, one less than ``bins`` at most."""
    at = [k / bins for k in range(1, bins)]
    values = df.select(*[F.when(~F.isnan(c), c).alias(f"_{k}") for k, c in enumerate(columns)])
    counts = values.agg(*[F.count(f"_{k}") for k in range(len(columns))]).first()
    if max(counts, default=0) > SKETCHED:
        found = lower_quantiles(values, list(counts), [0.0, *at])
    else:  # up to as many rows the sketch holds all values
        row = values.agg(*[F.percentile_approx(f"_{k}", [0.0, *at], SKETCHED) for k in range(len(columns))]).first()
        found = [v or [] for v in row]
    return [sorted({v for v in each if v > each[0]}) for each in found]


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class _Rows:
    """The stored rows, and the trees that their margins do not yet have."""

    def __init__(self, df: DataFrame, features: list[Column], y: Column, w: Column, held: Column, s: Settings):
        self.spark, self.s, self.n = df.sparkSession, s, len(features)
        self.cuts = cuts(df, features, s.bins)
        self.type = np.uint8 if max(map(len, self.cuts), default=0) < 255 else np.uint16
        rows = df.select(y.cast("double").alias("y"), w.cast("double").alias("w"), held.alias("held"), *[c.alias(f"f{k}") for k, c in enumerate(features)])
        rows = rows.withColumn("h", F.xxhash64(*rows.columns) if s.row_share < 1 else F.lit(0).cast("bigint"))
        of_train = F.when(~F.col("held"), F.col("w"))
        total = rows.agg(F.sum(of_train), F.sum(of_train * F.col("y")), F.count(F.when(F.col("held"), 1))).first()
        mean = (total[1] or 0.0) / total[0] if total[0] else 0.0
        if s.task == "classification":
            mean = min(max(mean, 1e-12), 1 - 1e-12)
            mean = math.log(mean / (1 - mean))
        self.base, self.any_held = mean, bool(total[2])
        where, kind = self.cuts, self.type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.zeros((b.num_rows, len(where)), kind)
                for k, c in enumerate(where):
                    v = b[f"f{k}"].to_numpy(zero_copy_only=False).astype(np.float64)
                    x[:, k] = np.where(np.isnan(v), 0, np.searchsorted(c, v, "right") + 1)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([b["y"], b["w"], b["held"], b["h"], packed], ["y", "w", "held", "h", "bins"])

        self.path, self.recent = None, []
        alike = rows.mapInArrow(run, "y double, w double, held boolean, h long, bins binary").groupBy("y", "held", "h", "bins").agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
        self._write(alike.select("y", "w", "n", "held", "h", "bins", F.lit(float(mean)).alias("margin")))
        self.keep = KEEP_MANY if self.table.count() > MANY_ROWS else KEEP

    def _write(self, df: DataFrame) -> None:
        path = shared_path(self.spark, "boosting")
        df.write.parquet(path)
        if self.path:
            _drop(self.spark, self.path)
        self.path, self.recent, self.table = path, [], self.spark.read.schema(STATE).parquet(path)
        self.tasks = self.table.rdd.getNumPartitions()

    def close(self) -> None:
        _drop(self.spark, self.path)

    def add(self, tree: Tree) -> None:
        self.recent.append(tree)
        if len(self.recent) >= self.keep:
            margin, at = self._margin(), self.table.columns.index("margin")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in _together(batches):
                    yield b.set_column(at, "margin", pa.array(margin(b)[1]))

            self._write(self.table.mapInArrow(run, STATE))

    def _margin(self):
        trees, n, kind = list(self.recent), self.n, self.type

        def margin(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            # one buffer has the bins of all rows, one row after the other
            bins, width = b["bins"], n * np.dtype(kind).itemsize
            start = int.from_bytes(memoryview(bins.buffers()[1])[4 * bins.offset : 4 * bins.offset + 4], "little") if width and b.num_rows else 0
            x = np.frombuffer(bins.buffers()[2], kind, b.num_rows * n, start).reshape(b.num_rows, n) if width and b.num_rows else np.zeros((b.num_rows, n), kind)
            out = b["margin"].to_numpy().copy()
            for t in trees:
                out += np.array(t.value)[t.place(x, True)]
            return x, out

        return margin

    def splits(self, tree: Tree, nodes: list[int], chosen: list[int], round_: int) -> tuple[dict[int, list[tuple]], np.ndarray]:
        """For each node its features' best splits, and the losses of the margins so far.

        A split is (gain, feature, last bin on the left, missing to the left, then G, H, rows on
        the left and in the node). Losses: of training and held rows, each sum and weight.
        """
        s, margin, sizes = self.s, self._margin(), [len(c) + 2 for c in self.cuts]
        wide, of = max(sizes), {v: k for k, v in enumerate(nodes)}
        index = np.full(len(tree.feature), -1)
        for v, k in of.items():
            index[v] = k
        rows_kept, draw = s.row_share < 1, np.uint64(random.Random(s.seed * 1_000_003 + round_).getrandbits(64))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(chosen), 3, len(nodes) * wide))
            loss = np.zeros(4)
            for b in _together(batches):
                x, m = margin(b)
                y, w, held, many = (b[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "held", "n"))
                held = held.astype(bool)
                g, h, each = _derivatives(s, y, w, m)
                for k, part in enumerate((~held, held)):
                    loss[2 * k] += each[part].sum()
                    loss[2 * k + 1] += w[part].sum()
                place = index[tree.place(x, True)]
                keep = (place >= 0) & ~held
                if rows_kept:
                    z = (b["h"].to_numpy().view(np.uint64) ^ draw) * np.uint64(0x9E3779B97F4A7C15)
                    keep &= ((z ^ (z >> np.uint64(32))) >> np.uint64(11)) < np.uint64(s.row_share * 2**53)
                if not keep.all():
                    place, g, h, x, many = place[keep], g[keep], h[keep], x[keep], many[keep]
                place = place * wide
                for k, f in enumerate(chosen):
                    at = place + x[:, f]
                    for j, v in enumerate((g, h, many)):
                        total[k, j] += np.bincount(at, v, total.shape[2])
            yield pa.RecordBatch.from_arrays([pa.array([-1, *chosen], pa.int32()), pa.array([loss.tobytes(), *[t.tobytes() for t in total]], pa.binary())], ["feature", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            """Sums of each feature; rows are in order of features."""
            at, total = None, None
            for b in batches:
                for f, x in zip(b["feature"].to_pylist(), b["sums"].to_pylist(), strict=True):
                    x = np.frombuffer(x)
                    if f != at:
                        if at is not None:
                            yield at, total
                        at, total = f, x.copy()
                    else:
                        total += x
            if at is not None:
                yield at, total

        def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f, total in added(batches):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["feature", "sums"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f, total in added(batches):
                if f < 0:
                    found = [(0, -1, 0, False, *total, 0.0, 0.0, 0.0)]
                else:
                    found = _best(s, f, total.reshape(3, len(nodes), wide)[:, :, : sizes[f]])
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(_SPLIT.names, r, strict=True)) for r in found], schema=_SPLIT)

        each = self.table.mapInArrow(sums, "feature int, sums binary")
        if self.tasks > MANY_TASKS:
            share = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(self.tasks)))
            each = each.withColumn("share", share).repartition("feature", "share").sortWithinPartitions("share", "feature").drop("share").mapInArrow(passed_on, "feature int, sums binary")
        rows = each.repartition(min(len(chosen) + 1, max(2, self.spark.sparkContext.defaultParallelism)), "feature").sortWithinPartitions("feature").mapInArrow(best, _SPLIT_SQL).collect()  # a row a feature and node
        out: dict[int, list[tuple]] = {v: [] for v in nodes}
        loss = np.zeros(4)
        for r in rows:
            if r["feature"] < 0:
                loss = np.array([r["gain"], r["gl"], r["hl"], r["nl"]])
            else:
                out[nodes[r["node"]]].append((r["gain"], r["feature"], r["bin"], r["missing_left"], r["gl"], r["hl"], r["nl"], r["g"], r["h"], r["n"]))
        return out, loss

    def held_auc(self) -> float:
        margin = self._margin()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _together(batches):
                yield pa.RecordBatch.from_arrays([b["y"], b["w"], pa.array(margin(b)[1])], ["y", "w", "s"])

        scored = self.table.where("held").mapInArrow(run, "y double, w double, s double")
        return metrics.ks_auc(scored, "y", "s", weight="w").first()["auc"]


_SPLIT = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("missing_left", pa.bool_()), *[(c, pa.float64()) for c in ("gain", "gl", "hl", "nl", "g", "h", "n")]])
_SPLIT_SQL = "node int, feature int, bin int, missing_left boolean, gain double, gl double, hl double, nl double, g double, h double, n double"


def _derivatives(s: Settings, y: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients, hessians and weighted losses under the metric."""
    if s.task == "classification":
        p = _chance(m)
        loss = (p >= 0.5) != (y > 0.5) if s.metric == "error" else np.logaddexp(0, m) - y * m
        return w * (p - y), w * np.maximum(p * (1 - p), 1e-16), w * loss
    return w * (m - y), w.copy(), w * (np.abs(m - y) if s.metric == "mae" else (m - y) ** 2)


def first_best(gain: np.ndarray) -> int:
    """The first place whose gain is equal to the greatest."""
    top = gain.max()
    return int(np.flatnonzero(gain >= top - EQUAL * abs(top))[0]) if np.isfinite(top) else 0


def _best(s: Settings, f: int, sums: np.ndarray) -> list[tuple]:
    """A feature's best split of each node, or of all nodes at once, as rows of _SPLIT; sums: G, H, rows by node and bin."""
    whole = sums.sum(2)
    present = np.cumsum(sums[:, :, 1:], 2)[:, :, :-1]  # left sums with bins 1 to k on the left
    if not present.shape[2]:
        return []
    left = np.stack([present, present + sums[:, :, :1]], 3)  # missing to the right, to the left
    right = whole[:, :, None, None] - left
    fits = (left[2] >= s.min_rows) & (right[2] >= s.min_rows) & (left[1] >= s.min_hessian) & (right[1] >= s.min_hessian)
    if s.grow == "oblivious":
        gain = (s.score(left[0], left[1]) + s.score(right[0], right[1]) - s.score(whole[0], whole[1])[:, None, None]).sum(0)[:, 1]
        k = first_best(gain)
        each = range(whole.shape[1])
        return [(v, f, k + 1, True, float(gain[k]), *map(float, left[:, v, k, 1]), *map(float, whole[:, v])) for v in each]
    gain = np.where(fits, s.score(left[0], left[1]) + s.score(right[0], right[1]) - s.score(whole[0], whole[1])[:, None, None], -np.inf)
    if not sums[2, :, 0].any():  # nothing is missing: to the right, as where both sides are equal
        gain[:, :, 1] = -np.inf
    out = []
    for v in range(gain.shape[0]):
        at = first_best(gain[v].ravel())
        k, missing = divmod(at, 2)
        if np.isfinite(gain[v, k, missing]):
            out.append((v, f, k + 1, bool(missing), float(gain[v, k, missing]), *map(float, left[:, v, k, missing]), *map(float, whole[:, v])))
    return out


class _Grower:
    """One tree over the stored rows."""

    def __init__(self, rows: _Rows, chosen: list[int], round_: int):
        self.rows, self.s, self.chosen, self.round = rows, rows.s, chosen, round_
        self.tree, self.level, self.known, self.loss = Tree(), {0: 0}, {}, None

    def look_up(self, tree: Tree, nodes: list[int]) -> dict[int, tuple | None]:
        found, loss = self.rows.splits(tree, nodes, self.chosen, self.round)
        self.loss = loss if self.loss is None else self.loss
        out = {}
        for v, each in found.items():
            each.sort(key=lambda r: r[1])
            one = each[first_best(np.array([r[0] for r in each]))] if each else None
            out[v] = one if one and one[0] > max(self.s.gain, 1e-12 * abs(float(self.s.score(one[7], one[8])))) else None
            if each:
                self._totals(tree, v, each[0][7:])
        return out

    def _totals(self, tree: Tree, node: int, ghn: tuple) -> None:
        tree.value[node], tree.cover[node] = self.s.value(ghn[0], ghn[1]), ghn[2]

    def apply(self, tree: Tree, node: int, one: tuple) -> tuple[int, int]:
        gain, f, last, missing, gl, hl, nl, g, h, n = one
        a, b = tree.split(node, f, last, self.rows.cuts[f][last - 1], missing, gain)
        self._totals(tree, a, (gl, hl, nl))
        self._totals(tree, b, (g - gl, h - hl, n - nl))
        return a, b

    def by_levels(self) -> Tree:
        tree, frontier = self.tree, [0]
        for _ in range(self.s.depth if self.s.depth > 0 else 64):
            found = self.look_up(tree, frontier)
            frontier = [c for v in frontier if found[v] for c in self.apply(tree, v, found[v])]
            frontier = [v for v in frontier if tree.cover[v] >= 2 * self.s.min_rows]
            if not frontier:
                break
        return tree

    def obliviously(self) -> Tree:
        tree, frontier = self.tree, [0]
        for _ in range(self.s.depth):
            found, loss = self.rows.splits(tree, frontier, self.chosen, self.round)
            self.loss = loss if self.loss is None else self.loss
            each = sorted(found[frontier[0]], key=lambda r: r[1])
            if not each:
                break
            if len(frontier) == 1:
                self._totals(tree, 0, each[0][7:])
            one = each[first_best(np.array([r[0] for r in each]))]
            if one[0] <= max(self.s.gain, 0.0):
                break
            mine = {v: next(r for r in found[v] if r[1] == one[1]) for v in frontier}
            frontier = [c for v in frontier for c in self.apply(tree, v, mine[v])]
        return tree

    def by_leaves(self) -> Tree:
        """wide has every split looked up so far; the tree takes them in order of gain."""
        s, wide = self.s, self.tree
        splits = self.look_up(wide, [0])
        depth, children = {0: 0}, {}
        while True:
            taken, open_ = [], [0]
            while len(taken) + 1 < s.leaves:
                ready = [v for v in open_ if splits.get(v)]
                if not ready:
                    break
                v = ready[first_best(np.array([splits[v][0] for v in ready]))]
                if v not in children:
                    break
                taken.append(v)
                open_ = [x for x in open_ if x != v] + list(children[v])
            room = s.leaves - 1 - len(taken)
            ready = sorted((v for v in open_ if splits.get(v) and v not in children), key=lambda v: -splits[v][0])[: max(0, room)]
            if not ready:
                break
            fresh_nodes = []
            for v in ready:
                children[v] = self.apply(wide, v, splits[v])
                for c in children[v]:
                    depth[c] = depth[v] + 1
                    if (s.depth <= 0 or depth[c] < s.depth) and wide.cover[c] >= 2 * s.min_rows:
                        fresh_nodes.append(c)
            if fresh_nodes:
                splits |= self.look_up(wide, fresh_nodes)
        out = Tree()
        self._copy(wide, 0, out, 0)
        of = {0: 0}
        for v in taken:
            one = splits[v]
            a, b = out.split(of[v], one[1], one[2], wide.cut[v], one[3], one[0])
            for new, old in zip((a, b), children[v], strict=True):
                of[old] = new
                self._copy(wide, old, out, new)
        return out

    @staticmethod
    def _copy(a: Tree, v: int, b: Tree, w: int) -> None:
        b.value[w], b.cover[w] = a.value[v], a.cover[v]


def fit(df: DataFrame, features: list[Column], names: list[str], y: Column, w: Column, settings: Settings, held: Column | None = None) -> Boosted:
    """Learns from the rows that are not held; with ``stop`` rounds end that long after the held rows' best."""
    s = settings
    rows = _Rows(df, features, y, w, F.lit(False) if held is None else F.coalesce(held, F.lit(False)), s)
    if s.stop and not rows.any_held:
        raise ValidationError("early stopping needs held rows")
    trees, history, best = [], [], None
    sign = METRICS[s.metric]
    try:
        for r in range(s.rounds + 1):
            last = r == s.rounds
            if last and not s.stop:
                break
            chosen = list(range(len(features)))
            if s.column_share < 1:
                chosen = sorted(random.Random(s.seed * 7919 + r).sample(chosen, max(1, round(s.column_share * len(chosen)))))
            grower = _Grower(rows, chosen, r)
            if last:
                grower.look_up(grower.tree, [0])
                tree = None
            else:
                tree = {"level": grower.by_levels, "leaf": grower.by_leaves, "oblivious": grower.obliviously}[s.grow]()
            if s.stop and r:  # losses seen by round r are those after r trees
                now = rows.held_auc() if s.metric == "auc" else float(grower.loss[2] / grower.loss[3])
                history.append(math.sqrt(now) if s.metric == "rmse" else now)
                if best is None or sign * history[-1] < sign * history[best]:
                    best = r - 1
                if r - 1 - best >= s.stop:
                    break
            if tree is None or (len(tree.feature) == 1 and s.row_share == s.column_share == 1):
                break  # no round is left, or none would split anything
            trees.append(tree)
            rows.add(tree)
    finally:
        rows.close()
    kept = trees if best is None else trees[: best + 1]
    return Boosted(s.task, names, rows.base, kept, history, best)


class OrderedStatistics:
    """Mean targets of categories: for learning over the rows before a row in a random order, else over all.

    mean = (sum of targets + prior) / (rows + 1), prior: the mean of all. Learning rows never
    see their own target. The random order is by hash of the given key, or of the whole row.
    """

    def __init__(self, columns: list[str], seed: int = 42):
        self.columns, self.seed = list(columns), seed

    def fit(self, df: DataFrame, y: str, key: list[str] = (), held: Column | None = None) -> DataFrame:
        """Learns from the rows that are not held, and returns df with the columns replaced."""
        taken = list(df.columns)
        order, target, one = (fresh(taken, x) for x in ("_order", "_target", "_one"))
        learn = F.lit(True) if held is None else ~F.coalesce(held, F.lit(False))
        rows = df.withColumns({order: F.xxhash64(F.lit(self.seed), *map(col, key or df.columns)), target: F.when(learn, col(y).cast("double")).otherwise(0.0), one: learn.cast("double")})
        row = rows.agg(F.sum(target), F.sum(one)).first()
        self.prior = row[0] / row[1] if row[1] else 0.0
        self.tables = {}
        for c in self.columns:
            names = [*taken, order, target, one]
            total, n = fresh(names, "_total"), fresh(names, "_n")
            rows = rows.withColumn(c, F.coalesce(col(c).cast("string"), F.lit("")))
            self.tables[c] = rows.groupBy(col(c).alias(c)).agg(((F.sum(target) + self.prior) / (F.sum(one) + 1)).alias("mean"))
            before = running(rows, order, {total: target, n: one}, within=(c,))
            rows = before.withColumn(c, (F.col(total) - F.col(target) + self.prior) / (F.col(n) - F.col(one) + 1)).drop(total, n)
        return rows.drop(order, target, one)

    def transform(self, df: DataFrame, place: dict[str, str] | None = None) -> DataFrame:
        """df with the columns (or those that stand for them) as means over all learning rows; the prior for new categories."""
        for c in self.columns:
            mine, name = (place or {}).get(c, c), fresh(df.columns, "_mean")
            table = self.tables[c].toDF(f"{name}k", name)
            joined = df.join(table, F.coalesce(col(mine).cast("string"), F.lit("")) == F.col(f"{name}k"), "left")
            df = joined.withColumn(mine, F.coalesce(F.col(name), F.lit(self.prior))).select(*map(col, df.columns))
        return df
