"""Many logistic models at once: folds, strengths and sets of features in the same scans.

Each Newton step is one scan for all models. A task adds up, for every model, the loss, the
gradient and the Gram matrix of the rows that train it; a shuffle by model adds up the tasks
(in two steps where there are many), and the driver, which sees (features + 1)**2 numbers a
model, takes the steps. So the number of jobs is that of the slowest model's steps, about ten,
whatever the number of models. A step that makes a loss worse is halved.

The loss is sum(w * log loss) + sum(b**2) / (2 C) without the intercept. Missing values count as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Steps at most, and the size of a step, in terms of the loss, that ends a model's search.
STEPS, ENOUGH = 50, 1e-12
#: Tasks beyond which their sums are added in two steps.
MANY_TASKS = 256
_SUMS = "model int, sums binary"


@dataclass
class Wanted:
    """A model: its strength, the places of its features, and the folds that train it (None: all rows)."""

    c: float
    features: list[int]
    folds: frozenset[int] | None = None
    start: np.ndarray | None = None


def _sums(models: list[tuple[int, Wanted, np.ndarray]], p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros(1 + (len(s.features) + 1) * (len(s.features) + 2)) for m, s, _ in models}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.ones((b.num_rows, p + 1))
            for k in range(p):
                x[:, k + 1] = b[f"x{k}"].to_numpy(zero_copy_only=False)
            y, w, fold = (b[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "fold"))
            for m, s, beta in models:
                rows = slice(None) if s.folds is None else np.isin(fold, list(s.folds))
                xs, ys, ws = x[rows][:, [0, *[k + 1 for k in s.features]]], y[rows], w[rows]
                z = xs @ beta
                q = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                n = xs.shape[1]
                t = total[m]
                t[0] += (ws * (np.logaddexp(0, z) - ys * z)).sum()
                t[1 : n + 1] += xs.T @ (ws * (q - ys))
                t[n + 1 :] += ((xs * (ws * q * (1 - q))[:, None]).T @ xs).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["model", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are in order of models."""
    at, total = None, None
    for b in batches:
        for m, x in zip(b["model"].to_pylist(), b["sums"].to_pylist(), strict=True):
            if m == at:
                total += np.frombuffer(x)
                continue
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["model", "sums"])
            at, total = m, np.frombuffer(x).copy()
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["model", "sums"])


def table(df: DataFrame, y: Column, w: Column, features: list[Column], fold: Column | None = None) -> DataFrame:
    """The columns that fit() reads: y, w, fold, x0, x1, ...; rows that are alike are one, with their weights added up."""
    x = [F.coalesce(F.when(~F.isnan(c.cast("double")), c.cast("double")), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)]
    rows = df.select(y.cast("double").alias("y"), w.cast("double").alias("w"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"), *x)
    return rows.groupBy("y", "fold", *[f"x{k}" for k in range(len(features))]).agg(F.sum("w").alias("w"))


def fit(rows: DataFrame, p: int, wanted: list[Wanted]) -> list[np.ndarray]:
    """Intercept and coefficients of each model, over a table() that is stored or cheap to read."""
    beta = [np.zeros(len(s.features) + 1) if s.start is None else s.start.copy() for s in wanted]
    last: list[tuple[float, np.ndarray] | None] = [None] * len(wanted)
    left = set(range(len(wanted)))
    tasks = rows.rdd.getNumPartitions()
    for _ in range(STEPS):
        each = rows.mapInArrow(_sums([(m, wanted[m], beta[m]) for m in sorted(left)], p), _SUMS)
        if tasks > MANY_TASKS:
            share = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))
            each = each.withColumn("share", share).repartition("model", "share").sortWithinPartitions("share", "model").drop("share").mapInArrow(_added, _SUMS)
        parts = min(len(left), max(2, rows.sparkSession.sparkContext.defaultParallelism))
        for m, sums in each.repartition(parts, "model").sortWithinPartitions("model").mapInArrow(_added, _SUMS).collect():  # a row a model
            s, b = wanted[m], beta[m]
            t, n = np.frombuffer(sums), len(b)
            ridge = np.concatenate([[0.0], np.full(n - 1, 1 / s.c)])
            loss, g, h = t[0] + (ridge * b * b).sum() / 2, t[1 : n + 1] + ridge * b, t[n + 1 :].reshape(n, n) + np.diag(ridge)
            if last[m] is not None and not loss <= last[m][0] * (1 + 1e-13) + 1e-300:
                beta[m] = (b + last[m][1]) / 2
                if np.array_equal(beta[m], b):
                    left.discard(m)
                continue
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            gain = float(g @ step) / 2
            if gain <= ENOUGH * max(1.0, abs(loss)):
                left.discard(m)  # this step is taken still, it costs nothing
            last[m] = (loss, b)
            beta[m] = b - step
        if not left:
            break
    return beta
