"""Shapley values of any model by weighted least squares over coalitions of features.

For a coalition, features in it have the explained row's values and the others those of
background rows; the coalition's worth is the mean output over the background. With up to
``coalitions`` coalitions all are taken and values are exact, else pairs of a coalition and
its complement are drawn by the kernel's weights. The least-squares solution is a fixed
matrix times the worths, so Spark scores all combinations with the model, averages over the
background, and adds up matrix entries times worths in two aggregations; rows that agree in
their features are explained once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..errors import ValidationError
from ..functions.basics import col, fresh, require

#: Background rows, coalitions and explained distinct rows where nothing is said.
BACKGROUND, COALITIONS, EXPLAINED = 30, 128, 500


def coalitions_of(m: int, most: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions but the empty and the whole one, and their weights."""
    if 2**m <= most:
        every = [s for size in range(1, m) for s in combinations(range(m), size)]
        z = np.array([[f in s for f in range(m)] for s in every], bool).reshape(-1, m)
        size = z.sum(1)
        return z, np.array([(m - 1) / (math.comb(m, s) * s * (m - s)) for s in size.tolist()])
    rng = np.random.default_rng(seed)
    share = np.array([1 / (s * (m - s)) for s in range(1, m)])
    drawn: dict[tuple, int] = {}
    for _ in range(8 * most):
        if len(drawn) + 2 > most:
            break
        one = np.zeros(m, bool)
        one[rng.permutation(m)[: 1 + rng.choice(m - 1, p=share / share.sum())]] = True
        for z in (one, ~one):
            drawn[tuple(z.tolist())] = drawn.get(tuple(z.tolist()), 0) + 1
    return np.array(list(drawn), bool), np.array(list(drawn.values()), float)


def solution(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The matrix that turns worths (of nothing, of everything, of each coalition) into values that add up to the difference."""
    m, n = z.shape[1], len(z)
    if m == 1:
        return np.array([[-1.0, 1.0]])
    x = z[:, :-1].astype(float) - z[:, -1:]
    y = np.zeros((n, n + 2))  # worth of the coalition above nothing, less the last feature's part of the whole
    y[:, 2:] = np.eye(n)
    y[:, 0] = -1.0 + z[:, -1]
    y[:, 1] = -z[:, -1].astype(float)
    first = np.linalg.lstsq((x * weight[:, None]).T @ x, (x * weight[:, None]).T @ y, rcond=None)[0]
    last = -first.sum(0)
    last[0] -= 1
    last[1] += 1
    return np.vstack([first, last])


def kernel_contributions(predict: Callable[[DataFrame, str], DataFrame], df: DataFrame, features: list[str], background: DataFrame | None = None, n_background: int = BACKGROUND, coalitions: int = COALITIONS, explained: int | None = EXPLAINED, seed: int = 42) -> DataFrame:
    """The features, n_rows (rows of these values), base (mean output of the background) and phi_0, phi_1, ... in their order; names that features have get an underscore.

    predict(rows, name) adds a number; explained: that many distinct rows by hash (None: all);
    the background are n_background rows by hash.
    """
    require(df, *features)
    if len(features) > 62 or coalitions < 2 * len(features) + 2:
        raise ValidationError("at most 62 features, and at least 2 (features + 1) coalitions")
    m = len(features)
    names = [f"x{k}" for k in range(m)]
    pick = lambda rows: rows.select(*[col(f).alias(n) for f, n in zip(features, names, strict=True)])
    scene = pick(df if background is None else background)
    scene = scene.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(n_background).collect()
    if not scene:
        raise ValidationError("the background has no rows")
    z, weight = coalitions_of(m, coalitions, seed)
    masks = [0, 2**m - 1, *[sum(1 << f for f in range(m) if row[f]) for row in z]]
    matrix = solution(z, weight)
    rows = pick(df).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    if explained:
        rows = rows.orderBy(F.xxhash64(F.lit(seed + 1), *names), *names).limit(explained)
    types = {f.name: f.dataType for f in rows.schema}
    other = F.explode(F.array(*[F.struct(*[F.lit(r[n]).cast(types[n]).alias(n) for n in names]) for r in scene])).alias("other")
    each = rows.withColumn("own", F.struct(*names)).select("own", "n", F.posexplode(F.array(*map(F.lit, masks))).alias("c", "mask")).select("own", "n", "c", "mask", other)
    mixed = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col(f"own.{n}")).otherwise(F.col(f"other.{n}")).alias(f) for k, (f, n) in enumerate(zip(features, names, strict=True))]
    packed = []
    for x in ("_own", "_n", "_c", "_v"):
        packed.append(fresh([*features, *packed], x))
    asked = each.select(*[F.col(a).alias(b) for a, b in zip(("own", "n", "c"), packed[:3], strict=True)], *mixed)
    worth = predict(asked, packed[3]).groupBy(*packed[:3]).agg(F.avg(packed[3]).alias("v"))
    entry = lambda k: F.element_at(F.array(*map(F.lit, matrix[k].tolist())), F.col(packed[2]) + 1)
    sums = worth.groupBy(packed[0], packed[1]).agg(F.sum(F.when(F.col(packed[2]) == 0, F.col("v"))).alias("base"), *[F.sum(entry(k) * F.col("v")).alias(f"phi_{k}") for k in range(m)])
    return sums.select(*[F.col(f"{packed[0]}.{n}").alias(f) for f, n in zip(features, names, strict=True)], F.col(packed[1]).alias(fresh(features, "n_rows")), F.col("base").alias(fresh(features, "base")), *[F.col(f"phi_{k}").alias(fresh(features, f"phi_{k}")) for k in range(m)])


def kernel_importance(predict: Callable[[DataFrame, str], DataFrame], df: DataFrame, features: list[str], **how) -> DataFrame:
    """feature, importance: the mean size of its contributions over the explained rows."""
    table = kernel_contributions(predict, df, features, **how)
    n, phi = table.columns[len(features)], table.columns[len(features) + 2 :]
    row = table.agg(*[F.sum(F.abs(p) * F.col(n)) / F.sum(n) for p in phi]).first()
    return df.sparkSession.createDataFrame([(f, float(v or 0.0)) for f, v in zip(features, row, strict=True)], "feature string, importance double")
