"""Kernel Shapley values against enumeration, sampled coalitions of an additive model, calibrated models."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import models as L, shapley as S


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(2)
    return pd.DataFrame(np.round(rng.normal(size=(40, 4)), 2), columns=["a", "b c", "n", "d"]).assign(y=rng.integers(0, 2, 40))


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(pd.concat([frame, frame[:5]])).repartition(2)


def test_values_equal_enumeration(spark, df, frame):
    names = ["a", "b c", "n", "d"]
    predict = lambda rows, name: rows.withColumn(name, F.col("a") * F.col("`b c`") + F.abs("n") - F.when(F.col("d") > 0, F.col("a")).otherwise(0.0))
    model = lambda x: x[0] * x[1] + abs(x[2]) - (x[0] if x[3] > 0 else 0)
    got = S.kernel_contributions(predict, df, names, spark.createDataFrame(frame[10:16]), explained=None).toPandas()
    scene = frame[10:16][names].to_numpy()
    assert len(got) == len(frame[names].drop_duplicates()) and got["n_rows"].sum() == 45
    for r in got.to_numpy()[:8]:
        x, n, base, phi = r[:4], r[4], r[5], r[6:]
        worth = lambda s: np.mean([model([x[f] if f in s else b[f] for f in range(4)]) for b in scene])  # noqa: B023, E731
        assert base == pytest.approx(worth(()), abs=1e-12) and n in (1, 2)
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (worth((*s, f)) - worth(s)) for k in range(4) for s in combinations(others, k))
            assert phi[f] == pytest.approx(want, abs=1e-9)


def test_sampled_coalitions_of_an_additive_model(spark):
    """Of a sum, values are exact whichever coalitions are drawn; they always add up."""
    rng = np.random.default_rng(3)
    names = [f"f{k}" for k in range(12)]
    pdf = pd.DataFrame(rng.normal(size=(20, 12)), columns=names)
    df = spark.createDataFrame(pdf)
    predict = lambda rows, name: rows.withColumn(name, sum((F.col(f) * k for k, f in enumerate(names)), F.lit(1.0)))
    got = S.kernel_contributions(predict, df, names, df, n_background=20, coalitions=60, explained=5).toPandas()
    assert len(got) == 5
    for k, f in enumerate(names):
        assert np.allclose(got[f"phi_{k}"], k * (got[f] - pdf[f].mean()), atol=1e-8)


def test_importance_of_a_calibrated_model(df):
    model = L.CalibratedModel("logistic", k=2).fit(df, "y", ["a", "n"])
    table = {r["feature"]: r["importance"] for r in S.kernel_importance(model.predict_proba, df, ["a", "n"], n_background=8, explained=10).collect()}
    assert set(table) == {"a", "n"} and all(v >= 0 for v in table.values())
    with pytest.raises(ValidationError):
        S.kernel_contributions(model.predict_proba, df.where("a > 99"), ["a", "n"])
