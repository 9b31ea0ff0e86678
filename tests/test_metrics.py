import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import metrics as M, stability as Y


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_exact_metrics(spark):
    row = M.confusion(frame(spark, y=[1, 0, 1, 1, 0, 1], p=[1, 0, 0, 1, 0, 1]), "y", "p").first()
    assert row["accuracy"] == pytest.approx(5 / 6)
    row = M.confusion(frame(spark, y=[1, 0, 1, 1, 0, 0], p=[1, 0, 0, 1, 1, 0]), "y", "p").first()
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3)


def test_one_class(spark):
    row = M.ks_auc(frame(spark, y=[1, 1, 1], s=[0.9, 0.8, 0.2], w=[1.0, 2.0, 1.0]), "y", "s", "w").first()
    assert (row["auc"], row["ks"]) == (0.5, 0.0)


def test_constant_and_perfect_scores(spark):
    assert M.ks_auc(frame(spark, y=[0, 0, 1, 1], s=[0.5] * 4), "y", "s").first()["ks"] == 0
    row = M.ks_auc(frame(spark, y=[0, 0, 1, 1], s=[0.1, 0.2, 0.8, 0.9]), "y", "s").first()
    assert (row["ks"], row["auc"], row["gini"]) == (1.0, 1.0, 1.0)


def test_ks_with_ties_against_the_definition(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 12, 400) / 12
    gaps = [abs((s[y == 1] >= t).mean() - (s[y == 0] >= t).mean()) for t in np.unique(s)]
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    row = M.ks_auc(frame(spark, y=y, s=s), "y", "s").first()
    assert row["ks"] == pytest.approx(max(gaps), abs=1e-9) and row["auc"] == pytest.approx(pairs, abs=1e-9)


def test_lift(spark):
    assert M.lift(frame(spark, y=[0, 1, 0, 1], s=[0.5] * 4), "y", "s").count() == 1
    rng = np.random.default_rng(2)
    df = frame(spark, y=rng.integers(0, 2, 1000), s=rng.random(1000))
    assert M.lift(df, "y", "s").count() == 10


def test_weighted_deciles(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=3000)
    y = (s > 0.3).astype(int)
    out = M.lift(frame(spark, y=y, s=s, w=np.where(y == 1, 1.0, 20.0)), "y", "s", weight="w").toPandas()
    share = out["count"] / out["count"].sum()
    assert share.max() - share.min() < 0.02


def test_regression(spark):
    y, p = np.array([1.0, 2, 3, 5]), np.array([1.0, 2, 4, 4])
    row = M.regression(frame(spark, y=y, p=p), "y", "p").first()
    assert row["rmse"] == pytest.approx(np.sqrt(0.5)) and row["mae"] == 0.5
    assert row["r2"] == pytest.approx(1 - 2 / ((y - y.mean()) ** 2).sum())


def test_psi(spark):
    rng = np.random.default_rng(4)
    a, b = frame(spark, x=rng.normal(size=4000)), frame(spark, x=rng.normal(3, 1, 4000))
    psi = lambda e, f: Y.psi_numeric(e, f, "x").agg(F.sum("psi")).first()[0]
    full = psi(a, b)
    assert full > 1 and psi(a, a) == pytest.approx(0)
    one_nan = a.unionByName(frame(spark, x=[float("nan")]))
    assert psi(one_nan, b) == pytest.approx(full, rel=0.02)
    with pytest.raises(ValidationError):
        Y.psi_numeric(frame(spark, x=[float("nan")] * 3), b, "x")


def test_empty_bins_are_there(spark):
    out = Y.psi_numeric(frame(spark, x=[1.0] * 90 + [2.0] * 10), frame(spark, x=[1.0] * 50), "x")
    assert out.count() == 10


def test_categorical_psi(spark):
    e, a = frame(spark, c=["a"] * 8 + ["b"] * 2), frame(spark, c=["a"] * 5 + ["c"] * 5)
    shares = {"a": (0.8, 0.5), "b": (0.2, 1e-4), "c": (1e-4, 0.5)}
    want = sum((y - x) * np.log(y / x) for x, y in shares.values())
    assert Y.psi_categorical(e, a, "c").first()["psi"] == pytest.approx(want)


def test_auc_by_ranges_is_the_auc(spark):
    """Ties, several groups, one class only, scores beyond the bounds and rows without a score."""
    from riskloom.operators import models as L

    rng = np.random.default_rng(4)
    score = np.round(rng.random(900), 2)
    rows = [(int(w), float(y), float(s)) for w, y, s in zip(rng.integers(0, 3, 900), rng.random(900) < score, score, strict=True)] + [(3, 1.0, 0.5), (1, 1.0, None)]
    df = spark.createDataFrame(rows, "which int, y double, score double").repartition(3)
    want = {r["which"]: r["auc"] for r in M.ks_auc(df, "y", "score", by=["which"]).collect()}
    for bounds in ([], [0.25, 0.5, 0.75], [0.1, 2.0]):
        got = {r["which"]: r["auc"] for r in L.auc_by_ranges(df, bounds).collect()}
        assert set(got) == {0, 1, 2, 3} and all(abs(got[w] - want[w]) < 1e-12 for w in want)
