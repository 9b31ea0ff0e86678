"""Logistic models fitted together against a single-machine Newton search; folds, grids, elimination, calibrated folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import features as X, metrics, models as L, newton, splits as D

NAMES = ["a", "b", "wide one", "d"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 900
    x = rng.normal(size=(n, 4)) * [1, 1, 40_000, 0.01]
    z = 1.3 * x[:, 0] - x[:, 1] + x[:, 2] / 50_000
    pdf = pd.DataFrame(x, columns=NAMES).assign(y=(rng.random(n) < 1 / (1 + np.exp(-z))).astype(int), w=rng.integers(1, 4, n).astype(float), k=np.arange(n), fold=7)
    pdf.loc[::9, "a"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(3).persist()


def alone(x, y, w, c):
    x = np.column_stack([np.ones(len(x)), np.nan_to_num(x)])
    b, ridge = np.zeros(x.shape[1]), np.array([0.0] + [1 / c] * (x.shape[1] - 1))
    loss = lambda b: (w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + (ridge * b * b).sum() / 2
    for _ in range(200):
        q = 1 / (1 + np.exp(-(x @ b)))
        step = np.linalg.lstsq((x * (w * q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (q - y)) + ridge * b, rcond=None)[0]
        while loss(b - step) > loss(b) + 1e-12:
            step = step / 2
        b = b - step
    return b


@pytest.mark.parametrize("many", [256, 1])
def test_models_fitted_together(df, frame, monkeypatch, many):
    monkeypatch.setattr(newton, "MANY_TASKS", many)
    wanted = [newton.Wanted(c, f, folds) for c, f, folds in ((1.0, [0, 1, 2, 3], None), (0.01, [0, 1], frozenset({0, 2})), (50.0, [2], frozenset({1})), (1.0, [], None))]
    rows = newton.table(df, F.col("y"), F.col("w"), [F.col(f"`{c}`") for c in NAMES], F.col("k") % 3)
    got = newton.fit(rows, 4, wanted)
    for s, b in zip(wanted, got, strict=True):
        part = frame if s.folds is None else frame[frame.k.mod(3).isin(s.folds)]
        want = alone(part[[NAMES[k] for k in s.features]].to_numpy(), part.y.to_numpy(), part.w.to_numpy(), s.c)
        assert np.allclose(b, want, rtol=1e-6, atol=1e-9)


def test_cross_validation_and_grids(df, frame, monkeypatch):
    """As fold by fold; the number of scans does not depend on folds and strengths."""
    scans, plain = [], newton._sums
    monkeypatch.setattr(newton, "_sums", lambda *a: scans.append(1) or plain(*a))
    got = {r["metric"]: r for r in L.cross_validate(df, "y", NAMES, k=4, key=["k"], C=2.0).collect()}
    few = len(scans)
    folded, splits = D.cv_folds(df, 4, "stratified", "y", ["k"], name="part")
    found = []
    rows = folded.toPandas()
    for train, test in splits:
        a, b = rows[rows.part.isin(train)], rows[rows.part == test]
        beta = alone(a[NAMES].to_numpy(), a.y.to_numpy(), np.ones(len(a)), 2.0)
        p = 1 / (1 + np.exp(-(beta[0] + np.nan_to_num(b[NAMES].to_numpy()) @ beta[1:])))
        found.append(metrics.all_metrics(df.sparkSession.createDataFrame(pd.DataFrame({"y": b.y, "p": p})), "y", "p").first().asDict())
    for m in ("auc", "accuracy", "ks"):
        v = [f[m] for f in found]
        assert got[m]["mean"] == pytest.approx(np.mean(v), abs=1e-9) and got[m]["std"] == pytest.approx(np.std(v), abs=1e-9)
    scans.clear()
    table = L.search(df, "y", NAMES, grid={"C": [0.001, 0.1, 2.0, 30.0]}, k=4, key=["k"])
    assert len(scans) <= few + 4 and sorted(r["rank"] for r in table) == [1, 2, 3, 4]
    assert next(r for r in table if r["params"] == {"C": 2.0})["mean"] == pytest.approx(got["auc"]["mean"], abs=1e-9)
    best, value = L.tune(df, "y", NAMES, grid={"C": [0.001, 0.1, 2.0, 30.0]}, k=4, key=["k"])
    assert value == max(r["mean"] for r in table) and best in [r["params"] for r in table if r["mean"] == value]


def test_candidates_from_distributions():
    class Dice:
        def rvs(self, random_state=None):
            return np.random.default_rng(random_state).integers(1, 7)

    found = L.candidates("xgboost", {"max_depth": Dice(), "learning_rate": (0.01, 0.3), "n_estimators": (5, 9), "gamma": [0, 1]}, 20, 3)
    assert len(found) == 20 and found == L.candidates("xgboost", {"max_depth": Dice(), "learning_rate": (0.01, 0.3), "n_estimators": (5, 9), "gamma": [0, 1]}, 20, 3)
    assert all(1 <= p["max_depth"] <= 6 and 0.01 <= p["learning_rate"] <= 0.3 and 5 <= p["n_estimators"] <= 9 and p["gamma"] in (0, 1) for p in found)
    assert len(L.candidates("logistic", None, None, 1)) == 4


def test_elimination(df, frame):
    left = list(NAMES)
    while len(left) > 1:
        b = alone(frame[left].to_numpy(), frame.y.to_numpy(), np.ones(len(frame)), 1.0)
        left.pop(min(range(len(left)), key=lambda k: (abs(b[k + 1]), left[k])))
        assert X.recursive_elimination(df, "y", NAMES, len(left)) == left


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrated_folds(spark, df, tmp_path, method):
    """The mean of its parts; saved and loaded."""
    model = L.CalibratedModel("logistic", method, 3).fit(df, "y", NAMES, ["k"])
    total = 0
    for part, calibrator in model.parts:
        total = total + calibrator.transform(part.predict_proba(df, "r"), "r", "c").orderBy("k").toPandas()["c"].to_numpy()
    got = model.predict_proba(df, "p")
    assert got.columns == [*df.columns, "p"]
    p = got.orderBy("k").toPandas()
    assert np.allclose(p["p"], total / 3, atol=1e-12) and L.brier(got, "y", "p") < 0.22
    model.save(str(tmp_path / "m"))
    again = L.CalibratedModel.load(spark, str(tmp_path / "m")).predict_proba(df, "p").orderBy("k").toPandas()
    assert np.allclose(again["p"], p["p"], atol=1e-12)


def test_alike_rows_are_one(spark):
    df = spark.range(600).selectExpr("cast(id % 4 as double) as x", "id % 3 = 0 as y")
    rows = newton.table(df, F.col("y"), F.lit(2.0), [F.col("x")])
    assert rows.count() == 8 and rows.agg(F.sum("w")).first()[0] == 1200.0


def test_calibrated_folds_read_alike_rows_once(spark, monkeypatch):
    """Each fit reads rows that are alike as one, and means what it meant with all of them."""
    df = spark.range(4000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.hash("id") % 3 + F.col("id") % 7 > 3).cast("int").alias("y"))
    seen, fit = [], L.ModelTrainer.fit
    monkeypatch.setattr(L.ModelTrainer, "fit", lambda self, rows, *a, **k: seen.append(rows.count()) or fit(self, rows, *a, **k))
    model = L.CalibratedModel("logistic", k=2).fit(df, "y", ["a"], ["id"])
    assert len(seen) == 4 and max(seen) <= 2 * 7
    folded, splits = L.cv_folds(df, 2, "stratified", "y", ["id"])
    for (trainer, calibrator), (train, test) in zip(model.parts, splits, strict=True):
        whole = L.ModelTrainer("logistic").fit(folded.where(F.col("fold").isin(sorted(train))).drop("fold"), "y", ["a"])
        assert trainer.fitted.intercept == pytest.approx(whole.fitted.intercept, rel=1e-6)
        assert list(trainer.fitted.coefficients) == pytest.approx(list(whole.fitted.coefficients), rel=1e-6)
        held = whole.predict_proba(folded.where(F.col("fold") == test), "p")
        by_rows = L.Calibrator().fit(held, "y", "p").model.fitted
        assert list(calibrator.model.fitted.coefficients) == pytest.approx(list(by_rows.coefficients), rel=1e-4)
        counted = held.groupBy("y", "p").agg(F.count(F.lit(1)).alias("w"))
        a, b = (sorted(c.transform(held.select("p").distinct(), "p").select("p", "calibrated").collect()) for c in (L.Calibrator("isotonic").fit(held, "y", "p"), L.Calibrator("isotonic").fit(counted, "y", "p", "w")))
        assert [r[1] for r in a] == pytest.approx([r[1] for r in b])


def test_logistic_fits_read_alike_rows_once(spark, monkeypatch):
    """Spark's steps go over rows that are alike as one."""
    df = spark.range(4000).select((F.col("id") % 7).cast("double").alias("a"), (F.hash("id") % 3 + F.col("id") % 7 > 3).cast("int").alias("y"), (F.col("id") % 2 + 1).alias("w"))
    seen, fit = [], L.LogisticRegression.fit
    monkeypatch.setattr(L.LogisticRegression, "fit", lambda self, rows: seen.append(rows.agg(F.count(F.lit(1)), F.sum("_weight")).first()) or fit(self, rows))
    L.ModelTrainer("logistic").fit(df, "y", ["a"], "w")
    assert seen[0][0] <= 2 * 7 and seen[0][1] == 6000


def test_forest_rows_are_dealt(spark, monkeypatch):
    """No task of Spark's trees has more rows than TASK_BYTES holds; the small table's partitions stay."""
    df = spark.range(0, 4000, 1, 1).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 97 > 40).cast("int").alias("y"))
    seen, fit = [], L.RandomForestClassifier.fit
    monkeypatch.setattr(L.RandomForestClassifier, "fit", lambda self, rows: seen.append(rows.rdd.glom().map(len).collect()) or fit(self, rows))
    L.ModelTrainer("random_forest", n_estimators=3).fit(df, "y", ["a"])
    monkeypatch.setattr(L, "TASK_BYTES", 1000 * (L.ROW_BYTES + 4 * (1 + 3)))
    L.ModelTrainer("random_forest", n_estimators=3).fit(df, "y", ["a"])
    assert seen[0] == [4000] and len(seen[1]) == 4 and sum(seen[1]) == 4000 and max(seen[1]) <= 1001
