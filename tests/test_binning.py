import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.errors import NotFittedError, ValidationError
from riskloom.functions.quantiles import exact_quantiles, running, weighted_quantiles
from riskloom.operators import binning as B


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-x))).astype(int)
    return spark.createDataFrame(pd.DataFrame({"x": x, "target": y, "w": np.where(y == 1, 1.0, 4.0)})).persist()


def test_iv_does_not_depend_on_the_unit_of_weights(sample):
    found = []
    for unit in (0.01, 1.0, 10000.0):
        df = sample.withColumn("w", F.col("w") * unit)
        found.append(B.WoeBinner(5).fit(df, features=["x"], target="target", weight="w").total_iv()["x"])
    assert max(found) - min(found) < 1e-9


def test_weighted_cuts_hold_equal_weight(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-2, 1, 800), rng.normal(2, 1, 800)])
    w = np.concatenate([np.full(800, 50.0), np.full(800, 1.0)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w}))
    cuts = B.quantile_cuts(df, ["x"], 5, weight="w")["x"]
    shares = np.bincount(np.searchsorted(cuts, x, side="right"), w) / w.sum()
    assert np.abs(shares - 0.2).max() < 0.02


def test_equal_weights_are_no_weights(sample):
    a = B.quantile_cuts(sample, ["x"], 5)["x"]
    b = B.quantile_cuts(sample.withColumn("w", F.lit(3.0)), ["x"], 5, weight="w")["x"]
    assert a == b


def test_exact_quantiles_of_large_tables_equal_the_small_way(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=4000), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    qs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    assert np.allclose(exact_quantiles(df, {"x": F.col("x")}, qs, small=50)["x"], np.quantile(x, qs), atol=1e-12)
    assert np.allclose(exact_quantiles(df, {"x": F.col("x")}, qs, small=50, bracketed=0)["x"], np.quantile(x, qs), atol=1e-12)


def test_running_sums_by_ranges(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.integers(0, 50, 500).astype(float), "k": np.arange(500), "w": rng.random(500)}))
    for down in (False, True):
        a = running(df, "x", {"c": "w"}, down, ("k",), 1).orderBy("k").toPandas()["c"]
        b = running(df, "x", {"c": "w"}, down, ("k",), 7).orderBy("k").toPandas()["c"]
        assert np.allclose(a, b)


def test_weighted_quantile_equals_interpolation(spark):
    rng = np.random.default_rng(5)
    x, w = rng.integers(0, 40, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w, "k": np.arange(300)}))
    order = np.lexsort((np.arange(300), w, x))
    p = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
    for ranges in (1, 5):
        got = weighted_quantiles(df, "x", "w", [0.0, 0.1, 0.5, 0.9, 1.0], ("k",), ranges)
        assert np.allclose(got, np.interp([0.0, 0.1, 0.5, 0.9, 1.0], p, x[order]))


def test_categories(spark):
    df = spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(zip(["A", "A", "A", "B", "B", "B", "C", "C", None, "RARE"], [0, 1, 0, 0, 1, 1, 1, 1, 0, 0], strict=True))], "category string, n int, target int")
    b = B.WoeBinner(min_samples_bin=2).fit(df, features=["category"], target="target")
    score = spark.createDataFrame([("A",), ("UNSEEN",), (None,), ("C",)], "category string")
    assert [r[0] for r in b.transform(score).select("category_bin").collect()] == [0, -2, -1, 2]


def test_missing_special_and_labels(spark):
    df = spark.createDataFrame([(float(i % 50), i % 2) for i in range(200)] + [(None, 1), (float("nan"), 0), (-999.0, 1), (-998.0, 1)], "x double, y int")
    b = B.WoeBinner(4, special_values=[-999.0], missing_values=[-998.0]).fit(df, features=["x"], target="y")
    got = {r["x_bin"] for r in b.transform(df.where("x is null or isnan(x) or x < 0")).collect()}
    assert got == {-1, -3}
    assert b.rules["x"].label(-3) == "Special_-999" and b.rules["x"].label(-1) == "Missing"
    assert b.rules["x"].label(0).startswith("00_(-inf, ")
    assert b.transform(df, return_type="woe").where("x_bin is null").count() == 0


def test_tree_cuts_do_not_depend_on_the_number_of_values(spark):
    rng = np.random.default_rng(21)
    x, z = np.round(rng.normal(size=3000) * 50) / 10, rng.exponential(size=3000).round(2)
    y = (rng.random(3000) < 1 / (1 + np.exp(-x + (z > 1.3)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "w": rng.integers(1, 4, 3000).astype(float), "y": y}))
    for weight in (None, "w"):
        want = B.tree_cuts(df, ["x", "z"], "y", 5, weight=weight, least=50)
        assert [len(v) for v in want.values()] == [4, 4]
        assert B.tree_cuts(df, ["x", "z"], "y", 5, weight=weight, least=50, grid=20) == want


def test_tree_cuts_find_a_step(spark):
    df = spark.createDataFrame([(float(i), int(i >= 100)) for i in range(200)], "x double, y int")
    assert B.tree_cuts(df, ["x"], "y", 2)["x"] == [99.5]
    assert B.tree_cuts(df, ["x"], "y", 5)["x"] == [99.5]


def test_best_first_cuts_against_brute_force():
    rng = np.random.default_rng(6)
    x, n = np.arange(30.0), np.ones(30)
    bad = (rng.random(30) < 0.5).astype(float)
    gini = lambda b, m: m - (b * b + (m - b) ** 2) / m
    gains = {k: gini(bad.sum(), 30) - gini(bad[:k].sum(), k) - gini(bad[k:].sum(), 30 - k) for k in range(3, 28)}
    best = max(gains, key=lambda k: (round(gains[k], 12), -k))
    assert B.best_first_cuts(x, n, n, bad, 2, 3) == [best - 0.5]


def test_monotonic_woe(spark):
    rng = np.random.default_rng(7)
    x = rng.random(2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": (rng.random(2000) < 0.2 + 0.3 * x).astype(int)}))
    woe = B.WoeBinner(10, monotonic=True).fit(df, features=["x"], target="y").rules["x"].woe
    v = [woe[k] for k in sorted(woe)]
    assert all(a <= b + 1e-12 for a, b in zip(v, v[1:], strict=False))


def test_pool_adjacent():
    assert B.pool_adjacent(np.array([1.0, 3, 2, 4])).tolist() == [1, 2.5, 2.5, 4]
    assert B.pool_adjacent(np.array([1.0, 3, 2, 4]), False).tolist() == [2.5, 2.5, 2.5, 2.5]


def test_failures_and_checks(spark):
    df = spark.createDataFrame([(1.0, None, 0), (1.0, None, 1)], "c double, e double, y int")
    b = B.WoeBinner().fit(df, features=["c", "e"], target="y")
    assert b.failures == {"c": "constant", "e": "no valid values"}
    with pytest.raises(ValidationError):
        B.WoeBinner(smoothing=-1)
    with pytest.raises(NotFittedError):
        B.WoeBinner().transform(df)
    with pytest.raises(ValidationError):
        B.WoeBinner().fit(df.withColumn("w", F.lit(0.0)), features=["c"], target="y", weight="w")


def test_one_class_target(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(50)], "x double, y int")
    b = B.WoeBinner(3).fit(df, features=["x"], target="y")
    assert b.rules["x"].woe == {} and "target" in b.failures


def test_rules_survive_json(sample):
    import json

    b = B.WoeBinner(4).fit(sample, features=["x"], target="target")
    again = B.WoeBinner.from_dict(json.loads(json.dumps(b.to_dict())))
    assert again.transform(sample, return_type="woe").select("x_bin").collect() == b.transform(sample, return_type="woe").select("x_bin").collect()


def test_exact_quantiles_by_brackets(spark):
    """Many columns at once: ties, constants, gaps, skew and no values at all."""
    from riskloom.functions.quantiles import exact_quantiles

    rng = np.random.default_rng(17)
    n = 30_000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": np.where(rng.random(n) < 0.9, np.nan, rng.lognormal(size=n)), "d": np.full(n, 7.0), "e": rng.pareto(0.5, n)})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")).withColumn("odd", F.when(F.col("b") == 0, float("inf")).otherwise(F.col("a")))
    qs = [0.0, 1e-5, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99999, 1.0]
    got = exact_quantiles(df, {c: F.col(c) for c in [*pdf.columns, "none", "odd"]}, qs)
    for c in pdf:
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), qs), rtol=1e-12), c
    assert got["none"] is None and np.allclose(got["odd"], np.quantile(pdf.a[pdf.b != 0], qs), rtol=1e-12)


def test_quantiles_by_digits_of_many_columns(spark):
    """Negative, tiny, huge and tied values, with and without weights, and a column without values."""
    from riskloom.functions import quantiles as Q

    rng = np.random.default_rng(23)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), "b": rng.integers(-2, 3, n) * 0.0 + rng.integers(-3, 3, n), "c": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)), "d": -rng.random(n), "w": rng.integers(1, 6, n) / 4})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")).repartition(5)
    qs, names = [0.0, 0.001, 0.3, 0.5, 0.501, 0.9, 1.0], ["a", "b", "c", "d", "none"]
    got = Q.exact_quantiles(df, {c: F.col(c) for c in names}, qs, small=10)
    for c in names[:4]:
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), qs), rtol=1e-12, atol=0), c
    assert got["none"] is None
    got = Q.weighted_quantiles_of(df, {c: F.col(c) for c in names}, F.col("w"), qs)
    for c in names[:4]:
        rows = pdf[pdf[c].notna()].sort_values([c, "w"])
        p = (rows.w.cumsum() - rows.w / 2) / rows.w.sum()
        assert np.allclose(got[c], np.interp(qs, p, rows[c]), rtol=1e-9, atol=0), c
    assert got["none"] is None
    even = Q.weighted_quantiles_of(df, {"a": F.col("a")}, F.lit(2.5), qs)["a"]
    assert np.allclose(even, np.quantile(pdf.a, qs), rtol=1e-12, atol=0)


def test_quantiles_take_few_scans(spark, monkeypatch):
    """Scans do not grow with columns, quantiles or rows."""
    from riskloom.functions import quantiles as Q

    scans, plain = [], Q._histograms
    monkeypatch.setattr(Q, "_histograms", lambda *a: scans.append(1) or plain(*a))
    df = spark.range(50_000).select(*[(F.rand(k) * 10.0**k).alias(f"x{k}") for k in range(12)])
    Q.exact_quantiles(df, {c: F.col(c) for c in df.columns}, [k / 20 for k in range(21)])
    assert len(scans) <= 4


def test_a_cut_at_a_whole_rank_is_that_value(spark):
    """0.6 of 5 is 3, not 3.0000000000000004, which would be above the value 0 and leave its row one bin too low."""
    assert B.inner(5) == [1 / 5, 2 / 5, 3 / 5, 4 / 5] and B.inner(1) == [0.5]
    df = spark.createDataFrame([(float(k - 3), k % 2) for k in range(6)], "x double, y int")
    b = B.WoeBinner(5).fit(df, features=["x"], target="y")
    assert b.rules["x"].cuts == [-2.0, -1.0, 0.0, 1.0]
    assert [r["x_bin"] for r in b.transform(df).orderBy("x").collect()] == [0, 1, 2, 3, 4, 4]
