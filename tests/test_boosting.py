"""Boosting against a single-machine brute force, early stopping, ordered statistics, saving."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import boosting as B, models as M
from riskloom.operators.attribution import contributions

NAMES = ["a", "b", "c", "odd name"]


@pytest.fixture(scope="module")
def frame():
    """Ties, few and many values, missing values that tell something, weights, an empty column's worth of nulls."""
    rng = np.random.default_rng(4)
    n = 700
    a, b = rng.normal(size=n), rng.integers(0, 6, n).astype(float)
    c = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    y = (a + 0.5 * b + np.where(np.isnan(c), 1.2, c) + rng.normal(size=n) > 2).astype(int)
    return pd.DataFrame({"a": a, "b": np.where(rng.random(n) < 0.1, np.nan, b), "c": c, "odd name": rng.integers(0, 2, n).astype(float), "y": y, "z": 3 * a + b + rng.normal(size=n), "w": rng.integers(1, 5, n) / 2, "t": rng.choice(["p", "q", "r", None], n), "_w": 1, "f0": "x"})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "a double, b double, c double, `odd name` double, y int, z double, w double, t string, _w int, f0 string").repartition(3).persist()


def grow(x, g, h, cuts, s):
    """One tree on one machine: (feature, cut, missing left, children) or a leaf's value; straight from the definition."""
    soft = lambda v: math.copysign(max(abs(v) - s.l1, 0), v)
    score = lambda r: soft(g[r].sum()) ** 2 / (h[r].sum() + s.l2) if len(r) and h[r].sum() + s.l2 > 0 else 0.0

    def sides(r, f, cut, missing):
        v = x[r, f]
        left = np.where(np.isnan(v), missing, v < cut)
        return r[left], r[~left]

    def all_splits(r):
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                for missing in (False, True):
                    if s.grow == "oblivious" and not missing or s.grow != "oblivious" and missing and not np.isnan(x[r, f]).any():
                        continue
                    yield f, cut, missing

    def best(nodes):
        found = None
        for f, cut, missing in all_splits(np.concatenate(nodes)):
            gain = 0.0
            for r in nodes:
                a, b = sides(r, f, cut, missing)
                if s.grow != "oblivious" and (min(len(a), len(b)) < s.min_rows or min(h[a].sum(), h[b].sum()) < s.min_hessian):
                    gain = -math.inf
                    break
                gain += score(a) + score(b) - score(r)
            if gain > -math.inf and (found is None or gain > found[0] + 1e-9 * abs(gain)):
                found = (gain, f, cut, missing)
        return found if found and found[0] > s.gain else None

    def leaf(r):
        return -s.rate * soft(g[r].sum()) / (h[r].sum() + s.l2) if h[r].sum() + s.l2 > 0 else 0.0

    root = {"rows": np.arange(len(x)), "depth": 0}
    leaves = [root]
    if s.grow == "oblivious":
        for _ in range(s.depth):
            one = best([v["rows"] for v in leaves])
            if one is None:
                break
            leaves = [{"rows": r} for v in leaves for r in sides(v["rows"], *one[1:])]
    else:
        while s.grow == "level" or len(leaves) < s.leaves:
            ready = [(v, best([v["rows"]])) for v in leaves if "done" not in v and (s.depth <= 0 or v["depth"] < s.depth)]
            ready = [(v, b) for v, b in ready if b]
            if not ready:
                break
            v, one = max(ready, key=lambda p: p[1][0])
            leaves = [u for u in leaves if u is not v] + [{"rows": r, "depth": v["depth"] + 1} for r in sides(v["rows"], *one[1:])]
    out = np.zeros(len(x))
    for v in leaves:
        out[v["rows"]] = leaf(v["rows"])
    return out, len(leaves)


def boosted(x, y, w, cuts, s):
    base = (w * y).sum() / w.sum()
    m = np.full(len(y), math.log(base / (1 - base)) if s.task == "classification" else base)
    sizes = []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = (w * (p - y), w * p * (1 - p)) if s.task == "classification" else (w * (m - y), w)
        step, n = grow(x, g, h, cuts, s)
        m = m + step
        sizes.append(n)
    return m, sizes


@pytest.mark.parametrize(
    ("kind", "task", "params"),
    [
        ("xgboost", "classification", {"n_estimators": 12, "max_depth": 3, "max_bin": 24, "gamma": 0.05}),
        ("xgboost", "regression", {"n_estimators": 3, "max_depth": 4, "max_bin": 16, "reg_alpha": 0.4, "reg_lambda": 2.0, "min_child_weight": 6}),
        ("lightgbm", "classification", {"n_estimators": 4, "num_leaves": 9, "max_bin": 20}),
        ("lightgbm", "regression", {"n_estimators": 2, "num_leaves": 12, "max_depth": 4, "max_bin": 16, "min_child_samples": 30}),
        ("catboost", "classification", {"iterations": 4, "depth": 3, "learning_rate": 0.2, "border_count": 16}),
        ("catboost", "regression", {"iterations": 2, "depth": 4, "learning_rate": 0.5, "border_count": 12}),
    ],
)
def test_boosting_equals_brute_force(df, frame, kind, task, params):
    target = "y" if task == "classification" else "z"
    model = M.ModelTrainer(kind, task, **params).fit(df, target, NAMES, "w")
    s = B.Settings.of(kind, task, params)
    columns = [F.col(f"`{c}`") for c in NAMES]
    where = B.cuts(df, columns, s.bins)
    for c, found in zip(NAMES, where, strict=True):
        v = np.sort(frame[c].dropna())
        assert found == sorted({v[max(0, math.ceil(k / s.bins * len(v)) - 1)] for k in range(1, s.bins)} - {v[0]})
    want, sizes = boosted(frame[NAMES].to_numpy(), frame[target].to_numpy(float), frame["w"].to_numpy(), where, s)
    got = model.predict_proba(df, "p").select(*columns, "w", target, "p").toPandas()
    margin = np.log(got["p"] / (1 - got["p"])) if task == "classification" else got["p"]
    order = lambda d: d.fillna(-99.0).sort_values([*NAMES, "w", target]).index
    assert np.allclose(margin[order(got[[*NAMES, "w", target]])], want[order(frame[[*NAMES, "w", target]])], atol=1e-9)
    assert [sum(f < 0 for f in t.feature) for t in model.model.trees] == sizes
    if kind == "lightgbm":
        assert max(sizes) == params["num_leaves"]


def test_cuts_do_not_depend_on_the_number_of_rows(df, monkeypatch):
    columns = [*[F.col(f"`{c}`") for c in NAMES], F.lit(None).cast("double"), F.lit(2.0)]
    small = B.cuts(df, columns, 17)
    monkeypatch.setattr(B, "SKETCHED", 10)
    assert B.cuts(df, columns, 17) == small and small[4:] == [[], []]


def test_missing_values_choose_their_side(df):
    model = M.ModelTrainer("xgboost", n_estimators=1, max_depth=1).fit(df.where("c is null or c < 0"), "y", ["c"])
    tree = model.model.trees[0]
    assert not tree.missing_left[0] and tree.value[2] > tree.value[1]


def test_margins_go_on_from_stored_ones(df, monkeypatch):
    whole = M.ModelTrainer("xgboost", n_estimators=7, max_depth=2).fit(df, "y", NAMES).model
    monkeypatch.setattr(B, "KEEP", 2)
    monkeypatch.setattr(B, "MANY_TASKS", 1)
    parts = M.ModelTrainer("xgboost", n_estimators=7, max_depth=2).fit(df.repartition(5), "y", NAMES).model
    assert [t.feature for t in whole.trees] == [t.feature for t in parts.trees] and [t.cut for t in whole.trees] == [t.cut for t in parts.trees]


@pytest.mark.parametrize("metric", ["logloss", "error", "auc"])
def test_early_stopping(df, frame, metric):
    """The history is the held rows' metric after each round; the best round's model stays."""
    held = F.pmod(F.xxhash64("a"), F.lit(3)) == 0
    model = M.ModelTrainer("xgboost", n_estimators=40, max_depth=2, learning_rate=0.6, early_stopping_rounds=4, eval_metric=metric).fit(df, "y", NAMES, "w", held=held)
    b = model.model
    sign = B.METRICS[metric]
    best = min(range(len(b.history)), key=lambda k: sign * b.history[k])
    assert b.best_round == best and len(b.trees) == best + 1 and len(b.history) in (best + 5, 40)
    got = model.predict_proba(df.where(held), "p").select("y", "w", "p").toPandas()
    y, w, p = (got[c].to_numpy(float) for c in ("y", "w", "p"))
    value = {"logloss": lambda: -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum(), "error": lambda: (w * ((p >= 0.5) != y)).sum() / w.sum(), "auc": lambda: M.metrics.ks_auc(model.predict_proba(df.where(held), "p"), "y", "p", weight="w").first()["auc"]}[metric]()
    assert value == pytest.approx(b.history[best], abs=1e-9)
    alone = M.ModelTrainer("xgboost", n_estimators=best + 1, max_depth=2, learning_rate=0.6).fit(df.where(~held), "y", NAMES, "w").model
    assert [t.feature for t in alone.trees[:1]] == [t.feature for t in b.trees[:1]]


def test_early_stopping_needs_held_rows(df):
    with pytest.raises(ValidationError):
        M.ModelTrainer("lightgbm", early_stopping_rounds=3).fit(df, "y", NAMES, held=F.lit(False))
    with pytest.raises(ValidationError):
        M.ModelTrainer("lightgbm", no_such=3).fit(df, "y", NAMES)


def test_ordered_statistics_do_not_see_their_own_row(df, frame):
    coder = B.OrderedStatistics(["t"])
    got = coder.fit(df, "y").select("a", "t").toPandas().set_index("a")["t"]
    hashed = df.select("a", F.xxhash64(F.lit(42), *[F.col(f"`{c}`") for c in df.columns]).alias("h")).toPandas()
    rows = frame.merge(hashed, on="a").sort_values("h")
    prior, total, n = frame["y"].mean(), {}, {}
    for r in rows.itertuples():
        k = r.t if isinstance(r.t, str) else ""
        assert got[r.a] == pytest.approx((total.get(k, 0) + prior) / (n.get(k, 0) + 1), abs=1e-12)
        total[k], n[k] = total.get(k, 0) + r.y, n.get(k, 0) + 1
    late = coder.transform(df.limit(3).withColumn("t", F.lit("new"))).select("t").distinct().collect()
    assert [r["t"] for r in late] == [pytest.approx(prior)]


def test_saved_models_score_alike(spark, df, tmp_path):
    model = M.ModelTrainer("catboost", iterations=3, depth=3, learning_rate=0.3).fit(df, "y", ["a", "t", "c"])
    model.save(str(tmp_path / "m"))
    again = M.ModelTrainer.load(spark, str(tmp_path / "m"))
    a, b = (sorted(r["p"] for r in m.predict_proba(df, "p").collect()) for m in (model, again))
    assert a == b and again.importance_values() == model.importance_values() and set(df.columns) < set(model.predict_proba(df, "p").columns)


def test_contributions_by_enumeration():
    """Over all orders of three features, with missing values."""
    tree = B.Tree()
    a, b = tree.split(0, 0, 1, 0.5, True, 1.0)
    c, d = tree.split(a, 1, 1, 2.0, False, 1.0)
    e, f = tree.split(b, 0, 2, 3.0, True, 1.0)
    for k, (value, cover) in enumerate([(0, 10), (0, 6), (0, 4), (1.0, 2), (-2.0, 4), (0.5, 3), (4.0, 1)]):
        tree.value[k], tree.cover[k] = value, cover

    def output(x, known, node=0):
        if tree.feature[node] < 0:
            return tree.value[node]
        kids = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            v = x[tree.feature[node]]
            return output(x, known, kids[0] if (tree.missing_left[node] if np.isnan(v) else v < tree.cut[node]) else kids[1])
        return sum(tree.cover[k] / tree.cover[node] * output(x, known, k) for k in kids)

    rows = np.array([[0.2, 1.0, 0.0], [np.nan, np.nan, 0.0], [0.5, 5.0, 1.0], [9.0, 2.0, np.nan]])
    got, base = contributions(rows, [(1.0, tree.leaves())])
    for x, mine in zip(rows, got, strict=True):
        for f in range(3):
            others = [g for g in range(3) if g != f]
            want = sum(math.factorial(k) * math.factorial(2 - k) / 6 * (output(x, {*s, f}) - output(x, set(s))) for k in range(3) for s in combinations(others, k))
            assert mine[f] == pytest.approx(want, abs=1e-12)
        assert base + mine.sum() == pytest.approx(output(x, {0, 1, 2}), abs=1e-12)


def test_alike_rows_are_stored_once(spark):
    """Rows of the same bins and label are one (three bins: 0, 1, and 2 with 3) with their weights and numbers; the rows of a split still count them all."""
    df = spark.range(600).selectExpr("cast(id % 4 as double) as x", "cast(id % 3 = 0 as double) as y")
    rows = B._Rows(df, [F.col("x")], F.col("y"), F.lit(1.0), F.lit(False), B.Settings(bins=4))
    try:
        assert rows.table.count() == 6 and rows.table.agg(F.sum("n"), F.sum("w")).first() == (600.0, 600.0)
        found, loss = rows.splits(B.Tree(), [0], [0], 0)
        assert found[0][0][9] == 600 and loss[1] == 600
    finally:
        rows.close()


def test_trees_of_one_split_a_level_are_read_by_levels():
    """One comparison a level for all rows; the leaves are those that the nodes' own splits lead to."""
    from riskloom.operators.boosting import Tree

    rng = np.random.default_rng(3)
    bins = rng.integers(0, 9, (500, 3)).astype(np.uint8)
    values = np.where(bins == 0, np.nan, bins.astype(float))
    for missing_left in (True, False):
        tree, frontier = Tree(), [0]
        for f, last in ((0, 4), (2, 3), (1, 6), (0, 2)):
            frontier = [c for v in frontier for c in tree.split(v, f, last, last + 1.0, missing_left, 1.0)]
            got = tree.place(bins, True)
            for row, leaf in zip(bins, got, strict=True):
                v = 0
                while tree.feature[v] >= 0:
                    b = row[tree.feature[v]]
                    v = tree.left[v] if b <= tree.bin[v] and (b or missing_left) else tree.right[v]
                assert v == leaf
            assert len(tree.levels()) > 1 and (got == tree.place(values, False)).all()
        tree.split(frontier[0], 1, 2, 3.0, missing_left, 1.0)
        assert not tree.levels()
