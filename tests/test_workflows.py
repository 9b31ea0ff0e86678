import json
import os
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from riskloom.errors import ConfigurationError, ValidationError
from riskloom.functions.basics import Roles, safe_divide, validate_binary_target
from riskloom.operators import cleaning as C, features as X, models as L, profiling as P, risk as K, scorecard as S, splits as D
from riskloom.plans import config, pipeline, report, runs
from riskloom.sources import tables as IO


@pytest.fixture(scope="module")
def risk_table(spark):
    rng = np.random.default_rng(1)
    n = 1200
    income, util = rng.lognormal(10, 0.5, n), rng.beta(2, 5, n)
    y = (rng.random(n) < 0.05 + 0.5 * util).astype(int)
    income[:60] = -999
    pdf = pd.DataFrame({"month": [f"2024-0{i % 3 + 1}" for i in range(n)], "income": income, "utilization": util, "segment": np.where(rng.random(n) < 0.5, "new", "repeat"), "target": y})
    df = spark.createDataFrame(pdf)
    return df.withColumn("k", F.monotonically_increasing_id()).withColumn("utilization", F.when(F.col("income") != -999, F.col("utilization"))).persist()


def test_profile(risk_table):
    out = P.profile_data(risk_table, ["income", "utilization", "segment"], "target", "month", [-999.0])
    dq = {r["feature"]: r for r in out["dq_table"].collect()}
    assert dq["utilization"]["n_missing"] == 60 and dq["income"]["n_special"] == 60 and dq["segment"]["n_unique"] == 2
    assert {r["item"]: r["value"] for r in out["overview"].collect()}["n_groups"] == "3"
    assert out["trends"].count() == 9 and P.wide(out["trends"], "missing_rate").count() == 3


def test_risk_and_monitor(risk_table):
    out = K.profile_risk(risk_table, "target", ["income", "utilization"], "month", special_values=[-999.0])
    first = out.trends["psi"].where("`group` = '2024-01'").collect()
    assert all(abs(r["psi"]) < 1e-9 for r in first)
    assert out.summary.count() == 2 and "## summary" in out.to_markdown()
    later = risk_table.withColumn("utilization", F.when(F.col("month") == "2024-03", F.col("utilization") + 0.35).otherwise(F.col("utilization")))
    m = K.Monitor(n_bins=5).monitor(later, "month", features=["utilization"], target="target", score="income")
    row = m.summary.first()
    assert row["status"] == "critical" and "critical" in K.alert_text(m.summary)
    assert m.trends["target"].count() == 3
    with pytest.raises(ValidationError):
        K.Monitor().monitor(risk_table)


def test_sentinel_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (-999.0,), (4.0,), (-999.0,)], "x double")
    p = C.Preprocessor("median", special_values=[-999.0]).fit(df)
    assert p.stats["x"]["median"] == 2.0
    assert [r["x"] for r in p.transform(df).collect()] == [1, 2, 2, 4, 2]


def test_weighted_median(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 100 + [(100.0, 50.0)] * 100, "x double, w double")
    assert C.Preprocessor().fit(df, columns=["x"], weight="w").stats["x"]["median"] == pytest.approx(100)


def test_fill(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, None, 2), (2, 3, None), (3, None, 4), (4, 5, None)], "k int, a int, b int")
    assert [r["a"] for r in C.clean_data(df, "forward", order=["k"]).orderBy("k").collect()] == [1, 1, 3, 3, 5]
    assert [r["b"] for r in C.clean_data(df, "backward", order=["k"]).orderBy("k").collect()] == [1, 2, 4, 4, None]
    many = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 97 == 5, F.col("id")).alias("v"))
    for back in (False, True):
        want = [r["v"] for r in C.fill_ordered(many, ["v"], ["k"], back, ranges=1).orderBy("k").collect()]
        assert [r["v"] for r in C.fill_ordered(many, ["v"], ["k"], back, ranges=9).orderBy("k").collect()] == want
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert C.clean_data(nan, fill=0.0).where("isnan(x)").count() == 1
    with pytest.raises(ValidationError):
        C.clean_data(df, "forward")


def test_splits(spark):
    df = spark.range(200).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    a, b = D.train_test_split(df, ["id"], 0.2)
    assert (a.count(), b.count(), a.join(b, "id").count()) == (160, 40, 0)
    a, b = D.stratified_split(df, "y", ["id"], 0.2)
    assert b.where("y = 1").count() == 10 and b.count() == 40
    assert sorted(r["count"] for r in D.kfold(df, 3, ["id"]).groupBy("fold").count().collect()) == [66, 67, 67]
    from riskloom.functions.quantiles import ranked

    assert [r["_k"] for r in ranked(df, ["id"], 200, 7).orderBy("id").collect()] == list(range(1, 201))
    within = D._within(df, "y", ["id"], 1, 5)
    assert sorted(r["_k"] for r in within.where("y = 1").collect()) == list(range(1, 51))
    folds = list(D.cv_splits(df, 3, "timeseries", date="id", key=["id"]))
    assert all(x.agg(F.max("id")).first()[0] < y.agg(F.min("id")).first()[0] for x, y in folds)
    label = df.withColumn("s", F.when(F.col("id") < 150, "Dev").when(F.col("id") < 190, "oot"))
    s = D.split_dev_oot(label, sample="s").validate("y")
    assert (s.dev.count(), s.oot.count(), s.dropped) == (150, 40, 10)
    s = D.split_dev_oot(df.withColumn("s", F.lit("1")).withColumn("s", F.when(F.col("id") > 99, "0").otherwise("1")), sample="s")
    assert s.dev.count() == 100
    with pytest.raises(ValidationError):
        D.time_series_split(df, "id", ["id"], 0.5, 200)


def test_features(spark):
    df = spark.createDataFrame([(2.0, 3.0), (-1.0, 0.0)], "a double, b double")
    out = X.polynomial(df, ["a", "b"]).collect()[0]
    assert (out["a^2"], out["a b"], out["b^2"]) == (4, 6, 9)
    assert X.log(df, ["a"]).collect()[1]["a_log"] == pytest.approx(-np.log(2))
    assert X.log(df, ["b"], "10", False).collect()[1]["b_log10"] is None
    rng = np.random.default_rng(2)
    f1 = rng.normal(size=400)
    pdf = pd.DataFrame({"f1": f1, "f2": rng.normal(size=400), "flat": rng.normal(size=400) * 0.01, "twin": f1 * 0.95, "target": (f1 > 0).astype(int)})
    wide = spark.createDataFrame(pdf)
    names = ["f1", "f2", "flat", "twin"]
    assert "flat" not in X.select_features(wide, "variance", columns=names)
    assert "twin" not in X.select_features(wide, "correlation", columns=names)
    for method in ("iv", "mutual_info", "rfe"):
        assert X.select_features(wide, method, "target", names, n=2)[0] in ("f1", "twin")
    assert X.remove_multicollinearity(wide, columns=names)[1] == ["twin"]
    assert X.FeatureSelector("iv", n=1).fit_transform(wide, target="target", columns=names).columns == ["f1"]


def test_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    p = 1 / (1 + np.exp(-(x @ [1.2, -0.8, 0.5])))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(y=(rng.random(600) < p).astype(int), raw=p**2.5, k=np.arange(600)))
    model = L.train_model(df, "y", ["f0", "f1", "f2"])
    assert L.evaluate(model, df, "y")["auc"] > 0.7
    before = L.brier(df, "y", "raw")
    for method in ("sigmoid", "isotonic"):
        assert L.brier(L.Calibrator(method).fit(df, "y", "raw").transform(df, "raw"), "y", "calibrated") < before
    cv = L.cross_validate(df, "y", ["f0", "f1"], k=2, key=["k"])
    assert cv.where("metric = 'auc'").first()["mean"] > 0.6
    importance = {r["feature"]: r["importance"] for r in L.permutation_importance(model, df, "y", 1).collect()}
    assert importance["f0"] > importance["f2"]
    assert L.tune(df, "y", ["f0"], grid={"C": [0.1, 1.0]}, k=2, key=["k"])[0]["C"] in (0.1, 1.0)
    with pytest.raises(ValidationError):
        L.ModelTrainer("none")


def test_scorecard(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["f0", "f1"]).assign(target=(x[:, 0] + rng.normal(size=1500) > 0).astype(int)))
    card = S.build_scorecard(df, "target", ["f0", "f1"])
    out = card.predict_proba(card.score(df)).toPandas()
    assert np.corrcoef(out["score"], out["p_bad"])[0, 1] < -0.9
    assert out.loc[out.target == 1, "score"].mean() < out.loc[out.target == 0, "score"].mean()
    assert card.factor == pytest.approx(20 / np.log(2)) and card.summary(df).count() == 2
    one = spark.createDataFrame([(0.5,), (1e-15,), (1.0,)], "p double").select(S.credit_score(F.col("p"))).collect()
    assert [r[0] for r in one] == [500.0, 900.0, 300.0]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"x1": x, "x2": rng.normal(size=n), "apply_month": [f"m{i % 3}" for i in range(n)], "bureau": x + rng.normal(size=n) * 0.1, "channel": np.where(rng.random(n) < 0.5, "a", "b"), "target": (x + rng.normal(size=n) > 0).astype(int), "sample": ["dev"] * 700 + ["oot"] * 200})
    pdf["bureau"] = 1 / (1 + np.exp(-pdf["bureau"]))
    folder = str(tmp_path_factory.mktemp("out"))
    roles = Roles(target="target", sample="sample", segment="channel", temporal="apply_month", benchmark="bureau")
    df = spark.createDataFrame(pdf)
    pipe = pipeline.AutoPipeline(roles).fit(df)
    pipe.save(folder)
    return pipe, df, folder


def test_roles_are_never_features(fitted):
    pipe, _, _ = fitted
    assert pipe.artifact.features == ["x1", "x2"]
    assert {"Segment_Summary", "Temporal_Stability", "Benchmark_Performance"} <= set(pipe.tables())


def test_learned_on_development_rows_only(spark):
    df = spark.createDataFrame([(float(i % 7), i % 2, "dev") for i in range(600)] + [(50.0 + i % 3, i % 2, "oot") for i in range(200)], "x double, target int, sample string")
    pipe = pipeline.AutoPipeline(Roles(target="target", sample="sample"), threshold=-1.0)
    pipe.fit(df)
    assert pipe.artifact.preprocessor.stats["x"]["max"] == 6.0


def test_artifact_and_gate(spark, fitted):
    pipe, df, folder = fitted
    again = pipeline.ScoringArtifact.load(spark, f"{folder}/scoring_artifact")
    a = again.score(df, points=True).select("probability").collect()
    assert a == pipe.predict(df).select("probability").collect()
    result = pipeline.validate_release(spark, folder, 0.6, 1.0)
    assert result["passed"], result
    assert not pipeline.validate_release(spark, folder, 0.999, 1.0)["passed"]
    assert {"Overview_Performance", "WOE_Detail"} <= set(IO.sheet_names(f"{folder}/Model_Report_1.xlsx"))
    assert IO.list_saved_models(spark, folder).first()["model_type"] == "logistic"


def test_regression_round_trip(spark):
    df = spark.createDataFrame([(float(i), float(np.expm1(0.1 * i)), "dev" if i < 30 else "oot") for i in range(40)], "x double, target double, sample string")
    pipe = pipeline.RegressionPipeline(Roles(target="target", sample="sample"), log_target=True, solver="normal").fit(df)
    got = pipe.predict(df).toPandas()
    assert np.allclose(got["prediction"], got["target"], rtol=1e-3, atol=1e-3)


def test_regression_release_passes_the_gate(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 1.5 + 0.2 * i, "dev" if i < 20 else "oot") for i in range(30)], "x double, target double, sample string")
    folder = str(tmp_path / "new" / "run")
    pipe = pipeline.RegressionPipeline(Roles(target="target", sample="sample"), solver="normal").fit(df)
    pipe.save(folder)
    assert {"Overview_Performance", "Artifact_Metadata", "OOT_Metrics", "Model_Estimation"} <= set(IO.sheet_names(pipe.save(f"file://{folder}").removeprefix("file://")))
    result = pipeline.validate_release(spark, folder)
    assert result["passed"] and "min_auc" not in result
    assert not pipeline.validate_release(spark, str(tmp_path / "none"))["passed"]
    again = pipeline.ScoringArtifact.load(spark, f"{folder}/scoring_artifact").score(df, "prediction").toPandas()
    assert np.allclose(again["prediction"], again["target"], atol=1e-6)


@pytest.mark.parametrize("sample", ["dev_holdout", "oot"])
def test_early_stopping_of_pipelines(spark, sample):
    """Rounds, metric and sample are honoured; the out-of-time sample is on the scale that is learned."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    pdf = pd.DataFrame({"x": x, "z": rng.normal(size=900), "amount": rng.lognormal(2 + 0.8 * x, 0.3), "sample": ["dev"] * 700 + ["oot"] * 200})
    how = {"early_stopping": sample, "early_stopping_rounds": 4, "n_estimators": 30, "max_depth": 2, "learning_rate": 0.5}
    pipe = pipeline.RegressionPipeline(Roles(target="amount", sample="sample"), "xgboost", log_target=True, early_stopping_metric="mae", **how).fit(spark.createDataFrame(pdf))
    model = pipe.artifact.model.model
    assert 0 < model.best_round and len(model.trees) == model.best_round + 1 <= len(model.history) <= 30 and min(model.history) == model.history[model.best_round] < 0.5
    if sample == "oot":
        got = pipe.artifact.score(pipe.split.oot, "p").toPandas()
        assert np.abs(np.log1p(got["p"]) - np.log1p(got["amount"])).mean() == pytest.approx(model.history[model.best_round], abs=1e-9)
    pdf["amount"] = (pdf["amount"] > 8).astype(int)
    auto = pipeline.AutoPipeline(Roles(target="amount", sample="sample"), "lightgbm", early_stopping_metric="auc", **(how | {"n_estimators": 4})).fit(spark.createDataFrame(pdf))
    assert len(auto.artifact.model.model.history) <= 4 and max(auto.artifact.model.model.history) > 0.8
    with pytest.raises(ValidationError):
        pipeline.AutoPipeline(Roles(target="amount", sample="sample"), early_stopping="train")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 1.5), (2, None, None)], "k int, s string, x double")
    for kind in ("csv", "parquet", "json", "orc"):
        path = str(tmp_path / f"t.{kind}")
        IO.save_dataframe(df, path)
        assert IO.load_data(spark, path).count() == 2
    IO.save_dataframe(df, str(tmp_path / "t.xlsx"))
    assert [r["s"] for r in IO.load_data(spark, str(tmp_path / "t.xlsx")).collect()] == ["a|b", None]
    (tmp_path / "n.csv").write_text("junk\na,b\n1,NA\n2,x\n")
    out = IO.load_csv(spark, str(tmp_path / "n.csv"), skip_rows=1, null_values=["NA"], columns=["b"], n_rows=2).collect()
    assert [r["b"] for r in out] == [None, "x"]
    pd.DataFrame({"a": [1]}).to_pickle(tmp_path / "p.pkl")
    assert IO.load_data(spark, str(tmp_path / "p.pkl")).first()["a"] == 1
    with pytest.raises(ConfigurationError):
        IO.load_data(spark, "x.unknown")
    assert "1.5000" in report.markdown(df) and "only the first 1 rows" in report.markdown(df, 1)


def finished(folder, name="out"):
    out = folder / name
    (out / "scoring_artifact").mkdir(parents=True)
    (out / "scoring_artifact" / "part").write_text("artifact")
    for k in (1, 2):
        (out / f"Model_Report_{k}.xlsx").write_text(str(k))
        os.utime(out / f"Model_Report_{k}.xlsx", (k, k))
    (out / "scratch.log").write_text("x")
    return out


def test_archive(tmp_path):
    out, to = finished(tmp_path), tmp_path / "runs"
    at = datetime(2026, 1, 1, 9)
    run = runs.archive_run(out, to, {"model_type": "logistic", "data": tmp_path, "call": object()}, {"auc": 0.7, "none": float("nan")}, ["a"], model_type="logistic", timestamp=at)
    assert sorted(p.name for p in run.iterdir()) == ["Model_Report_2.xlsx", "config.yaml", "run.json", "scoring_artifact"]
    noted = json.loads((run / "run.json").read_text(), parse_constant=lambda x: pytest.fail(x))
    assert noted["metrics"] == {"auc": 0.7, "none": None} and noted["config"]["data"] == str(tmp_path) and isinstance(noted["config"]["call"], str)
    assert run.name.startswith("20260101-090000-logistic-") and noted["created_at"] == "2026-01-01T09:00:00"
    again = runs.load_run(run)
    assert again.selected_features == ["a"] and again.artifact_path == run / "scoring_artifact" and again.headline() == {"auc": 0.7}
    assert len({runs.new_run_id("m", at) for _ in range(50)}) == 50 and runs.new_run_id("m", at, "s") == runs.new_run_id("m", at, "s")
    assert not set(runs.new_run_id("odd/name here")) & set("/ ")
    a, b = (runs.archive_run(out, to, metrics={"auc": v}, run_id="fixed") for v in (0.1, 0.9))
    assert a != b and (runs.load_run(a).metrics["auc"], runs.load_run(b).metrics["auc"]) == (0.1, 0.9)
    assert (out / "scratch.log").exists()
    with pytest.raises(FileNotFoundError):
        runs.archive_run(tmp_path / "none", to)
    with pytest.raises(FileNotFoundError):
        runs.load_run(tmp_path)


def test_list_and_resolve(tmp_path, monkeypatch):
    out, to = finished(tmp_path), tmp_path / "runs"
    made = [runs.archive_run(out, to, {"model_type": m, "output": m, "n": k}, {"auc": 0.7 + k / 10}, [m, "x"], model_type=m, timestamp=datetime(2026, 1, 1, 9 + k)) for k, m in enumerate(("logistic", "xgboost"))]
    (to / "stray").mkdir()
    (to / "broken").mkdir()
    (to / "broken" / "run.json").write_text("{not json")
    assert [r.model_type for r in runs.list_runs(to)] == ["xgboost", "logistic"] and runs.list_runs(tmp_path / "never") == []
    find = lambda x: runs.resolve_run(x, to).run_id
    assert find(made[0].name) == find(made[0].name[:13]) == find(str(made[0])) == find("latest~1") == made[0].name and find("latest") == made[1].name
    # a folder of that name here does not stand before the archive
    other = tmp_path / "here" / made[0].name
    other.mkdir(parents=True)
    (other / "run.json").write_text(json.dumps({"run_id": "other"}))
    monkeypatch.chdir(tmp_path / "here")
    assert find(made[0].name) == made[0].name
    with pytest.raises(ValueError, match="ambiguous"):
        find("20260101")
    for name in ("nope", "latest~9"):
        with pytest.raises(FileNotFoundError):
            find(name)
    diff = runs.compare_runs(*map(runs.load_run, made))
    assert diff["metrics"]["auc"]["delta"] == pytest.approx(0.1) and set(diff["config_changes"]) == {"model_type", "n"}
    assert diff["features"] == {"added": ["xgboost"], "removed": ["logistic"], "shared": 1}
    text = runs.format_comparison(diff)
    assert "+0.1000" in text and f"{made[0].name}  ->  {made[1].name}" in text
    assert "AUC" in runs.format_runs(runs.list_runs(to)) and "0.8000" in runs.format_runs(runs.list_runs(to)) and "No runs" in runs.format_runs([])


def test_configured_run(spark, tmp_path):
    pd.DataFrame({"x": range(40), "target": [i % 2 if i % 5 else 1 for i in range(40)], "sample": ["dev"] * 24 + ["oot"] * 16}).to_csv(tmp_path / "d.csv", index=False)
    (tmp_path / "c.yaml").write_text("data:\n  path: d.csv\nroles:\n  target_col: target\n  sample_col: sample\nmodel:\n  threshold: -1\noutput: out\nruns_dir: runs\n")
    pipe = config.run_configured(spark, str(tmp_path / "c.yaml"), {"n_bins": 3})
    assert pipe.binner.n_bins == 3
    assert json.loads(next((tmp_path / "runs").glob("*/run.json")).read_text())["metrics"]
    with pytest.raises(ConfigurationError):
        config.to_arguments({"data": "x", "target": "y", "nonsense": 1})


def test_command_line_options():
    a = config.parser().parse_args("fit -i d.csv -t y -o out --model xgboost --segment-column a --segment-column b --monotonic --smoothing 1 --convert-to-credit-score --pdo 40 --early-stopping-eval dev_holdout --early-stopping-rounds 5 --seed 7 --no-archive-run --dev-label train --weight-column w --n-features 3".split())
    given = {k: v for k, v in vars(a).items() if v is not None and k not in ("command", "config")}
    how = config.to_arguments(given)
    assert how["roles"].segment == ["a", "b"] and how["roles"].weight == "w" and given["archive"] is False
    assert how["binner"] == {"monotonic": True, "smoothing": 1.0} and how["credit"] == {"pdo": 40.0}
    assert (how["early_stopping_rounds"], how["seed"], how["max_features"], how["dev_label"], how["model_type"]) == (5, 7, 3, "train", "xgboost")
    regression = config.to_arguments({"data": "d", "target": "y", "task": "regression", "target_transform": "log1p", "n_bins": 4, "normalize": "zscore"})
    assert regression["log_target"] and regression["normalize"] == "zscore" and "n_bins" not in regression
    assert config.to_arguments({"data": "d", "target": "y", "weight": "w", "use_sample_weight": False})["roles"].weight is None


def test_pipeline_with_labels_scaling_and_credit_scores(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"x": x, "s1": np.where(x > 0, "p", "q"), "s2": ["u", "v"] * 200, "b1": 1 / (1 + np.exp(-x)), "y": (x + rng.normal(size=400) > 0).astype(int), "part": ["Train"] * 300 + ["hold"] * 100})
    roles = Roles(target="y", sample="part", segment=["s1", "s2"], benchmark=["b1"])
    pipe = pipeline.AutoPipeline(roles, normalize="zscore", dev_label="train", oot_label="hold", credit={"base": 600.0, "pdo": 40.0, "column": "points"}).fit(spark.createDataFrame(pdf))
    assert pipe.artifact.features == ["x"] and {r["by"] for r in pipe.tables()["Segment_Summary"].collect()} <= {"s1", "s2"}
    out = pipe.predict(spark.createDataFrame(pdf)).toPandas()
    want = np.clip(600 + 40 / np.log(2) * np.log((1 - out.probability) / out.probability), 300, 900)
    assert np.allclose(out.points, want)
    pipe.release()


def test_boosting_parameters():
    p = L.spark_params
    assert p("xgboost", {"n_estimators": 7, "eta": 0.2, "colsample_bytree": 0.5, "n_jobs": 4}) == {"maxIter": 7, "maxDepth": 6, "stepSize": 0.2, "featureSubsetStrategy": "0.5"}
    assert p("lightgbm", {"num_leaves": 31, "bagging_fraction": 0.8})["maxDepth"] == 5 and p("lightgbm", {"bagging_fraction": 0.8})["subsamplingRate"] == 0.8
    assert p("catboost", {"iterations": 5, "depth": 4, "rsm": 0.3})["maxIter"] == 5
    assert p("random_forest", {"n_estimators": 9, "max_features": None, "min_samples_split": 10}) == {"numTrees": 9, "featureSubsetStrategy": "all", "minInstancesPerNode": 5}
    assert p("logistic", {"penalty": "l1", "max_iter": 5, "solver": "lbfgs"}) == {"elasticNetParam": 1.0, "maxIter": 5}


def test_model_report_folder(spark, tmp_path):
    df = spark.createDataFrame([(float(k % 7), k % 2) for k in range(60)], "x double, y int")
    m = L.train_model(df, "y", ["x"])
    to = report.generate_model_report(m, {"auc": 0.6, "other": float("nan")}, m.importance(df), str(tmp_path))
    assert sorted(p.name for p in to.iterdir()) == ["feature_importance.csv", "metrics.json", "model", "summary.json"]
    assert json.loads((to / "summary.json").read_text()) == {"model_type": "logistic", "n_features": 1, "key_metrics": {"auc": 0.6}}
    assert json.loads((to / "metrics.json").read_text())["other"] is None and (to / "feature_importance.csv").read_text().startswith("feature,importance")
    assert "<rect" in open(report.importance_chart(m.importance(df), str(tmp_path / "i.svg"))).read()
    assert IO.list_saved_models(spark, str(tmp_path)).first()["model_type"] == "logistic"


def test_sheets_go_on(spark, tmp_path):
    df = spark.range(25).withColumn("s", F.concat(F.lit("x"), "id"))
    path = IO.write_xlsx({"t": df, "empty": df.limit(0)}, str(tmp_path / "t.xlsx"), most=11)
    assert IO.sheet_names(path) == ["t", "t_2", "t_3", "empty"]
    got = [r["s"] for k in (1, 2, 3) for r in IO.load_excel(spark, path, sheet_id=k).collect()]
    assert got == [f"x{k}" for k in range(25)] and IO.load_excel(spark, path, "empty").count() == 0


def test_clashing_columns(spark):
    names = ["_k", "_n", "_h", "_r", "_range", "_one", "_x", "_label", "s", "fold"]
    df = spark.range(120).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") / 120).alias("score"), *[(F.col("id") + k).alias(n) for k, n in enumerate(names)])
    same = lambda out: all(r[n] == r["id"] + k for r in out.collect() for k, n in enumerate(names))
    for parts in (D.train_test_split(df, ["id"]), D.train_test_split(df, ["id"], shuffle=False), D.stratified_split(df, "y", ["id"]), D.time_series_split(df, "id", ["id"]), next(D.cv_splits(df, 3, "stratified", "y", ["id"]))):
        assert all(p.columns == df.columns and same(p) for p in parts)
    gaps = df.withColumn("v", F.when(F.col("id") % 5 == 0, F.col("id")))
    assert same(C.fill_ordered(gaps, ["v"], ["id"], ranges=4))
    from riskloom.functions.quantiles import running

    out = running(df.withColumn("one", F.lit(1)), "id", {"total": "one"}, ranges=5, within=("y",))
    assert same(out) and {r["y"]: r["m"] for r in out.groupBy("y").agg(F.max("total").alias("m")).collect()} == {0: 80, 1: 40}
    assert same(L.Calibrator().fit(df, "y", "score").transform(df, "score"))
    model = L.train_model(df, "y", ["_x", "_label"])
    assert L.permutation_importance(model, df, "y", 1).count() == 2


def test_bisection(spark):
    from riskloom.functions.quantiles import bisect

    for n in (1, 2, 3, 7, 8, 100):
        bounds = [2.0 * k for k in range(n)]
        got = spark.range(-2, 2 * n + 2).select(F.col("id").cast("double").alias("x")).select("x", bisect(bounds, F.col("x")).alias("k")).collect()
        assert all(r["k"] == int(np.searchsorted(bounds, r["x"], side="right")) for r in got)
    assert spark.range(1).select(bisect([1.0], F.lit(None).cast("double")).alias("k")).first()["k"] == 0


def test_many_categories_are_a_failure(spark, monkeypatch):
    from riskloom.operators import binning as B

    monkeypatch.setattr(B, "MOST_CATEGORIES", 3)
    df = spark.range(60).select((F.col("id") % 10).cast("string").alias("c"), (F.col("id") % 3).cast("string").alias("few"), (F.col("id") % 2).alias("y"))
    b = B.WoeBinner().fit(df, features=["c", "few"], target="y")
    assert "more than 3" in b.failures["c"] and set(b.rules) == {"few"}


def test_saved_reports_and_scorecards(spark, risk_table, tmp_path):
    out = K.profile_risk(risk_table, "target", ["income"], special_values=[-999.0])
    assert "## summary" in open(out.save(str(tmp_path / "r.md"))).read() and IO.sheet_names(out.save(str(tmp_path / "r.xlsx"))) == ["summary", "detail"]
    card = S.build_scorecard(risk_table.where("utilization is not null"), "target", ["utilization"])
    assert len(open(card.save_scorecard(risk_table, str(tmp_path / "c.csv"))).readlines()) == 1 + card.table(risk_table).count()
    assert card.about(risk_table)["n_variables"] == 1
    tables = P.explore(risk_table.withColumn("part", F.when(F.col("month") == "2024-03", "oot").otherwise("dev")), "target", "part", ["income", "segment"], woe_detail=True)
    assert [n for n in tables if n[0].isdigit()] == ["1_Overview", "2_Missing_Rate", "3_Num_Dist_DEV", "4_Num_Dist_OOT", "5_Char_Dist_DEV", "6_Char_Dist_OOT", "7_IV_DEV", "8_IV_OOT", "9_PSI_Numeric", "10_PSI_Categorical"]
    assert tables["WOE_Detail"].count() > 2 and set(P.explore(risk_table, features=["income", "segment"])) == {"1_Overview", "2_Missing_Rate", "3_Num_Dist_DEV", "5_Char_Dist_DEV"}


def test_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_divide(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5]
    with pytest.raises(ValidationError):
        validate_binary_target(df, "a")


@pytest.mark.parametrize(("kind", "task"), [("tree", "classification"), ("random_forest", "classification"), ("gbt", "classification"), ("tree", "regression"), ("gbt", "regression"), ("random_forest", "regression")])
def test_tree_contributions_against_enumeration(spark, kind, task):
    from itertools import permutations

    from riskloom.operators import attribution

    rng = np.random.default_rng(31)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float) if task == "classification" else x[:, 0] * 2 + np.abs(x[:, 1])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y))
    params = {"tree": {"max_depth": 4}, "random_forest": {"n_estimators": 4, "max_depth": 3}, "gbt": {"n_estimators": 3, "max_depth": 3}}[kind]
    m = L.ModelTrainer(kind, task, **params).fit(df, "y", ["a", "b", "c"])
    trees = attribution.trees_of(m.fitted, task)
    got, base = attribution.contributions(x[:25], trees)
    # they add up to the model's output
    out = m.predict_proba(df, "out").toPandas()["out"].to_numpy()[:25]
    out = np.log(out / (1 - out)) if (kind, task) == ("gbt", "classification") else out
    assert np.allclose(base + got.sum(1), out, atol=1e-6)

    def expected(row, known):
        total = 0.0
        for scale, leaves in trees:
            for leaf in leaves:
                chance = 1.0
                for f, (low, high, share) in leaf.path.items():
                    chance *= (low < row[f] <= high) if f in known else share
                total += scale * leaf.value * chance
        return total

    for row, mine in zip(x[:5], got, strict=False):
        want = np.zeros(3)
        for order in permutations(range(3)):
            for k, f in enumerate(order):
                want[f] += (expected(row, order[: k + 1]) - expected(row, order[:k])) / 6
        assert np.allclose(mine, want)
    table = {r["feature"]: r["importance"] for r in m.shap_importance(df).collect()}
    assert table["a"] > 0 and np.allclose(m.contributions(df).toPandas().to_numpy()[:25], got)


def test_backward_fill_takes_one_step_a_row(spark):
    """Frames that end at the last row begin anew at each row: Spark's time was the square of a range's rows."""
    df = spark.range(4000).selectExpr("id", "if(id % 7 = 3, id, null) as v")
    plans = [C.fill_ordered(df, ["v"], ["id"], True, **how)._jdf.queryExecution().executedPlan().toString().lower() for how in ({}, {"by": ["v"]})]
    assert all("unboundedpreceding" in p and "unboundedfollowing" not in p for p in plans)
    got = [r["v"] for r in C.fill_ordered(df, ["v"], ["id"], True, ranges=5).orderBy("id").collect()]
    assert got == [next((j for j in range(k, 4000) if j % 7 == 3), None) for k in range(4000)]
    by = df.withColumn("g", F.col("id") % 2)
    assert [r["v"] for r in C.fill_ordered(by, ["v"], ["id"], True, by=["g"]).orderBy("id").limit(4).collect()] == [10, 3, 10, 3]


def test_importances_that_rounding_parts_are_ties(spark):
    """Sums of the same values in another order differ in their last digits."""
    first = spark.createDataFrame([("a", 208.4654152746972), ("twin", 208.4654152746998), ("b", 3.0), ("c", 900.0), ("d", None), ("e", None)], "feature string, importance double")
    second = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, importance double")
    got = {r["feature"]: (r["rank_a"], r["rank_b"], r["mean_rank"]) for r in X.rank_features(first, second).collect()}
    assert got == {"c": (1.0, None, 1.0), "a": (2.5, 2.0, 2.25), "twin": (2.5, None, 2.5), "b": (4.0, 1.0, 2.5), "d": (5.5, None, 5.5), "e": (5.5, None, 5.5)}


@pytest.mark.parametrize("kind", ["logistic", "xgboost", "tree"])
def test_permutations_in_passes_leave_no_shuffle_files(spark, monkeypatch, kind):
    """Passes bound the disk that ordered scores take; they give what one pass gives, and what Spark's own hashes and scores give."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(3000, 2)).round(2), columns=["a", "b"]).assign(c=[None if k % 9 == 0 else float(k % 5) for k in range(3000)])
    df = spark.createDataFrame(pdf.assign(y=(pdf["a"] + rng.normal(size=3000) > 0).astype(int)))
    params = {"xgboost": {"n_estimators": 3}, "tree": {"max_depth": 4}}.get(kind, {})
    m = L.train_model(df, "y", ["a", "b", "c"], kind, **params)
    files = lambda: {n for _, _, names in os.walk(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]) for n in names if n.startswith("shuffle_")}
    shares = df.select(F.struct(*[F.col(c).cast("double").alias(c) for c in "abc"]).alias("own"), "y").withColumn("h", F.xxhash64("own", "y")).withColumn("s", F.pmod("h", F.lit(16)))
    p = shares.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("h"))).select("own.*", "s", "y", "r", *[F.xxhash64("h", "r", F.lit(42 + k)).alias(f"p{k}") for k in range(2)]).toPandas()
    want = dict.fromkeys("abc", 0.0)
    auc = lambda t: L.evaluate(m, spark.createDataFrame(t[["a", "b", "c", "y"]], "a double, b double, c double, y int"), "y")["auc"]
    own = p.sort_values(["s", "r"], ignore_index=True)
    for k in range(2):
        other = p.sort_values(["s", f"p{k}"], ignore_index=True)
        for c in "abc":
            want[c] += (auc(p) - auc(own.assign(**{c: other[c]}))) / 2
    seen, mixed = [], L._mixed
    monkeypatch.setattr(L, "_mixed", lambda n, wanted, seed: seen.append(len(wanted)) or mixed(n, wanted, seed))
    for most in (1, 10**9):
        monkeypatch.setattr(L, "PASS_SCORES", most)
        before = files()
        got = {r["feature"]: r["importance"] for r in L.permutation_importance(m, df, "y", 2).collect()}
        assert got == pytest.approx(want, abs=1e-9) and not files() - before
    assert seen == [4, 3, 7]
