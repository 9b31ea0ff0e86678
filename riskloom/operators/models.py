"""Models over columns: training, tuning, calibration, cross-validation and importances.

``xgboost``, ``lightgbm`` and ``catboost`` are boosted by gradients and hessians (boosting.py), each
with its library's way to grow trees, parameter names and defaults; missing values go to the side
that gains more. ``gbt`` is Spark's own; there and elsewhere missing values count as 0.
A logistic model's strength C is 1 / (regParam * sum of weights).
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, IsotonicRegressionModel, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StringType

from ..errors import NotFittedError, ValidationError
from ..functions.basics import check_weights, col, fresh, require, validate_binary_target
from ..functions.quantiles import _together as together, ranges_for
from ..sources.shared import shared_path, shuffles_given_back
from . import boosting, metrics, newton
from .attribution import in_batches, trees_of
from .splits import cv_folds, cv_splits, hashed

LINEAR = ("logistic", "linear", "linear_regression")
BOOSTERS = ("xgboost", "lightgbm", "catboost", "gbt")
SECOND_ORDER = BOOSTERS[:3]
#: Rounds without gain after which training stops where it is to stop early and none are given.
PATIENCE = 10
CLASSIFIERS = {"logistic": LogisticRegression, "tree": DecisionTreeClassifier, "random_forest": RandomForestClassifier} | dict.fromkeys(BOOSTERS, GBTClassifier)
REGRESSORS = {"linear": LinearRegression, "linear_regression": LinearRegression, "tree": DecisionTreeRegressor, "random_forest": RandomForestRegressor} | dict.fromkeys(BOOSTERS, GBTRegressor)
#: Rows of one share within which permuted values change places.
SHARE_ROWS = 100_000
#: Scores that permutation importance orders at once, and at least so many of each row.
PASS_SCORES, PASS_LEAST = 100_000_000, 4
#: What a task of Spark's trees may read of the rows kept for it, and a row's size there without bins and trees.
TASK_BYTES, ROW_BYTES = 128 << 20, 160
#: Grids that are searched where none is given.
_BOOST_GRID = {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.2]}
GRIDS = {
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0]},
    "linear": {"regParam": [0.0, 0.1]},
    "linear_regression": {"regParam": [0.0, 0.1]},
    "tree": {"max_depth": [3, 5, 7, 10], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 5, 10]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15], "min_samples_split": [2, 5, 10]},
} | dict.fromkeys(BOOSTERS, _BOOST_GRID)
#: What the libraries of these names take where nothing is said (31 leaves are 5 levels).
DEFAULTS = {
    "xgboost": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
    "lightgbm": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 20},
    "catboost": {"maxIter": 1000, "maxDepth": 6, "stepSize": 0.03},
    "random_forest": {"numTrees": 100},
}
#: Names of parameters in those libraries, and Spark's.
_TREES = {"max_depth": "maxDepth", "depth": "maxDepth", "random_state": "seed", "random_seed": "seed", "min_samples_leaf": "minInstancesPerNode", "min_child_samples": "minInstancesPerNode", "min_data_in_leaf": "minInstancesPerNode", "min_impurity_decrease": "minInfoGain", "min_split_gain": "minInfoGain", "gamma": "minInfoGain", "max_bin": "maxBins", "border_count": "maxBins"}
_ROUNDS = dict.fromkeys(("n_estimators", "iterations", "num_iterations", "num_boost_round", "num_trees"), "maxIter") | dict.fromkeys(("learning_rate", "eta"), "stepSize")
_SHARES = {"subsample": "subsamplingRate", "bagging_fraction": "subsamplingRate", "max_samples": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy", "feature_fraction": "featureSubsetStrategy", "rsm": "featureSubsetStrategy", "max_features": "featureSubsetStrategy"}
_LINES = {"max_iter": "maxIter", "random_state": "seed", "fit_intercept": "fitIntercept", "l1_ratio": "elasticNetParam"}
#: Settings of those libraries about threads, messages and methods, which Spark has no use for.
UNUSED = {"n_jobs", "verbose", "verbosity", "silent", "eval_metric", "use_label_encoder", "tree_method", "objective", "solver", "device", "thread_count", "logging_level", "allow_writing_files", "importance_type", "booster"}


def spark_params(model_type: str, params: dict) -> dict:
    """Parameters under the names of scikit-learn, XGBoost, LightGBM, CatBoost or Spark -> Spark's, with the library's defaults."""
    lines = model_type in ("logistic", "linear", "linear_regression")
    names = _LINES if lines else _TREES | _ROUNDS | _SHARES
    out = dict(DEFAULTS.get(model_type, {}))
    for k, v in params.items():
        if k in UNUSED:
            continue
        if k == "penalty":
            out["elasticNetParam"] = {"l1": 1.0, "l2": 0.0}.get(v, out.get("elasticNetParam", 0.5))
            if v in (None, "none"):
                out["regParam"] = 0.0
        elif k == "num_leaves":
            out["maxDepth"] = max(1, math.ceil(math.log2(v)))
        elif k == "min_samples_split":  # the nearest that Spark has: half of it in each leaf
            out["minInstancesPerNode"] = max(out.get("minInstancesPerNode", 1), -(-int(v) // 2))
        elif names.get(k) == "featureSubsetStrategy":
            out["featureSubsetStrategy"] = "all" if v is None else str(v)
        else:
            out[names.get(k, k)] = v
    if model_type == "random_forest" and "maxIter" in out:
        out["numTrees"] = out.pop("maxIter")
    return out


class ModelTrainer:
    """early_stopping_rounds: training ends that many rounds after the best on held rows (fit's ``held``, or a fifth by hash)."""

    def __init__(self, model_type: str = "logistic", task: str = "classification", early_stopping: bool = False, early_stopping_rounds: int | None = None, **params):
        known = CLASSIFIERS if task == "classification" else REGRESSORS
        if model_type not in known:
            raise ValidationError(f"no such {task} model: {model_type}")
        self.model_type, self.task, self.params = model_type, task, params
        self.stop = (int(early_stopping_rounds) if early_stopping_rounds else PATIENCE if early_stopping else None) if model_type in BOOSTERS else None
        self.model: PipelineModel | boosting.Boosted | None = None
        self.encoder: boosting.OrderedStatistics | None = None

    def _estimator(self, total_weight: float, validation: str | None):
        params = spark_params(self.model_type, self.params)
        kind = (CLASSIFIERS if self.task == "classification" else REGRESSORS)[self.model_type]
        if self.model_type == "logistic":
            c = params.pop("C", 1.0)
            params = {"regParam": 1 / (c * total_weight), "elasticNetParam": 0.0, "standardization": False, "maxIter": 200, "tol": 1e-9} | params
            params.pop("seed", None)
        elif self.model_type in ("linear", "linear_regression"):
            params.pop("seed", None)
        else:
            params.setdefault("seed", 42)
        if validation:
            params["validationIndicatorCol"] = validation
        unknown = [k for k in params if not kind().hasParam(k)]
        if unknown:
            raise ValidationError(f"{self.model_type} has no such parameters: {unknown}")
        return kind(featuresCol="_features", labelCol="_label", weightCol="_weight", **params)

    def _value(self, f: str) -> Column:
        x = col(f).cast("double")
        return x if self.model_type in SECOND_ORDER else F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))

    def _inputs(self) -> dict:
        """The features as numbers under names of their own, so that they cannot clash with those of the model."""
        return {f"_f{k}": self._value(f).alias(f"_f{k}") for k, f in enumerate(self.features)}

    def fit(self, df: DataFrame, target: str, features: list[str], weight: str | None = None, key: list[str] | None = None, held: Column | None = None) -> ModelTrainer:
        """held: rows that only decide when boosting stops."""
        require(df, target, weight, *features)
        check_weights(df, weight)
        if self.task == "classification":
            validate_binary_target(df, target)
        self.features = list(features)
        w = col(weight).cast("double") if weight else F.lit(1.0)
        if self.stop and held is None:
            held = F.pmod(hashed(key or features, 42), F.lit(5)) == 0
        if self.model_type in SECOND_ORDER:
            return self._fit_boosted(df, target, w, key, held)
        rows = df.select(col(target).cast("double").alias("_label"), w.alias("_weight"), *self._inputs().values(), *([held.alias("_validation")] if self.stop else []))
        assembler = VectorAssembler(inputCols=list(self._inputs()), outputCol="_features")
        if self.model_type == "logistic":  # each of some hundred steps reads all rows
            rows = alike(rows, "_weight")
        sums = rows.agg(F.sum("_weight"), F.count(F.lit(1))).first()
        total = sums[0] or 1.0
        if self.model_type not in LINEAR:
            rows = self._dealt(rows, sums[1])
        fitted = self._estimator(total, "_validation" if self.stop else None).fit(assembler.transform(rows))
        self.model = PipelineModel(stages=[assembler, fitted])
        return self

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """The rows in enough partitions: Spark keeps a row with its bins and a number for each tree, and a task reads a partition of these."""
        trees = int(spark_params(self.model_type, self.params).get("numTrees", 20)) if self.model_type == "random_forest" else 1
        parts = -(-n * (ROW_BYTES + 4 * (len(self.features) + trees)) // TASK_BYTES)
        return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows

    def _fit_boosted(self, df: DataFrame, target: str, w: Column, key: list[str] | None, held: Column | None) -> ModelTrainer:
        settings = boosting.Settings.of(self.model_type, self.task, self.params | ({"early_stopping_rounds": self.stop} if self.stop else {}), UNUSED)
        held = held if settings.stop else None
        names = {n: fresh(df.columns, n) for n in ("_w", "_held")}
        rows = df.withColumns({names["_w"]: w, names["_held"]: F.lit(False) if held is None else held})
        text = [f for f in self.features if isinstance(df.schema[f].dataType, StringType)]
        if self.model_type == "catboost" and text:
            self.encoder = boosting.OrderedStatistics(text, settings.seed)
            rows = self.encoder.fit(rows, target, list(key or ()), F.col(names["_held"]))
            rows = _stored(rows.select(*map(col, dict.fromkeys([target, *self.features, *names.values()]))))  # running means are read several times
        self.model = boosting.fit(rows, [self._value(f) for f in self.features], self.features, col(target), F.col(names["_w"]), settings, F.col(names["_held"]))
        return self

    @property
    def fitted(self):
        if self.model is None:
            raise NotFittedError("the model is not fitted")
        return self.model if self.model_type in SECOND_ORDER else self.model.stages[-1]

    def encoded(self, df: DataFrame) -> DataFrame:
        """The features as the trees see them, string ones as numbers."""
        rows = df.select(*map(col, self.features))
        return self.encoder.transform(rows) if self.encoder else rows

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Adds the probability of class 1 (a logistic one as a plain projection) or the predicted number."""
        m = self.fitted
        if self.model_type in LINEAR:
            z = F.lit(float(m.intercept))
            for f, b in zip(self.features, m.coefficients, strict=True):
                z = z + F.lit(float(b)) * self._value(f)
            return df.withColumn(name, 1 / (1 + F.exp(-z)) if self.model_type == "logistic" else z)
        if self.encoder:
            packed = df.select(F.struct("*").alias("_row"), *[col(f).alias(f"_f{k}") for k, f in enumerate(self.features)])
            place = {f: f"_f{k}" for k, f in enumerate(self.features)}
            coded = self.encoder.transform(packed, place)
            return coded.select("_row.*", m.output([F.col(place[f]).cast("double") for f in self.features]).alias(name))
        if self.model_type in SECOND_ORDER:
            return df.withColumn(name, m.output([self._value(f) for f in self.features]))
        packed = df.select(F.struct("*").alias("_row"), *self._inputs().values())
        out = self.model.transform(packed)
        value = vector_to_array(F.col("probability"))[1] if self.task == "classification" else F.col("prediction")
        return out.select("_row.*", value.alias(name))

    def scorer(self):
        """predict_proba for the features' values as arrays, in tasks; None for the models that Spark itself applies."""
        m, kind, task = self.fitted, self.model_type, self.task
        if kind in LINEAR:
            base, weights = float(m.intercept), [float(b) for b in m.coefficients]

            def linear(x: list[np.ndarray]) -> np.ndarray:
                z = np.full(len(x[0]), base)
                for v, b in zip(x, weights, strict=True):
                    z = z + b * np.where(np.isnan(v), 0.0, v)
                with np.errstate(over="ignore"):
                    return 1 / (1 + np.exp(-z)) if kind == "logistic" else z

            return linear
        if kind in SECOND_ORDER and not self.encoder:
            return lambda x: boosting._chance(m.margin(np.column_stack(x))) if task == "classification" else m.margin(np.column_stack(x))
        return None

    def predict(self, df: DataFrame, threshold: float = 0.5, name: str = "prediction") -> DataFrame:
        if self.task != "classification":
            return self.predict_proba(df, name)
        p = fresh([*df.columns, name], "_p")
        return self.predict_proba(df, p).withColumn(name, (F.col(p) >= threshold).cast("int")).drop(p)

    def importance_values(self) -> dict[str, float]:
        m = self.fitted
        if self.model_type in SECOND_ORDER:
            return dict(zip(self.features, m.importance(), strict=True))
        values = [abs(float(v)) for v in m.coefficients] if self.model_type in LINEAR else [float(v) for v in m.featureImportances.toArray()]
        return dict(zip(self.features, values, strict=True))

    def importance(self, df: DataFrame) -> DataFrame:
        """feature, importance."""
        return df.sparkSession.createDataFrame(list(self.importance_values().items()), "feature string, importance double")

    def contributions(self, df: DataFrame) -> DataFrame:
        """What each feature adds to the mean output: of linear models coefficient x (value - mean), of trees exact Shapley values.

        The output is the number or log odds for linear and boosted models, the probability for trees and forests.
        """
        x = {f: self._value(f).alias(f) for f in self.features}
        if self.model_type in SECOND_ORDER:
            rows = self.encoded(df).select(*x.values())
            return rows.mapInPandas(in_batches([(1.0, t.leaves()) for t in self.fitted.trees], self.features), rows.schema)
        if self.model_type not in LINEAR:
            rows = df.select(*x.values())
            return rows.mapInPandas(in_batches(trees_of(self.fitted, self.task), self.features), rows.schema)
        mean = df.agg(*[F.avg(c) for c in x.values()]).first()
        return df.select(*[(F.lit(float(b)) * (x[f] - F.lit(m))).alias(f) for f, b, m in zip(self.features, self.fitted.coefficients, mean, strict=True)])

    def shap_importance(self, df: DataFrame) -> DataFrame:
        """feature, importance: the mean size of its contributions."""
        row = self.contributions(df).agg(*[F.avg(F.abs(col(f))).alias(f) for f in self.features]).first()
        return df.sparkSession.createDataFrame([(f, float(row[f] or 0.0)) for f in self.features], "feature string, importance double")

    def summary(self) -> dict:
        return {"model_type": self.model_type, "task": self.task, "n_features": len(self.features), "params": self.params}

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        about = self.summary() | {"features": self.features}
        if self.model_type in SECOND_ORDER:
            spark.createDataFrame([(self.fitted.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
            if self.encoder:
                about |= {"encoded": self.encoder.columns, "prior": self.encoder.prior}
                for k, c in enumerate(self.encoder.columns):
                    self.encoder.tables[c].toDF("category", "mean").write.mode("overwrite").parquet(f"{path}/categories/{k}")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark, path: str) -> ModelTrainer:
        about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        out = cls(about["model_type"], about["task"], **about["params"])
        out.features = about["features"]
        if out.model_type in SECOND_ORDER:
            out.model = boosting.Boosted.from_json(spark.read.text(f"{path}/model").first()[0])
            if about.get("encoded"):
                out.encoder = boosting.OrderedStatistics(about["encoded"])
                out.encoder.prior = about["prior"]
                out.encoder.tables = {c: spark.read.parquet(f"{path}/categories/{k}").toDF(c, "mean") for k, c in enumerate(about["encoded"])}
        else:
            out.model = PipelineModel.load(f"{path}/model")
        return out


def train_model(df: DataFrame, target: str, features: list[str], model_type: str = "logistic", task: str = "classification", weight: str | None = None, **params) -> ModelTrainer:
    return ModelTrainer(model_type, task, **params).fit(df, target, features, weight)


def evaluate(trainer: ModelTrainer, df: DataFrame, target: str, weight: str | None = None) -> dict[str, float]:
    score = fresh(df.columns, "_score")
    scored = trainer.predict_proba(df, score)
    row = metrics.all_metrics(scored, target, score, weight=weight) if trainer.task == "classification" else metrics.regression(scored, target, score, weight)
    return row.first().asDict()


def permutation_importance(trainer: ModelTrainer, df: DataFrame, target: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance (mean fall in AUC, or rise in RMSE) when a column's values change places.

    Rows are matched with others of their hash share by ranks in two hash orders; a share
    has about SHARE_ROWS rows, is stored as one row, and the task that has it matches all repeats.
    Repeats and features are scored some at a time (PASS_SCORES scores, or PASS_LEAST a row), so that
    the disk that their order takes, which is given back after each pass, does not grow with their number.
    AUCs come from ranges of the score that are ordered apart; rows without a target do not count.
    """
    names = trainer.features
    sign, name = (1, "auc") if trainer.task == "classification" else (-1, "rmse")
    label, which = (fresh(names, x) for x in ("_label", "_which"))
    score = fresh([label, which, *names], "_score")
    df = df.where(col(target).isNotNull())
    rows = df.select(F.struct(*[col(f).cast("double").alias(f) for f in names]).alias("own"), col(target).alias("y")).withColumn("h", F.xxhash64("own", "y"))
    with shuffles_given_back(df.sparkSession):
        n = df.count()
        rows = rows.withColumn("s", F.pmod("h", F.lit(max(16, n // SHARE_ROWS))))
        rows = rows.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("h")))
        # the window leaves rows by share and rank
        flat = rows.select("s", "r", "h", F.col("y").cast("double").alias("y"), *[F.col(f"own.`{f}`").alias(f"x{k}") for k, f in enumerate(names)])
        parts = ["h", "y", *[f"x{k}" for k in range(len(names))]]
        shares = _stored(flat.mapInArrow(_packed(parts), ", ".join(f"{c} binary" for c in parts)))
        bounds = _bounds(trainer.predict_proba(df.select(*map(col, names)), score), score, ranges_for(n)) if sign == 1 else []
        every = [-1, *range(repeats * len(names))]  # -1: all values in their places
        step, found = max(PASS_LEAST, PASS_SCORES // max(1, n)), {}
        for k in range(0, len(every), step):
            mix = _mixed(len(names), every[k : k + step], seed)
            scores = trainer.scorer() if sign == 1 else None
            if scores:
                table = _auc(shares.mapInArrow(_counted(mix, scores, np.array(bounds, np.float64)), COUNTS)).withColumnRenamed("which", which)
            else:
                kinds = ", ".join([f"`{label}` double", f"`{which}` int", *[f"`{f}` double" for f in names]])
                scored = trainer.predict_proba(shares.mapInArrow(_as_rows(mix, [label, which, *names]), kinds), score)
                if sign == 1:
                    table = auc_by_ranges(scored.select(F.col(which).alias("which"), F.col(label).alias("y"), F.col(score).alias("score")), bounds).withColumnRenamed("which", which)
                else:
                    table = metrics.regression(scored, label, score, by=[which])
            found |= {r[which]: r[name] for r in table.select(which, name).collect()}  # a row a repeat and feature
    falls = dict.fromkeys(names, 0.0)
    for k in sorted(found):
        if k >= 0:
            falls[names[k % len(names)]] += sign * (found[-1] - found[k]) / repeats
    return df.sparkSession.createDataFrame(list(falls.items()), "feature string, importance double")


def _packed(columns: list[str]):
    """Rows of whole shares (s, then r) -> a share's columns as the bytes of its numbers, by rank, in one row."""

    def pack(share: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(share)
        place = np.argsort(t["r"].to_numpy(), kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([t[c].to_numpy()[place].tobytes()], pa.binary()) for c in columns], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            s = b["s"].to_numpy()
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else []
            for i, j in itertools.pairwise(edges):
                if s[i] != at and held:
                    yield pack(held)
                    held = []
                at = s[i]
                held.append(b.slice(i, j - i))
        if held:
            yield pack(held)

    return run


def _mixed(n: int, wanted: list[int], seed: int):
    """Shares -> for each wanted (repeat x n + feature) the targets and the columns, that feature's values being others' of the share."""

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        for b in batches:
            for i in range(b.num_rows):
                numbers = lambda c, kind=np.float64: np.frombuffer(b[c][i].as_buffer(), kind)  # noqa: B023, E731
                y, x, h = numbers("y"), [numbers(f"x{f}") for f in range(n)], numbers("h", np.int64)
                own, repeat, other = hashed_on(hashed_on(42, h), np.arange(1, len(h) + 1, dtype=np.int32)), None, None
                for w in wanted:
                    if w < 0:
                        yield w, y, x
                        continue
                    k, f = divmod(w, n)
                    if k != repeat:
                        repeat, other = k, np.argsort(hashed_on(own, np.array([seed + k], np.int32)).view(np.int64), kind="stable")
                    yield w, y, [v[other] if g == f else v for g, v in enumerate(x)]

    return mix


def hashed_on(seed: int | np.ndarray, x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a further column of bigint or int, on the hash of the columns before (42 at first)."""
    p = [np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turned = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = np.atleast_1d(np.asarray(seed, np.uint64)) + p[4] + np.uint64(x.itemsize)
    if x.itemsize == 8:
        h = turned(h ^ turned(x.view(np.uint64) * p[1], 31) * p[0], 27) * p[0] + p[3]
    else:
        h = turned(h ^ x.view(np.uint32).astype(np.uint64) * p[0], 23) * p[1] + p[2]
    h = (h ^ (h >> np.uint64(33))) * p[1]
    h = (h ^ (h >> np.uint64(29))) * p[2]
    return h ^ (h >> np.uint64(32))


def _as_rows(mix, out: list[str]):
    """What is mixed, as rows for models that Spark applies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, y, x in mix(batches):
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(np.full(len(y), w, np.int32)), *map(pa.array, x)], out)

    return run


def _counted(mix, scores, edges: np.ndarray):
    """What is mixed, scored in the task and counted by ranges of the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, y, x in mix(batches):
            yield _counts(_by_range(w, y, scores(x), edges))

    return run


def _bounds(df: DataFrame, score: str, ranges: int) -> list[float]:
    """Scores that cut a table into ranges of about as many rows."""
    found = df.agg(F.percentile_approx(score, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    return sorted(set(found or []))


COUNTS = "which int, part int, counts binary"


def _equal_as_one(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(score, kind="stable")
    score = score[order]
    lead = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    return score[lead], np.add.reduceat(pos[order], lead), np.add.reduceat(neg[order], lead)


def _by_range(w: int, y: np.ndarray, score: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, bytes]]:
    """which, range, and the range's distinct scores with their rows of both classes."""
    found = _equal_as_one(score, y, 1 - y)
    part = np.searchsorted(edges, found[0], "right")
    lead = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [(int(w), int(part[i]), np.stack([v[i:j] for v in found]).tobytes()) for i, j in itertools.pairwise([*lead.tolist(), len(part)])]


def _counts(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["which", "part", "counts"])


def auc_by_ranges(scored: DataFrame, bounds: list[float]) -> DataFrame:
    """which, auc of rows of which, y, score: tasks count equal scores by range, a shuffle by range puts them in order, and sums of ranges are added up."""
    edges = np.array(bounds, np.float64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches):
            which, y, score = (b[c].to_numpy(zero_copy_only=False) for c in ("which", "y", "score"))
            yield _counts([r for w in np.unique(which) for r in _by_range(w, y[which == w], score[which == w], edges)])

    return _auc(scored.where(F.col("score").isNotNull()).mapInArrow(dealt, COUNTS))


def _auc(counts: DataFrame) -> DataFrame:
    def ordered(t: pa.Table) -> pa.Table:
        score, pos, neg = _equal_as_one(*np.concatenate([np.frombuffer(x).reshape(3, -1) for x in t["counts"].to_pylist()], axis=1))
        below = np.cumsum(neg) - neg
        return pa.table({"which": t["which"][:1], "part": t["part"][:1], "pos": [pos.sum()], "neg": [neg.sum()], "pairs": [(pos * (below + neg / 2)).sum()]})

    parts = counts.groupBy("which", "part").applyInArrow(ordered, "which int, part int, pos double, neg double, pairs double")
    before = F.coalesce(F.sum("neg").over(W.partitionBy("which").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    sums = parts.withColumn("pairs", F.col("pairs") + F.col("pos") * before).groupBy("which").agg(F.sum("pairs").alias("pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select("which", F.coalesce(F.try_divide("pairs", F.col("pos") * F.col("neg")), F.lit(0.5)).alias("auc"))


#: Parameters with which a logistic model is one of many that are fitted at once.
TOGETHER = {"C", "solver", "random_state", "max_iter", "n_jobs", "verbose", "tol"}


def _summary(df: DataFrame, found: list[dict]) -> DataFrame:
    rows = []
    for m in found[0]:
        v = [float(x[m]) for x in found if x[m] is not None]
        mean = sum(v) / len(v)
        rows.append((m, mean, (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5, min(v), max(v)))
    return df.sparkSession.createDataFrame(rows, "metric string, mean double, std double, min double, max double")


def alike(rows: DataFrame, weight: str) -> DataFrame:
    """Rows that are alike but for their weights as one, with the weights added up; stored."""
    return _stored(rows.groupBy(*[col(c) for c in rows.columns if c != weight]).agg(F.sum(weight).alias(weight)).select(*map(col, rows.columns)))


def _stored(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "folds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folds_at_once(df: DataFrame, target: str, features: list[str], strengths: list[float], k: int, method: str, key: list[str], date: str | None) -> list[list[dict]]:
    """For each strength the metrics of each fold: all models from the same scans, all scores in one."""
    require(df, target, *features)
    validate_binary_target(df, target)
    name = fresh(df.columns, "fold")
    folded, splits = cv_folds(df, k, method, target, key, date, name=name)
    rows = _stored(newton.table(folded, col(target), F.lit(1.0), [col(f) for f in features], F.col(name)))
    every = list(range(len(features)))
    fitted = newton.fit(rows, len(features), [newton.Wanted(c, every, train) for c in strengths for train, _ in splits])

    def chance(c: int) -> Column:
        out = F.lit(None).cast("double")
        for j, (_, test) in enumerate(splits):
            b = fitted[c * len(splits) + j]
            z = F.lit(float(b[0]))
            for f in every:
                z = z + F.lit(float(b[f + 1])) * F.col(f"x{f}")
            out = F.when(F.col("fold") == test, 1 / (1 + F.exp(-z))).otherwise(out)
        return out

    scores = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), chance(c).alias("p")) for c in range(len(strengths))])).alias("s")
    scored = rows.where(F.col("fold").isin([t for _, t in splits])).select("y", "fold", "w", scores).select("y", "fold", "w", "s.c", "s.p")
    found = {(r["c"], r["fold"]): r.asDict() for r in metrics.all_metrics(scored, "y", "p", weight="w", by=["c", "fold"]).collect()}  # a row a model
    return [[{m: v for m, v in found[c, t].items() if m not in ("c", "fold")} for _, t in splits] for c in range(len(strengths))]


def cross_validate(df: DataFrame, target: str, features: list[str], model_type: str = "logistic", task: str = "classification", k: int = 5, method: str = "stratified", key: list[str] = (), date: str | None = None, scoring=None, **params) -> DataFrame:
    """metric, mean, std (n), min, max over folds. Logistic models of all folds are fitted in the same scans."""
    method = method if task == "classification" or method != "stratified" else "kfold"
    if model_type == "logistic" and task == "classification" and not scoring and set(params) <= TOGETHER:
        return _summary(df, _folds_at_once(df, target, features, [params.get("C", 1.0)], k, method, list(key) or features, date)[0])
    name = fresh(df.columns, "fold")
    folded, splits = cv_folds(df, k, method, target, list(key) or features, date, name=name)
    stored = _stored(folded.select(*map(col, dict.fromkeys([target, *features])), name))
    found: list[dict] = []
    for train, test in splits:
        trainer = ModelTrainer(model_type, task, **params).fit(stored.where(F.col(name).isin(sorted(train))), target, features)
        held = stored.where(F.col(name) == test)
        found.append(scoring(trainer, held, target) if scoring else evaluate(trainer, held, target))
    return _summary(df, found)


def default_grid(model_type: str) -> dict[str, list]:
    return dict(GRIDS[model_type])


def candidates(model_type: str, grid: dict | None, n_iter: int | None, seed: int) -> list[dict]:
    """All combinations of lists, or n_iter at random; values may be distributions: things with rvs(random_state) or (low, high) of uniform numbers."""
    grid = grid or default_grid(model_type)
    drawn = lambda v: hasattr(v, "rvs") or isinstance(v, tuple)
    if not any(map(drawn, grid.values())):
        every = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
        return random.Random(seed).sample(every, n_iter) if n_iter and n_iter < len(every) else every
    rng = random.Random(seed)

    def draw(v):
        if hasattr(v, "rvs"):
            x = v.rvs(random_state=rng.getrandbits(32))
            return x.item() if hasattr(x, "item") else x
        if not isinstance(v, tuple):
            return rng.choice(v)
        return rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v)

    return [{name: draw(v) for name, v in grid.items()} for _ in range(n_iter or 10)]


def search(df: DataFrame, target: str, features: list[str], model_type: str = "logistic", task: str = "classification", grid: dict | None = None, n_iter: int | None = None, k: int = 5, key: list[str] = (), seed: int = 42, scoring: str | None = None) -> list[dict]:
    """Every candidate with its mean and standard deviation over folds, and its rank; logistic ones are fitted in the same scans.

    scoring: a metric of evaluate(); of errors (rmse, mae, mse) the least is best.
    """
    name = scoring or ("auc" if task == "classification" else "rmse")
    sign = -1 if name in ("rmse", "mae", "mse", "mape") else 1
    every = candidates(model_type, grid, n_iter, seed)
    if model_type == "logistic" and task == "classification" and all(set(p) <= TOGETHER | {"penalty"} and p.get("penalty", "l2") == "l2" for p in every):
        strengths = sorted({float(p.get("C", 1.0)) for p in every})
        folds = dict(zip(strengths, _folds_at_once(df, target, features, strengths, k, "stratified", list(key) or features, None), strict=True))
        values = [[f[name] for f in folds[float(p.get("C", 1.0))]] for p in every]
    else:
        values = []
        for params in every:
            r = cross_validate(df, target, features, model_type, task, k, key=key, **params).where(F.col("metric") == name).first()
            values.append((r["mean"], r["std"]))
    rows = []
    for params, v in zip(every, values, strict=True):
        mean, std = v if isinstance(v, tuple) else (sum(v) / len(v), (sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) ** 0.5)
        rows.append({"params": params, "mean": mean, "std": std})
    for rank, r in enumerate(sorted(rows, key=lambda r: -sign * r["mean"]), 1):
        r["rank"] = rank
    return rows


def tune(df: DataFrame, target: str, features: list[str], model_type: str = "logistic", task: str = "classification", grid: dict | None = None, n_iter: int | None = None, k: int = 5, key: list[str] = (), seed: int = 42, scoring: str | None = None) -> tuple[dict, float]:
    """The best of search(), and its mean (negative for errors)."""
    best = min(search(df, target, features, model_type, task, grid, n_iter, k, key, seed, scoring), key=lambda r: r["rank"])
    name = scoring or ("auc" if task == "classification" else "rmse")
    return best["params"], -best["mean"] if name in ("rmse", "mae", "mse", "mape") else best["mean"]


#: The only column of a calibrator's model.
SCORE = "_calibrated_score"


class Calibrator:
    """Maps scores to probabilities: a logistic function of the score, or a monotone step function."""

    def __init__(self, method: str = "sigmoid"):
        if method not in ("sigmoid", "isotonic"):
            raise ValidationError(f"no such method: {method}")
        self.method = method

    def fit(self, df: DataFrame, target: str, score: str, weight: str | None = None) -> Calibrator:
        w = col(weight).cast("double") if weight else F.lit(1.0)
        if self.method == "sigmoid":
            self.model = ModelTrainer("logistic").fit(df.select(col(target).alias("y"), col(score).alias(SCORE), w.alias("w")), "y", [SCORE], "w")
        else:
            rows = df.select(col(target).cast("double").alias("label"), col(score).cast("double").alias(SCORE), w.alias("w")).where("label is not null")
            rows = rows.groupBy(SCORE).agg((F.sum(F.col("label") * F.col("w")) / F.sum("w")).alias("label"), F.sum("w").alias("w"))
            self.model = IsotonicRegression(featuresCol=SCORE, labelCol="label", weightCol="w").fit(rows)
        return self

    def transform(self, df: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
        if self.method == "sigmoid":
            packed = df.select(F.struct("*").alias("_row"), col(score).cast("double").alias(SCORE))
            return self.model.predict_proba(packed, "_out").select("_row.*", F.col("_out").alias(name))
        packed = df.select(F.struct("*").alias("_row"), col(score).cast("double").alias(SCORE))
        return self.model.transform(packed).select("_row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias(name))


def calibrated_model(df: DataFrame, target: str, features: list[str], model_type: str = "logistic", method: str = "sigmoid", k: int = 3, key: list[str] = (), **params) -> tuple[ModelTrainer, Calibrator]:
    """A model on all rows and a calibrator learned from predictions out of its folds."""
    held = [ModelTrainer(model_type, **params).fit(a, target, features).predict_proba(b, "_score").select(target, "_score") for a, b in cv_splits(df, k, "stratified", target, list(key) or features)]
    out = held[0]
    for h in held[1:]:
        out = out.unionByName(h)
    return ModelTrainer(model_type, **params).fit(df, target, features), Calibrator(method).fit(out, target, "_score")


class CalibratedModel:
    """The mean of k fold models, each with a calibrator learned from the rows that it did not see."""

    def __init__(self, model_type: str = "logistic", method: str = "sigmoid", k: int = 5, **params):
        self.model_type, self.method, self.k, self.params = model_type, method, k, params
        self.parts: list[tuple[ModelTrainer, Calibrator]] = []

    def fit(self, df: DataFrame, target: str, features: list[str], key: list[str] = ()) -> CalibratedModel:
        require(df, target, *features)
        validate_binary_target(df, target)
        self.features, name, score = list(features), fresh(df.columns, "fold"), fresh([*features, target], "_score")
        folded, splits = cv_folds(df, self.k, "stratified", target, list(key) or features, name=name)
        rows, weight = folded.select(*map(col, dict.fromkeys([target, *features])), name), None
        if self.model_type == "logistic":
            weight = fresh([*rows.columns, score], "_w")
            stored = alike(rows.withColumn(weight, F.lit(1.0)), weight)
        else:
            stored = _stored(rows)
        self.parts = []
        for train, test in splits:
            model = ModelTrainer(self.model_type, **self.params).fit(stored.where(F.col(name).isin(sorted(train))), target, features, weight)
            held = model.predict_proba(stored.where(F.col(name) == test), score)
            self.parts.append((model, Calibrator(self.method).fit(held, target, score, weight)))
        return self

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        if not self.parts:
            raise NotFittedError("the model is not fitted")
        raw, names, out = fresh([*df.columns, name], "_raw"), [], df
        for model, calibrator in self.parts:
            names.append(fresh([*out.columns, name, raw], "_part"))
            out = calibrator.transform(model.predict_proba(out, raw), raw, names[-1]).drop(raw)
        mean = sum(map(F.col, names[1:]), F.col(names[0])) / len(names)
        return out.select(*map(col, df.columns), mean.alias(name)) if name not in df.columns else out.withColumn(name, mean).drop(*names)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        about = {"model_type": self.model_type, "method": self.method, "k": self.k, "params": self.params, "features": self.features}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        for j, (model, calibrator) in enumerate(self.parts):
            model.save(f"{path}/{j}/trainer")
            if self.method == "sigmoid":
                calibrator.model.save(f"{path}/{j}/calibrator")
            else:
                calibrator.model.write().overwrite().save(f"{path}/{j}/calibrator")

    @classmethod
    def load(cls, spark, path: str) -> CalibratedModel:
        about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        out = cls(about["model_type"], about["method"], about["k"], **about["params"])
        out.features = about["features"]
        for j in range(out.k):
            calibrator = Calibrator(out.method)
            calibrator.model = ModelTrainer.load(spark, f"{path}/{j}/calibrator") if out.method == "sigmoid" else IsotonicRegressionModel.load(f"{path}/{j}/calibrator")
            out.parts.append((ModelTrainer.load(spark, f"{path}/{j}/trainer"), calibrator))
        return out


def brier(df: DataFrame, target: str, probability: str) -> float:
    return df.agg(F.avg((col(target).cast("double") - col(probability)) ** 2)).first()[0]
