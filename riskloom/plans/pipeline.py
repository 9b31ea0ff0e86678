"""End-to-end modelling: split, preprocess, bin, select, train, evaluate, report, save, score, gate."""

from __future__ import annotations

import io
import json
import re
import tempfile
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import NotFittedError, ValidationError
from ..functions.basics import NUMERIC, Roles, check_weights, col, fresh, plain, require
from ..operators import metrics, risk
from ..operators.binning import WoeBinner, bin_stats, cube, iv_report, woe_table
from ..operators.cleaning import Preprocessor
from ..operators.features import select_features
from ..operators.models import BOOSTERS, ModelTrainer
from ..operators.scorecard import credit_score
from ..operators.splits import hashed, split_dev_oot
from ..operators.stability import psi_numeric
from ..sources.shared import get_bytes, names_in, put_bytes, put_file
from ..sources.tables import load_data, sheet_names, write_xlsx


@dataclass
class ScoringArtifact:
    """What turns raw columns into a probability: rules as JSON, the model beside them."""

    features: list[str]
    preprocessor: Preprocessor | None
    binner: WoeBinner | None
    selected: list[str]
    model: ModelTrainer
    task: str = "classification"
    log_target: bool = False
    metadata: dict = field(default_factory=dict)
    version: str = "1.0"

    def prepare(self, df: DataFrame) -> DataFrame:
        require(df, *self.features)
        if self.preprocessor:
            df = self.preprocessor.transform(df)
        return self.binner.transform(df, return_type="woe") if self.binner else df

    def score(self, df: DataFrame, name: str = "probability", threshold: float = 0.5, points: bool = False) -> DataFrame:
        """df with its own columns and the score; transformed columns do not stay."""
        own = [c for c in df.columns if c not in (name, "label", "credit_score")]
        held = df.select(*[col(c) for c in own], F.struct(*[col(c) for c in own]).alias("_own"))
        out = self.model.predict_proba(self.prepare(held), name)
        out = out.select(*[F.col(f"_own.`{c}`") for c in own], name)
        if self.task != "classification":
            return out.withColumn(name, F.expm1(name)) if self.log_target else out
        out = out.withColumn("label", (F.col(name) >= threshold).cast("int"))
        scale = dict(self.metadata.get("credit") or {})
        column = scale.pop("column", "credit_score")
        return out.withColumn(column, credit_score(F.col(name), **scale)) if points or self.metadata.get("credit") else out

    def save(self, path: str) -> None:
        p = self.preprocessor
        about = {
            "version": self.version, "task": self.task, "feature_columns": self.features, "selected": self.selected, "log_target": self.log_target, "metadata": self.metadata,
            "preprocessor": {"impute": p.impute, "scale": p.scale, "special_values": p.special_values, "stats": p.stats} if p else None,
            "binner": self.binner.to_dict() if self.binner else None,
        }
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/artifact")
        self.model.save(f"{path}/trainer")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringArtifact:
        about = json.loads(spark.read.text(f"{path}/artifact").first()[0])
        pre = None
        if about["preprocessor"]:
            p = about["preprocessor"]
            pre = Preprocessor(p["impute"], p["scale"], p["special_values"])
            pre.stats, pre.fitted = p["stats"], True
        binner = WoeBinner.from_dict(about["binner"]) if about["binner"] else None
        return cls(about["feature_columns"], pre, binner, about["selected"], ModelTrainer.load(spark, f"{path}/trainer"), about["task"], about["log_target"], about["metadata"], about["version"])


class EarlyStopping:
    """Where boosting is judged while it trains: on a fifth of the development rows, or on the out-of-time sample."""

    def __init__(self, sample: str = "none", rounds: int | None = None, metric: str | None = None):
        if sample not in (None, False, "none", "dev_holdout", "oot"):
            raise ValidationError(f"early stopping is judged on dev_holdout or oot, not {sample}")
        self.sample, self.rounds, self.metric = sample or "none", rounds, metric

    def fit(self, trainer: ModelTrainer, dev: DataFrame, oot: DataFrame, target: str, features: list[str], weight: str | None, key: list[str]) -> ModelTrainer:
        if self.sample == "none" or not self.rounds or trainer.model_type not in BOOSTERS:
            return trainer.fit(dev, target, features, weight)
        trainer.stop = int(self.rounds)
        if self.metric:
            trainer.params = trainer.params | {"eval_metric": self.metric}
        if self.sample == "dev_holdout":
            return trainer.fit(dev, target, features, weight, held=F.pmod(hashed(key, 42), F.lit(5)) == 0)
        names = [c for c in dict.fromkeys((target, weight, *features)) if c]
        held = fresh(names, "_held")
        both = dev.select(*map(col, names), F.lit(False).alias(held)).unionByName(oot.select(*map(col, names), F.lit(True).alias(held)))
        return trainer.fit(both, target, features, weight, held=F.col(held))


def write_report(tables: dict[str, DataFrame], folder: str) -> str:
    """Model_Report_N.xlsx with the next free number, on the store that Spark writes to."""
    found = [int(m[1]) for n in names_in(folder) if (m := re.fullmatch(r"Model_Report_(\d+)\.xlsx", n))]
    with tempfile.TemporaryDirectory() as here:
        return put_file(write_xlsx(tables, f"{here}/it.xlsx"), f"{folder}/Model_Report_{max(found, default=0) + 1}.xlsx")


def pairs(spark: SparkSession, values: dict, prefix: str = "") -> DataFrame:
    """Metrics whose names begin so, as metric, value."""
    return spark.createDataFrame([(k.removeprefix(prefix), float(v)) for k, v in values.items() if k.startswith(prefix) and v is not None], "metric string, value double")


def facts(spark: SparkSession, values: dict) -> DataFrame:
    """item, value."""
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in values.items()], "item string, value string")


class AutoPipeline:
    """Classification. Everything is learned on the development sample; columns with a role are never features."""

    def __init__(self, roles: Roles, model_type: str = "logistic", n_bins: int = 5, method: str = "quantile", clean: str = "median", selection: str = "iv", threshold: float | None = None, max_features: int | None = None, special_values: list = (), oot_start=None, test_size: float = 0.2, key: list[str] = (), binner: dict | None = None, normalize: str | None = None, dev_label: str = "dev", oot_label: str = "oot", credit: dict | None = None, early_stopping: str = "none", early_stopping_rounds: int | None = None, early_stopping_metric: str | None = None, **params):
        self.stopping = EarlyStopping(early_stopping, early_stopping_rounds, early_stopping_metric)
        self.roles, self.model_type, self.clean, self.selection = roles, model_type, clean, selection
        self.normalize, self.labels, self.credit = normalize, (str(dev_label).lower(), str(oot_label).lower()), credit
        self.threshold, self.max_features, self.oot_start, self.test_size, self.key = threshold, max_features, oot_start, test_size, list(key)
        self.special_values = list(special_values)
        self.binner = WoeBinner(n_bins, method, special_values=special_values, **(binner or {}))
        self.params = params
        self.artifact: ScoringArtifact | None = None
        self._held: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame) -> AutoPipeline:
        r = self.roles
        require(df, r.target)
        self.split = split_dev_oot(df, r.sample, r.date, self.oot_start, r.target, self.key, self.test_size, *self.labels).validate(r.target)
        dev = self.split.dev
        check_weights(dev, r.weight)
        features = r.features(df)
        numeric = [f for f in features if isinstance(df.schema[f].dataType, NUMERIC)]
        pre = Preprocessor(self.clean, self.normalize, [] if self.clean == "keep" else self.special_values).fit(dev, columns=numeric, weight=r.weight)
        clean = pre.transform(dev)
        self.binner.fit(clean, features=features, target=r.target, weight=r.weight)
        woe = self.binner.transform(clean, return_type="woe")
        names = [f"{f}_bin" for f in self.binner.rules]
        if self.selection == "iv":
            total, least = self.binner.total_iv(), 0.02 if self.threshold is None else self.threshold
            chosen = [f"{f}_bin" for f in sorted(total, key=lambda f: (-total[f], f)) if total[f] >= least][: self.max_features]
        else:
            chosen = select_features(woe, self.selection, r.target, names, self.threshold, self.max_features)
        if not chosen:
            raise ValidationError("no feature was selected")
        ready = lambda part: self.binner.transform(pre.transform(part), return_type="woe")
        model = self.stopping.fit(ModelTrainer(self.model_type, **self.params), woe, ready(self.split.oot), r.target, chosen, r.weight, self.key or features)
        self.artifact = ScoringArtifact(features, pre, self.binner, chosen, model, metadata={"target": r.target} | ({"credit": self.credit} if self.credit else {}))
        self.metrics = self.evaluate()
        return self

    def _need(self) -> ScoringArtifact:
        if self.artifact is None:
            raise NotFittedError("the pipeline is not fitted")
        return self.artifact

    def scored(self, df: DataFrame) -> DataFrame:
        return self._need().score(df, "score").drop("credit_score")

    def predict(self, df: DataFrame) -> DataFrame:
        return self._need().score(df)

    def held(self, name: str) -> DataFrame:
        """The scores of a sample with its role columns, kept as a dozen reports read them; release() lets go."""
        if name not in self._held:
            r = self.roles
            names = [c for c in dict.fromkeys((r.target, r.weight, r.temporal, *r.each(r.segment), *r.each(r.benchmark))) if c]
            self._held[name] = self.scored(getattr(self.split, name)).select(*map(col, names), "score").persist(StorageLevel.MEMORY_AND_DISK)
        return self._held[name]

    def release(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held = {}

    def evaluate(self) -> dict[str, float]:
        r, out = self.roles, {}
        for name in ("dev", "oot"):
            row = metrics.all_metrics(self.held(name), r.target, "score", weight=r.weight).first().asDict()
            out |= {f"{name}_{k}": v for k, v in row.items()}
        psi = psi_numeric(self.held("dev"), self.held("oot"), "score", expected_weight=r.weight, actual_weight=r.weight)
        out["score_psi"] = psi.agg(F.sum("psi")).first()[0]
        return out

    def tables(self) -> dict[str, DataFrame]:
        """The report's sheets."""
        a, r = self._need(), self.roles
        dev, oot = self.held("dev"), self.held("oot")
        spark = dev.sparkSession
        sums = cube(a.preprocessor.transform(self.split.dev), a.binner.rules, r.target, r.weight)
        detail = bin_stats(sums, a.binner.smoothing).join(F.broadcast(a.binner.labels_frame(dev)), ["feature", "bin_idx"], "left")  # a row for each bin
        report = iv_report(woe_table(sums, a.binner.smoothing))
        chosen = [f.removesuffix("_bin") for f in a.selected]
        out = {
            "Overview_Performance": pairs(spark, self.metrics),
            "Artifact_Metadata": facts(spark, {"version": a.version, "task": a.task, "model_type": self.model_type, "features": a.features, "selected": a.selected}),
            "Binning_Summary": report.join(detail.groupBy("feature").agg(F.count(F.lit(1)).alias("n_bins")), "feature"),
            "IV_Summary": report,
            "WOE_Detail": detail.orderBy("feature", "bin_idx"),
            "Variable_Audit": spark.createDataFrame([(f, f in a.binner.rules, a.binner.failures.get(f), f in chosen) for f in a.features], "feature string, binned boolean, failure string, selected boolean"),
            "Selection_Report": report.withColumn("selected", F.col("feature").isin(chosen)),
            "Dev_Metrics": pairs(spark, self.metrics, "dev_"), "OOT_Metrics": pairs(spark, self.metrics, "oot_"),
            "Dev_Score_Bins": metrics.lift(dev, r.target, "score", weight=r.weight), "OOT_Score_Bins": metrics.lift(oot, r.target, "score", weight=r.weight),
            "Score_PSI": psi_numeric(dev, oot, "score"),
            "Model_Estimation": a.model.importance(dev),
        }
        every = dev.withColumn("_sample", F.lit("dev")).unionByName(oot.withColumn("_sample", F.lit("oot")))
        both = lambda tables: reduce(DataFrame.unionByName, tables)
        if segment := r.each(r.segment):
            one = lambda c: risk.segments(every, c, r.target, "score", r.weight).select(F.lit(c).alias("by"), col(c).cast("string").alias("segment"), "*").drop(c)
            out["Segment_Summary"] = both(map(one, segment))
        if r.temporal:
            out["Temporal_Stability"] = risk.segments(every, r.temporal, r.target, "score", r.weight)
        if benchmark := r.each(r.benchmark):
            out["Benchmark_Performance"] = both(metrics.all_metrics(oot, r.target, c, 0.5, r.weight).select(F.lit(c).alias("benchmark"), "*") for c in benchmark)
        return out

    def save(self, folder: str) -> str:
        self._need().save(f"{folder}/scoring_artifact")
        put_bytes(json.dumps(plain(self.metrics), indent=2).encode(), f"{folder}/metrics.json")
        path = write_report(self.tables(), folder)
        self.release()
        return path


class RegressionPipeline:
    """Numeric features only; the target may be trained as log1p and is returned on its own scale."""

    def __init__(self, roles: Roles, model_type: str = "linear", log_target: bool = False, clean: str = "median", oot_start=None, normalize: str | None = None, dev_label: str = "dev", oot_label: str = "oot", key: list[str] = (), early_stopping: str = "none", early_stopping_rounds: int | None = None, early_stopping_metric: str | None = None, **params):
        self.stopping, self.key = EarlyStopping(early_stopping, early_stopping_rounds, early_stopping_metric), list(key)
        self.roles, self.model_type, self.log_target, self.clean, self.oot_start, self.params = roles, model_type, log_target, clean, oot_start, params
        self.normalize, self.labels = normalize, {"dev": str(dev_label).lower(), "oot": str(oot_label).lower()}
        self.artifact: ScoringArtifact | None = None

    def fit(self, df: DataFrame) -> RegressionPipeline:
        r = self.roles
        self.split = split_dev_oot(df, r.sample, r.date, self.oot_start, **self.labels).validate(r.target)
        features = r.features(df, numeric_only=True)
        pre = Preprocessor(self.clean, self.normalize).fit(self.split.dev, columns=features)
        if self.log_target and df.where(col(r.target) <= -1).limit(1).count():
            raise ValidationError("log1p needs targets above -1")
        own = (lambda part: part.withColumn(r.target, F.log1p(col(r.target)))) if self.log_target else (lambda part: part)
        dev, oot = (own(pre.transform(part)) for part in (self.split.dev, self.split.oot))  # both on the scale that is learned
        model = self.stopping.fit(ModelTrainer(self.model_type, "regression", **self.params), dev, oot, r.target, features, r.weight, self.key or features)
        self.artifact = ScoringArtifact(features, pre, None, features, model, "regression", self.log_target, {"target": r.target})
        self.metrics = {}
        for name, part in (("dev", self.split.dev), ("oot", self.split.oot)):
            row = metrics.regression(self.artifact.score(part, "prediction"), r.target, "prediction", r.weight).first().asDict()
            self.metrics |= {f"{name}_{k}": v for k, v in row.items()}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.artifact is None:
            raise NotFittedError("the pipeline is not fitted")
        return self.artifact.score(df, "prediction")

    def tables(self) -> dict[str, DataFrame]:
        """The report's sheets."""
        if self.artifact is None:
            raise NotFittedError("the pipeline is not fitted")
        a, r = self.artifact, self.roles
        spark = self.split.dev.sparkSession
        about = {"version": a.version, "task": a.task, "model_type": self.model_type, "target": r.target, "target_transform": "log1p" if self.log_target else None, "features": a.features, "early_stopping": self.stopping.sample, "early_stopping_rounds": self.stopping.rounds}
        return {
            "Overview_Performance": pairs(spark, self.metrics), "Artifact_Metadata": facts(spark, about),
            "Dev_Metrics": pairs(spark, self.metrics, "dev_"), "OOT_Metrics": pairs(spark, self.metrics, "oot_"),
            "Model_Estimation": a.model.importance(self.split.dev),
        }

    def save(self, folder: str) -> str:
        """Artifact, metrics and workbook; the path of the workbook."""
        tables = self.tables()
        self.artifact.save(f"{folder}/scoring_artifact")
        put_bytes(json.dumps(plain(self.metrics), indent=2).encode(), f"{folder}/metrics.json")
        return write_report(tables, folder)


def run_pipeline(spark: SparkSession, source, roles: Roles, folder: str | None = None, task: str = "classification", encoding: str | None = None, **how):
    df = load_data(spark, source, **({"encoding": encoding} if encoding else {}))
    pipe = (AutoPipeline if task == "classification" else RegressionPipeline)(roles, **how).fit(df)
    if folder:
        pipe.save(folder)
    return pipe


def validate_release(spark: SparkSession, folder: str, min_auc: float | None = 0.6, max_psi: float | None = 0.25) -> dict[str, bool]:
    """artifact_loadable, artifact_contract, feature_contract, report_contract, and passed; of a
    classification also min_auc and max_psi, each only where a limit is given."""
    out = dict.fromkeys(("artifact_loadable", "artifact_contract", "feature_contract", "report_contract"), False)
    task = None
    try:
        a = ScoringArtifact.load(spark, f"{folder}/scoring_artifact")
        task = a.task
        out["artifact_loadable"] = True
        out["artifact_contract"] = a.version == "1.0" and a.task in ("classification", "regression")
        out["feature_contract"] = bool(a.selected) and all(s.removesuffix("_bin") in a.features for s in a.selected)
    except Exception as e:  # a broken artifact is a finding, not a crash
        out["error"] = str(e)[:200]
    reports = sorted((n for n in names_in(folder) if re.fullmatch(r"Model_Report_\d+\.xlsx", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    if reports:
        out["report_contract"] = {"Overview_Performance", "Artifact_Metadata"} <= set(sheet_names(io.BytesIO(get_bytes(f"{folder}/{reports[-1]}"))))
    if task != "regression":
        text = get_bytes(f"{folder}/metrics.json")
        m = json.loads(text) if text else {}
        if min_auc is not None:
            out["min_auc"] = (m.get("oot_auc") or 0) >= min_auc
        if max_psi is not None:
            out["max_psi"] = m.get("score_psi") is not None and m["score_psi"] <= max_psi
    return out | {"passed": all(v for k, v in out.items() if k != "error")}
