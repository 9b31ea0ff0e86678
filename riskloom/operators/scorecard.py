"""Scorecards: points for bins, scores, and probabilities back from scores."""

from __future__ import annotations

import csv
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import NotFittedError
from .binning import WoeBinner, lookup
from .models import ModelTrainer


def credit_score(p: Column, base: float = 500.0, pdo: float = 20.0, low: float = 300.0, high: float = 900.0) -> Column:
    """base at even odds, pdo points for each doubling of the odds of good, within [low, high]."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.least(F.greatest(F.lit(base) + F.lit(pdo / math.log(2)) * F.ln((1 - p) / p), F.lit(low)), F.lit(high))


class Scorecard:
    """points = -coefficient x WOE x factor; a higher score is a lower risk; predict: 1 approves."""

    def __init__(self, base_score: float = 600.0, base_odds: float = 50.0, pdo: float = 20.0):
        self.base_score, self.base_odds, self.pdo = base_score, base_odds, pdo
        self.factor = pdo / math.log(2)
        self.offset = base_score - self.factor * math.log(base_odds)
        self.points: dict[str, dict[int, float]] = {}

    def fit(self, binner: WoeBinner, model: ModelTrainer) -> Scorecard:
        """model: a logistic model over the binner's WOE columns, <feature>_bin."""
        self.binner = binner
        self.base_points = self.offset - self.factor * float(model.fitted.intercept)
        for name, b in zip(model.features, model.fitted.coefficients, strict=True):
            f = name.removesuffix("_bin")
            self.points[f] = {k: -float(b) * w * self.factor for k, w in binner.rules[f].woe.items()}
        return self

    def _need(self) -> None:
        if not self.points:
            raise NotFittedError("the scorecard is not fitted")

    def raw_score(self) -> Column:
        self._need()
        total = F.lit(self.base_points)
        for f, p in self.points.items():
            total = total + F.coalesce(lookup(p, self.binner.rules[f].index()), F.lit(0.0))
        return total

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Rounded half to even."""
        return df.withColumn(name, F.bround(self.raw_score()))

    def predict_proba(self, df: DataFrame, name: str = "p_bad") -> DataFrame:
        return df.withColumn(name, 1 / (1 + F.exp(-(F.lit(self.offset) - self.raw_score()) / self.factor)))

    def predict(self, df: DataFrame, threshold: float | None = None, name: str = "approved") -> DataFrame:
        return df.withColumn(name, (F.bround(self.raw_score()) >= (self.base_score if threshold is None else threshold)).cast("int"))

    def table(self, df: DataFrame) -> DataFrame:
        """feature, bin_idx, bin_label, woe, points."""
        self._need()
        rows = [(f, k, self.binner.rules[f].label(k), self.binner.rules[f].woe[k], v) for f, p in self.points.items() for k, v in sorted(p.items())]
        return df.sparkSession.createDataFrame(rows, "feature string, bin_idx int, bin_label string, woe double, points double")

    def save_scorecard(self, df: DataFrame, path: str) -> str:
        """The table as one csv file; df only lends its session."""
        rows = self.table(df).orderBy("feature", "bin_idx").collect()  # a row for each bin
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", newline="") as f:
            csv.writer(f).writerows([["feature", "bin_idx", "bin_label", "woe", "points"], *rows])
        return path

    def about(self, df: DataFrame) -> dict:
        """Scale, numbers of variables and bins, and the points' range of each variable."""
        stats = [r.asDict() for r in self.summary(df).collect()]
        return {"base_score": self.base_score, "pdo": self.pdo, "base_odds": self.base_odds, "factor": self.factor, "offset": self.offset, "n_variables": len(self.points), "n_bins": sum(map(len, self.points.values())), "variable_stats": stats}

    def summary(self, df: DataFrame) -> DataFrame:
        out = self.table(df).groupBy("feature").agg(F.min("points").alias("min_points"), F.max("points").alias("max_points"))
        return out.withColumn("range", F.col("max_points") - F.col("min_points")).orderBy(F.desc("range"), "feature")


def build_scorecard(df: DataFrame, target: str, features: list[str], n_bins: int = 5, weight: str | None = None, **scale) -> Scorecard:
    binner = WoeBinner(n_bins).fit(df, features=features, target=target, weight=weight)
    woe = binner.transform(df, return_type="woe")
    model = ModelTrainer("logistic").fit(woe, target, [f"{f}_bin" for f in binner.rules], weight)
    return Scorecard(**scale).fit(binner, model)


def points_column(coefficient: float, woe: Column, pdo: float = 20.0) -> Column:
    return -F.lit(coefficient) * woe * F.lit(pdo / math.log(2))


