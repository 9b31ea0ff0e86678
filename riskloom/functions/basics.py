"""Missing values, guarded division, weights, column roles and the estimator protocol."""

from __future__ import annotations

import functools
import logging
import math
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import DataTypeError, NotFittedError, ValidationError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
LOG = logging.getLogger("riskloom")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def number(name: str) -> Column:
    """The column as double with NaN as null."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = col(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, NUMERIC + NESTED)]


def fresh(names, name: str) -> str:
    """A column name that none of the names is, whatever their case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def require(df: DataFrame, *names: str | None) -> None:
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValidationError(f"columns not found: {missing}")
    nested = [n for n in names if n is not None and isinstance(df.schema[n].dataType, NESTED)]
    if nested:
        raise DataTypeError(f"nested columns cannot be analysed: {nested}")


def fitting(values: Iterable, df: DataFrame, name: str) -> list:
    """The user's special or missing values that the column's type can hold."""
    is_number = isinstance(df.schema[name].dataType, NUMERIC)
    out = []
    for v in values or ():
        if isinstance(v, bool) or v is None:
            continue
        if isinstance(v, (int, float)) == is_number and not (isinstance(v, float) and math.isnan(v)):
            out.append(float(v) if is_number else str(v))
    return out


def plain(value):
    """The value as JSON can hold it: numbers that are not finite are null, other things their text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return str(value)


def safe_divide(n: Column, d: Column, eps: float = 1e-10, fill: float = 0.0) -> Column:
    return F.when(F.abs(d) < eps, F.lit(fill)).otherwise(F.try_divide(n, d))


def share(n: Column, d: Column) -> Column:
    """n / d, null where d is 0 or null."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def weight_column(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else col(weight).cast("double")


def check_weights(df: DataFrame, weight: str | None) -> None:
    """Weights must be finite and above 0."""
    if weight is None:
        return
    require(df, weight)
    w = col(weight).cast("double")
    bad = df.agg(F.max(F.coalesce(w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf")), F.lit(True))).alias("b")).first()["b"]
    if bad:
        raise ValidationError("weights must be finite and above 0")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows in which both are finite; null if there are none."""
    v, w = value.cast("double"), weight.cast("double")
    ok = v.isNotNull() & w.isNotNull() & ~F.isnan(v) & ~F.isnan(w) & (F.abs(v) != float("inf")) & (F.abs(w) != float("inf"))
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def validate_binary_target(df: DataFrame, target: str) -> None:
    require(df, target)
    found = df.agg(F.count_distinct(col(target)).alias("k"), F.max(is_missing(df, target)).alias("m")).first()
    if found["m"]:
        raise ValidationError(f"{target} has missing values")
    if found["k"] != 2:
        raise ValidationError(f"{target} has {found['k']} values, not 2")


def validate_no_nulls(df: DataFrame, names: list[str]) -> None:
    row = df.agg(*[F.max(is_missing(df, n)).alias(n) for n in names]).first()
    bad = [n for n in names if row[n]]
    if bad:
        raise ValidationError(f"missing values in {bad}")


def ensure_dataframe(data, spark: SparkSession | None = None) -> DataFrame:
    """Spark frames as they are; pandas frames and dicts of columns through Arrow."""
    if isinstance(data, DataFrame):
        return data
    import pandas as pd

    spark = spark or SparkSession.getActiveSession()
    if isinstance(data, dict):
        data = pd.DataFrame(data)
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    raise DataTypeError(f"cannot read {type(data).__name__} as a table")


def group_keys(df: DataFrame, group: str) -> list:
    """Sorted keys of a grouping column (periods or segments, not records)."""
    return [r[0] for r in df.select(col(group)).where(col(group).isNotNull()).distinct().orderBy(col(group)).collect()]


@dataclass
class Roles:
    """What columns are for; those with a role are never features."""

    target: str | None = None
    sample: str | None = None
    date: str | None = None
    weight: str | None = None
    segment: str | list[str] | None = None
    temporal: str | None = None
    benchmark: str | list[str] | None = None
    excluded: list[str] = field(default_factory=list)

    @staticmethod
    def each(role: str | list[str] | None) -> list[str]:
        """The columns of a role that may have several."""
        return [role] if isinstance(role, str) else list(role or ())

    def features(self, df: DataFrame, numeric_only: bool = False) -> list[str]:
        taken = {self.target, self.sample, self.date, self.weight, self.temporal, *self.each(self.segment), *self.each(self.benchmark), *self.excluded}
        names = numeric_columns(df) if numeric_only else [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]
        return [n for n in names if n not in taken]


def validate_fitted(method):
    """A method that may only be called once its object is fitted."""

    @functools.wraps(method)
    def checked(self, *a, **b):
        if not getattr(self, "fitted", False):
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        return method(self, *a, **b)

    return checked


def get_logger(name: str = "riskloom", level: int = logging.INFO) -> logging.Logger:
    """The named logger, with one handler to stderr that replaces what its encoding cannot write."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = _SafeHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log


class _SafeHandler(logging.StreamHandler):
    def emit(self, record: logging.LogRecord) -> None:
        encoding = getattr(self.stream, "encoding", None) or "utf-8"
        text = self.format(record).encode(encoding, "replace").decode(encoding)
        self.stream.write(text + self.terminator)
        self.flush()


class Transformer:
    """fit(df, ...) learns rules, transform(df) applies them as projections."""

    fitted = False

    def fit(self, df, **roles):
        self._fit(ensure_dataframe(df), **roles)
        self.fitted = True
        return self

    @validate_fitted
    def transform(self, df, **how) -> DataFrame:
        return self._transform(ensure_dataframe(df), **how)

    def fit_transform(self, df, how: dict | None = None, **roles) -> DataFrame:
        return self.fit(df, **roles).transform(df, **(how or {}))


def time_it(f):
    """Logs how long a call takes; of lazy results, how long their plans take to build."""

    @functools.wraps(f)
    def timed(*a, **b):
        began = time.perf_counter()
        try:
            return f(*a, **b)
        finally:
            LOG.info("%s took %.3f s", f.__qualname__, time.perf_counter() - began)

    return timed
