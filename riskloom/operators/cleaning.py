"""Cleaning, filling, scaling and the fitted preprocessor: projections over one-row statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..errors import ValidationError
from ..functions.basics import Transformer, check_weights, col, fitting, fresh, is_missing, numeric_columns, require, weight_column, weighted_mean
from ..functions.quantiles import exact_quantiles, finite, range_of, ranges_for, weighted_quantiles

EPS = 1e-10


def null_values(df: DataFrame, values: list, columns: list[str] | None = None) -> DataFrame:
    """NULL where a column equals one of the values that its type can hold."""
    out = {}
    for c in columns or df.columns:
        found = fitting(values, df, c)
        if found:
            out[c] = F.when(~F.coalesce(col(c).isin(found), F.lit(False)), col(c))
    return df.withColumns(out)


def fill_value(df: DataFrame, value, columns: list[str] | None = None) -> DataFrame:
    """NULL, but not NaN, becomes the value in columns of its type."""
    names = [c for c in columns or df.columns if fitting([value], df, c)]
    return df.withColumns({c: F.coalesce(col(c), F.lit(value).cast(df.schema[c].dataType)) for c in names})


def _towards(w, order: list[str], backward: bool):
    """The rows up to this one, from the end that values come from: a frame that grows takes one step a row, one that shrinks begins anew at each."""
    return w.orderBy(*[col(c).desc() if backward else col(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)


def fill_ordered(df: DataFrame, columns: list[str], order: list[str], backward: bool = False, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """The previous (or next) value that is not NULL, in an explicit order and within groups if given.

    Without groups, rows are dealt in ranges of the first order column; what a range
    hands on to the next comes from a table of one row a range.
    """
    if not by:
        part = fresh(df.columns, "_range")
        ends_of = [fresh(df.columns, f"_end{k}") for k in range(len(columns))]
        df = df.withColumn(part, range_of(df, order[0], ranges or ranges_for(df.count())))
        way = W.partitionBy(F.lit(0)).orderBy(F.desc(part) if backward else part).rowsBetween(W.unboundedPreceding, -1)
        ends = df.groupBy(part).agg(*[(F.min_by if backward else F.max_by)(col(c), F.when(col(c).isNotNull(), F.struct(*map(col, order)))).alias(e) for c, e in zip(columns, ends_of, strict=True)])
        ends = ends.select(part, *[F.last(e, ignorenulls=True).over(way).alias(e) for e in ends_of])
        own = _towards(W.partitionBy(part), order, backward)
        out = df.join(F.broadcast(ends), part)  # one row a range
        filled = {c: F.coalesce(F.last(col(c), ignorenulls=True).over(own), F.col(e)) for c, e in zip(columns, ends_of, strict=True)}
        return out.withColumns(filled).drop(part, *ends_of)
    w = _towards(W.partitionBy(*map(col, by)), order, backward)
    return df.withColumns({c: F.last(col(c), ignorenulls=True).over(w) for c in columns})


def fill_statistic(df: DataFrame, columns: list[str], statistic: str) -> DataFrame:
    """NULL becomes the column's mean, median or zero (strings: empty)."""
    if statistic == "zero":
        zero = {c: F.coalesce(col(c), F.lit("") if isinstance(df.schema[c].dataType, T.StringType) else F.lit(0).cast(df.schema[c].dataType)) for c in columns}
        return df.withColumns(zero)
    numeric = [c for c in columns if c in numeric_columns(df)]
    if statistic == "mean":
        row = df.agg(*[F.avg(finite(col(c))).alias(c) for c in numeric]).first()
        found = {c: row[c] for c in numeric}
    elif statistic == "median":
        found = {c: v[0] if v else None for c, v in exact_quantiles(df, {c: col(c) for c in numeric}, [0.5]).items()}
    else:
        raise ValidationError(f"no such statistic: {statistic}")
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in found.items() if v is not None})


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    ok = F.lit(True)
    for c in columns or df.columns:
        ok &= col(c).isNotNull()
    return df.where(ok)


def clean_data(df: DataFrame, strategy: str = "drop", custom_null_values: list = (), fill=None, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Sentinels to NULL, then a value or a strategy: forward, backward, mean, median, zero, drop."""
    names = columns or df.columns
    if custom_null_values:
        df = null_values(df, custom_null_values, names)
    if fill is not None:
        return fill_value(df, fill, names)
    if strategy in ("forward", "backward"):
        if not order:
            raise ValidationError("filling forward or backward needs an order")
        return fill_ordered(df, [c for c in names if c not in order], order, strategy == "backward")
    if strategy == "drop":
        return drop_nulls(df, names)
    return fill_statistic(df, names, strategy)


def _scaled(x: Column, method: str, s: dict) -> Column:
    if method == "minmax":
        return (x - s["min"]) / (s["max"] - s["min"] + EPS)
    if method == "zscore":
        return (x - s["mean"]) / (s["std"] + EPS)
    if method == "robust":
        return (x - s["median"]) / ((s["q75"] - s["q25"]) or 1.0)
    raise ValidationError(f"no such scaling: {method}")


def statistics(df: DataFrame, columns: list[str], exclude: list = ()) -> dict[str, dict]:
    """mean, std (n - 1), min, max, median, q25, q75 of each column's finite values but the excluded."""
    x = {c: finite(F.when(~F.coalesce(col(c).isin(fitting(exclude, df, c)), F.lit(False)), col(c))) for c in columns}
    row = df.agg(*[f(x[c]).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]).first()
    q = exact_quantiles(df, x, [0.25, 0.5, 0.75])
    out = {}
    for k, c in enumerate(columns):
        a, m, b = q[c] or (None, None, None)
        out[c] = {n: row[f"{n}{k}"] for n in ("mean", "std", "min", "max")} | {"q25": a, "median": m, "q75": b}
    return out


def clip_outliers(df: DataFrame, columns: list[str], p: float = 0.01) -> DataFrame:
    found = exact_quantiles(df, {c: col(c) for c in columns}, [p, 1 - p])
    return df.withColumns({c: F.least(F.greatest(col(c).cast("double"), F.lit(v[0])), F.lit(v[1])) for c, v in found.items() if v})


def normalize_data(df: DataFrame, columns: list[str], method: str = "minmax", clip: bool = False, p: float = 0.01) -> DataFrame:
    if clip:
        df = clip_outliers(df, columns, p)
    s = statistics(df, columns)
    return df.withColumns({c: _scaled(col(c).cast("double"), method, s[c]) for c in columns if s[c]["min"] is not None})


def preprocess_data(df: DataFrame, keep: list[str] | None = None, drop: list[str] = (), strategy: str | None = None, custom_null_values: list = (), fill=None, scale: str | None = None, order: list[str] | None = None) -> DataFrame:
    df = df.select(*[col(c) for c in keep or df.columns if c not in drop])
    if strategy or custom_null_values or fill is not None:
        df = clean_data(df, strategy or "zero", custom_null_values, fill, order=order)
    return normalize_data(df, numeric_columns(df), scale) if scale else df


class Preprocessor(Transformer):
    """Sentinels to NULL, imputation (mean, median, zero or keep) and scaling by fit-time statistics."""

    def __init__(self, impute: str = "median", scale: str | None = None, special_values: list = ()):
        if impute not in ("mean", "median", "zero", "keep"):
            raise ValidationError(f"no such imputation: {impute}")
        if scale not in (None, "minmax", "zscore", "robust"):
            raise ValidationError(f"no such scaling: {scale}")
        self.impute, self.scale, self.special_values = impute, scale, list(special_values or ())
        self.stats: dict[str, dict] = {}

    def _fit(self, df: DataFrame, columns: list[str] | None = None, weight: str | None = None) -> None:
        columns = [c for c in columns or numeric_columns(df) if c != weight]
        require(df, weight, *columns)
        if weight is None:
            self.stats = statistics(df, columns, self.special_values)
        else:
            check_weights(df, weight)
            self.stats = self._weighted(df, columns, weight)
        for s in self.stats.values():
            s["std"] = s["std"] or 1.0

    def _weighted(self, df: DataFrame, columns: list[str], weight: str) -> dict:
        """Weighted mean, population deviation and quantiles; sentinels left out as without weights."""
        w = weight_column(weight)
        x = {c: finite(F.when(~F.coalesce(col(c).isin(fitting(self.special_values, df, c)), F.lit(False)), col(c))) for c in columns}
        row = df.agg(*[e.alias(f"{n}{k}") for k, c in enumerate(columns) for n, e in (("m", weighted_mean(x[c], w)), ("q", weighted_mean(x[c] * x[c], w)), ("a", F.min(x[c])), ("b", F.max(x[c])))]).first()
        out = {}
        for k, c in enumerate(columns):
            mean = row[f"m{k}"]
            rows = df.select(x[c].alias("x"), w.alias("w"))
            q = [None] * 3 if mean is None else weighted_quantiles(rows, "x", "w", [0.25, 0.5, 0.75])
            std = None if mean is None else max(0.0, row[f"q{k}"] - mean * mean) ** 0.5
            out[c] = {"mean": mean, "std": std, "min": row[f"a{k}"], "max": row[f"b{k}"], "q25": q[0], "median": q[1], "q75": q[2]}
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, s in self.stats.items():
            require(df, c)
            special = fitting(self.special_values, df, c)
            x = F.when(~is_missing(df, c), col(c).cast("double"))
            if special:
                x = F.when(~x.isin(special), x)
            if self.impute != "keep":
                value = 0.0 if self.impute == "zero" else s[self.impute]
                if value is not None:
                    x = F.coalesce(x, F.lit(float(value)))
            out[c] = _scaled(x, self.scale, s) if self.scale and s["min"] is not None else x
        return df.withColumns(out)
