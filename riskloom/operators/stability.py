"""Population stability: categorical, numeric, and from binned shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import ValidationError
from ..functions.basics import check_weights, col, numeric_columns, weight_column
from ..functions.quantiles import exact_quantiles, finite, weighted_quantiles

#: Shifts from which a feature is watched, and from which it alarms.
WARN, CRITICAL = 0.1, 0.25


def psi_level(psi: Column, warn: float = WARN, critical: float = CRITICAL) -> Column:
    return F.when(psi >= critical, "critical").when(psi >= warn, "warning").otherwise("normal")


def drift_level(psi: Column) -> Column:
    return F.when(psi < WARN, "Stable").when(psi < CRITICAL, "Moderate Shift").otherwise("Significant Shift")


def psi_categorical(expected: DataFrame, actual: DataFrame, column: str, smooth: float = 1e-4) -> DataFrame:
    """One row, psi: shares of each value, at least ``smooth``, over the values of either."""
    both = expected.select(col(column).alias("v"), F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(col(column).alias("v"), F.lit(0).alias("e"), F.lit(1).alias("a")))
    sums = both.groupBy("v").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    totals = both.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    part = lambda c: F.least(F.greatest(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"t{c}").cast("double")), F.lit(0.0)), F.lit(smooth)), F.lit(1.0))
    rows = sums.crossJoin(F.broadcast(totals)).select(part("e").alias("e"), part("a").alias("a"))  # one row
    return rows.agg(F.coalesce(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))), F.lit(0.0)).alias("psi"))


def numeric_edges(expected: DataFrame, actual: DataFrame, column: str, n_bins: int = 10, bin_type: str = "quantile", weight: str | None = None) -> list[float]:
    """Inner edges: quantiles of what is expected, or equal steps over both."""
    if bin_type == "uniform":
        x = finite(col(column))
        row = expected.select(x.alias("x")).unionByName(actual.select(x.alias("x"))).agg(F.min("x"), F.max("x")).first()
        if row[0] is None:
            raise ValidationError(f"{column} has no finite values")
        return [row[0] + (row[1] - row[0]) * k / n_bins for k in range(1, n_bins)]
    if bin_type != "quantile":
        raise ValidationError(f"no such bin type: {bin_type}")
    qs = [k / n_bins for k in range(1, n_bins)]
    if weight is None:
        found = exact_quantiles(expected, {"x": col(column)}, qs)["x"]
        if not found:
            raise ValidationError(f"{column} has no finite values")
        return found
    return weighted_quantiles(expected, column, weight, qs)


def _bin(column: str, edges: list[float]) -> Column:
    x = col(column).cast("double")
    out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int"))
    for k, e in enumerate(edges):
        out = out.when(x < e, k + 1)
    return out.otherwise(len(edges) + 1)


def psi_numeric(expected: DataFrame, actual: DataFrame, column: str, n_bins: int = 10, bin_type: str = "quantile", eps: float = 1e-10, expected_weight: str | None = None, actual_weight: str | None = None) -> DataFrame:
    """A row for each bin: bin, expected_pct, actual_pct, psi; rows without a number count in the totals.

    Bins that nothing falls in, as between equal edges, are there too.
    """
    check_weights(expected, expected_weight)
    check_weights(actual, actual_weight)
    edges = numeric_edges(expected, actual, column, n_bins, bin_type, expected_weight)
    side = lambda df, w, e: df.select(_bin(column, edges).alias("bin"), (weight_column(w) if e else F.lit(0.0)).alias("e"), (F.lit(0.0) if e else weight_column(w)).alias("a"))
    sums = side(expected, expected_weight, True).unionByName(side(actual, actual_weight, False)).groupBy("bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    every = W.partitionBy(F.lit(0))
    sums = sums.withColumns({"te": F.sum("e").over(every), "ta": F.sum("a").over(every)})
    bins = expected.sparkSession.range(1, len(edges) + 2).select(F.col("id").cast("int").alias("bin"))
    totals = sums.agg(F.max("te").alias("te"), F.max("ta").alias("ta"))
    rows = bins.join(sums.drop("te", "ta"), "bin", "left").crossJoin(F.broadcast(totals))  # one row
    rows = rows.select("bin", ((F.coalesce("e", F.lit(0.0)) + eps) / F.col("te")).alias("expected_pct"), ((F.coalesce("a", F.lit(0.0)) + eps) / F.col("ta")).alias("actual_pct"))
    return rows.withColumn("psi", (F.col("actual_pct") - F.col("expected_pct")) * F.ln(F.col("actual_pct") / F.col("expected_pct")))


def feature_psi(expected: DataFrame, actual: DataFrame, features: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """feature, psi, level, most shifted first. Both sides are scanned once for all features."""
    features = features or [f for f in numeric_columns(expected) if f in actual.columns]
    found = exact_quantiles(expected, {f: col(f) for f in features}, [k / n_bins for k in range(1, n_bins)])
    usable = {f: e for f, e in found.items() if e}
    each = lambda df, e: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _bin(f, x).alias("bin")) for f, x in usable.items()])).alias("p"), F.lit(float(e)).alias("e"), F.lit(float(not e)).alias("a")).select("p.*", "e", "a")
    sums = each(expected, True).unionByName(each(actual, False)).groupBy("feature", "bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    w = W.partitionBy("feature")
    sums = sums.withColumns({"te": F.sum("e").over(w), "ta": F.sum("a").over(w)}).where("bin is not null")
    pe, pa = (F.col("e") + 1e-10) / F.col("te"), (F.col("a") + 1e-10) / F.col("ta")
    out = sums.groupBy("feature").agg(F.sum((pa - pe) * F.ln(pa / pe)).alias("psi"))
    return out.withColumn("level", drift_level(F.col("psi"))).orderBy(F.desc("psi"), "feature")


def bin_distribution(sums: DataFrame, by: list[str]) -> DataFrame:
    """Adds pct, each bin's share of its feature's (and group's) weight, to a cube."""
    return sums.withColumn("pct", F.try_divide(F.col("w"), F.sum("w").over(W.partitionBy(*by))))


def psi_from_shares(expected: DataFrame, actual: DataFrame, keys: list[str], include_missing: bool = False, include_special: bool = False, eps: float = 1e-6) -> DataFrame:
    """psi for each key of ``actual``: feature, bin_idx, pct against the same of ``expected``.

    Missing and special bins are left out without scaling the rest up; shares are at least
    ``eps``. keys: columns of ``actual`` that name a distribution, feature among them.
    """
    ok = F.lit(True)
    if not include_missing:
        ok &= F.col("bin_idx") != -1
    if not include_special:
        ok &= F.col("bin_idx") > -3
    e = expected.where(ok).select("feature", "bin_idx", F.col("pct").alias("e"))
    a = actual.where(ok).select(*keys, "bin_idx", F.col("pct").alias("a"))
    # features x groups x bins rows: every group meets every expected bin
    every = actual.select(*keys).distinct().join(e, "feature").select(*keys, "bin_idx").unionByName(a.select(*keys, "bin_idx")).distinct()
    rows = every.join(e, ["feature", "bin_idx"], "left").join(a, [*keys, "bin_idx"], "left")
    x, y = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(eps)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(eps))
    return rows.groupBy(*keys).agg(F.sum((y - x) * F.ln(y / x)).alias("psi"))
