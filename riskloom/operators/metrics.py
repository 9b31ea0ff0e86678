"""Classification, ranking and regression metrics, weighted or not, overall or by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basics import check_weights, col, fresh, weight_column
from ..functions.quantiles import exact_quantiles, running, weighted_quantiles


def _ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def confusion(df: DataFrame, target: str, predicted: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """tp, tn, fp, fn, accuracy, precision, recall, f1 (0 where a denominator is 0)."""
    check_weights(df, weight)
    w, y, p = weight_column(weight), col(target).cast("int"), col(predicted).cast("int")
    cell = lambda a, b: F.coalesce(F.sum(F.when((y == a) & (p == b), w)), F.lit(0.0))
    sums = df.groupBy(*map(col, by)).agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))
    c = F.col
    rows = sums.withColumns({"accuracy": _ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": _ratio(c("tp"), c("tp") + c("fp")), "recall": _ratio(c("tp"), c("tp") + c("fn"))})
    return rows.withColumn("f1", _ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def score_groups(df: DataFrame, target: str, score: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """Sums of both classes for each score: ties are one group, and rows shrink before they are ordered."""
    w, y = weight_column(weight), col(target).cast("double")
    return df.where(col(score).isNotNull()).groupBy(*map(col, by), col(score).cast("double").alias("score")).agg(F.sum(w * y).alias("bad"), F.sum(w * (1 - y)).alias("good"))


def ks_auc(df: DataFrame, target: str, score: str, weight: str | None = None, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """ks, ks_threshold, auc, gini; with one class only 0, 0, 0.5 and 0.

    The gap is taken at the ends of tied scores, from the highest score down, and of equal
    gaps the first counts. Running sums go through ranges of the score.
    """
    check_weights(df, weight)
    sums = score_groups(df, target, score, weight, by)
    upto = running(sums, "score", {"cb": "bad", "cg": "good"}, descending=True, ranges=ranges, within=tuple(by))
    totals = sums.groupBy(*by).agg(F.sum("bad").alias("tb"), F.sum("good").alias("tg"))
    # without groups: one row; with groups: a row for each, joined by key
    rows = upto.join(totals, list(by)) if by else upto.crossJoin(F.broadcast(totals))
    c = F.col
    gap = F.abs(F.try_divide(c("cb"), c("tb")) - F.try_divide(c("cg"), c("tg")))
    area = F.try_divide(c("bad") * ((c("tg") - c("cg")) + c("good") / 2), c("tb") * c("tg"))
    out = rows.withColumns({"gap": F.round(gap, 14), "area": area}).groupBy(*by).agg(F.max(F.struct("gap", "score")).alias("m"), F.sum("area").alias("auc"), F.min("tb").alias("tb"), F.min("tg").alias("tg"))
    both = (c("tb") > 0) & (c("tg") > 0)
    out = out.select(*by, F.when(both, c("m.gap")).otherwise(0.0).alias("ks"), F.when(both, c("m.score")).otherwise(0.0).alias("ks_threshold"), F.when(both, c("auc")).otherwise(0.5).alias("auc"))
    return out.withColumn("gini", 2 * c("auc") - 1)


def all_metrics(df: DataFrame, target: str, score: str, threshold: float = 0.5, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """confusion at ``score >= threshold`` and ks_auc, in one row for each group."""
    label = fresh(df.columns, "_p")
    first = confusion(df.withColumn(label, (col(score) >= threshold).cast("int")), target, label, weight, by)
    second = ks_auc(df, target, score, weight, by)
    return first.join(second, list(by)) if by else first.crossJoin(F.broadcast(second))  # one row each


def lift(df: DataFrame, target: str, score: str, n_bins: int = 10, weight: str | None = None) -> DataFrame:
    """rank (0: highest mean score), bin, count, bad, bad_rate, cum_bad_rate, lift; bins closed on the left."""
    check_weights(df, weight)
    qs = [k / n_bins for k in range(1, n_bins)]
    edges = exact_quantiles(df, {"x": col(score)}, qs)["x"] if weight is None else weighted_quantiles(df, score, weight, qs)
    x, w = col(score).cast("double"), weight_column(weight)
    place = F.lit(0)
    for e in sorted(set(edges)):
        place = place + F.when(x >= e, 1).otherwise(0)
    sums = df.where(x.isNotNull() & ~F.isnan(x)).select(place.alias("bin"), w.alias("w"), (w * col(target)).alias("b"), (w * x).alias("s")).groupBy("bin").agg(F.sum("w").alias("count"), F.sum("b").alias("bad"), (F.sum("s") / F.sum("w")).alias("avg_score"))
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.desc("avg_score"))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rate = F.sum("bad").over(every) / F.sum("count").over(every)
    return sums.select(
        (F.row_number().over(order) - 1).alias("rank"), "bin", "count", "bad", F.try_divide("bad", "count").alias("bad_rate"), "avg_score",
        F.try_divide(F.sum("bad").over(upto), F.sum("count").over(upto)).alias("cum_bad_rate"), F.try_divide(F.col("bad") / F.col("count"), rate).alias("lift"),
    )


def regression(df: DataFrame, target: str, predicted: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """rmse, mae, r2."""
    check_weights(df, weight)
    w, y, e = weight_column(weight), col(target).cast("double"), col(target).cast("double") - col(predicted).cast("double")
    keys = list(map(col, by))
    name = fresh(df.columns, "_m")
    mean = df.groupBy(*keys).agg(F.try_divide(F.sum(w * y), F.sum(w)).alias(name))
    both = df.join(mean, list(by)) if by else df.crossJoin(F.broadcast(mean))  # without groups: one row
    sums = both.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * e * e).alias("sse"), F.sum(w * F.abs(e)).alias("sae"), F.sum(w * (y - F.col(name)) ** 2).alias("sst"))
    return sums.select(*by, F.sqrt(F.col("sse") / F.col("w")).alias("rmse"), (F.col("sae") / F.col("w")).alias("mae"), F.coalesce(1 - F.try_divide("sse", "sst"), F.lit(0.0)).alias("r2"))


def metrics_table(row: DataFrame) -> DataFrame:
    """One row of metrics as metric, value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]))
    return row.select(pairs.alias("p")).select("p.*")
