"""Feature generation, selection and importance."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import ValidationError
from ..functions.basics import Transformer, col, number, numeric_columns, require, validate_binary_target
from ..functions.quantiles import running
from .binning import WoeBinner, apply_binning, calculate_bins, index_columns, quantile_cuts

EPS = 1e-10


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """All products of up to ``degree`` columns: a, a^2, a b, ..."""
    pick = combinations if interaction_only else combinations_with_replacement
    out = []
    for d in range(1, degree + 1):
        for group in pick(columns, d):
            counts = {c: group.count(c) for c in dict.fromkeys(group)}
            value = F.lit(1.0)
            for c, k in counts.items():
                for _ in range(k):
                    value = value * col(c).cast("double")
            out.append(value.alias(" ".join(c if k == 1 else f"{c}^{k}" for c, k in counts.items())))
    return df.select("*", *out[len(columns) :])


def interaction(df: DataFrame, columns: list[str]) -> DataFrame:
    return polynomial(df, columns, 2, True)


def ratio(df: DataFrame, columns: list[str] | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """a / (|b| + 1e-10) as a_div_b, for given pairs, all pairs of given columns, or of the first 10 numeric ones."""
    pairs = pairs or list(combinations(columns or numeric_columns(df)[:10], 2))
    return df.select("*", *[(col(a).cast("double") / (F.abs(col(b).cast("double")) + EPS)).alias(f"{a}_div_{b}") for a, b in pairs])


def log(df: DataFrame, columns: list[str], base: str = "e", signed: bool = True) -> DataFrame:
    """sign(x) ln(1 + |x|), or plain logarithms (null where there is none), in base e, 2 or 10."""
    names = {"e": ("_log", 1.0), "2": ("_log2", float(np.log(2))), "10": ("_log10", float(np.log(10)))}
    if str(base) not in names:
        raise ValidationError(f"no such base: {base}")
    suffix, unit = names[str(base)]
    x = lambda c: col(c).cast("double")
    value = lambda c: (F.signum(x(c)) * F.log1p(F.abs(x(c))) if signed else F.ln(F.when(x(c) > 0, x(c)))) / unit
    return df.select("*", *[value(c).alias(f"{c}{suffix}") for c in columns])


def binned(df: DataFrame, columns: list[str], n_bins: int = 5, method: str = "quantile") -> DataFrame:
    for c in columns:
        df = apply_binning(df, c, calculate_bins(df, c, n_bins, method)).withColumnRenamed(f"{c}_bin", f"{c}_binned")
    return df


class FeatureGenerator(Transformer):
    def __init__(self, degree: int | None = 2, interactions: bool = False, ratios: bool = False, logs: bool = False, bins: int | None = None):
        self.degree, self.interactions, self.ratios, self.logs, self.bins = degree, interactions, ratios, logs, bins

    def _fit(self, df: DataFrame, columns: list[str] | None = None) -> None:
        self.columns, self.named = columns or numeric_columns(df), bool(columns)
        self.edges = {c: calculate_bins(df, c, self.bins) for c in self.columns} if self.bins else {}

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, *self.columns)
        if self.degree:
            df = polynomial(df, self.columns, self.degree)
        elif self.interactions:
            df = interaction(df, self.columns)
        if self.ratios:
            df = ratio(df, self.columns if self.named else self.columns[:10])
        if self.logs:
            df = log(df, self.columns)
        for c, e in self.edges.items():
            df = apply_binning(df, c, e).withColumnRenamed(f"{c}_bin", f"{c}_binned")
        return df


def generate_features(df: DataFrame, columns: list[str] | None = None, **kinds) -> DataFrame:
    return FeatureGenerator(**kinds).fit_transform(df, columns=columns)


# selection


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, variance (n - 1)."""
    each = df.agg(*[F.var_samp(number(c)).alias(f"v{k}") for k, c in enumerate(columns)])
    return each.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{k}").alias("variance")) for k, c in enumerate(columns)])).alias("p")).select("p.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of each pair, from sums in one pass around the means; missing counts as 0, constants give null."""
    x = [F.coalesce(number(c), F.lit(0.0)) for c in columns]
    mean = df.agg(*[F.avg(v) for v in x]).first()
    d = [v - F.lit(m if m is not None else 0.0) for v, m in zip(x, mean, strict=True)]
    n = len(columns)
    sums = df.agg(*[F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)])
    pairs = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.try_divide(F.col(f"s{i}_{j}"), F.sqrt(F.col(f"s{i}_{i}") * F.col(f"s{j}_{j}"))).alias("r")) for i in range(n) for j in range(i + 1, n)]
    return sums.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def uncorrelated(df: DataFrame, columns: list[str], threshold: float = 0.95) -> tuple[list[str], list[str]]:
    """Kept and dropped: of a pair above the threshold the one of less variance goes."""
    if len(columns) < 2:
        return list(columns), []
    x = [F.coalesce(number(c), F.lit(0.0)) for c in columns]
    spread = dict(zip(columns, df.agg(*[F.var_pop(v) for v in x]).first(), strict=True))
    r = {(p["a"], p["b"]): p["r"] for p in correlations(df, columns).collect()}
    dropped: list[str] = []
    for i, a in enumerate(columns):  # a dropped column still drops its weaker partners
        for b in columns[i + 1 :]:
            if r[a, b] is not None and abs(r[a, b]) > threshold:
                out = a if spread[a] < spread[b] else b
                if out not in dropped:
                    dropped.append(out)
    return [c for c in columns if c not in dropped], dropped


def remove_multicollinearity(df: DataFrame, threshold: float = 0.95, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    dropped = uncorrelated(df, columns or numeric_columns(df), threshold)[1]
    return df.drop(*dropped), dropped


def iv_selection(df: DataFrame, target: str, columns: list[str], least: float = 0.02, n: int | None = None, n_bins: int = 10, weight: str | None = None) -> list[str]:
    total = WoeBinner(n_bins).fit(df, features=columns, target=target, weight=weight).total_iv()
    kept = sorted((f for f, v in total.items() if v >= least), key=lambda f: (-total[f], f))
    return kept[:n] if n else kept


def mutual_information(df: DataFrame, target: str, columns: list[str], n_bins: int = 10) -> DataFrame:
    """feature, mi (nats) between quantile bins and the target, greatest first."""
    from .binning import BinRule

    cuts = quantile_cuts(df, columns, n_bins)
    sums = index_columns(df, {c: BinRule(c, True, cuts=cuts[c]) for c in columns}, [col(target).alias("y")]).groupBy("feature", "bin_idx", "y").agg(F.count(F.lit(1)).alias("n"))
    share = lambda *by: F.sum("n").over(W.partitionBy("feature", *by))
    terms = sums.select("feature", (F.col("n") / share() * F.ln(F.col("n") * share() / (share("bin_idx") * share("y")))).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("mi")).orderBy(F.desc("mi"), "feature")


#: Values of one block within which neighbours are looked up.
BLOCK_VALUES = 100_000


def digamma(x: Column) -> Column:
    """For x >= 1, by its series at x + 6."""
    y = x + 6
    z = 1 / (y * y)
    series = z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z * (F.lit(1 / 252) - z * (F.lit(1 / 240) - z * F.lit(1 / 132)))))
    return F.ln(y) - 1 / (2 * y) - series - sum((1 / (x + k) for k in range(1, 6)), 1 / x)


def neighbour_information(df: DataFrame, target: str, columns: list[str], k: int = 3, block: int = BLOCK_VALUES) -> DataFrame:
    """feature, mi (nats) between numeric columns and a target's classes by nearest neighbours, greatest first.

    A value's radius is the distance to its k-th neighbour in its class; mi is digamma(n) + mean
    digamma(k) - mean digamma(size of the class) - mean digamma(values closer than the radius),
    0 at least. Values count without noise, so where k neighbours are equal the radius is 0 and
    equal values are counted. Missing values are 0, rows without a target and classes of one
    row do not count, classes of at most k rows take all their rows.

    Rows become distinct values with their numbers, which are stored, as are the ends of radii: both
    are read several times. Neighbours are found in blocks of ranks, of
    which each has the k values beyond its ends; numbers of closer values are differences of
    running sums over ranges, in which the ends of radii stand among the values.
    """
    if block <= k:
        raise ValidationError("a block holds more values than neighbours")
    x = lambda c: F.coalesce(F.when(~F.isnan(number(c)), number(c)), F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (x(c) + 0.0).alias("x")) for c in columns]))
    from .models import _stored

    rows = df.where(col(target).isNotNull()).select(col(target).cast("string").alias("y"), each.alias("p")).groupBy("p.feature", "y", "p.x").agg(F.count(F.lit(1)).alias("c"))
    rows = _stored(rows)
    sizes = rows.groupBy("feature", "y").agg(F.sum("c").alias("size")).where("size > 1")
    rows = rows.join(sizes, ["feature", "y"])
    ranked = running(rows.withColumn("one", F.lit(1)), "x", {"rank": "one"}, within=("feature", "y")).withColumn("rank", F.col("rank") - 1).drop("one")
    home, place = F.expr(f"rank div {block}"), F.col("rank") % block
    beside = F.filter(F.array(home, F.when(place < k, home - 1), F.when(place >= block - k, home + 1)), lambda b: b.isNotNull())
    dealt = ranked.withColumn("home", home).withColumn("block", F.explode(beside))
    order = W.partitionBy("feature", "y", "block").orderBy("rank")
    near = F.array(*[F.struct(F.abs(F.col("x") - step(F.col("x"), j).over(order)).alias("d"), step(F.col("c"), j).over(order).alias("c"), step(F.col("x"), j).over(order).alias("x")) for j in range(1, k + 1) for step in (F.lag, F.lead)])
    found = dealt.withColumn("near", F.array_sort(F.filter(near, lambda p: p["d"].isNotNull()))).where("block = home")
    found = found.withColumn("k", F.least(F.lit(k), F.col("size") - 1))
    start = F.struct((F.col("c") - 1).alias("n"), F.lit(0.0).alias("r"))
    reach = F.aggregate("near", start, lambda s, p: F.when(s["n"] >= F.col("k"), s).otherwise(F.struct((s["n"] + p["c"]).alias("n"), p["d"].alias("r"))), lambda s: s["r"])
    found = found.withColumn("r", reach)
    end = lambda side, other: F.coalesce(F.get(F.filter("near", lambda p: (p["d"] == F.col("r")) & side(p["x"])), 0)["x"], other)
    low = F.when(F.col("r") == 0, F.col("x")).otherwise(end(lambda v: v < F.col("x"), F.col("x") - F.col("r")))
    high = F.when(F.col("r") == 0, F.col("x")).otherwise(end(lambda v: v > F.col("x"), F.col("x") + F.col("r")))
    # ends of radii: those of 0 take the values there in, others do not; at equal places "below" stands before values, "upto" after them
    below, value, upto = 0, 1, 2
    inside = F.col("r") == 0
    ends = F.array(F.struct(low.alias("at"), F.when(inside, below).otherwise(upto).alias("tag"), F.lit(-1).alias("sign")), F.struct(high.alias("at"), F.when(inside, upto).otherwise(below).alias("tag"), F.lit(1).alias("sign")))
    asked = found.select("feature", "y", "x", "c", "k", "size", F.explode(ends).alias("e")).select("feature", "y", "x", "c", "k", "size", "e.*", F.lit(0).cast("bigint").alias("n"))
    none = F.lit(None)
    values = rows.groupBy("feature", "x").agg(F.sum("c").alias("n")).select("feature", none.cast("string").alias("y"), none.cast("double").alias("x"), none.cast("bigint").alias("c"), none.cast("bigint").alias("k"), none.cast("bigint").alias("size"), F.col("x").alias("at"), F.lit(value).alias("tag"), F.lit(0).alias("sign"), "n")
    placed = running(_stored(values.unionByName(asked)), "at", {"upto": "n"}, ties=("tag",), within=("feature",)).where("sign <> 0")
    terms = placed.groupBy("feature", "y", "x", "c", "k", "size").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    mean = lambda e: F.sum(F.col("c") * digamma(e.cast("double"))) / F.sum("c")
    mi = digamma(F.sum("c").cast("double")) + mean(F.col("k")) - mean(F.col("size")) - mean(F.greatest(F.col("m"), F.lit(1)))
    return terms.groupBy("feature").agg(F.greatest(F.lit(0.0), mi).alias("mi")).orderBy(F.desc("mi"), "feature")


def recursive_elimination(df: DataFrame, target: str, columns: list[str], n: int) -> list[str]:
    """Drops the feature of least absolute coefficient of a logistic model until n are left."""
    from . import newton
    from .models import _stored

    validate_binary_target(df, target)
    rows = _stored(newton.table(df, col(target), F.lit(1.0), [col(c) for c in columns]))
    left, start = list(range(len(columns))), None
    while len(left) > n:
        b = newton.fit(rows, len(columns), [newton.Wanted(1.0, left, start=start)])[0]
        out = min(range(len(left)), key=lambda k: (abs(b[k + 1]), columns[left[k]]))
        left, start = left[:out] + left[out + 1 :], np.delete(b, out + 1)  # the next search starts where this one ended
    return [columns[k] for k in left]


def select_features(df: DataFrame, method: str = "iv", target: str | None = None, columns: list[str] | None = None, threshold: float | None = None, n: int | None = None) -> list[str]:
    """variance, correlation, iv, mutual_info (by nearest neighbours), rfe (or recursive)."""
    columns = columns or [c for c in numeric_columns(df) if c != target]
    if method in ("iv", "mutual_info", "rfe", "recursive") and not target:
        raise ValidationError(f"{method} needs a target")
    if method == "variance":
        limit = 0.01 if threshold is None else threshold
        found = {r["feature"]: r["variance"] for r in variances(df, columns).collect()}
        return [c for c in columns if found[c] is not None and found[c] > limit]
    if method == "correlation":
        return uncorrelated(df, columns, 0.95 if threshold is None else threshold)[0]
    if method == "iv":
        return iv_selection(df, target, columns, 0.02 if threshold is None else threshold, n)
    if method == "mutual_info":
        return [r["feature"] for r in neighbour_information(df, target, columns).limit(n or len(columns)).collect()]
    if method in ("rfe", "recursive"):
        return recursive_elimination(df, target, columns, n or max(1, len(columns) // 2))
    raise ValidationError(f"no such method: {method}")


class FeatureSelector(Transformer):
    def __init__(self, method: str = "iv", threshold: float | None = None, n: int | None = None):
        self.method, self.threshold, self.n = method, threshold, n

    def _fit(self, df: DataFrame, target: str | None = None, columns: list[str] | None = None) -> None:
        self.selected = select_features(df, self.method, target, columns, self.threshold, self.n)

    def _transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        return df.select(*[col(c) for c in [*keep, *self.selected] if c in df.columns])


# importance


def importance_summary(table: DataFrame, top: int | None = None) -> DataFrame:
    """rank, feature, importance, share and cumulative share, in percent."""
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.desc("importance"), "feature")
    total = F.sum("importance").over(every)
    upto = F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, 0))
    out = table.select(F.row_number().over(order).alias("rank"), "feature", "importance", (100 * F.try_divide(F.col("importance"), total)).alias("pct"), (100 * F.try_divide(upto, total)).alias("cum_pct"))
    return out.where(F.col("rank") <= top) if top else out


#: Relative difference below which importances are equal: sums that are added in another order differ by less.
EQUAL = 1e-9


def average_rank(table: DataFrame, c: str, name: str) -> DataFrame:
    """feature and its rank from the greatest, ties sharing their mean; values with no gap between them above EQUAL are ties."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(c), "feature")
    before = F.lag(c).over(order)
    apart = F.coalesce(F.when(F.col(c).isNull(), before.isNotNull()).otherwise(before - F.col(c) > EQUAL * F.abs(F.col(c))).cast("int"), F.lit(0))
    placed = table.select("feature", F.row_number().over(order).alias("place"), apart.alias("apart"))
    tied = placed.select("feature", "place", F.sum("apart").over(W.partitionBy(F.lit(0)).orderBy("place")).alias("tie"))
    return tied.select("feature", F.avg("place").over(W.partitionBy("tie")).alias(name))


def rank_features(first: DataFrame, second: DataFrame) -> DataFrame:
    """feature, the rank in each table of importances, and the mean of both."""
    a = average_rank(first, "importance", "rank_a")
    b = average_rank(second, "importance", "rank_b")
    return a.join(b, "feature", "left").withColumn("mean_rank", (F.col("rank_a") + F.coalesce("rank_b", "rank_a")) / 2)
