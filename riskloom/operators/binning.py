"""Binning with weight of evidence and information value.

Bins: 0..k-1 for values, -1 missing, -2 other (rare or unseen categories), -3-j the j-th
special value. Numeric bins are closed on the left. A special value wins over a missing
one. One cube of (feature, bin) sums serves WOE, IV, KS and stability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import ValidationError
from ..functions.basics import NUMERIC, Transformer, check_weights, col, fitting, require, weight_column
from ..functions.quantiles import exact_quantiles, finite, running, weighted_quantiles_of

MISSING, OTHER, FIRST_SPECIAL = -1, -2, -3
INF = float("inf")
#: Categories of one feature, each a bin and an entry of the rules.
MOST_CATEGORIES = 10_000


@dataclass
class BinRule:
    feature: str
    numeric: bool
    cuts: list[float] = field(default_factory=list)
    mapping: dict[str, int] = field(default_factory=dict)
    special: list = field(default_factory=list)
    missing: list = field(default_factory=list)
    woe: dict[int, float] = field(default_factory=dict)
    iv: dict[int, float] = field(default_factory=dict)

    @property
    def n_bins(self) -> int:
        return len(self.cuts) + 1 if self.numeric else len(self.mapping)

    def index(self) -> Column:
        """The bin of a row: one projection."""
        if self.numeric:
            x = col(self.feature).cast("double")
            out = F.when(x.isNull() | F.isnan(x), F.lit(MISSING))
        else:
            x = col(self.feature).cast("string")
            out = F.when(x.isNull(), F.lit(MISSING))
        for j, v in enumerate(self.special):
            out = out.when(x == F.lit(v), F.lit(FIRST_SPECIAL - j))
        for v in self.missing:
            out = out.when(x == F.lit(v), F.lit(MISSING))
        if self.numeric:
            for k, c in enumerate(self.cuts):
                out = out.when(x < F.lit(float(c)), F.lit(k))
            return out.otherwise(F.lit(len(self.cuts))).cast("int")
        if not self.mapping:
            return out.otherwise(F.lit(OTHER)).cast("int")
        return out.otherwise(F.coalesce(lookup(self.mapping, x), F.lit(OTHER))).cast("int")

    def label(self, k: int) -> str:
        if k == MISSING:
            return "Missing"
        if k == OTHER:
            return "Other"
        if k <= FIRST_SPECIAL:
            return f"Special_{self.special[FIRST_SPECIAL - k]:g}" if self.numeric else f"Special_{self.special[FIRST_SPECIAL - k]}"
        if not self.numeric:
            return f"{k:02d}_{next(v for v, i in self.mapping.items() if i == k)}"
        if not self.cuts:
            return "00_(-inf, inf)"
        if k == 0:
            return f"00_(-inf, {self.cuts[0]:.4g})"
        if k == len(self.cuts):
            return f"{k:02d}_[{self.cuts[-1]:.4g}, inf)"
        return f"{k:02d}_[{self.cuts[k - 1]:.4g}, {self.cuts[k]:.4g})"

    def indexes(self) -> list[int]:
        return [*(FIRST_SPECIAL - j for j in range(len(self.special) - 1, -1, -1)), OTHER, MISSING, *range(self.n_bins)]

    def labels(self) -> dict[int, str]:
        return {k: self.label(k) for k in self.indexes()}


def lookup(values: dict, key: Column) -> Column:
    """values[key], null where absent; the key expression is evaluated once."""
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def interpret_iv(iv: Column) -> Column:
    # fixed values: 0.02, 0.1, 0.3, 0.5
    return F.when(iv < 0.02, "unpredictive").when(iv < 0.1, "weak").when(iv < 0.3, "medium").when(iv < 0.5, "strong").otherwise("suspicious")


# cuts


def valid_number(df: DataFrame, feature: str, exclude: list) -> Column:
    x = finite(col(feature))
    values = fitting(exclude, df, feature)
    return F.when(~x.isin(values), x) if values else x


def inner(n_bins: int) -> list[float]:
    """Shares at which bins are cut: each the nearest double, so that a rank that is whole stays whole."""
    return [0.5] if n_bins <= 1 else [k / n_bins for k in range(1, n_bins)]


def quantile_cuts(df: DataFrame, features: list[str], n_bins: int, exclude: list = (), weight: str | None = None) -> dict[str, list[float]]:
    qs = inner(n_bins)
    if weight is None:
        found = exact_quantiles(df, {f: valid_number(df, f, exclude) for f in features}, qs)
    else:
        found = weighted_quantiles_of(df, {f: valid_number(df, f, exclude) for f in features}, weight_column(weight), qs)
    return {f: sorted(set(v)) if v else [] for f, v in found.items()}


def uniform_cuts(df: DataFrame, features: list[str], n_bins: int, exclude: list = ()) -> dict[str, list[float]]:
    row = df.agg(*[f(valid_number(df, c, exclude)).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).first() if features else {}
    out = {}
    for k, c in enumerate(features):
        a, b = row[f"a{k}"], row[f"b{k}"]
        step = 0 if a is None else (b - a) / max(1, n_bins)
        out[c] = [a + step * j for j in range(1, n_bins)] if step else []
    return out


def best_first_cuts(x: np.ndarray, n: np.ndarray, w: np.ndarray, bad: np.ndarray, leaves: int, least: int) -> list[float]:
    """Cuts of a tree on one variable that splits the leaf of greatest weighted Gini gain first.

    x: sorted distinct values with counts, weights and weights of class 1. Leaves keep
    ``least`` rows; thresholds lie midway; of equal gains the lower one wins.
    """
    cn, cw, cb = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, w, bad))
    impurity = lambda a, b: (cw[b] - cw[a]) - ((cb[b] - cb[a]) ** 2 + (cw[b] - cw[a] - cb[b] + cb[a]) ** 2) / np.maximum(cw[b] - cw[a], 1e-300)

    def best(a: int, b: int):
        k = np.arange(a + 1, b)
        k = k[(cn[k] - cn[a] >= least) & (cn[b] - cn[k] >= least)]
        if not len(k):
            return None
        gain = impurity(a, b) - impurity(a, k) - impurity(k, b)
        top = int(gain.argmax())
        return (float(gain[top]), a, int(k[top]), b) if gain[top] > 1e-12 * max(1.0, cw[-1]) else None

    return sorted(float((x[k - 1] + x[k]) / 2) for k in best_first(best, 0, len(x), leaves))


def best_first(best, a, b, leaves: int) -> list:
    """Where the leaf from a to b and those it leaves are split; best(a, b): gain, a, split, b, or None."""
    open_leaves, splits = [best(a, b)], []
    while len(splits) < leaves - 1:
        ready = [s for s in open_leaves if s]
        if not ready:
            break
        split = min(ready, key=lambda s: (-s[0], s[2]))
        open_leaves.remove(split)
        _, a, k, b = split
        splits.append(k)
        if len(splits) < leaves - 1:
            open_leaves += [best(a, k), best(k, b)]
    return splits


def best_first_cuts_of_table(sums: DataFrame, leaves: int, least: int) -> list[float]:
    """best_first_cuts for a table of x, n, w, bad of any size: a search is an aggregate over running sums."""
    rows = running(sums, "x", {"cn": "n", "cw": "w", "cb": "bad"}).select("cn", "cw", "cb", "x").persist()
    impurity = lambda w, bad, most: w - (bad * bad + (w - bad) * (w - bad)) / most(w, 1e-300)
    of = lambda w, bad: impurity(w, bad, lambda x, y: F.greatest(x, F.lit(y)))
    end = rows.agg(F.max(F.struct("cn", "cw", "cb", "x")).alias("r")).first()["r"]

    def best(a: tuple, b: tuple):
        inside = rows.where((F.col("cn") - a[0] >= least) & (F.lit(b[0]) - F.col("cn") >= least) & (F.col("cn") > a[0]) & (F.col("cn") < b[0]))
        gain = F.lit(impurity(b[1] - a[1], b[2] - a[2], max)) - of(F.col("cw") - a[1], F.col("cb") - a[2]) - of(F.lit(b[1]) - F.col("cw"), F.lit(b[2]) - F.col("cb"))
        top = inside.select(gain.alias("gain"), "cn", "cw", "cb", "x").agg(F.max_by(F.struct("gain", "cn", "cw", "cb", "x"), F.struct("gain", -F.col("x"))).alias("r")).first()["r"]
        return (top["gain"], a, tuple(top[1:]), b) if top and top["gain"] > 1e-12 * max(1.0, end["cw"]) else None

    try:
        if not end or end["cn"] < 2 * least:
            return []
        splits = best_first(best, (0.0, 0.0, 0.0), tuple(end), leaves)
        return sorted((k[3] + rows.where(F.col("cn") > k[0]).agg(F.min("x")).first()[0]) / 2 for k in splits)
    finally:
        rows.unpersist()


def tree_cuts(df: DataFrame, features: list[str], target: str, n_bins: int, exclude: list = (), weight: str | None = None, least: int = 5, grid: int = 100_000) -> dict[str, list[float]]:
    """Supervised cuts; rows are summed by value before a feature meets in one task.

    The values of features with more than ``grid`` distinct ones stay in their tasks, with the same cuts.
    """
    distinct = df.agg(*[F.approx_count_distinct(valid_number(df, f, exclude)).alias(f) for f in features]).first() if features else {}
    large = [f for f in features if distinct[f] > grid]

    def summed(names: list[str]) -> DataFrame:
        pairs = [F.struct(F.lit(f).alias("feature"), valid_number(df, f, exclude).alias("x")) for f in names]
        long = df.select(F.explode(F.array(*pairs)).alias("p"), weight_column(weight).alias("w"), col(target).cast("double").alias("y")).select("p.*", "w", "y").where("x is not null and y is not null")
        return long.groupBy("feature", "x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("bad"))

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x")
        found = [] if group["n"].sum() < 2 * least else best_first_cuts(*(group[c].to_numpy(float) for c in ("x", "n", "w", "bad")), n_bins, least)
        return pd.DataFrame({"feature": [group["feature"].iloc[0]], "cuts": [found]})

    found = {f: best_first_cuts_of_table(summed([f]), n_bins, least) for f in large}
    if few := [f for f in features if f not in large]:
        found |= {r["feature"]: list(r["cuts"]) for r in summed(few).groupBy("feature").applyInPandas(cut, "feature string, cuts array<double>").collect()}
    return {f: found.get(f, []) for f in features}


def category_mapping(df: DataFrame, feature: str, least: int = 5, exclude: list = ()) -> DataFrame:
    """value, n, bin_idx: by falling frequency then value; rarer values than ``least`` are OTHER.

    Only values that are not rare are ranked; more than MOST_CATEGORIES of them are an error.
    """
    value = col(feature).cast("string")
    rows = df.where(value.isNotNull() & ~value.isin(list(exclude)) if exclude else value.isNotNull())
    counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    common = counts.where(F.col("n") >= least)
    if common.limit(MOST_CATEGORIES + 1).count() > MOST_CATEGORIES:
        raise ValidationError(f"{feature} has more than {MOST_CATEGORIES} categories of {least} rows")
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value")) - 1  # MOST_CATEGORIES rows at most
    return common.withColumn("bin_idx", rank.cast("int")).unionByName(counts.where(F.col("n") < least).withColumn("bin_idx", F.lit(OTHER)))


# the cube and its roll-ups


def index_columns(df: DataFrame, rules: dict[str, BinRule], keep: list[Column]) -> DataFrame:
    """Long rows: feature, bin_idx and the kept columns."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), r.index().alias("bin_idx")) for f, r in rules.items()]))
    return df.select(each.alias("_p"), *keep).select("_p.feature", "_p.bin_idx", *[c for c in df.select(*keep).columns])


def cube(df: DataFrame, rules: dict[str, BinRule], target: str | None = None, weight: str | None = None, by: str | None = None) -> DataFrame:
    """feature, (group,) bin_idx, n, w, bad: one scan and one small shuffle for all features.

    Partial sums per task keep the shuffle to features x groups x bins rows a task.
    """
    y = F.lit(0.0) if target is None else col(target).cast("double")
    keep = [weight_column(weight).alias("_w"), y.alias("_y"), *([col(by).alias("group")] if by else [])]
    keys = ["feature", *(["group"] if by else []), "bin_idx"]
    return index_columns(df, rules, keep).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("bad"))


def woe_table(sums: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """Adds good, bad_rate, woe, iv and total_iv of each feature to its cube.

    Smoothing counts in mean weights, so IV does not change with the weights' unit.
    """
    w = W.partitionBy("feature")
    out = sums.withColumn("good", F.col("w") - F.col("bad"))
    s = F.lit(smoothing) * F.sum("w").over(w) / F.sum("n").over(w)
    rows = out.withColumns({"_s": s, "_b": F.sum("bad").over(w), "_g": F.sum("good").over(w)})
    pb, pg = ((F.col(c) + F.col("_s")) / (F.col(t) + 2 * F.col("_s")) for c, t in (("bad", "_b"), ("good", "_g")))
    rows = rows.withColumns({"bad_rate": F.try_divide("bad", "w"), "_pb": pb, "_pg": pg})
    rows = rows.withColumn("woe", F.ln(F.try_divide("_pb", "_pg"))).withColumn("iv", (F.col("_pb") - F.col("_pg")) * F.col("woe"))
    return rows.withColumn("total_iv", F.sum("iv").over(w)).drop("_s", "_b", "_g", "_pb", "_pg")


def bin_stats(sums: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """count, bad, good, bad_rate, plain shares, smoothed woe and their iv for each bin."""
    w = W.partitionBy("feature")
    rows = woe_table(sums, smoothing).drop("iv", "total_iv")
    rows = rows.withColumns({"dist_bad": F.try_divide(F.col("bad"), F.sum("bad").over(w)), "dist_good": F.try_divide(F.col("good"), F.sum("good").over(w))})
    iv = (F.col("dist_bad") - F.col("dist_good")) * F.col("woe")
    return rows.select("feature", "bin_idx", F.col("w").alias("count"), "bad", "good", "bad_rate", "dist_bad", "dist_good", "woe", iv.alias("iv"))


def iv_report(table: DataFrame) -> DataFrame:
    """feature, total_iv, interpretation from a woe_table, strongest first."""
    out = table.groupBy("feature").agg(F.sum("iv").alias("total_iv"))
    return out.withColumn("interpretation", interpret_iv(F.col("total_iv"))).orderBy(F.desc("total_iv"), "feature")


def binned_ks(table: DataFrame) -> DataFrame:
    """feature, ks: greatest gap of the cumulative shares of bads and goods in order of bins."""
    w = W.partitionBy("feature")
    upto = w.orderBy("bin_idx").rowsBetween(W.unboundedPreceding, 0)
    gap = F.abs(F.try_divide(F.sum("bad").over(upto), F.sum("bad").over(w)) - F.try_divide(F.sum("good").over(upto), F.sum("good").over(w)))
    return table.select("feature", gap.alias("gap")).groupBy("feature").agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("ks"))


def monotonic(table: DataFrame) -> DataFrame:
    """feature, monotonic_woe: whether WOE of the value bins never turns."""
    before = F.lag("woe").over(W.partitionBy("feature").orderBy("bin_idx"))
    steps = table.where("bin_idx >= 0").select("feature", (F.col("woe") - before).alias("d"))
    return steps.groupBy("feature").agg((F.coalesce(F.min("d"), F.lit(0.0)) >= 0).alias("_up"), (F.coalesce(F.max("d"), F.lit(0.0)) <= 0).alias("_down")).select("feature", (F.col("_up") | F.col("_down")).alias("monotonic_woe"))


def pool_adjacent(y: np.ndarray, increasing: bool = True) -> np.ndarray:
    """Least-squares fit that never falls (or never rises)."""
    blocks: list[list[float]] = []
    for v in (y if increasing else -y).tolist():
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    out = np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])
    return out if increasing else -out


class WoeBinner(Transformer):
    """Bins, WOE and IV of each feature, learned in a few aggregations and applied as projections."""

    def __init__(self, n_bins: int = 5, method: str = "quantile", missing_values: list = (), special_values: list = (), min_samples_bin: int = 5, monotonic: bool = False, smoothing: float = 0.5):
        if smoothing < 0:
            raise ValidationError("smoothing must not be below 0")
        if method not in ("quantile", "uniform", "cart"):
            raise ValidationError(f"no such method: {method}")
        self.n_bins, self.method, self.min_samples_bin = n_bins, method, min_samples_bin
        self.missing_values, self.special_values = list(missing_values or ()), list(special_values or ())
        self.monotonic, self.smoothing = monotonic, smoothing
        self.rules: dict[str, BinRule] = {}
        self.failures: dict[str, str] = {}
        self.sums: list[tuple] = []

    def _fit(self, df: DataFrame, features: list[str] | None = None, target: str | None = None, weight: str | None = None) -> None:
        features = features or [f for f in df.columns if f not in (target, weight)]
        require(df, target, weight, *features)
        check_weights(df, weight)
        exclude = self.missing_values + self.special_values
        numeric = [f for f in features if isinstance(df.schema[f].dataType, NUMERIC)]
        self.rules, self.failures, self.sums = {}, {}, []
        plain = self.method == "quantile" and weight is None
        if plain:  # least and greatest values come with the cuts
            every = exact_quantiles(df, {f: valid_number(df, f, exclude) for f in numeric}, [0.0, *inner(self.n_bins), 1.0])
            ends = {f: (v[0], v[-1]) if v else (None, None) for f, v in every.items()}
        else:
            row = df.agg(*[g(valid_number(df, f, exclude)) for f in numeric for g in (F.min, F.max)]).first() if numeric else ()
            ends = {f: (row[2 * k], row[2 * k + 1]) for k, f in enumerate(numeric)}
        self.failures |= {f: "no valid values" if a is None else "constant" for f, (a, b) in ends.items() if a is None or a == b}
        usable = [f for f in numeric if f not in self.failures]
        if plain:
            cuts = {f: sorted(set(every[f][1:-1])) for f in usable}
        elif self.method == "quantile":
            cuts = quantile_cuts(df, usable, self.n_bins, exclude, weight)
        elif self.method == "uniform":
            cuts = uniform_cuts(df, usable, self.n_bins, exclude)
        else:
            cuts = {f: [] for f in usable} if target is None else tree_cuts(df, usable, target, self.n_bins, exclude, weight, self.min_samples_bin)
        for f in features:
            special, missing = fitting(self.special_values, df, f), fitting(self.missing_values, df, f)
            if f in cuts:
                self.rules[f] = BinRule(f, True, cuts=cuts[f], special=special, missing=missing)
            elif f not in numeric:
                try:
                    found = category_mapping(df, f, self.min_samples_bin, special + missing).where("bin_idx >= 0").orderBy("bin_idx").collect()
                except ValidationError as e:
                    self.failures[f] = str(e)
                    continue
                self.rules[f] = BinRule(f, False, mapping={r["value"]: r["bin_idx"] for r in found}, special=special, missing=missing)
        if target is None or not self.rules:
            return
        # a row for each bin, kept: reports on what was learned need no other pass
        self.sums = [tuple(r) for r in cube(df, self.rules, target, weight).select("feature", "bin_idx", "n", "w", "bad").collect()]
        table = self.table(df).collect()
        for r in table:
            self.rules[r["feature"]].woe[r["bin_idx"]] = r["woe"]
            self.rules[r["feature"]].iv[r["bin_idx"]] = r["iv"]
        if any(not sum(r["bad"] for r in table if r["feature"] == f) or not sum(r["good"] for r in table if r["feature"] == f) for f in self.rules):
            self.failures["target"] = "one class only"
            for rule in self.rules.values():
                rule.woe, rule.iv = {}, {}
        elif self.monotonic:
            self._straighten(table)

    def _straighten(self, table: list) -> None:
        for f, rule in self.rules.items():
            rows = sorted((r for r in table if r["feature"] == f), key=lambda r: r["bin_idx"])
            value = [r for r in rows if r["bin_idx"] >= 0]
            if len(value) < 2:
                continue
            rate = np.array([r["bad_rate"] for r in value])
            up, down = pool_adjacent(rate), pool_adjacent(rate, False)
            fit = np.clip(up if ((rate - up) ** 2).sum() <= ((rate - down) ** 2).sum() else down, 1e-7, 1 - 1e-7)
            n = np.array([r["w"] for r in value])
            s = self.smoothing * sum(r["w"] for r in rows) / sum(r["n"] for r in rows)
            bad, good = n * fit, n * (1 - fit)
            pb, pg = (bad + s) / (bad.sum() + 2 * s), (good + s) / (good.sum() + 2 * s)
            woe = np.log(pb / pg)
            for r, a, b in zip(value, woe, (pb - pg) * woe, strict=True):
                rule.woe[r["bin_idx"]], rule.iv[r["bin_idx"]] = float(a), float(b)
            rule.iv = {k: v for k, v in rule.iv.items() if k >= 0}

    def _transform(self, df: DataFrame, return_type: str = "index") -> DataFrame:
        rules = {f: r for f, r in self.rules.items() if f in df.columns}
        if return_type == "index":
            return df.withColumns({f"{f}_bin": r.index() for f, r in rules.items()})
        if return_type == "label":
            return df.withColumns({f"{f}_bin": lookup(r.labels(), r.index()) for f, r in rules.items()})
        if return_type == "woe":
            return df.withColumns({f"{f}_bin": F.coalesce(lookup(r.woe, r.index()), F.lit(0.0)) if r.woe else F.lit(0.0) for f, r in rules.items()})
        raise ValidationError(f"no such return type: {return_type}")

    def total_iv(self) -> dict[str, float]:
        return {f: sum(r.iv.values()) for f, r in self.rules.items()}

    def woe_dict(self, feature: str) -> dict[int, float]:
        return dict(self.rules[feature].woe)

    def report(self, df: DataFrame) -> DataFrame:
        rows = [(f, float(v)) for f, v in self.total_iv().items()]
        out = df.sparkSession.createDataFrame(rows, "feature string, total_iv double")
        return out.withColumn("interpretation", interpret_iv(F.col("total_iv"))).orderBy(F.desc("total_iv"), "feature")

    def table(self, df: DataFrame) -> DataFrame:
        """The woe_table of the rows it was fitted on; df only lends its session."""
        return woe_table(df.sparkSession.createDataFrame(self.sums, "feature string, bin_idx int, n long, w double, bad double"), self.smoothing)

    def labels_frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([(f, k, x) for f, r in self.rules.items() for k, x in r.labels().items()], "feature string, bin_idx int, bin_label string")

    def stats(self, df: DataFrame, target: str, weight: str | None = None) -> DataFrame:
        return bin_stats(cube(df, self.rules, target, weight), self.smoothing)

    def to_dict(self) -> dict:
        keep = ("n_bins", "method", "missing_values", "special_values", "min_samples_bin", "monotonic", "smoothing")
        plain = lambda r: r.__dict__ | {"woe": {str(k): v for k, v in r.woe.items()}, "iv": {str(k): v for k, v in r.iv.items()}}
        return {"settings": {k: getattr(self, k) for k in keep}, "rules": [plain(r) for r in self.rules.values()]}

    @classmethod
    def from_dict(cls, data: dict) -> WoeBinner:
        out = cls(**data["settings"])
        for r in data["rules"]:
            out.rules[r["feature"]] = BinRule(**(r | {"woe": {int(k): v for k, v in r["woe"].items()}, "iv": {int(k): v for k, v in r["iv"].items()}}))
        out.fitted = True
        return out


# one feature at a time


def calculate_bins(df: DataFrame, feature: str, n_bins: int = 5, method: str = "quantile", exclude: list = ()) -> list[float]:
    """Edges from -inf to inf."""
    if method not in ("quantile", "uniform"):
        raise ValidationError(f"no such method: {method}")
    cuts = quantile_cuts(df, [feature], n_bins, exclude) if method == "quantile" else uniform_cuts(df, [feature], n_bins, exclude)
    return [-INF, *cuts[feature], INF]


def apply_binning(df: DataFrame, feature: str, edges: list[float], special_values: list = ()) -> DataFrame:
    rule = BinRule(feature, isinstance(df.schema[feature].dataType, NUMERIC), cuts=list(edges[1:-1]), special=fitting(special_values, df, feature))
    return df.withColumn(f"{feature}_bin", rule.index())


def calculate_woe(df: DataFrame, target: str, bin_column: str, smooth: float = 0.5) -> DataFrame:
    """bin_idx, count, bad, good, bad_rate, woe, iv; a class without rows counts as 1."""
    sums = df.groupBy(col(bin_column).alias("bin_idx")).agg(F.count(F.lit(1)).alias("count"), F.sum(col(target).cast("double")).alias("bad"))
    sums = sums.withColumn("good", F.col("count") - F.col("bad"))
    every = W.partitionBy(F.lit(0))
    tb, tg = (F.greatest(F.sum(c).over(every), F.lit(1.0)) for c in ("bad", "good"))
    pb, pg = (F.col("bad") + smooth) / (tb + 2 * smooth), (F.col("good") + smooth) / (tg + 2 * smooth)
    rows = sums.withColumns({"bad_rate": F.try_divide("bad", "count"), "_pb": pb, "_pg": pg}).withColumn("woe", F.ln(F.try_divide("_pb", "_pg")))
    return rows.withColumn("iv", (F.col("_pb") - F.col("_pg")) * F.col("woe")).drop("_pb", "_pg").orderBy("bin_idx")


def binning_with_woe(df: DataFrame, feature: str, target: str, n_bins: int = 5, method: str = "quantile", special_values: list = (), smooth: float = 0.5) -> DataFrame:
    """calculate_bins, apply_binning and calculate_woe with the feature's total_iv on each row."""
    edges = calculate_bins(df, feature, n_bins, method, special_values)
    table = calculate_woe(apply_binning(df, feature, edges, special_values), target, f"{feature}_bin", smooth)
    return table.withColumn("total_iv", F.sum("iv").over(W.partitionBy(F.lit(0))))


