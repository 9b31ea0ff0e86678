"""Data-quality profiles and exploratory tables, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basics import NESTED, NUMERIC, col, fitting, is_missing, numeric_columns
from ..functions.quantiles import exact_quantiles, finite


def _special(df: DataFrame, c: str, values: list) -> Column:
    found = fitting(values, df, c)
    return F.coalesce(col(c).isin(found), F.lit(False)) if found else F.lit(False)


def long_rows(df: DataFrame, features: list[str], special_values: list = (), keep: list[Column] = ()) -> DataFrame:
    """feature, missing, special, value (text), number, and kept columns: one row a feature."""
    parts = [
        F.struct(F.lit(c).alias("feature"), is_missing(df, c).alias("missing"), _special(df, c, special_values).alias("special"), F.when(~is_missing(df, c), col(c).cast("string")).alias("value"),
                 (finite(col(c)) if isinstance(df.schema[c].dataType, NUMERIC) else F.lit(None).cast("double")).alias("number"))
        for c in features
    ]
    return df.select(F.explode(F.array(*parts)).alias("p"), *keep).select("p.*", *[c for c in df.select(*keep).columns] if keep else [])


def overview(df: DataFrame, features: list[str], target: str | None = None, group: str | None = None) -> DataFrame:
    """item, value (text): rows, features, numeric and categorical ones, duplicate rows, bad rate, groups."""
    n_numeric = len([f for f in features if f in numeric_columns(df)])
    flat = [col(c) for c in df.columns if not isinstance(df.schema[c].dataType, NESTED)]
    null = [c.isNull() for c in flat]
    # rows are told apart by 128 bits of hashes, which is what crosses the network
    rows = df.groupBy(F.xxhash64(*flat, *null).alias("_h"), F.xxhash64(F.lit(1), *null, *flat).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    about = rows.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))
    more = df.agg(*[e for e in (F.avg(col(target).cast("double")).alias("bad_rate") if target else None, F.count_distinct(col(group)).alias("n_groups") if group else None) if e is not None]) if target or group else None
    both = about.crossJoin(F.broadcast(more)) if more is not None else about  # one row each
    items = [("rows", F.col("rows").cast("string")), ("features", F.lit(str(len(features)))), ("numeric", F.lit(str(n_numeric))), ("categorical", F.lit(str(len(features) - n_numeric))), ("duplicate_rows", F.col("duplicate_rows").cast("string"))]
    if target:
        items.append(("bad_rate", F.round("bad_rate", 6).cast("decimal(18,6)").cast("string")))
    if group:
        items.append(("n_groups", F.col("n_groups").cast("string")))
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in items])).alias("p")).select("p.*")


def quality(df: DataFrame, features: list[str], special_values: list = ()) -> DataFrame:
    """feature, n_missing, missing_rate, n_special, special_rate, n_unique (missing counts as a value), high_missing, constant."""
    rows = long_rows(df, features, special_values)
    # values are summed first, so that a feature's distinct values never meet in one task
    values = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("missing").cast("long")).alias("m"), F.sum(F.col("special").cast("long")).alias("s"))
    out = values.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("m").alias("n_missing"), F.sum("s").alias("n_special"), F.count(F.lit(1)).alias("n_unique"))
    rate = lambda c: F.col(c) / F.col("n")
    return out.select("feature", "n_missing", rate("n_missing").alias("missing_rate"), "n_special", rate("n_special").alias("special_rate"), "n_unique", (rate("n_missing") >= 0.9).alias("high_missing"), (F.col("n_unique") <= 1).alias("constant")).orderBy(F.desc("missing_rate"), "feature")


def statistics_table(df: DataFrame, features: list[str], special_values: list = ()) -> DataFrame:
    """feature, count, mean, std (0 for one row), min, p25, median, p75, max of numbers but special ones."""
    x = {c: finite(F.when(~_special(df, c, special_values), col(c))) for c in features}
    q = exact_quantiles(df, x, [0.25, 0.5, 0.75])
    row = df.agg(*[f(x[c]).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("a", F.min), ("b", F.max))]).first()
    out = [(c, row[f"n{k}"], row[f"m{k}"], (row[f"s{k}"] or 0.0) if row[f"n{k}"] else None, row[f"a{k}"], *(q[c] or (None,) * 3), row[f"b{k}"]) for k, c in enumerate(features)]
    return df.sparkSession.createDataFrame(out, "feature string, count long, mean double, std double, min double, p25 double, median double, p75 double, max double")


def trend(df: DataFrame, features: list[str], group: str) -> DataFrame:
    """feature, group, row_count, missing_rate."""
    rows = long_rows(df, features, keep=[col(group).alias("group")])
    return rows.groupBy("feature", "group").agg(F.count(F.lit(1)).alias("row_count"), F.avg(F.col("missing").cast("double")).alias("missing_rate"))


def wide(table: DataFrame, value: str, group: str = "group") -> DataFrame:
    """A long trend with one column for each group."""
    return table.groupBy("feature").pivot(group).agg(F.first(value))


def profile_data(df: DataFrame, features: list[str] | None = None, target: str | None = None, group: str | None = None, special_values: list = ()) -> dict[str, DataFrame]:
    features = features or [f.name for f in df.schema if not isinstance(f.dataType, NESTED) and f.name not in (target, group)]
    numeric = [f for f in features if f in numeric_columns(df)]
    out = {"overview": overview(df, features, target, group), "dq_table": quality(df, features, special_values), "stats_table": statistics_table(df, numeric, special_values)}
    return out | ({"trends": trend(df, features, group)} if group else {})


# exploration by sample


def missing_by_sample(dev: DataFrame, oot: DataFrame, features: list[str]) -> DataFrame:
    """feature, dev_missing, oot_missing, delta."""
    side = lambda df, n: long_rows(df, features).groupBy("feature").agg(F.avg(F.col("missing").cast("double")).alias(n))
    return side(dev, "dev_missing").join(side(oot, "oot_missing"), "feature").withColumn("delta", F.col("oot_missing") - F.col("dev_missing"))


def numeric_distribution(df: DataFrame, features: list[str], qs: tuple = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """feature, q, value."""
    found = exact_quantiles(df, {c: col(c) for c in features}, list(qs))
    return df.sparkSession.createDataFrame([(c, float(q), v) for c in features for q, v in zip(qs, found[c] or [None] * len(qs), strict=True)], "feature string, q double, value double")


def top_categories(df: DataFrame, features: list[str], n: int = 20) -> DataFrame:
    """feature, value, n, pct, rank of each feature's commonest values."""
    counts = long_rows(df, features).where("not missing").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("feature")
    ranked = counts.withColumns({"pct": F.col("n") / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "value"))})
    return ranked.where(F.col("rank") <= n)


def numeric_table(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, n_valid, missing_rate, min, max, mean, median, std, p01, p25, p50, p75, p99."""
    q = exact_quantiles(df, {c: col(c) for c in features}, [0.01, 0.25, 0.5, 0.75, 0.99])
    x = {c: finite(col(c)) for c in features}
    about = [g.alias(f"{n}{k}") for k, c in enumerate(features) for n, g in (("v", F.count(x[c])), ("m", F.avg(is_missing(df, c).cast("double"))), ("a", F.min(x[c])), ("b", F.max(x[c])), ("u", F.avg(x[c])), ("s", F.stddev_samp(x[c])))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *about).first()
    out = []
    for k, c in enumerate(features):
        p = q[c] or [None] * 5
        out.append((c, row["n"], *(row[f"{n}{k}"] for n in "vmabu"), p[2], row[f"s{k}"], *p))
    return df.sparkSession.createDataFrame(out, "feature string, n long, n_valid long, missing_rate double, min double, max double, mean double, median double, std double, p01 double, p25 double, p50 double, p75 double, p99 double")


def explore(df: DataFrame, target: str | None = None, sample: str | None = None, features: list[str] | None = None, weight: str | None = None, n_bins: int = 10, dev: str = "dev", oot: str = "oot", woe_detail: bool = False) -> dict[str, DataFrame]:
    """The ten exploratory tables: overview, missing rates, distributions by sample, IV of both samples and stability.

    Without a target and a sample label there are tables 1, 2, 3 and 5, of all rows.
    """
    from .binning import WoeBinner, cube, iv_report, woe_table
    from .splits import split_dev_oot
    from .stability import bin_distribution, psi_from_shares

    roles = {target, sample, weight}
    features = features or [f.name for f in df.schema if not isinstance(f.dataType, NESTED) and f.name not in roles]
    numeric = [f for f in features if f in numeric_columns(df)]
    text = [f for f in features if f not in numeric]
    tables = {"1_Overview": overview(df, features, target), "2_Missing_Rate": quality(df, features), "3_Num_Dist_DEV": numeric_table(df, numeric), "5_Char_Dist_DEV": top_categories(df, text) if text else None}
    if target and sample:
        split = split_dev_oot(df, sample=sample, dev=dev, oot=oot)
        a, b = split.dev, split.oot
        binner = WoeBinner(n_bins, min_samples_bin=1).fit(a, features=features, target=target, weight=weight)
        sums = {n: cube(x, binner.rules, target, weight) for n, x in (("dev", a), ("oot", b))}
        shares = {n: bin_distribution(x, ["feature"]) for n, x in sums.items()}
        psi = psi_from_shares(shares["dev"], shares["oot"], ["feature"])
        tables |= {
            "2_Missing_Rate": missing_by_sample(a, b, features), "3_Num_Dist_DEV": numeric_table(a, numeric), "4_Num_Dist_OOT": numeric_table(b, numeric),
            "5_Char_Dist_DEV": top_categories(a, text) if text else None, "6_Char_Dist_OOT": top_categories(b, text) if text else None,
            "7_IV_DEV": iv_report(woe_table(sums["dev"], binner.smoothing)), "8_IV_OOT": iv_report(woe_table(sums["oot"], binner.smoothing)),
            "9_PSI_Numeric": psi.where(F.col("feature").isin(numeric)), "10_PSI_Categorical": psi.where(F.col("feature").isin(text)),
        }
        if woe_detail:
            tables["WOE_Detail"] = woe_table(sums["dev"], binner.smoothing).join(F.broadcast(binner.labels_frame(a)), ["feature", "bin_idx"], "left")  # a row for each bin
    return {n: t for n, t in sorted(tables.items(), key=lambda x: int(x[0].split("_")[0]) if x[0][0].isdigit() else 99) if t is not None}
