"""Risk profile of features and period-over-period monitoring, as roll-ups of one cube.

A scan for cuts and one for sums by feature, group and bin serve detail, IV, KS, stability,
missing and bad rates: all later tables have features x groups x bins rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..errors import ValidationError
from ..functions.basics import check_weights, col, group_keys, numeric_columns, require, weight_column
from .binning import WoeBinner, bin_stats, binned_ks, cube, interpret_iv, iv_report, monotonic, woe_table
from .stability import bin_distribution, psi_from_shares, psi_level


@dataclass
class Report:
    summary: DataFrame
    detail: DataFrame
    trends: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    binner: WoeBinner | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {"summary": self.summary, "detail": self.detail, **self.trends}

    def to_markdown(self, most: int = 50) -> str:
        from ..plans.report import markdown

        return "\n\n".join(f"## {n}\n\n{markdown(t, most)}" for n, t in self.tables().items())

    def save(self, path: str, most: int = 50) -> str:
        """Markdown, or all rows as a workbook if the path ends in .xlsx."""
        from ..plans.report import save_markdown

        return save_markdown(self.tables(), path, most)


def _all_groups(sums: DataFrame) -> DataFrame:
    return sums.groupBy("feature", "bin_idx").agg(*[F.sum(c).alias(c) for c in ("n", "w", "bad")])


def rates(sums: DataFrame) -> DataFrame:
    """feature, group, missing_rate, bad_rate by weight."""
    return sums.groupBy("feature", "group").agg((F.sum(F.when(F.col("bin_idx") == -1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("missing_rate"), F.try_divide(F.sum("bad"), F.sum("w")).alias("bad_rate"))


def psi_trend(sums: DataFrame, benchmark) -> DataFrame:
    """feature, group, psi against the benchmark: a group's key, or a cube of other rows."""
    shares = bin_distribution(sums, ["feature", "group"])
    expected = bin_distribution(benchmark, ["feature"]) if isinstance(benchmark, DataFrame) else shares.where(F.col("group") == F.lit(benchmark)).drop("group")
    return psi_from_shares(expected, shares, ["feature", "group"])


def profile_risk(df: DataFrame, target: str, features: list[str] | None = None, group: str | None = None, weight: str | None = None, binner: WoeBinner | None = None, **how) -> Report:
    """summary: feature, iv, iv_strength, ks, missing_rate, n_bins, monotonic_woe, psi_max; detail: bins."""
    features = features or [f for f in numeric_columns(df) if f not in (target, group, weight)]
    require(df, target, group, weight, *features)
    if binner is None:
        binner = WoeBinner(**how).fit(df, features=features, target=target, weight=weight)
    sums = cube(df, binner.rules, target, weight, group)
    flat = _all_groups(sums) if group else sums
    table = woe_table(flat, binner.smoothing)
    detail = bin_stats(flat, binner.smoothing).join(F.broadcast(binner.labels_frame(df)), ["feature", "bin_idx"], "left")  # a row for each bin
    missing = flat.groupBy("feature").agg((F.sum(F.when(F.col("bin_idx") == -1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("missing_rate"), F.count(F.lit(1)).alias("n_bins"))
    summary = iv_report(table).select("feature", F.col("total_iv").alias("iv")).join(binned_ks(table), "feature").join(missing, "feature").join(monotonic(table), "feature", "left")
    trends = {}
    if group:
        first = df.agg(F.min(col(group))).first()[0]
        trends = {"psi": psi_trend(sums, first), **{n: rates(sums).select("feature", "group", n) for n in ("missing_rate", "bad_rate")}}
        summary = summary.join(trends["psi"].groupBy("feature").agg(F.max("psi").alias("psi_max")), "feature", "left")
    else:
        summary = summary.withColumn("psi_max", F.lit(None).cast("double"))
    r = lambda c: F.round(c, 6).alias(c)
    summary = summary.select("feature", r("iv"), interpret_iv(F.col("iv")).alias("iv_strength"), r("ks"), r("missing_rate"), "n_bins", F.coalesce("monotonic_woe", F.lit(True)).alias("monotonic_woe"), r("psi_max")).orderBy(F.desc("iv"), "feature")
    return Report(summary, detail, trends, {"target": target, "group": group}, binner)


class Monitor:
    """Stability of features, target and score of each period against a benchmark."""

    def __init__(self, binner: WoeBinner | None = None, warn: float = 0.1, critical: float = 0.25, **how):
        self.binner, self.warn, self.critical, self.how = binner, warn, critical, how

    def monitor(self, df: DataFrame, group: str | None = None, benchmark: DataFrame | None = None, features: list[str] | None = None, target: str | None = None, score: str | None = None, weight: str | None = None) -> Report:
        if group is None and benchmark is None:
            raise ValidationError("monitoring needs groups or a benchmark")
        features = features or [f for f in numeric_columns(df) if f not in (group, target, score, weight)]
        require(df, group, target, score, weight, *features)
        check_weights(df, weight)
        if group is None:
            df, group = df.withColumn("_period", F.lit("current")), "_period"
        keys = group_keys(df, group)
        if not keys:
            raise ValidationError("there are no groups")
        base = benchmark if benchmark is not None else df.where(col(group) == F.lit(keys[0]))
        if self.binner is None:
            self.binner = WoeBinner(**self.how).fit(base, features=[*features, *([score] if score and score not in features else [])], target=target, weight=weight if weight in base.columns else None)
        rules = {f: r for f, r in self.binner.rules.items() if f in df.columns}
        sums = cube(df.where(col(group).isNotNull()), rules, target, weight, group)
        expected = cube(base, rules, target if target in base.columns else None, weight if weight in base.columns else None)
        shares = bin_distribution(sums, ["feature", "group"])
        wanted = bin_distribution(expected, ["feature"])
        psi = psi_from_shares(wanted, shares, ["feature", "group"])
        part = rates(sums)
        detail = shares.select("feature", "group", "bin_idx", "pct").join(wanted.select("feature", "bin_idx", F.col("pct").alias("benchmark_pct")), ["feature", "bin_idx"], "left").join(F.broadcast(self.binner.labels_frame(df)), ["feature", "bin_idx"], "left")  # a row for each bin
        trends = {"psi": psi, "missing_rate": part.select("feature", "group", "missing_rate")}
        if target:
            trends["target"] = target_trend(df, group, target, weight)
        if score:
            trends["score"] = score_trend(df, group, score, weight)
        return Report(monitor_summary(psi, part, self.warn, self.critical), detail, trends, {"benchmark": "given" if benchmark is not None else keys[0], "groups": keys}, self.binner)


def target_trend(df: DataFrame, group: str, target: str, weight: str | None = None) -> DataFrame:
    w = weight_column(weight)
    return df.groupBy(col(group).alias("group")).agg((F.sum(w * col(target)) / F.sum(w)).alias("bad_rate"))


def score_trend(df: DataFrame, group: str, score: str, weight: str | None = None) -> DataFrame:
    """group, score_mean, score_std (population)."""
    w, s = weight_column(weight), col(score).cast("double")
    ok = s.isNotNull() & ~F.isnan(s)
    sums = df.where(ok).groupBy(col(group).alias("group")).agg((F.sum(w * s) / F.sum(w)).alias("score_mean"), F.sum(w).alias("_w"))
    spread = df.where(ok).join(sums, col(group) == F.col("group")).groupBy("group").agg(F.sum(w * (s - F.col("score_mean")) ** 2).alias("_v"))
    return sums.join(spread, "group").select("group", "score_mean", F.sqrt(F.col("_v") / F.col("_w")).alias("score_std"))


def monitor_summary(psi: DataFrame, part: DataFrame, warn: float = 0.1, critical: float = 0.25) -> DataFrame:
    """feature, psi_latest, psi_max, missing_latest, missing_max, missing_delta, status."""
    rows = psi.join(part.select("feature", "group", "missing_rate"), ["feature", "group"])
    out = rows.groupBy("feature").agg(F.max_by("psi", "group").alias("psi_latest"), F.max("psi").alias("psi_max"), F.max_by("missing_rate", "group").alias("missing_latest"), F.max("missing_rate").alias("missing_max"), F.min_by("missing_rate", "group").alias("_first"))
    return out.select("feature", "psi_latest", "psi_max", "missing_latest", "missing_max", (F.col("missing_latest") - F.col("_first")).alias("missing_delta"), psi_level(F.col("psi_max"), warn, critical).alias("status")).orderBy(F.desc("psi_max"), "feature")


@dataclass
class AlertConfig:
    """Shifts that are worth a word."""

    psi_warn: float = 0.1
    psi_critical: float = 0.25
    missing_delta: float = 0.05
    most: int = 10


def alerts(summary: DataFrame, config: AlertConfig | None = None, model_features: list[str] = ()) -> DataFrame:
    """feature, level (critical, warning), reason, in_model; model features and larger shifts first."""
    c = config or AlertConfig()
    critical, warning = F.col("psi_latest") >= c.psi_critical, (F.col("psi_latest") >= c.psi_warn) | (F.abs("missing_delta") >= c.missing_delta)
    level = F.when(critical, "critical").when(warning, "warning")
    reason = F.when(F.col("psi_latest") >= c.psi_warn, "psi").otherwise("missing")
    rows = summary.select("feature", level.alias("level"), reason.alias("reason"), F.col("feature").isin(list(model_features)).alias("in_model"), "psi_latest").where("level is not null")
    return rows.orderBy((F.col("level") == "critical").desc(), F.desc("in_model"), F.desc("psi_latest"), "feature")


def alert_text(summary: DataFrame, config: AlertConfig | None = None, model_features: list[str] = ()) -> str:
    c = config or AlertConfig()
    lines, table = [], alerts(summary, c, model_features)
    for level in ("critical", "warning"):
        found = table.where(F.col("level") == level).limit(c.most + 1).collect()
        if found:
            lines.append(f"{level}: " + ", ".join(f"{r['feature']}{' (model)' if r['in_model'] else ''} {r['reason']} psi={r['psi_latest']:.4f}" for r in found[: c.most]) + (" ..." if len(found) > c.most else ""))
    return "\n".join(lines) or "normal: nothing to report"


def wide_trend(table: DataFrame, value: str) -> DataFrame:
    return table.groupBy("feature").pivot("group").agg(F.first(value)).orderBy("feature")


def segments(df: DataFrame, by: str, target: str, score: str, weight: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Metrics of each segment or period with both classes, in one job."""
    from .metrics import all_metrics

    both = df.groupBy(col(by)).agg(F.min(col(target)).alias("_a"), F.max(col(target)).alias("_b"), F.count(F.lit(1)).alias("n")).where("_a < _b").select(by, "n")
    return all_metrics(df, target, score, threshold, weight, [by]).join(both, by)
