"""YAML configuration and command line."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from ..errors import ConfigurationError
from ..functions.basics import LOG, Roles, plain
from ..operators.models import CLASSIFIERS, REGRESSORS

#: Other names that settings go by.
ALIASES = {
    "target_col": "target", "label": "target", "sample_col": "sample", "date_col": "date", "date_column": "date", "weight_col": "weight", "segment_col": "segment", "segment_cols": "segment",
    "temporal_col": "temporal", "benchmark_col": "benchmark", "benchmark_cols": "benchmark", "exclude": "excluded", "exclude_columns": "excluded", "binning_method": "method", "model": "model_type",
    "output_dir": "output", "data_path": "data", "clean_strategy": "clean", "selection_method": "selection", "target_mode": "task", "n_features": "max_features", "random_state": "seed",
    "normalize_method": "normalize", "data_encoding": "encoding", "archive_run": "archive", "early_stopping_eval": "early_stopping",
}
ROLES = ("target", "sample", "date", "weight", "segment", "temporal", "benchmark", "excluded")
OTHER = ("data", "output", "task", "runs_dir", "archive", "model_type", "n_bins", "method", "clean", "selection", "threshold", "max_features", "special_values", "oot_start", "test_size", "key", "log_target", "normalize", "dev_label", "oot_label", "encoding")
#: Settings of the binner, of the credit score, and those that are turned into others.
BINNER = ("min_samples_bin", "monotonic", "smoothing")
CREDIT = {"credit_score_col": "column", "base_score": "base", "pdo": "pdo", "min_score": "low", "max_score": "high"}
TURNED = ("target_transform", "seed", "early_stopping", "early_stopping_rounds", "early_stopping_metric", "use_sample_weight", "convert_to_credit_score", "export_excel")
#: Settings that a regression has.
REGRESSION = ("model_type", "clean", "oot_start", "log_target", "normalize", "dev_label", "oot_label", "encoding", "key")


def load_config(path: str) -> dict:
    """A YAML file's settings, flat; relative paths are those of the file's folder."""
    import yaml

    data = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(data, dict):
        raise ConfigurationError("the configuration is not a mapping")
    flat: dict = {}
    for k, v in data.items():
        if isinstance(v, dict) and k not in ("model_params", "data", "params"):
            flat |= {ALIASES.get(x, x): y for x, y in v.items()}
        elif k == "data" and isinstance(v, dict) and "type" not in v:
            flat |= {ALIASES.get(x, x): y for x, y in v.items()}
        else:
            flat[ALIASES.get(k, k)] = v
    if "path" in flat and "data" not in flat:
        flat["data"] = flat.pop("path")
    for k in ("data", "output", "runs_dir"):
        if isinstance(flat.get(k), str) and "://" not in flat[k]:
            flat[k] = str((Path(path).parent / flat[k]).resolve())
    return flat


def to_arguments(config: dict) -> dict:
    """Arguments of run_pipeline."""
    unknown = set(config) - {*ROLES, *OTHER, *BINNER, *CREDIT, *TURNED, "model_params", "params"}
    if unknown:
        raise ConfigurationError(f"no such settings: {sorted(unknown)}")
    if not config.get("target") or not config.get("data"):
        raise ConfigurationError("data and target are needed")
    if config.get("target_transform") not in (None, "log1p"):
        raise ConfigurationError(f"no such transform: {config['target_transform']}")
    task = config.get("task", "classification")
    how = {k: config[k] for k in OTHER[5:] if config.get(k) is not None} | dict(config.get("model_params") or config.get("params") or {})
    if config.get("target_transform"):
        how["log_target"] = True
    if config.get("early_stopping") not in (None, "none", False) and config.get("early_stopping_rounds"):
        how |= {k: config[k] for k in ("early_stopping", "early_stopping_rounds", "early_stopping_metric") if config.get(k)}
    if config.get("seed") is not None and how.get("model_type", "logistic") not in ("logistic", "linear", "linear_regression"):
        how["seed"] = config["seed"]
    roles = {k: config[k] for k in ROLES if config.get(k)}
    if config.get("use_sample_weight") is False:
        roles.pop("weight", None)
    if task == "classification":
        if binner := {k: config[k] for k in BINNER if config.get(k) is not None}:
            how["binner"] = binner
        if config.get("convert_to_credit_score"):
            how["credit"] = {v: config[k] for k, v in CREDIT.items() if config.get(k) is not None} or {"column": "credit_score"}
    else:
        params = set(how) - set(OTHER)
        how = {k: v for k, v in how.items() if k in REGRESSION or k in params}
    return {"source": config["data"], "roles": Roles(**roles), "folder": config.get("output"), "task": task, **how}


def run_configured(spark, path: str | None, overrides: dict | None = None):
    """A run by the file's settings and those that replace them; archived, though no run is lost over that."""
    from .pipeline import run_pipeline
    from .runs import archive_run

    config = (load_config(path) if path else {}) | {ALIASES.get(k, k): v for k, v in (overrides or {}).items() if v is not None}
    pipe = run_pipeline(spark, **to_arguments(config))
    if config.get("output") and config.get("archive", True):
        selected = pipe.artifact.selected
        try:
            archive_run(config["output"], config.get("runs_dir", "runs"), config, pipe.metrics, selected, config.get("task", "classification"), config.get("model_type", "logistic"))
        except OSError as e:
            LOG.warning("the run was not archived: %s", e)
    return pipe


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("riskloom")
    sub = out.add_subparsers(dest="command", required=True)
    fit = sub.add_parser("fit", help="train from a configuration or from options, which replace its settings")
    text = lambda *flags, **how: fit.add_argument(*flags, **how)
    text("--config")
    text("--data", "--input", "-i")
    text("--target", "-t")
    text("--output", "-o")
    text("--task", "--target-mode", choices=("classification", "regression"))
    text("--model-type", "--model", choices=sorted({*CLASSIFIERS, *REGRESSORS}))
    text("--target-transform", choices=("log1p",))
    text("--early-stopping-eval", dest="early_stopping", choices=("none", "dev_holdout", "oot"))
    text("--early-stopping-rounds", type=int)
    text("--early-stopping-metric")
    text("--method", choices=("quantile", "uniform", "cart"))
    text("--selection", choices=("iv", "correlation", "variance", "rfe", "recursive", "mutual_info"))
    text("--clean", "--clean-strategy", choices=("mean", "median", "zero", "keep"))
    text("--normalize", "--normalize-method", choices=("minmax", "zscore", "robust"))
    for flags, dest in ((("--sample", "--sample-column"), "sample"), (("--date", "--date-column"), "date"), (("--weight", "--weight-column"), "weight"), (("--temporal", "--temporal-column"), "temporal"), (("--oot-start",), "oot_start"), (("--dev-label",), "dev_label"), (("--oot-label",), "oot_label"), (("--encoding",), "encoding"), (("--credit-score-col",), "credit_score_col"), (("--runs-dir",), "runs_dir")):
        text(*flags, dest=dest)
    for flags, dest in ((("--segment", "--segment-column"), "segment"), (("--benchmark", "--benchmark-column"), "benchmark"), (("--exclude-column",), "excluded")):
        text(*flags, dest=dest, action="append")
    for flags, dest in ((("--n-bins",), "n_bins"), (("--max-features", "--n-features"), "max_features"), (("--seed",), "seed"), (("--min-samples-bin",), "min_samples_bin")):
        text(*flags, dest=dest, type=int)
    for k in ("threshold", "test_size", "smoothing", "base_score", "pdo", "min_score", "max_score"):
        text(f"--{k.replace('_', '-')}", type=float)
    for k in ("special_values", "key", "log_target", "archive"):
        text(f"--{k.replace('_', '-')}", type=json.loads)
    for k in ("monotonic", "use_sample_weight", "convert_to_credit_score"):
        text(f"--{k.replace('_', '-')}", action="store_true", default=None)
    text("--no-archive-run", dest="archive", action="store_false", default=None)
    explore = sub.add_parser("explore", help="write the exploratory tables of a file as a workbook")
    for k in ("data", "output"):
        explore.add_argument(f"--{k}", required=True)
    for k in ("target", "sample", "weight"):
        explore.add_argument(f"--{k}", f"--{k}-column")
    explore.add_argument("--n-bins", type=int, default=10)
    explore.add_argument("--export-woe-detail", action="store_true")
    score = sub.add_parser("score", help="score a file with a saved artifact")
    for k in ("artifact", "data", "output"):
        score.add_argument(f"--{k}", required=True)
    gate = sub.add_parser("gate", help="check an output folder for release")
    gate.add_argument("folder")
    gate.add_argument("--min-auc", type=float, default=0.6)
    gate.add_argument("--max-psi", type=float, default=0.25)
    runs = sub.add_parser("runs", help="list, show or compare runs")
    runs.add_argument("what", choices=("list", "show", "compare"))
    runs.add_argument("names", nargs="*")
    runs.add_argument("--runs-dir", default="runs")
    return out


def main(argv: list[str] | None = None) -> int:
    from . import runs as history

    a = parser().parse_args(argv)
    if a.command == "runs":
        found = [history.resolve_run(n, a.runs_dir) for n in a.names]
        if a.what == "list":
            print(history.format_runs(history.list_runs(a.runs_dir)))
        elif a.what == "show":
            print(json.dumps(plain(found[0].__dict__), indent=2))
        else:
            print(history.format_comparison(history.compare_runs(*found[:2])))
        return 0
    from pyspark.sql import SparkSession

    from ..sources.tables import load_data, save_dataframe
    from .pipeline import ScoringArtifact, validate_release

    spark = SparkSession.builder.getOrCreate()
    if a.command == "fit":
        pipe = run_configured(spark, a.config, {k: v for k, v in vars(a).items() if k not in ("command", "config")})
        print(json.dumps(pipe.metrics, indent=2))
        return 0
    if a.command == "explore":
        from ..operators.profiling import explore
        from ..sources.tables import write_xlsx

        write_xlsx(explore(load_data(spark, a.data), a.target, a.sample, weight=a.weight, n_bins=a.n_bins, woe_detail=a.export_woe_detail), a.output)
        return 0
    if a.command == "score":
        save_dataframe(ScoringArtifact.load(spark, a.artifact).score(load_data(spark, a.data), points=True), a.output)
        return 0
    result = validate_release(spark, a.folder, a.min_auc, a.max_psi)
    print(json.dumps(result, indent=2))
    return 0 if result["passed"] else 1
