"""Run history: finished runs are archived in a folder each, listed, resolved and compared.

A run's folder holds what the run wrote, but logs and older reports, with run.json (valid
JSON whatever the metrics are) and, if there is a configuration, config.yaml.
"""

from __future__ import annotations

import json
import re
import shutil
import uuid
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError
from ..functions.basics import plain

INDEX = "run.json"
LEFT_OUT = (".log", ".tmp")
#: Metrics that head a list of runs, and settings that differ from run to run.
HEADLINE = ("oot_auc", "auc_roc", "auc", "ks", "oot_ks", "score_psi", "oot_rmse", "rmse")
OWN_TO_A_RUN = {"output", "output_dir", "runs_dir", "config", "archive"}


@dataclass
class RunRecord:
    run_id: str
    path: Path
    created_at: str = ""
    task: str = "classification"
    model_type: str = ""
    data_path: str = ""
    metrics: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    selected_features: list = field(default_factory=list)

    @property
    def artifact_path(self) -> Path | None:
        found = sorted(Path(self.path).glob("scoring_artifact*"))
        return found[0] if found else None

    def headline(self) -> dict[str, float]:
        return {m: self.metrics[m] for m in HEADLINE if self.metrics.get(m) is not None}


def new_run_id(model_type: str = "model", timestamp: datetime | None = None, seed: str | None = None) -> str:
    """<date>-<time>-<model>-<suffix>, in order of time; the suffix differs at each call unless seeded."""
    name = re.sub(r"\W", "-", str(model_type)) or "model"
    suffix = uuid.uuid4() if seed is None else uuid.uuid5(uuid.NAMESPACE_OID, seed)
    return f"{timestamp or datetime.now():%Y%m%d-%H%M%S}-{name}-{suffix.hex[:6]}"


def _kept(output: Path) -> list[Path]:
    """What a run wrote: no logs, and of numbered reports the one written last."""
    found = [p for p in sorted(output.iterdir()) if p.suffix not in LEFT_OUT]
    reports = sorted((p for p in found if p.suffix == ".xlsx"), key=lambda p: p.stat().st_mtime)
    return [p for p in found if p not in reports[:-1]]


def archive_run(output: str | Path, runs_dir: str | Path = "runs", config: dict | None = None, metrics: dict | None = None, selected_features: list | None = None, task: str = "classification", model_type: str = "", run_id: str | None = None, timestamp: datetime | None = None) -> Path:
    """Copies what a run wrote and notes it; returns the run's folder. An id that is taken gets a number."""
    output, config, at = Path(output), dict(config or {}), timestamp or datetime.now()
    if not output.is_dir():
        raise FileNotFoundError(f"no output folder: {output}")
    model_type = str(model_type or config.get("model_type", ""))
    name = run_id or new_run_id(model_type or "model", at)
    to, k = Path(runs_dir) / name, 2
    while True:
        try:
            to.mkdir(parents=True)
            break
        except FileExistsError:
            to, k = Path(runs_dir) / f"{name}-{k}", k + 1
    for p in _kept(output):
        (shutil.copytree if p.is_dir() else shutil.copy2)(p, to / p.name)
    noted = {
        "run_id": to.name, "created_at": at.isoformat(timespec="seconds"), "task": task, "model_type": model_type, "data_path": str(config.get("data", config.get("data_path", ""))),
        "metrics": metrics or {}, "config": config, "selected_features": list(selected_features or []),
    }
    (to / INDEX).write_text(json.dumps(plain(noted), indent=2, ensure_ascii=False, allow_nan=False))
    if config:
        import yaml

        (to / "config.yaml").write_text(yaml.safe_dump(plain(config), sort_keys=False, allow_unicode=True))
    return to


def load_run(path: str | Path) -> RunRecord:
    path = Path(path)
    if not (path / INDEX).is_file():
        raise FileNotFoundError(f"no {INDEX} in {path}")
    noted = json.loads((path / INDEX).read_text())
    known = {k: v for k, v in noted.items() if k in RunRecord.__dataclass_fields__ and v is not None}
    return RunRecord(**({"run_id": path.name} | known | {"path": path}))


def list_runs(runs_dir: str | Path = "runs") -> list[RunRecord]:
    """Newest first; folders without a readable run.json are left out."""
    found = []
    for p in Path(runs_dir).glob(f"*/{INDEX}"):
        try:
            found.append(load_run(p.parent))
        except (ValueError, TypeError, OSError):
            continue
    return sorted(found, key=lambda r: (r.created_at, r.run_id), reverse=True)


def resolve_run(reference: str, runs_dir: str | Path = "runs") -> RunRecord:
    """A run by id, else "latest" or "latest~n", else a folder's path, else an id's beginning that is no other's."""
    known = list_runs(runs_dir)
    if same := [r for r in known if r.run_id == reference]:
        return same[0]
    if m := re.fullmatch(r"latest(?:~(\d+))?", str(reference)):
        k = int(m[1] or 0)
        if k >= len(known):
            raise FileNotFoundError(f"there are only {len(known)} runs in {runs_dir}")
        return known[k]
    if (Path(reference) / INDEX).is_file():
        return load_run(reference)
    begun = [r for r in known if r.run_id.startswith(str(reference))]
    if len(begun) > 1:
        raise ValidationError(f"{reference!r} is ambiguous: {', '.join(r.run_id for r in begun[:5])}")
    if not begun:
        raise FileNotFoundError(f"no run {reference!r} in {runs_dir}")
    return begun[0]


def compare_runs(left: RunRecord, right: RunRecord) -> dict:
    """metrics: left, right and delta of each; settings that differ, but a run's own paths; features added, removed, shared."""

    def both(name: str) -> dict:
        a, b = left.metrics.get(name), right.metrics.get(name)
        numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
        return {"left": a, "right": b, "delta": b - a if numbers else None}

    names = sorted({*left.config, *right.config} - OWN_TO_A_RUN)
    changes = {k: {"left": left.config.get(k), "right": right.config.get(k)} for k in names if left.config.get(k) != right.config.get(k)}
    a, b = set(left.selected_features), set(right.selected_features)
    return {
        "left": left.run_id, "right": right.run_id, "metrics": {m: both(m) for m in sorted({*left.metrics, *right.metrics})}, "config_changes": changes,
        "features": {"added": sorted(b - a), "removed": sorted(a - b), "shared": len(a & b)},
    }


def format_runs(runs: list[RunRecord]) -> str:
    """A line for each run, with the headline metrics that any of them has."""
    if not runs:
        return "No runs"
    shown = [m for m in HEADLINE if any(m in r.headline() for r in runs)]
    rows = [("RUN", "MODEL", "FEATURES", *map(str.upper, shown))]
    rows += [(r.run_id, r.model_type, str(len(r.selected_features)), *(f"{r.headline()[m]:.4f}" if m in r.headline() else "-" for m in shown)) for r in runs]
    width = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows)


def format_comparison(diff: dict) -> str:
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    pair = lambda x: f"{show(x['left'])} -> {show(x['right'])}"
    lines = [f"{diff['left']}  ->  {diff['right']}"]
    lines += [f"  {k}: {pair(x)}" + ("" if x["delta"] is None else f" ({x['delta']:+.4f})") for k, x in diff["metrics"].items()]
    lines += [f"  config {k}: {pair(x)}" for k, x in diff["config_changes"].items()]
    return "\n".join([*lines, *(f"  + {f}" for f in diff["features"]["added"]), *(f"  - {f}" for f in diff["features"]["removed"])])


def runs_table(spark: SparkSession, runs_dir: str) -> DataFrame:
    """All run.json files as a table."""
    return spark.read.option("multiLine", True).json(f"{runs_dir}/*/{INDEX}")
