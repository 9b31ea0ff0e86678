"""Report tables as Markdown, text and workbooks."""

from __future__ import annotations

import csv
import re
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from ..sources.tables import save_json, write_xlsx

#: Metrics that sum a model up.
KEY_METRICS = ("auc", "auc_roc", "ks", "ks_statistic", "accuracy", "f1", "f1_score", "rmse", "r2")


def _text(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")


def markdown(df: DataFrame, most: int = 50) -> str:
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    lines += ["| " + " | ".join(map(_text, r)) + " |" for r in rows[:most]]
    return "\n".join(lines) + (f"\n\nonly the first {most} rows" if len(rows) > most else "")


def metrics_text(metrics: dict[str, float], title: str = "Model report") -> str:
    return "\n".join([title, "=" * len(title), *(f"{k}: {v:.4f}" for k, v in metrics.items() if v is not None)])


def save_markdown(tables: dict[str, DataFrame], path: str, most: int = 50) -> str:
    """The tables as sections of one Markdown file, or as a workbook if the path ends so."""
    if path.endswith(".xlsx"):
        return write_xlsx(tables, path)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n\n".join(f"## {n}\n\n{markdown(t, most)}" for n, t in tables.items()) + "\n")
    return path


def importance_chart(table: DataFrame, path: str, top: int = 20) -> str:
    """A bar for each of the most important features, as SVG."""
    rows = table.orderBy(table["importance"].desc(), "feature").limit(top).collect()
    most = max((abs(r["importance"]) for r in rows), default=0.0) or 1.0
    bars = [
        f'<text x="195" y="{20 * k + 15}" text-anchor="end">{escape(r["feature"])}</text><rect x="200" y="{20 * k + 3}" width="{380 * abs(r["importance"]) / most:.1f}" height="14" fill="#4477aa"/>'
        for k, r in enumerate(rows)
    ]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="600" height="{20 * len(rows) + 10}" font-family="sans-serif" font-size="12">{"".join(bars)}</svg>')
    return path


def generate_model_report(model, metrics: dict[str, float], importance: DataFrame, folder: str, name: str = "model_report") -> Path:
    """A folder with the model, metrics.json, feature_importance.csv and summary.json."""
    to = Path(folder, name)
    to.mkdir(parents=True, exist_ok=True)
    model.save(str(to / "model"))
    save_json(metrics, str(to / "metrics.json"))
    rows = importance.collect()  # a row for each feature
    with open(to / "feature_importance.csv", "w", newline="") as f:
        csv.writer(f).writerows([importance.columns, *rows])
    key = {k: v for k, v in metrics.items() if k in KEY_METRICS}
    save_json({"model_type": model.model_type, "n_features": len(rows), "key_metrics": key}, str(to / "summary.json"))
    return to


def next_path(folder: str, stem: str = "Model_Report") -> Path:
    """Model_Report_N.xlsx with the next free number."""
    found = [int(m[1]) for p in Path(folder).glob(f"{stem}_*.xlsx") if (m := re.fullmatch(rf"{stem}_(\d+)", p.stem))]
    return Path(folder) / f"{stem}_{max(found, default=0) + 1}.xlsx"


def write_model_report(tables: dict[str, DataFrame], folder: str) -> str:
    return write_xlsx(tables, str(next_path(folder)))
