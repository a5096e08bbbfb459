"""Markdown of what the operators found."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

from textgauge.sources.tables import DataIOError


def write_text_file(text: str, path: str) -> Path:
    """The text with one line break at its end, complete or not at all; a blank one is refused."""
    if not isinstance(text, str) or not text.strip():
        raise DataIOError("nothing to write")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex[:8]}.tmp")
    part.write_text(text.rstrip("\n") + "\n", encoding="utf-8")
    part.replace(target)
    return target


def cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, float):
        return f"{x:.6f}".rstrip("0").rstrip(".")
    return str(x).replace("|", r"\|").replace("\n", " ")


def table(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def frame(df: DataFrame, most: int = 200) -> str:
    """A small frame as a table: its first rows, and a line that says so if there are more."""
    rows = df.limit(most + 1).collect()
    more = f"\n\nMore than {most} rows." if len(rows) > most else ""
    return table(df.columns, rows[:most]) + more


def sections(title: str, parts: Mapping[str, str]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{text}" for name, text in parts.items() if text)])


def bullets(values: Mapping) -> str:
    return "\n".join(f"- {k}: {cell(v)}" for k, v in values.items())


def dataset_card(name: str, classes: DataFrame, lengths: DataFrame | None = None, notes: Sequence[str] = ()) -> str:
    """What a corpus holds: rows by class, rows by class and length, and what else is to be said."""
    return sections(f"Dataset card: {name}", {"Classes": frame(classes), "Lengths": frame(lengths) if lengths is not None else "", "Notes": "\n".join(f"- {n}" for n in notes)})


def audit_report(frames: Mapping[str, DataFrame], warnings: Sequence[str] = ()) -> str:
    found = "\n".join(f"- {w}" for w in warnings) or "No warnings."
    return sections("Dataset audit", {"Warnings": found, **{name: frame(df) for name, df in frames.items()}})


def leakage_report(report: Mapping) -> str:
    """The report of `leakage.check` or `leakage.disabled`."""
    s = report["summary"]
    listed = "\n\n".join(f"### {k}. {f['severity']}: {f['check']}\n\n{f['message']}" for k, f in enumerate(report["findings"], 1))
    return sections("Leakage", {"Summary": bullets(s), "Findings": listed or "No leakage was found."})


def evaluation_report(metrics: Mapping, classes: DataFrame, confusion: DataFrame, best: Mapping, extra: Mapping[str, Mapping | None] | None = None) -> str:
    """The final report; with `extra` (leakage, folds, search, fingerprint), whatever of it there is, the extended one."""
    parts = {"Best experiment": bullets(best), "Metrics": bullets(metrics), "Classes": frame(classes), "Confusion": frame(confusion)}
    for name, values in (extra or {}).items():
        if values:
            parts[name] = bullets({k: v for k, v in values.items() if not isinstance(v, (list, dict))})
    return sections("Evaluation" if extra is None else "Extended evaluation", parts)
