"""Settings, runs and the artifacts they must leave."""

from __future__ import annotations

import hashlib
import json
import logging
import platform
import subprocess
import sys
import time
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path


class SettingsError(ValueError):
    """Settings that don't make sense."""


MODELS = {"logistic_regression", "linear_svm", "random_forest"}
REPRESENTATIONS = {"linguistic_metrics", "tfidf_word", "tfidf_char", "tfidf_word_plus_linguistic_metrics"}
METRICS = {"accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "balanced_accuracy"}


@dataclass(frozen=True)
class Settings:
    """One experiment.  Defaults are the usual values; whole numbers and switches are not taken for each other."""

    id_column: str = "id"
    text_column: str = "texto"
    target_column: str = "target"
    train_size: float = 0.70
    val_size: float = 0.15
    test_size: float = 0.15
    long_word_min_chars: int = 7
    word_terms: int = 5000
    char_terms: int = 3000
    models: tuple[str, ...] = ("logistic_regression", "linear_svm", "random_forest")
    representations: tuple[str, ...] = ("linguistic_metrics", "tfidf_word", "tfidf_char", "tfidf_word_plus_linguistic_metrics")
    selection_metric: str = "f1_macro"
    n_splits: int = 5
    near_duplicate_threshold: float = 0.92
    fail_on_critical_leakage: bool = True
    run_id_format: str = "%Y%m%d_%H%M%S"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        faults = []
        for f in fields(self):
            v, kind = getattr(self, f.name), f.type
            good = {"str": isinstance(v, str) and v != "", "int": isinstance(v, int) and not isinstance(v, bool) and v > 0, "float": isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v <= 1, "bool": isinstance(v, bool)}
            if kind in good and not good[kind]:
                faults.append(f"{f.name}: {v!r}")
        for name, allowed in (("models", MODELS), ("representations", REPRESENTATIONS)):
            v = getattr(self, name)
            if not v or len(set(v)) != len(v) or set(v) - allowed:
                faults.append(f"{name}: {v!r}")
        if self.selection_metric not in METRICS:
            faults.append(f"selection_metric: {self.selection_metric!r}")
        if not faults and abs(self.train_size + self.val_size + self.test_size - 1) > 1e-6:
            faults.append("the split doesn't sum to 1")
        if self.n_splits == 1:
            faults.append("n_splits: 1")
        if "%" not in self.run_id_format:
            faults.append("run_id_format has no %")
        if faults:
            raise SettingsError("; ".join(faults))

    @classmethod
    def load(cls, path: str, most: int = 2 << 20) -> Settings:
        """From a JSON mapping of at most 2 MB; unknown names are kept in `extra`."""
        p = Path(path)
        if not p.is_file() or p.stat().st_size > most:
            raise SettingsError(f"no settings file of at most {most} bytes: {path}")
        data = json.loads(p.read_text(encoding="utf-8"))
        if not isinstance(data, dict):
            raise SettingsError("settings must be a mapping")
        known = {f.name for f in fields(cls)} - {"extra"}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known}
        return cls(**values, extra={k: v for k, v in data.items() if k not in known})


def fingerprint(path: str) -> dict:
    """SHA-256 in pieces of 1 MB, size and time of a file; one that is missing is reported, not raised."""
    p = Path(path)
    if not p.is_file():
        return {"path": p.as_posix(), "exists": False}
    digest = hashlib.sha256()
    with p.open("rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    stat = p.stat()
    return {"path": p.as_posix(), "exists": True, "sha256": digest.hexdigest(), "size_bytes": stat.st_size, "modified": datetime.fromtimestamp(stat.st_mtime, timezone.utc).isoformat()}


PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def environment(folder: str = ".") -> dict:
    """Python, platform, the versions of packages and the commit of the folder; what can't be found out is None."""

    def git(*words: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    changed = git("status", "--porcelain")
    return {"python": sys.version, "platform": platform.platform(), "packages": {n: version(n) for n in PACKAGES}, "commit": git("rev-parse", "HEAD"), "changed": None if changed is None else bool(changed)}


class JsonLines(logging.Formatter):
    """A log record as a line of JSON, its time in UTC."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False)


def start_logging(level: str = "INFO", kind: str = "text", stream=None) -> logging.Logger:
    """The package's logger, with one handler: text or JSON lines, times in UTC."""
    if kind not in ("text", "json"):
        raise SettingsError(f"unknown kind of log {kind}")
    plain = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s", "%Y-%m-%dT%H:%M:%SZ")
    plain.converter = time.gmtime
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonLines() if kind == "json" else plain)
    logger = logging.getLogger("textgauge")
    logger.handlers[:] = [handler]
    logger.setLevel(level.upper())
    logger.propagate = False
    return logger


MARKERS = ("pyproject.toml", ".git", "bench.py")


def project_root(start: str | None = None) -> Path:
    """The nearest folder from `start` upwards that has one of the markers."""
    at = Path(start or ".").resolve()
    for folder in (at, *at.parents):
        if any((folder / m).exists() for m in MARKERS):
            return folder
    raise FileNotFoundError(f"no project around {at}")


def relative_path(path: str, root: str) -> str:
    """The path below the root with forward slashes, or the whole path if it lies elsewhere."""
    at, base = Path(path).resolve(), Path(root).resolve()
    return at.relative_to(base).as_posix() if at.is_relative_to(base) else at.as_posix()


SUBFOLDERS = ["metrics", "models", "reports", "figures", "explainability"]


def start_run(root: str, settings: Settings, dataset: str | None = None, now: datetime | None = None) -> Path:
    """A new folder named by the time in UTC, with _02 and so on if there is one, and what describes the run."""
    name = (now or datetime.now(timezone.utc)).strftime(settings.run_id_format)
    base, k = Path(root), 1
    while True:
        folder = base / (name if k == 1 else f"{name}_{k:02d}")
        try:
            folder.mkdir(parents=True)
            break
        except FileExistsError:
            k += 1
    for s in SUBFOLDERS:
        (folder / s).mkdir()
    write = lambda n, x: (folder / n).write_text(json.dumps(x, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    write("settings.json", asdict(settings))
    write("environment.json", environment())
    if dataset:
        write("data_fingerprint.json", fingerprint(dataset))
    write("run_manifest.json", {"run_id": folder.name, "started": datetime.now(timezone.utc).isoformat(), "status": "started"})
    return folder


def finish_run(folder: Path, status: str = "ok") -> None:
    p = folder / "run_manifest.json"
    data = json.loads(p.read_text(encoding="utf-8")) | {"status": status, "finished": datetime.now(timezone.utc).isoformat()}
    p.write_text(json.dumps(data, indent=2), encoding="utf-8")
    (folder.parent / "latest.txt").write_text(folder.name, encoding="utf-8")


#: What a smoke run and a complete run must leave.
SMOKE = ["settings.json", "environment.json", "data_fingerprint.json", "run_manifest.json", "metrics/leakage_report.json", "metrics/cv_summary.json", "models/best_experiment.json", "metrics/final_metrics.json", "reports/final_report_extended.md", "models/best_model"]
COMPLETE = SMOKE + ["reports/leakage_report.md", "metrics/cv_results.csv", "reports/cv_report.md", "metrics/hyperparameter_search_results.csv", "metrics/best_hyperparameters.json", "reports/hyperparameter_search_report.md", "models/experiment_results.csv", "metrics/classification_report.json", "metrics/classification_report.txt", "metrics/test_predictions.csv", "figures/confusion_matrix_absolute.csv", "reports/final_report.md"]


def check_artifacts(folder: str, kind: str = "smoke") -> list[tuple[str, str]]:
    """(artifact, ok | missing | empty | invalid) for each that the kind of run requires."""
    out = []
    for name in {"smoke": SMOKE, "complete": COMPLETE}[kind]:
        p = Path(folder) / name
        status = "missing" if not p.exists() else "ok"
        if p.is_file() and p.stat().st_size == 0 or p.is_dir() and not any(p.iterdir()):
            status = "empty"
        elif p.is_file() and name.endswith(".json"):
            try:
                json.loads(p.read_text(encoding="utf-8"))
            except ValueError:
                status = "invalid"
        out.append((name, status))
    return out
