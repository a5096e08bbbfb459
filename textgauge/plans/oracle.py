"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from textgauge.plans import queries  # noqa: F401  (registers them)
from textgauge.plans.registry import SQL


def oracle_sql():
    return dict(SQL)
