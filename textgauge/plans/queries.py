"""The registered queries for the engine's own operators."""

from __future__ import annotations

from textgauge.plans import corpus_queries, model_queries, text_queries  # noqa: F401
from textgauge.plans.registry import QUERIES

feature_means_by_lang = text_queries.feature_means_by_lang


def queries():
    return dict(QUERIES)
