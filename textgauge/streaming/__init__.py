"""The per-row expressions work on streams as they are; this scores a stream of texts as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textgauge.functions import features as X


def score_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    """The builder's features and the complexity score of each row: stateless, so it may run in any output mode."""
    return X.builder(rows, text).withColumn("score", X.complexity_score())
