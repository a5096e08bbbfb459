"""Tertile labels, caps and balancing.  Where a random order is wanted the digest of the id gives it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textgauge.functions.lexicons import LABELS
from textgauge.operators.ranking import first_rows, quantiles
from textgauge.sources.scratch import saved


def tertiles(df: DataFrame, bin_col: str, score: str) -> DataFrame:
    """q1 and q2 (exact, interpolated) of each bin."""
    q = quantiles(saved(df.select(bin_col, score), "scores"), bin_col, score, [1 / 3, 2 / 3])
    return q.select(bin_col, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))


def labelled(df: DataFrame, bin_col: str, score: str) -> DataFrame:
    """With target and the reason for it: low up to q1, medium up to q2, else high.  The rows are computed once, into a table."""
    df = saved(df, "scored")
    q = quantiles(df, bin_col, score, [1 / 3, 2 / 3]).select(bin_col, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))
    # one row for each length bin
    out = df.join(F.broadcast(q), bin_col)
    s = F.col(score)
    target = F.when(s <= F.col("q1"), LABELS[0]).when(s <= F.col("q2"), LABELS[1]).otherwise(LABELS[2])
    reason = F.format_string("score=%.4f; q1=%.4f; q2=%.4f", s, F.col("q1"), F.col("q2"))
    return out.withColumn("target", target).withColumn("reason", reason)


def capped(df: DataFrame, work: str, target: str, order: list, per_class: int = 320, per_work: int = 850) -> DataFrame:
    """At most per_class rows of a work and class, then at most per_work of a work, in order."""
    df = first_rows(df, [work, target], order, per_class, "__a").drop("__a")
    return first_rows(df, [work], order, per_work, "__b").drop("__b")


def balanced(df: DataFrame, target: str, bin_col: str, order: list, bins: int = 3, most: int = 5000) -> DataFrame:
    """As many rows of each class: the smallest class's, `most` at most; first an equal share of each bin, then others."""
    smallest = df.groupBy(target).count().agg(F.least(F.min("count"), F.lit(most)).alias("per_class"))
    df = df.crossJoin(F.broadcast(smallest))  # one row
    share = F.greatest(F.lit(1), F.floor(F.col("per_class") / bins))
    df = df.withColumn("__in", (F.row_number().over(W.partitionBy(target, bin_col).orderBy(*order)) <= share).cast("int"))
    df = df.withColumn("__r", F.row_number().over(W.partitionBy(target).orderBy(F.desc("__in"), *order)))
    return df.where(F.col("__r") <= F.col("per_class")).drop("__in", "__r", "per_class")


def numbered(df: DataFrame, order: list, width: int = 6) -> DataFrame:
    """With a sequential id in order.  For a corpus that `balanced` has bounded: one window numbers it."""
    return df.withColumn("id", F.lpad(F.row_number().over(W.orderBy(*order)).cast("string"), width, "0"))
