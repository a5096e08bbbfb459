"""Profiles of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.functions import text as T
from textgauge.operators.ranking import quantiles
from textgauge.sources.scratch import saved


def measured(df: DataFrame, text: str) -> DataFrame:
    """With n words, words a sentence and the share of distinct lower-case words."""
    df = df.withColumn("__w", T.words(F.col(text))).withColumn("n", F.size("__w"))
    distinct = F.size(F.array_distinct(F.split(F.lower(F.array_join("__w", " ")), " ")))
    df = df.withColumn("ttr", F.when(F.col("n") == 0, 0.0).otherwise(distinct / F.col("n")))
    return df.withColumn("per_sentence", F.col("n") / F.greatest(F.size(T.sentences(F.col(text))), F.lit(1))).drop("__w")


def metrics_by_class(df: DataFrame, text: str, target: str) -> DataFrame:
    """Rows and lengths by class.  Texts are measured once, into a table; medians are found by counting ranges of lengths."""
    rows = saved(measured(df, text).select(target, "n", "per_sentence", "ttr"), "measured")
    by = rows.groupBy(target).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("n"), 4).alias("words_mean"), F.min("n").cast("long").alias("words_min"), F.max("n").cast("long").alias("words_max"),
        F.round(F.avg("per_sentence"), 4).alias("sentence_mean"), F.round(F.avg("ttr"), 4).alias("ttr_mean"),
    )
    medians = quantiles(rows, target, "n", [0.5]).select(F.col(target).alias("__class"), F.round(F.col("q")[0], 4).alias("words_median"))
    # one row a class
    out = by.join(F.broadcast(medians), F.col(target).eqNullSafe(F.col("__class")), "left")
    return out.select(target, "rows", "words_mean", "words_median", "words_min", "words_max", "sentence_mean", "ttr_mean")


def length_crosstab(df: DataFrame, text: str, target: str, labels: list[str]) -> DataFrame:
    """All six bins by all labels, with zeros."""
    bins = [name for _, name in T.AUDIT_BINS] + [">220"]
    counts = df.groupBy(T.audit_length_bin(F.size(T.words(F.col(text)))).alias("bin")).agg(*(F.count(F.when(F.col(target) == x, 1)).alias(x) for x in labels))
    every = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(bins)], "position int, bin string")
    return every.join(counts, "bin", "left").na.fill(0, labels)


def duplicate_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows beyond the first of each: exact texts, normalised texts, ids."""
    n = F.count(F.lit(1))
    return df.agg(
        (n - F.countDistinct(F.sha2(T.coerce(F.col(text)), 256))).alias("exact"),
        (n - F.countDistinct(F.sha2(T.normalize_text(T.coerce(F.col(text))), 256))).alias("normalised"),
        (n - F.countDistinct(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("ids"),
    )


def repeated_sentences(df: DataFrame, text: str, most: int = 30) -> DataFrame:
    """The most frequent normalised sentences of four tokens or more that occur at least twice."""
    s = df.select(F.explode(T.sentences(F.col(text))).alias("s")).select(T.normalize_text(F.col("s")).alias("sentence"))
    s = s.where(F.size(F.split("sentence", " ")) >= 4)
    return s.groupBy("sentence").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "sentence").limit(most).where("occurrences > 1")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))


def gap_ratio(df: DataFrame, text: str, target: str, warn: float = 0.10) -> DataFrame:
    """How far the classes' mean lengths are apart, as a share of the smallest (1 word at least); null if a class has no words."""
    means = df.groupBy(target).agg(F.avg(F.size(T.words(F.col(text)))).alias("m"))
    gap = F.when(F.min("m") > 0, (F.max("m") - F.min("m")) / F.greatest(F.lit(1.0), F.min("m")))
    return means.agg(F.round(gap, 9).alias("gap")).withColumn("warns", F.coalesce(F.col("gap") > warn, F.lit(False)))


def concentration(df: DataFrame, column: str, warn: float, most: int = 20) -> DataFrame:
    """The most frequent values with their shares of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("rows") / F.col("total"), 9))
    return shares.select("value", "rows", "share", (F.col("share") > warn).alias("warns")).orderBy(F.desc("rows"), "value").limit(most)


def threshold_warnings(df: DataFrame, id_col: str, text: str, target: str, min_rows: int = 10_000, min_class: int = 3_000) -> DataFrame:
    """A row for each threshold that the corpus misses."""
    few = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_rows).select(F.lit("rows").alias("what"), F.lit("all").alias("which"), "n")
    small = df.groupBy(F.col(target).alias("which")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_class).select(F.lit("class").alias("what"), "which", "n")
    d = duplicate_counts(df, id_col, text)
    copies = d.select(F.explode(F.array(*(F.struct(F.lit("duplicates").alias("what"), F.lit(k).alias("which"), F.col(k).alias("n")) for k in ("exact", "normalised", "ids")))).alias("x")).select("x.*").where("n > 0")
    return few.unionByName(small).unionByName(copies)
