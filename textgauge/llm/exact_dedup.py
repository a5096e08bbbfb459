"""Exact deduplication by skew-safe combining.

Copies are removed in three stages, each of which has the whole normalised text in its grouping key, so that full contents
are compared and never digests alone:

1. each task folds the copies it has read (the partial aggregation on the map side);
2. the folded rows meet in salted digest groups, so that the copies of one text are dealt over `salts` tasks;
3. the salts' winners are combined into one winner a text.

The winners then go back to all rows by digest; those of texts with very many copies are broadcast, so that no task gets all
rows of one text.  If two different texts ever had one digest, those rows would be joined by digest and content instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, join_back, materialise


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after each run of white space has become one blank; null counts as empty, and an empty text
    equals other empty ones only.  Of equal texts the row with the smallest id stays; a null id stays only where no row of
    the group has one.  Repeated rows (same id, same text) count in group_size and share `kept`.  Of the other columns none
    is read, whatever their names.  A text of any length is compared whole.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text"))
    rows = rows.withColumn("__sha", F.sha2(F.col("__text"), 256))
    salted = (
        rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("byte"))
        .groupBy("__sha", "__salt", "__text")
        .agg(F.min("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    )
    winners = salted.groupBy("__sha", "__text").agg(F.min("__keep").alias("__keep"), F.sum("__n").alias("__n"))
    # a text of its own for digests that collide; null for all others
    by_sha = winners.groupBy("__sha").agg(F.count(F.lit(1)).alias("__texts"), F.min("__keep").alias("__keep"), F.max("__n").alias("__n"))
    by_sha = materialise(by_sha, "exact-winners")
    simple = join_back(rows.drop("__text"), by_sha.where("__texts = 1"), "__sha", "__n", ["__keep", "__n"]).where("__n is not null")
    collided = by_sha.where("__texts > 1").select("__sha")
    if not collided.isEmpty():
        both = winners.join(collided, "__sha", "left_semi")
        simple = simple.unionByName(rows.join(both, ["__sha", "__text"]).drop("__text").select(*simple.columns))
    return simple.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
