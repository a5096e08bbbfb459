"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before has kept.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from textgauge.llm import language_id  # noqa: E402
from textgauge.llm.common import SPACE_RE, drop_table, if_small, lower_ascii, materialise, read_table, ship  # noqa: E402
from textgauge.llm.decontaminate import decontaminate  # noqa: E402
from textgauge.llm.jaccard_join import jaccard_components  # noqa: E402
from textgauge.llm.mixing import mix  # noqa: E402
from textgauge.llm.token_shards import token_shards  # noqa: E402


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, which takes the place of the one stated; the profiles are learned from these same documents.

    Null and empty texts, those without a letter, and those whose best cosine is not above chance go; if no document states a
    language, all do.  Texts of any length are read whole, repeated rows are treated alike, null ids stay, columns beyond
    those of documents pass through.  An empty table stays empty.
    """
    ship(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents, the one with the smallest id.

    Of rows that share the id of one that stays, one stays of each that are equal but for white space and case; rows with
    other texts are documents of their own and stay.  Rows without id can't be named as anyone's copy and stay.  Null and
    empty texts are linked with nothing.  Texts of any length are compared whole.  Columns beyond those of documents pass
    through, whatever their names.  An empty table stays empty.
    """
    ship(spark)
    joined = materialise(jaccard_components(docs), "pipeline-components")
    gone = materialise(joined.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
    kept = docs.join(if_small(gone), "doc_id", "left_anti")
    again = joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialise(again, "pipeline-again")
    if not again.isEmpty():  # ids that repeat
        again = if_small(again)
        words = F.trim(F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), SPACE_RE, " "))
        plain = [c for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
        rows = kept.join(again, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), words.alias("words"), F.xxhash64(*plain).alias("hash"))
        once = rows.groupBy("id", "words").agg(F.min_by("row", "hash").alias("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; nulls, empty and long texts, ties, repeated rows and other columns as in `contaminated`.

    Null and empty texts hold nothing and stay.  Without benchmark items all stay; an empty table stays empty.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document at least once, those of sources below their target weight repeated and in the order that the schedule says.

    Rows are written by runs of slots, each in order, so that documents are packed together as they were scheduled.  Nulls,
    ties, repeated rows, long texts, clashing names and empty tables are as in `mix`.
    """
    ship(spark)
    return mix(docs, in_order=True).select(*docs.columns)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards' sequences; nulls, empty and long texts, repeated rows, other columns and empty tables as in `write_shards`."""
    ship(spark)
    return token_shards(docs)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", shard_stage),
]

#: Prototypes, schedules and token ids have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder, read again by the next and then removed."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
        if before is not None:  # the last stage has written its shards and their list
            drop_table(before)
        before = docs
    return docs
