"""Validation, cleaning and splitting of a labelled corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textgauge.functions import text as T
from textgauge.operators.ranking import ranked


def assigned_split(id_col: Column) -> Column:
    """70 / 15 / 15 by the id's remainder, for tables that come without a split."""
    r = F.pmod(id_col, F.lit(20))
    return F.when(r < 14, "train").when(r < 17, "val").otherwise("test")


def null_and_blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = [x for c in columns for x in (F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}"), F.count(F.when(F.col(c).isNotNull() & T.is_blank(F.col(c)), 1)).alias(f"blank_{c}"))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts)


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that occur more than once, as text, in order of their text."""
    return df.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1").orderBy("id")


def text_groups(df: DataFrame, id_col: str, text_col: str, normalised: bool = True) -> DataFrame:
    """Groups of equal texts of more than one row: digest, occurrences, the smallest id and a preview."""
    key = F.lower(T.clean_text(F.col(text_col))) if normalised else T.coerce(F.col(text_col))
    rows = df.select(F.col(id_col).cast("string").alias("id"), key.alias("key"))
    # digests are grouped, not texts
    groups = rows.groupBy(F.sha2("key", 256).alias("digest")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("id").alias("first_id"), F.min(T.preview(F.col("key"), 120)).alias("preview"))
    return groups.where("occurrences > 1")


def duplicate_examples(df: DataFrame, id_col: str, text_col: str, groups: int = 10, ids: int = 10, normalised: bool = True) -> DataFrame:
    """The first groups of equal texts in the order of their previews: preview, the smallest ids, occurrences."""
    first = text_groups(df, id_col, text_col, normalised).orderBy("preview", "digest").limit(groups)
    key = F.lower(T.clean_text(F.col(text_col))) if normalised else T.coerce(F.col(text_col))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.sha2(key, 256).alias("digest"))
    place = F.row_number().over(W.partitionBy("digest").orderBy("id"))
    members = rows.join(F.broadcast(first.select("digest")), "digest").withColumn("place", place).where(F.col("place") <= ids)  # a few rows
    named = members.groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return first.join(named, "digest").select("preview", "ids", "occurrences").orderBy("preview")


def involved_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that have a copy, counting all members: exact and normalised."""
    exact = text_groups(df, id_col, text_col, False).agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("exact_rows"))
    return exact.crossJoin(text_groups(df, id_col, text_col).agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("normalised_rows")))


class CorpusError(ValueError):
    """All faults of a corpus in one message."""


def validate(df: DataFrame, id_col: str = "id", text_col: str = "texto", target_col: str = "target") -> list[str]:
    """Raises CorpusError with all faults found; returns the warnings.  One pass for counts, one each for duplicates."""
    faults = []
    if len(set(df.columns)) != len(df.columns):
        faults.append("duplicate column names")
    missing = [c for c in (id_col, text_col, target_col) if c not in df.columns]
    if missing:
        raise CorpusError("; ".join([*faults, f"missing columns: {', '.join(missing)}"]))
    counts = null_and_blank_counts(df, [id_col, text_col, target_col]).first()
    if counts.rows == 0:
        raise CorpusError("; ".join([*faults, "no rows"]))
    for c in (id_col, text_col, target_col):
        for what in ("null", "blank"):
            if counts[f"{what}_{c}"]:
                faults.append(f"{counts[f'{what}_{c}']} {what} values in {c}")
    if repeated := duplicate_ids(df, id_col).count():
        faults.append(f"{repeated} duplicate ids")
    if df.agg(F.countDistinct(target_col)).first()[0] < 2:
        faults.append("fewer than two classes")
    if counts.rows < 3:
        faults.append("fewer than three rows")
    if faults:
        raise CorpusError("; ".join(faults))
    involved = involved_rows(df, id_col, text_col).first()
    return [f"{involved[k]} rows with {w} copies" for k, w in (("exact_rows", "exact"), ("normalised_rows", "normalised")) if involved[k]]


def prepared(df: DataFrame, text_col: str = "texto", clean_col: str = "texto_limpo", keep_original: bool = True, normalize_whitespace: bool = True) -> DataFrame:
    """With the cleaned text beside the original, or in its place too."""
    out = df.withColumn(clean_col, T.clean_text(F.col(text_col), normalize_whitespace))
    return out if keep_original else out.withColumn(text_col, F.col(clean_col))


def split_counts(n: int, test: float, val: float) -> tuple[int, int, int]:
    """(train, val, test): test and val are rounded up, val as a share of what test leaves."""
    t = math.ceil(round(n * test, 9))
    v = math.ceil(round((n - t) * (val / (1 - test)), 9))
    return n - t - v, v, t


def cut(rows: DataFrame, test: float, val: float) -> DataFrame:
    """Ranked rows with a `split`: of each group test and val from the front, as many as `split_counts` says."""
    n = F.col("__size")
    t = F.ceil(F.round(n * test, 9))
    v = F.ceil(F.round((n - t) * (val / (1 - test)), 9))
    split = F.when(F.col("__rank") <= t, "test").when(F.col("__rank") <= t + v, "val").otherwise("train")
    return rows.withColumn("split", split).drop("__rank", "__size")


def apportioned(sizes: list[int], whole: int) -> list[int]:
    """`whole` dealt to classes by their sizes: each its share rounded down, the rest to the largest remainders, earlier classes first."""
    total = max(sum(sizes), 1)
    out = [n * whole // total for n in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: (-(sizes[i] * whole % total), i))[: whole - sum(out)]:
        out[i] += 1
    return out


def stratified_split(df: DataFrame, id_col: str, target_col: str, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """With a `split` column: the parts have the sizes of `split_counts`, dealt to the classes by their sizes.

    Within each class rows are ranked by the digest of their id; test is the front, then val.  The classes, a few, come to the
    driver with their counts, in the order of their names, null last.
    """
    name = F.col(id_col).cast("string")
    classes = df.groupBy(F.col(target_col).alias("__class")).agg(F.count(F.lit(1)).alias("n"))
    counts = sorted(classes.collect(), key=lambda r: (r[0] is None, str(r[0])))
    _, v, t = split_counts(sum(r.n for r in counts), test, val)
    tests = apportioned([r.n for r in counts], t)
    vals = apportioned([r.n - k for r, k in zip(counts, tests)], v)
    ends = df.sparkSession.createDataFrame([(r[0], k, k + m) for r, k, m in zip(counts, tests, vals)], StructType([StructField("__class", classes.schema[0].dataType), StructField("__test", LongType()), StructField("__val", LongType())]))
    rows = ranked(df, target_col, F.md5(name), name).join(F.broadcast(ends), F.col(target_col).eqNullSafe(F.col("__class")))
    split = F.when(F.col("__rank") <= F.col("__test"), "test").when(F.col("__rank") <= F.col("__val"), "val").otherwise("train")
    return rows.withColumn("split", split).drop("__rank", "__size", "__class", "__test", "__val")


def split_dataset(df: DataFrame, id_col: str, target_col: str, test: float = 0.15, val: float = 0.15) -> tuple[DataFrame, list[str]]:
    """`stratified_split`, and warnings.  Where a class is too small to be in all three parts, one split of all rows and a warning."""
    smallest = df.groupBy(target_col).count().agg(F.min("count")).first()[0] or 0
    if smallest and all(x > 0 for x in split_counts(smallest, test, val)):
        return stratified_split(df, id_col, target_col, test, val), []
    name = F.col(id_col).cast("string")
    rows = ranked(df.withColumn("__all", F.lit(0)), "__all", F.md5(name), name)
    return cut(rows, test, val).drop("__all"), [f"not stratified: the smallest class has {smallest} rows"]


def sorted_by_id(df: DataFrame, id_col: str) -> DataFrame:
    """In the order of the ids' text."""
    return df.orderBy(F.col(id_col).cast("string"))


def preparation_report(df: DataFrame, split: DataFrame, id_col: str, text_col: str, target_col: str, warnings: list[str]) -> dict:
    """Rows, classes, faults and duplicates of the corpus, and what the parts have; counts alone come to the driver."""
    counts = null_and_blank_counts(df, [id_col, text_col, target_col]).first().asDict()
    classes = {str(r[0]): r[1] for r in df.groupBy(target_col).count().orderBy(target_col).collect()}
    parts = split.groupBy("split", target_col).count().collect()
    return {
        "rows": counts.pop("rows"), "columns": df.columns, "classes": classes, "counts": counts, "warnings": warnings,
        "duplicates": {"ids": duplicate_ids(df, id_col).count(), **involved_rows(df, id_col, text_col).first().asDict()},
        "examples": [r.asDict() for r in duplicate_examples(df, id_col, text_col).collect()],
        "splits": {s: {str(r[1]): r["count"] for r in sorted(parts, key=lambda r: str(r[1])) if r.split == s} for s in ("train", "val", "test")},
        "unseen": [list(r) for r in unseen_classes(split, target_col).orderBy("split", target_col).collect()],
    }


def unseen_classes(df: DataFrame, target_col: str) -> DataFrame:
    """Classes of val and test that train doesn't have."""
    train = df.where("split = 'train'").select(target_col).distinct()
    return df.where("split <> 'train'").select("split", target_col).distinct().join(train, target_col, "left_anti")
