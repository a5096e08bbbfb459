"""Leakage between splits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.functions import lexicons as lex
from textgauge.functions import text as T
from textgauge.operators.near import near_copies
from textgauge.sources.scratch import saved

SPLITS = ["train", "val", "test"]
PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


def value_overlap(df: DataFrame, value: Column, check: str) -> DataFrame:
    """For each pair of splits, the number of distinct non-empty values that both have.

    Values are digests, grouped once for all pairs.
    """
    rows = df.select("split", T.strip(T.coerce(value)).alias("v")).where("v <> ''")
    by = rows.groupBy(F.sha2("v", 256).alias("d")).agg(*(F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")))
    counts = by.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in PAIRS))
    entries = F.array(*(F.struct(F.lit(check).alias("check"), F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"{a}_{b}").alias("shared")) for a, b in PAIRS))
    return counts.select(F.explode(entries).alias("x")).select("x.*")


def across_splits(df: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What `find` makes of the rows of each pair of splits, with left_split and right_split; df has a column split."""
    sides = [(a, b, find(df.where(F.col("split") == a).drop("split"), df.where(F.col("split") == b).drop("split"))) for a, b in PAIRS]
    return reduce(DataFrame.unionByName, [x.select(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), *x.columns) for a, b, x in sides])


def target_like_columns(columns: list[str], exempt: list[str]) -> list[str]:
    """Columns whose normalised name is one that gives the target away, or contains `target`."""
    import re

    def norm(name: str) -> str:
        return re.sub("[^0-9a-z]+", " ", T.fold_accents(name.strip().lower())).strip().replace(" ", "_")

    known = {norm(x) for x in lex.TARGET_LIKE}
    return [c for c in columns if c not in exempt and (norm(c) in known or "target" in norm(c))]


def near_duplicates(left: DataFrame, right: DataFrame, id_col: str, text_col: str, threshold: float = 0.92, length_ratio: float = 0.70, n: int = 5) -> DataFrame:
    """left_id, right_id, similarity of all rows on either side that are near copies; for tables with few copies, as pairs are expanded."""
    sides = [x.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(s).alias("part")) for s, x in (("left", left), ("right", right))]
    return near_copies(sides[0].unionByName(sides[1]), "id", "text", "part", ["left", "right"], threshold, length_ratio, n).expanded("left", "right")


def near_duplicates_across(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.92) -> DataFrame:
    """left_split, right_split, left_id, right_id, similarity of near copies in each pair of splits, all found at once."""
    found = near_copies(df, id_col, text_col, "split", SPLITS, threshold)
    return reduce(DataFrame.unionByName, [found.expanded(a, b).select(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), "left_id", "right_id", "similarity") for a, b in PAIRS])


def near_duplicate_counts(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.92) -> DataFrame:
    """For each row its id, split, class_id, and how many rows of other splits equal it when normalised (copies) or are near copies (links, those among them).

    class_id is the smallest id of the rows with the same normalised text.  Rows without a letter or digit are classes of
    their own with no link; so are rows of no split.  Nothing is expanded into pairs of rows.
    """
    linked = near_copies(df, id_col, text_col, "split", SPLITS, threshold).linked()
    # a plain letter or digit stays one, so few texts are normalised here
    blank = F.when(F.col(text_col).cast("string").rlike("[0-9A-Za-z]"), False).otherwise(T.leakage_form(F.col(text_col)) == "")
    rest = df.where(blank | F.col("split").isNull() | ~F.col("split").isin(SPLITS))
    alone = rest.select(F.col(id_col).alias("id"), F.col("split").alias("part"), F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return linked.unionByName(alone).withColumnsRenamed({"id": id_col, "part": "split"})


def summary(findings: DataFrame) -> DataFrame:
    """Findings by severity, and whether the corpus fails: any critical one does."""
    return findings.agg(F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warning"), F.count(F.lit(1)).alias("findings")).withColumn("failed", F.col("critical") > 0)


class LeakageError(RuntimeError):
    """Critical leakage where it is not allowed."""


def gate(counts, fail_on_critical: bool = True) -> None:
    if fail_on_critical and counts["critical"]:
        raise LeakageError(f"{counts['critical']} critical findings")


def finding(severity: str, check: str, message: str, **details) -> dict:
    return {"severity": severity, "check": check, "message": message, "details": details}


def report_of(findings: list[dict], status: str | None = None) -> dict:
    counts = {f"{k}_findings": sum(f["severity"] == k for f in findings) for k in ("info", "warning", "critical")}
    found = status or ("failed" if counts["critical_findings"] else "passed")
    return {"summary": {"total_findings": sum(counts.values()), **counts, "status": found}, "findings": findings}


def disabled() -> dict:
    """The report of a run whose checks are switched off."""
    report = report_of([finding("info", "leakage_checks_disabled", "the checks are switched off")], "disabled")
    report["summary"]["total_findings"] = 0
    return report


def check(df: DataFrame, id_col: str, text_col: str, target_col: str, clean_col: str | None = None, threshold: float = 0.92, records: int = 1000, enabled: bool = True) -> dict:
    """All checks between the splits of `df`, which has a column split: the report, with findings by severity.

    Shared ids and texts that are equal, as they are or normalised, are critical; near copies and columns that name the target
    are warnings.  Near copies are all counted; the first `records` of each pair of splits are listed.  `gate` decides.
    """
    if not enabled:
        return disabled()
    out = []
    used = {id_col, text_col, target_col, clean_col, "split"}
    if named := target_like_columns([c for c in df.columns if c not in used], []):
        out.append(finding("warning", "target_like_columns", f"columns that give the target away: {', '.join(named)}", columns=named))
    checks = [("id_overlap", F.col(id_col).cast("string"), "critical"), ("exact_text_overlap", F.col(text_col), "critical"), ("normalized_text_overlap", T.leakage_form(F.col(clean_col or text_col)), "critical")]
    for name, value, severity in checks:
        for r in value_overlap(df, value, name).orderBy("left_split", "right_split").collect():
            if r.shared:
                out.append(finding(severity, name, f"{r.left_split} and {r.right_split} share {r.shared} values", left=r.left_split, right=r.right_split, shared=r.shared))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(clean_col or text_col), F.lit("")).alias("text"), "split", F.col(target_col).cast("string").alias("target"))
    near = saved(near_duplicates_across(rows, "id", "text", threshold), "near-copies")
    for left, right in PAIRS:
        pairs = near.where((F.col("left_split") == left) & (F.col("right_split") == right))
        if n := pairs.count():
            listed = near_records(pairs.orderBy(F.desc("similarity"), "left_id", "right_id").limit(records), rows).collect()
            out.append(finding("warning", "near_duplicate_texts", f"{n} near copies in {left} and {right}", left=left, right=right, pairs=n, records=[r.asDict() for r in listed]))
    return report_of(out)


def near_records(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with the targets and previews of both sides; `pairs` are few."""
    for side in ("left", "right"):
        mine = rows.select(F.col("id").alias(f"{side}_id"), F.col("split").alias(f"{side}_split"), F.col("target").alias(f"{side}_target"), T.preview(F.col("text"), 160).alias(f"{side}_preview"))
        pairs = pairs.join(mine, [f"{side}_id", f"{side}_split"])
    return pairs


FINDINGS = "severity string, check string, message string"


def findings_frame(spark, report: dict) -> DataFrame:
    return spark.createDataFrame([(f["severity"], f["check"], f["message"]) for f in report["findings"]], FINDINGS)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeated values; of two empty ones 1, of one empty one 0."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)
