"""Folds, metrics and tables of results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textgauge.functions import text as T
from textgauge.operators.ranking import first_rows, ranked


class MergeError(ValueError):
    """Two tables that should match row by row don't."""


def merge_one_to_one(prepared: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """The join of prepared rows and their features; raises unless keys are unique on both sides and all rows match."""
    n = [x.count() for x in (prepared, features)]
    if any(x.select(*keys).distinct().count() != k for x, k in zip((prepared, features), n)):
        raise MergeError("keys are not unique")
    out = prepared.join(features, keys)
    if not out.count() == n[0] == n[1]:
        raise MergeError("rows without a partner")
    return out


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (k * n of the class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(target, (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def confusion(df: DataFrame, true: str = "y", predicted: str = "p") -> DataFrame:
    """true, predicted, n for all labels on either side, with zeros; bounded by the number of labels."""
    counts = df.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("true", "predicted")).alias("label")).distinct()
    every = labels.select(F.col("label").alias("true")).crossJoin(labels.select(F.col("label").alias("predicted")))
    full = every.join(counts, ["true", "predicted"], "left").na.fill(0, ["n"])
    row = F.greatest(F.sum("n").over(W.partitionBy("true")), F.lit(1))
    return full.select("true", "predicted", "n", F.bround(F.col("n") / row, 6).alias("share"))


def per_class(df: DataFrame, true: str = "y", predicted: str = "p") -> DataFrame:
    """label, support, predicted, hits, precision, recall, f1; 0 where nothing divides."""
    counts = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("g"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h"))))
    by = counts.select(entry.alias("e")).select("e.*").groupBy("label").agg(F.sum("s").alias("support"), F.sum("g").alias("predicted"), F.sum("h").alias("hits"))

    def over(a, b):
        return F.when(b == 0, 0.0).otherwise(a / b)

    by = by.withColumn("precision", over(F.col("hits"), F.col("predicted"))).withColumn("recall", over(F.col("hits"), F.col("support")))
    return by.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "balanced_accuracy"]


def metrics(df: DataFrame, true: str = "y", predicted: str = "p") -> DataFrame:
    """The six metrics to six decimals; macro means over all labels, balanced accuracy over true ones only."""
    c = per_class(df, true, predicted)
    return c.agg(
        F.bround(F.sum("hits") / F.sum("support"), 6).alias("accuracy"), F.bround(F.avg("precision"), 6).alias("precision_macro"), F.bround(F.avg("recall"), 6).alias("recall_macro"), F.bround(F.avg("f1"), 6).alias("f1_macro"),
        F.bround(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("f1_weighted"), F.bround(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("balanced_accuracy"),
    )


def report(df: DataFrame, true: str = "y", predicted: str = "p") -> DataFrame:
    """Precision, recall, f1 and support by class, with accuracy, macro and weighted averages as further rows."""
    c = per_class(df, true, predicted)
    total = F.sum("support")
    r = lambda x: F.bround(x, 6)
    classes = c.select("label", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"), r(F.col("f1")).alias("f1"), "support")
    accuracy = r(F.sum("hits") / total)
    rows = [c.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), total.alias("support")).withColumn("label", F.lit("accuracy"))]
    rows.append(c.agg(*(r(F.avg(x)).alias(x) for x in ("precision", "recall", "f1")), total.alias("support")).withColumn("label", F.lit("macro avg")))
    rows.append(c.agg(*(r(F.sum(F.col(x) * F.col("support")) / total).alias(x) for x in ("precision", "recall", "f1")), total.alias("support")).withColumn("label", F.lit("weighted avg")))
    for x in rows:
        classes = classes.unionByName(x.select(*classes.columns))
    return classes


def stratified_folds(df: DataFrame, id_col: str, target: str, k: int, seed: str = "") -> DataFrame:
    """With a fold: ranks by digest of seed and id within each class, modulo k.  Raises if the smallest class has fewer than k rows."""
    smallest = df.groupBy(target).count().agg(F.min("count")).first()[0] or 0
    if k < 2 or smallest < k:
        raise ValueError(f"{k} folds need that many rows of each class; the smallest has {smallest}")
    name = F.col(id_col).cast("string")
    rows = ranked(df, target, F.md5(F.concat(F.lit(seed), name)) if seed else F.md5(name), name)
    return rows.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank", "__size")


def repeated_folds(df: DataFrame, id_col: str, target: str, k: int, repeats: int) -> DataFrame:
    """`stratified_folds` under `repeats` seeds: each row once for each repeat, with repeat and fold."""
    if repeats < 1:
        raise ValueError("one repeat is needed")
    parts = [stratified_folds(df, id_col, target, k, str(r) if r else "").withColumn("repeat", F.lit(r)) for r in range(repeats)]
    return reduce(DataFrame.unionByName, parts)


def effective_splits(requested: int, groups: int) -> int:
    """The folds that so many groups allow."""
    if requested < 2 or groups < 2:
        raise ValueError("two groups and two folds are needed")
    return min(requested, groups)


GROUP_CANDIDATES = ("obra", "titulo", "título", "title", "work", "autor", "author", "fonte", "source")


def select_group_column(df: DataFrame, id_col: str, preferred: str = "obra", candidates: Sequence[str] = GROUP_CANDIDATES, by_row: bool = True) -> tuple[str, str, DataFrame]:
    """The first candidate with two usable groups at least: its name, how it was found, and the group of each id.

    Nulls and blanks aren't usable; in a column that is chosen, nulls are a group of their own, 'nan'.  Without such a column
    each id is a group, or, with by_row off, it is an error.
    """
    present = [c for c in dict.fromkeys([*([preferred] if preferred else []), *candidates]) if c in df.columns]
    usable = df.agg(*(F.countDistinct(F.when(~T.is_blank(F.col(c)), T.group_value(F.col(c)))).alias(c) for c in present)).first() if present else {}
    for c in present:
        if usable[c] >= 2:
            group = F.when(F.col(c).isNull(), "nan").otherwise(T.group_value(F.col(c)))
            return c, "preferred_column" if c == preferred else "fallback_column", df.select(id_col, group.alias("group"))
    if not by_row:
        raise ValueError("no column has two usable groups")
    return "__row_group__", "synthetic_row_id", df.select(id_col, F.concat(F.lit("row_"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("group"))


def group_folds(sizes: dict[str, int], k: int) -> dict[str, int]:
    """Largest group first into the lightest fold."""
    k = effective_splits(k, len(sizes))
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        out[g] = f
        load[f] += n
    return out


def summary(results: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Mean, population standard deviation, least and largest of each metric, and the rank by the first."""
    stats = [f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", lambda c: F.bround(F.avg(c), 6)), ("std", lambda c: F.bround(F.stddev_pop(c), 6)), ("min", F.min), ("max", F.max))]
    out = results.groupBy(key).agg(F.count(F.lit(1)).alias("folds"), *stats)
    order = [F.desc(f"{c}_mean") for c in names] + [F.col(key)]
    return out.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))  # one row for each experiment


class SelectionError(ValueError):
    """Experiments of which none can be chosen."""


def best(results: DataFrame, metric: str) -> DataFrame:
    """The experiment with the largest metric, then f1_weighted, accuracy, then the earliest.

    No experiments, a column that isn't there, and a metric that is null or not finite are errors: such a run has failed.
    """
    if metric not in results.columns:
        raise SelectionError(f"no metric {metric}; there are {', '.join(results.columns)}")
    m = F.col(metric).cast("double")
    n, bad = results.agg(F.count(F.lit(1)), F.count(F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")), 1))).first()
    if not n or bad:
        raise SelectionError(f"{bad} of {n} experiments have no finite {metric}" if n else "no experiments")
    return results.orderBy(F.desc(metric), F.desc("f1_weighted"), F.desc("accuracy"), "position").limit(1)


def fold_metrics(df: DataFrame, fold: str, labels: list[str], true: str = "y", predicted: str = "p") -> DataFrame:
    """fold, rows, accuracy and precision_macro, recall_macro, f1_macro, means over the fixed labels: one that a fold lacks counts as 0.

    Rows with a label beyond the list count for accuracy alone.  One aggregation, with as many sums as there are labels.
    """
    y, p = F.col(true), F.col(predicted)
    sums = [F.sum(F.when(cond, 1).otherwise(0)).alias(f"__{kind}{i}") for i, x in enumerate(labels) for kind, cond in (("hit", (y == x) & (p == x)), ("true", y == x), ("said", p == x))]
    by = df.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(y == p, 1.0).otherwise(0.0)).alias("accuracy"), *sums)
    each = [[F.col(f"__{kind}{i}") for kind in ("hit", "true", "said")] for i in range(len(labels))]

    def mean(parts):
        return F.bround(sum((T.ratio(a, b) for a, b in parts), F.lit(0.0)) / max(len(labels), 1), 6)

    precision, recall, f1 = mean([(h, s) for h, _, s in each]), mean([(h, t) for h, t, _ in each]), mean([(2 * h, t + s) for h, t, s in each])
    return by.select(fold, "rows", F.bround("accuracy", 6).alias("accuracy"), precision.alias("precision_macro"), recall.alias("recall_macro"), f1.alias("f1_macro"))


def softmax(margins):
    """Shifted softmax of an array; equal shares if it sums to nothing."""
    top = F.array_max(margins)
    e = F.transform(margins, lambda m: F.exp(m - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(margins)))


def top_terms(coefficients: DataFrame, most: int = 30) -> DataFrame:
    """class, direction, rank, term, coefficient: the largest and the smallest coefficients of each class."""
    c = coefficients.withColumn("coefficient", F.bround("coefficient", 8))
    sides = []
    for name, order in (("positive", F.desc("coefficient")), ("negative", F.asc("coefficient"))):
        sides.append(first_rows(c, ["class"], [order, "term"], most, "rank").withColumn("direction", F.lit(name)))
    return sides[0].unionByName(sides[1]).select("class", "direction", "rank", "term", "coefficient")


def shown_rows(predicted: DataFrame, id_col: str, rows: int = 10) -> DataFrame:
    """The first rows of each predicted class, with their position."""
    return first_rows(predicted, ["class"], [id_col], rows, "position")


def local_terms(weights: DataFrame, predicted: DataFrame, coefficients: DataFrame, id_col: str, rows: int = 10, most: int = 10, chosen: bool = False) -> DataFrame:
    """For the first rows of each predicted class (or those of `shown_rows`, if they are `chosen` already) the terms with the largest contributions."""
    parts = weights.join(predicted if chosen else shown_rows(predicted, id_col, rows), id_col).join(coefficients, ["class", "term"])
    parts = parts.withColumn("contribution", F.round(F.col("weight") * F.col("coefficient"), 8))
    rank = F.row_number().over(W.partitionBy("class", id_col).orderBy(F.desc("contribution"), "term")).cast("long")
    return parts.withColumn("term_rank", rank).where(F.col("term_rank") <= most).select("class", id_col, "position", "term_rank", "term", "contribution")


def results_table(results: DataFrame, metric: str) -> DataFrame:
    """Experiments, best first: by the metric, then f1_weighted, accuracy and the order in which they came; with their place."""
    order = [F.col(metric).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ("f1_weighted", "accuracy") if c != metric), F.asc("position")]
    return results.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))  # one row for each experiment


def predictions(df: DataFrame, id_col: str, true: str, predicted: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(true).alias("target"), F.col(predicted).alias("predicted_target"), (F.col(true) == F.col(predicted)).alias("correct"))


def prediction_distribution(df: DataFrame, predicted: str) -> DataFrame:
    return df.groupBy(F.col(predicted).alias("predicted_target")).agg(F.count(F.lit(1)).alias("rows"))


def experiment_bars(results: DataFrame, name: str, metric: str, most: int = 20) -> DataFrame:
    """The best experiments for a bar chart: name, value, place."""
    order = [F.col(metric).desc_nulls_last(), F.col(name)]
    place = F.row_number().over(W.orderBy(*order)).cast("long")
    return results.select(F.col(name).alias("name"), F.col(metric).alias("value"), place.alias("place")).where(F.col("place") <= most)


def fold_bars(summarised: DataFrame, key: str, metric: str, most: int = 20) -> DataFrame:
    """The best experiments of `summary` with their mean and spread over folds."""
    rows = experiment_bars(summarised, key, f"{metric}_mean", most)
    return rows.join(summarised.select(F.col(key).alias("name"), F.col(f"{metric}_std").alias("spread")), "name")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin, low, high, rows of values from 0 to 1, with empty bins; 1 is in the last one, nulls don't count."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.createDataFrame([(k, k / bins, (k + 1) / bins) for k in range(bins)], "bin int, low double, high double")
    return every.join(counts, "bin", "left").na.fill(0, ["rows"])


class TestFrameError(ValueError):
    """A test table that can't be evaluated; all faults in one message."""

    __test__ = False


def check_test_frame(df: DataFrame, id_col: str, target: str) -> int:
    """The rows of a test table; raises TestFrameError unless it has rows, unique ids without nulls, and no blank target."""
    if missing := [c for c in (id_col, target) if c not in df.columns]:
        raise TestFrameError(f"missing columns: {', '.join(missing)}")
    r = test_frame_counts(df, id_col, target).first()
    faults = [f"{r[k]} {text}" for k, text in (("null_ids", "null ids"), ("repeated_ids", "repeated ids"), ("blank_targets", "blank targets")) if r[k]]
    if not r["rows"]:
        faults.append("no rows")
    if faults:
        raise TestFrameError("; ".join(faults))
    return r["rows"]


def test_frame_counts(df: DataFrame, id_col: str, target: str) -> DataFrame:
    """Rows, null ids, ids beyond the first of each, blank targets."""
    rows = F.count(F.lit(1))
    blank = F.count(F.when(F.col(target).isNull() | T.is_blank(F.col(target)), 1))
    return df.agg(rows.alias("rows"), F.count(F.when(F.col(id_col).isNull(), 1)).alias("null_ids"), (F.count(id_col) - F.countDistinct(id_col)).alias("repeated_ids"), blank.alias("blank_targets"))


test_frame_counts.__test__ = False  # type: ignore[attr-defined]
