"""Ranks and order statistics within groups that may be very large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of digests that a group is ranked by: four hexadecimal digits.
DIGITS = 4
#: Ranges of values that one round of `quantiles` counts.
RANGES = 1024


def ranked(df: DataFrame, group: str, digest: Column, ties: Column | None = None) -> DataFrame:
    """With __rank, from 1, by digest (hexadecimal) within the group, and __size, the group's rows.

    Rows are counted by group and range of digests first, so a group is ranked by as many tasks as it has ranges.
    """
    rows = df.withColumn("__digest", digest).withColumn("__range", F.substring("__digest", 1, DIGITS))
    counts = rows.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy("__group").orderBy("__of")
    counts = counts.select(
        "__group", "__of", F.coalesce(F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy("__group")).alias("__size")
    )
    place = F.row_number().over(W.partitionBy(group, "__range").orderBy("__digest", *([ties] if ties is not None else [])))
    out = rows.withColumn("__place", place).join(counts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__of")))
    return out.withColumn("__rank", F.col("__place") + F.col("__before")).drop("__digest", "__range", "__place", "__before", "__group", "__of")


#: Pieces of a group in which its first rows are looked for.
PIECES = 64


def first_rows(df: DataFrame, keys: list[str], order: list, most: int, rank: str) -> DataFrame:
    """The first `most` rows of each group in order, with their rank from 1.

    They are found in PIECES parts of each group first, so that no task gets all rows of a large one; equal rows share a part.
    """
    piece = F.pmod(F.xxhash64(*(c for c, t in df.dtypes if not t.startswith("map"))), F.lit(PIECES))
    rows = df.withColumn("__piece", piece)
    for by in ([*keys, "__piece"], keys):
        rows = rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= most)
    return rows.drop("__piece")


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group and q, an array of the exact quantiles, interpolated, of the group's values; nulls don't count.

    Each round counts the values by ranges and narrows to the range that holds the rank, until that is a single value: no task
    holds a group's values.  The groups are few: their state is on the driver.  `df` should be a table.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    # (group, rank from 0) -> least and largest value that it may be, and the rank within them
    open_: dict[tuple, tuple[float, float, int]] = {}
    for r in whole:
        for s in shares:
            at = s * (r.n - 1)
            for k in {math.floor(at), math.ceil(at)}:
                open_[r.g, k] = (r.lo, r.hi, k)
    found: dict[tuple, float] = {}
    spark = df.sparkSession
    while open_:
        found |= {x: lo for x, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {x: y for x, y in open_.items() if x not in found}
        if not open_:
            break
        keys = list(open_)
        facts = [(n, g, open_[g, k][0], open_[g, k][1]) for n, (g, k) in enumerate(keys)]
        bounds = F.broadcast(spark.createDataFrame(facts, f"t int, g {rows.schema['g'].dataType.simpleString()}, lo double, hi double"))  # a row for each group and rank
        inside = rows.join(bounds, rows.g.eqNullSafe(bounds.g) & F.col("v").between(F.col("lo"), F.col("hi"))).select("t", "v", "lo", "hi")
        width = (F.col("hi") - F.col("lo")) / RANGES
        range_ = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(RANGES - 1))
        counted = inside.groupBy("t", range_.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("t", "r").collect()
        rank, narrowed = {x: k for x, (_, _, k) in open_.items()}, {}
        for r in counted:  # by range, in order
            x = keys[r.t]
            if x not in narrowed:
                if rank[x] < r.n:
                    narrowed[x] = (r.lo, r.hi, rank[x])
                rank[x] -= r.n
        open_ = narrowed
    out = []
    for r in whole:
        qs = []
        for s in shares:
            at = s * (r.n - 1)
            a, b = found[r.g, math.floor(at)], found[r.g, math.ceil(at)]
            qs.append(a + (b - a) * (at - math.floor(at)))
        out.append((r.g, qs))
    return spark.createDataFrame(out, f"`{group}` {rows.schema['g'].dataType.simpleString()}, q array<double>")
