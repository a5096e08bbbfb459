"""Mixing sources to target weights by Pfair scheduling.

A source's documents make blocks.  The k-th block of a source of weight w may not run before slot floor((k - 1) / w), its
release, and must have run by slot ceil(k / w), its deadline.  One slot after the other takes, of the released blocks, the
one with the earliest deadline.  As the weights sum to one, no deadline is missed, so after any number t of slots each source
has had more than w t - 1 and fewer than w t + 1 blocks.

Releases and deadlines are exact: weights are kept as whole numbers over their total, and every slot up to the end of the mix
is scheduled.  That takes one step for each slot on the driver, which keeps only one job of each source and hands the slots on
in pieces of `PIECE` as a table.  Ranks within a source come from counts by source and hash bucket, so a source with a third of
all rows is ranked by as many tasks as its rows need.  The slots go to the buckets that have their blocks; so the documents
themselves move once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Documents a block.
BLOCK = 16
#: Slots that the driver holds at once.
PIECE = 1 << 19
#: Without weights given, a source's weight is its number of documents to this power.
TEMPERATURE = 0.9
#: Rows that one task ranks, about.
RANKED = 1_024
#: Slots that a partition of an ordered mix has, about, and the most partitions.
RUN, PARTITIONS_MOST = 512, 10_000


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """The positive weights as whole numbers in the same proportions, without rounding."""
    use = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in use.values()))
    return {s: int(w * scale) for s, w in use.items()}


def slots_of(weights: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, number of its block) of one slot after the other, by earliest deadline among the released blocks."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in weights]
    heapq.heapify(waiting)
    ready, slot = [], 0
    while weights:
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s, k))
        deadline, s, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))
        yield s, k
        slot += 1


def slot_pieces(weights: dict[str, int], blocks: dict[str, int], horizon: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The slots up to the end of the mix: number of the first, sources by their place in `weights`, and their blocks."""
    number, left = {s: i for i, s in enumerate(weights)}, len(weights)
    ends = {"cover": 0, "shortest": left - 1}[horizon]
    sources, numbers, first = [], [], 0
    for s, k in slots_of(weights):
        sources.append(number[s])
        numbers.append(k)
        left -= k + 1 == blocks[s]
        if left <= ends or len(sources) == PIECE:
            yield first, np.array(sources, np.int32), np.array(numbers, np.int64)
            first, sources, numbers = first + len(sources), [], []
        if left <= ends:
            return


def source_name(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    """Rows by source; a row of each source comes to the driver, which schedules them."""
    return {r["s"]: r["count"] for r in docs.groupBy(source_name(source_col).alias("s")).count().collect()}


ADDED = ["mix_slot", "mix_source", "mix_block", "mix_place", "mix_epoch"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, horizon: str = "cover", in_order: bool = False) -> DataFrame:
    """The documents, with all their columns, and mix_slot, mix_source, mix_block, mix_place, mix_epoch.

    A row that is scheduled several times comes several times.  horizon "cover" ends the mix when each source has had all its
    blocks, so no document is left out, and sources that have less than their weight begin again (mix_epoch counts from 0);
    "shortest" ends it when the first source has had all its blocks, and what the others have left is left out.  A null
    source is the source ''.  Sources without a weight, or with 0, are left out; weights of sources that don't occur are
    ignored.  Within a source rows are ordered by a hash of the id, then the id (a null id first), then a hash of all columns
    that have an order; only rows equal in all of these are in any order.  An empty table gives an empty mix.  Texts of any
    length and other columns pass through, whatever their names; those of the names that are added are replaced.  "cover"
    repeats the others as often as the least favoured source's weight demands, so a weight far below its size's share makes a
    long mix.  `in_order`: each partition is a run of slots, and its rows are in their order.
    """
    spark = docs.sparkSession
    counts = source_counts(docs, source_col)
    if weights is None:
        weights = {s: n**TEMPERATURE for s, n in counts.items()}
    exact = exact_weights({s: w for s, w in weights.items() if s in counts})
    blocks = {s: -(-counts[s] // block) for s in exact}
    names, pieces, end = list(exact), [], 0
    for first, sources, numbers in slot_pieces(exact, blocks, horizon):
        piece = pa.table({"number": sources, "j": numbers, "slot": first + np.arange(len(sources))})
        pieces.append(materialise(spark.createDataFrame(piece, "number int, j long, slot long"), "mix-slots"))
        end = first + len(sources)
    keep = [c for c in docs.columns if c not in ADDED]
    types = dict(docs.dtypes)
    if not pieces:
        return docs.limit(0).select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in zip(ADDED, ("long", "string", "long", "int", "long"))))
    slots = reduce(DataFrame.unionByName, pieces)

    # the row goes as one value, so that no name of its columns meets one of ours
    buckets = max(1, -(-sum(counts.values()) // RANKED))
    hashed = F.xxhash64(F.col(id_col).cast("string"))
    whole = F.xxhash64(*(F.col(c) for c in keep if not types[c].startswith(("map", "variant"))))
    rows = docs.select(F.struct(*keep).alias("row"), source_name(source_col).alias("source"), F.col(id_col).alias("id"), hashed.alias("hash"), whole.alias("all"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(buckets)))

    # what the buckets of a source have before them, and the slots of their blocks by epoch
    facts = materialise(spark.createDataFrame([(s, i, blocks[s]) for i, s in enumerate(names)], "source string, number int, blocks long"), "mix-sources")
    by = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).join(facts, "source")
    before = F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    by = by.withColumn("offset", F.coalesce(before, F.lit(0))).withColumn("first", F.floor(F.col("offset") / block).cast("long"))
    last = F.floor((F.col("offset") + F.col("n") - 1) / block).cast("long")
    by = by.withColumn("block", F.explode(F.sequence("first", last)))
    had = slots.join(facts.drop("source"), "number").select("number", (F.col("j") % F.col("blocks")).alias("block"), F.floor(F.col("j") / F.col("blocks")).alias("epoch"), "slot")
    had = had.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "slot"))).alias("slots"))
    given = by.join(had, ["number", "block"], "left").groupBy("source", "bucket", "offset", "first")
    given = materialise(given.agg(F.array_sort(F.collect_list(F.struct("block", "slots"))).alias("blocks")), "mix-buckets")

    rank = F.row_number().over(W.partitionBy("source", "bucket").orderBy("hash", "id", "all")) - 1
    ranked = rows.withColumn("rank", rank).join(given, ["source", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    own = F.get(F.col("blocks"), (F.col("block") - F.col("first")).cast("int"))
    out = ranked.withColumn("had", F.explode(own["slots"]))
    if in_order:
        run = max(RUN, -(-end // PARTITIONS_MOST))
        out = out.repartitionById(-(-end // run), F.floor(F.col("had.slot") / run).cast("int")).sortWithinPartitions("had.slot", "rank")
    added = [F.col("had.slot"), F.col("source"), F.col("block"), (F.col("rank") % block).cast("int"), F.col("had.epoch")]
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), *(c.alias(name) for c, name in zip(added, ADDED)))
