"""Shared folders, materialised tables and sizes."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space and words as all operators here see them.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder of this machine stands for it, but only if there is no other machine (a local master, as in
    tests): executors elsewhere would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "textgauge")
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table below the shared folder; the session's folders go with `clear_scratch`."""
    return f"{shared_dir(spark)}/textgauge-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes this session's intermediate tables.  Frames that read them can't be used any more."""
    remove(spark, f"{shared_dir(spark)}/textgauge-{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: While a table is written: its query's shuffle files go when it ends, and what is sent to Python workers at once is small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def writing(spark: SparkSession):
    """Sets what holds while a table is written."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes the frame to the shared folder and reads it again: this cuts the lineage, and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with writing(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textgauge_path = path
    return out


def drop_table(table: DataFrame) -> None:
    """Removes a table that `materialise` has written, once its last reader is done."""
    remove(table.sparkSession, table._textgauge_path)


#: Rows of one id each that are broadcast at most: 32 MB.
BROADCAST_MOST = 1 << 22


def if_small(ids: DataFrame) -> DataFrame:
    """A table of ids for a join: broadcast if its rows are few, as counted, so that the other side needn't move."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_MOST else ids


#: A key with more than this share of all rows, and more than so many, is hot; so at most 1 / HOT_SHARE keys are.
HOT_SHARE, HOT_LEAST = 1e-5, 1 << 10


def join_back(rows: DataFrame, facts: DataFrame, key: str, size: str, columns: list[str]) -> DataFrame:
    """The rows with the columns of that fact which has their key, or nulls; each key has one fact, and `size` rows.

    `facts` is a table; it is read three times.  Facts of hot keys are broadcast, at most 1 / HOT_SHARE of them.  Their rows,
    and those without a key, pass through the join of the others under keys of their own, so that no task gets all rows of a
    key.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    hot, cold = facts.where(F.col(size) > least), facts.where(F.col(size) <= least)
    told = F.broadcast(hot.select(F.col(key), F.struct(*columns).alias("__hot")))
    rows = rows.join(told, key, "left")
    away = F.concat_ws(" ", F.lit("hot"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("__key", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(away))
    others = cold.select(F.col(key).cast("string").alias("__key"), F.struct(*columns).alias("__cold"))
    out = rows.join(others, "__key", "left").withColumn("__fact", F.coalesce("__hot", "__cold")).drop("__key", "__hot", "__cold")
    return out.select("*", *(F.col(f"__fact.{c}").alias(c) for c in columns)).drop("__fact")


#: Turns of a conversation that one task puts in order.
TURNS = 1 << 10


def in_order(rows: DataFrame, key: str, turn: str, tie: Column, name: str) -> DataFrame:
    """With a column `name`: each row's place among those of its key, from 1, by turn (null first) and tie.

    Rows are ordered within stretches of TURNS turn numbers, and those before a stretch are counted, so that one key's rows
    are not one task's.  `rows` is read twice.  The rows of a null key are placed among themselves.
    """
    stretch = F.coalesce(F.floor(F.col(turn) / TURNS), F.lit(-(1 << 60)))
    counts = rows.groupBy(F.col(key).alias("__key"), stretch.alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy("__key").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    later = counts.withColumn("__before", F.sum("__n").over(order)).where("__before is not null").drop("__n")
    rows = rows.withColumn("__stretch", stretch)
    rows = rows.withColumn("__at", F.row_number().over(W.partitionBy(key, "__stretch").orderBy(F.col(turn).asc_nulls_first(), tie)))
    rows = rows.join(later, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__stretch") == F.col("__of")), "left")
    return rows.withColumn(name, F.col("__at") + F.coalesce("__before", F.lit(0))).drop("__key", "__of", "__before", "__stretch", "__at")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context: they may have neither it nor this machine's folders."""
    context = spark.sparkContext
    if getattr(context, "_textgauge_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="textgauge-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._textgauge_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def buckets_for(spark: SparkSession, total_bytes: float, bucket_bytes: float = 16 << 20) -> int:
    """So many hash buckets that each holds about bucket_bytes, and one for each shuffle partition at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / bucket_bytes), 1)


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(m)
