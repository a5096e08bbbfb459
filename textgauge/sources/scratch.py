"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


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


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine stands for it only where there is no other machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "textgauge-tables")
    return at.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table of this session."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: A query's shuffles end with it, and Python workers get small batches.
RELEASING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def releasing(spark: SparkSession):
    """While tables are written one after another, each written table's shuffles go at once."""
    before = {k: spark.conf.get(k, None) for k in RELEASING}
    for k, v in RELEASING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table: what is costly is computed once for several readers, and a lost executor loses nothing of it.

    `dropped` removes it once its last reader is done; `clear_tables` removes all of a session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textgauge_path = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `saved` has written and that nobody reads any more."""
    for t in tables:
        removed(t.sparkSession, t._textgauge_path)


def clear_tables(spark: SparkSession) -> None:
    """Removes this session's intermediate tables.  Frames that read them can't be used any more."""
    removed(spark, session_folder(spark))
