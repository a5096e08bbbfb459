"""Corpus tables, source catalogues and raw works."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

REQUIRED = ["id", "texto", "target"]


class DataIOError(RuntimeError):
    """A table that can't be read or written as asked."""


def _once(columns: list[str]) -> None:
    if len(set(columns)) != len(columns):
        raise DataIOError("duplicate column names")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, quoted line breaks and inferred types; a byte order mark is no part of the first name."""
    if not path.lower().endswith(".csv"):
        raise DataIOError(f"not a .csv file: {path}")
    try:
        df = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"', encoding="UTF-8")
    except AnalysisException as e:
        raise DataIOError(f"cannot read {path}") from e
    if not df.columns:
        raise DataIOError(f"empty file: {path}")
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    _once(df.columns)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files; the committer makes all of it visible at once."""
    _once(df.columns)
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def read_sources(df: DataFrame) -> DataFrame:
    """The catalogue: title and work default to slug and title; of repeated slugs the last row (by `position`) counts."""
    rows = df.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "slug"))
    rows = rows.withColumn("work", F.coalesce(F.nullif("work", F.lit("")), "title"))
    best = rows.groupBy("slug").agg(F.max(F.struct("position", *[c for c in rows.columns if c not in ("slug", "position")])).alias("b"))
    return best.select("slug", "b.*")


def read_works(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    """The catalogue with each work's text from folder/slug.txt; found is false where there is none."""
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("slug"), F.col("value").alias("text"))
    return catalogue.join(texts, "slug", "left").withColumn("found", F.col("text").isNotNull())


def candidate_addresses() -> F.Column:
    """Distinct addresses to try for a source, in order: its own, then those that follow from its number."""
    number = F.trim(F.coalesce("source_id", F.lit("")))
    site = "https://www.gutenberg.org"
    made = [f"{site}/cache/epub/%1$s/pg%1$s.txt", f"{site}/files/%1$s/%1$s-0.txt", f"{site}/files/%1$s/%1$s.txt", f"{site}/ebooks/%1$s.txt.utf-8"]
    own = [F.trim(F.coalesce(c, F.lit(""))) for c in ("url", "text_url")]
    return F.array_distinct(F.filter(F.array(*own, *(F.when(number != "", F.format_string(m, number)) for m in made)), lambda x: x.isNotNull() & (x != "")))


def decode(data: bytes) -> str:
    """UTF-8, with or without a byte order mark, else Latin-1, which takes any bytes."""
    for name in ("utf-8-sig", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise AssertionError


def write_json(payload: Mapping, path: str) -> None:
    """A mapping as JSON, complete or not at all; sets are sorted, dates are ISO."""
    if not isinstance(payload, Mapping):
        raise DataIOError("only mappings are written as JSON")

    def plain(x):
        if isinstance(x, (set, frozenset)):
            return sorted(x)
        if isinstance(x, (date, datetime)):
            return x.isoformat()
        if hasattr(x, "asDict"):
            return x.asDict(recursive=True)
        if hasattr(x, "item"):
            return x.item()
        raise TypeError(type(x).__name__)

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".tmp")
    part.write_text(json.dumps(payload, ensure_ascii=False, indent=2, default=plain), encoding="utf-8")
    part.replace(target)


def manifest(attempts: DataFrame) -> DataFrame:
    """Counts of downloads, and the exit status: 0 all fetched, 1 some, 2 none."""
    ok = F.count(F.when(F.col("ok"), 1))
    counts = attempts.agg(F.count(F.lit(1)).alias("sources"), ok.alias("fetched"))
    return counts.withColumn("status", F.when(F.col("fetched") == 0, 2).when(F.col("fetched") < F.col("sources"), 1).otherwise(0))


def download_with_retries(urls: list[str], fetch: Callable[[str], bytes], attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, list[dict]]:
    """The first address that gives a text, decoded, and a log of all attempts; None if none does.

    `fetch` gets an address; what it raises, and a blank text, is a failed attempt.  Each address is tried `attempts` times
    with a pause between.
    """
    log: list[dict] = []
    for url in urls:
        for k in range(1, attempts + 1):
            if log:
                sleep(pause)
            try:
                text = decode(fetch(url))
                error = None if text.strip() else "blank"
            except Exception as e:  # noqa: BLE001  whatever the fetcher raises
                error = f"{type(e).__name__}: {e}"
            log.append({"url": url, "attempt": k, "ok": error is None, "error": error})
            if error is None:
                return text, log
    return None, log


def download_all(sources: list[dict], folder: str, fetch: Callable[[str], bytes], partial: bool = False, **options) -> dict:
    """Fetches each source (slug, urls) into folder/slug.txt; the manifest has a row for each, counts and an exit status.

    0 all fetched, or some and `partial`; 1 some; 2 none.
    """
    rows = []
    for s in sources:
        text, log = download_with_retries(s["urls"], fetch, **options)
        if text is not None:
            at = Path(folder) / f"{s['slug']}.txt"
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text, encoding="utf-8")
        rows.append({"slug": s["slug"], "ok": text is not None, "characters": len(text or ""), "attempts": log})
    fetched = sum(r["ok"] for r in rows)
    status = 0 if fetched == len(rows) and rows else 2 if not fetched else 0 if partial else 1
    return {"sources": len(rows), "fetched": fetched, "failed": len(rows) - fetched, "status": status, "rows": rows}


def promote(spark: SparkSession, candidate: str, main: str, backup: bool = True, now: datetime | None = None) -> str | None:
    """The candidate table takes the place of the main one, which is kept under its name and the time if there is one; its path."""
    if candidate.rstrip("/") == main.rstrip("/"):
        raise DataIOError("a table can't take its own place")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(main).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path(candidate)):
        raise DataIOError(f"no table at {candidate}")
    part = f"{main}.new"
    store.delete(path(part), True)
    conf = spark._jsc.hadoopConfiguration()
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, path(candidate), store, path(part), False, conf)
    kept = None
    if store.exists(path(main)):
        kept = f"{main}.{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}.bak" if backup else None
        store.rename(path(main), path(kept)) if kept else store.delete(path(main), True)
    store.rename(path(part), path(main))
    return kept
