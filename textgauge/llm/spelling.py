"""Spelling variants: words one letter apart, and the frequent word that each may stand for.

If two words are one insertion, deletion or replacement apart, one half of the first is whole in the second: its first half at the
front or its second half at the end.

1. Words are cut in halves, and both segments of each word go to the shard of their hash.  A shard's Aho-Corasick automaton holds
   its segments with the words that have them.
2. All words are scanned, each by the shards that may hold its own front or end.  A hit counts if it is at the front for a first
   half, at the end for a second one, and if the word's length differs by one at most.
3. The words behind a hit are kept by what is left of them without one stretch of three letters, so that a hit leads to those
   only that agree outside of a stretch; their distance is then verified.  A pair that several stretches or both halves show
   counts where it shows first.
4. What a shard finds of a word is a count and the best neighbour; shards' findings are combined, and forms are followed to their
   roots by doubling.

A half that very many words share is dealt over the shards by half, length and the rest without the stretch.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, lower_ascii, materialise

RUN_RE = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: Letters of a stretch at least, and stretches of a half at most: those of long words are longer.
STRETCH, STRETCHES = 3, 16
#: Segments of a shard, and words of a half from which on it is dealt over shards.
SHARD, HOT_HALF = 1 << 16, 1 << 14


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspelt: int = 31, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """A table of word and n: runs of letters, A-Z lowered, of at least so many letters and occurrences.

    Every `misspelt`-th run, as crc32 of id and run says, lacks one letter.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN_RE}{{{letters},}}+)"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", lower_ascii(F.col("run")))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % misspelt == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)
    return materialise(rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "spelling-words")


def stretches(letters: int) -> list[tuple[int, int]]:
    """Where the stretches of so many letters begin and end."""
    size = max(STRETCH, math.ceil(letters / STRETCHES))
    return [(i, min(i + size, letters)) for i in range(0, letters, size)]


def outside(rest: Column, letters: Column, k: Column, longer: Column) -> Column:
    """`rest`, `longer` letters longer than `letters`, without the k-th stretch of that many letters."""
    size = F.greatest(F.lit(STRETCH), F.ceil(letters / STRETCHES)).cast("int")
    end = F.least((k + 1) * size, letters)
    return F.concat(F.substring(rest, F.lit(1), (k * size).cast("int")), F.lit(" "), F.substring(rest, (end + longer + 1).cast("int"), F.length(rest)))


def count_of(letters: Column) -> Column:
    return F.ceil(letters / F.greatest(F.lit(STRETCH), F.ceil(letters / STRETCHES))).cast("int")


def segments(words: DataFrame) -> DataFrame:
    """word, n, side (0: front, 1: end), half, length: two rows a word."""
    front = F.floor(F.length("word") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), front).alias("half")), F.struct(F.lit(1).alias("side"), F.substring(F.col("word"), front + 1, F.length("word")).alias("half")))
    return words.select("word", "n", F.length("word").alias("length"), F.explode(halves).alias("x")).select("word", "n", "length", "x.*")


def scans(words: DataFrame, letters: int) -> DataFrame:
    """word, side, half: the fronts and ends of a word that are halves of words as long as it, or one letter longer or shorter."""
    n = F.length("word")

    def of(length: Column) -> Column:
        front = F.floor(length / 2).cast("int")
        both = F.array(F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), front).alias("half")), F.struct(F.lit(1).alias("side"), F.right(F.col("word"), length - front).alias("half")))
        return F.when(length >= letters, both).otherwise(F.array().cast("array<struct<side:int,half:string>>"))

    found = F.array_distinct(F.concat(of(n - 1), of(n), of(n + 1)))
    return words.select("word", F.explode(found).alias("x")).select("word", "x.*")


def routed(rows: DataFrame, hot: DataFrame, shards: int, letters: int, scanned: bool) -> DataFrame:
    """Rows with shard and stretch: the shard of their half and -1 for all stretches, or, for a hot half, the shard of each stretch."""
    rows = rows.join(F.broadcast(hot), ["side", "half"], "left")
    n, m = F.length("word"), F.length("half")
    rest = F.when(F.col("side") == 0, F.substring(F.col("word"), m + 1, n)).otherwise(F.substring(F.col("word"), F.lit(1), n - m))

    def to(stretch: Column, *by) -> Column:
        return F.struct(stretch.alias("stretch"), F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int").alias("shard"))

    def of(length: Column) -> Column:
        left = length - m
        fits = (length >= letters) & (m == F.when(F.col("side") == 0, F.floor(length / 2)).otherwise(length - F.floor(length / 2)))
        keys = F.transform(F.sequence(F.lit(0), count_of(left) - 1), lambda k: to(k, "side", "half", length, k, outside(F.col("__rest"), left, k, n - length)))
        return F.when(fits, keys).otherwise(F.array().cast("array<struct<stretch:int,shard:int>>"))

    lengths = [n - 1, n, n + 1] if scanned else [n]
    routes = F.when(F.col("hot"), F.concat(*map(of, lengths))).otherwise(F.array(to(F.lit(-1), "side", "half")))
    return rows.withColumn("__rest", rest).withColumn("x", F.explode(routes)).drop("__rest", "hot").select("*", "x.*").drop("x")


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


FOUND = "word string, near long, best_n long, best string"


def searched(letters: int):
    """Finds, in a shard, the neighbours that its segments show of the words that are scanned."""

    def find(held: pa.Table, words: pa.Table) -> pa.Table:
        import ahocorasick

        automaton, behind = ahocorasick.Automaton(), {}
        for only, w, n, side, half in zip(*(held.column(c).to_pylist() for c in ("stretch", "held", "n", "side", "half"))):
            both = behind.setdefault(half, ({}, {}))
            rest = w[len(half) :] if side == 0 else w[: len(w) - len(half)]
            for k, (i, j) in enumerate(stretches(len(rest))):
                if only in (-1, k):
                    both[side].setdefault((len(w), k, rest[:i], rest[j:]), []).append((w, n))
        for half, both in behind.items():
            automaton.add_word(half, (len(half), both))
        out = ([], [], [], [])
        if behind:
            automaton.make_automaton()
            for x in dict.fromkeys(words.column("scanned").to_pylist()):
                near, best = 0, (0, "")
                for end, (m, both) in automaton.iter(x):
                    for side in (0, 1):
                        if both[side] and end == (m - 1 if side == 0 else len(x) - 1):
                            for w, n in neighbours(x, side, m, both[side]):
                                near += 1
                                if n > best[0] or n == best[0] and w < best[1]:
                                    best = (n, w)
                if near:
                    for column, value in zip(out, (x, near, *best)):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["word", "near", "best_n", "best"])

    def neighbours(x, side, m, kept):
        """The words of the half `x[:m]`, or of that at the end, that are one letter apart from x and show here first."""
        rest = x[m:] if side == 0 else x[: len(x) - m]
        for length in (len(x) - 1, len(x), len(x) + 1):
            if length < letters or m != (length // 2 if side == 0 else length - length // 2):
                continue
            longer = len(x) - length
            for k, (i, j) in enumerate(stretches(length - m)):
                for w, n in kept.get((length, k, rest[:i], rest[j + longer :]), ()):
                    other = w[m:] if side == 0 else w[: length - m]
                    if not one_apart(other[i:j], rest[i : j + longer]):
                        continue
                    # the stretch before shows it too, or the first half does
                    if longer and i and rest[i + longer :] == other[i:] or side == 1 and x.startswith(w[: length // 2]):
                        continue
                    yield w, n

    return find


def neighbours_of(words: DataFrame, letters: int = LEAST_LETTERS, hot_half: int = HOT_HALF, shard: int = SHARD) -> DataFrame:
    """word, near, best_n, best of the words that have neighbours: how many, and the most frequent, then smallest, of them."""
    spark, total = words.sparkSession, words.count()
    held = segments(words)
    # 2^20 at most
    hot = held.groupBy("side", "half").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(hot_half, total >> 19)).select("side", "half", F.lit(True).alias("hot"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total / shard))
    held = routed(held, hot, shards, letters, False).select("shard", "stretch", F.col("word").alias("held"), "n", "side", "half")
    scanned = routed(scans(words, letters), hot, shards, letters, True).select("shard", F.col("word").alias("scanned"))
    found = held.groupBy("shard").cogroup(scanned.groupBy("shard")).applyInArrow(searched(letters), FOUND)
    by = found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b"))
    return by.select("word", "near", (-F.col("b.m")).alias("best_n"), "b.best")


def rooted(forms: DataFrame) -> DataFrame:
    """A table of word and root of (word, form): forms are followed to the last.  They grow by FORM_RATIO, so they never return."""
    state = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("more")), "spelling-roots")
    while not state.where("more").isEmpty():
        on = state.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        after = state.select("word", "root").join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("more"))
        after = materialise(after, "spelling-roots")
        drop_table(state)
        state = after
    return state.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_half: int = HOT_HALF, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `word_counts`.

    Words are near if one inserted, deleted or replaced letter parts them.  A word's form is its near word of largest n, ties to
    the smallest, if that is FORM_RATIO times its own n at least; its root is the last form.  Null texts have no words and a null
    id counts as empty; repeated rows count again; texts and words of any length are read whole.  An empty table gives an empty
    result; other columns aren't read, whatever their names.
    """
    words = word_counts(docs, id_col, text_col)
    near = materialise(neighbours_of(words, LEAST_LETTERS, hot_half, shard), "spelling-near")
    rows = words.join(near, "word", "left")
    formed = F.col("best_n") >= FORM_RATIO * F.col("n")
    rows = rows.select("word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    rows = materialise(rows, "spelling-forms")
    roots = rooted(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
