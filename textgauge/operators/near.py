"""Near copies by Jaccard similarity of character n-grams, for whole documents and many copies.

Rows with one normalised text are one class; only classes are compared.  Two sets of at most r grams that are similar enough
differ in H grams at most, H = 2r(1 - t)/(1 + t).  If grams are dealt to H + 1 parts by a hash, some part is the same in both
sets, so sets meet by the digests of their parts (about a dozen grams each) and no gram is ever a join key.  Parts without
grams would be alike in all sets: there are SPARE parts more than needed, and a set with at most as many empty ones need not
show them.  r is bounded by levels of size, in which similar sets are in the same or neighbouring ones.

Long texts of one vocabulary share some part with nearly every other, so a part is told with a sketch of its block, the parity of
its grams in 64 cells.  Blocks of c parts hold all grams, so where H grams differ some part is the same in a block of c - 1
differences at most, and sketches never differ in more cells than there are differences.  Candidates are verified on whole
sets, which are told by what they lack of and have beyond a set that their group shares.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.functions import text as T
from textgauge.sources.scratch import dropped, releasing, saved, ship

#: Parts beyond H + 1; sets with more empty parts than this also meet by these.
SPARE = 2
#: The least parts of a block, where a set has as many; blocks have less than twice as many.
BLOCK = 12
#: Bits of a key, and its lowest ones, which are the differences that its block may have.
KEY_BITS, LIMIT_BITS = 48, 6
#: Digests or grams that a task gathers before it hands them on.
BATCH = 1 << 20
#: The normalised form's letters: with the end of a short text 38 signs, of which 12 fit 63 bits, 5 fit 31.
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz "
MOST_N = 12
SIGNS = np.zeros(256, np.int64)
SIGNS[np.frombuffer(LETTERS, np.uint8)] = np.arange(1, len(LETTERS) + 1)


def levels(threshold: float, most: float = 2.0**40) -> np.ndarray:
    """The smallest size of each level; a level's largest is what its smallest may be similar to."""
    out = [1]
    while out[-1] < most:
        out.append(int(out[-1] / threshold + 1e-9) + 1)
    return np.array(out, np.int64)


def grams(form: str, n: int) -> np.ndarray:
    """The distinct n-grams of a normalised text between two blanks on each side, as numbers, in order; all of it if it has n signs at most."""
    if not form:
        return np.zeros(0, np.int64)
    signs = SIGNS[np.frombuffer(f"  {form}  ".encode("ascii"), np.uint8)].astype(np.int32 if n <= 5 else np.int64)
    n = min(n, len(signs))
    codes = signs[: len(signs) - n + 1].copy()
    for k in range(1, n):
        codes *= len(LETTERS) + 1
        codes += signs[k : len(signs) - n + 1 + k]
    codes.sort()
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_keys(codes: np.ndarray, threshold: float, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the set's parts in its own level and in the next, where larger sets may be similar to it, and the sketches of their blocks."""
    level = int(np.searchsorted(starts, len(codes), "right")) - 1
    spread = mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    place, cell = spread >> np.uint64(32), (spread & np.uint64(63)).astype(np.intp)
    # sums of 32 bits are exact in doubles, whatever their order
    halves = [(x & np.uint64(0xFFFFFFFF)).astype(np.float64) for x in (spread, spread * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32))]
    keys, sketches = [], []
    for at in (level, level + 1):
        differ = int(2 * (starts[at + 1] - 1) * (1 - threshold) / (1 + threshold) + 1e-6)
        spare = SPARE if differ else 0
        k = differ + 1 + spare
        part = (place * np.uint64(k) >> np.uint64(32)).astype(np.intp)
        low, high = (np.bincount(part, x, k).astype(np.uint64) for x in halves)
        full = (low | high) > 0
        if k - full.sum() > spare:
            full[:] = True
        blocks = max(k // BLOCK, 1)
        block = np.arange(k) * blocks // k
        limits = (np.bincount(block) - 1).astype(np.uint64)[block]
        odd = (np.bincount(block[part] * 64 + cell, minlength=blocks * 64) & 1).astype(np.uint8)
        names = np.arange(k, dtype=np.uint64) + np.uint64((at << 40) + 1)
        digests = mixed((high << np.uint64(32)) + low + mixed(names)) >> np.uint64(64 - KEY_BITS + LIMIT_BITS)
        keys.append(((digests << np.uint64(LIMIT_BITS)) + limits)[full])
        sketches.append(np.packbits(odd).view(np.uint64)[block][full])
    return np.concatenate(keys).view(np.int64), np.concatenate(sketches).view(np.int64)


def part_digests(codes: np.ndarray, threshold: float, starts: np.ndarray) -> np.ndarray:
    """The keys alone."""
    return part_keys(codes, threshold, starts)[0]


def normalised(batches):
    """id, part, digest and normalised form of rows of id, part, text."""
    for batch in batches:
        forms = [T.leakage_text(t.as_py()) for t in batch.column(2)]
        digests = [hashlib.sha256(f.encode()).digest() for f in forms]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(forms, pa.string())], names=["id", "part", "digest", "form"])


@dataclass
class NearCopies:
    """members: id, part, class; classes: class, first (the smallest id), n_<part>; pairs: left < right (classes), similarity.

    Rows without a letter or digit are in no class.  Pairs are of classes that have members in different parts.
    """

    members: DataFrame
    classes: DataFrame
    pairs: DataFrame
    parts: list[str]

    def expanded(self, left: str, right: str) -> DataFrame:
        """left_id, right_id, similarity of all rows of the two parts: as many as there are, for small tables and lists."""
        own = self.classes.where((F.col(f"n_{left}") > 0) & (F.col(f"n_{right}") > 0)).select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
        there = self.pairs.toDF("a", "b", "similarity")
        every = own.unionByName(there).unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
        for key, part in (("a", left), ("b", right)):
            side = "left_id" if key == "a" else "right_id"
            every = every.join(self.members.where(F.col("part") == part).select(F.col("class").alias(key), F.col("id").alias(side)), key)
        return every.select("left_id", "right_id", "similarity")

    def linked(self) -> DataFrame:
        """id, part, class_id, copies and links of each member: rows of other parts that are equal to it or near copies, by counts."""
        n = [f"n_{p}" for p in self.parts]
        both = self.pairs.select("left", "right").unionByName(self.pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
        sums = both.join(self.classes.withColumnRenamed("class", "right"), "right").groupBy(F.col("left").alias("class")).agg(*(F.sum(c).alias(f"near_{c}") for c in n))
        rows = self.members.join(self.classes.join(sums, "class", "left"), "class")

        def others(of):
            return sum((F.when(F.col("part") == p, F.lit(0)).otherwise(of(f"n_{p}")) for p in self.parts), F.lit(0)).cast("long")

        copies = others(F.col)
        return rows.select("id", "part", F.col("first").alias("class_id"), copies.alias("copies"), (copies + others(lambda c: F.coalesce(f"near_{c}", F.lit(0)))).alias("links"))


def near_copies(df: DataFrame, id_col: str, text_col: str, part_col: str, parts: list[str], threshold: float = 0.92, length_ratio: float = 0.70, n: int = 5) -> NearCopies:
    """The near copies between the rows of different parts; similarities are rounded to six digits before they are compared.

    Null and empty texts, and those without a letter or digit, are near to nothing; rows of other parts are left out; texts of
    any length are compared whole.  `length_ratio` is of normalised characters.
    """
    if not 1 <= n <= MOST_N:
        raise ValueError(f"n-grams of 1 to {MOST_N} signs")
    ship(df.sparkSession)
    with releasing(df.sparkSession):
        return _near_copies(df, id_col, text_col, part_col, parts, threshold, length_ratio, n)


def _near_copies(df: DataFrame, id_col: str, text_col: str, part_col: str, parts: list[str], threshold: float, length_ratio: float, n: int) -> NearCopies:
    least = threshold - 5e-7 - 1e-9
    starts, bits = levels(least), len(parts)
    named = df.where(F.col(part_col).isin(parts)).select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    kind = dict(named.dtypes)["id"]
    named = named.mapInArrow(normalised, f"id {kind}, part string, digest binary, form string").where("form <> ''")
    forms = saved(named.select(F.monotonically_increasing_id().alias("row"), "*"), "forms")
    counts = [F.count(F.when(F.col("part") == p, 1)).alias(f"n_{p}") for p in parts]
    digests = saved(forms.groupBy("digest").agg(F.min("row").alias("class"), F.min("id").alias("first"), *counts), "classes")
    classes = digests.drop("digest")
    members = saved(forms.select("id", "part", "digest").join(digests.select("digest", "class"), "digest").drop("digest"), "members")
    mask = sum((F.when(F.col(f"n_{p}") > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(parts)), F.lit(0))
    once = forms.select(F.col("row").alias("class"), "form").join(classes.select("class", mask.cast("long").alias("mask")), "class")

    def keys(batches):
        for batch in batches:
            found, owners, held = [], [], 0
            for name, form in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.append(part_keys(grams(form.as_py(), n), least, starts))
                owners.append(np.full(len(found[-1][0]), name, np.int64))
                held += len(found[-1][0])
                if held >= BATCH:
                    yield key_batch(found, owners)
                    found, owners, held = [], [], 0
            if found:
                yield key_batch(found, owners)

    def key_batch(found, owners):
        return pa.RecordBatch.from_arrays([*map(np.concatenate, zip(*found)), np.concatenate(owners)], names=["key", "sketch", "owner"])

    def differences(batches):
        last, own = None, None
        for batch in batches:
            rows, held = [], 0
            for name, pivot, form, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if pivot != last:
                    last, own = pivot, grams(other.as_py(), n)
                text = form.as_py()
                mine = grams(text, n)
                rows.append((name, pivot, len(text), len(mine), np.setxor1d(mine, own, assume_unique=True)))
                held += len(rows[-1][-1])
                if held >= BATCH:
                    yield difference_batch(rows)
                    rows, held = [], 0
            if rows:
                yield difference_batch(rows)

    def difference_batch(rows):
        *plain, found = zip(*rows)
        ends = pa.array(np.cumsum([0, *(len(x) for x in found)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), number))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in plain), lists], names=["class", "pivot", "chars", "size", "differ"])

    number = pa.int32() if n <= 5 else pa.int64()
    owned = once.select(F.shiftleft("class", bits).bitwiseOR(F.col("mask")).alias("owner"), "form").mapInArrow(keys, "key long, sketch long, owner long")
    one, other = owned.toDF("key", "p", "x"), owned.toDF("key", "q", "y")
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= F.col("key").bitwiseAND(F.lit((1 << LIMIT_BITS) - 1))
    of = [F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) for c in ("x", "y")]
    across = (of[0] != of[1]) | (of[0].bitwiseAND(of[0] - 1) != 0)
    met = one.join(other, "key").where((F.col("x") < F.col("y")) & across & near).select(F.shiftright("x", bits).alias("left"), F.shiftright("y", bits).alias("right")).distinct()
    met = saved(met, "candidates")
    # x and y differ where their differences from a third set do, so pairs carry those: a group's sets are all compared with its smallest class
    both = met.unionByName(met.select(F.col("right").alias("left"), F.col("left").alias("right")))
    pivots = both.groupBy("left").agg(F.least(F.col("left"), F.min("right")).alias("pivot"))
    asked = saved(met.join(pivots, "left"), "pivots")
    about = asked.select(F.col("left").alias("class"), "pivot").unionByName(asked.select(F.col("right").alias("class"), "pivot")).distinct()
    texts = forms.select(F.col("row").alias("class"), "form")
    told = about.join(texts, "class").join(texts.toDF("pivot", "other"), "pivot").select("class", "pivot", "form", "other")
    apiece = saved(told.mapInArrow(differences, f"class long, pivot long, chars long, size long, differ array<{'int' if n <= 5 else 'long'}>"), "differences")
    a, b = apiece.toDF("left", "pivot", "left_chars", "left_size", "x"), apiece.toDF("right", "pivot", "right_chars", "right_size", "y")
    long = F.least("left_chars", "right_chars") >= F.lit(length_ratio) * F.greatest("left_chars", "right_chars")
    sized = F.least("left_size", "right_size") >= F.lit(least) * F.greatest("left_size", "right_size")
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    sizes = F.col("left_size") + F.col("right_size")
    compared = asked.join(a, ["left", "pivot"]).join(b, ["right", "pivot"]).where(long & sized).select("left", "right", ((sizes - apart) / 2).cast("long").alias("shared"), sizes.alias("sizes"))
    pairs = compared.select("left", "right", F.bround(F.col("shared") / (F.col("sizes") - F.col("shared")), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    pairs = saved(pairs, "near-pairs")
    dropped(forms, met, asked, apiece)
    return NearCopies(members, classes, pairs, list(parts))
