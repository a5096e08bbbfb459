"""Exact Jaccard join of shingle sets: a size-aware heavy-light join, down to connected components.

Documents with equal sets are one set from the start.  Two sets of n <= m shingles are linked if they share
c(n, m) = ceil(T (n + m) / (100 + T)) of them, T being the threshold in hundredths.

* Small sets, of at most B shingles: each enumerates all its subsets of the size c(n, m), for each size m of a partner.  Sets
  with a subset in common are linked; nothing is left to verify.  B is chosen by cost from the sizes of the whole corpus.
* Large sets: each enters the inverted lists of the shingles of its prefix, the n - ceil(T n / 100) + 1 first in an order
  that all sets share: light shingles by hash, then heavy ones, those in more than `LIGHT` documents.  Any two linked sets
  share one of these lists at least, whatever is heavy, so the choice is one of cost only.  The lists are scanned:
  - a light list gives all its pairs that pass the size and position bounds;
  - a list of more sets, which may grow with the corpus, stays a table of rows.  First its members are compared with the
    member that has the fewest light shingles.  Links so found make components; then only pairs of members from different
    components are compared.  So a group of n near copies takes about n comparisons instead of n * n, and no link between
    components is lost.

Candidate pairs are verified on the whole sets, after two bounds that never drop a link: parity sketches of a fixed size, then
of a size that grows with the set.  Only tables in the shared folder stand between the steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed as P
from .common import buckets_for, drop_table, join_back, materialise
from .components import components

SHINGLE = 5
THRESHOLD = 80
#: Lists of at most so many sets are light.
LIGHT = 64
#: A shingle is counted towards the heavy ones where one task sees it so often.
SEEN = 4
#: The heavy shingles that are told to all tasks: the most frequent ones, at most so many (8 bytes each).
HEAVY_MOST = 500_000
#: The largest B to consider, and estimated costs of a subset row and of a posting with its share of scans and verification, in microseconds.
SMALL_MOST, SUBSET_COST, POSTING_COST = 24, 3.0, 20.0
#: Bits of the filter that names wanted documents: 16 MB.
FILTER_BITS = 1 << 27
#: Postings that a task holds back before it sends them on in blocks.
FLUSH = 1 << 19

POSTING = np.dtype([("h", "<u8"), ("s", "<i8"), ("n", "<u4"), ("q", "<u2")])
#: Marks a watched set in q; places are cut off below it, which only loosens their bound.
WATCHED = 1 << 15
#: Bytes of a packed posting, for the number of buckets.
POSTING_BYTES = 17


def need(n, m, t: int = THRESHOLD):
    """Shared shingles that link sets of n and m."""
    return -(-t * (n + m) // (100 + t))


def prefix(n, t: int = THRESHOLD):
    return n - (-(-t * n // 100)) + 1


def subset_plans(n: int, boundary: int, t: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(size of the smaller, of the larger, of the subset, side) for a set of n; side 0 smaller, 1 larger, 2 equal sizes."""
    plans = []
    for m in range(1, boundary + 1):
        a, b = min(n, m), max(n, m)
        if 100 * a >= t * b and need(a, b, t) <= a:
            plans.append((a, b, need(a, b, t), 2 if a == b else 0 if n == a else 1))
    return plans


def subset_count(n: int, boundary: int, t: int = THRESHOLD) -> int:
    return sum(comb(n, c) for _, _, c, side in subset_plans(n, boundary, t) if not (side == 2 and c == n))


def choose_boundary(sizes: dict[int, int], t: int = THRESHOLD) -> int:
    """The B that costs least for these numbers of sets by size (only those up to SMALL_MOST matter)."""

    def cost(b: int) -> float:
        subsets = sum(k * subset_count(n, b, t) for n, k in sizes.items() if n <= b)
        postings = sum(k * prefix(n, t) for n, k in sizes.items() if 100 * n >= t * (b + 1) and n <= SMALL_MOST)
        return SUBSET_COST * subsets + POSTING_COST * postings

    return min(range(SMALL_MOST + 1), key=lambda b: (cost(b), b))


def identity(keys: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """A 63-bit identity of each set: the mixed sum of its mixed keys."""
    sums = np.r_[P.U64(0), np.cumsum(P.mix(keys + P.U64(1)))]
    ends = np.searchsorted(text, np.arange(texts + 1))
    n = np.diff(ends).astype(P.U64)
    return (P.mix((sums[ends[1:]] - sums[ends[:-1]]) * P.BASE + n) >> P.U64(1)).astype(np.int64)


def sets_of(column: pa.Array):
    """(key, text) of a slice's distinct shingles, the sets' sizes and identities."""
    words = P.Words(column)
    keys, text = P.distinct_by_text(*words.shingles(SHINGLE))
    return keys, text, np.bincount(text, minlength=words.texts).astype(np.int64), identity(keys, text, words.texts)


#: Bits of a set's parity sketch, in longs.
PARITY = [f"p{k}" for k in range(8)]


def parities(keys: np.ndarray, text: np.ndarray, texts: int) -> list[np.ndarray]:
    """For each set 512 bits: whether an odd number of its keys falls on the bit.

    Two sets' sketches differ in no more bits than their symmetric difference has keys.
    """
    width = 64 * len(PARITY)
    odd = np.bincount(text * width + (keys & P.U64(width - 1)).astype(np.int64), minlength=texts * width) & 1
    return list(np.packbits(odd.astype(np.uint8).reshape(texts, width), axis=1).view(np.int64).reshape(texts, len(PARITY)).T)


def parity_allows(x: str, y: str) -> Column:
    """Whether the sketches leave room for a link between sets of n keys each."""
    n = F.col(f"{x}n").cast("long") + F.col(f"{y}n").cast("long")
    differ = sum((F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))).cast("long") for p in PARITY[1:]), F.bit_count(F.col(f"{x}p0").bitwiseXOR(F.col(f"{y}p0"))).cast("long"))
    # a link needs a difference of at most n + m - 2 * THRESHOLD (n + m) / (100 + THRESHOLD)
    return differ * (100 + THRESHOLD) <= n * (100 - THRESHOLD)


def batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names.split())


def profile(docs: DataFrame) -> DataFrame:
    """For each document (kind 0) id, set, size and sketch; for each shingle that a task sees often (kind 1) key and count."""
    names = "kind a b c " + " ".join(PARITY)

    def read(batches):
        kept, seen = [], np.empty(0, np.int64)
        for part in P.slices(batches):
            keys, text, n, sets = sets_of(part.column("text"))
            yield batch(names, np.zeros(len(n), np.int32), part.column("id"), sets, n, *parities(keys, text, len(n)))
            new = ~np.isin(sets, seen)
            new[np.setdiff1d(np.arange(len(sets)), np.unique(sets, return_index=True)[1])] = False
            seen = np.concatenate([seen, sets[new]])
            kept.append(keys[new[text]])
            if sum(map(len, kept)) > 2 * FLUSH:
                yield from count(kept)
                kept = []
        yield from count(kept)

    def count(kept):
        if kept:
            keys, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= SEEN
            k = int(often.sum())
            yield batch(names, np.ones(k, np.int32), keys[often].astype(np.int64), n[often], np.zeros(k, np.int64), *(pa.nulls(k, pa.int64()) for _ in PARITY))

    return docs.mapInArrow(read, "kind int, a long, b long, c long, " + ", ".join(f"{p} long" for p in PARITY))


ENTRY = "kind int, bucket int, a long, b long, n int, q int, light int, data binary"
ENTRY_NAMES = "kind bucket a b n q light data"


def rows(kind: int, k: int, a=None, b=None, n=None, q=None, light=None, bucket=None, data=None) -> pa.RecordBatch:
    def col(x, t):
        return pa.nulls(k, t) if x is None else pa.array(x, t)

    return batch(ENTRY_NAMES, np.full(k, kind, np.int32), col(bucket, pa.int32()), col(a, pa.int64()), col(b, pa.int64()), col(n, pa.int32()), col(q, pa.int32()), col(light, pa.int32()), col(data, pa.binary()))


def enter(heavy: np.ndarray, boundary: int, buckets: int):
    """A function for mapInArrow: blocks of light postings (kind 0), postings of heavy shingles (1), subsets of small sets (2).

    The rows of the last two kinds only pass through the buckets; they are dealt by set, so no shingle fills one.
    """

    def flush(held):
        x = np.concatenate(held)
        to = (x["h"] % P.U64(buckets)).astype(np.int32)
        order = np.lexsort((x["h"], to))
        x, to = x[order], to[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        ends = np.r_[first[1:], len(to)]
        yield rows(0, len(first), bucket=to[first], data=[P.pack(*(x[f][i:j] for f in POSTING.names)) for i, j in zip(first, ends)])

    def subsets(keys, first, n, sets):
        out = []
        for k in np.flatnonzero((n > 0) & (n <= boundary)):
            own = [int(x) for x in P.mix(keys[first[k] : first[k] + n[k]] + P.U64(1))]
            total = sum(own)
            for a, b, c, side in subset_plans(int(n[k]), boundary):
                if side == 2 and c == n[k]:
                    continue
                base = (a * 64 + b) * 0x9E3779B97F4A7C15
                for gone in combinations(own, len(own) - c):
                    out.append(((total - sum(gone) + base) & 0xFFFFFFFFFFFFFFFF, sets[k], side))
        return out

    def read(batches):
        held, size, seen = [], 0, np.empty(0, np.int64)
        for part in P.slices(batches):
            keys, text, n, sets = sets_of(part.column("text"))
            new = ~np.isin(sets, seen)
            new[np.setdiff1d(np.arange(len(sets)), np.unique(sets, return_index=True)[1])] = False
            seen = np.concatenate([seen, sets[new]])
            first = np.cumsum(n) - n
            if boundary and (small := subsets(keys, first, np.where(new, n, 0), sets)):
                key, s, side = zip(*small)
                s = np.array(s, np.int64)
                yield rows(2, len(s), a=P.mix(np.array(key, P.U64)).astype(np.int64), b=s, n=side, bucket=(s % buckets).astype(np.int32))
            large = new & (100 * n >= THRESHOLD * (boundary + 1))
            use = large[text]
            keys, text = keys[use], text[use]
            if not len(keys):
                continue
            hot = P.member_of(keys, heavy)
            # the place in the order: light ones by hash, then heavy ones
            before = np.cumsum(~hot) - ~hot
            light = np.bincount(text[~hot], minlength=len(n))
            begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            start = np.zeros(len(n), np.int64)
            start[text[begin]] = begin
            light_before = before - before[start[text]]
            at = np.arange(len(keys)) - start[text]
            place = np.where(hot, light[text] + at - light_before, light_before)
            use = place < prefix(n)[text]
            keys, text, hot, place = keys[use], text[use], hot[use], place[use]
            x = np.empty((~hot).sum(), POSTING)
            t = text[~hot]
            # a set with a heavy shingle in its prefix has all its light ones there: it is watched
            watched = np.zeros(len(n), np.uint16)
            watched[text[hot]] = WATCHED
            x["h"], x["s"], x["n"], x["q"] = keys[~hot], sets[t], n[t], np.minimum(place[~hot], WATCHED - 1).astype(np.uint16) | watched[t]
            held.append(x)
            size += len(x)
            if hot.any():
                t = text[hot]
                # a: shingle, b: set, n: size, q: place, light: 1 for watched sets
                yield rows(1, len(t), a=keys[hot].astype(np.int64), b=sets[t], n=n[t], q=place[hot], light=np.ones(len(t), np.int32), bucket=(sets[t] % buckets).astype(np.int32))
            if size > FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return read


def possible(n, m, p, q):
    """Whether sets of n and m that share their shingles at places p and q first can be linked."""
    n, m, p, q = (x.astype(np.int64) for x in (n, m, p, q))
    low = np.minimum(n, m)
    return (100 * low >= THRESHOLD * np.maximum(n, m)) & (1 + np.minimum(n - p, m - q) - 1 >= need(n, m))


def scan(batches):
    """The light lists of one bucket: pairs (kind 3) of sets a < b; lists that aren't light stay rows (kind 1)."""
    held: list[list[np.ndarray]] = []
    for part in batches:
        kind = np.asarray(part.column("kind"))
        held += [P.unpack(x) for x in part.column("data").filter(pa.array(kind == 0)).to_pylist()]
        if (kind > 0).any():
            yield part.filter(pa.array(kind > 0))
    if not held:
        return
    x = np.empty(sum(len(b[0]) for b in held), POSTING)
    for k, f in enumerate(POSTING.names):
        x[f] = np.concatenate([b[k] for b in held])
    x = x[np.lexsort((x["s"], x["h"]))]
    keep = np.ones(len(x), bool)
    keep[1:] = (x["h"][1:] != x["h"][:-1]) | (x["s"][1:] != x["s"][:-1])
    x = x[keep]
    first = np.flatnonzero(np.r_[True, x["h"][1:] != x["h"][:-1]])
    length = np.diff(np.r_[first, len(x)])
    # light shingles that a watched set shares with no other watched one
    single = x[first[length == 1]]
    s, k = np.unique(single["s"][single["q"] >= WATCHED], return_counts=True)
    if len(s):
        yield rows(4, len(s), a=s, n=k.astype(np.int32))
    x["q"] &= WATCHED - 1
    found = []
    for k in np.unique(length[(length > 1) & (length <= LIGHT)]):
        i, j = np.triu_indices(k, 1)
        lists = first[length == k]
        for part in range(0, len(lists), max(1, (1 << 20) // len(i))):
            at = lists[part : part + max(1, (1 << 20) // len(i))][:, None]
            a, b = x[(at + i).ravel()], x[(at + j).ravel()]
            ok = possible(a["n"], b["n"], a["q"], b["q"])
            found.append(np.unique(np.stack([a["s"][ok], b["s"][ok]], 1), axis=0))
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        yield rows(3, len(pairs), a=pairs[:, 0], b=pairs[:, 1])
    for k in np.flatnonzero(length > LIGHT):
        y = x[first[k] : first[k] + length[k]]
        yield rows(1, len(y), a=y["h"].astype(np.int64), b=y["s"], n=y["n"].astype(np.int32), q=y["q"].astype(np.int32), light=np.zeros(len(y), np.int32))


def scan_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from scan(batches)
    P.trim()


def wide_parities(keys: np.ndarray, text: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """For each set as `parities`, of 4 to 8 bits for each of its keys."""
    out = []
    for e, c in zip(np.cumsum(n).tolist(), n.tolist()):
        width = max(64, 1 << (4 * c - 1).bit_length())
        odd = np.bincount((keys[e - c : e] & P.U64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return [pa.array(out, pa.binary())]


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the wider one is folded, as its keys would be, to the width of the other."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def could_be(batches):
    """The pairs that wide sketches of their sets don't rule out."""
    for part in batches:
        rows = zip(*(part.column(c).to_pylist() for c in ("n_a", "n_b", "wide_a", "wide_b")))
        ok = [differing(x, y) * (100 + THRESHOLD) <= (n + m) * (100 - THRESHOLD) for n, m, x, y in rows]
        yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    P.trim()


def verify(batches):
    """The linked ones of pairs with their sets' keys, as edges between the sets' documents."""
    for part in batches:
        a, b = ([P.unpack(x)[0] for x in part.column(c).to_pylist()] for c in ("keys_a", "keys_b"))
        ok = [int(P.member_of(x, y).sum()) >= need(len(x), len(y)) for x, y in zip(a, b)]
        yield batch("u v", part.column("doc_a"), part.column("doc_b")).filter(pa.array(ok, pa.bool_()))
    P.trim()


def shared_enough(x: str, y: str) -> Column:
    """Whether two members of a long list can be linked, by their sizes, places and shingles that they have alone."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    place = F.least(n - F.col(f"{x}q"), m - F.col(f"{y}q"))
    alone = F.coalesce(F.least(n - F.col(f"{x}u"), m - F.col(f"{y}u")) + F.col(f"{x}u") * 0 + F.col(f"{y}u") * 0, place)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * THRESHOLD) & (F.least(place, alone) * (100 + THRESHOLD) >= (n + m) * THRESHOLD)


def whole_keys(keys: np.ndarray, text: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    return [pa.array([P.pack(keys[e - c : e]) for e, c in zip(np.cumsum(n), n)], pa.binary())]


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))


def size_class(n: Column) -> Column:
    """Sets that are linked have the same class or neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / THRESHOLD) + 1e-9).cast("int")


class JaccardJoin:
    """The join's tables over one corpus; `result()` is what most callers want."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.id_col = id_col

    def entries(self) -> None:
        seen = materialise(profile(self.docs), "jaccard-profile")
        self.members = seen.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("set"), F.col("c").alias("n"))
        of = F.min("a").alias("id"), F.first("c").alias("n"), F.count(F.lit(1)).alias("copies"), *(F.first(p).alias(p) for p in PARITY)
        #: Each set once, with the smallest id of its documents, its size, the number of its rows, its sketch.
        self.sets = materialise(seen.where("kind = 0").groupBy(F.col("b").alias("set")).agg(*of), "jaccard-sets")
        counts = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("k")).where(F.col("k") > LIGHT)
        heavy = np.sort(np.array([r.a for r in counts.orderBy(F.desc("k"), "a").limit(HEAVY_MOST).collect()], np.int64)).astype(np.uint64)
        sizes = {r.n: r["count"] for r in self.sets.where(F.col("n").between(1, SMALL_MOST)).groupBy("n").count().collect()}
        postings = self.sets.agg(F.sum(F.col("n") * (100 - THRESHOLD) / 100 + 1)).first()[0] or 0
        self.boundary = choose_boundary(sizes)
        self.buckets = buckets_for(self.spark, postings * POSTING_BYTES)
        told = self.spark.sparkContext.broadcast(heavy)
        boundary, buckets = self.boundary, self.buckets

        def read(batches):
            yield from enter(told.value, boundary, buckets)(batches)

        self.scanned = materialise(self.docs.mapInArrow(read, ENTRY).groupBy("bucket").applyInArrow(scan_group, ENTRY), "jaccard-lists")
        self.subsets = self.scanned.where("kind = 2").select("a", F.col("b").alias("s"), F.col("n").alias("side")).distinct()
        alone = self.scanned.where("kind = 4").groupBy(F.col("a").alias("s")).agg(F.sum("n").alias("alone"))
        long = self.scanned.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("s"), "n", "q", "light").distinct()
        # u: shingles that no other watched set has; null in lists whose sets aren't all watched
        own = F.when(F.col("light") == 1, F.coalesce("alone", F.lit(0)))
        self.long = materialise(long.join(alone, "s", "left").select("h", "s", F.col("n").cast("long").alias("n"), F.col("q").cast("long").alias("q"), own.cast("long").alias("u")), "jaccard-long")

    def of_sets(self, wanted: DataFrame, name: str, make, column: str, compression: str = "zstd") -> DataFrame:
        """For the wanted sets, and maybe some others, what `make(keys, text, n)` gives, read anew from their first documents' texts.

        So what is big by set is only ever written for the sets that still matter.  No text moves: a filter of at most
        `FILTER_BITS` bits tells the tasks which documents to look at; if very many are wanted it lets all pass.
        """
        ids = self.sets.where("id is not null").join(wanted, "set").select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("at"))
        mark = F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
        found = ids.groupBy(F.shiftright("at", 6).alias("word")).agg(mark).toArrow()  # at most FILTER_BITS / 64 rows
        bits = np.zeros(FILTER_BITS >> 6, np.int64)
        bits[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
        told = self.spark.sparkContext.broadcast(np.flatnonzero(bits) if (few := len(found) < FILTER_BITS >> 9) else bits)
        values = self.spark.sparkContext.broadcast(bits[told.value] if few else None)

        def wanted_rows(batches):
            table = told.value
            if values.value is not None:
                table = np.zeros(FILTER_BITS >> 6, np.int64)
                table[told.value] = values.value
            for whole in batches:
                at = np.asarray(whole.column("at"))
                use = (table[at >> 6] >> (at & 63)) & 1 > 0
                yield whole.filter(pa.array(use))

        def make_all(batches):
            for part in P.slices(wanted_rows(batches)):
                keys, text, n, sets = sets_of(part.column("text"))
                yield batch(f"set n {column}", sets, n, *make(keys, text, n))

        rows = self.docs.where("id is not null").withColumn("at", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)))
        # an id that stands for several texts comes with each of them, repeated rows come again
        return materialise(rows.mapInArrow(make_all, f"set long, n long, {column} binary"), name, compression)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Edges (u, v) between documents for those pairs (a, b) of sets that are linked."""
        # three steps, each on what the one before has left: sketches of 64 bytes, of half a byte for each key, whole keys
        x, y = (self.sets.select(F.col("set").alias(k), F.struct("n", *PARITY).alias(k * 2)) for k in "ab")
        sketched = pairs.join(x, "a").join(y, "b").where(parity_allows("aa.", "bb.")).select("a", "b")
        pairs = materialise(sketched, "jaccard-sketched")
        found = self.of_sets(both_ends(pairs).distinct(), "jaccard-wide", wide_parities, "wide", "none")
        wide = found.groupBy("set").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
        both = pairs.join(wide.toDF("a", "n_a", "wide_a"), "a").join(wide.toDF("b", "n_b", "wide_b"), "b")
        left = materialise(both.mapInArrow(could_be, "a long, b long"), "jaccard-left")
        drop_table(found)
        found = self.of_sets(both_ends(left).distinct(), "jaccard-keys", whole_keys, "keys", "none")
        keys = found.groupBy("set").agg(F.first("keys").alias("keys")).join(self.sets.select("set", "id"), "set")
        a, b = keys.toDF("a", "keys_a", "doc_a"), keys.toDF("b", "keys_b", "doc_b")
        both = left.join(a, "a").join(b, "b").select("doc_a", "keys_a", "doc_b", "keys_b")
        links = materialise(both.mapInArrow(verify, "u long, v long"), "jaccard-links")
        drop_table(found)
        return links

    def subset_edges(self) -> DataFrame:
        """Links by common subsets: in each group all smaller sets with one larger, and all larger ones with one smaller."""
        one = self.subsets.groupBy("a").agg(F.min(F.when(F.col("side") != 1, F.col("s"))).alias("small"), F.min(F.when(F.col("side") != 0, F.col("s"))).alias("large"), F.count(F.lit(1)).alias("k")).where("small is not null and large is not null and k > 1")
        other = F.when(F.col("side") == 0, F.col("large")).otherwise(F.col("small"))
        edges = self.subsets.join(one, "a").select("s", other.alias("o")).where("s <> o").distinct()
        first = self.sets.where("id is not null")
        u, v = first.select(F.col("set").alias("s"), F.col("id").alias("u")), first.select(F.col("set").alias("o"), F.col("id").alias("v"))
        return materialise(edges.join(u, "s").join(v, "o").select("u", "v"), "jaccard-small")

    def shared_ids(self) -> DataFrame:
        """Edges between the sets of those ids that stand for several."""
        some = self.members.where("id is not null and n > 0")
        several = some.groupBy("id").agg((F.min("set") != F.max("set")).alias("several")).where("several").select("id")
        edges = some.join(several, "id", "left_semi").select("id", "set").distinct().join(self.sets.select("set", F.col("id").alias("v")), "set")
        return edges.select(F.col("id").alias("u"), "v").where("u <> v")

    def roots(self) -> DataFrame:
        self.entries()
        pivot = self.long.groupBy("h").agg(F.min(F.struct("u", "s", "n", "q")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
        starred = self.long.join(pivot, "h").where(shared_enough("", "p.") & (F.col("s") != F.col("p.s"))).select(F.least("s", "p.s").alias("a"), F.greatest("s", "p.s").alias("b"))
        pairs = materialise(self.scanned.where("kind = 3").select("a", "b").unionByName(starred).distinct(), "jaccard-candidates")
        edges = self.linked(pairs)
        if self.boundary:
            edges = edges.unionByName(self.subset_edges())
        edges = edges.unionByName(self.shared_ids())
        roots = components(edges)
        if not self.long.isEmpty():
            node = self.sets.where("id is not null").select(F.col("set").alias("s"), F.col("id").alias("node"), *PARITY)
            member = self.long.join(node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "s")
            open_ = member.groupBy("h").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("h")
            left = materialise(member.join(open_, "h", "left_semi"), "jaccard-open")
            # a list is compared by classes of sizes, so that it is neither one task's nor all pairs
            left = left.withColumn("class", size_class(F.col("n")))
            a, b = left.alias("x"), left.withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1))))).alias("y")
            same = (F.col("x.h") == F.col("y.h")) & (F.col("x.class") == F.col("y.class"))
            on = same & (F.col("x.s") < F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & shared_enough("x.", "y.") & parity_allows("x.", "y.")
            more = a.join(b, on).select(F.col("x.s").alias("a"), F.col("y.s").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
            edges = self.linked(more).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots = components(edges)
        return roots

    def result(self) -> DataFrame:
        roots = self.roots()
        # an empty set is linked with nothing; the copies of one set go to as many tasks as their rows need
        by_set = self.sets.where("n > 0").withColumnRenamed("id", "node").join(roots, "node", "left").select("set", "copies", F.coalesce("root", "node").alias("component"))
        out = join_back(self.members, materialise(by_set, "jaccard-components"), "set", "copies", ["component"])
        component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles and component_id (the smallest id reachable by links, itself included) of each row.

    Null and empty texts have the empty set, are linked with nothing and are components of their own.  Rows that share an id
    are one document to the links.  A row without id has the component of its set, or null if no row with that set has an
    id.  Repeated rows give repeated rows.  A text of any length is one set of all its shingles; a similarity of just 80 %
    links.  An empty table gives an empty result.  Other columns aren't read, whatever their names.
    """
    return JaccardJoin(docs, id_col, text_col).result()
