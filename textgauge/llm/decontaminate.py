"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so the Jaccard similarity of an item and a document that holds it is tiny.  Two steps
make it large again.  First, of a document's shingles only those count that any item has: that leaves its containment of
every item as it was, and mostly leaves nothing.  Then the documents are partitioned by the size of what is left.  Within a
partition of upper size u, an item of q shingles that is contained to the threshold t has a Jaccard similarity of
t*q / (u + q - t*q) at least, and the banding of the MinHash signatures is chosen so that such a pair is missed with a
probability of at most `MISS`.  Where no banding reaches that (far more item shingles in a document than in the item), all
items that share a shingle are candidates.  Each candidate is verified by the exact shingles, as words.

Items are few beside documents; they are taken in blocks of at most `block_bytes` of text, each of which passes over the
documents, so what is sent to the executors is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P

SHINGLE = 5
#: In hundredths.
CONTAINED = 80
PERMUTATIONS = 128
MISS = 1e-9
BLOCK_BYTES = 8 << 20
SEEDS = P.mix(np.arange(1, PERMUTATIONS + 1, dtype=P.U64) * P.BASE)


def rows_per_band(q: int, u: int, t: float = CONTAINED / 100) -> int:
    """The most rows a band that meet MISS for items of q shingles and sets of at most u; 0 if none do."""
    j = min(1.0, t * q / (u + q - t * q))
    return max((r for r in (1, 2, 4, 8) if (1 - j**r) ** (PERMUTATIONS // r) <= MISS), default=0)


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash signatures of the sets that begin at `first`."""
    out = np.empty((len(first), PERMUTATIONS), P.U64)
    for k, seed in enumerate(SEEDS):
        out[:, k] = np.minimum.reduceat(P.mix(h ^ seed), first)
    return out


def band_keys(sig: np.ndarray, r: int) -> np.ndarray:
    bands = PERMUTATIONS // r
    x = np.zeros((len(sig), bands), P.U64)
    for k in range(r):
        x = P.mix(x * P.BASE + sig[:, k : bands * r : r])
    return P.mix(x ^ np.arange(1, bands + 1, dtype=P.U64) * P.BASE_INV)


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [lo, hi), and the range's number for each."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), owner


class ItemIndex:
    """The items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        words = P.Words(pa.array([t for _, t in items], pa.large_string()))
        h, owner = words.shingles(SHINGLE)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[keep], owner[keep]
        self.lengths = sorted({min(SHINGLE, int(c)) for c in words.count if c})
        used = np.unique(owner)
        self.ids = [items[i][0] for i in used]
        self.words = [text_words(items[i][1]) for i in used]
        owner = np.searchsorted(used, owner)
        self.size = np.bincount(owner, minlength=len(used))
        self.first = np.cumsum(self.size) - self.size
        self.hash, by = h, np.argsort(h, kind="stable")
        self.vocabulary, at = np.unique(h, return_index=False, return_counts=True) if len(h) else (h, np.empty(0, int))
        self.posting_end = np.cumsum(at)
        self.posting = owner[by]
        self.mask = P.U64((1 << max(16, int(64 * len(self.vocabulary)).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[self.vocabulary & self.mask] = True
        self.bands = {}
        if len(used):
            sig = signatures(h, self.first)
            for r in (1, 2, 4, 8):
                keys = band_keys(sig, r)
                item = np.repeat(np.arange(len(used)), keys.shape[1])
                o = np.argsort(keys.ravel(), kind="stable")
                self.bands[r] = keys.ravel()[o], item[o]

    def restricted(self, words: P.Words) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (shingle, text) pairs whose shingle any item has, ordered by text."""
        hs, ts = [], []
        for k in self.lengths:
            h, t = P.shingle_hashes(words.hash, words.text, words.count, words.first, k, short=False)
            maybe = np.flatnonzero(self.table[h & self.mask])
            maybe = maybe[P.member_of(h[maybe], self.vocabulary)]
            hs.append(h[maybe])
            ts.append(t[maybe])
        h, t = np.concatenate(hs), np.concatenate(ts)
        order = np.lexsort((h, t))
        h, t = h[order], t[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        return h[keep], t[keep]

    def candidates(self, h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(set, item) pairs to verify."""
        found = [np.empty((0, 2), np.int64)]
        partition = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
        ends = first + n
        for e in np.unique(partition):
            u, sets = 1 << int(e), np.flatnonzero(partition == e)
            inside, owner = expand(first[sets], ends[sets])
            sig = signatures(h[inside], np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
            sizes = np.unique(self.size)
            rows = dict(zip(sizes, (rows_per_band(int(q), u) for q in sizes)))
            needed = np.array([rows[q] for q in self.size])
            for r in set(rows.values()):
                if r:
                    keys = band_keys(sig, r)
                    table, item = self.bands[r]
                    flat = keys.ravel()
                    at, k = expand(np.searchsorted(table, flat, "left"), np.searchsorted(table, flat, "right"))
                    pairs = np.stack([sets[k // keys.shape[1]], item[at]], 1)
                else:
                    v = np.searchsorted(self.vocabulary, h[inside])
                    end = self.posting_end[v]
                    at, k = expand(np.r_[0, self.posting_end][v], end)
                    pairs = np.stack([sets[owner[k]], self.posting[at]], 1)
                found.append(np.unique(pairs[needed[pairs[:, 1]] == r], axis=0))
        return np.concatenate(found)

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles shared, shingles of the item) for all items that a text contains."""
        if not self.ids:
            return []
        words = P.Words(column)
        h, t = self.restricted(words)
        if not len(h):
            return []
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        n = np.diff(np.r_[first, len(h)])
        out, sets = [], {}
        for s, item in self.candidates(h, first, n):
            mine = self.hash[self.first[item] : self.first[item] + self.size[item]]
            if 100 * P.member_of(mine, h[first[s] : first[s] + n[s]]).sum() < CONTAINED * len(mine):
                continue
            text, k = int(t[first[s]]), min(SHINGLE, len(self.words[item]))
            if (text, k) not in sets:
                ws = text_words(column[text].as_py())
                sets[text, k] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
            ws = self.words[item]
            wanted = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
            shared = len(wanted & sets[text, k])
            if 100 * shared >= CONTAINED * len(wanted):
                out.append((text, int(item), shared, len(wanted)))
        return sorted(out)


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_FOLD).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of about block_bytes of text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        if rows:
            yield [(r.i, r.t) for r in sorted(rows, key=lambda r: (r.i is None, r.i, r.t))]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each pair of a document and a benchmark item of whose distinct shingles the document holds 80 % or more.

    Shingles are 5 words, A-Z lowered; an item of fewer words is one shingle, looked for as a run of words.  Null and empty
    items match nothing, null and empty texts hold nothing, texts of any length are searched whole.  Repeated documents or
    items give repeated rows, null ids are kept, and a containment of just 80 % counts.  Other columns aren't read, whatever
    their names.  Without items or documents the result is empty.  Returns the id, item_id, item_shingles, shared_shingles,
    containment.
    """
    spark = docs.sparkSession
    names = [id_col, "item_id", "item_shingles", "shared_shingles", "containment"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "long", "long", "long", "double")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(items))

        def find(batches, index=index):
            for part in P.slices(batches):
                if got := index.value.search(part.column("text")):
                    text, item, shared, n = map(list, zip(*got))
                    ids = part.column("id")
                    arrays = [ids.take(pa.array(text)), pa.array([index.value.ids[i] for i in item], pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array(np.array(shared) / np.array(n))]
                    yield pa.RecordBatch.from_arrays(arrays, names)

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, without those that `contaminated` finds; no row moves."""
    spark = docs.sparkSession
    for items in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(items))

        def drop(batches, index=index):
            for part in P.slices(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in index.value.search(part.column(text_col))]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(drop, docs.schema)
    return docs
