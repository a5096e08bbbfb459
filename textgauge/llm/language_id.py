"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds its letters' vectors, permuted by their place, by
multiplication; a text's vector bundles those of its trigrams by addition; a language's prototype bundles its training texts.
A text has the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from .common import crc_mod

DIMENSIONS = 512
SEED = 20240607
#: Letters are told apart by so many bits of their code point, folded; below U+1000 each is one of its own.
LETTER_BITS = 12
UNKNOWN = "und"
#: A text of no relation to a prototype reaches this cosine by chance one time in forty.
CHANCE = 2 / DIMENSIONS**0.5


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """For each code point the folded lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            p = ord(low) if len(low) == 1 else c
            out[c] = (p ^ (p >> LETTER_BITS)) & ((1 << LETTER_BITS) - 1) or 1
    return out


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    draw = np.random.default_rng(SEED)
    return (draw.integers(0, 2, (1 << LETTER_BITS, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    v, m = letter_vectors(), (1 << LETTER_BITS) - 1
    a, b, c = (grams >> (2 * LETTER_BITS)) & m, (grams >> LETTER_BITS) & m, grams & m
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def gram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of the distinct trigrams of each text of a slice, and whether each text has a letter.

    Runs of other characters count as one blank, as do a text's ends.
    """
    raw, offsets = P.text_buffer(column)
    none = np.empty(0, np.int64)
    if not len(raw):
        return none, none, none, np.zeros(len(offsets) - 1, bool)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets]
    if starts[-1] != len(points):  # bytes that aren't UTF-8: text by text
        texts = [x.as_py() or "" for x in column.cast(pa.large_binary())]
        texts = [x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *map(len, texts)])
    codes = letter_codes()[points]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    has = np.bincount(text[codes > 0], minlength=len(starts) - 1) > 0
    # a blank before each text and after the last
    at = np.arange(len(codes)) + text + 1
    padded = np.zeros(len(codes) + len(starts), np.uint64)
    owner = np.zeros(len(padded), np.uint64)
    padded[at], owner[at] = codes, text
    before = starts[:-1] + np.arange(len(starts) - 1)
    owner[before] = np.arange(len(starts) - 1)
    owner[-1] = len(starts) - 2
    keep = np.ones(len(padded), bool)
    keep[:-1] = (padded[:-1] > 0) | (padded[1:] > 0)  # of several blanks the last, which is the next text's own
    padded, owner = padded[keep], owner[keep]
    if len(padded) < 3:
        return none, none, none, has
    b = P.U64(LETTER_BITS)
    grams = (padded[:-2] << (b + b)) | (padded[1:-1] << b) | padded[2:]
    inside = owner[1:-1] == owner[:-2]
    inside &= padded[1:-1] > 0  # a gram across a blank belongs to two words
    x = np.sort(((owner[1:-1] << P.U64(36)) | grams)[inside])
    if not len(x):
        return none, none, none, has
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    count = np.diff(np.r_[first, len(x)])
    x = x[first]
    return (x >> P.U64(36)).astype(np.int64), (x & P.U64((1 << 36) - 1)).astype(np.int64), count, has


def text_vectors(column: pa.Array, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, has a letter) of a slice's texts; a tile of trigram vectors fits a core's cache."""
    text, gram, count, has = gram_counts(column)
    out = np.zeros((len(has), DIMENSIONS), np.float32)
    if len(text):
        grams, which = np.unique(gram, return_inverse=True)
        vectors = gram_vectors(grams)
        for a in range(0, len(text), tile):
            t = text[a : a + tile]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            rows = vectors[which[a : a + tile]]
            rows *= count[a : a + tile, None]
            out[t[first]] += np.add.reduceat(rows, first)
    return out, has


class Profiles:
    """Unit prototypes by language."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.languages = sorted(sums)
        m = np.array([sums[x] for x in self.languages]).reshape(len(sums), DIMENSIONS)
        self.matrix = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        vectors, has = text_vectors(column)
        if not self.languages:
            return [UNKNOWN] * len(has), np.zeros(len(has))
        norm = np.linalg.norm(vectors, axis=1)
        cosine = (vectors @ self.matrix.T) / np.maximum(norm, 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        known = has & (norm > 0)
        score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 0, folds: int = 5) -> Profiles:
    """Prototypes of all languages, from the documents outside the held-out fold whose language is known.

    Each task bundles its own texts, so what moves is one vector for each task and language, and what comes to the driver one
    for each language.  Texts of any length count whole; repeated rows count as often as they occur; null texts and texts
    without a letter add nothing.  A null id counts as an empty text for the fold.  An empty table gives no prototype.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(F.col(id_col), folds) != held_out)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for part in P.slices(batches):
            text, gram, count, _ = gram_counts(part.column("text"))
            if not len(text):
                continue
            coded = part.column("lang").dictionary_encode()
            names, lang = coded.dictionary.to_pylist(), np.asarray(coded.indices)
            grams, which = np.unique(gram, return_inverse=True)
            weight = np.bincount(lang[text] * len(grams) + which, weights=count, minlength=len(names) * len(grams)).reshape(len(names), len(grams))
            for name, v in zip(names, weight.astype(np.float32) @ gram_vectors(grams)):
                sums[name] = sums.get(name, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    parts = rows.mapInArrow(bundle, "lang string, vector array<double>")
    # element-wise sums on the map side too: one row for each language and dimension
    sums = parts.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect()
    return Profiles({r.lang: np.array([x.x for x in r.v]) for r in found})


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """The id, held_out, lang_pred and score (the cosine, 0 at least) of each row.

    A text that is null or has no letter, and any text if nothing was learned, is `und` with score 0.  Among equal cosines
    the first language by name counts.  A null id counts as an empty text for held_out.  A text of any length is read whole;
    repeated rows give repeated rows, an empty table an empty result.  Other columns aren't read, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).alias("text"))

    def predict(batches):
        for part in P.slices(batches):
            lang, score = model.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], [id_col, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang", min_score: float = CHANCE, wanted: list[str] | None = None) -> DataFrame:
    """The documents whose language is known with at least min_score and, if some are wanted, is one of them; no row moves.

    The language found takes the place of what stood in lang_col, if there is such a column; all others stay.  Nulls, empty
    and long texts, ties, repeated rows and empty tables are as in `identify`.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def keep(batches):
        for part in P.slices(batches, text_col):
            lang, score = model.value.predict(part.column(text_col))
            if lang_col in part.schema.names:
                at = part.schema.get_field_index(lang_col)
                part = part.set_column(at, part.schema.field(at), pa.array(lang, pa.string()).cast(part.schema.field(at).type))
            use = [x != UNKNOWN and s >= min_score and (wanted is None or x in wanted) for x, s in zip(lang, score)]
            yield part.filter(pa.array(use, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
