"""Quality classification by co-training.

Two classifiers see a document from two sides: its text (how its characters and words are distributed) and its page's
metadata (source, language, stated length).  Both learn from labelled rows.  Then, for some rounds, each labels those of all
unlabelled rows of which it is surest, with the class balance of the labelled rows, and both learn from them too.  At the end
each view is calibrated on labelled rows that no classifier has learned from, and the calibrated views are combined.

Both views' features of all documents are computed once, over whole texts, into a table; every round looks at all of its
unlabelled rows and takes a top list of bounded size.  The models are fitted on the driver, on a sample of at most
`labelled_most` labelled rows, by a hash of the id, and the rows that the rounds have chosen, `GROWTH` of it a view and round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from .common import drop_table, join_back, materialise

LABELLED_MOST = 20_000
ROUNDS = 5
#: Rows that each view labels in a round, as a share of the labelled rows, and the least log odds that are sure.
GROWTH, SURE = 0.1, 1.5
#: Rows with crc32 of the id modulo this of 0 calibrate.
FOLDS = 5
#: Hashed dimensions for words' endings and for source and language.
HASHED_TEXT, HASHED_META = 64, 64
KEEP = 0.5

CLASSES = np.full(256, 6, np.uint8)  # other symbols
CLASSES[97:123] = 0
CLASSES[65:91] = 1
CLASSES[48:58] = 2
CLASSES[128:] = 3
CLASSES[[0x20, 9, 10, 11, 12, 13]] = 4
CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 5


def text_features(column: pa.Array) -> np.ndarray:
    """A row of features of each text of a slice: shares of character classes, word lengths, repetition, hashed words."""
    raw, offsets = P.text_buffer(column)
    n = len(offsets) - 1
    words = P.Words(column)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    classes = np.bincount(owner * 7 + CLASSES[raw], minlength=7 * n).reshape(n, 7) / np.maximum(size, 1)[:, None]
    marks = [np.bincount(owner[raw == ord(c)], minlength=n) / np.maximum(size, 1) for c in "|*#$%&!?"]
    count = np.maximum(words.count, 1)
    length = (words.ends - words.starts).astype(float)
    mean = np.bincount(words.text, weights=length, minlength=n) / count
    spread = np.sqrt(np.maximum(np.bincount(words.text, weights=length**2, minlength=n) / count - mean**2, 0))
    short = np.bincount(words.text, weights=length <= 3, minlength=n) / count
    long = np.bincount(words.text, weights=length >= 12, minlength=n) / count
    first = words.raw[words.starts] if len(words.starts) else np.empty(0, np.uint8)
    marked = np.bincount(words.text, weights=CLASSES[words.raw[words.ends - 1]] == 6, minlength=n) / count if len(first) else np.zeros(n)
    key, text = P.distinct_by_text(words.hash, words.text)
    distinct = np.bincount(text, minlength=n) / count
    hashed = np.bincount(words.text * HASHED_TEXT + (words.hash % P.U64(HASHED_TEXT)).astype(np.int64), minlength=n * HASHED_TEXT).reshape(n, HASHED_TEXT) / count[:, None]
    return np.column_stack([classes, *marks, mean / 10, spread / 10, short, long, marked, distinct, (words.count == 0), np.sqrt(hashed)]).astype(np.float32)


def meta_features(source: pa.Array, lang: pa.Array, chars: pa.Array) -> np.ndarray:
    """Hashed source and language, and the stated length: nothing of the text.  Nulls are a value of their own."""
    n = len(source)
    out = np.zeros((n, HASHED_META + 2), np.float32)
    for salt, values in ((1, source), (2, lang)):
        buffer, at = P.text_buffer(values)
        h = P.mix(P.span_hashes(buffer, at[:-1], at[1:]) + P.U64(salt))
        h[np.asarray(values.is_null())] = P.U64(salt)
        out[np.arange(n), (h % P.U64(HASHED_META)).astype(np.int64)] += 1
    stated = np.asarray(chars.fill_null(-1)).astype(float)
    out[:, HASHED_META] = np.log1p(np.maximum(stated, 0)) / 10
    out[:, HASHED_META + 1] = stated < 0
    return out


class Logistic:
    """A ridge logistic model on standardised features, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, weight = self.design(x), np.ones(len(y)) if weight is None else weight
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (weight * (p - y)) + penalty * w
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            w = w - np.linalg.solve(h, g)
        self.w = w

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -30, 30)


class CoTrained:
    """Both views, their calibration and the combination.  `calibrate` marks the rows that only calibrate."""

    def __init__(self, models: list[Logistic], views: tuple[np.ndarray, np.ndarray], y: np.ndarray, calibrate: np.ndarray, pseudo: list[int]):
        self.models, self.pseudo = models, pseudo
        on = calibrate if calibrate.any() and len(set(y[calibrate])) == 2 else np.ones(len(y), bool)
        logits = np.column_stack([m.logit(x[on]) for m, x in zip(models, views)])
        self.platt = [Logistic(logits[:, v : v + 1], y[on], ridge=0.01) for v in (0, 1)]
        both = np.column_stack([p.logit(logits[:, v : v + 1]) for v, p in enumerate(self.platt)])
        self.joint = Logistic(both, y[on], ridge=0.01)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of quality: by text, by metadata, combined."""
        both = np.column_stack([p.logit(m.logit(x)[:, None]) for p, m, x in zip(self.platt, self.models, (text, meta))])
        return tuple(1 / (1 + np.exp(-z)) for z in (both[:, 0], both[:, 1], self.joint.logit(both)))


class Constant:
    """Where labels are missing or all alike: their mean, or 0.5."""

    def __init__(self, p: float):
        self.p, self.pseudo = p, [0, 0]

    def score(self, text, meta):
        return (np.full(len(text), self.p),) * 3


COLUMNS = ["source", "lang", "n_chars"]


def inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns that the views see; one that is missing is null."""
    have = set(docs.columns)
    others = [(F.col(c) if c in have else F.lit(None)).cast("long" if c == "n_chars" else "string").alias(c) for c in COLUMNS]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *others)


def views_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both views' features of each row, in a table: row (a number of its own), id, text, meta."""

    def features(batches):
        for part in P.slices(batches):
            a, b = text_features(part.column("text")), meta_features(*(part.column(c) for c in COLUMNS))
            blocks = (pa.array([x.tobytes() for x in v], pa.binary()) for v in (a, b))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *blocks], ["row", "id", "text", "meta"])

    rows = inputs(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return materialise(rows.mapInArrow(features, "row long, id long, text binary, meta binary"), "cotraining-views")


def matrices(part) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch or table with text and meta."""
    out = []
    for c in ("text", "meta"):
        raw, offsets = P.text_buffer(part.column(c))
        width = (offsets[1] - offsets[0]) // 4 if len(offsets) > 1 else 0
        out.append(np.frombuffer(raw.tobytes(), np.float32).reshape(len(offsets) - 1, width))
    return tuple(out)


def collected(rows: DataFrame, order: list[str]):
    """Rows of bounded number on the driver, in an order that doesn't depend on how they were read."""
    got = rows.toArrow()
    return got.sort_by([(c, "ascending") for c in order]) if got.num_rows else got


def surest(pool: DataFrame, models: list[Logistic], taken: set[int], v: int, good: int, bad: int) -> list[tuple[int, pa.Table]]:
    """(label, rows) of which view v is surest, among all rows of the pool that it hasn't labelled; ties by id, then features."""
    told = pool.sparkSession.sparkContext.broadcast((models[v], np.array(sorted(taken), np.int64)))

    def score(batches):
        model, gone = told.value
        for part in batches:
            if part.num_rows:
                z = model.logit(matrices(part)[v])
                use = (np.abs(z) > SURE) & ~np.isin(np.asarray(part.column("row")), gone)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(z)], ["row", "id", "text", "meta", "z"]).filter(pa.array(use))

    scored = pool.select("row", "id", "text", "meta").mapInArrow(score, "row long, id long, text binary, meta binary, z double")
    ties = ["id", "text", "meta"]
    low = scored.where("z < 0").orderBy("z", *ties).limit(bad)
    high = scored.where("z > 0").orderBy(F.desc("z"), *ties).limit(good)
    return [(y, collected(rows.drop("z"), ties + ["row"])) for y, rows in ((0, low), (1, high))]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled_most: int = LABELLED_MOST, rounds: int = ROUNDS, views: DataFrame | None = None):
    """The co-trained model.

    Labels other than 0 and 1, null ones and those of unknown documents don't count; of several labels of one document the
    mean, rounded, does, and of several rows of a labelled id the one with the least features.  A row without id has no label.
    An empty table, or labels that are all alike, give a constant.  Texts of any length are read whole; columns of metadata
    that are missing are null, others aren't read, whatever their names.  `views`: `views_of(docs)`, where it is there already.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.round(F.avg(label_col)).alias("y"))
    marks = materialise(marks, "cotraining-labels")
    dealt = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # a fixed share of all ids by hash: 0.9 of the bound is far more than the spread below it
    sample = marks.where(dealt < int(min(1.0, 0.9 * labelled_most / max(marks.count(), 1)) * (1 << 30)))
    views = views_of(docs, id_col, text_col) if views is None else views
    chosen = views.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min(F.struct("text", "meta")).alias("x"))  # at most labelled_most rows of 16 bytes
    got = collected(chosen.select("id", "y", "x.*"), ["id"])
    y = np.asarray(got.column("y"))
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    text, meta = matrices(got)
    import zlib

    calibrate = np.array([zlib.crc32(str(i).encode()) % FOLDS == 0 for i in got.column("id").to_pylist()])
    if len(set(y[~calibrate].tolist())) < 2:
        calibrate[:] = False
    fit = ~calibrate
    named = labels.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().withColumn("rows", F.lit(1))
    pool = join_back(views, materialise(named, "cotraining-named"), "id", "rows", ["rows"])
    pool = materialise(pool.where("rows is null").drop("rows"), "cotraining-pool")
    share = y[fit].mean()
    step = max(1, int(GROWTH * fit.sum()))
    good, bad = max(1, round(step * share)), max(1, round(step * (1 - share)))
    #: By view, what the other has labelled for it: label, rows of both views.
    given: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[], []]
    taken: list[set[int]] = [set(), set()]  # rows that a view has labelled

    def learn(v: int) -> Logistic:
        own = (text, meta)[v][fit]
        x = np.concatenate([own, *(g[1 + v] for g in given[v])])
        labels_ = np.concatenate([y[fit], *(np.full(len(g[1]), float(g[0])) for g in given[v])])
        return Logistic(x, labels_, np.r_[np.ones(len(own)), np.full(len(x) - len(own), 0.5)])

    models = [learn(0), learn(1)]
    for _ in range(rounds):
        before = len(taken[0]) + len(taken[1])
        for v in (0, 1):
            for label, rows in surest(pool, models, taken[v], v, good, bad):
                if rows.num_rows:
                    given[1 - v].append((label, *matrices(rows)))
                    taken[v].update(rows.column("row").to_pylist())
        if len(taken[0]) + len(taken[1]) == before:
            break
        models = [learn(0), learn(1)]
    drop_table(pool)
    return CoTrained(models, (text, meta), y, calibrate, [sum(len(g[1]) for g in x) for x in given])


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, views: DataFrame | None = None) -> DataFrame:
    """The id, p_text, p_meta, quality (all 0 to 1) and keep (quality of `keep` or more) of each row.

    A null text is empty; an empty one is scored like others, one of any length whole.  Null metadata are a value of their
    own, columns of metadata that are missing are null; others aren't read, whatever their names.  Repeated rows give repeated
    rows, equal ones equal scores.  An empty table gives an empty result.  `views`: `views_of(docs)`, where it is there already.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for part in batches:
            if part.num_rows:
                p = told.value.score(*matrices(part))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x.astype(np.float64)) for x in p), pa.array(p[2] >= keep)], [id_col, "p_text", "p_meta", "quality", "keep"])

    views = views_of(docs, id_col, text_col) if views is None else views
    return views.select("id", "text", "meta").mapInArrow(score, f"`{id_col}` long, p_text double, p_meta double, quality double, keep boolean")
