"""Each stage against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from textgauge.llm import language_id, mixing, token_shards

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["id", "set", "n", "row", "words", "hash", "component_id", "count", "rank", "slot", "key", "component", "lang_pred", "score"]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", *(f"concat('own ', {k}) as `{c}`" for k, c in enumerate(EXTRA)))


def plain(rows):
    out = [tuple(r)[:5] for r in rows]
    for r in rows:
        assert [r[c] for c in EXTRA] == [f"own {k}" for k in range(len(EXTRA))]
    return Counter(out)


def words(text):
    fold = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return fold.replace("\n", " ").replace("\t", " ").split(" ")


def corpus(draw, n=90):
    rows, lines = [], [" ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(40)) for _ in range(30)]
    for i in range(n):
        text = lines[i % 30].split(" ")
        if i % 4 == 1:
            text[draw.randrange(40)] = "CHANGED"
        rows.append((1000 + i, " ".join(text), "xx", ["big", "mid", None][min(i % 5, 2)], 3))
    long = " ".join(f"w{i}" for i in range(30_000))
    return rows + [(1, None, None, "s", None), (2, "", "xx", "s", 0), (3, "12 !?", "xx", None, 1), (None, lines[0], "xx", "big", 2), (None, "alone here it is", None, "mid", 2), (5, long, None, "s", 5)]


def test_language_stage(spark):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice("abc " if i % 2 else "xyz ") for _ in range(40)), "aa" if i % 2 else "bb", "s", 1) for i in range(80)]
    rows += [(100, None, "aa", "s", 1), (101, "", "bb", "s", 1), (102, "1 2", "aa", "s", 1), (103, "abcabc", None, "s", 1), (None, "xyz xyz", "aa", None, None), (104, "ßß", "aa", "s", 1), rows[0], rows[0]]
    docs = table(spark, rows)
    model = language_id.train(docs)
    import pyarrow as pa

    lang, score = model.predict(pa.array([r[1] for r in rows], pa.string()))
    want = Counter((r[0], r[1], x, r[3], r[4]) for r, x, s in zip(rows, lang, score) if x != "und" and s >= language_id.CHANCE)
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert got.columns == docs.columns and plain(got.collect()) == want and 80 <= sum(want.values()) < len(rows)
    assert (103, "abcabc", "aa", "s", 1) in want  # the language found is carried on
    assert corpus_pipeline.language_stage(spark, docs.where("false"), "").count() == 0


def linked(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) > 4 else {tuple(t)} - {()} for t in ([w for w in words(s) if w] for s in (a, b)))
    return bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)


def test_near_duplicate_stage(spark):
    rows = corpus(random.Random(2))
    rows += [(1, "three unrelated texts share", "xx", "s", 1), (1, "an id and stay all of them", "xx", "s", 1), (1, "An id  and stay all OF them", "xx", "s", 1), rows[7], (2, "", "xx", "s", 0)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, r in enumerate(rows):
        for j in range(i):
            same = r[0] is not None and r[0] == rows[j][0] and [w for w in words(r[1]) if w] and [w for w in words(rows[j][1]) if w]
            if same or linked(r[1], rows[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    stay = [r for i, r in enumerate(rows) if r[0] is None or r[0] == least[find(i)]]
    want = Counter((r[0], tuple(w for w in words(r[1]) if w)) for r in stay if r[0] is None) + Counter({(r[0], tuple(w for w in words(r[1]) if w)) for r in stay if r[0] is not None})
    docs = table(spark, rows)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    found = got.collect()
    assert got.columns == docs.columns and set(plain(found)) <= set(rows)
    assert Counter((r.doc_id, tuple(w for w in words(r.text) if w)) for r in found) == want
    assert sum(r.doc_id == 1 for r in found) == 3  # null, and the two that differ
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), "").count() == 0
    three = table(spark, [(1, "one two three four five six", "x", "s", 1), (1, "seven eight nine ten eleven twelve", "x", "s", 1), (2, "a b c d e f g", "x", "s", 1)])
    assert corpus_pipeline.near_duplicate_stage(spark, three, "").count() == 3


def test_decontamination_stage(spark, tmp_path):
    rows = corpus(random.Random(3)) + [(7, "before " + " ".join(f"W{i}" for i in range(100, 130)) + " after", "xx", "s", 1)] * 2
    items = [(1, " ".join(f"w{i}" for i in range(100, 130))), (2, None), (3, ""), (4, rows[3][1]), (5, "not there at all it is")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    def holds(text, item):
        t, k = ([w for w in words(x) if w] for x in (text, item))
        n = min(5, len(k))
        own, all_ = {tuple(k[i : i + n]) for i in range(len(k) - n + 1)} if n else set(), {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        return bool(own) and 100 * len(own & all_) >= 80 * len(own)

    docs = table(spark, rows)
    got = corpus_pipeline.decontamination_stage(spark, docs, f"file://{tmp_path}")
    want = Counter(r for r in rows if not any(holds(r[1], t) for _, t in items))
    assert got.columns == docs.columns and plain(got.collect()) == want and sum(want.values()) < len(rows) - 3
    assert corpus_pipeline.decontamination_stage(spark, docs.where("false"), f"file://{tmp_path}").count() == 0


def test_mixing_stage(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 4)
    rows = [(i, f"t{i}", "xx", "big" if i % 3 else ("mid" if i % 2 else None), 1) for i in range(900)] + [(5, None, None, "mid", None)] * 2
    docs = table(spark, rows)
    want = sorted((r.mix_slot, r.mix_place, str(r.doc_id)) for r in mixing.mix(docs).collect())
    got = corpus_pipeline.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns and [str(r.doc_id) for r in got.collect()] == [x[2] for x in want]
    assert set(plain(got.collect())) == set(rows)  # every document is there
    parts = [p for p in got.rdd.glom().map(len).collect() if p]
    assert len(parts) > 3 and max(parts) <= 4 * mixing.BLOCK  # runs of slots
    assert corpus_pipeline.mixing_stage(spark, docs.where("false"), "").count() == 0


def test_shard_stage(spark):
    rows = corpus(random.Random(4))
    got = corpus_pipeline.shard_stage(spark, table(spark, rows), "").collect()
    e = token_shards.encoder(open(token_shards.VOCABULARY, "rb").read(), token_shards.PATTERN)
    total = sum(len(e.encode_ordinary(t or "")) + 1 for _, t, *_ in rows)
    assert sum(r.n_tokens for r in got) == total and sorted(r.slot for r in got) == list(range(-(-total // token_shards.LENGTH)))
    assert {i for r in got for i in r.doc_ids} == {-1 if r[0] is None else r[0] for r in rows}
    assert corpus_pipeline.shard_stage(spark, table(spark, []), "").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_run(spark, tmp_path, empty):
    rows = [] if empty else corpus(random.Random(5))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w100 w101 w102 w103 w104 w105")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ids = {i for r in got for i in r.doc_ids}
    assert (not got) if empty else (5 not in ids and 1 not in ids and 1000 in ids and -1 in ids)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from textgauge.llm import common

    class Context:
        master = "spark://elsewhere:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
