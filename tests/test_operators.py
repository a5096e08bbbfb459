import pytest
from pyspark.sql import functions as F

from textgauge.operators import audit, evaluate, labeling, leakage, prepare, segment, vectorize

LONG = " ".join(["palavra"] * 30)


def test_paragraphs_and_windows(spark):
    text = f"um dois\n\n{LONG}\n\ntres\n\n{LONG}\n \nfim"
    got = segment.paragraphs(spark.createDataFrame([("w", text)], "work string, t string"), ["work"], "t").orderBy("ordinal").collect()
    assert [r.paragraph for r in got] == [f"um dois {LONG}", f"tres {LONG}"]
    rows = segment.windows(spark.createDataFrame([(" ".join(f"t{i}" for i in range(300)) + " ,",)], "t string"), [], "t").orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, 115, 230][: len(rows)] and rows[0].window.startswith("t0 t1") and len(rows[0].window.split()) == 160


def test_first_by_hash(spark):
    rows = spark.createDataFrame([("h", 2, "b"), ("h", 1, "a"), ("g", 3, "c")], "hash string, i int, t string")
    assert sorted(map(tuple, segment.first_by_hash(rows, "hash", ["i"]).collect())) == [("g", 3, "c"), ("h", 1, "a")]


def test_labels_and_caps(spark):
    rows = spark.createDataFrame([(i, "b", float(i), f"w{i % 2}") for i in range(9)], "id int, bin string, s double, work string")
    got = {r.id: r.target for r in labeling.labelled(rows, "bin", "s").collect()}
    assert [got[i] for i in range(9)] == ["baixa"] * 3 + ["media"] * 3 + ["alta"] * 3
    capped = labeling.capped(rows.withColumn("target", F.lit("x")), "work", "target", ["id"], 2, 3)
    assert capped.count() == 4


def test_audit(spark):
    rows = spark.createDataFrame([(1, "Um dois tres quatro. Um dois tres quatro.", "a"), (1, "um DOIS  tres quatro", "b"), (2, "um DOIS  tres quatro", "b")], "id int, t string, y string")
    d = audit.duplicate_counts(rows, "id", "t").first()
    assert (d.exact, d.normalised, d.ids) == (1, 1, 1)
    assert audit.repeated_sentences(rows, "t").first().occurrences == 4
    assert audit.length_crosstab(rows, "t", "y", ["a", "b"]).count() == 6


def test_validation_collects_all_faults(spark):
    bad = spark.createDataFrame([("1", "x", "a"), ("1", None, "a")], "id string, texto string, target string")
    with pytest.raises(prepare.CorpusError) as e:
        prepare.validate(bad)
    assert "duplicate ids" in str(e.value) and "null" in str(e.value) and "two classes" in str(e.value) and "three rows" in str(e.value)
    with pytest.raises(prepare.CorpusError, match="missing columns"):
        prepare.validate(bad.drop("target"))
    good = spark.createDataFrame([("1", "x", "a"), ("2", "X ", "b"), ("3", "y", "b")], "id string, texto string, target string")
    assert prepare.validate(good) == ["2 rows with normalised copies"]


def test_split(spark):
    n = 101
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(n)], "id int, y string")
    got = prepare.stratified_split(rows, "id", "y").groupBy("split").count().collect()
    assert sum(r["count"] for r in got) == n and {r["split"] for r in got} == {"train", "val", "test"}
    assert sum(prepare.split_counts(n, 0.15, 0.15)) == n and prepare.split_counts(100, 0.15, 0.15) == (70, 15, 15)


def test_leakage(spark):
    rows = spark.createDataFrame([("train", "Olá, Mundo"), ("val", "ola mundo"), ("test", "outro")], "split string, t string")
    from textgauge.functions import text as T

    shared = {(r.left_split, r.right_split): r.shared for r in leakage.value_overlap(rows, T.leakage_form(F.col("t")), "n").collect()}
    assert shared == {("train", "val"): 1, ("train", "test"): 0, ("val", "test"): 0}
    assert leakage.target_like_columns(["id", "target_encoded", "Nível", "texto", "my_target"], ["id", "texto"]) == ["target_encoded", "Nível", "my_target"]
    a = "a criança observou a árvore antiga perto do rio durante a tarde"
    left = spark.createDataFrame([(1, a), (2, "nada disso")], "i int, t string")
    right = spark.createDataFrame([(7, a.upper() + "!"), (8, "completamente diferente")], "i int, t string")
    assert [tuple(r) for r in leakage.near_duplicates(left, right, "i", "t").collect()] == [(1, 7, 1.0)]
    with pytest.raises(leakage.LeakageError):
        leakage.gate({"critical": 1})
    leakage.gate({"critical": 1}, False)


def test_near_copies_across_splits(spark):
    import math
    import random
    from collections import Counter

    from textgauge.plans import corpus_queries, model_queries

    draw = random.Random(5)
    texts = [" ".join(draw.choice(["rio", "criança", "árvore", "tarde", "longamente", "observou", "antiga"]) + str(draw.randrange(30)) for _ in range(20)) for _ in range(30)]
    split = lambda i: "train" if i % 20 < 14 else "val" if i % 20 < 17 else "test"
    rows = [(i, texts[i % 29] + (" fim" if i % 3 else ""), split(i)) for i in range(90)] + [(100, None, "train"), (114, "", "val")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, split string")
    form = lambda t: (t or "").replace("ç", "c").replace("á", "a")
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    near, cosine = {}, {}
    for a, b in pairs:
        mine = [(i, form(t), s) for i, t, s in rows if s in (a, b)]
        terms = {i: Counter(g for w in t.split() for g in ([f" {w} "] if len(w) < 4 else [f" {w} "[k : k + 5] for k in range(len(w) - 2)])) for i, t, _ in mine}
        df = Counter(g for c in terms.values() for g in c)
        vec = {i: {g: n * (math.log((1 + len(mine)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in terms.items()}
        unit = {i: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for i, v in vec.items()}
        grams = {i: {f"  {t}  "[k : k + 5] for k in range(len(t))} if t else set() for i, t, _ in mine}
        for i, t, s in mine:
            for j, u, r in mine:
                if (s, r) == (a, b):
                    dot = round(sum(x * unit[j].get(g, 0) for g, x in unit[i].items()), 6)
                    shared = len(grams[i] & grams[j])
                    if dot >= 0.92:
                        cosine[a, b, i, j] = dot
                    if t and u and round(shared / (len(grams[i] | grams[j])), 6) >= 0.92:
                        near[a, b, i, j] = round(shared / len(grams[i] | grams[j]), 6)
    for want, find in ((near, corpus_queries.near_duplicates_by_split), (cosine, model_queries.cosine_pairs_by_split)):
        got = {tuple(r)[:4]: r.similarity for r in find(docs).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
        assert any(i % 2 == j % 2 for _, _, i, j in got) and {k[:2] for k in got} == set(pairs)


def test_metrics(spark):
    rows = spark.createDataFrame(list(zip(["baixa", "media", "alta", "alta"], ["baixa", "media", "media", "alta"])), "y string, p string")
    m = evaluate.metrics(rows).first()
    assert m.accuracy == 0.75 and m.balanced_accuracy == 0.833333
    assert evaluate.confusion(rows).count() == 9 and evaluate.report(rows).count() == 6
    runs = spark.createDataFrame([("e", 0.5, 0.4), ("e", 1.0, 0.8)], "experiment string, accuracy double, f1_macro double")
    s = evaluate.summary(runs, "experiment", ["accuracy", "f1_macro"]).first()
    assert s.accuracy_mean == 0.75 and s.accuracy_std == 0.25 and s.f1_macro_min == 0.4 and s.f1_macro_max == 0.8
    tied = spark.createDataFrame([(2, 0.5, 0.5, 0.5), (1, 0.5, 0.5, 0.5)], "position int, f1_macro double, f1_weighted double, accuracy double")
    assert evaluate.best(tied, "f1_macro").first().position == 1


def test_folds(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, y string")
    got = evaluate.stratified_folds(rows, "id", "y", 5).groupBy("fold").count().collect()
    assert [r["count"] for r in got] == [4] * 5
    with pytest.raises(ValueError):
        evaluate.stratified_folds(rows.limit(3), "id", "y", 5)
    folds = evaluate.group_folds({"a": 9, "b": 5, "c": 4, "d": 1}, 2)
    assert folds == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(evaluate.MergeError):
        evaluate.merge_one_to_one(rows, rows.limit(3), ["id"])


def test_tfidf_rows_have_unit_length(spark):
    d = spark.createDataFrame([(1, "um dois um"), (2, "dois tres")], "i int, t string")
    counts = vectorize.term_counts(d, "i", vectorize.word_terms(F.col("t")))
    assert {(r.i, r.term): r.tf for r in counts.collect()}[1, "um dois"] == 1
    norms = vectorize.tfidf(counts, vectorize.vocabulary(counts, 2), "i").groupBy("i").agg(F.round(F.sum(F.col("weight") ** 2), 9).alias("n")).collect()
    assert [r.n for r in norms] == [1.0, 1.0]
    wb = d.select(vectorize.char_wb_terms(F.lit("ab longer")).alias("x")).first().x
    assert wb[0] == " ab " and " long" in wb and "nger " in wb
    assert vectorize.char_terms is not None and d.select(F.size(vectorize.char_terms(F.lit("abcd"))).alias("n")).first().n == 3


def test_softmax(spark):
    s = spark.range(1).select(evaluate.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s")).first().s
    assert s == [0.5, 0.5]


def test_gap_is_a_share_of_the_smallest_mean(spark):
    # means of 100 and 110.5 words: 10.5 / 100
    rows = [("a", "w " * 100), ("b", "w " * 110), ("b", "w " * 111)]
    of = lambda rows: tuple(audit.gap_ratio(spark.createDataFrame(rows, "y string, t string"), "t", "y").first())
    assert of(rows) == (0.105, True)
    assert of([("a", "w " * 100), ("b", "w " * 109)]) == (0.09, False)
    assert of([("a", "..."), ("b", "w w")]) == (None, False)


def test_candidates_are_named_by_window(spark):
    text = " ".join(f"t{i}" for i in range(400))
    rows = segment.windows(spark.createDataFrame([("w", text)], "work string, t string"), ["work"], "t").where("offset > 0")
    got = [tuple(r)[1:] for r in segment.candidates(rows, "work").orderBy("janela_inicio").collect()]
    # windows begin at tokens 0, 115 and 230
    assert got == [("janela_00001", 1, 161), ("janela_00002", 2, 162)]


def test_normalised_copies_fail_the_gate(spark):
    rows = [(1, "A casa do gato é bonita", "x", "train"), (2, "a CASA, do gato: é bonita!", "x", "test"), (3, "outra coisa bem diferente", "y", "val")]
    report = leakage.check(spark.createDataFrame(rows, "id int, t string, y string, split string"), "id", "t", "y")
    assert [(f["severity"], f["check"]) for f in report["findings"]][0] == ("critical", "normalized_text_overlap") and report["summary"]["status"] == "failed"
    with pytest.raises(leakage.LeakageError):
        leakage.gate({"critical": report["summary"]["critical_findings"]})


def test_a_run_without_its_metric_is_an_error(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.1, 0.1, 0), ("b", float("nan"), 0.2, 0.2, 1)], "experiment string, f1_macro double, f1_weighted double, accuracy double, position int")
    for bad in (rows, rows.withColumn("f1_macro", F.lit(None).cast("double")), rows.limit(0)):
        with pytest.raises(evaluate.SelectionError):
            evaluate.best(bad, "f1_macro")
    with pytest.raises(evaluate.SelectionError, match="no metric"):
        evaluate.best(rows, "recall")
    assert evaluate.best(rows, "accuracy").first().experiment == "b"


def test_first_rows_of_a_hot_group(spark):
    from textgauge.operators import ranking

    # a third of all rows in one group, a null group, ties and repeated rows
    rows = [(("hot" if i % 3 == 0 else None if i % 3 == 1 else f"w{i % 30}"), i * 7919 % 500, i % 11) for i in range(3000)] + [("w2", 0, 0)] * 3
    got = ranking.first_rows(spark.createDataFrame(rows, "w string, a int, b int"), ["w"], ["a", "b"], 20, "rank").collect()
    by = {}
    for w, a, b in sorted(rows, key=lambda r: r[1:]):
        by.setdefault(w, []).append((a, b))
    assert {w: [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"]) if r.w == w] for w in by} == {w: v[:20] for w, v in by.items()}


def test_entry_is_whole():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_registered_models_do_the_whole_search(spark, monkeypatch):
    from textgauge.operators import models as M
    from textgauge.plans import model_queries, registry

    assert len(M.grid(M.SEARCH_SPACES["logistic_regression"])) == 16 and len(M.grid(M.SEARCH_SPACES["linear_svm"])) == 8
    drawn = M.random_points(M.SEARCH_SPACES["logistic_regression"])
    assert len(drawn) == 10 and len({str(p) for p in drawn}) == 10 and len(M.random_points(M.SEARCH_SPACES["random_forest"])) == 8
    assert M.spec_of("logistic_regression", 0).max_iter == 2000 and M.forest_of().getMaxDepth() == 20 and M.forest_of().getNumTrees() == 40
    units = []

    class Nothing:
        def __init__(self, df, kinds):
            self.folds = list(range(5))

        def drop(self):
            pass

    def unit(vectors, unit, points):
        units.append(unit)
        kind, name, fold, balanced = unit
        mine = [i for i, p in enumerate(points[name]) if balanced is None or p.get("balanced", True) == balanced]
        return [M.result_row(vectors, kind, name, i, k, 0.1, {(0, 0): 3, (0, 1): 1, (1, 1): 4}) for i in mine for k in ([fold] if fold is not None else vectors.folds)]

    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id long, target string")
    monkeypatch.setattr(M, "Vectors", Nothing)
    monkeypatch.setattr(M, "linear_unit", unit)
    monkeypatch.setattr(M, "forest_unit", unit)
    monkeypatch.setattr(model_queries, "labelled_documents", lambda spark, sf: rows)
    assert registry.QUERIES["m24_cross_validation"](spark, "").count() == 12 and len(units) == 4 * (2 + 5)
    assert registry.QUERIES["m10_random_forest"](spark, "").count() == 5
    monkeypatch.setattr(M, "REPRESENTATIONS", ["tfidf_word"])
    units.clear()
    found = registry.QUERIES["m21_grid_search"](spark, "")
    assert found.count() == 32 and found.select("experiment", "params").distinct().count() == 32 and len(units) == 2 + 10


def test_group_column(spark):
    rows = spark.createDataFrame([(1, "A ", None), (2, " a", "x"), (3, None, "Y"), (4, "", "y ")], "id long, obra string, autor string")
    column, strategy, groups = evaluate.select_group_column(rows, "id")
    assert (column, strategy) == ("autor", "fallback_column") and [r["group"] for r in groups.orderBy("id").collect()] == ["nan", "x", "y", "y"]
    assert evaluate.select_group_column(rows, "id", "autor")[1] == "preferred_column"
    column, strategy, groups = evaluate.select_group_column(rows.drop("autor"), "id")
    assert strategy == "synthetic_row_id" and groups.select("group").distinct().count() == 4
    with pytest.raises(ValueError):
        evaluate.select_group_column(rows.drop("autor"), "id", by_row=False)


def test_registered_caps_are_the_references(spark, monkeypatch):
    from textgauge.plans import corpus_queries, registry

    rows = spark.range(4000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'small', 'hot') AS source", "concat('c', id % 3) AS target", "id % 5 AS bin", "md5(string(id)) AS md5")
    monkeypatch.setattr(corpus_queries, "labelled", lambda spark, sf: rows)
    assert registry.QUERIES["l03_caps_whole"](spark, "").groupBy("source").count().orderBy("source").collect() == [("hot", 850), ("small", 850)]
    assert {r["count"] for r in labeling.capped(rows.where("target = 'c1'"), "source", "target", ["md5"]).groupBy("source").count().collect()} == {320}
    assert registry.QUERIES["l06_card_whole"](spark, "").agg({"rows": "min"}).first()[0] > 500
    windows = spark.range(2000).selectExpr("'w' AS source", "id AS doc_id", "0L AS `offset`")
    monkeypatch.setattr(corpus_queries, "filtered", lambda spark, sf: windows)
    assert registry.QUERIES["g04_cap_per_work_whole"](spark, "").count() == 1700


def brute_near(rows, n=5):
    """(id, part) -> links, and pairs of rows in different parts, by comparing all sets."""
    sets = {}
    for i, t, p in rows:
        form = " ".join("".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in (t or "").lower()).split())
        padded = f"  {form}  "
        sets[i] = (p, len(form), {padded[k : k + n] for k in range(max(len(padded) - n + 1, 1))} if form else set())
    links = dict.fromkeys(sets, 0)
    for i, (p, c, x) in sets.items():
        for j, (q, d, y) in sets.items():
            if p != q and x and y and round(len(x & y) / len(x | y), 6) >= 0.92 and min(c, d) >= 0.7 * max(c, d):
                links[i] += 1
    return links


def test_near_copies_of_whole_documents(spark):
    """Texts of one sign to thousands, groups of copies, near copies at and beside the threshold, texts of one repeated word."""
    import random

    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(1, 9))) for _ in range(400)]
    rows = []
    for _ in range(60):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 2, 3, 6, 12, 25, 60, 200, 1500]))]
        for _ in range(draw.choice([1, 2, 5, 9])):
            mine = list(base)
            for _ in range(draw.choice([0, 0, 1, 1 + len(mine) // 100, 1 + len(mine) // 60, 1 + len(mine) // 30])):
                if mine:
                    mine[draw.randrange(len(mine))] = draw.choice(vocabulary)
            rows.append((len(rows), draw.choice([" ", "  ", ", "]).join(mine).upper(), draw.choice(["train", "val", "test"])))
    rows += [(len(rows) + k, "la " * m, ["train", "val"][k % 2]) for k, m in enumerate([1, 2, 3, 50, 60, 80, 200])]
    rows += [(-1, None, "val"), (-2, "", "test"), (-3, " .!", "train")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, split string").withColumn("form", F.lit("x")).withColumn("class", F.lit(None).cast("int"))
    got = {r.doc_id: r for r in leakage.near_duplicate_counts(docs, "doc_id", "text").collect()}
    want = brute_near(rows)
    assert {i: r.links for i, r in got.items()} == want and sum(want.values()) > 100
    assert got[-1].class_id == -1 and all(r.class_id <= i and r.copies <= r.links for i, r in got.items())
    assert leakage.near_duplicate_counts(docs.limit(0), "doc_id", "text").count() == 0


def test_parts_of_similar_sets_meet():
    """Any two sets at the threshold share a part's digest, whatever their sizes; others hardly ever do."""
    import numpy as np

    from textgauge.operators import near

    draw, starts = np.random.default_rng(3), near.levels(0.92 - 6e-7)
    for size in [*range(1, 60), 100, 500, 3000]:
        for _ in range(20):
            most = int(size * 0.08)  # the smaller one lacks as many as it may
            x = draw.choice(38**5, size, replace=False)
            y = x[: size - draw.integers(0, most + 1)]
            swap = int((len(y) - 0.92 * (len(x) + len(y)) / 1.92) + 1e-9)
            y = np.concatenate([y[max(swap, 0) :], -1 - np.arange(max(swap, 0))]) if swap > 0 else y
            if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.92:
                assert len(np.intersect1d(near.part_digests(x, 0.92 - 6e-7, starts), near.part_digests(y, 0.92 - 6e-7, starts)))
    # few grams, so that parts are often empty
    for _ in range(300):
        x = draw.choice(14, 13, replace=False)
        y = x[1:]
        assert len(np.intersect1d(near.part_digests(x, 0.92 - 6e-7, starts), near.part_digests(y, 0.92 - 6e-7, starts)))


def test_long_texts_of_one_vocabulary_are_no_candidates(spark, monkeypatch):
    """Sets that share four fifths have a part in common but not its block's sketch; near copies among them are found."""
    import random

    from textgauge.operators import near

    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 7))) for _ in range(120)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(6000)) for _ in range(40)]
    texts.append(texts[0].replace(" ", " new ", 3))
    rows = [(i, t, ["train", "val"][i % 2 if i < 40 else 1]) for i, t in enumerate(texts)]
    counts, saved = {}, near.saved
    monkeypatch.setattr(near, "saved", lambda df, name: counts.setdefault(name, saved(df, name)))
    dropped = near.dropped
    sizes = {}
    monkeypatch.setattr(near, "dropped", lambda *tables: (sizes.update({n: t.count() for n, t in counts.items()}), dropped(*tables)))
    got = {r.doc_id: r.links for r in leakage.near_duplicate_counts(spark.createDataFrame(rows, "doc_id long, text string, split string"), "doc_id", "text").collect()}
    assert got == brute_near(rows) and got[0] == got[40] == 1
    assert sizes["candidates"] < 40


def test_stratified_parts_have_the_sizes_of_the_split(spark):
    """Three classes of ten: 20, 5 and 5 rows, not a rounding up in each class; a null class is one too."""
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "id int, y string")
    got = {(r.split, r.y): r["count"] for r in prepare.stratified_split(rows, "id", "y").groupBy("split", "y").count().collect()}
    assert {s: sum(n for (p, _), n in got.items() if p == s) for s in ("train", "val", "test")} == {"train": 20, "val": 5, "test": 5}
    assert sorted(n for (p, _), n in got.items() if p == "test") == [1, 2, 2] and got["test", "c"] == 1
    assert prepare.apportioned([6, 3, 1], 5) == [3, 2, 0] and prepare.apportioned([], 0) == []
    rows = spark.createDataFrame([(i, None if i % 4 else "a") for i in range(41)], "id int, y string")
    sizes = {r.split: r["count"] for r in prepare.stratified_split(rows, "id", "y").groupBy("split").count().collect()}
    assert tuple(sizes[s] for s in ("train", "val", "test")) == prepare.split_counts(41, 0.15, 0.15)
    assert prepare.stratified_split(rows.limit(0), "id", "y").count() == 0


def test_fold_metrics_over_fixed_labels(spark):
    """Worked by hand: fold 1 lacks the label c, whose zeros count in the means."""
    rows = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (1, "b", "b"), (2, "c", "a"), (2, "c", None)], "fold int, y string, p string")
    one, two = evaluate.fold_metrics(rows, "fold", ["a", "b", "c"]).orderBy("fold").collect()
    assert tuple(one) == (1, 3, 0.666667, 0.5, 0.5, 0.444444)
    assert tuple(two) == (2, 2, 0.0, 0.0, 0.0, 0.0)
    assert evaluate.fold_metrics(rows.limit(0), "fold", ["a"]).count() == 0
