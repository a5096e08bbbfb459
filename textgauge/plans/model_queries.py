"""Queries for vectors, folds, metrics, explanations and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from textgauge.functions import features as X
from textgauge.functions import lexicons as lex
from textgauge.functions import text as T
from textgauge.operators import evaluate as E
from textgauge.operators import leakage, terms
from textgauge.operators import vectorize as V
from textgauge.operators.cosine import cosines
from textgauge.plans import sql as S
from textgauge.plans.corpus_queries import GRAMS, SPLIT_NAMES, TURN_SPLIT, split_documents, split_turns  # noqa: F401
from textgauge.plans.registry import documents, query, table
from textgauge.sources.scratch import saved

#: A prediction that SQL can make too: the true language, or English for ids whose digest begins below 4.
PREDICTED = "pr AS (SELECT doc_id, source, lang AS y, CASE WHEN md5(doc_id::VARCHAR) < '4' THEN 'en' ELSE lang END AS p FROM documents)"


def predicted(spark, sf):
    return documents(spark, sf).select("doc_id", "source", F.col("lang").alias("y"), F.when(F.md5(F.col("doc_id").cast("string")) < "4", "en").otherwise(F.col("lang")).alias("p"))


@query(f"WITH {S.FEATURE_INPUT} SELECT doc_id, d.source, num_palavras FROM (SELECT doc_id, {S.linguistic()} FROM f2) JOIN documents d USING (doc_id)")
def m01_merge(spark, sf):
    d = documents(spark, sf)
    return E.merge_one_to_one(d.select("doc_id", "source"), X.linguistic(d.select("doc_id", "text"), "text").select("doc_id", "num_palavras"), ["doc_id"])


@query("WITH s AS (SELECT doc_id, lang, CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM documents) SELECT doc_id, lang FROM s WHERE split = 'train' UNION ALL SELECT doc_id, lang FROM s WHERE split = 'val'")
def m02_concat(spark, sf):
    from textgauge.operators.prepare import assigned_split

    rows = documents(spark, sf).select("doc_id", "lang", assigned_split(F.col("doc_id")).alias("split"))
    return rows.where("split = 'train'").unionByName(rows.where("split = 'val'")).drop("split")


def tfidf_sql(terms: str, most: int | None) -> str:
    limit = f" ORDER BY total DESC, term LIMIT {most}" if most else ""
    return f"""c0 AS (SELECT doc_id, unnest({terms}) AS term FROM documents), c1 AS (SELECT doc_id, term, count(*) AS tf FROM c0 GROUP BY ALL),
v0 AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c1 GROUP BY term{limit}), v1 AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)::DOUBLE) + 1 AS idf FROM v0),
w0 AS (SELECT doc_id, term, tf * idf AS w FROM c1 JOIN v1 USING (term)), w1 AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


def tfidf(spark, sf, kind, most):
    """doc_id and the weights of its terms, documents that have some."""
    rows = terms.by_id(documents(spark, sf), "doc_id", "text")
    known = terms.vocabulary(rows, kind, documents(spark, sf).count(), most)
    found = terms.vectors(terms.prepared(rows, kind, "id"), kind, {0: known}).where(F.size("i") > 0)
    return found.select(F.col("id").alias("doc_id"), "x")


def summed_weights(rows):
    return rows.select("doc_id", F.size("x").cast("long").alias("terms"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(F.array_max("x"), 6).alias("top"))


_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
WORD_TERMS = f"list_concat({_W}, list_transform(range(1, greatest(len({_W}), 1)), lambda i: {_W}[i] || ' ' || {_W}[i + 1]))"
CHAR_TEXT = r"regexp_replace(lower(text), '[\s\v\x{a0}]{2,}', ' ', 'g')"
CHAR_TERMS = "list_concat(" + ", ".join(f"list_transform(range(1, greatest(length({CHAR_TEXT}) - {n - 2}, 1)), lambda i: substr({CHAR_TEXT}, i, {n}))" for n in (3, 4)) + ")"
#: Term lists are built in a first step, so that expressions in lambdas are only read.
WORD_SQL = tfidf_sql("list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))", 5000).replace("FROM documents), c1", f"FROM (SELECT doc_id, {_W} AS ws FROM documents)), c1")
CHAR_SQL = tfidf_sql("list_concat(" + ", ".join(f"list_transform(range(1, greatest(length(ct) - {n - 2}, 1)), lambda i: substr(ct, i, {n}))" for n in (3, 4, 5)) + ")", 3000).replace("FROM documents), c1", f"FROM (SELECT doc_id, {CHAR_TEXT} AS ct FROM documents)), c1")


@query(f"WITH {WORD_SQL} SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM w1 GROUP BY doc_id")
def m03_tfidf_word(spark, sf):
    return summed_weights(tfidf(spark, sf, "word", 5000))


@query(f"WITH {CHAR_SQL} SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM w1 GROUP BY doc_id")
def m04_tfidf_char(spark, sf):
    return summed_weights(tfidf(spark, sf, "char", 3000))


WB = r"""x0 AS (SELECT conv_id * 1000 + turn AS doc_id, unnest(list_filter(string_split_regex(lower(text), '[\s\v\x{a0}]+'), lambda w: w <> '')) AS w FROM conversations),
x1 AS (SELECT doc_id, ' ' || w || ' ' AS p FROM x0),
x2 AS (SELECT doc_id, unnest(CASE WHEN length(p) <= 5 THEN [p] ELSE list_transform(range(1, length(p) - 3), lambda i: substr(p, i, 5)) END) AS term FROM x1),
c1 AS (SELECT doc_id, term, count(*) AS tf FROM x2 GROUP BY ALL), nd AS (SELECT count(*) AS n FROM conversations),
v1 AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT n FROM nd)) / (1.0 + count(*))::DOUBLE) + 1 AS idf FROM c1 GROUP BY term),
w0 AS (SELECT doc_id, term, tf * idf AS w FROM c1 JOIN v1 USING (term)), w1 AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


def turns(spark, sf):
    d = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    counts = saved(terms.row_counts(terms.prepared(terms.by_id(d, "doc_id", "text"), "char_wb", "id"), "char_wb").withColumnRenamed("id", "doc_id"), "term-counts")
    return V.tfidf(counts, V.vocabulary(counts, d.count()), "doc_id")


@query(f"WITH {WB} SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total FROM w1 GROUP BY doc_id")
def m05_tfidf_char_wb(spark, sf):
    return turns(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("total"))


@query(f"WITH {WB} SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(sum(a.weight * b.weight), 6) AS similarity FROM w1 a JOIN w1 b USING (term) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY ALL HAVING round(sum(a.weight * b.weight), 6) >= 0.92")
def k06_cosine_pairs(spark, sf):
    parity = F.when(F.col("doc_id") % 2 == 0, "even").when(F.col("doc_id") % 2 == 1, "odd").otherwise("neither")
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    found = cosines(rows.withColumn("part", parity), "doc_id", "text", "part", [("even", "odd", ["even", "odd", "neither"])], 0.92)
    return found.expanded().drop("left_part", "right_part")


def cosine_pairs_by_split(rows):
    """Weights are fitted on both sides of each pair of splits, on normalised texts."""
    rows = rows.withColumn("text", T.leakage_form(F.col("text")))
    return cosines(rows, "doc_id", "text", "split", [(a, b, [a, b]) for a, b in leakage.PAIRS], 0.92).expanded().withColumnsRenamed({"left_part": "left_split", "right_part": "right_split"})


SPLIT_WB = f"""x0 AS (SELECT doc_id, {TURN_SPLIT.format('doc_id')} AS split, {S.leakage_form('text')} AS k FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)),
pr AS (SELECT * FROM (VALUES (0, 1), (0, 2), (1, 2)) t(l, r)), nd AS (SELECT l, r, count(*) AS n FROM x0 JOIN pr ON split IN (l, r) GROUP BY ALL),
x1 AS (SELECT doc_id, split, ' ' || unnest(list_filter(string_split(k, ' '), lambda w: w <> '')) || ' ' AS p FROM x0),
x2 AS (SELECT doc_id, split, unnest(CASE WHEN length(p) <= 5 THEN [p] ELSE list_transform(range(1, length(p) - 3), lambda i: substr(p, i, 5)) END) AS term FROM x1),
c1 AS (SELECT doc_id, split, term, count(*) AS tf FROM x2 GROUP BY ALL), c2 AS (SELECT c1.*, l, r FROM c1 JOIN pr ON split IN (l, r)),
v0 AS (SELECT l, r, term, count(*) AS df FROM c2 GROUP BY ALL), v1 AS (SELECT l, r, term, ln((1.0 + n) / (1.0 + df)::DOUBLE) + 1 AS idf FROM v0 JOIN nd USING (l, r)),
w0 AS (SELECT l, r, doc_id, split, term, tf * idf AS w FROM c2 JOIN v1 USING (l, r, term)), w1 AS (SELECT l, r, doc_id, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY l, r, doc_id)) AS weight FROM w0)"""


@query(f"WITH {SPLIT_WB} SELECT {SPLIT_NAMES}[l + 1] AS left_split, {SPLIT_NAMES}[r + 1] AS right_split, a.doc_id AS left_id, b.doc_id AS right_id, round(sum(a.weight * b.weight), 6) AS similarity FROM w1 a JOIN w1 b USING (l, r, term) WHERE a.split = l AND b.split = r GROUP BY ALL HAVING round(sum(a.weight * b.weight), 6) >= 0.92")
def k06_cosine_pairs_by_split(spark, sf):
    return cosine_pairs_by_split(split_turns(spark, sf))


@query()
def k06_cosine_pair_documents(spark, sf):
    """Too slow in SQL on whole documents, as in k05."""
    return cosine_pairs_by_split(split_documents(spark, sf))


SCALED = ["num_palavras", "num_sentencas", "type_token_ratio"]


@query(f"WITH {S.FEATURE_INPUT}, g AS (SELECT doc_id, {S.linguistic()} FROM f2), s AS (SELECT " + ", ".join(f"stddev_pop({c}) AS s_{c}" for c in SCALED) + " FROM g) SELECT doc_id, " + ", ".join(f"round({c} / s_{c}, 9) AS {c}" for c in SCALED) + " FROM g, s")
def m06_scaled(spark, sf):
    rows = X.linguistic(documents(spark, sf).select("doc_id", "text"), "text").select("doc_id", *SCALED)
    return V.scaled(rows, SCALED).select("doc_id", *(F.round(c, 9).alias(c) for c in SCALED))


@query("SELECT lang, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM documents GROUP BY lang")
def m11_class_weights(spark, sf):
    return E.class_weights(documents(spark, sf), "lang").select("lang", F.round("weight", 9).alias("weight"))


PER_CLASS = f"""{PREDICTED}, lb AS (SELECT y AS label FROM pr UNION SELECT p FROM pr),
k0 AS (SELECT label, (SELECT count(*) FROM pr WHERE y = label) AS support, (SELECT count(*) FROM pr WHERE p = label) AS predicted, (SELECT count(*) FROM pr WHERE y = label AND p = label) AS hits FROM lb),
k1 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE hits / predicted END AS prec, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits / support END AS rec FROM k0),
k2 AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0::DOUBLE ELSE 2 * prec * rec / (prec + rec) END AS f FROM k1)"""


@query(f"WITH {PER_CLASS} SELECT round_even(sum(hits) / sum(support), 6) AS accuracy, round_even(avg(prec), 6) AS precision_macro, round_even(avg(rec), 6) AS recall_macro, round_even(avg(f), 6) AS f1_macro, round_even(sum(f * support) / sum(support), 6) AS f1_weighted, round_even(avg(rec) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM k2")
def m14_metrics(spark, sf):
    return E.metrics(predicted(spark, sf))


@query(f"WITH {PREDICTED}, lb AS (SELECT y AS label FROM pr UNION SELECT p FROM pr), c AS (SELECT a.label AS \"true\", b.label AS predicted, (SELECT count(*) FROM pr WHERE y = a.label AND p = b.label) AS n FROM lb a, lb b) SELECT *, round_even(n / greatest(sum(n) OVER (PARTITION BY \"true\"), 1), 6) AS share FROM c")
def m15_confusion(spark, sf):
    return E.confusion(predicted(spark, sf))


@query(f"WITH {PER_CLASS} SELECT label, round_even(prec, 6) AS precision, round_even(rec, 6) AS recall, round_even(f, 6) AS f1, support FROM k2 UNION ALL SELECT 'accuracy', round_even(sum(hits) / sum(support), 6), round_even(sum(hits) / sum(support), 6), round_even(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM k2 UNION ALL SELECT 'macro avg', round_even(avg(prec), 6), round_even(avg(rec), 6), round_even(avg(f), 6), sum(support)::BIGINT FROM k2 UNION ALL SELECT 'weighted avg', round_even(sum(prec * support) / sum(support), 6), round_even(sum(rec * support) / sum(support), 6), round_even(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM k2")
def m16_report(spark, sf):
    return E.report(predicted(spark, sf))


BY_SOURCE = f"{PREDICTED}, ex AS (SELECT source AS experiment, row_number() OVER (ORDER BY source) AS position, round_even(avg((y = p)::INT), 6) AS accuracy, round_even(avg((y = p)::INT), 2) AS f1_macro, round_even(avg((y = p)::INT), 3) AS f1_weighted FROM pr GROUP BY source)"


def experiments(spark, sf):
    from pyspark.sql import Window as W

    hit = F.avg((F.col("y") == F.col("p")).cast("int"))
    rows = predicted(spark, sf).groupBy(F.col("source").alias("experiment")).agg(F.bround(hit, 6).alias("accuracy"), F.bround(hit, 2).alias("f1_macro"), F.bround(hit, 3).alias("f1_weighted"))
    return rows.withColumn("position", F.row_number().over(W.orderBy("experiment")).cast("long"))  # one row for each source


@query(f"WITH {BY_SOURCE} SELECT * FROM ex ORDER BY f1_macro DESC, f1_weighted DESC, accuracy DESC, position LIMIT 1")
def m17_best_experiment(spark, sf):
    return E.best(experiments(spark, sf), "f1_macro")


@query(f"WITH {BY_SOURCE} SELECT experiment, f1_macro, row_number() OVER (ORDER BY f1_macro DESC, f1_weighted DESC, accuracy DESC, position) AS place FROM ex")
def m18_results_table(spark, sf):
    return E.results_table(experiments(spark, sf), "f1_macro").select("experiment", "f1_macro", "place")


@query(f"WITH {BY_SOURCE} SELECT experiment, f1_macro, rank() OVER (ORDER BY f1_macro DESC) AS rank FROM ex")
def m22_ranked_results(spark, sf):
    from pyspark.sql import Window as W

    return experiments(spark, sf).select("experiment", "f1_macro", F.rank().over(W.orderBy(F.desc("f1_macro"))).cast("long").alias("rank"))


FOLDS = "fo AS (SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) - 1) % 5)::INTEGER AS fold FROM documents)"


@query(f"WITH {FOLDS} SELECT doc_id, fold FROM fo")
def m23_stratified_folds(spark, sf):
    return E.stratified_folds(documents(spark, sf).select("doc_id", "lang"), "doc_id", "lang", 5).select("doc_id", "fold")


REPEATED = " UNION ALL ".join(f"SELECT doc_id, {r} AS repeat, ((row_number() OVER (PARTITION BY lang ORDER BY md5({s!r} || doc_id::VARCHAR)) - 1) % 5)::INTEGER AS fold FROM documents" for r, s in enumerate(("", "1", "2")))


@query(REPEATED)
def m23_repeated_folds(spark, sf):
    return E.repeated_folds(documents(spark, sf).select("doc_id", "lang"), "doc_id", "lang", 5, 3).select("doc_id", "repeat", "fold")


@query("SELECT least(5, count(DISTINCT source)) AS folds FROM documents")
def m28_effective_splits(spark, sf):
    groups = documents(spark, sf).agg(F.countDistinct("source")).first()[0]
    return spark.createDataFrame([(E.effective_splits(5, groups),)], "folds long")


@query(f"WITH {PREDICTED}, {FOLDS}, r AS (SELECT source AS experiment, fold, avg((y = p)::INT) AS accuracy FROM pr JOIN fo USING (doc_id) GROUP BY ALL), g AS (SELECT experiment, count(*) AS folds, round_even(avg(accuracy), 6) AS accuracy_mean, round_even(stddev_pop(accuracy), 6) AS accuracy_std, min(accuracy) AS accuracy_min, max(accuracy) AS accuracy_max FROM r GROUP BY experiment) SELECT *, row_number() OVER (ORDER BY accuracy_mean DESC, experiment) AS rank FROM g")
def m25_cv_summary(spark, sf):
    folds = E.stratified_folds(documents(spark, sf).select("doc_id", "lang"), "doc_id", "lang", 5).select("doc_id", "fold")
    rows = predicted(spark, sf).join(folds, "doc_id").groupBy(F.col("source").alias("experiment"), "fold").agg(F.avg((F.col("y") == F.col("p")).cast("int")).alias("accuracy"))
    return E.summary(rows, "experiment", ["accuracy"])


@query("SELECT count(DISTINCT lower(trim(source))) AS source_groups, count(DISTINCT lower(trim(lang))) AS lang_groups FROM documents WHERE trim(source) <> ''")
def m26_usable_groups(spark, sf):
    d = documents(spark, sf).where(~T.is_blank(F.col("source")))
    return d.agg(F.countDistinct(T.group_value(F.col("source"))).alias("source_groups"), F.countDistinct(T.group_value(F.col("lang"))).alias("lang_groups"))


@query("WITH f AS (SELECT source, (dense_rank() OVER (ORDER BY source) - 1) % 5 AS fold FROM documents) SELECT fold, count(*) AS rows, count(DISTINCT source) AS groups FROM f GROUP BY fold")
def m29_group_folds_modulo(spark, sf):
    from pyspark.sql import Window as W

    groups = documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("fold", ((F.dense_rank().over(W.orderBy("source")) - 1) % 5).cast("long"))  # one row for each group
    return groups.groupBy("fold").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))


@query()
def m29_group_folds(spark, sf):
    rows = documents(spark, sf).groupBy("source").count().collect()
    folds = E.group_folds({r["source"]: r["count"] for r in rows}, 5)
    return spark.createDataFrame(sorted(folds.items()), "source string, fold long")


@query(f"WITH {PREDICTED}, f AS (SELECT *, (dense_rank() OVER (ORDER BY source) - 1) % 5 AS fold FROM pr) SELECT fold, round_even(avg((y = p)::INT), 6) AS accuracy, count(*) AS rows FROM f GROUP BY fold")
def m30_group_metrics(spark, sf):
    from pyspark.sql import Window as W

    p = predicted(spark, sf)
    folds = p.groupBy("source").count().select("source", ((F.dense_rank().over(W.orderBy("source")) - 1) % 5).cast("long").alias("fold"))
    return p.join(folds, "source").groupBy("fold").agg(F.bround(F.avg((F.col("y") == F.col("p")).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {PREDICTED}, f AS (SELECT y, p, source AS fold FROM pr), lb AS (SELECT DISTINCT y AS label FROM pr WHERE y IS NOT NULL),
k AS (SELECT fo.fold, label, (SELECT count(*) FROM f WHERE f.fold = fo.fold AND y = label AND p = label)::DOUBLE AS h, (SELECT count(*) FROM f WHERE f.fold = fo.fold AND y = label) AS t,
(SELECT count(*) FROM f WHERE f.fold = fo.fold AND p = label) AS s FROM (SELECT DISTINCT fold FROM f) fo, lb),
m AS (SELECT fold, round_even(avg(CASE WHEN s > 0 THEN h / s ELSE 0 END), 6) AS precision_macro, round_even(avg(CASE WHEN t > 0 THEN h / t ELSE 0 END), 6) AS recall_macro, round_even(avg(CASE WHEN t + s > 0 THEN 2 * h / (t + s) ELSE 0 END), 6) AS f1_macro FROM k GROUP BY fold),
a AS (SELECT fold, count(*) AS rows, round_even(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f GROUP BY fold) SELECT fold, rows, accuracy, precision_macro, recall_macro, f1_macro FROM a JOIN m USING (fold)""")
def m30_fold_metrics(spark, sf):
    """Each source is a group held out; the labels, a few, are those of all rows."""
    p = predicted(spark, sf).withColumnRenamed("source", "fold")
    labels = sorted(r.y for r in p.select("y").distinct().where("y is not null").collect())
    return E.fold_metrics(p, "fold", labels)


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) AS null_ids, count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) FILTER (WHERE trim(coalesce(lang, '')) = '') AS blank_targets FROM documents")
def e02_test_frame(spark, sf):
    return E.test_frame_counts(documents(spark, sf), "doc_id", "lang")


@query(f"WITH {PREDICTED} SELECT doc_id AS id, y AS target, p AS predicted_target, y = p AS correct FROM pr")
def e03_predictions(spark, sf):
    return E.predictions(predicted(spark, sf), "doc_id", "y", "p")


@query(f"WITH {PREDICTED} SELECT p AS predicted_target, count(*) AS rows FROM pr GROUP BY p")
def e04_prediction_distribution(spark, sf):
    return E.prediction_distribution(predicted(spark, sf), "p")


@query(f"WITH {BY_SOURCE} SELECT experiment AS name, f1_macro AS value, row_number() OVER (ORDER BY f1_macro DESC, experiment) AS place FROM ex QUALIFY place <= 20")
def e06_experiment_bars(spark, sf):
    return E.experiment_bars(experiments(spark, sf), "experiment", "f1_macro")


@query("""WITH x AS (SELECT least(greatest(n_chars / 40000.0, 0), 1) AS c FROM documents), b AS (SELECT least(floor(c * 10), 9)::INTEGER AS bin, count(*) AS n FROM x GROUP BY 1)
SELECT k::INTEGER AS bin, k / 10.0::DOUBLE AS low, (k + 1) / 10.0::DOUBLE AS high, coalesce(n, 0) AS rows FROM range(10) r(k) LEFT JOIN b ON b.bin = k""")
def e06_histogram(spark, sf):
    """The histogram of a value from 0 to 1 that SQL can make too: the documents' lengths as shares of 40,000 characters."""
    share = F.least(F.greatest(F.col("n_chars") / 40000.0, F.lit(0.0)), F.lit(1.0))
    return E.histogram(documents(spark, sf).select(share.alias("c")), "c")


@query("SELECT lang, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.5) AS median, quantile_cont(n_chars::DOUBLE, 0.75) AS q3, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY lang")
def e06_boxplot_data(spark, sf):
    from textgauge.operators.ranking import quantiles

    rows = documents(spark, sf).select("lang", "n_chars")
    boxes = quantiles(rows, "lang", "n_chars", [0.25, 0.5, 0.75]).select("lang", *(F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))))
    ends = rows.groupBy(F.col("lang").alias("__lang")).agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    return boxes.join(ends, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")  # one row a class


#: Coefficients that SQL can make too: how much more often a class has a word than all have it.
COEF = """tk AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), al AS (SELECT term, count(*) AS n FROM tk GROUP BY term HAVING count(*) >= 50),
cl AS (SELECT lang AS class, term, count(*) AS k FROM tk GROUP BY ALL), co AS (SELECT class, term, round_even(k / n, 8) AS coefficient FROM cl JOIN al USING (term))"""


def coefficients(spark, sf):
    tokens = documents(spark, sf).select(F.col("lang").alias("own"), T.extract(F.lower("text"), r"(?U)\w\w+").alias("values"))
    by = saved(terms.totals(tokens, "term").select(F.col("own").alias("lang"), "term", F.col("total").alias("k")), "terms-by-class")
    total = by.groupBy("term").agg(F.sum("k").alias("n")).where("n >= 50")
    return by.join(total, "term").select(F.col("lang").alias("class"), "term", F.bround(F.col("k") / F.col("n"), 8).alias("coefficient"))


@query(f"WITH {COEF}, p AS (SELECT class, 'positive' AS direction, row_number() OVER (PARTITION BY class ORDER BY coefficient DESC, term) AS rank, term, coefficient FROM co), n AS (SELECT class, 'negative' AS direction, row_number() OVER (PARTITION BY class ORDER BY coefficient, term) AS rank, term, coefficient FROM co) SELECT * FROM p WHERE rank <= 30 UNION ALL SELECT * FROM n WHERE rank <= 30")
def e08_top_terms(spark, sf):
    return E.top_terms(coefficients(spark, sf))


@query(f"""WITH {COEF}, {WORD_SQL}, ch AS (SELECT lang AS class, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM documents QUALIFY position <= 10),
ct AS (SELECT class, doc_id, position, term, round(weight * coefficient, 8) AS contribution FROM w1 JOIN ch USING (doc_id) JOIN co USING (class, term))
SELECT class, doc_id, position, row_number() OVER (PARTITION BY class, doc_id ORDER BY contribution DESC, term) AS term_rank, term, contribution FROM ct QUALIFY term_rank <= 10""")
def e09_local_terms(spark, sf):
    rows = terms.by_id(documents(spark, sf), "doc_id", "text")
    known = terms.vocabulary(rows, "word", documents(spark, sf).count(), 5000)
    classes = documents(spark, sf).select("doc_id", F.col("lang").alias("class"))
    # only the rows that are shown, a few of each class, get weights
    chosen = saved(E.shown_rows(classes, "doc_id"), "shown-rows")
    shown = rows.join(F.broadcast(chosen.select(F.col("doc_id").alias("id")).distinct()), "id", "left_semi")
    found = terms.vectors(terms.prepared(shown, "word", "id"), "word", {0: known})
    names = spark.createDataFrame(list(enumerate(t for t, _ in known)), "i int, term string")
    weights = found.select(F.col("id").alias("doc_id"), F.explode(F.arrays_zip("i", "x")).alias("v")).select("doc_id", F.col("v.i").alias("i"), F.col("v.x").alias("weight")).join(F.broadcast(names), "i").drop("i")
    return E.local_terms(weights, chosen, coefficients(spark, sf), "doc_id", chosen=True)


MARGINS = "mg AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS m FROM embeddings), ex AS (SELECT vec_id, list_transform(m, lambda x: exp(x - list_max(m))) AS e FROM mg), sm AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS s FROM ex)"


@query(f"WITH {MARGINS} SELECT vec_id, round(s[1], 9) AS a, round(s[2], 9) AS b, round(s[3], 9) AS c FROM sm")
def e11_softmax(spark, sf):
    m = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", m.alias("m")).select("vec_id", E.softmax(F.col("m")).alias("s"))
    return rows.select("vec_id", *(F.round(F.col("s")[i], 9).alias(n) for i, n in enumerate("abc")))


@query(f"WITH {MARGINS} SELECT vec_id, round_even(list_max(s), 6) AS confidence FROM sm")
def e13_confidence(spark, sf):
    m = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", m.alias("m")).select("vec_id", E.softmax(F.col("m")).alias("s"))
    return rows.select("vec_id", F.bround(F.array_max("s"), 6).alias("confidence"))


def labelled_documents(spark, sf):
    from textgauge.operators import models as M

    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("y"))
    # terms and features are costly, whatever files the texts come in
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return M.model_frame(rows, "doc_id", "text", "y")


def scored(kind: str, name: str):
    """Metrics of each of five folds under the model of the others."""

    def run(spark, sf):
        from textgauge.operators import models as M

        return spark.createDataFrame(M.cross_validate(labelled_documents(spark, sf), [kind], [name], 5)).drop("fit_seconds")

    return run


query(name="m08_logistic_regression")(scored("tfidf_word_plus_linguistic_metrics", "logistic_regression"))
query(name="m09_linear_svm")(scored("tfidf_word", "linear_svm"))
query(name="m10_random_forest")(scored("linguistic_metrics", "random_forest"))
query(name="m12_char_representation")(scored("tfidf_char", "logistic_regression"))


def searched(points):
    """The search over `points` of each classifier's space, for all representations."""

    def run(spark, sf):
        from textgauge.operators import models as M

        found = M.searches(labelled_documents(spark, sf), M.REPRESENTATIONS, {n: points(M, M.SEARCH_SPACES[n]) for n in M.CLASSIFIERS}, 5)
        out = [(f"{kind}__{name}", r["rank"], str(r["params"]), r["mean"], r["std"]) for (kind, name), rows in found.items() for r in rows]
        return spark.createDataFrame(out, "experiment string, rank long, params string, mean double, std double")

    return run


query(name="m21_grid_search")(searched(lambda M, space: M.grid(space)))
query(name="m21_random_search")(searched(lambda M, space: M.random_points(space)))


@query()
def m24_cross_validation(spark, sf):
    from textgauge.operators import models as M

    rows = M.cross_validate(labelled_documents(spark, sf), M.REPRESENTATIONS, M.CLASSIFIERS, 5)
    return E.summary(spark.createDataFrame(rows), "experiment", ["f1_macro", "f1_weighted", "accuracy"])


@query()
def m31_group_estimators(spark, sf):
    """Sources in no more than one of five folds, word vectors and a linear SVM."""
    from textgauge.operators import models as M

    _, _, groups = E.select_group_column(documents(spark, sf), "doc_id")
    found = M.group_cross_validate(labelled_documents(spark, sf), groups.withColumnRenamed("doc_id", "id"), "svm", 5)
    return spark.createDataFrame(found).drop("fit_seconds")


@query()
def m27_group_column(spark, sf):
    column, strategy, groups = E.select_group_column(documents(spark, sf), "doc_id")
    return groups.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(column).alias("column"), F.lit(strategy).alias("strategy"), "group", "rows")


@query()
def e12_predictions(spark, sf):
    from textgauge.operators import models as M

    model = M.fit(labelled_documents(spark, sf), "linguistic_metrics", "logistic_regression")
    return M.predict(model, documents(spark, sf), "doc_id", "text").select("id", "predicted", "confidence", "warning", "preview")
