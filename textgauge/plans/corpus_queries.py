"""Queries for segmentation, labelling, audit, preparation and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from textgauge.functions import features as X
from textgauge.functions import lexicons as lex
from textgauge.functions import text as T
from textgauge.operators import audit, labeling, leakage, prepare, segment
from textgauge.plans import sql as S
from textgauge.plans.registry import documents, query
from textgauge.plans.text_queries import BUILDER_SQL

PARAGRAPHS = f"""
p0 AS (SELECT doc_id, string_split_regex(text, '\\n[\\s\\v\\x{{a0}}]*\\n') AS ps FROM documents),
p1 AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS pos FROM p0),
p2 AS (SELECT doc_id, pos, {S.csv_text('raw')} AS p FROM p1),
p3 AS (SELECT *, len({S.words('p')}) AS n FROM p2 WHERE p <> ''),
p4 AS (SELECT *, sum(CASE WHEN n >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM p3),
p5 AS (SELECT doc_id, g, string_agg(p, ' ' ORDER BY pos) AS paragraph, sum(n) AS n, min(pos) AS pos FROM p4 GROUP BY doc_id, g)"""


@query(f"WITH {PARAGRAPHS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal, md5(paragraph) AS digest FROM p5 WHERE g > 0 OR n >= 25")
def g01_paragraphs(spark, sf):
    return segment.paragraphs(documents(spark, sf), ["doc_id"], "text").select("doc_id", "ordinal", F.md5("paragraph").alias("digest"))


WINDOWS = """
w0 AS (SELECT doc_id, source, list_filter(string_split_regex(text, '[\\s\\v\\x{a0}]+'), lambda t: t <> '') AS w FROM documents),
w1 AS (SELECT doc_id, source, w, unnest(range(0, len(w) - 79, 115)) AS "offset" FROM w0 WHERE len(w) >= 80),
w2 AS (SELECT doc_id, source, "offset", regexp_replace(array_to_string(w["offset" + 1:"offset" + 160], ' '), '[\\s\\v\\x{a0}]+([,.;:!?])', '\\1', 'g') AS t FROM w1)"""


def windowed(spark, sf):
    return segment.windows(documents(spark, sf), ["doc_id", "source"], "text")


@query(f'WITH {WINDOWS} SELECT doc_id, "offset", md5(t) AS digest FROM w2')
def g02_windows(spark, sf):
    return windowed(spark, sf).select("doc_id", "offset", F.md5("window").alias("digest"))


FILTERED = f"""{WINDOWS},
w3 AS (SELECT *, {S.normalized_words('t')} AS w, {S.sentences('t')} AS s FROM w2),
w4 AS (SELECT * FROM w3 WHERE len(w) BETWEEN 80 AND 220 AND len(s) >= 2 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / length(t) >= 0.65
  AND {S.share_in('w', lex.STOPWORDS)} >= 0.015 AND NOT {S.editorial('t')} AND {S.length_bin('len(w)')} <> 'out_of_range')"""


def filtered(spark, sf):
    rows = segment.measured(windowed(spark, sf), "window")
    return rows.where(segment.plausible())


@query(f'WITH {FILTERED} SELECT doc_id, "offset", len(w)::BIGINT AS n, {S.length_bin("len(w)")} AS length_bin FROM w4')
def g03_window_filters(spark, sf):
    return filtered(spark, sf).select("doc_id", "offset", F.col("n").cast("long").alias("n"), T.length_bin(F.col("n")).alias("length_bin"))


@query(f'WITH {FILTERED} SELECT source, doc_id, "offset", row_number() OVER (PARTITION BY source ORDER BY doc_id, "offset") AS rank_in_work FROM w4 QUALIFY rank_in_work <= 20')
def g04_cap_per_work(spark, sf):
    return segment.first_per_work(filtered(spark, sf).select("source", "doc_id", "offset"), "source", ["doc_id", "offset"], 20)


@query(f'WITH {FILTERED} SELECT source, doc_id, "offset", row_number() OVER (PARTITION BY source ORDER BY doc_id, "offset") AS rank_in_work FROM w4 QUALIFY rank_in_work <= 1700')
def g04_cap_per_work_whole(spark, sf):
    return segment.first_per_work(filtered(spark, sf).select("source", "doc_id", "offset"), "source", ["doc_id", "offset"], 1700)


HASHED = f"{FILTERED}, w5 AS (SELECT *, substr(sha1({S.normalize_text('t')}), 1, 16) AS hash FROM w4)"


@query(f"""WITH {HASHED} SELECT source || '_' || lpad(("offset" // 115)::VARCHAR, 5, '0') || '_' || hash AS id, 'janela_' || lpad(("offset" // 115)::VARCHAR, 5, '0') AS chapter, "offset" // 115 AS janela_inicio, "offset" // 115 + 160 AS janela_fim FROM w5""")
def g05_candidates(spark, sf):
    return segment.candidates(filtered(spark, sf), "source")


@query(f'WITH {HASHED} SELECT hash, doc_id, "offset" FROM w5 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, "offset") = 1')
def g06_first_by_hash(spark, sf):
    rows = filtered(spark, sf).select(T.stable_hash(F.col("window")).alias("hash"), "doc_id", "offset")
    return segment.first_by_hash(rows, "hash", ["doc_id", "offset"])


SCORED = f"{BUILDER_SQL}, s0 AS (SELECT doc_id, source, lang, CASE WHEN num_palavras <= 100 THEN 'short' WHEN num_palavras <= 300 THEN 'middle' ELSE 'long' END AS bin, round({S.SCORE}, 9) AS score FROM b2)"
LABELLED = f"""{SCORED}, q AS (SELECT bin, quantile_cont(score, 1.0 / 3) AS q1, quantile_cont(score, 2.0 / 3) AS q2 FROM s0 GROUP BY bin),
l0 AS (SELECT s0.*, q1, q2, CASE WHEN score <= q1 THEN 'baixa' WHEN score <= q2 THEN 'media' ELSE 'alta' END AS target FROM s0 JOIN q USING (bin)),
c0 AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY md5(doc_id::VARCHAR)) <= 12),
c1 AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) <= 30),
n0 AS (SELECT least(min(n), 5000) AS per_class FROM (SELECT count(*) AS n FROM c1 GROUP BY target)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY target, bin ORDER BY md5(doc_id::VARCHAR)) <= greatest(1, per_class // 3) AS share FROM c1, n0),
n2 AS (SELECT * FROM n1 QUALIFY row_number() OVER (PARTITION BY target ORDER BY share DESC, md5(doc_id::VARCHAR)) <= per_class)"""
ORDER = ["md5"]


def scored(spark, sf):
    n = F.col("num_palavras")
    rows = X.builder(documents(spark, sf).select("doc_id", "source", "lang", "text"), "text").drop("text")
    bin_ = F.when(n <= 100, "short").when(n <= 300, "middle").otherwise("long")
    return rows.select("doc_id", "source", "lang", bin_.alias("bin"), F.round(X.complexity_score(), 9).alias("score"), F.md5(F.col("doc_id").cast("string")).alias("md5"))


def labelled(spark, sf):
    return labeling.labelled(scored(spark, sf), "bin", "score")


@query(f"WITH {SCORED} SELECT bin, round(quantile_cont(score, 1.0 / 3), 9) AS q1, round(quantile_cont(score, 2.0 / 3), 9) AS q2 FROM s0 GROUP BY bin")
def l01_percentiles(spark, sf):
    return labeling.tertiles(scored(spark, sf), "bin", "score").select("bin", F.round("q1", 9).alias("q1"), F.round("q2", 9).alias("q2"))


@query(f"WITH {LABELLED} SELECT doc_id, target, format('score={{:.4f}}; q1={{:.4f}}; q2={{:.4f}}', score, q1, q2) AS reason FROM l0")
def l02_tertile_labels(spark, sf):
    return labelled(spark, sf).select("doc_id", "target", "reason")


def caps(spark, sf):
    return labeling.capped(labelled(spark, sf), "source", "target", ORDER, 12, 30)


@query(f"WITH {LABELLED} SELECT doc_id, source, target FROM c1")
def l03_caps(spark, sf):
    return caps(spark, sf).select("doc_id", "source", "target")


@query(f"WITH {LABELLED} SELECT doc_id, target, bin FROM n2")
def l04_balance(spark, sf):
    return labeling.balanced(caps(spark, sf), "target", "bin", ORDER).select("doc_id", "target", "bin")


@query(f"WITH {LABELLED} SELECT lpad(row_number() OVER (ORDER BY md5(doc_id::VARCHAR))::VARCHAR, 6, '0') AS id, doc_id FROM n2")
def l05_sequential_ids(spark, sf):
    return labeling.numbered(labeling.balanced(caps(spark, sf), "target", "bin", ORDER), ORDER).select("id", "doc_id")


@query(f"WITH {LABELLED} SELECT target, count(*) AS rows FROM n2 GROUP BY target")
def l06_card(spark, sf):
    return audit.class_distribution(labeling.balanced(caps(spark, sf), "target", "bin", ORDER), "target")


#: The same with the reference's caps.  Small caps, as above, are reached on small tables too.
LABELLED_WHOLE = LABELLED.replace("<= 12)", "<= 320)").replace("<= 30)", "<= 850)")


def whole_caps(spark, sf):
    return labeling.capped(labelled(spark, sf), "source", "target", ORDER)


def whole_balance(spark, sf):
    return labeling.balanced(whole_caps(spark, sf), "target", "bin", ORDER)


@query(f"WITH {LABELLED_WHOLE} SELECT doc_id, source, target FROM c1")
def l03_caps_whole(spark, sf):
    return whole_caps(spark, sf).select("doc_id", "source", "target")


@query(f"WITH {LABELLED_WHOLE} SELECT doc_id, target, bin FROM n2")
def l04_balance_whole(spark, sf):
    return whole_balance(spark, sf).select("doc_id", "target", "bin")


@query(f"WITH {LABELLED_WHOLE} SELECT lpad(row_number() OVER (ORDER BY md5(doc_id::VARCHAR))::VARCHAR, 6, '0') AS id, doc_id FROM n2")
def l05_sequential_ids_whole(spark, sf):
    from pyspark.sql import Window as W

    # bounded as in l05_sequential_ids
    return whole_balance(spark, sf).select(F.lpad(F.row_number().over(W.orderBy("md5")).cast("string"), 6, "0").alias("id"), "doc_id")


@query(f"WITH {LABELLED_WHOLE} SELECT target, count(*) AS rows FROM n2 GROUP BY target")
def l06_card_whole(spark, sf):
    return audit.class_distribution(whole_balance(spark, sf), "target")


MEASURED = f"m0 AS (SELECT *, {S.words('text')} AS w, {S.sentences('text')} AS s FROM documents), m1 AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) END AS ttr, len(w) / greatest(len(s), 1) AS per_sentence FROM m0)"


@query(f"WITH {MEASURED} SELECT lang, count(*) AS rows, round(avg(n), 4) AS words_mean, round(median(n), 4)::DOUBLE AS words_median, min(n) AS words_min, max(n) AS words_max, round(avg(per_sentence), 4) AS sentence_mean, round(avg(ttr), 4) AS ttr_mean FROM m1 GROUP BY lang")
def a01_metrics_by_class(spark, sf):
    return audit.metrics_by_class(documents(spark, sf), "text", "lang")


LANGS = ["de", "en", "es", "fr"]


@query(f"WITH b AS (SELECT * FROM (VALUES (0, '<=40'), (1, '41-80'), (2, '81-120'), (3, '121-160'), (4, '161-220'), (5, '>220')) t(position, bin)), d AS (SELECT {S.audit_bin('len(' + S.words('text') + ')')} AS bin, lang FROM documents) SELECT b.bin, position, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in LANGS) + " FROM b LEFT JOIN d ON b.bin = d.bin GROUP BY ALL")
def a02_length_crosstab(spark, sf):
    return audit.length_crosstab(documents(spark, sf), "text", "lang", LANGS)


@query(f"SELECT count(*) - count(DISTINCT text) AS exact, count(*) - count(DISTINCT {S.normalize_text('text')}) AS normalised, count(*) - count(DISTINCT doc_id) AS ids FROM documents")
def a03_duplicate_counts(spark, sf):
    return audit.duplicate_counts(documents(spark, sf), "doc_id", "text")


@query(f"WITH x AS (SELECT unnest({S.sentences('text')}) AS s FROM documents), y AS (SELECT {S.normalize_text('s')} AS sentence FROM x), z AS (SELECT sentence, count(*) AS occurrences FROM y WHERE len(string_split(sentence, ' ')) >= 4 GROUP BY sentence ORDER BY occurrences DESC, sentence LIMIT 30) SELECT * FROM z WHERE occurrences > 1")
def a04_repeated_sentences(spark, sf):
    return audit.repeated_sentences(documents(spark, sf), "text")


@query("SELECT lang, count(*) AS rows FROM documents GROUP BY lang")
def a05_class_distribution(spark, sf):
    return audit.class_distribution(documents(spark, sf), "lang")


@query(f"WITH x AS (SELECT lang, avg(len({S.words('text')})) AS m FROM documents GROUP BY lang) SELECT CASE WHEN min(m) > 0 THEN round((max(m) - min(m)) / greatest(1, min(m)), 9) END AS gap, coalesce(gap > 0.1, false) AS warns FROM x")
def a06_gap_ratio(spark, sf):
    return audit.gap_ratio(documents(spark, sf), "text", "lang")


@query(f"SELECT count(*) AS rows FROM documents WHERE regexp_matches({S.normalize_text('text')}, {S.q('|'.join(lex.AUDIT_EDITORIAL))})")
def a07_editorial_rows(spark, sf):
    return documents(spark, sf).where(T.audit_noise(F.col("text"))).agg(F.count(F.lit(1)).alias("rows"))


@query("WITH x AS (SELECT source AS value, count(*) AS rows FROM documents GROUP BY source) SELECT value, rows, round(rows / sum(rows) OVER (), 9) AS share, round(rows / sum(rows) OVER (), 9) > 0.2 AS warns FROM x ORDER BY rows DESC, value LIMIT 20")
def a08_concentration(spark, sf):
    return audit.concentration(documents(spark, sf), "source", 0.20)


@query(f"""WITH d AS (SELECT count(*) - count(DISTINCT text) AS e, count(*) - count(DISTINCT {S.normalize_text('text')}) AS k, count(*) - count(DISTINCT doc_id) AS i FROM documents)
SELECT 'rows' AS what, 'all' AS which, count(*) AS n FROM documents HAVING count(*) < 10000
UNION ALL SELECT 'class', lang, count(*) FROM documents GROUP BY lang HAVING count(*) < 3000
UNION ALL SELECT 'duplicates', 'exact', e FROM d WHERE e > 0 UNION ALL SELECT 'duplicates', 'normalised', k FROM d WHERE k > 0 UNION ALL SELECT 'duplicates', 'ids', i FROM d WHERE i > 0""")
def a09_threshold_warnings(spark, sf):
    return audit.threshold_warnings(documents(spark, sf), "doc_id", "text", "lang")


CHECKED = ["doc_id", "text", "lang"]


@query("SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}, count(*) FILTER (WHERE {S.strip(c + '::VARCHAR')} = '') AS blank_{c}" for c in CHECKED) + " FROM documents")
def p02_null_blank_counts(spark, sf):
    return prepare.null_and_blank_counts(documents(spark, sf), CHECKED)


@query("SELECT conv_id::VARCHAR AS id, count(*) AS occurrences FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def p03_duplicate_ids(spark, sf):
    from textgauge.plans.registry import table

    return prepare.duplicate_ids(table(spark, sf, "conversations"), "conv_id")


CLEAN = S.clean_text("text")


@query(f"WITH e AS (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1), k AS (SELECT count(*) AS n FROM documents GROUP BY lower({CLEAN}) HAVING count(*) > 1) SELECT (SELECT coalesce(sum(n), 0) FROM e)::BIGINT AS exact_rows, (SELECT coalesce(sum(n), 0) FROM k)::BIGINT AS normalised_rows")
def p04_involved_rows(spark, sf):
    return prepare.involved_rows(documents(spark, sf), "doc_id", "text")


@query(f"WITH x AS (SELECT doc_id::VARCHAR AS id, lower({CLEAN}) AS key FROM documents) SELECT substr(key, 1, 120) AS preview, array_to_string(list_sort(list(id))[1:10], ',') AS ids, count(*) AS occurrences FROM x GROUP BY key HAVING count(*) > 1 ORDER BY preview, sha256(key) LIMIT 10")
def p05_first_groups(spark, sf):
    """The first ten groups: a report's examples."""
    found = prepare.duplicate_examples(documents(spark, sf), "doc_id", "text")
    return found.select("preview", F.array_join("ids", ",").alias("ids"), "occurrences")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id::VARCHAR) AS place FROM documents")
def p10_sorted_ids(spark, sf):
    rows = prepare.sorted_by_id(documents(spark, sf).select("doc_id"), "doc_id")
    # places by task: each has the ids that sort before its own ahead of it
    rows = rows.select("doc_id", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("within", F.col("at") - F.shiftleft(F.col("task").cast("long"), 33) + 1)
    from textgauge.sources.scratch import saved

    rows = saved(rows, "sorted")
    from pyspark.sql import Window as W

    counts = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"))  # one row for each task
    before = F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(counts.select("task", before.alias("before"))), "task").select("doc_id", (F.col("within") + F.col("before")).alias("place"))


@query(f"WITH x AS (SELECT doc_id::VARCHAR AS id, lower({CLEAN}) AS key FROM documents) SELECT sha256(key) AS digest, count(*) AS occurrences, min(id) AS first_id, min(substr(key, 1, 120)) AS preview FROM x GROUP BY key HAVING count(*) > 1")
def p05_duplicate_examples(spark, sf):
    return prepare.text_groups(documents(spark, sf), "doc_id", "text")


@query(f"SELECT count(*) AS rows, count(*) FILTER (WHERE {CLEAN} <> text) AS changed_rows, count(*) FILTER (WHERE {CLEAN} = '') AS empty_rows FROM documents")
def p06_preprocessed(spark, sf):
    rows = prepare.prepared(documents(spark, sf), "text", "clean")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("clean") != F.col("text"), 1)).alias("changed_rows"), F.count(F.when(F.col("clean") == "", 1)).alias("empty_rows"))


SPLIT = """
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id::VARCHAR) AS k FROM documents),
c AS (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang),
z AS (SELECT a, t, ceil(round((a - t) * (0.15::DOUBLE / (1 - 0.15::DOUBLE)), 9))::BIGINT AS v FROM (SELECT sum(n)::BIGINT AS a, ceil(round(sum(n)::BIGINT * 0.15::DOUBLE, 9))::BIGINT AS t FROM c)),
t0 AS (SELECT lang, n, a, t, v, n * t // a AS lo, row_number() OVER (ORDER BY n * t % a DESC, lang NULLS LAST) AS place FROM c, z),
t1 AS (SELECT lang, n, a - t AS a, v, lo + (place <= t - (SELECT sum(lo) FROM t0))::BIGINT AS nt FROM t0),
v0 AS (SELECT lang, nt, v, (n - nt) * v // a AS lo, row_number() OVER (ORDER BY (n - nt) * v % a DESC, lang NULLS LAST) AS place FROM t1),
v1 AS (SELECT lang, nt, nt + lo + (place <= v - (SELECT sum(lo) FROM v0))::BIGINT AS nv FROM v0),
sp AS (SELECT doc_id, r.lang, CASE WHEN k <= nt THEN 'test' WHEN k <= nv THEN 'val' ELSE 'train' END AS split FROM r JOIN v1 ON r.lang IS NOT DISTINCT FROM v1.lang)"""


@query(f"WITH {SPLIT} SELECT doc_id, split FROM sp")
def p07_stratified_split(spark, sf):
    return prepare.stratified_split(documents(spark, sf).select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "split")


@query("SELECT n - t - v AS train, v AS val, t AS test FROM (SELECT n, t, ceil(round((n - t) * (0.15::DOUBLE / (1 - 0.15::DOUBLE)), 9))::BIGINT AS v FROM (SELECT count(*) AS n, ceil(round(count(*) * 0.15::DOUBLE, 9))::BIGINT AS t FROM documents))")
def p08_split_counts(spark, sf):
    train, val, test = prepare.split_counts(documents(spark, sf).count(), 0.15, 0.15)
    return spark.createDataFrame([(train, val, test)], "train long, val long, test long")


@query("WITH x AS (SELECT CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split, source || '_' || (n_chars // 500) AS c FROM documents) SELECT DISTINCT split, c FROM x WHERE split <> 'train' AND c NOT IN (SELECT c FROM x WHERE split = 'train')")
def p09_unseen_classes(spark, sf):
    cls = F.concat_ws("_", "source", F.floor(F.col("n_chars") / 500).cast("string"))
    return prepare.unseen_classes(documents(spark, sf).select(prepare.assigned_split(F.col("doc_id")).alias("split"), cls.alias("c")), "c").select("split", "c")


OVERLAP = """
pr AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) t(left_split, right_split)),
ov AS (SELECT left_split, right_split, (SELECT count(*) FROM (SELECT v FROM x WHERE split = left_split AND v <> '' INTERSECT SELECT v FROM x WHERE split = right_split)) AS shared FROM pr)"""


def overlapping(name: str, check: str, value, sql: str) -> None:
    query(f"WITH x AS (SELECT CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split, {S.strip(sql)} AS v FROM documents), {OVERLAP} SELECT '{check}' AS \"check\", left_split, right_split, shared FROM ov", name)(
        lambda spark, sf: leakage.value_overlap(documents(spark, sf).withColumn("split", prepare.assigned_split(F.col("doc_id"))), value(), check)
    )


overlapping("k01_id_overlap", "id", lambda: F.col("source"), "source")
overlapping("k01_text_overlap", "exact_text", lambda: F.col("text"), "text")
overlapping("k02_normalised_overlap", "normalised_text", lambda: T.leakage_form(F.col("text")), S.leakage_form("text"))
TURNS = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
GRAMS = f"""k0 AS (SELECT doc_id, {S.leakage_form('text')} AS k FROM {TURNS}), kc AS (SELECT doc_id, k, string_split('  ' || k || '  ', '') AS c FROM k0),
k1 AS (SELECT doc_id, length(k) AS chars, CASE WHEN k = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(c) - 3, 2)), lambda i: array_to_string(c[i:i + 4], ''))) END AS g FROM kc), k2 AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM k1)"""


@query(f"""WITH {GRAMS}, j AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS i FROM k2 a JOIN k2 b ON a.gram = b.gram AND 100 * a.n >= 91 * b.n AND 100 * b.n >= 91 * a.n WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY ALL)
SELECT left_id, right_id, round_even(i / (len(x.g) + len(y.g) - i), 6) AS similarity FROM j JOIN k1 x ON x.doc_id = left_id JOIN k1 y ON y.doc_id = right_id
WHERE round_even(i / (len(x.g) + len(y.g) - i), 6) >= 0.92 AND least(x.chars, y.chars) >= 0.7 * greatest(x.chars, y.chars)""")
def k05_near_duplicates(spark, sf):
    from textgauge.plans.registry import table

    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return leakage.near_duplicates(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "doc_id", "text")


#: A turn's split is its conversation's; 0, 1, 2 for train, val, test.
TURN_SPLIT = "CASE WHEN ({0} // 1000) % 20 < 14 THEN 0 WHEN ({0} // 1000) % 20 < 17 THEN 1 ELSE 2 END"
SPLIT_NAMES = "['train', 'val', 'test']"


def split_turns(spark, sf):
    from textgauge.plans.registry import table

    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", prepare.assigned_split(F.col("conv_id")).alias("split"))


def split_documents(spark, sf):
    return documents(spark, sf).select("doc_id", "text", prepare.assigned_split(F.col("doc_id")).alias("split"))


def near_duplicates_by_split(rows):
    return leakage.near_duplicates_across(rows, "doc_id", "text")


@query(f"""WITH {GRAMS}, j AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS i FROM k2 a JOIN k2 b ON a.gram = b.gram AND 100 * a.n >= 91 * b.n AND 100 * b.n >= 91 * a.n WHERE {TURN_SPLIT.format('a.doc_id')} < {TURN_SPLIT.format('b.doc_id')} GROUP BY ALL)
SELECT {SPLIT_NAMES}[{TURN_SPLIT.format('left_id')} + 1] AS left_split, {SPLIT_NAMES}[{TURN_SPLIT.format('right_id')} + 1] AS right_split, left_id, right_id, round_even(i / (len(x.g) + len(y.g) - i), 6) AS similarity FROM j JOIN k1 x ON x.doc_id = left_id JOIN k1 y ON y.doc_id = right_id
WHERE round_even(i / (len(x.g) + len(y.g) - i), 6) >= 0.92 AND least(x.chars, y.chars) >= 0.7 * greatest(x.chars, y.chars)""")
def k05_near_duplicates_by_split(spark, sf):
    return near_duplicates_by_split(split_turns(spark, sf))


@query()
def k05_near_duplicate_documents(spark, sf):
    """Each document's class and number of near copies in other splits; too slow in SQL on whole documents, tests hold it against brute force."""
    return leakage.near_duplicate_counts(split_documents(spark, sf), "doc_id", "text")


@query("WITH s AS (SELECT CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split, lang AS target FROM documents) SELECT split, target, count(*) AS rows FROM s GROUP BY ALL")
def k09_split_summary(spark, sf):
    return documents(spark, sf).groupBy(prepare.assigned_split(F.col("doc_id")).alias("split"), F.col("lang").alias("target")).agg(F.count(F.lit(1)).alias("rows"))


SHARED = "SELECT count(*) AS n FROM (SELECT v FROM s GROUP BY v HAVING bool_or(split = '{a}') AND bool_or(split = '{b}'))"
K10_CHECKS = " UNION ALL ".join(
    f"SELECT '{severity}' AS severity, '{check}' AS check, '{a} and {b} share ' || n || ' values' AS message FROM (WITH s AS (SELECT DISTINCT split, trim({value}) AS v FROM t WHERE trim({value}) <> '') {SHARED.format(a=a, b=b)}) WHERE n > 0"
    for check, value, severity in (("id_overlap", "id", "critical"), ("exact_text_overlap", "text", "critical"), ("normalized_text_overlap", S.leakage_form("text"), "critical"))
    for a, b in (("train", "val"), ("train", "test"), ("val", "test"))
)


@query(f"WITH t AS (SELECT conv_id::VARCHAR AS id, text, ['train', 'val', 'test'][turn % 3 + 1] AS split FROM conversations) {K10_CHECKS}")
def k10_findings(spark, sf):
    """The critical findings of the leakage run over conversations, whose ids the splits share."""
    from textgauge.plans.registry import table

    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("turn") % 3 + 1).cast("int"))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("target"), split.alias("split"))
    report = leakage.check(rows, "id", "text", "target")
    return leakage.findings_frame(spark, report).where("severity = 'critical'")


@query("WITH x AS (SELECT CASE WHEN quality = 0 THEN 'critical' ELSE 'warning' END AS severity FROM labels) SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) AS findings, count(*) FILTER (WHERE severity = 'critical') > 0 AS failed FROM x")
def k07_severity_summary(spark, sf):
    from textgauge.plans.registry import table

    return leakage.summary(table(spark, sf, "labels").select(F.when(F.col("quality") == 0, "critical").otherwise("warning").alias("severity")))
