"""Queries for text functions and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from textgauge.functions import features as X
from textgauge.functions import lexicons as lex
from textgauge.functions import text as T
from textgauge.plans import sql as S
from textgauge.plans.registry import documents, query, table


def listed(name: str, column, sql: str) -> None:
    """A query of an array's size and digest for each document."""
    query(f"WITH x AS (SELECT doc_id, {sql} AS a FROM documents) SELECT doc_id, len(a)::BIGINT AS n, md5(array_to_string(a, '|')) AS digest FROM x", name)(
        lambda spark, sf: documents(spark, sf).select("doc_id", column(F.col("text")).alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.md5(F.array_join("a", "|")).alias("digest"))
    )


def digested(name: str, column, sql: str) -> None:
    """A query of a text's length and digest for each document."""
    query(f"WITH x AS (SELECT doc_id, {sql} AS a FROM documents) SELECT doc_id, length(a)::BIGINT AS n, md5(a) AS digest FROM x", name)(
        lambda spark, sf: documents(spark, sf).select("doc_id", column(F.col("text")).alias("a")).select("doc_id", F.length("a").cast("long").alias("n"), F.md5("a").alias("digest"))
    )


def valued(name: str, column, sql: str) -> None:
    """A query of one value for each document."""
    query(f"SELECT doc_id, {sql} AS value FROM documents", name)(lambda spark, sf: documents(spark, sf).select("doc_id", column(F.col("text")).alias("value")))


listed("t01_builder_words", T.words, S.words("text"))
listed("t02_normalized_words", T.normalized_words, S.normalized_words("text"))
listed("t03_builder_sentences", T.sentences, S.sentences("text"))
listed("t04_feature_words", T.feature_words, S.feature_words("text"))
listed("t05_feature_sentences", T.feature_sentences, S.feature_sentences("text"))
valued("t06_numbers", lambda c: F.size(T.numbers(c)).cast("long"), r"len(regexp_extract_all(regexp_replace(text, '[\p{L}\p{N}_]*[\p{L}_][\p{L}\p{N}_]*', ' ', 'g'), '\d+(?:[.,]\d+)?'))")
valued("t07_punctuation", lambda c: T.punctuation(c).cast("long"), S.chars("text", lex.PUNCTUATION))
digested("t08_strip_accents", T.strip_accents, "strip_accents(text)")
digested("t09_normalize_spaces", T.normalize_spaces, S.strip(r"regexp_replace(regexp_replace(translate(text, chr(65279) || chr(13), ' ' || chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"))
_FRAMED = "('head' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK X ***' || text || '*** END OF THE PROJECT GUTENBERG EBOOK' || chr(10) || 'tail')"
digested(
    "t10_strip_boilerplate",
    lambda c: T.strip_boilerplate(F.concat(F.lit("head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***"), c, F.lit("*** END OF THE PROJECT GUTENBERG EBOOK\ntail"))),
    rf"regexp_replace(regexp_replace({_FRAMED}, '(?is)^.*?\*\*\* START OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*\*\*', ''), '(?is)\*\*\* END OF (?:THE )?PROJECT GUTENBERG EBOOK.*', '')",
)
digested(
    "t11_editorial_lines",
    T.remove_editorial_lines,
    f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: {S.strip('s')}), lambda s: s = '' OR NOT ({S.editorial('s')} OR regexp_full_match(s, '[^\\p{{L}}]{{1,20}}'))), chr(10))",
)
valued("t12_editorial_noise", T.has_editorial_noise, S.editorial("text"))
digested("t13_audit_normalize", T.normalize_text, S.normalize_text("text"))
valued("t14_stable_hash", T.stable_hash, f"substr(sha1({S.normalize_text('text')}), 1, 16)")
digested("t15_clean_for_csv", T.clean_for_csv, S.csv_text("text"))
digested("t16_clean_text", T.clean_text, S.clean_text("text"))
digested("t17_leakage_form", T.leakage_form, S.leakage_form("text"))
valued("t18_char_ngrams", lambda c: F.size(T.char_ngrams(T.leakage_form(c))).cast("long"), f"len({S.char_ngrams('k')}) AS value FROM (SELECT doc_id, {S.leakage_form('text')} AS k FROM documents) --")
valued("t19_alpha_ratio", T.alpha_ratio, S.over(r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))", "length(text)"))
valued("t20_stopword_ratio", lambda c: T.stopword_ratio(T.normalized_words(c)), S.share_in(S.normalized_words("text"), lex.STOPWORDS))
valued("t21_length_bin", lambda c: T.length_bin(F.size(T.words(c))), S.length_bin(f"len({S.words('text')})"))
valued("t22_audit_length_bin", lambda c: T.audit_length_bin(F.size(T.words(c))), S.audit_bin(f"len({S.words('text')})"))


@query(f"SELECT DISTINCT source, {S.csv_text(S.q('  ') + ' || upper(source) || ' + S.q('  X '))} AS raw, lower({S.csv_text(S.q('  ') + ' || upper(source) || ' + S.q('  X '))}) AS grp FROM documents")
def t23_group_value(spark, sf):
    raw = F.concat(F.lit("  "), F.upper("source"), F.lit("  X "))
    return documents(spark, sf).select("source").distinct().select("source", T.clean_for_csv(raw).alias("raw"), T.group_value(raw).alias("grp"))


@query(
    f"WITH x AS (SELECT doc_id, {S.normalized_words('text')} AS w FROM documents) SELECT doc_id, "
    + ", ".join(f"{S.share_in('w', S.folded(v))} AS {k}" for k, v in (("subordination", lex.SUBORDINATION), ("discourse", lex.DISCOURSE), ("abstract", lex.ABSTRACT), ("ambiguity", lex.AMBIGUITY), ("temporal", lex.TEMPORAL)))
    + " FROM x"
)
def t24_lexicon_shares(spark, sf):
    lists = {"subordination": lex.SUBORDINATION, "discourse": lex.DISCOURSE, "abstract": lex.ABSTRACT, "ambiguity": lex.AMBIGUITY, "temporal": lex.TEMPORAL}
    return documents(spark, sf).select("doc_id", T.normalized_words(F.col("text")).alias("w")).select("doc_id", *(T.share_in(F.col("w"), T.folded(v)).alias(k) for k, v in lists.items()))


valued("t25_preview", lambda c: T.preview(c, 180), "substr(text, 1, 180)")
valued("t26_blank", T.is_blank, f"{S.strip('coalesce(text, ' + S.q('') + ')')} = ''")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint, strlen(coalesce(text, ''))::BIGINT AS size_bytes FROM documents")
def s14_fingerprint(spark, sf):
    c = T.coerce(F.col("text"))
    return documents(spark, sf).select("doc_id", F.sha2(c, 256).alias("fingerprint"), F.octet_length(c).cast("long").alias("size_bytes"))


@query(f"WITH {S.FEATURE_INPUT} SELECT doc_id AS id, {S.linguistic()} FROM f2")
def f_linguistic_features(spark, sf):
    return X.linguistic(documents(spark, sf).select(F.col("doc_id").alias("id"), "text"), "text").drop("text")


@query(f"WITH {S.FEATURE_INPUT}, g AS (SELECT lang, {S.linguistic()} FROM f2) SELECT lang, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in lex.FEATURES) + " FROM g GROUP BY lang")
def feature_means_by_lang(spark, sf):
    rows = X.linguistic(documents(spark, sf).select("lang", "text"), "text")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in lex.FEATURES))


BUILDER_SQL = f"b0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents), b1 AS (SELECT *, {S.normalized_words('t')} AS w, {S.sentences('t')} AS s FROM b0), b2 AS (SELECT doc_id, source, lang, {S.BUILDER} FROM b1)"


@query(f"WITH {BUILDER_SQL} SELECT doc_id, {', '.join(X.BUILDER_FEATURES)} FROM b2")
def b_builder_features(spark, sf):
    return X.builder(documents(spark, sf).select("doc_id", "text"), "text").drop("text")


@query(f"WITH {BUILDER_SQL} SELECT doc_id, round({S.SCORE}, 9) AS score FROM b2")
def f18_complexity_score(spark, sf):
    return X.builder(documents(spark, sf).select("doc_id", "text"), "text").select("doc_id", F.round(X.complexity_score(), 9).alias("score"))


@query(f"WITH {S.FEATURE_INPUT}, g AS (SELECT CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split, lang AS target, {S.linguistic()} FROM f2) SELECT split, target, count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}" for c in lex.FEATURES) + " FROM g GROUP BY ALL")
def f20_feature_metadata(spark, sf):
    from textgauge.operators.prepare import assigned_split

    rows = X.linguistic(documents(spark, sf).select(assigned_split(F.col("doc_id")).alias("split"), F.col("lang").alias("target"), "text"), "text")
    return rows.groupBy("split", "target").agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}") for c in lex.FEATURES))
