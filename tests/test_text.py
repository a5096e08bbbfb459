import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textgauge.functions import features, lexicons
from textgauge.functions import text as T

TEXTS = [
    "Embora cansada, a criança observou a árvore. Depois, d'água sorriu!",
    "  Linha   um.\x00\r\n\r\n\r\n  Linha\t dois.  ",
    "pão_de œuvre 1º a-b-c 3.5 d’água... !? Fim",
    "",
    "   ",
    " x y. Z w",
    "— Olá! Que é isto? ÀÉÎÕÜ ñ ß ﬁ",
    "...!?",
]


def each(spark, f):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def strip_accents(t):
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")


L = "A-Za-zÀ-ÖØ-öø-ÿ"


def py_words(t):
    return re.findall(rf"[{L}]+(?:[-'][{L}]+)?|\d+", t)


def test_tokens_match_python(spark):
    assert each(spark, T.words) == [py_words(t) for t in TEXTS]
    assert each(spark, T.normalized_words) == [[strip_accents(w.lower()) for w in py_words(t) if re.search(f"[{L}]", w)] for t in TEXTS]
    assert each(spark, T.feature_words) == [re.findall(rf"\b[0-9{L}]+(?:[-'’][0-9{L}]+)*\b", t) for t in TEXTS]
    assert each(spark, T.numbers) == [re.findall(r"\b\d+(?:[.,]\d+)?\b", t) for t in TEXTS]
    sentences = [[p.strip() for p in re.split(r"(?<=[.!?…])\s+", t) if p.strip()] for t in TEXTS]
    assert each(spark, T.sentences) == sentences
    runs = [[x for p in re.findall(r"[^.!?…]+[.!?…]*", t) if (x := p.strip())] or ([t.strip()] if t.strip() else []) for t in TEXTS]
    assert each(spark, T.feature_sentences) == runs


def test_forms(spark):
    assert each(spark, T.clean_text)[1] == "Linha um.\n\nLinha dois."
    plain = spark.range(1).select(T.clean_text(F.lit("  Linha   com\t espaços.\n  Outra linha.  "), False).alias("x")).first().x
    assert plain == "Linha   com\t espaços.\n  Outra linha."
    assert each(spark, T.strip_accents) == [strip_accents(t) for t in TEXTS]
    assert each(spark, T.clean_for_csv) == [re.sub(r"\s+", " ", t).strip() for t in TEXTS]
    one = spark.range(1).select(T.leakage_form(F.lit("  Texto,   SIMPLES!!! ")).alias("x")).first().x
    assert one == "texto simples"
    grams = each(spark, lambda c: T.char_ngrams(c, 5))
    for t, g in zip(TEXTS, grams):
        p = f"  {t}  "
        assert sorted(g) == sorted({p} if len(p) <= 5 and t else {p[i : i + 5] for i in range(len(p) - 4)} if t else set())


def test_boilerplate_and_lines(spark):
    book = "x\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\nBody\nProduced by someone\n12 -- 34\n  kept  \n*** END OF THE PROJECT GUTENBERG EBOOK A\nz"
    got = spark.range(1).select(T.strip_boilerplate(F.lit(book)).alias("a"), T.remove_editorial_lines(T.strip_boilerplate(F.lit(book))).alias("b"), T.has_editorial_noise(F.lit("um ÍNDICE")).alias("c")).first()
    assert got.a == "\nBody\nProduced by someone\n12 -- 34\n  kept  \n" and got.b == "\nBody\nkept\n" and got.c


def test_features(spark):
    rows = features.linguistic(spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string"), "t").orderBy("id").collect()
    assert list(rows[0].asDict())[2:] == lexicons.FEATURES
    blank = rows[3].asDict()
    assert blank["num_palavras"] == blank["num_sentencas"] == 0 and all(v == 0 for k, v in blank.items() if k in lexicons.FEATURES)
    assert rows[0].num_sentencas == 2 and rows[0].num_palavras == 10
    with pytest.raises(ValueError):
        features.linguistic(spark.createDataFrame([], "t string"), "t", long_word=0)


def test_complexity_score(spark):
    row = features.builder(spark.createDataFrame([(TEXTS[6],)], "t string"), "t").withColumn("s", features.complexity_score()).first()
    want = sum(w * min(row[n] / s, c) for n, (w, s, c) in lexicons.SCORE_TERMS.items()) - 0.04 * row.dialogo_detectado
    assert row.dialogo_detectado == 1.0 and abs(row.s - want) < 1e-12


def test_leakage_text_is_the_column(spark):
    """All code points up to U+FFFF, each between letters, but for marks that the JVM's Unicode doesn't have yet or has in another class."""
    rows = [(c, f"  A{chr(c)}b {chr(c)}\n Ç-9") for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame(rows, "c int, t string").select("c", "t", T.leakage_form(F.col("t")).alias("k")).collect()
    differ = [r.c for r in got if T.leakage_text(r.t) != r.k]
    assert len(differ) < 60 and {unicodedata.category(chr(c)) for c in differ} <= {"Mn", "Mc", "Cn"}
    assert T.leakage_text(None) == ""
