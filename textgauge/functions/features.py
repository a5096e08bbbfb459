"""Linguistic features of a text, and the complexity score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.sources.scratch import ship

from . import counts as C
from . import lexicons as lex
from . import text as T

LONG_WORD = 7
BUILDER_LONG_WORD = C.BUILDER_LONG


def linguistic(df: DataFrame, text: str, long_word: int = LONG_WORD, decimals: int = 6) -> DataFrame:
    """The 17 features beside the frame's columns; ratios are rounded half to even.  A blank text has zeros."""
    if isinstance(long_word, bool) or not isinstance(long_word, int) or long_word < 1:
        raise ValueError("long_word must be a whole number of 1 or more")
    df = counted(df, text, C.linguistic, long_word=long_word)
    # tokens, sentences and sizes once: later expressions only refer to them
    df = df.withColumn("__t", T.strip(T.coerce(F.col("__rest")))).withColumn("__w", T.feature_words(F.lower("__t"))).withColumn("__s", T.feature_sentences(F.col("__t")))
    df = df.withColumn("__l", F.filter(F.transform("__s", lambda s: F.size(T.feature_words(s))), lambda n: n > 0)).withColumn("__sorted", F.sort_array("__w"))
    df = df.withColumn("__mean", F.aggregate("__l", F.lit(0), lambda a, x: a + x) / F.greatest(F.size("__l"), F.lit(1)))
    w = F.col("__w")
    # in sorted order a token that occurs once differs from both neighbours
    alone = F.filter(F.arrays_zip(F.col("__sorted").alias("x"), F.slice("__sorted", 2, F.greatest(F.size(w), F.lit(1))).alias("y"), F.concat(F.array(F.lit(None).cast("string")), F.col("__sorted")).alias("z")), lambda p: p.x.isNotNull() & ~p.x.eqNullSafe(p.y) & ~p.x.eqNullSafe(p.z))
    mean = F.col("__mean")

    def r(x: Column) -> Column:
        return F.bround(x.cast("double"), decimals)

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(w, lambda t: t.isin(words)))

    df = either(df, {
        "chars": F.length("__t"), "words": F.size(w), "sentences": F.size("__s"), "letters": F.length(F.array_join(w, "")), "longest": F.coalesce(F.array_max("__l"), F.lit(0)), "counted": F.size("__l"),
        "squares": F.aggregate("__l", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), "distinct": F.size(F.array_distinct("__w")), "long": F.size(F.filter(w, lambda t: F.length(t) >= long_word)), "alone": F.size(alone),
        "punctuation": T.punctuation(F.col("__t")), "numbers": F.size(T.numbers(F.col("__t"))), "connectives": hits(lex.CONNECTIVES), "subordination": hits(lex.SUBORDINATION_MARKERS), "function": hits(lex.FUNCTION_WORDS),
    })
    at = lambda name: F.col("__c").getField(name)
    n = at("words")
    unique = r(T.ratio(at("distinct"), n))
    out = {
        "num_caracteres": at("chars").cast("long"),
        "num_palavras": n.cast("long"),
        "num_sentencas": at("sentences").cast("long"),
        "media_palavras_por_sentenca": r(T.ratio(n, at("sentences"))),
        "media_caracteres_por_palavra": r(T.ratio(at("letters"), n)),
        "maior_sentenca_palavras": at("longest").cast("long"),
        "variancia_tamanho_sentencas": r(F.when(at("counted") < 2, 0.0).otherwise(at("squares") / (at("counted") - 1))),
        "palavras_unicas": at("distinct").cast("long"),
        "type_token_ratio": unique,
        "diversidade_lexical": unique,
        "razao_palavras_longas": r(T.ratio(at("long"), n)),
        "razao_palavras_repetidas": r(T.ratio(n - at("alone"), n)),
        "razao_pontuacao": r(T.ratio(at("punctuation"), at("chars"))),
        "razao_numeros": r(T.ratio(at("numbers"), F.greatest(n, at("numbers")))),
        "frequencia_conectivos": r(T.ratio(at("connectives"), n)),
        "frequencia_marcadores_subordinacao": r(T.ratio(at("subordination"), n)),
        "densidade_lexical_aproximada": r(T.ratio(n - at("function"), n)),
    }
    return df.select(*[c for c in df.columns if not c.startswith("__") and c not in out], *(v.alias(k) for k, v in out.items()))


def counted(df: DataFrame, text: str, of, **parameters) -> DataFrame:
    """With __p, what `of` counts in plain texts, in tasks, and __rest, the text of other rows, which expressions measure."""
    ship(df.sparkSession)
    c = F.col(text).cast("string")
    df = df.withColumn("__p", C.udf_of(of, **parameters)(F.when(F.is_valid_utf8(c), c)))
    return df.withColumn("__rest", F.when(F.col("__p").isNull(), c))


def either(df: DataFrame, others: dict[str, Column]) -> DataFrame:
    """With __c, the counts of tasks, or else `others`."""
    of = {f.name: f.dataType for f in df.schema["__p"].dataType.fields}
    return df.withColumn("__c", F.coalesce("__p", F.struct(*(v.cast(of[k]).alias(k) for k, v in others.items()))))


BUILDER_FEATURES = [
    "num_palavras", "num_sentencas", "media_palavras_por_sentenca", "type_token_ratio", "razao_palavras_longas", "frequencia_subordinacao",
    "frequencia_marcadores_discursivos", "densidade_pontuacao", "frequencia_abstracao", "frequencia_ambiguidade", "frequencia_temporalidade",
    "dialogo_detectado",
]


def builder(df: DataFrame, text: str) -> DataFrame:
    """The 12 features of the corpus builder, unrounded, beside the frame's columns."""
    df = counted(df, text, C.builder)
    df = df.withColumn("__t", T.coerce(F.col("__rest"))).withColumn("__w", T.normalized_words(F.col("__t"))).withColumn("__s", T.sentences(F.col("__t")))
    w = F.col("__w")

    def hits(lexicon: list[str]) -> Column:
        return F.size(F.filter(w, lambda t: t.isin(T.folded(lexicon))))

    # words of a sentence are counted without folding them
    in_sentences = F.aggregate(F.transform("__s", lambda s: F.size(F.filter(T.words(s), lambda x: x.rlike(rf"[{T.LATIN}]")))), F.lit(0), lambda a, x: a + x)
    df = either(df, {
        "chars": F.length("__t"), "words": F.size(w), "sentences": F.size("__s"), "in_sentences": in_sentences, "distinct": F.size(F.array_distinct("__w")), "long": F.size(F.filter(w, lambda t: F.length(t) >= BUILDER_LONG_WORD)),
        "subordination": hits(lex.SUBORDINATION), "discourse": hits(lex.DISCOURSE), "punctuation": T.count_chars(F.col("__t"), C.BUILDER_MARKS), "abstract": hits(lex.ABSTRACT), "ambiguity": hits(lex.AMBIGUITY),
        "temporal": hits(lex.TEMPORAL), "dialogue": F.col("__t").rlike(T.DIALOGUE),
    })
    at = lambda name: F.col("__c").getField(name).cast("double")
    n = F.greatest(at("words"), F.lit(1))
    out = {
        "num_palavras": at("words"),
        "num_sentencas": at("sentences"),
        "media_palavras_por_sentenca": at("in_sentences") / F.greatest(at("sentences"), F.lit(1)),
        "type_token_ratio": at("distinct") / n,
        "razao_palavras_longas": at("long") / n,
        "frequencia_subordinacao": at("subordination") / n,
        "frequencia_marcadores_discursivos": at("discourse") / n,
        "densidade_pontuacao": at("punctuation") / F.greatest(at("chars"), F.lit(1)),
        "frequencia_abstracao": at("abstract") / n,
        "frequencia_ambiguidade": at("ambiguity") / n,
        "frequencia_temporalidade": at("temporal") / n,
        "dialogo_detectado": at("dialogue"),
    }
    return df.select(*[c for c in df.columns if not c.startswith("__") and c not in out], *(v.alias(k) for k, v in out.items()))


def complexity_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted, capped and scaled builder features, less a penalty for dialogue.  `weights` replaces weights by feature."""
    weights = weights or {}
    total = F.lit(0.0)
    for name, (weight, scale, cap) in lex.SCORE_TERMS.items():
        total = total + F.lit(float(weights.get(name, weight))) * F.least(F.col(name) / scale, F.lit(cap))
    return total - F.lit(float(weights.get("dialogo_detectado", lex.DIALOGUE_PENALTY))) * F.col("dialogo_detectado")
