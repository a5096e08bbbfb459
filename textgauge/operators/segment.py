"""From raw works to candidate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textgauge.functions import counts as C
from textgauge.functions import features as X
from textgauge.functions import lexicons as lex
from textgauge.functions import text as T
from textgauge.operators.ranking import first_rows

MIN_PARAGRAPH_WORDS = 25


def cleaned_work(c: Column) -> Column:
    return T.normalize_spaces(T.remove_editorial_lines(T.strip_boilerplate(c)))


def paragraphs(df: DataFrame, key: list[str], text: str, min_words: int = MIN_PARAGRAPH_WORDS) -> DataFrame:
    """key, ordinal and paragraph: short paragraphs go before the next long one; those after the last long one are a
    paragraph if they have min_words together.

    A paragraph's group is the number of long ones from it on; one window over each work's paragraphs gives it.
    """
    parts = df.select(*key, F.posexplode(F.split(F.col(text), r"(?U)\n\s*\n")).alias("pos", "raw"))
    parts = parts.withColumn("p", T.clean_for_csv(F.col("raw"))).where("p <> ''").withColumn("n", F.size(T.words(F.col("p"))))
    after = W.partitionBy(*key).orderBy("pos").rowsBetween(W.currentRow, W.unboundedFollowing)
    parts = parts.withColumn("g", F.sum((F.col("n") >= min_words).cast("long")).over(after))
    joined = parts.groupBy(*key, "g").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("ps"), F.sum("n").alias("n"), F.min("pos").alias("pos"))
    kept = joined.where((F.col("g") > 0) | (F.col("n") >= min_words))
    text_of = F.array_join(F.transform("ps", lambda x: x.p), " ")
    return kept.select(*key, F.row_number().over(W.partitionBy(*key).orderBy("pos")).cast("long").alias("ordinal"), text_of.alias("paragraph"))


def windows(df: DataFrame, key: list[str], text: str, min_words: int = 80, target: int = 160, most: int = 220, overlap: int = 45) -> DataFrame:
    """key, offset (0-based, in tokens), number (0-based) and window, its text: every step tokens a window of `target` tokens,
    min_words at least.  Numbers count all of a text's windows, whatever filters come later."""
    step = max(20, target - overlap)
    tokens = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda t: t != "")
    df = df.select(*key, tokens.alias("__w")).withColumn("__n", F.size("__w")).where(F.col("__n") >= min_words)
    # a text's tokens stay in its row: only the windows' own come out of it
    at = F.sequence(F.lit(0), F.col("__n") - min_words, F.lit(step))
    own = F.transform(at, lambda i: F.struct(i.alias("offset"), F.array_join(F.slice("__w", i + 1, F.lit(min(target, most))), " ").alias("__chunk")))
    df, chunk = df.select(*key, F.inline(own)), F.col("__chunk")
    return df.select(*key, F.col("offset").cast("long"), F.floor(F.col("offset") / step).alias("number"), F.regexp_replace(chunk, r"(?U)\s+([,.;:!?])", "$1").alias("window"))


def measured(df: DataFrame, text: str) -> DataFrame:
    """With n, the number of normalised words, k, of sentences, alpha, the share of letters, stop, of stop words, and noise,
    whether it has an editor's words.

    Plain texts are counted in tasks.  What others have comes out of a generator: a filter on it can't be pushed below it, where
    each of its terms would find it anew.
    """

    def of(t: Column) -> Column:
        w = T.normalized_words(t)
        stops = F.size(F.filter(w, lambda x: x.isin(lex.STOPWORDS)))
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        return F.struct(F.length(t).alias("chars"), F.size(w).alias("words"), F.size(T.sentences(t)).alias("sentences"), letters.alias("letters"), stops.alias("stopwords"), T.has_editorial_noise(t).cast("int").alias("noise"))

    rows = X.counted(df, text, C.window)
    rows = rows.select("*", F.inline_outer(F.transform(F.array("__rest"), lambda t: F.struct(of(t).alias("__g")))))
    at = lambda name: F.coalesce(F.col("__p").getField(name), F.col("__g").getField(name))
    n = at("words")
    return rows.select(*df.columns, n.alias("n"), at("sentences").alias("k"), T.ratio(at("letters"), at("chars")).alias("alpha"), (at("stopwords").cast("double") / F.greatest(n, F.lit(1))).alias("stop"), (at("noise") > 0).alias("noise"))


def plausible(min_words: int = 80, max_words: int = 220, min_sentences: int = 2, min_alpha: float = 0.65, min_stopwords: float = 0.015) -> Column:
    """The builder's filters on what `measured` adds, cheap ones first."""
    n = F.col("n")
    sizes = n.between(min_words, max_words) & (F.col("k") >= min_sentences) & (F.col("alpha") >= min_alpha) & ~F.col("noise")
    return sizes & (T.length_bin(n) != "out_of_range") & (F.col("stop") >= min_stopwords)


def first_per_work(df: DataFrame, work: str, order: list[str], most: int) -> DataFrame:
    return first_rows(df, [work], order, most, "rank_in_work")


def first_by_hash(df: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """Of rows with equal hashes the first in order: an aggregation, so equal rows fold before they move."""
    rest = [c for c in df.columns if c != hash_col and c not in order]
    best = df.groupBy(hash_col).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(hash_col, "b.*").select(*df.columns)


def candidates(df: DataFrame, work: str, text: str = "window", target: int = 160) -> DataFrame:
    """id, chapter, janela_inicio and janela_fim of windows: the id names work, number and digest.

    The last two are the window's number, and that plus the words of a window.
    """
    at = F.lpad(F.col("number").cast("string"), 5, "0")
    name = F.concat_ws("_", work, at, T.stable_hash(F.col(text)))
    return df.select(name.alias("id"), F.concat(F.lit("janela_"), at).alias("chapter"), F.col("number").alias("janela_inicio"), (F.col("number") + target).alias("janela_fim"))
