"""Cleaning of texts, and counts of words in bytes."""

import random
import re

from pyspark.sql import functions as F

from textgauge.functions import counts
from textgauge.functions import text as T


def cleaned(t: str, blanks: bool = True) -> str:
    t = re.sub("\r\n?", "\n", t)
    t = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
    if blanks:
        t = re.sub(r"[ \t\f\x0b]+", " ", t)
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", t))
    return re.sub(r"^\s+|\s+\Z", "", t)


def test_clean_texts_are_looked_through_and_others_cleaned(spark):
    draw = random.Random(2)
    signs = ["a", "é", "字", " ", " ", "\n", "\n", "\r", "\t", "\x0b", "\x0c", "\x00", "\x07", "\x7f", " ", " ", " ", "\x85"]
    texts = ["".join(draw.choice(signs[: draw.choice([6, 7, 18])]) for _ in range(draw.randrange(9))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.clean_text(F.col("t")).alias("a"), T.clean_text(F.col("t"), False).alias("b"), T.clean_text(F.lit(None)).alias("none"))
    for r in rows.collect():
        assert (r.a, r.b, r.none) == (cleaned(texts[r.i]), cleaned(texts[r.i], False), ""), ascii(texts[r.i])


def test_words_in_bytes_are_those_in_signs(monkeypatch):
    """Joining marks beside others, letters that aren't a word's, capitals: the same counts with and without bytes."""
    draw = random.Random(3)
    pools = ["ab c-d'.!?\n", "aB é-'_1ª.µ ×÷ «", "aĀ’'-– .…"]
    texts = ["".join(draw.choice(pools[i % 3]) for _ in range(draw.randrange(30))) for i in range(3000)] + ["Porque, e que - não-é 'mas' d'água--x.", "___", "a-_b"]
    found = [counts.linguistic(t, 7) for t in texts]
    plain = "Rock'n'roll - sim!  Não--sei"
    assert counts.latin_sentences(plain, plain.lower())[1] == [[b"rock'n'roll", b"sim"], ["não".encode("latin-1"), b"sei"]]
    monkeypatch.setattr(counts, "latin_sentences", lambda t, low: None)
    assert found == [counts.linguistic(t, 7) for t in texts]
