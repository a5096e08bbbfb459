import random

import pytest
from pyspark.sql import functions as F

from textgauge.functions import counts, features
from textgauge.operators import segment


def texts():
    draw, marks = random.Random(7), list(" \t\n\r\x0b\x0c\x1b\x85\xa0.!?…,;:-'’—–_\"“” 0123456789ªºµß²½\x1c\x00İŸſKŁœ́")
    words = ["casa", "porém", "que", "não", "Embora", "porque", "ÁRVORE", "paradigma", "x1", "3,14", "10.5", "d'água", "co-autor", "ação", "todavia", "Às", "talvez", "ontem"]
    out = ["", " ", "...", " . ! ", "a", "- Sim.", "fim.\n", "a-b-c", "É — É.\n—À", "a\x00b", None]
    for size in [1, 3, 10, 40] * 60:
        usual = draw.random() < 0.5
        out.append("".join(draw.choice(words) if draw.random() < 0.5 else draw.choice(marks[:30] if usual else marks) for _ in range(size)))
    return out


@pytest.mark.parametrize("of", ["linguistic", "builder", "window"])
def test_counts_of_tasks_are_those_of_expressions(spark, monkeypatch, of):
    rows = spark.createDataFrame(list(enumerate(texts())), "id long, text string").unionByName(spark.sql("SELECT 999L AS id, CAST(X'61FF2E62' AS STRING) AS text"))
    measure = segment.measured if of == "window" else getattr(features, of)
    if of == "window":
        rows = rows.where("text IS NOT NULL")
    got = {r.id: r.asDict() for r in measure(rows, "text").drop("text").collect()}
    plain = features.counted(rows, "text", getattr(counts, of), **({"long_word": 7} if of == "linguistic" else {}))
    assert plain.where("__p IS NOT NULL").count() > 150 and plain.where("__p IS NULL AND __rest IS NOT NULL").count() > 20
    kind = plain.schema["__p"].dataType
    monkeypatch.setattr(features, "counted", lambda df, text, of, **_: df.withColumn("__p", F.lit(None).cast(kind)).withColumn("__rest", F.col(text)))
    want = {r.id: r.asDict() for r in measure(rows, "text").drop("text").collect()}
    assert got == want
