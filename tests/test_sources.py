import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from textgauge import cli
from textgauge.sources import runs, tables
from textgauge.streaming import score_stream


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿id,texto,target\n1,"a ""b""\nc",alta\n2,ç,baixa\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(p)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b"\nc', "alta"), (2, "ç", "baixa")]
    for bad in (str(tmp_path / "none.csv"), str(tmp_path / "x.txt")):
        with pytest.raises(tables.DataIOError):
            tables.read_csv(spark, bad)
    tables.write_csv(spark.createDataFrame(rows), str(tmp_path / "out.csv"))
    assert tables.read_csv(spark, str(tmp_path / "out.csv")).count() == 2


def test_catalogue_works_and_addresses(spark, tmp_path):
    (tmp_path / "a.txt").write_text("corpo", encoding="utf-8")
    raw = spark.createDataFrame([(0, "a", "", "", "http://x ", "", "7"), (1, "a", "T", "", "http://x", "http://x", "7"), (2, "b", "B", "W", "", "", "")], "position int, slug string, title string, work string, url string, text_url string, source_id string")
    got = {r.slug: r for r in tables.read_works(spark, f"file://{tmp_path}", tables.read_sources(raw)).withColumn("tries", tables.candidate_addresses()).collect()}
    assert got["a"].title == got["a"].work == "T" and got["a"].found and not got["b"].found
    assert got["a"].tries[0] == "http://x" and len(got["a"].tries) == 5 and got["b"].tries == []
    assert tables.decode(b"\xef\xbb\xbfol\xc3\xa1") == "olá" and tables.decode(b"ol\xe1") == "olá"
    ok = spark.createDataFrame([(True,), (False,)], "ok boolean")
    assert tables.manifest(ok).first().status == 1 and tables.manifest(ok.where("ok")).first().status == 0 and tables.manifest(ok.where("not ok")).first().status == 2


def test_json(tmp_path):
    tables.write_json({"s": {"b", "a"}, "t": datetime(2020, 1, 1), "ç": 1}, str(tmp_path / "d/x.json"))
    assert json.loads((tmp_path / "d/x.json").read_text())["s"] == ["a", "b"]
    with pytest.raises(tables.DataIOError):
        tables.write_json([1], str(tmp_path / "y.json"))


def test_settings_and_runs(tmp_path):
    for bad in ({"train_size": 0.9}, {"n_splits": True}, {"models": ("x",)}, {"selection_metric": "loss"}, {"run_id_format": "x"}, {"fail_on_critical_leakage": 1}, {"models": ()}):
        with pytest.raises(runs.SettingsError):
            runs.Settings(**bad)
    (tmp_path / "s.json").write_text('{"n_splits": 3, "models": ["linear_svm"], "other": 1}')
    s = runs.Settings.load(str(tmp_path / "s.json"))
    assert s.n_splits == 3 and s.models == ("linear_svm",) and s.extra == {"other": 1}
    now = datetime(2024, 1, 2, tzinfo=timezone.utc)
    a, b = (runs.start_run(str(tmp_path / "runs"), s, str(tmp_path / "s.json"), now) for _ in range(2))
    assert b.name == a.name + "_02"
    runs.finish_run(b)
    assert (tmp_path / "runs/latest.txt").read_text() == b.name
    status = dict(runs.check_artifacts(str(a)))
    assert status["settings.json"] == "ok" and status["metrics/cv_summary.json"] == "missing"
    (a / "metrics/cv_summary.json").write_text("{")
    assert dict(runs.check_artifacts(str(a)))["metrics/cv_summary.json"] == "invalid"
    assert runs.fingerprint(str(tmp_path / "no")) == {"path": (tmp_path / "no").as_posix(), "exists": False}
    assert cli.main(["artifacts", "--input", str(a)]) == 1


def test_cli_features(spark, tmp_path):
    p = tmp_path / "in.parquet"
    spark.createDataFrame([("1", "Um texto. Outro.", "a")], "id string, texto string, target string").write.parquet(str(p))
    assert cli.main(["features", "--input", str(p), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first().num_palavras == 3


def test_stream(spark, tmp_path):
    spark.range(5).select(F.concat(F.lit("Olá mundo "), F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = score_stream(rows).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scored").count() == 5
