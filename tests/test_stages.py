import io
import json
import logging
import random

import pytest
from pyspark.sql import functions as F

from textgauge import cli
from textgauge.operators import evaluate, leakage, models, prepare, ranking
from textgauge.sources import reports, runs, tables


def corpus(n=24):
    draw = random.Random(11)
    words = {"baixa": ["casa", "gato", "sol", "rio"], "alta": ["epistemologia", "hermenêutica", "todavia", "paradigma"]}
    rows = []
    for i in range(n):
        y = ["baixa", "alta"][i % 2]
        text = " ".join(draw.choice(words[y]) for _ in range(25)) + f". Texto número {i} termina aqui."
        rows.append((f"d{i:02}", text, y, f"obra{i % 6}"))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame(corpus(), "id string, texto string, target string, obra string").cache()
    rows = models.model_frame(df, "id", "texto", "target").cache()
    return df, rows, models.fit(rows, "tfidf_word", "logistic_regression", max_iter=10)


def test_quantiles_are_exact(spark):
    import numpy as np

    draw = random.Random(2)
    values = {"a": [draw.random() for _ in range(5000)], "b": [float(draw.randrange(3)) for _ in range(400)], "c": [7.5], None: [1.0, 2.0, 1e300, -1e300]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None)]
    got = {r.g: r.q for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.0, 1 / 3, 2 / 3, 1.0]).collect()}
    for g, vs in values.items():
        assert np.allclose(got[g], np.quantile(vs, [0, 1 / 3, 2 / 3, 1]), rtol=1e-12)
    assert ranking.quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0


def test_ranks_match_a_plain_window(spark):
    import hashlib

    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], i) for i in range(700)] + [(5, "b", 900)]
    got = ranking.ranked(spark.createDataFrame(rows, "id int, y string, own int"), "y", F.md5(F.col("id").cast("string")), F.col("own")).collect()
    by = {}
    for i, y, own in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[2])):
        by.setdefault(y, []).append(own)
    assert {r.own: (r["__rank"], r["__size"]) for r in got} == {own: (k + 1, len(v)) for v in by.values() for k, own in enumerate(v)}


def test_split_falls_back(spark):
    rows = spark.createDataFrame([(i, "rare" if i == 3 else "usual") for i in range(40)], "id int, y string")
    got, warnings = prepare.split_dataset(rows, "id", "y")
    assert len(warnings) == 1 and "smallest class has 1" in warnings[0]
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == dict(zip(("train", "val", "test"), prepare.split_counts(40, 0.15, 0.15)))
    assert prepare.split_dataset(rows.withColumn("y", F.lit("x")), "id", "y")[1] == []
    assert [r.id for r in prepare.sorted_by_id(rows.where("id in (2, 10, 1)"), "id").collect()] == [1, 10, 2]


def test_duplicate_examples_and_report(spark):
    rows = [(i, "same  text" if i < 14 else f"text {i}", "ab"[i % 2]) for i in range(40)] + [(50, "Other Pair", "a"), (51, "other pair", "b"), (52, None, "a")]
    df = spark.createDataFrame(rows, "id int, t string, y string")
    got = prepare.duplicate_examples(df, "id", "t").collect()
    assert [(r.preview, r.occurrences) for r in got] == [("other pair", 2), ("same text", 14)]
    assert got[0].ids == ["50", "51"] and got[1].ids == sorted(map(str, range(14)))[:10]
    split, warnings = prepare.split_dataset(df, "id", "y")
    report = prepare.preparation_report(df, split, "id", "t", "y", warnings)
    assert report["rows"] == 43 and report["counts"]["null_t"] == 1 and sum(sum(x.values()) for x in report["splits"].values()) == 43
    assert report["duplicates"]["normalised_rows"] == 16 and len(report["examples"]) == 2 and not report["unseen"]


def test_leakage_run(spark, tmp_path):
    a = "a criança observou a árvore antiga perto do rio durante a tarde"
    rows = [("1", a, "baixa", "train"), ("2", "texto único número um aqui", "alta", "train"), ("3", a.upper(), "baixa", "val"), ("1", "outro texto qualquer sem par", "alta", "test"), ("5", "texto único número um aqui", "alta", "val"), ("6", None, "alta", "test")]
    df = spark.createDataFrame(rows, "id string, texto string, target string, split string").withColumn("nível", F.lit(1))
    report = leakage.check(df, "id", "texto", "target")
    kinds = [(f["severity"], f["check"]) for f in report["findings"]]
    assert kinds == [("warning", "target_like_columns"), ("critical", "id_overlap"), ("critical", "exact_text_overlap"), ("critical", "normalized_text_overlap"), ("warning", "near_duplicate_texts")]
    near = report["findings"][-1]["details"]
    assert near["pairs"] == 2 and {(r["left_id"], r["right_id"]) for r in near["records"]} == {("1", "3"), ("2", "5")}
    assert all(r["left_target"] == r["right_target"] and r["left_preview"] for r in near["records"])
    assert report["summary"] == {"total_findings": 5, "info_findings": 0, "warning_findings": 2, "critical_findings": 3, "status": "failed"}
    assert leakage.findings_frame(spark, report).count() == 5 and "failed" in reports.leakage_report(report)
    off = leakage.check(df, "id", "texto", "target", enabled=False)
    assert off["summary"]["status"] == "disabled" and off["summary"]["info_findings"] == 1 and off["findings"][0]["severity"] == "info"
    clean = leakage.check(df.where("id in ('2', '6')").drop("nível"), "id", "texto", "target")
    assert clean["summary"]["status"] == "passed" and "No leakage" in reports.leakage_report(clean)
    frame = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [r[0] for r in frame.select(leakage.jaccard(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0]


def test_param_grid_and_search(trained):
    assert models.param_grid({"classifier__C": [1, 2], "max_iter": 5, "bootstrap": [1]}, "logistic_regression") == {"c": [1, 2], "max_iter": [5]}
    with pytest.raises(models.SearchError, match="n_estimators"):
        models.param_grid({"n_estimators": [3]}, "linear_svm")
    assert models.param_grid({}, "linear_svm") == {} and models.param_grid({"n_estimators": [3]}, "random_forest") == {"trees": [3]}
    _, rows, _ = trained
    model, found = models.search_and_refit(rows, "linguistic_metrics", "random_forest", {"trees": [2], "depth": [1, 2], "nothing": [1]}, 2)
    assert [r["rank"] for r in found][0] == 1 and len(found) == 2 and set(json.loads(found[0]["params"])) == {"trees", "depth"}
    assert model.transform(rows).count() == 24
    tied = models.search_rows([{"params": {}, "mean": m, "std": 0.0} for m in (0.9, 0.9, 0.5)], "k", "n")
    assert [r["rank"] for r in tied] == [1, 1, 3]
    with pytest.raises(models.SearchError):
        models.search_and_refit(rows, "linguistic_metrics", "random_forest", {"trees": [3]}, 2, "guess")
    with pytest.raises(ValueError, match="empty"):
        models.search(rows, "linguistic_metrics", "random_forest", [], 2)


def test_folds_and_groups(spark, trained):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, y string")
    got = evaluate.repeated_folds(rows, "id", "y", 5, 3)
    assert {(r.repeat, r.fold): r["count"] for r in got.groupBy("repeat", "fold").count().collect()} == {(r, k): 4 for r in range(3) for k in range(5)}
    by = {}
    for r in got.collect():
        by.setdefault(r.repeat, {})[r.id] = r.fold
    assert by[0] != by[1] != by[2]
    assert evaluate.effective_splits(5, 3) == 3
    for bad in ((1, 5), (5, 1)):
        with pytest.raises(ValueError):
            evaluate.effective_splits(*bad)
    df, frame, _ = trained
    column, strategy, groups = evaluate.select_group_column(df, "id")
    found = models.group_cross_validate(frame, groups, "lr", 2, max_iter=5)
    assert (column, strategy, len(found)) == ("obra", "preferred_column", 2) and all(r["model_name"] == "logistic_regression" for r in found)
    with pytest.raises(ValueError, match="unknown"):
        models.group_cross_validate(frame, groups, "forest")


def test_result_tables(spark):
    rows = [("a", 0.5, 0.6, 0.7, 0), ("b", 0.9, 0.1, 0.1, 1), ("c", 0.5, 0.7, 0.1, 2), ("d", None, 0.9, 0.9, 3), ("e", 0.5, 0.6, 0.7, 4)]
    df = spark.createDataFrame(rows, "experiment string, f1_macro double, f1_weighted double, accuracy double, position int")
    assert [r.experiment for r in evaluate.results_table(df, "f1_macro").orderBy("place").collect()] == ["b", "c", "a", "e", "d"]
    assert [(r.name, r.place) for r in evaluate.experiment_bars(df, "experiment", "f1_macro", 2).orderBy("place").collect()] == [("b", 1), ("a", 2)]
    bins = evaluate.histogram(spark.createDataFrame([(0.0,), (0.05,), (0.95,), (1.0,), (None,)], "c double"), "c").orderBy("bin").collect()
    assert [r.rows for r in bins] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    folds = spark.createDataFrame([("e", 0.5), ("e", 1.0), ("f", 0.1)], "experiment string, f1_macro double")
    assert [(r.name, r.value, r.spread) for r in evaluate.fold_bars(evaluate.summary(folds, "experiment", ["f1_macro"]), "experiment", "f1_macro").orderBy("place").collect()] == [("e", 0.75, 0.25), ("f", 0.1, 0.0)]
    with pytest.raises(evaluate.TestFrameError, match="1 null ids; 1 repeated ids; 2 blank targets"):
        evaluate.check_test_frame(spark.createDataFrame([(1, "a"), (1, " "), (None, None)], "id int, y string"), "id", "y")
    with pytest.raises(evaluate.TestFrameError, match="no rows"):
        evaluate.check_test_frame(spark.createDataFrame([], "id int, y string"), "id", "y")
    with pytest.raises(evaluate.TestFrameError, match="missing columns: z"):
        evaluate.check_test_frame(df, "experiment", "z")


def test_explanations(spark, trained):
    _, rows, model = trained
    found = models.explanation(model, spark, 5)
    assert found["status"] == "ok" and {t["class"] for t in found["terms"]} == {"alta", "baixa"}
    top = {(t["class"], t["direction"]): t["term"] for t in found["terms"] if t["rank"] == 1}
    assert top["baixa", "positive"].split()[0] in ("casa", "gato", "sol", "rio")
    svm = models.fit(rows, "tfidf_word", "linear_svm", max_iter=5)
    by = dict(models.class_coefficients(svm))
    assert set(by) == {"alta", "baixa"} and len(by["alta"]) == len(models.vocabulary_of(svm))
    forest = models.fit(rows, "linguistic_metrics", "random_forest", trees=2, depth=2)
    assert models.explanation(forest, spark)["status"] == "unsupported"


def test_predict_text(spark, trained):
    _, rows, model = trained
    got = models.predict_text(model, spark, "A casa e o gato no sol do rio.")
    assert got["predicted"] == "baixa" and got["confidence"] == got["scores"]["baixa"] and got["warnings"] in ([], ["low confidence"])
    assert "Predicted: baixa" in models.console_text(got) and "num_palavras: 9" in models.console_text(got)
    svm = models.fit(rows, "tfidf_word", "linear_svm", max_iter=5)
    assert any("calibrated" in w for w in models.predict_text(svm, spark, "casa")["warnings"])
    with pytest.raises(models.InferenceError):
        models.predict_text(model, spark, " \n ")


def test_evaluate_model(spark, trained, tmp_path):
    df, _, model = trained
    run = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        models.load_bundle(f"{run}/models")
    facts = {"experiment": "tfidf_word__logistic_regression", "representation": "tfidf_word", "model_name": "logistic_regression"}
    models.save_bundle(model, f"{run}/models", facts)
    metrics = models.evaluate_model(df, run, "id", "texto", "target")
    assert metrics["accuracy"] == 1.0 and metrics["rows"] == 24
    stored = json.loads((tmp_path / "run/metrics/final_metrics.json").read_text())
    assert stored["f1_macro"] == 1.0 and json.loads((tmp_path / "run/metrics/classification_report.json").read_text())["alta"]["support"] == 12
    written = spark.read.csv(f"{run}/metrics/test_predictions.csv", header=True)
    assert written.count() == 24 and written.columns == ["id", "target", "predicted_target", "correct"]
    assert sum(int(r.rows) for r in spark.read.csv(f"{run}/figures/confidence_histogram.csv", header=True).collect()) == 24
    assert "Extended" in (tmp_path / "run/reports/final_report_extended.md").read_text()
    with pytest.raises(evaluate.TestFrameError):
        models.evaluate_model(df.limit(0), run, "id", "texto", "target")
    (tmp_path / "run/models/best_experiment.json").write_text("[]")
    with pytest.raises(ValueError):
        models.load_bundle(f"{run}/models")


def test_commands(spark, trained, tmp_path, capsys):
    df, *_ = trained
    table, run = str(tmp_path / "t"), str(tmp_path / "run")
    df.write.parquet(table)
    base = ["--output", run, "--representation", "tfidf_word", "--max-iter", "5", "--folds", "2"]
    assert cli.main(["train", "--input", table, *base]) == 0
    assert cli.main(["evaluate", "--input", table, *base]) == 0
    assert cli.main(["explain", "--model", f"{run}/models", "--output", run]) == 0
    assert cli.main(["predict-text", "--model", f"{run}/models", "--input", "casa e gato"]) == 0
    assert cli.main(["predict", "--input", table, "--model", f"{run}/models", "--output", f"{run}/predicted"]) == 0
    assert cli.main(["cross-validate", "--input", table, *base]) == 0
    assert cli.main(["prepare", "--input", table, "--output", f"{run}/split"]) == 0
    assert cli.main(["audit", "--input", table, "--output", f"{run}/audit"]) == 0
    assert cli.main(["leakage", "--input", f"{run}/split", "--output", run, "--allow-leakage"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["status"] for x in lines] == ["ok"] * 9 and lines[3]["result"]["predicted"] == "baixa"
    assert spark.read.parquet(f"{run}/predicted").count() == 24 and (tmp_path / "run/reports/leakage_report.md").exists()
    assert cli.main(["predict-text", "--model", str(tmp_path), "--input", "x"]) == 1
    assert "no model" in json.loads(capsys.readouterr().err)["message"]


def test_downloads(tmp_path):
    calls, slept = [], []

    def fetch(url):
        calls.append(url)
        if "bad" in url or (url == "late" and calls.count("late") < 2):
            raise OSError("gone")
        return b" " if url == "blank" else "olá".encode("latin-1")

    text, log = tables.download_with_retries(["bad", "blank", "late"], fetch, 2, 0.5, slept.append)
    assert text == "olá" and [(x["url"], x["attempt"], x["ok"]) for x in log] == [("bad", 1, False), ("bad", 2, False), ("blank", 1, False), ("blank", 2, False), ("late", 1, False), ("late", 2, True)]
    assert slept == [0.5] * 5 and log[0]["error"] == "OSError: gone"
    got = tables.download_all([{"slug": "a", "urls": ["x"]}, {"slug": "b", "urls": ["bad"]}], str(tmp_path), fetch, sleep=slept.append)
    assert (got["status"], got["fetched"], got["rows"][1]["ok"]) == (1, 1, False) and (tmp_path / "a.txt").read_text() == "olá"
    status = lambda sources, **o: tables.download_all(sources, str(tmp_path), fetch, sleep=slept.append, **o)["status"]
    assert status([{"slug": "b", "urls": ["bad"]}]) == 2 and status([{"slug": "a", "urls": ["x"]}]) == 0
    assert status([{"slug": "a", "urls": ["x"]}, {"slug": "b", "urls": []}], partial=True) == 0


def test_promote(spark, tmp_path):
    from datetime import datetime

    new, main = f"file://{tmp_path}/new", f"file://{tmp_path}/main"
    spark.range(3).write.parquet(new)
    assert tables.promote(spark, new, main) is None and spark.read.parquet(main).count() == 3
    spark.range(5).write.mode("overwrite").parquet(new)
    kept = tables.promote(spark, new, main, now=datetime(2024, 1, 2))
    assert kept.endswith("main.20240102_000000.bak") and spark.read.parquet(kept).count() == 3 and spark.read.parquet(main).count() == 5
    assert tables.promote(spark, new, main, backup=False) is None and spark.read.parquet(new).count() == 5
    for a, b in ((main, main), (f"{new}-none", main)):
        with pytest.raises(tables.DataIOError):
            tables.promote(spark, a, b)


def test_reports_logs_and_paths(spark, tmp_path):
    at = reports.write_text_file("# x\n\n\n", str(tmp_path / "a/b.md"))
    assert at.read_text() == "# x\n" and [p.name for p in at.parent.iterdir()] == ["b.md"]
    for bad in ("", " \n", None):
        with pytest.raises(tables.DataIOError):
            reports.write_text_file(bad, str(tmp_path / "c.md"))
    classes = spark.createDataFrame([("a|b", 3, 0.5)], "y string, n int, s double")
    assert r"| a\|b | 3 | 0.5 |" in reports.dataset_card("x", classes, notes=["n"]) and "No warnings" in reports.audit_report({"C": classes})
    assert "More than 2 rows" in reports.frame(spark.range(5), 2)
    stream = io.StringIO()
    runs.start_logging("info", "json", stream).info("done %s", 3)
    line = json.loads(stream.getvalue())
    assert (line["level"], line["message"], line["logger"]) == ("INFO", "done 3", "textgauge") and line["time"].endswith("+00:00")
    stream = io.StringIO()
    runs.start_logging("WARNING", "text", stream).info("hidden")
    logging.getLogger("textgauge").warning("seen")
    assert "WARNING textgauge: seen" in stream.getvalue() and "hidden" not in stream.getvalue()
    with pytest.raises(runs.SettingsError):
        runs.start_logging(kind="xml")
    assert (runs.project_root(str(tmp_path.parent)) if (tmp_path.parent / "bench.py").exists() else True)
    (tmp_path / "bench.py").write_text("")
    (tmp_path / "x/y").mkdir(parents=True)
    assert runs.project_root(str(tmp_path / "x/y")) == tmp_path.resolve()
    assert runs.relative_path(str(tmp_path / "x/y"), str(tmp_path)) == "x/y" and runs.relative_path("/etc", str(tmp_path)).startswith("/")
    found = runs.environment(str(tmp_path))
    assert found["packages"]["pyspark"] and found["commit"] is None
