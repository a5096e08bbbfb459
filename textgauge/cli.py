"""One command for the stages: python -m textgauge.cli STAGE --input TABLE --output PLACE."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

STAGES = [
    "features", "audit", "prepare", "leakage", "train", "search", "cross-validate", "group-cross-validate", "evaluate", "explain",
    "predict", "predict-text", "artifacts", "promote",
]


def main(argv: list[str] | None = None) -> int:
    """0 done, 1 failed, 130 interrupted; what was done is printed as JSON."""
    p = argparse.ArgumentParser(prog="textgauge")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--input", help="table, or text of predict-text, or folder of artifacts")
    p.add_argument("--output", help="table or run folder to write to; main table of promote")
    p.add_argument("--id", default="id")
    p.add_argument("--text", default="texto")
    p.add_argument("--target", default="target")
    p.add_argument("--model", help="folder of a run's models")
    p.add_argument("--kind", default="smoke", choices=["smoke", "complete"])
    p.add_argument("--representation", default="tfidf_word_plus_linguistic_metrics")
    p.add_argument("--classifier", default="logistic_regression")
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--max-iter", type=int, default=2000)
    p.add_argument("--strategy", default="grid", choices=["grid", "random"])
    p.add_argument("--allow-leakage", action="store_true")
    p.add_argument("--no-backup", action="store_true")
    a = p.parse_args(argv)
    try:
        done = run(a)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  the command's last resort
        print(json.dumps({"stage": a.stage, "status": "error", "message": str(e)[:500]}), file=sys.stderr)
        return 1
    print(json.dumps({"stage": a.stage, "status": "ok", **done}, ensure_ascii=False))
    return 0


def artifacts(a) -> dict:
    from textgauge.sources.runs import check_artifacts

    found = check_artifacts(a.input, a.kind)
    if bad := [x for x in found if x[1] != "ok"]:
        raise ValueError(f"artifacts: {bad}")
    return {"artifacts": len(found)}


def experiment(a, df) -> dict:
    """The stages that fit models; each leaves its tables in the run folder."""
    from textgauge.operators import evaluate, models
    from textgauge.sources import reports
    from textgauge.sources.tables import write_csv, write_json

    spark, at = df.sparkSession, Path(a.output)
    rows = models.model_frame(df, a.id, a.text, a.target)
    name = f"{a.representation}__{a.classifier}"
    limits = {} if a.classifier == "random_forest" else {"max_iter": a.max_iter}
    facts = {"experiment": name, "representation": a.representation, "model_name": a.classifier, "text_column": a.text}
    if a.stage == "train":
        models.save_bundle(models.fit(rows, a.representation, a.classifier, **limits), str(at / "models"), facts)
        return {"model": str(at / "models")}
    if a.stage == "search":
        model, found = models.search_and_refit(rows, a.representation, a.classifier, models.SEARCH_SPACES[a.classifier], a.folds, a.strategy)
        models.save_bundle(model, str(at / "models"), facts | {"params": found[0]["params"]})
        write_json(found[0], f"{at}/metrics/best_hyperparameters.json")
        write_csv(spark.createDataFrame(found).coalesce(1), f"{at}/metrics/hyperparameter_search_results.csv")
        reports.write_text_file(reports.sections("Search", {"Points": reports.table(list(found[0]), [list(r.values()) for r in found])}), f"{at}/reports/hyperparameter_search_report.md")
        return {"best": found[0]["params"]}
    if a.stage == "group-cross-validate":
        column, strategy, groups = evaluate.select_group_column(df, a.id)
        found = models.group_cross_validate(rows, groups.withColumnRenamed(a.id, "id"), a.classifier, a.folds, a.representation, **limits)
        facts |= {"group_column": column, "strategy": strategy}
    else:
        found = models.cross_validate(rows, [a.representation], [a.classifier], a.folds, **limits)
    results = spark.createDataFrame(found).coalesce(1)
    write_csv(results, f"{at}/metrics/cv_results.csv")
    summary = evaluate.summary(results, "experiment", ["f1_macro", "f1_weighted", "accuracy"])
    write_json(facts | summary.first().asDict(), f"{at}/metrics/cv_summary.json")
    reports.write_text_file(reports.sections("Folds", {"Summary": reports.frame(summary), "Folds": reports.frame(results)}), f"{at}/reports/cv_report.md")
    return {"folds": len(found)}


def run(a) -> dict:
    if a.stage == "artifacts":
        return artifacts(a)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from textgauge.functions import features
    from textgauge.operators import audit, leakage, models, prepare
    from textgauge.sources import reports
    from textgauge.sources.tables import promote, read_csv, write_json

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.stage == "promote":
        return {"backup": promote(spark, a.input, a.output, not a.no_backup)}
    if a.stage == "explain":
        found = models.explanation(models.load_bundle(a.model)[0], spark)
        write_json(found, f"{a.output}/explainability/top_terms.json")
        return {"explanation": found["status"]}
    if a.stage == "predict-text":
        result = models.predict_text(models.load_bundle(a.model)[0], spark, a.input)
        return {"result": result, "text": models.console_text(result)}
    df = read_csv(spark, a.input) if a.input.lower().endswith(".csv") else spark.read.parquet(a.input)
    if a.stage in ("train", "search", "cross-validate", "group-cross-validate"):
        return experiment(a, df)
    if a.stage == "evaluate":
        return {"metrics": models.evaluate_model(df, a.output, a.id, a.text, a.target)}
    if a.stage == "leakage":
        report = leakage.check(df, a.id, a.text, a.target)
        write_json(report, f"{a.output}/metrics/leakage_report.json")
        reports.write_text_file(reports.leakage_report(report), f"{a.output}/reports/leakage_report.md")
        leakage.gate({"critical": report["summary"]["critical_findings"]}, not a.allow_leakage)
        return {"summary": report["summary"]}
    if a.stage == "features":
        out = features.linguistic(df.select(F.col(a.id).alias("id"), F.col(a.target).alias("target"), F.col(a.text).alias("text")), "text").drop("text")
    elif a.stage == "audit":
        out = audit.metrics_by_class(df, a.text, a.target)
        duplicates = audit.duplicate_counts(df, a.id, a.text)
        reports.write_text_file(reports.audit_report({"Classes": out, "Duplicates": duplicates}), f"{a.output}.md")
        reports.write_text_file(reports.dataset_card(Path(a.input).stem, audit.class_distribution(df, a.target)), f"{a.output}.card.md")
    elif a.stage == "prepare":
        warnings = prepare.validate(df, a.id, a.text, a.target)
        out, more = prepare.split_dataset(prepare.prepared(df, a.text), a.id, a.target)
        write_json(prepare.preparation_report(df, out, a.id, a.text, a.target, warnings + more), f"{a.output}.report.json")
        out = prepare.sorted_by_id(out, a.id)
    else:
        out = models.predict(models.load_bundle(a.model)[0], df, a.id, a.text)
    out.write.mode("overwrite").parquet(a.output)
    return {"output": a.output}


if __name__ == "__main__":
    sys.exit(main())
