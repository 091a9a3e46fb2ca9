"""Reading, snapshots, result folders, cache round trip."""

import json

import pytest
from pyspark.sql import functions as F

from colsieve import schemas
from colsieve.operators import checks, inject, scorer, semantic
from colsieve.sources import results, snapshots, tables


def _frame(spark, n=40):
    return spark.range(n).select(
        *[((F.col("id") * (7 + i)) % 11).cast("double").alias(f"n{i}") for i in range(4)],
        F.when(F.col("id") % 3 == 0, "low").otherwise("high").alias("level"), (F.col("id") % 2).cast("int").alias("target"),
    )


SPEC = snapshots.TableSpec("tiny", "target", descriptions={"n0": "first number"}, drop=("n3",))


def test_snapshot_stages(spark, tmp_path):
    paths = snapshots.prepare(spark, _frame(spark), SPEC, str(tmp_path))
    injected = spark.read.parquet(paths["injected"])
    assert injected.columns == ["row_id", "n0", "n1", "n2", "level", *inject.leak_names(), "target"]
    assert "n3" in spark.read.parquet(paths["raw"]).columns and "n3" not in spark.read.parquet(paths["processed"]).columns
    document = json.loads(spark.read.text(paths["metadata"]).first()[0])
    assert document["leakage_columns"] == inject.leak_names() and document["target"] == "target"
    assert document["features"]["final_outcome_flag"]["noise_rate"] == 0.02

    # Raw is kept unless forced; the later stages follow the new settings.
    snapshots.prepare(spark, _frame(spark, 10), SPEC, str(tmp_path))
    assert spark.read.parquet(paths["raw"]).count() == 40
    snapshots.prepare(spark, _frame(spark, 10), SPEC, str(tmp_path), force=True)
    assert spark.read.parquet(paths["injected"]).count() == 10

    table = snapshots.load_injected(spark, SPEC, str(tmp_path))
    assert table.leaks == inject.leak_names() and table.features[:3] == ["n0", "n1", "n2"]
    told = {r["feature"]: r["description"] for r in table.catalog.collect()}
    assert told["n0"] == "first number" and told["n1"] == "n1" and told["service_path_code"] == inject.LEAKS[8].description


def test_missing_snapshot(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.load_injected(spark, SPEC, str(tmp_path))


def test_snapshot_refuses_other_profiles(spark, tmp_path):
    with pytest.raises(ValueError):
        snapshots.prepare(spark, _frame(spark), SPEC, str(tmp_path), leak_count=5)


def test_loading_without_metadata_knows_leaks_by_name(spark):
    rows = _frame(spark).withColumn("row_id", F.monotonically_increasing_id()).withColumn("risk_review_code", F.lit("x"))
    table = snapshots.labelled(rows, SPEC)
    assert table.leaks == ["risk_review_code"]
    assert {r["leakage_type"] for r in table.catalog.where("is_injected_leakage").collect()} == {"unknown"}


def test_metadata_written_over_several_lines(spark, tmp_path):
    facts = {"is_injected_leakage": True, "leakage_type": "obvious", "leakage_level": "strong", "noise_rate": 0.02,
             "expected_target_agreement": 0.98, "observed_target_agreement": 0.97, "representation": "binary", "description": "d"}
    path = tmp_path / "t.metadata.json"
    path.write_text(json.dumps({"dataset": "t", "target": "y", "leakage_columns": ["a", "gone"], "features": {"a": facts, "unlisted": facts}}, indent=2))
    rows = snapshots.read_leak_metadata(spark, str(path)).collect()
    assert [r["feature"] for r in rows] == ["a"] and rows[0]["noise_rate"] == 0.02


def test_checked_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("a,b\n1,x\n2,\n")
    assert tables.read_checked_csv(spark, str(good)).dtypes == [("a", "int"), ("b", "string")]
    gbk = tmp_path / "gbk.csv"
    gbk.write_bytes("名,b\n值,1\n".encode("gbk"))
    df = tables.read_checked_csv(spark, str(gbk))
    assert df.columns == ["名", "b"] and df.first()["名"] == "值"
    for name, text, message in (("none", "", "empty"), ("head", "a,b\n", "no rows"), ("thin", "a\n1\n", "at least one feature")):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        with pytest.raises(ValueError, match=message):
            tables.read_checked_csv(spark, str(path))


def test_gbk_files_without_a_session_setting(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part, rows in (("1", ["1,值", "2,\"a,b\""]), ("2", ["3,"])):
        (folder / f"part-{part}.csv").write_bytes("\n".join(["号,名", *rows, ""]).encode("gbk"))
    before = spark.conf.getAll
    df = tables.read_checked_csv(spark, str(folder))
    assert df.dtypes == [("号", "int"), ("名", "string")] and spark.conf.getAll == before
    assert sorted((r["号"], r["名"]) for r in df.collect()) == [(1, "值"), (2, "a,b"), (3, None)]


def test_nan_is_missing(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(path)
    assert tables.read_table(spark, path).where("v IS NULL").count() == 1


def test_read_or_empty(spark, tmp_path):
    df, there = tables.read_or_empty(spark, str(tmp_path / "none"), schemas.METRICS)
    assert not there and df.isEmpty() and df.schema == schemas.METRICS


def test_result_folders_replace_only_their_partition(spark, tmp_path):
    def rows(dataset, value):
        return spark.createDataFrame([(dataset, 1, value)], "dataset string, seed int, x double")
    base = str(tmp_path)
    results.write_results({"metrics": rows("a", 1.0)}, base, "main")
    results.write_results({"metrics": rows("b", 2.0)}, base, "main", csv=True)
    results.write_results({"metrics": rows("a", 9.0)}, base, "ablation")
    results.write_results({"metrics": rows("a", 3.0)}, base, "main")
    results.write_results({"metrics": rows("synthetic", 4.0)}, base, "main")
    got = {(r["dataset"], r["x"]) for r in results.read_results(spark, base, "metrics", "main").collect()}
    assert got == {("a", 3.0), ("b", 2.0)}
    assert results.read_results(spark, base, "metrics", "main", include_debug=True).count() == 3
    assert results.read_results(spark, base, "metrics", "ablation").first()["x"] == 9.0
    plan = results.read_results(spark, base, "metrics", "main")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_kind" in plan
    with pytest.raises(ValueError):
        results.write_results({}, base, "other")


def test_failed_checks_raise(spark):
    df = spark.createDataFrame([("a", 1, "m")], "dataset string, seed int, method string")
    with pytest.raises(RuntimeError, match="main_seed_count"):
        checks.require_passed(checks.check_report(spark, ["a"], df, None, None))
    no_methods = {r["check"]: r["status"] for r in checks.check_report(spark, ["a"], df.drop("method"), df, None).collect()}
    assert no_methods["main_methods"] == "FAIL" and no_methods["semantic_scores_exists"] == "FAIL"


def _reply(prompt):
    if "never" in prompt:
        return "no json"
    if "range" in prompt:
        return '{"semantic_relevance": 1.5, "prediction_time_availability": 1, "leakage_risk": 0, "reason": "x"}'
    return '{"semantic_relevance": 0.9, "prediction_time_availability": 0.5, "leakage_risk": 0.25, "reason": "  Strong   task signal.  "}'


def test_scorer_retries_and_cache(spark):
    catalog = spark.createDataFrame([("t", "good", "d"), ("t", "never", "d"), ("t", "range", "d")], "dataset string, feature string, description string")
    prompts = [p for p in semantic.PROMPTS if p.name in ("leakage", "relevance")]
    jobs = semantic.with_cache_keys(semantic.render_prompts(semantic.prompt_jobs(catalog, prompts), F.lit("task"), prompts), "p", "m")
    asked = {(r["feature"], r["prompt_variant"]): r for r in scorer.ask(jobs, _reply, workers=2).collect()}
    assert asked["never", "leakage"]["n_attempts"] == 3 and asked["never", "leakage"]["reply"] is None
    assert asked["good", "leakage"]["n_attempts"] == 1
    empty = spark.createDataFrame([], "score_key string, semantic_relevance double, prediction_time_availability double, leakage_risk double, reason string")
    scored, entries = scorer.score_with_cache(jobs, empty, _reply, ["relevance"])
    got = {(r["feature"], r["prompt_variant"]): r for r in scored.collect()}
    assert got["good", "relevance"]["prediction_time_availability"] == 1.0 and got["good", "relevance"]["leakage_risk"] == 0.0
    assert got["good", "leakage"]["reason"] == "Strong task signal."
    assert {k for k, r in got.items() if not r["valid"]} == {(f, p) for f in ("never", "range") for p in ("leakage", "relevance")}
    with pytest.raises(ValueError, match="no valid score"):
        scorer.require_valid(scored)

    def fail(prompt):
        raise AssertionError("a cached job was asked again")

    again, new = scorer.score_with_cache(jobs.where("feature = 'good'"), entries, fail, ["relevance"])
    assert {r["hit"] for r in again.collect()} == {"current"} and new.isEmpty()


def test_legacy_keys_are_carried_forward(spark):
    catalog = spark.createDataFrame([("t", "a", "d")], "dataset string, feature string, description string")
    jobs = semantic.with_cache_keys(semantic.prompt_jobs(catalog, semantic.PROMPTS[:1]), "Old", "m", legacy_provider="old")
    cache = jobs.select(F.col("legacy_key").alias("score_key"), F.lit(0.3).alias("leakage_risk"))
    found = semantic.cache_lookup(jobs, cache)
    assert found.first()["hit"] == "legacy"
    carried = semantic.carried_forward(found, ["leakage_risk"]).first()
    assert carried["score_key"] == jobs.first()["score_key"] and carried["leakage_risk"] == 0.3
    other = semantic.with_cache_keys(semantic.prompt_jobs(catalog, semantic.PROMPTS[:1]), "new", "m", legacy_provider="old")
    assert other.first()["legacy_key"] is None
