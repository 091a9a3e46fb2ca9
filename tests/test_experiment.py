"""Whole runs on the smallest tables: invariants of the fits."""

import pytest
from pyspark.sql import functions as F

from colsieve.operators import checks, prep, select, stats
from colsieve.plans import experiment
from registry import frames
from tests.conftest import SF_SMALL

SETTINGS = experiment.RunSettings(seeds=(1, 2), trees=10, max_depth=5)


@pytest.fixture(scope="module")
def table(spark):
    return frames.order_labelled(spark, SF_SMALL)


@pytest.fixture(scope="module")
def main(table):
    return experiment.run_main(table, experiment.offline_semantic(table.catalog), SETTINGS)


def test_main_run(spark, main):
    rows = main.metrics.collect()
    assert len(rows) == 2 * len(select.METHODS)
    assert {r["k"] for r in rows} == {4} and {r["n_original_features"] for r in rows} == {9}
    for r in rows:
        if r["method"].startswith("tfs"):
            assert r["selected_leakage_count"] >= 1 and r["leaky_auroc"] > 0.9 and r["deployment_drop"] > 0.2
            assert r["llm_provider"] == "none"
        else:
            assert r["llm_provider"] == "rules"


def test_main_run_passes_the_integrity_checks(spark, main):
    report = checks.check_report(spark, ["orders_value"], main.metrics, main.selected, main.semantic, seeds=2)
    assert report.count() == 14 and checks.failures(report).isEmpty()


def test_leakage_aware_avoids_obvious_names(main):
    chosen = main.selected.where(F.col("method") == select.AWARE_METHOD)
    assert chosen.where(F.col("feature").isin("final_outcome_flag", "post_decision_status", "confirmed_result_code")).isEmpty()


def test_ablation_run(table):
    result = experiment.run_ablation(table, experiment.offline_semantic(table.catalog), SETTINGS)
    assert {(r["seed"], r["method"]) for r in result.metrics.collect()} == {(s, m) for s in (1, 2) for m in select.ABLATIONS}


def test_forest_importances(spark, table):
    prepared = stats.prepare(table.rows, table.features, "value_class")
    found = stats.forest_importances(prepared, seed=1, trees=10, max_depth=5)
    rows = {r["feature"]: r["importance"] for r in found.collect()}
    assert set(rows) == set(table.features) and min(rows.values()) >= 0 and sum(rows.values()) == pytest.approx(1.0)
    assert rows["final_outcome_flag"] > rows["order_month"]


def test_logistic_scores(spark):
    rows = [(i, 0.1 * i, "ab"[i // 2 % 2], float(i * 7 % 5), y) for i, y in enumerate((0, 0, 1, 1, 0, 1))]
    df = spark.createDataFrame(rows, "i int, numeric_signal double, category_signal string, weak_noise double, y int")
    prepared = stats.prepare(df, ["numeric_signal", "category_signal", "weak_noise"], "y", scale_numeric=True)
    for penalty in ("l2", "l1"):
        got = {r["feature"]: r["stat_score"] for r in stats.normalise_scorers(stats.logistic_importances(prepared, penalty)).collect()}
        assert len(got) == 3 and all(0 <= v <= 1 for v in got.values())


def test_encoder(spark):
    train = spark.createDataFrame([(1.0, "b", 5), (None, "a", 5), (3.0, None, 5), (8.0, "b", 5)], "n double, c string, flat int")
    encoder = prep.fit_encoder(train, ["n", "c", "flat"], scale_numeric=True)
    assert encoder.medians == {"n": 3.0, "flat": 5.0} and encoder.modes == {"c": "b"} and encoder.categories == {"c": ["a", "b"]}
    assert encoder.slots() == ["n", "flat", "c", "c"]
    filled = [1.0, 3.0, 3.0, 8.0]
    mean = sum(filled) / 4
    assert encoder.scales["n"] == pytest.approx((mean, (sum((x - mean) ** 2 for x in filled) / 4) ** 0.5))
    assert encoder.scales["flat"] == (5.0, 1.0)
    new = spark.createDataFrame([(None, "zzz", 5), (8.0, None, 6)], "n double, c string, flat int")
    vectors = [r["features"].toArray().tolist() for r in encoder.unscaled().transform(new).collect()]
    assert vectors == [[3.0, 5.0, 0.0, 0.0], [8.0, 6.0, 0.0, 1.0]]


def test_encoder_refuses_dates(spark):
    dates = spark.sql("SELECT DATE '2024-01-01' AS d, 'x' AS c")
    with pytest.raises(ValueError, match="date"):
        prep.fit_encoder(dates, ["d", "c"])


def test_run_needs_two_classes(table):
    from dataclasses import replace

    three = replace(table, spec=replace(table.spec, target="order_status"))
    with pytest.raises(ValueError, match="two classes"):
        experiment.run_main(three, experiment.offline_semantic(table.catalog), SETTINGS)


def test_analyze(spark, table):
    external = spark.createDataFrame(
        [("final_outcome_flag", 0.9, 0.0, 1.0, 0.0, "fine"), ("order_month", 0.9, 0.0, 1.0, 0.0, "known early")],
        "feature string, semantic_relevance double, leakage_risk double, availability double, uncertainty double, reason string",
    )
    summary, rankings = experiment.analyze(
        table.rows, "value_class", "row_id", k_ratio=0.3, external=external, trees=10, max_depth=5
    )
    row = summary.first()
    assert row["feature_count"] == 19 and row["selected_count"] == 6 and row["target_classes"] == ["high", "low"]
    assert [m["method"] for m in row["methods"]] == ["forest", "leakage_aware"]
    assert all(len(m["selected_features"]) == 6 and len(m["rankings"]) == 19 for m in row["methods"])
    flag = rankings.where("feature = 'final_outcome_flag'").first()
    assert flag["leakage_risk"] == 0.9 and flag["availability"] == 0.25 and flag["uncertainty"] == 0.18 and "guardrail" in flag["reason"]
