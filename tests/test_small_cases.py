"""Small frames with known results."""

import pytest
from pyspark.sql import functions as F

from colsieve.operators import inject, metrics, profile, report, select, semantic, split, stats, target as targets


def one(df, column=None):
    row = df.first()
    return row[column or df.columns[0]]


@pytest.mark.parametrize("n, ratio, k, expected", [(10, 0.4, None, 4), (10, 0.4, 99, 10), (10, 0.4, 0, 1), (14, 0.4, None, 6)])
def test_k_from_ratio(spark, n, ratio, k, expected):
    assert one(spark.range(1).select(select.k_from_ratio(F.lit(n), ratio, k))) == expected


def test_k_of_the_interactive_analysis_bounds_the_ratio(spark):
    assert one(spark.range(1).select(select.k_from_ratio(F.lit(40), 0.0001, least=0.05))) == 2
    assert one(spark.range(1).select(select.k_from_ratio(F.lit(40), 9.0, least=0.05))) == 40


def _catalog(spark, original, injected):
    rows = [("t", f"c{i}", False) for i in range(original)] + [("t", f"l{i}", True) for i in range(injected)]
    return spark.createDataFrame(rows, "dataset string, feature string, is_injected_leakage boolean")


@pytest.mark.parametrize("n, injected, k, expected", [(24, 10, None, 6), (14, 10, None, 2), (14, 10, 99, 4)])
def test_budget_counts_original_columns(spark, n, injected, k, expected):
    assert one(select.budgets(_catalog(spark, n - injected, injected), k=k), "k") == expected


def test_budget_needs_an_original_column(spark):
    with pytest.raises(Exception, match="not injected"):
        select.budgets(_catalog(spark, 0, 10)).collect()


def _scores(spark, values):
    return spark.createDataFrame([("t", f"f{i}", v) for i, v in enumerate(values)], "dataset string, feature string, importance double")


def test_normalise(spark):
    got = {r["feature"]: r["stat_score"] for r in stats.normalise(_scores(spark, [3.0, 3.0, 3.0]), ["dataset"]).collect()}
    assert set(got.values()) == {0.5}
    got = {r["feature"]: r["stat_score"] for r in stats.normalise(_scores(spark, [None, 2.0, float("nan"), 4.0]), ["dataset"]).collect()}
    assert got == {"f0": 0.0, "f1": 0.5, "f2": 0.0, "f3": 1.0}


def test_normalise_tolerances_differ(spark):
    near = _scores(spark, [1.0, 1.0 + 5e-6])
    assert {r["stat_score"] for r in stats.normalise(near, ["dataset"]).collect()} == {0.5}
    assert {r["stat_score"] for r in stats.normalise(near, ["dataset"], strict=True).collect()} == {0.0, 1.0}


STAT = "dataset string, seed int, feature string, stat_score double"
SEM = "dataset string, seed int, feature string, avg_semantic_relevance double, avg_availability double, avg_leakage_risk double, uncertainty double"


def _aware(spark, stat, sem, variants=None):
    scores = select.aware_scores(spark.createDataFrame(stat, STAT), spark.createDataFrame(sem, SEM), variants)
    return {(r["method"], r["feature"]): round(r["score"], 9) for r in scores.collect()}


def test_leakage_penalty_flips_the_winner(spark):
    got = _aware(
        spark, [("t", 1, "safe", 0.8), ("t", 1, "leaky", 1.0)],
        [("t", 1, "safe", 0.7, 0.9, 0.1, 0.0), ("t", 1, "leaky", 0.9, 0.1, 0.95, 0.0)],
    )
    assert got == {("leakage_aware", "safe"): 0.68, ("leakage_aware", "leaky"): 0.215}


def test_missing_side_counts_as_zero(spark):
    got = _aware(spark, [("t", 1, "only_stat", 1.0)], [("t", 1, "only_sem", 0.5, 1.0, 0.0, 0.0)])
    assert got == {("leakage_aware", "only_stat"): 0.3, ("leakage_aware", "only_sem"): 0.2}


def test_ablation_drops_one_penalty(spark):
    got = _aware(spark, [("t", 1, "f", 0.0)], [("t", 1, "f", 0.0, 0.0, 1.0, 1.0)], select.ablations())
    assert got == {("full", "f"): -1.0, ("no_leakage", "f"): -0.5, ("no_availability", "f"): -0.7, ("no_uncertainty", "f"): -0.8}


def test_relevance_ranking_ignores_risk_and_breaks_ties_by_name(spark):
    sem = spark.createDataFrame(
        [("t", 1, "safe", 0.7, 0.9, 0.1, 0.0), ("t", 1, "leaky", 1.4, 0.1, 0.95, 0.0), ("t", 1, "also", 0.7, 0.9, 0.1, 0.0)], SEM
    )
    budget = spark.createDataFrame([("t", 1)], "dataset string, k int")
    ranked = select.rank_methods(select.relevance_scores(sem), budget).orderBy("rank").collect()
    assert [(r["feature"], r["score"], r["selected"]) for r in ranked] == [("leaky", 1.0, True), ("also", 0.7, False), ("safe", 0.7, False)]


def test_injection_shape_and_order(spark):
    df = spark.createDataFrame([(i, 20 + i, "ab"[i % 2], i % 2) for i in range(4)], "row_id int, age int, segment string, y int")
    out = inject.inject_leaks(df, targets.injection_bit(df, "y"), "row_id")
    assert out.columns == [*df.columns, *inject.leak_names()]
    assert {l.level for l in inject.LEAKS} == {"strong", "moderate", "weak"}
    kinds = dict(out.dtypes)
    assert kinds["final_outcome_flag"] == "int" and kinds["risk_review_code"] == "string" and kinds["review_priority_index"] == "double"


def test_agreement_bounds(spark):
    df = spark.range(10000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"))
    for row in inject.leak_agreement(df, F.col("y"), "row_id").collect():
        low, high = {"strong": (0.95, 1.0), "moderate": (0.8, 0.9), "weak": (0.6, 0.7)}[row["leakage_level"]]
        assert low < row["observed_target_agreement"] < high
    levels = {r["leakage_level"]: r["mean_agreement"] for r in inject.agreement_by_level(inject.leak_agreement(df, F.col("y"), "row_id")).collect()}
    assert levels["strong"] > levels["moderate"] > levels["weak"]


def test_injection_validation(spark):
    df = spark.createDataFrame([(1, 0)], "row_id int, y int")
    with pytest.raises(ValueError, match="between 1 and 10"):
        inject.inject_leaks(df, F.col("y"), "row_id", count=11)
    with pytest.raises(ValueError, match="below 0.5"):
        inject.inject_leaks(df, F.col("y"), "row_id", noise={"weak": 0.5})
    with pytest.raises(ValueError, match="named like leaks"):
        inject.inject_leaks(df.withColumn("final_outcome_flag", F.lit(1)), F.col("y"), "row_id")
    with pytest.raises(ValueError, match="level counts"):
        inject.require_fixed_profile(10, {"strong": 10})
    with pytest.raises(ValueError, match="exactly 10"):
        inject.require_fixed_profile(9)


@pytest.mark.parametrize("values, kind, injected, measured", [
    ([1, 1, 1, 0], "int", [1, 1, 1, 0], [1, 1, 1, 0]),
    ([10.0, 20.0, 30.0, 40.0], "double", [0, 0, 1, 1], [0, 0, 1, 1]),
    ([5, 5, 5], "int", [0, 0, 0], [1, 1, 1]),
    (["a", "b", "b"], "string", [0, 1, 1], [0, 1, 1]),
    (["a", "b", "c", "c"], "string", [0, 0, 1, 1], [0, 0, 1, 1]),
    (["x", "x"], "string", [1, 1], [0, 0]),
    ([True, False, True], "boolean", [1, 0, 1], [1, 0, 1]),
])
def test_target_bits(spark, values, kind, injected, measured):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, y {kind}")
    for make, expected in ((targets.injection_bit, injected), (targets.metric_bit, measured)):
        rows = df.select("i", make(df, "y").alias("bit")).orderBy("i").collect()
        assert [r["bit"] for r in rows] == expected


def test_mask(spark):
    df = spark.createDataFrame([(1, "x", 30), (0, "y", 40)], "final_outcome_flag int, risk_review_code string, age int")
    rows = inject.mask_leaks(df, ["final_outcome_flag", "risk_review_code", "absent"]).collect()
    assert {r["final_outcome_flag"] for r in rows} == {0.5}
    assert {r["risk_review_code"] for r in rows} == {inject.UNAVAILABLE}
    assert sorted(r["age"] for r in rows) == [30, 40]


def test_median_binary(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "continuous_target int")
    out = targets.median_binary(df, "continuous_target", "label")
    assert out.columns == ["label"]
    assert sorted(r[0] for r in out.collect()) == ["high", "high", "low", "low"]
    assert targets.median_binary(df, "continuous_target", "label", threshold=35).where("label = 'high'").count() == 1
    bad = spark.createDataFrame([("1",), ("x",)], "t string")
    with pytest.raises(ValueError, match="no numbers"):
        targets.median_binary(bad, "t")


def test_coercion_needs_more_than_95_percent(spark):
    rows = [(i, "x" if i == 0 else str(i), None if i == 0 else "2.5", "7") for i in range(20)]
    df = spark.createDataFrame(rows, "i int, word string, gap string, number string")
    out = dict(profile.coerce_numeric(df, ["word", "gap", "number"]).dtypes)
    assert out == {"i": "int", "word": "string", "gap": "string", "number": "double"}


def test_constant_columns_and_nulls(spark):
    df = spark.createDataFrame([("a", None, "same", 1.0), (None, None, "same", 1.0)], "half string, none string, same string, one double")
    assert profile.drop_constant(df, df.columns).columns == ["half"]


def test_two_classes_needed(spark):
    with pytest.raises(ValueError, match="two classes"):
        profile.require_two_classes(spark.createDataFrame([("a",), ("a",)], "y string"), "y")
    with pytest.raises(ValueError, match="no rows"):
        profile.require_two_classes(spark.createDataFrame([], "y string"), "y")


def test_examples_of_sparse_columns(spark):
    df = spark.range(500).select(
        F.col("id").alias("row_id"), F.when(F.col("id") >= 490, F.col("id")).alias("late"),
        F.when(F.col("id") == 3, F.lit("x" * 100)).alias("rare"),
    ).repartition(5)
    got = {r["feature"]: r["examples"] for r in profile.profile(df, ["late", "rare"], "row_id").collect()}
    assert got == {"late": ["490", "491", "492", "493"], "rare": ["x" * 60]}


def test_split_quotas_disjoint_and_independent_of_partitions(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"), F.when(F.col("id") % 7 == 0, "rare").otherwise("common").alias("y"))
    def parts(frame):
        return {(r["seed"], r["row_id"]): r["part"] for r in split.stratified_split(frame, "y", "row_id", [1, 2]).collect()}
    first, again = parts(df.repartition(1)), parts(df.repartition(8))
    assert first == again and len(first) == 2006
    counts = {(r["seed"], r["label"], r["part"]): r["n_rows"] for r in split.split_counts(split.stratified_split(df, "y", "row_id", [1]), "y").collect()}
    n = 144
    assert counts[1, "rare", "train"] == round(n * 0.6) and counts[1, "rare", "validation"] == round(n * 0.8) - round(n * 0.6)
    rough = split.stratified_split(df, "y", "row_id", [1], exact=False)
    assert 0.5 < rough.where("part = 'train'").count() / 1003 < 0.7


def test_tiny_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "row_id int, y string")
    assert split.stratified_split(df, "y", "row_id", [1]).count() == 3


def test_guardrail(spark):
    names = ["loan_amount", "final_state", "risk_review_code", "case_type", "case_type_resolution", "Quality-score", "action_group_followup"]
    floor, hits, _ = semantic.guardrail(F.col("feature"), F.lit("doc_quality"))
    df = spark.createDataFrame([(n,) for n in names], "feature string").select("feature", floor.alias("f"), hits.alias("h"))
    got = {r["feature"]: (r["f"], list(r["h"])) for r in df.collect()}
    assert got == {
        "loan_amount": (0.12, []), "final_state": (0.9, ["final"]), "risk_review_code": (0.9, ["code", "review", "risk"]),
        "case_type": (0.12, []), "case_type_resolution": (0.9, ["resolution"]), "Quality-score": (0.9, ["quality"]),
        "action_group_followup": (0.9, ["followup"]),
    }


def test_one_prompt_has_no_uncertainty(spark):
    raw = spark.createDataFrame(
        [("t", "a", 0.5, 0.5, 0.2), ("t", "b", 0.5, 0.5, 0.2), ("t", "b", 0.7, 0.5, 0.4)],
        "dataset string, feature string, semantic_relevance double, prediction_time_availability double, leakage_risk double",
    )
    got = {r["feature"]: round(r["uncertainty"], 9) for r in semantic.aggregate_prompts(raw, ["dataset"]).collect()}
    assert got == {"a": 0.0, "b": 0.02}


def test_prompt_braces_in_names_stay(spark):
    jobs = spark.createDataFrame([("t", "{feature_description}", "a {b}", "p")], "dataset string, feature string, description string, prompt_variant string")
    prompts = [semantic.Prompt("p", "{{x}} {feature_name}|{feature_description}|{task_description}")]
    assert one(semantic.render_prompts(jobs, F.lit("T{0}"), prompts), "prompt") == "{x} {feature_description}|a {b}|T{0}"


def test_leak_selection(spark):
    chosen = spark.createDataFrame([("t", 1, "m", "a", False), ("t", 1, "m", "leak_1", True), ("t", 1, "m", "b", False)],
                                   "dataset string, seed int, method string, feature string, is_injected_leakage boolean")
    row = metrics.leak_selection(chosen, spark.createDataFrame([("t", 2)], "dataset string, n_injected_features int")).first()
    assert (row["selected_leakage_count"], round(row["selected_leakage_ratio"], 6), row["injected_leakage_recall"]) == (1.0, 0.333333, 0.5)


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert sorted(round(r[0], 6) for r in df.select(metrics.jaccard(F.col("a"), F.col("b"))).collect()) == [0.333333, 1.0]


def test_mean_pairwise_jaccard(spark):
    rows = [("one", 1, "a")] + [("three", s, f) for s, fs in ((1, "ab"), (2, "bc"), (3, "ab")) for f in fs]
    df = spark.createDataFrame(rows, "dataset string, seed int, feature string")
    got = {r["dataset"]: r["mean_jaccard"] for r in metrics.mean_pairwise_jaccard(df, ["dataset"]).collect()}
    assert got["one"] == 1.0 and got["three"] == pytest.approx((1 / 3 + 1 + 1 / 3) / 3)


PRED = "g int, label int, pred int, score double"


def test_average_precision_and_auroc_with_ties(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (1, 0, 1, 0.9), (1, 1, 0, 0.4), (1, 0, 0, 0.1)], PRED)
    row = metrics.ranking_metrics(df, ["g"]).first()
    assert row["auprc"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3) and row["auroc"] == pytest.approx((1.5 + 1) / 4)


def test_single_class_predictions_are_not_recoded(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.1), (1, 0, 0, 0.2), (2, 0, 0, 0.1)], PRED)
    got = {r["g"]: r for r in metrics.classification_metrics(df, ["g"]).collect()}
    assert got[1]["f1"] == 0.0 and got[1]["accuracy"] == 0.5 and got[1]["auroc"] == 0.0
    assert got[2]["auroc"] is None and got[2]["auprc"] is None


def test_case_study_without_leaks_keeps_columns(spark):
    chosen = spark.createDataFrame([], "dataset string, seed int, method string, feature string, rank int, is_injected_leakage boolean")
    summary = spark.createDataFrame([], "dataset string, feature string, semantic_relevance_mean double, availability_mean double, leakage_risk_mean double, leakage_risk_std double")
    table = report.case_study(chosen, summary)
    assert table.count() == 0 and "aware_decision" in table.columns


def test_mean_delta_is_difference_of_means(spark):
    rows = [("t", s, m, *[0.1 * s + 0.01 * i for _ in range(5)]) for s in (1, 2, 3) for i, m in enumerate(("leakage_aware", "tfs_rf"))]
    df = spark.createDataFrame(rows, "dataset string, seed int, method string, " + ", ".join(f"{m} double" for m in report.DELTA_METRICS))
    delta = report.paired_delta(df, order=("tfs_rf", "leakage_aware")).first()
    assert delta["comparison"] == "leakage_aware - tfs_rf" and delta["mean_delta"] == pytest.approx(-0.01) and delta["n_seeds"] == 3


def test_one_seed_has_no_deviation(spark):
    df = spark.createDataFrame([("t", "m", 0.12345)], "dataset string, method string, x double")
    assert one(report.mean_std_text(df, ["x"]), "x") == "0.123 +/- nan"


def test_refused_injections(spark):
    names = inject.leak_names()
    columns = spark.createDataFrame([("a", names[0]), ("a", names[3]), ("a", "x"), ("b", names[9]), ("b", names[9]), (None, names[0])], "dataset string, feature string")
    settings = spark.createDataFrame(
        [("a", 4, 0.1), ("a", 3, 0.0), ("b", 9, 0.5), ("b", 11, -0.1), ("c", 0, None), (None, None, 0.2)], "dataset string, n_leaks int, noise_rate double"
    )
    found = [tuple(r) for r in inject.refusals(columns, settings).collect()]
    assert sorted(found, key=str) == sorted([
        ("a", 4, 0.1, False, False, ",".join(sorted((names[0], names[3])))), ("a", 3, 0.0, False, False, names[0]),
        ("b", 9, 0.5, False, True, ""), ("b", 11, -0.1, True, True, names[9]), ("c", 0, None, True, True, ""), (None, None, 0.2, True, False, ""),
    ], key=str)
