"""Queries over predictions and result rows: metrics, reports, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.operators import checks, metrics, report, select
from colsieve.plans import experiment
from colsieve.plans.settle import settle
from registry import frames, sql
from registry.frames import SEEDS, ablation_rows, metric_rows as result_rows, order_budget, order_semantic, rankings, six, table


GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.split_leaky_orders(spark, sf, several_uses=True)
    return frames.predictions(rows, rankings(spark, sf, rows=rows))


def acc_f1(spark: SparkSession, sf: str) -> DataFrame:
    return six(metrics.accuracy_f1(predictions(spark, sf)))


def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return six(metrics.ranking_metrics(predictions(spark, sf)).drop("auprc"))


def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision with many equal scores: they are cut to two places."""
    rough = predictions(spark, sf).withColumn("score", F.floor(F.col("score") * 100.0) / 100.0)
    return six(metrics.ranking_metrics(rough, ("seed", "method", "setting")).drop("auroc"))


def leak_selection(spark: SparkSession, sf: str) -> DataFrame:
    return six(metrics.leak_selection(select.top_k(rankings(spark, sf)), order_budget(spark, sf)))


def deploy_drop(spark: SparkSession, sf: str) -> DataFrame:
    return six(metrics.by_setting(metrics.classification_metrics(predictions(spark, sf))))


def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of the features that two methods chose in the same run."""
    lists = select.selected_lists(rankings(spark, sf, ("tfs_rf", "leakage_aware")))
    def of(m: str):
        return F.coalesce(F.max(F.when(F.col("method") == m, F.col("selected_features"))), F.array().cast("array<string>"))
    pairs = lists.groupBy("dataset", "seed").agg(of("tfs_rf").alias("a"), of("leakage_aware").alias("b"))
    return six(pairs.select("dataset", "seed", metrics.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


def seed_stability(spark: SparkSession, sf: str) -> DataFrame:
    return six(metrics.mean_pairwise_jaccard(select.top_k(rankings(spark, sf)), ["dataset", "method"]))


def prompt_stability(spark: SparkSession, sf: str) -> DataFrame:
    ranked = experiment.rankings_by_prompt(
        settle(frames.stat_scores(spark, sf)), order_semantic(spark, sf), order_budget(spark, sf), SEEDS
    )
    return six(experiment.prompt_stability(ranked))


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    return six(result_rows(spark, sf))


def mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.mean_std(result_rows(spark, sf)))


def mean_std_text(spark: SparkSession, sf: str) -> DataFrame:
    return report.mean_std_text(result_rows(spark, sf), ["clean_auroc", "clean_f1", "leaky_auroc", "leaky_f1"])


def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.paired_delta(result_rows(spark, sf)))


def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset lacks the full variant and is left out."""
    rows = ablation_rows(spark, sf).where((F.col("dataset") != "NATION_3") | (F.col("method") != "full"))
    return six(report.ablation_delta(rows))


def selection_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.selection_frequency(select.top_k(rankings(spark, sf))))


def _word_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.offline_semantic(frames.word_catalog(spark, sf))


def frequency_order(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.ordered_frequency(report.selection_frequency(select.top_k(rankings(spark, sf)))))


def ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.mean_std(ablation_rows(spark, sf), report.ABLATION_METRICS))


def semantic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.semantic_summary(experiment.offline_semantic(frames.dealt_names(spark, sf))))


def case_study(spark: SparkSession, sf: str) -> DataFrame:
    chosen = select.top_k(rankings(spark, sf))
    raw = order_semantic(spark, sf).where(F.col("scoring_role") == select.AWARE_METHOD)
    return six(report.case_study(chosen, report.semantic_summary(raw)))


def ordered_results(spark: SparkSession, sf: str) -> DataFrame:
    known = result_rows(spark, sf).withColumn("method", F.when(F.col("method") == "tfs_lasso", "other").otherwise(F.col("method")))
    return six(report.ordered_results(known.select("dataset", "seed", "method", "clean_auroc")))


def repro_row(spark: SparkSession, sf: str) -> DataFrame:
    return report.reproducibility_row(result_rows(spark, sf))


def leaky_vs_clean(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.leaky_vs_clean(result_rows(spark, sf)))


def bar_input(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.bar_input(result_rows(spark, sf), "deployment_drop"))


def macro_avg(spark: SparkSession, sf: str) -> DataFrame:
    return six(report.macro_average(result_rows(spark, sf)))


def report_cut(spark: SparkSession, sf: str) -> DataFrame:
    table_ = report.bar_input(result_rows(spark, sf), "clean_f1")
    return report.report_cut(table_, ["dataset", "method"])


def check_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Every given table is there, a made-up one is not; the row counts stand beside."""
    found = [checks.check_exists(spark, n, f"{n}_exists", f"{sf}/{n}.parquet") for n in (*GIVEN, "no_such_table")]
    counts = [table(spark, sf, n).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("dataset", F.lit(n)) for n in GIVEN]
    stacked = [reduce(lambda a, b: a.unionByName(b), frames_) for frames_ in (found, counts)]
    return stacked[0].drop("detail").join(stacked[1], "dataset", "left")


def check_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = result_rows(spark, sf)
    good = checks.check_columns(rows, "main_required_columns", checks.MAIN_COLUMNS)
    bad = checks.check_columns(rows.drop("k", "clean_f1"), "cut_required_columns", checks.MAIN_COLUMNS)
    return good.unionByName(bad)


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows with faults: a missing method, a missing seed, missing values."""
    rows = result_rows(spark, sf)
    rows = rows.where((F.col("dataset") != "NATION_1") | (F.col("method") != "tfs_rf"))
    rows = rows.where((F.col("dataset") != "NATION_2") | (F.col("seed") != 2))
    hole = (F.col("dataset") == "NATION_4") & (F.col("seed") == 1)
    return rows.withColumns({"clean_f1": F.when(~hole, F.col("clean_f1")), "leaky_auroc": F.when(~(hole & (F.col("method") == "tfs_rf")), F.col("leaky_auroc"))})


def check_methods(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_methods(_gappy(spark, sf), "main_methods")


def check_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_seeds(_gappy(spark, sf), "main_seed_count", len(SEEDS))


def check_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_nulls(_gappy(spark, sf), "main_no_null_metrics")


def check_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_row_count(_gappy(spark, sf), "main_row_count", len(SEEDS))


def check_range(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the wide catalogue; one table has a score out of range and one a missing score."""
    raw = _word_semantic(spark, sf)
    risk = F.when(F.col("dataset") == "conv_2", 1.2).when(F.col("dataset") != "conv_3", F.col("leakage_risk"))
    return checks.check_range(raw.withColumn("leakage_risk", risk), "semantic_scores_in_unit_interval")


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit("none")
    return select.top_k(rankings(spark, sf)).withColumns({"llm_provider": none, "llm_model": none})


def check_report(spark: SparkSession, sf: str) -> DataFrame:
    datasets = [r["n_name"] for r in table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()] + ["NOWHERE"]
    raw = frames.with_run_seeds(order_semantic(spark, sf))
    return checks.check_report(spark, datasets, settle(_gappy(spark, sf)), _selected(spark, sf), raw, len(SEEDS))


QUERIES = {
    "acc_f1": acc_f1, "auroc": auroc, "avg_precision": avg_precision, "leak_selection": leak_selection, "deploy_drop": deploy_drop,
    "jaccard": jaccard, "seed_stability": seed_stability, "prompt_stability": prompt_stability, "metric_rows": metric_rows,
    "mean_std": mean_std, "mean_std_text": mean_std_text, "paired_delta": paired_delta, "ablation_delta": ablation_delta,
    "selection_frequency": selection_frequency, "frequency_order": frequency_order, "ablation_summary": ablation_summary, "semantic_summary": semantic_summary, "case_study": case_study,
    "ordered_results": ordered_results, "repro_row": repro_row, "leaky_vs_clean": leaky_vs_clean, "bar_input": bar_input,
    "macro_avg": macro_avg, "report_cut": report_cut, "check_exists": check_exists, "check_columns": check_columns,
    "check_methods": check_methods, "check_seeds": check_seeds, "check_nulls": check_nulls, "check_rows": check_rows,
    "check_range": check_range, "check_report": check_report,
}

_MAIN = report.MAIN_METRICS
# The result rows of the variants come from their own rankings.
_VARIANTS = {
    "chosen": "SELECT dataset, seed, method, feature FROM ranked_variants WHERE selected",
    "leak_selection": """
      SELECT dataset, seed, method, count(*) FILTER (is_injected_leakage)::DOUBLE AS selected_leakage_count,
        count(*) FILTER (is_injected_leakage)::DOUBLE / count(*) AS selected_leakage_ratio,
        count(*) FILTER (is_injected_leakage)::DOUBLE / 10 AS injected_leakage_recall
      FROM ranked_variants WHERE selected GROUP BY 1, 2, 3""",
}
_THREE = "printf('%.3f', round(({})::DECIMAL(30,12), 3)::DOUBLE)"
_PAIRS = [("leakage_aware", m) for m in ("tfs_rf", "tfs_logreg", "tfs_lasso", "semantic_only")]


def _moments(metrics_) -> str:
    return ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in metrics_)


def _deltas(source: str, pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT a.dataset, '{x} - {y}' AS comparison, '{m}' AS metric, avg(a.{m} - b.{m}) AS mean_delta, stddev_samp(a.{m} - b.{m}) AS std_delta, count(a.{m} - b.{m}) AS n_seeds"
        f" FROM {source} a JOIN {source} b ON a.dataset = b.dataset AND a.seed = b.seed AND a.method = '{x}' AND b.method = '{y}' GROUP BY 1"
        for x, y in pairs for m in report.DELTA_METRICS
    )


_SET_PAIRS = """
  SELECT {by}, count(DISTINCT seed) AS n_runs, coalesce(avg(j) FILTER (seed < other), 1.0::DOUBLE) AS mean_jaccard FROM (
    SELECT {by}, a.seed, b.seed AS other, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS j
    FROM chosen_sets a JOIN chosen_sets b USING ({by})) GROUP BY {by}"""
_PROMPT_TABLES = {
    "per_prompt": "SELECT dataset, prompt_variant, seed, feature, avg(semantic_relevance) AS r, avg(prediction_time_availability) AS a, avg(leakage_risk) AS l FROM raw, seeds GROUP BY 1, 2, 3, 4",
    "prompt_scores": """
      SELECT dataset, prompt_variant, seed, CASE scorer WHEN 'forest' THEN 'tfs_rf' WHEN 'logreg' THEN 'tfs_logreg' ELSE 'tfs_lasso' END AS method, feature, stat_score AS score FROM stat, prompts
      UNION ALL SELECT dataset, prompt_variant, seed, 'semantic_only', feature, r FROM per_prompt
      UNION ALL SELECT p.dataset, p.prompt_variant, p.seed, 'leakage_aware', p.feature,
        0.6::DOUBLE * s.stat_score + 0.4::DOUBLE * p.r - 0.5::DOUBLE * p.l - 0.3::DOUBLE * (1 - p.a) - 0.2::DOUBLE * 0
        FROM per_prompt p JOIN stat s ON s.dataset = p.dataset AND s.seed = p.seed AND s.feature = p.feature AND s.scorer = 'forest'""",
    "chosen_sets": """
      SELECT dataset, prompt_variant, method, seed, list(feature) AS s FROM (SELECT *, row_number() OVER (PARTITION BY dataset, prompt_variant, seed, method ORDER BY score DESC, feature) AS rank FROM prompt_scores) JOIN budget USING (dataset)
      WHERE rank <= k GROUP BY 1, 2, 3, 4""",
}
_SETS = {"chosen_sets": "SELECT dataset, method, seed, list(feature) AS s FROM ranked WHERE selected GROUP BY 1, 2, 3"}
_GAPPY = {
    "gappy": "SELECT * REPLACE (CASE WHEN dataset = 'NATION_4' AND seed = 1 THEN NULL ELSE clean_f1 END AS clean_f1,"
    " CASE WHEN dataset = 'NATION_4' AND seed = 1 AND method = 'tfs_rf' THEN NULL ELSE leaky_auroc END AS leaky_auroc)"
    " FROM result WHERE NOT (dataset = 'NATION_1' AND method = 'tfs_rf') AND NOT (dataset = 'NATION_2' AND seed = 2)",
}
_STATUS = "CASE WHEN {} THEN 'PASS' ELSE 'FAIL' END AS status"
_METHOD_LIST = ",".join(sorted(select.METHODS))


def _methods(source: str, check: str) -> str:
    listed = "string_agg(DISTINCT method, ',' ORDER BY method)"
    return f"SELECT dataset, '{check}' AS \"check\", {_STATUS.format(f'{listed} = {sql.text(_METHOD_LIST)}')}, 'has methods ' || {listed} AS detail FROM {source} GROUP BY dataset"


def _seeds(source: str, check: str) -> str:
    return (f"SELECT dataset, '{check}' AS \"check\", {_STATUS.format('count(DISTINCT seed) = 3')},"
            f" 'has seeds ' || string_agg(DISTINCT seed::VARCHAR, ',' ORDER BY seed::VARCHAR) AS detail FROM {source} GROUP BY dataset")


def _columns(source: str, check: str, missing: str = "") -> str:
    return f"SELECT DISTINCT dataset, '{check}' AS \"check\", '{'FAIL' if missing else 'PASS'}' AS status, 'columns not there: {missing}' AS detail FROM {source}"


_LOOKED = sorted(c for c in checks.MAIN_COLUMNS if c not in ("dataset", "method"))
_NULLS = (
    "SELECT dataset, 'main_no_null_metrics' AS \"check\", " + _STATUS.format("bad = ''") + ", 'empty cells ' || bad AS detail FROM (SELECT dataset, concat_ws(',', "
    + ", ".join(f"CASE WHEN count(*) > count({c}) THEN '{c}:' || (count(*) - count({c})) END" for c in _LOOKED) + ") AS bad FROM gappy GROUP BY 1)"
)
_ROWS = "SELECT dataset, 'main_row_count' AS \"check\", " + _STATUS.format("count(*) = 15") + ", 'rows wanted 15, found ' || count(*) AS detail FROM gappy GROUP BY dataset"


def _exists(source: str, check: str, what: str) -> str:
    return (f"SELECT w.dataset, '{check}' AS \"check\", {_STATUS.format('h.dataset IS NOT NULL')}, '{what} rows' AS detail"
            f" FROM wanted w LEFT JOIN (SELECT DISTINCT dataset FROM {source}) h ON h.dataset = w.dataset")


_PICKED = "(SELECT * FROM ranked WHERE selected)"
_SCORED = "(SELECT * FROM raw, seeds)"
_RANGE = "SELECT DISTINCT dataset, 'semantic_scores_in_unit_interval' AS \"check\", 'PASS' AS status, 'every score lies between 0 and 1' AS detail FROM catalog"
_ALL_CHECKS = " UNION ALL ".join([
    _columns("gappy", "main_required_columns"), _methods("gappy", "main_methods"), _seeds("gappy", "main_seed_count"), _NULLS, _ROWS,
    _columns(_PICKED, "selected_required_columns"), _methods(_PICKED, "selected_methods"), _seeds(_PICKED, "selected_seed_count"),
    _columns(_SCORED, "semantic_required_columns"), _seeds(_SCORED, "semantic_seed_count"), _RANGE,
])
_WANTED = {"wanted": "SELECT n_name AS dataset FROM nation UNION ALL SELECT 'NOWHERE'"}

_RULES_A_WORDS = f"""
  SELECT dataset, feature, prompt_variant, plain, CASE WHEN plain THEN 0.0::DOUBLE WHEN risky THEN 0.9::DOUBLE ELSE 0.15::DOUBLE END AS risk,
    CASE WHEN risky THEN 0.9::DOUBLE WHEN regexp_matches(lower(feature), {sql.text('|'.join(sql.SIGNAL_NAME_PARTS))}) THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS relevance,
    CASE WHEN plain THEN 1.0::DOUBLE WHEN risky THEN 0.15::DOUBLE ELSE 0.85::DOUBLE END AS available
  FROM (SELECT *, list_has_any({sql.tokens()}, {sql.texts(sql.RISKY_NAME_TERMS)}) AS risky FROM word_columns, prompts)"""

SQL = {
    "acc_f1": sql.six("SELECT * FROM plain_metrics", "accuracy f1"),
    "auroc": sql.six("SELECT dataset, seed, method, setting, auroc FROM ranking_metrics", "auroc"),
    "avg_precision": sql.six(
        "SELECT seed, method, setting, CASE WHEN max(p) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / max(p) END AS auprc FROM rough GROUP BY 1, 2, 3", "auprc",
        rough="""
          SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS p
          FROM (SELECT seed, method, setting, floor(score * 100.0::DOUBLE) / 100.0::DOUBLE AS s, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM pred GROUP BY 1, 2, 3, 4)
          WINDOW w AS (PARTITION BY seed, method, setting ORDER BY s DESC), g AS (PARTITION BY seed, method, setting)""",
    ),
    "leak_selection": sql.six("SELECT * FROM leak_selection", "selected_leakage_count selected_leakage_ratio injected_leakage_recall"),
    "deploy_drop": sql.six("SELECT * FROM wide", "leaky_auroc leaky_f1 clean_auroc clean_f1 deployment_drop"),
    "jaccard": sql.six(
        "SELECT dataset, seed, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS jaccard"
        " FROM (SELECT * FROM chosen_sets WHERE method = 'tfs_rf') a JOIN (SELECT * FROM chosen_sets WHERE method = 'leakage_aware') b USING (dataset, seed)",
        "jaccard", **_SETS,
    ),
    "seed_stability": sql.six(_SET_PAIRS.format(by="dataset, method"), "mean_jaccard", **_SETS),
    "prompt_stability": sql.six(_SET_PAIRS.format(by="dataset, prompt_variant, method"), "mean_jaccard", **_PROMPT_TABLES),
    "metric_rows": sql.six("SELECT * FROM result", " ".join(_MAIN)),
    "mean_std": sql.six(
        f"SELECT dataset, method, {_moments(_MAIN)} FROM result GROUP BY 1, 2", " ".join(f"{m}_mean {m}_std" for m in _MAIN)
    ),
    "mean_std_text": sql.with_tables(
        "SELECT dataset, method, " + ", ".join(
            f"coalesce({_THREE.format(f'avg({m})')}, 'nan') || ' +/- ' || coalesce({_THREE.format(f'stddev_samp({m})')}, 'nan') AS {m}" for m in ("clean_auroc", "clean_f1", "leaky_auroc", "leaky_f1")
        ) + " FROM result GROUP BY 1, 2"
    ),
    "paired_delta": sql.six(_deltas("result", _PAIRS), "mean_delta std_delta"),
    "ablation_delta": sql.six(
        _deltas("variants", [(v, "full") for v in ("no_leakage", "no_availability", "no_uncertainty")]), "mean_delta std_delta",
        variants="SELECT * FROM result WHERE NOT (dataset = 'NATION_3' AND method = 'full')", **_VARIANTS,
    ),
    "selection_frequency": sql.six(
        "SELECT dataset, method, feature, count(*) AS selected_count, avg(rank) AS mean_rank, bool_or(is_injected_leakage) AS is_injected_leakage"
        " FROM ranked WHERE selected GROUP BY 1, 2, 3", "mean_rank"
    ),
    "frequency_order": sql.six(
        "SELECT *, row_number() OVER (ORDER BY dataset, list_position(['tfs_rf', 'tfs_logreg', 'tfs_lasso', 'semantic_only', 'leakage_aware'], method),"
        " selected_count DESC, mean_rank, feature) AS position FROM (SELECT dataset, method, feature, count(*) AS selected_count, avg(rank) AS mean_rank,"
        " bool_or(is_injected_leakage) AS is_injected_leakage FROM ranked WHERE selected GROUP BY 1, 2, 3)", "mean_rank"
    ),
    "ablation_summary": sql.six(
        f"SELECT dataset, method, {_moments(report.ABLATION_METRICS)} FROM result GROUP BY 1, 2",
        " ".join(f"{m}_mean {m}_std" for m in report.ABLATION_METRICS), **_VARIANTS,
    ),
    "semantic_summary": sql.six(
        "SELECT dataset, feature, CASE WHEN plain THEN 'semantic_only' ELSE 'leakage_aware' END AS scoring_role, 'rules' AS provider, 'names' AS model,"
        " avg(relevance) AS semantic_relevance_mean, avg(available) AS availability_mean, avg(risk) AS leakage_risk_mean, stddev_samp(risk) AS leakage_risk_std, count(*) AS prompt_count"
        f" FROM ({_RULES_A_WORDS}) GROUP BY 1, 2, 3", "semantic_relevance_mean availability_mean leakage_risk_mean leakage_risk_std"
    ),
    "case_study": sql.six(
        "SELECT r.dataset, r.seed, r.method, r.feature, r.rank, CASE WHEN EXISTS (SELECT 1 FROM ranked x WHERE x.selected AND x.method = 'leakage_aware'"
        " AND x.dataset = r.dataset AND x.seed = r.seed AND x.feature = r.feature) THEN 'Select' ELSE 'Reject' END AS aware_decision,"
        " s.semantic_relevance_mean, s.availability_mean, s.leakage_risk_mean, s.leakage_risk_std FROM ranked r LEFT JOIN"
        " (SELECT dataset, feature, avg(semantic_relevance) AS semantic_relevance_mean, avg(prediction_time_availability) AS availability_mean, avg(leakage_risk) AS leakage_risk_mean,"
        " stddev_samp(leakage_risk) AS leakage_risk_std FROM raw WHERE scoring_role = 'leakage_aware' GROUP BY 1, 2) s ON s.dataset = r.dataset AND s.feature = r.feature"
        " WHERE r.selected AND r.is_injected_leakage AND r.method LIKE 'tfs%'",
        "semantic_relevance_mean availability_mean leakage_risk_mean leakage_risk_std",
    ),
    "ordered_results": sql.six(
        "SELECT dataset, seed, method, clean_auroc, list_position(['tfs_rf', 'tfs_logreg', 'tfs_lasso', 'semantic_only', 'leakage_aware'], method)::INTEGER AS method_order"
        " FROM result WHERE method <> 'tfs_lasso'", "clean_auroc"
    ),
    "repro_row": sql.with_tables(
        "SELECT string_agg(DISTINCT dataset, ';' ORDER BY dataset) AS datasets, 'tfs_rf;tfs_logreg;tfs_lasso;semantic_only;leakage_aware' AS methods,"
        " string_agg(DISTINCT seed::VARCHAR, ';' ORDER BY seed::VARCHAR) AS seeds, count(*) AS n_rows,"
        " 'semantic_only=rules/names;leakage_aware=rules/names' AS llm_assignments FROM result"
    ),
    "leaky_vs_clean": sql.six("SELECT dataset, method, avg(leaky_auroc) AS leaky_auroc, avg(clean_auroc) AS clean_auroc FROM result GROUP BY 1, 2", "leaky_auroc clean_auroc"),
    "bar_input": sql.six("SELECT dataset, method, avg(deployment_drop) AS mean, stddev_samp(deployment_drop) AS std FROM result GROUP BY 1, 2", "mean std"),
    "macro_avg": sql.six(
        "SELECT method, " + ", ".join(f"avg({m}) AS {m}" for m in _MAIN) + ", count(*) AS n_datasets FROM (SELECT dataset, method, "
        + ", ".join(f"avg({m}) AS {m}" for m in _MAIN) + " FROM result GROUP BY 1, 2) GROUP BY 1", " ".join(_MAIN)
    ),
    "report_cut": sql.with_tables(
        f"SELECT dataset, method, {_THREE.format('avg(clean_f1)')} AS mean, {_THREE.format('stddev_samp(clean_f1)')} AS std FROM result GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 18"
    ),
    "check_exists": " UNION ALL ".join(f"SELECT '{n}' AS dataset, '{n}_exists' AS \"check\", 'PASS' AS status, count(*) AS n_rows FROM {n}" for n in GIVEN)
    + " UNION ALL SELECT 'no_such_table', 'no_such_table_exists', 'FAIL', NULL",
    "check_columns": sql.with_tables(
        _columns("result", "main_required_columns") + " UNION ALL " + _columns("result", "cut_required_columns", "clean_f1,k")
    ),
    "check_methods": sql.with_tables(_methods("gappy", "main_methods"), **_GAPPY),
    "check_seeds": sql.with_tables(_seeds("gappy", "main_seed_count"), **_GAPPY),
    "check_nulls": sql.with_tables(_NULLS, **_GAPPY),
    "check_rows": sql.with_tables(_ROWS, **_GAPPY),
    "check_range": sql.with_tables(
        "SELECT DISTINCT dataset, 'semantic_scores_in_unit_interval' AS \"check\", " + _STATUS.format("dataset NOT IN ('conv_2', 'conv_3')")
        + ", 'every score lies between 0 and 1' AS detail FROM word_columns"
    ),
    "check_report": sql.with_tables(
        " UNION ALL ".join([
            _exists("gappy", "main_results_exists", "metrics"), _exists(_PICKED, "selected_features_exists", "selected"),
            _exists(_SCORED, "semantic_scores_exists", "semantic"),
        ]) + f" UNION ALL SELECT * FROM ({_ALL_CHECKS}) WHERE dataset IN (SELECT dataset FROM wanted)", **_GAPPY, **_WANTED,
    ),
}
