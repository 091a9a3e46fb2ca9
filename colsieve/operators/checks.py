"""Integrity checks of finished result tables. Each gives (dataset, check, status, detail) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colsieve import schemas
from colsieve.operators.select import METHODS
from colsieve.sources.tables import path_exists

# The columns a result table must have.
MAIN_COLUMNS = (
    "dataset", "seed", "method", "llm_provider", "llm_model", "k", "leaky_auroc", "leaky_f1", "clean_auroc", "clean_f1",
    "deployment_drop", "selected_leakage_count", "selected_leakage_ratio", "injected_leakage_recall",
)
SELECTED_COLUMNS = ("dataset", "seed", "method", "llm_provider", "llm_model", "rank", "feature", "is_injected_leakage")
SEMANTIC_COLUMNS = (
    "dataset", "feature", "prompt_variant", "semantic_relevance", "prediction_time_availability", "leakage_risk",
    "scoring_role", "provider", "model",
)
UNIT_COLUMNS = ("semantic_relevance", "prediction_time_availability", "leakage_risk")
EXPECTED_SEEDS = 5


def _status(passed: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")


def _rows(per_dataset: DataFrame, check: str, passed: Column, detail: Column) -> DataFrame:
    return per_dataset.select(
        "dataset", F.lit(check).alias("check"), _status(passed).alias("status"), detail.alias("detail")
    )


def _fixed(spark: SparkSession, datasets: Sequence[str], check: str, passed: bool, detail: str) -> DataFrame:
    rows = [(d, check, "PASS" if passed else "FAIL", detail) for d in datasets]
    return spark.createDataFrame(rows, schemas.CHECKS)


def check_exists(spark: SparkSession, dataset: str, check: str, path: str) -> DataFrame:
    return _fixed(spark, [dataset], check, path_exists(spark, path), path)


def check_columns(df: DataFrame, check: str, required: Sequence[str]) -> DataFrame:
    """One row per dataset of the table; the schema decides."""
    missing = sorted(set(required) - set(df.columns))
    detail = F.lit("columns not there: " + ",".join(missing))
    return _rows(df.select("dataset").distinct(), check, F.lit(not missing), detail)


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(values), lambda x: x.cast("string")), ",")


def check_methods(df: DataFrame, check: str, expected: Sequence[str] = METHODS) -> DataFrame:
    """The methods of a dataset are the expected ones, no more and no fewer."""
    if "method" not in df.columns:
        return _rows(df.select("dataset").distinct(), check, F.lit(not expected), F.lit("has methods "))
    found = df.select("dataset", "method").distinct().groupBy("dataset").agg(F.collect_set("method").alias("_m"))
    want = F.array(*[F.lit(m) for m in sorted(expected)])
    return _rows(found, check, F.sort_array("_m") == want, F.concat(F.lit("has methods "), _joined(F.col("_m"))))


def check_seeds(df: DataFrame, check: str, expected: int = EXPECTED_SEEDS) -> DataFrame:
    if "seed" not in df.columns:
        return _rows(df.select("dataset").distinct(), check, F.lit(expected == 0), F.lit("has seeds "))
    found = df.select("dataset", "seed").distinct().groupBy("dataset").agg(F.collect_set("seed").alias("_s"))
    return _rows(found, check, F.size("_s") == expected, F.concat(F.lit("has seeds "), _joined(F.col("_s"))))


def check_nulls(df: DataFrame, check: str, columns: Sequence[str] = MAIN_COLUMNS) -> DataFrame:
    """No nulls in the required columns, all counted in one pass."""
    looked = sorted(c for c in columns if c in df.columns and c not in ("dataset", "method"))
    counts = df.groupBy("dataset").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in looked])
    bad = F.concat_ws(",", *[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in looked])
    return _rows(counts.withColumn("_bad", bad), check, F.col("_bad") == "", F.concat(F.lit("empty cells "), F.col("_bad")))


def check_row_count(df: DataFrame, check: str, seeds: int = EXPECTED_SEEDS, methods: int = len(METHODS)) -> DataFrame:
    counts = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    detail = F.concat(F.lit(f"rows wanted {seeds * methods}, found "), F.col("_n").cast("string"))
    return _rows(counts, check, F.col("_n") == seeds * methods, detail)


def check_range(df: DataFrame, check: str, columns: Sequence[str] = UNIT_COLUMNS) -> DataFrame:
    """All scores within [0, 1]; a missing score or score column is a failure."""
    if not set(columns) <= set(df.columns):
        return _rows(df.select("dataset").distinct(), check, F.lit(False), F.lit("a score column is missing"))
    inside = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)) for c in columns])
    found = df.groupBy("dataset").agg(F.bool_and(inside).alias("_ok"))
    return _rows(found, check, F.col("_ok"), F.lit("every score lies between 0 and 1"))


# The names of the published checks, each with its result table and rule.
RULES = {
    "main_required_columns": ("metrics", "columns", MAIN_COLUMNS),
    "selected_required_columns": ("selected", "columns", SELECTED_COLUMNS),
    "semantic_required_columns": ("semantic", "columns", SEMANTIC_COLUMNS),
    "main_methods": ("metrics", "methods", None),
    "selected_methods": ("selected", "methods", None),
    "main_seed_count": ("metrics", "seeds", None),
    "selected_seed_count": ("selected", "seeds", None),
    "semantic_seed_count": ("semantic", "seeds", None),
    "main_no_null_metrics": ("metrics", "nulls", None),
    "main_row_count": ("metrics", "rows", None),
    "semantic_scores_in_unit_interval": ("semantic", "range", None),
}


def _checked(present: Mapping[str, DataFrame | None], seeds: int, methods: Sequence[str]) -> list[DataFrame]:
    """The rules whose result table is there."""
    rules = {
        "columns": check_columns, "methods": lambda df, check, _: check_methods(df, check, methods),
        "seeds": lambda df, check, _: check_seeds(df, check, seeds), "nulls": lambda df, check, _: check_nulls(df, check),
        "rows": lambda df, check, _: check_row_count(df, check, seeds, len(methods)), "range": lambda df, check, _: check_range(df, check),
    }
    return [rules[rule](present[name], check, wanted) for check, (name, rule, wanted) in RULES.items() if present.get(name) is not None]


def check_report(
    spark: SparkSession,
    datasets: Sequence[str],
    metrics: DataFrame | None,
    selected: DataFrame | None,
    semantic: DataFrame | None,
    seeds: int = EXPECTED_SEEDS,
    methods: Sequence[str] = METHODS,
) -> DataFrame:
    """All checks. A dataset that a result lacks fails that result's existence check."""
    present = {"metrics": metrics, "selected": selected, "semantic": semantic}
    wanted = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    rows = []
    for name, check in (
        ("metrics", "main_results_exists"), ("selected", "selected_features_exists"), ("semantic", "semantic_scores_exists")
    ):
        df = present[name]
        if df is None:
            rows.append(_fixed(spark, datasets, check, False, f"no {name} table"))
        else:
            have = df.select("dataset").distinct().withColumn("_have", F.lit(True))
            rows.append(_rows(wanted.join(have, "dataset", "left"), check, F.col("_have"), F.lit(f"{name} rows")))
    for checked in _checked(present, seeds, methods):
        rows.append(checked.join(wanted, "dataset", "left_semi"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def failures(report: DataFrame) -> DataFrame:
    return report.where(F.col("status") != "PASS")


def require_passed(report: DataFrame) -> None:
    """Raise if any check failed; the message shows the first ones."""
    bad = failures(report).limit(20).collect()
    if bad:
        raise RuntimeError("; ".join(f"{r['dataset']}/{r['check']}: {r['detail']}" for r in bad))
