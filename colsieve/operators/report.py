"""Summary tables over result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colsieve.operators.select import ABLATIONS, AWARE_METHOD, METHODS, STAT_METHODS
from colsieve.plans.ranking import number_rows

# The metrics of the published tables.
MAIN_METRICS = (
    "leaky_auroc", "clean_auroc", "leaky_f1", "clean_f1", "deployment_drop",
    "selected_leakage_count", "selected_leakage_ratio", "injected_leakage_recall",
)
ABLATION_METRICS = (
    "clean_auroc", "clean_f1", "deployment_drop",
    "selected_leakage_count", "selected_leakage_ratio", "injected_leakage_recall",
)
DELTA_METRICS = ("clean_auroc", "clean_f1", "deployment_drop", "selected_leakage_count", "injected_leakage_recall")
TABLE_ROWS = 18


def method_order(order: Sequence[str] = METHODS) -> Column:
    """Position of the method in the given order; null for other methods."""
    return F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))


def ordered_results(results: DataFrame, order: Sequence[str] = METHODS, extra: Sequence[str] = ()) -> DataFrame:
    """Known methods only, by dataset, seed, method position and the extra columns."""
    known = results.where(F.col("method").isin(list(order))).withColumn("method_order", method_order(order).cast("int"))
    return known.orderBy("dataset", "seed", "method_order", *extra)


def mean_std(results: DataFrame, metrics: Sequence[str] = MAIN_METRICS, by: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """<metric>_mean and <metric>_std (sample deviation) per group."""
    columns = []
    for m in metrics:
        columns += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return results.groupBy(*by).agg(*columns)


def three_places(value: Column) -> Column:
    """Three decimals as text, ties away from zero. Twelve places are kept before, so that noise of float sums decides no tie."""
    tidy = F.round(value.try_cast("decimal(30,12)"), 3)
    return F.when(value.isNotNull(), F.format_string("%.3f", F.coalesce(tidy.cast("double"), value)))


def _text(mean: Column, deviation: Column) -> Column:
    shown = lambda c: F.when(c.isNull(), "nan").otherwise(three_places(c))
    return F.concat(shown(mean), F.lit(" +/- "), shown(deviation))


def mean_std_text(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """'mean +/- deviation' with three decimals per metric."""
    table = mean_std(results, metrics, by)
    return table.select(*by, *[_text(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in metrics])


def method_deltas(
    results: DataFrame, comparisons: Sequence[tuple[str, str]], metrics: Sequence[str] = DELTA_METRICS
) -> DataFrame:
    """Per seed differences ``a - b`` of each (a, b): mean, sample deviation, pairs without gaps.

    One aggregation puts the methods of a (dataset, seed) beside each other; there
    is no self join. Datasets without one of the two methods give no row.
    """
    methods = sorted({m for pair in comparisons for m in pair})
    wide = results.groupBy("dataset", "seed").agg(*[
        F.max(F.when(F.col("method") == m, F.struct(*metrics))).alias(m) for m in methods
    ])
    cells = [
        F.struct(
            F.lit(f"{a} - {b}").alias("comparison"), F.lit(metric).alias("metric"),
            F.col(a).isNotNull().alias("_has_a"), F.col(b).isNotNull().alias("_has_b"),
            (F.col(a)[metric] - F.col(b)[metric]).cast("double").alias("_delta"),
        )
        for a, b in comparisons
        for metric in metrics
    ]
    long = wide.select("dataset", F.inline(F.array(*cells)))
    table = long.groupBy("dataset", "comparison", "metric").agg(
        F.avg("_delta").alias("mean_delta"), F.stddev_samp("_delta").alias("std_delta"), F.count("_delta").alias("n_seeds"),
        F.bool_or("_has_a").alias("_a"), F.bool_or("_has_b").alias("_b"),
    )
    return table.where(F.col("_a") & F.col("_b")).drop("_a", "_b")


def paired_delta(results: DataFrame, method: str = AWARE_METHOD, order: Sequence[str] = METHODS) -> DataFrame:
    return method_deltas(results, [(method, b) for b in order if b != method])


def ablation_delta(results: DataFrame, full: str = ABLATIONS[0], order: Sequence[str] = ABLATIONS) -> DataFrame:
    return method_deltas(results, [(v, full) for v in order if v != full])


def selection_frequency(selected: DataFrame) -> DataFrame:
    """How often, and how early, each feature was chosen."""
    return selected.groupBy("dataset", "method", "feature").agg(
        F.count(F.lit(1)).alias("selected_count"), F.avg("rank").alias("mean_rank"),
        F.bool_or("is_injected_leakage").alias("is_injected_leakage"),
    )


def ordered_frequency(frequency: DataFrame, order: Sequence[str] = METHODS) -> DataFrame:
    """The frequency table in its published order; ``position`` counts from 1."""
    by = [F.col("dataset"), method_order(order), F.col("selected_count").desc(), F.col("mean_rank"), F.col("feature")]
    return number_rows(frequency, [], by, "position").orderBy("position")


def semantic_summary(raw: DataFrame) -> DataFrame:
    """Means over prompts and seeds per feature, split by role, provider and model where these are columns."""
    by = ["dataset", "feature", *[c for c in ("scoring_role", "provider", "model") if c in raw.columns]]
    return raw.groupBy(*by).agg(
        F.avg("semantic_relevance").alias("semantic_relevance_mean"),
        F.avg("prediction_time_availability").alias("availability_mean"),
        F.avg("leakage_risk").alias("leakage_risk_mean"),
        F.stddev_samp("leakage_risk").alias("leakage_risk_std"),
        F.count("prompt_variant").alias("prompt_count"),
    )


def case_study(selected: DataFrame, summary: DataFrame, method: str = AWARE_METHOD) -> DataFrame:
    """Leaks that a statistical method chose, and whether ``method`` chose them in the same seed.

    Without such leaks the table is empty but has its columns.
    """
    keys = ["dataset", "seed", "feature"]
    chosen = selected.where(F.col("method").isin(list(STAT_METHODS.values())) & F.col("is_injected_leakage"))
    also = selected.where(F.col("method") == method).select(*keys).distinct().withColumn("_also", F.lit(True))
    means = ["semantic_relevance_mean", "availability_mean", "leakage_risk_mean", "leakage_risk_std"]
    judged = chosen.join(also, keys, "left").withColumn(
        "aware_decision", F.when(F.col("_also"), "Select").otherwise("Reject")
    )
    told = judged.join(summary.select("dataset", "feature", *means), ["dataset", "feature"], "left")
    return told.select("dataset", "seed", "method", "feature", "rank", "aware_decision", *means)


def reproducibility_row(results: DataFrame, order: Sequence[str] = METHODS) -> DataFrame:
    """Datasets, seeds, scorer assignments and row count of a run in one row."""
    def joined(c: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ";")

    # Distinct first: what is gathered is one entry per dataset, seed and method of the run.
    runs = results.groupBy("dataset", "seed", "method", "llm_provider", "llm_model").agg(F.count(F.lit(1)).alias("_n"))
    scored = F.when(
        F.col("llm_provider") != "none",
        F.struct(method_order(order).alias("o"), F.concat_ws("", "method", F.lit("="), "llm_provider", F.lit("/"), "llm_model").alias("t")),
    )
    return runs.agg(
        joined(F.col("dataset")).alias("datasets"), F.lit(";".join(order)).alias("methods"),
        joined(F.col("seed")).alias("seeds"), F.sum("_n").alias("n_rows"),
        F.array_join(F.sort_array(F.collect_set(scored))["t"], ";").alias("llm_assignments"),
    )


def leaky_vs_clean(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset", "method").agg(
        F.avg("leaky_auroc").alias("leaky_auroc"), F.avg("clean_auroc").alias("clean_auroc")
    )


def bar_input(results: DataFrame, metric: str) -> DataFrame:
    return results.groupBy("dataset", "method").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def macro_average(results: DataFrame, metrics: Sequence[str] = MAIN_METRICS) -> DataFrame:
    """Mean over datasets of the datasets' means: every dataset counts the same."""
    per_dataset = results.groupBy("dataset", "method").agg(*[F.avg(m).alias(m) for m in metrics])
    return per_dataset.groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_datasets"))


def report_cut(table: DataFrame, order: Sequence[str], rows: int = TABLE_ROWS) -> DataFrame:
    """The first rows of a report table, its floats as text with three decimals."""
    cut = table.orderBy(*order).limit(rows)
    return cut.select(*[
        three_places(F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
        for f in table.schema
    ])
