"""Prediction metrics, leak selection, stability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colsieve.operators.select import AWARE_METHOD, RELEVANCE_METHOD
from colsieve.plans.buckets import ONE_TASK_ROWS, needs_buckets, order_buckets
from colsieve.plans.settle import attach, match, settle

CELL = ("dataset", "seed", "method", "setting")
RUN = ("dataset", "seed", "method")


def _outcomes() -> list[Column]:
    label, pred = F.col("label") == 1, F.col("pred") == 1
    return [
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == F.col("pred")).alias("_correct"),
        F.count_if(label & pred).alias("_tp"), F.count_if(label | pred).alias("_any"),
    ]


def _accuracy_f1(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    # 2tp / (2tp + fp + fn), where tp + fp + fn are the rows that are 1 on either side.
    f1 = F.try_divide(2.0 * F.col("_tp"), (F.col("_tp") + F.col("_any")).cast("double"))
    return outcomes.select(
        *by, "n_rows", (F.col("_correct") / F.col("n_rows")).alias("accuracy"), F.coalesce(f1, F.lit(0.0)).alias("f1")
    )


def accuracy_f1(predictions: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Accuracy, and F1 of class 1 (0 if there is nothing to find or found).

    Labels and predictions are taken as the 0/1 they are; a model that predicts
    one class only is not re-coded.
    """
    return _accuracy_f1(predictions.groupBy(*by).agg(*_outcomes()), by)


def score_counts(predictions: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Class counts per group and distinct score, written once. Everything else is derived from them."""
    counts = [F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg")]
    if "pred" in predictions.columns:
        counts += _outcomes()
    return settle(predictions.groupBy(*by, "score").agg(*counts))


def _running(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Class counts above each score within its group."""
    above = Window.partitionBy(*group).orderBy(F.col("score").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({
        "pos_above": F.coalesce(F.sum("pos").over(above), F.lit(0)),
        "neg_above": F.coalesce(F.sum("neg").over(above), F.lit(0)),
    })


def score_curve(counts: DataFrame, by: Sequence[str] = CELL, limit: int = ONE_TASK_ROWS) -> DataFrame:
    """One row per group and distinct score: class counts here and above the score.

    A missing score is below all others, NaN above them.
    If a group is too large for one task, running totals are taken inside buckets
    of the score and each bucket adds the totals of the buckets above it.
    """
    by = list(by)
    columns = [*by, "score", "pos", "neg", "pos_above", "neg_above"]
    rows = needs_buckets(counts, by, limit)
    if not rows:
        return _running(counts, by).select(*columns)
    cut = order_buckets(counts, "score", rows, limit, by)
    totals = cut.groupBy(*by, "_bucket").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    higher = Window.partitionBy(*by).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket",
        F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_p_higher"),
        F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_n_higher"),
    )
    placed = attach(_running(cut, [*by, "_bucket"]), offsets, [*by, "_bucket"], "inner")
    return placed.withColumns({
        "pos_above": F.col("pos_above") + F.col("_p_higher"), "neg_above": F.col("neg_above") + F.col("_n_higher"),
    }).select(*columns)


def _ranking_metrics(counts: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    curve = score_curve(counts, by, limit)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # Pairs in which the negative scores higher, or the same (half).
    losses = pos * (F.col("neg_above").cast("double") + neg / 2.0)
    tp = F.col("pos_above").cast("double") + pos
    seen = tp + F.col("neg_above").cast("double") + neg
    sums = curve.groupBy(*by).agg(
        F.sum(losses).alias("_losses"), F.sum(pos * tp / seen).alias("_ap"),
        F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"),
    )
    pairs = F.col("_p") * F.col("_n")
    return sums.select(
        *by,
        F.when(pairs > 0, (pairs - F.col("_losses")) / pairs).alias("auroc"),
        F.when(pairs > 0, F.col("_ap") / F.col("_p")).alias("auprc"),
    )


def ranking_metrics(predictions: DataFrame, by: Sequence[str] = CELL, limit: int = ONE_TASK_ROWS) -> DataFrame:
    """Exact AUROC (equal scores count half) and average precision; null if a group has one class only."""
    return _ranking_metrics(score_counts(predictions.drop("pred"), by), by, limit)


def classification_metrics(predictions: DataFrame, by: Sequence[str] = CELL, limit: int = ONE_TASK_ROWS) -> DataFrame:
    """All four metrics from one pass over the predictions."""
    counts = score_counts(predictions, by)
    outcomes = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_rows", "_correct", "_tp", "_any")])
    return match(_accuracy_f1(outcomes, by), _ranking_metrics(counts, by, limit), by, "left")


def leak_selection(selected: DataFrame, n_injected: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Leaks among the chosen features: count, share of the chosen, share of all injected."""
    counted = selected.groupBy(*by).agg(
        F.count_if("is_injected_leakage").cast("double").alias("selected_leakage_count"),
        F.count(F.lit(1)).cast("double").alias("_chosen"),
    )
    known = match(counted, n_injected.select("dataset", "n_injected_features"), ["dataset"], "left")
    injected = F.coalesce(F.col("n_injected_features").cast("double"), F.lit(0.0))
    hits = F.col("selected_leakage_count")
    return known.select(
        *by, "selected_leakage_count",
        (hits / F.greatest(F.lit(1.0), F.col("_chosen"))).alias("selected_leakage_ratio"),
        (hits / F.greatest(F.lit(1.0), injected)).alias("injected_leakage_recall"),
    )


def by_setting(metrics: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Leaky and clean metrics side by side, and how much AUROC falls between them."""
    def of(setting: str, metric: str) -> Column:
        return F.max(F.when(F.col("setting") == setting, F.col(metric))).alias(f"{setting}_{metric}")

    wide = metrics.groupBy(*by).agg(*[of(s, m) for s in ("leaky", "clean") for m in ("auroc", "f1")])
    return wide.withColumn("deployment_drop", F.col("leaky_auroc") - F.col("clean_auroc"))


def metric_rows(
    settings: DataFrame,
    leaks: DataFrame,
    budget: DataFrame,
    scorers: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One result row per dataset, seed and method. ``scorers``: method -> (provider, model)."""
    scorers = scorers if scorers is not None else {m: ("rules", "names") for m in (RELEVANCE_METHOD, AWARE_METHOD)}
    provider, model = F.lit("none"), F.lit("none")
    for method, (p, m) in scorers.items():
        provider = F.when(F.col("method") == method, p.lower()).otherwise(provider)
        model = F.when(F.col("method") == method, m).otherwise(model)
    rows = match(settings, leaks, list(RUN), "inner")
    rows = match(rows, budget.select("dataset", "n_original_features", "n_injected_features", "k"), ["dataset"], "inner")
    return rows.select(
        "dataset", "seed", "method", provider.alias("llm_provider"), model.alias("llm_model"),
        "n_original_features", "n_injected_features", F.lit("original_features").alias("k_basis"), "k",
        "leaky_auroc", "leaky_f1", "clean_auroc", "clean_f1", "deployment_drop",
        "selected_leakage_count", "selected_leakage_ratio", "injected_leakage_recall",
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets given as arrays; two empty sets are the same."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def mean_pairwise_jaccard(selected: DataFrame, by: Sequence[str], run: str = "seed") -> DataFrame:
    """Mean Jaccard over all pairs of runs; 1 for a single run.

    The runs of a group are the configured seeds or prompts and a set is as long
    as the budget, so a group is small whatever the size of the tables. Pairs
    are walked inside one array and never become rows.
    """
    sets = selected.groupBy(*by, run).agg(F.collect_set("feature").alias("_set"))
    groups = sets.groupBy(*by).agg(F.collect_list("_set").alias("_sets"), F.count(F.lit(1)).alias("n_runs"))
    later = lambda i: F.slice(F.col("_sets"), i + 2, F.greatest(F.col("n_runs").cast("int") - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform("_sets", lambda a, i: F.transform(later(i), lambda b: jaccard(a, b))))
    total = F.aggregate("_pairs", F.lit(0.0), lambda t, x: t + x)
    return groups.withColumn("_pairs", pairs).select(
        *by, "n_runs", F.when(F.size("_pairs") == 0, 1.0).otherwise(total / F.size("_pairs")).alias("mean_jaccard")
    )
