"""Budgets, method scores, rankings and the views made of them.

Scores and rankings are long tables keyed by (dataset, seed, method, feature), so
many tables, seeds and methods are one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from colsieve.functions.scores import unit_clip
from colsieve.plans.ranking import number_rows
from colsieve.plans.settle import match

K_RATIO = 0.4
LEAST_RATIO = 0.05
STAT_METHODS = {"forest": "tfs_rf", "logreg": "tfs_logreg", "lasso": "tfs_lasso"}
RELEVANCE_METHOD = "semantic_only"
AWARE_METHOD = "leakage_aware"
METHODS = (*STAT_METHODS.values(), RELEVANCE_METHOD, AWARE_METHOD)
GROUP = ("dataset", "seed", "method")


@dataclass(frozen=True)
class Weights:
    """Fixed default weights of the leakage-aware score."""

    stat: float = 0.6
    relevance: float = 0.4
    risk: float = 0.5
    unavailable: float = 0.3
    uncertainty: float = 0.2


def ablations(base: Weights = Weights()) -> dict[str, Weights]:
    """The full score and one variant without each of its penalties."""
    return {
        "full": base,
        "no_leakage": replace(base, risk=0.0),
        "no_availability": replace(base, unavailable=0.0),
        "no_uncertainty": replace(base, uncertainty=0.0),
    }


ABLATIONS = tuple(ablations())


def k_from_ratio(n: Column, ratio: float = K_RATIO, k: int | None = None, least: float | None = None) -> Column:
    """How many of ``n`` columns to take: ceil(n * ratio) or ``k``, at least 1, at most all."""
    if least is not None:
        ratio = min(max(float(ratio), least), 1.0)
    wanted = F.ceil(n * F.lit(float(ratio))) if k is None else F.lit(int(k))
    return F.greatest(F.lit(1), F.least(n, wanted)).cast("int")


def budgets(catalog: DataFrame, ratio: float = K_RATIO, k: int | None = None, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Budget per table from its original columns; injected ones do not count."""
    counted = catalog.groupBy(*by).agg(
        F.count_if(~F.col("is_injected_leakage")).cast("int").alias("n_original_features"),
        F.count_if(F.col("is_injected_leakage")).cast("int").alias("n_injected_features"),
    )
    original = F.when(
        F.col("n_original_features") < 1, F.raise_error(F.lit("a table needs at least one column that was not injected"))
    ).otherwise(F.col("n_original_features"))
    return counted.withColumn("k", k_from_ratio(original, ratio, k))


def stat_method_scores(
    stat: DataFrame, methods: Mapping[str, str] = STAT_METHODS, keys: Sequence[str] = ("dataset", "seed")
) -> DataFrame:
    """(keys, method, feature, score) of the statistical methods."""
    names = F.create_map(*[F.lit(x) for pair in methods.items() for x in pair])
    chosen = stat.where(F.col("scorer").isin(list(methods)))
    method = F.element_at(names, F.col("scorer")).alias("method")
    return chosen.select(*keys, method, "feature", F.col("stat_score").alias("score"))


def relevance_scores(
    semantic: DataFrame, method: str = RELEVANCE_METHOD, keys: Sequence[str] = ("dataset", "seed")
) -> DataFrame:
    return semantic.select(
        *keys, F.lit(method).alias("method"), "feature",
        unit_clip(F.col("avg_semantic_relevance")).alias("score"),
    )


def _blend(w: Column, stat: Column, relevance: Column, risk: Column, available: Column, uncertainty: Column) -> Column:
    return (
        w["stat"] * stat + w["relevance"] * relevance - w["risk"] * risk
        - w["unavailable"] * (F.lit(1.0) - available) - w["uncertainty"] * uncertainty
    )


def _weight_struct(method: str, weights: Weights) -> Column:
    return F.struct(F.lit(method).alias("method"), *[F.lit(float(v)).alias(n) for n, v in asdict(weights).items()])


def aware_scores(
    stat: DataFrame,
    semantic: DataFrame,
    variants: Mapping[str, Weights] | None = None,
    keys: Sequence[str] = ("dataset", "seed"),
) -> DataFrame:
    """Leakage-aware score of every feature under every weight set, in one pass.

    The join is full: a feature that one side lacks gets zeros there, so without
    semantic scores it counts as unavailable and pays that penalty in full.
    """
    variants = variants or {AWARE_METHOD: Weights()}
    on = [*keys, "feature"]
    left = stat.select(*on, "stat_score")
    right = semantic.select(*on, "avg_semantic_relevance", "avg_availability", "avg_leakage_risk", "uncertainty")
    both = left.join(right, on, "full")
    weighed = both.withColumn("_w", F.explode(F.array(*[_weight_struct(m, w) for m, w in variants.items()])))
    score = _blend(
        F.col("_w"), *[unit_clip(F.col(c)) for c in (
            "stat_score", "avg_semantic_relevance", "avg_leakage_risk", "avg_availability", "uncertainty"
        )]
    )
    return weighed.select(*keys, F.col("_w.method").alias("method"), "feature", score.alias("score"))


def rank_methods(
    scores: DataFrame, budget: DataFrame, leaks: DataFrame | None = None, by: Sequence[str] = GROUP, decimals: int | None = None
) -> DataFrame:
    """Rank by score, equal scores by name; mark the first k. ``leaks``: (dataset, feature) of injected columns."""
    if decimals is not None:
        scores = scores.withColumn("score", F.round("score", decimals))
    ranked = number_rows(scores, by, [F.col("score").desc(), F.col("feature").asc()])
    marked = match(ranked, budget.select("dataset", "k"), ["dataset"], "inner")
    marked = marked.withColumn("selected", F.col("rank") <= F.col("k")).drop("k")
    if leaks is not None:
        flags = leaks.select("dataset", "feature").distinct().withColumn("is_injected_leakage", F.lit(True))
        marked = match(marked, flags, ["dataset", "feature"], "left")
        marked = marked.withColumn("is_injected_leakage", F.coalesce(F.col("is_injected_leakage"), F.lit(False)))
    return marked


def top_k(rankings: DataFrame) -> DataFrame:
    return rankings.where("selected")


def interactive_scores(stat: DataFrame, semantic: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Fixed-weight score of the interactive analysis: features of the statistical side only, six places."""
    on = [*keys, "feature"]
    scores = ["semantic_relevance", "leakage_risk", "availability", "uncertainty"]
    joined = stat.join(semantic.select(*on, *scores, "reason"), on, "left").na.fill(0.0, scores)
    blend = _blend(
        _weight_struct("", Weights()), *[F.col(c) for c in (
            "stat_score", "semantic_relevance", "leakage_risk", "availability", "uncertainty"
        )]
    )
    return joined.withColumn("aware_score", F.round(blend, 6))


def rank_interactive(scores: DataFrame, k: Column | int, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Both rankings of the interactive analysis, one row per method and feature."""
    both = F.array(
        F.struct(F.lit("forest").alias("method"), F.col("stat_score").alias("score")),
        F.struct(F.lit(AWARE_METHOD).alias("method"), F.col("aware_score").alias("score")),
    )
    long = scores.withColumn("_m", F.explode(both)).select("*", "_m.method", "_m.score").drop("_m")
    order = [F.col("score").desc(), F.col("stat_score").desc(), F.col("feature").asc()]
    k = F.lit(k) if isinstance(k, int) else k
    return number_rows(long, [*keys, "method"], order).withColumn("selected", F.col("rank") <= k)


def selected_lists(rankings: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Chosen features in rank order; a list is as long as the table's budget."""
    picked = F.sort_array(F.collect_list(F.struct("rank", "feature")))
    return top_k(rankings).groupBy(*by).agg(picked.alias("_picked")).select(
        *by, F.col("_picked.feature").alias("selected_features")
    )


def side_by_side(rankings: DataFrame, left: str, right: str, by: Sequence[str] = ("dataset", "seed")) -> DataFrame:
    """Chosen features of two methods beside each other by rank, blank where one has none."""
    chosen = top_k(rankings).where(F.col("method").isin(left, right))
    def of(method: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("method") == method, F.col("feature"))), F.lit(""))
    return chosen.groupBy(*by, "rank").agg(of(left).alias(left), of(right).alias(right))


def severity(risk: Column) -> Column:
    return F.when(risk > 0.8, "high").when(risk > 0.4, "medium").otherwise("low")


def first_ranks(rankings: DataFrame, n: int = 12) -> DataFrame:
    return rankings.where(F.col("rank") <= n)
