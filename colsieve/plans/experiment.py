"""Composed runs: main comparison, ablations, prompt stability, interactive analysis."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from colsieve.operators import inject, metrics, profile, select, semantic, stats
from colsieve.operators.prep import Encoder, fit_encoder
from colsieve.operators.split import stratified_split, with_seeds
from colsieve.plans.settle import settle
from colsieve.sources.snapshots import LabelledTable


# Number of the greater of two labels, and so the place of its probability.
GREATER = 1
FITS_AT_ONCE = 4


@dataclass(frozen=True)
class RunSettings:
    seeds: Sequence[int] = (1, 2, 3, 4, 5)
    train: float = 0.6
    validation: float = 0.2
    test: float = 0.2
    k_ratio: float = select.K_RATIO
    weights: select.Weights = field(default_factory=select.Weights)
    trees: int = stats.TREES
    max_depth: int = stats.MAX_DEPTH


@dataclass(frozen=True)
class RunResult:
    metrics: DataFrame
    selected: DataFrame
    semantic: DataFrame


def offline_semantic(catalog: DataFrame, prompts: Sequence[semantic.Prompt] = semantic.PROMPTS) -> DataFrame:
    """Raw semantic rows of the name rules for both roles.

    The relevance-only prompts serve the relevance ranking, the others the leakage-aware one.
    """
    only = semantic.relevance_only_names(prompts)
    rules = semantic.name_rules(semantic.prompt_jobs(catalog.select("dataset", "feature", "description"), prompts), only)
    role = F.when(F.col("prompt_variant").isin(only), select.RELEVANCE_METHOD).otherwise(select.AWARE_METHOD)
    return rules.drop("description").withColumns({
        "scoring_role": role, "provider": F.lit("rules"), "model": F.lit("names"),
    })


def role_scores(raw: DataFrame, role: str, seeds: Sequence[int]) -> DataFrame:
    """One role's scores over its prompts, for every seed: they do not depend on the seed, so they are made once."""
    return with_seeds(semantic.aggregate_prompts(raw.where(F.col("scoring_role") == role), ["dataset"]), seeds)


def at_once(tasks: Sequence[Callable]) -> list:
    """Results of Spark work that waits on the driver, a few tasks at the same time so that the cluster is never idle between jobs."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda task: inheritable_thread_target(task)(), tasks))


def _with_target(table: LabelledTable) -> LabelledTable:
    """Rows without a target are left out before anything is split or fitted."""
    return replace(table, rows=profile.drop_null_target(table.rows, table.spec.target))


def _greatest_label(table: LabelledTable) -> Column:
    """The target as 0/1; text order of the two labels decides."""
    label = F.col(table.spec.target).cast("string")
    ends = table.rows.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        raise ValueError("the target needs two classes")
    if not table.rows.where(label.isNotNull() & ~label.isin(ends["low"], ends["high"])).limit(1).isEmpty():
        raise ValueError("a run compares two classes; make the target binary first")
    return (label == ends["high"]).cast("int")


@dataclass(frozen=True)
class SeedRows:
    """What one seed's fits need: encoded training rows and the raw rows of both parts."""

    train: DataFrame
    test: DataFrame
    encoder: Encoder
    plain: stats.Prepared


def seed_rows(table: LabelledTable, split: DataFrame, seed: int) -> SeedRows:
    """One encoder per seed serves all scorers and all refits; subsets of features are cut out of its vectors."""
    own = split.where(F.col("seed") == seed)
    train, test = (own.where(F.col("part") == part) for part in ("train", "test"))
    encoder = fit_encoder(train, table.features, scale_numeric=True)
    plain = stats.prepare(train, table.features, table.spec.target, encoder=encoder.unscaled())
    return SeedRows(train, test, encoder, plain)


def _seeds(table: LabelledTable, settings: RunSettings) -> dict[int, SeedRows]:
    spec = table.spec
    split = stratified_split(
        table.rows, spec.target, spec.row_id, settings.seeds, settings.train, settings.validation, settings.test
    )
    return {seed: seed_rows(table, split, seed) for seed in settings.seeds}


def stat_table(table: LabelledTable, seeds: Mapping[int, SeedRows], settings: RunSettings, forest_only: bool = False) -> DataFrame:
    """Scores of all scorers and seeds. Both logistic fits read the same prepared rows."""
    spec = table.spec

    def one(seed: int, rows: SeedRows) -> list[DataFrame]:
        found = [stats.forest_importances(rows.plain, spec.name, seed, settings.trees, settings.max_depth)]
        if not forest_only:
            scaled = stats.prepare(rows.train, table.features, spec.target, encoder=rows.encoder)
            found += [stats.logistic_importances(scaled, p, spec.name, seed) for p in ("l2", "l1")]
        return found

    found = [df for part in at_once([partial(one, *item) for item in seeds.items()]) for df in part]
    return settle(stats.normalise_scorers(reduce(lambda a, b: a.unionByName(b), found)))


def encode_test(test: Mapping[str, DataFrame], label: Column, row_id: str, encoder: Encoder) -> DataFrame:
    """(setting, row_id, label, features) of the test rows under every setting, written once for all models."""
    both = reduce(lambda a, b: a.unionByName(b), [df.withColumn("setting", F.lit(s)) for s, df in test.items()])
    encoded = encoder.transform(both.withColumn("label", label))
    return settle(encoded.select("setting", F.col(row_id).cast("string").alias("row_id"), "label", "features"))


def fit_and_predict(
    train: stats.Prepared, test: DataFrame, features: Sequence[str], seed: int, trees: int, max_depth: int
) -> DataFrame:
    """Fit one forest on the chosen features and score the encoded test rows of all settings with it."""
    model = stats.forest(seed, trees, max_depth).fit(train.only(features))
    scored = model.transform(stats.slice_features(test, train.encoder, features))
    return scored.select(
        "setting", "row_id", "label", F.col("prediction").cast("int").alias("pred"),
        F.get(vector_to_array("probability"), F.lit(GREATER)).alias("score"),
    )


def predictions(
    table: LabelledTable, seeds: Mapping[int, SeedRows], rankings: DataFrame, settings: RunSettings, label: Column
) -> DataFrame:
    """(dataset, seed, method, setting, row_id, label, pred, score) of every method and seed.

    Methods that chose the same features in a seed share one fit. The model is
    trained on rows with the leaks in them; only the test rows are masked.
    """
    spec = table.spec
    lists: dict[tuple[int, tuple[str, ...]], list[str]] = {}
    for r in select.selected_lists(rankings).collect():
        lists.setdefault((r["seed"], tuple(sorted(r["selected_features"]))), []).append(r["method"])

    def encoded(rows: SeedRows) -> DataFrame:
        masks = inject.mask_values(rows.train, table.leaks)
        shown = {"leaky": rows.test, "clean": inject.apply_mask(rows.test, masks)}
        return encode_test(shown, label, spec.row_id, rows.plain.encoder)

    def scored(seed: int, features: tuple[str, ...], methods: list[str]) -> DataFrame:
        one = fit_and_predict(seeds[seed].plain, tests[seed], features, seed, settings.trees, settings.max_depth)
        return one.select(
            F.lit(spec.name).alias("dataset"), F.lit(seed).alias("seed"),
            F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), "*",
        )

    tests = dict(zip(seeds, at_once([partial(encoded, rows) for rows in seeds.values()]), strict=True))
    fits = [partial(scored, seed, features, methods) for (seed, features), methods in sorted(lists.items()) if seed in seeds]
    return reduce(lambda a, b: a.unionByName(b), at_once(fits))


def _finish(
    table: LabelledTable, seeds: Mapping[int, SeedRows], scores: DataFrame, raw: DataFrame, settings: RunSettings,
    scorers: Mapping[str, tuple[str, str]], label: Column,
) -> RunResult:
    budget = settle(select.budgets(table.catalog, settings.k_ratio))
    leaks = table.catalog.where("is_injected_leakage")
    rankings = settle(select.rank_methods(scores, budget, leaks))
    chosen = select.top_k(rankings)
    measured = metrics.classification_metrics(predictions(table, seeds, rankings, settings, label))
    rows = metrics.metric_rows(metrics.by_setting(measured), metrics.leak_selection(chosen, budget), budget, scorers)
    names = F.create_map(*[F.lit(x) for m, (p, n) in scorers.items() for x in (m, F.struct(F.lit(p.lower()).alias("p"), F.lit(n).alias("n")))])
    who = F.element_at(names, F.col("method"))
    selected = chosen.select(
        "dataset", "seed", "method", F.coalesce(who["p"], F.lit("none")).alias("llm_provider"),
        F.coalesce(who["n"], F.lit("none")).alias("llm_model"), "rank", "feature", "is_injected_leakage",
    )
    return RunResult(settle(rows), selected, with_seeds(raw, settings.seeds))


def _scorer_of(raw: DataFrame, role: str) -> tuple[str, str]:
    row = raw.where(F.col("scoring_role") == role).select("provider", "model").first()
    return (row["provider"], row["model"]) if row else ("none", "none")


def run_main(table: LabelledTable, raw: DataFrame, settings: RunSettings = RunSettings()) -> RunResult:
    """Five methods over all seeds. ``raw``: semantic rows with scoring_role, provider and model.

    Fits are separate Spark jobs, several at the same time; everything before and after them is one job for all
    seeds and methods.
    """
    table = _with_target(table)
    label, seeds = _greatest_label(table), _seeds(table, settings)
    stat = stat_table(table, seeds, settings)
    relevance = role_scores(raw, select.RELEVANCE_METHOD, settings.seeds)
    aware = role_scores(raw, select.AWARE_METHOD, settings.seeds)
    scores = reduce(lambda a, b: a.unionByName(b), [
        select.stat_method_scores(stat),
        select.relevance_scores(relevance),
        select.aware_scores(stat.where(F.col("scorer") == "forest"), aware, {select.AWARE_METHOD: settings.weights}),
    ])
    scorers = {m: _scorer_of(raw, m) for m in (select.RELEVANCE_METHOD, select.AWARE_METHOD)}
    return _finish(table, seeds, scores, raw, settings, scorers, label)


def run_ablation(table: LabelledTable, raw: DataFrame, settings: RunSettings = RunSettings()) -> RunResult:
    """The full leakage-aware score and its variants; all weight sets are ranked in one pass."""
    table = _with_target(table)
    label, seeds = _greatest_label(table), _seeds(table, settings)
    stat = stat_table(table, seeds, settings, forest_only=True)
    own = raw.where(F.col("scoring_role") == select.AWARE_METHOD)
    variants = select.ablations(settings.weights)
    scores = select.aware_scores(stat, role_scores(own, select.AWARE_METHOD, settings.seeds), variants)
    scorer = _scorer_of(raw, select.AWARE_METHOD)
    return _finish(table, seeds, scores, own, settings, {v: scorer for v in variants}, label)


def rankings_by_prompt(
    stat: DataFrame, raw: DataFrame, budget: DataFrame, seeds: Sequence[int], weights: select.Weights = select.Weights()
) -> DataFrame:
    """Rankings as if each prompt were the only one; the raw scores are filtered, nothing is scored again."""
    keys = ["dataset", "prompt_variant", "seed"]
    per_prompt = with_seeds(semantic.aggregate_prompts(raw, ["dataset", "prompt_variant"]), seeds)
    prompts = [r[0] for r in raw.select("prompt_variant").distinct().orderBy("prompt_variant").collect()]
    copies = stat.withColumn("prompt_variant", F.explode(F.array(*[F.lit(p) for p in prompts])))
    scores = reduce(lambda a, b: a.unionByName(b), [
        select.stat_method_scores(copies, keys=keys),
        select.relevance_scores(per_prompt, keys=keys),
        select.aware_scores(
            copies.where(F.col("scorer") == "forest"), per_prompt, {select.AWARE_METHOD: weights}, keys
        ),
    ])
    return select.rank_methods(scores, budget, by=[*keys, "method"])


def prompt_stability(rankings: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard of the chosen features over the seeds, per prompt and method."""
    return metrics.mean_pairwise_jaccard(select.top_k(rankings), ["dataset", "prompt_variant", "method"])


def analyze(
    df: DataFrame,
    target: str,
    row_id: str,
    name: str = "table",
    k_ratio: float = select.K_RATIO,
    external: DataFrame | None = None,
    trees: int = stats.TREES,
    max_depth: int = stats.MAX_DEPTH,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(summary, rankings) of one table: clean, score, hold against the name rules, rank.

    ``external``: (feature, semantic_relevance, leakage_risk, availability,
    uncertainty, reason) of an outside scorer, held up by the guardrail.
    """
    profile.require_column(df, target)
    rows = profile.drop_null_target(df, target)
    profile.require_two_classes(rows, target)
    classes = profile.class_list(rows, target).agg(F.sort_array(F.collect_list("class")).alias("target_classes"))
    clean = profile.drop_constant(rows, profile.feature_names(rows, target, row_id))
    features = profile.feature_names(clean, target, row_id)
    if not features:
        raise ValueError("no usable column is left after cleaning")
    found = stats.forest_importances(stats.prepare(clean, features, target), name, seed, trees, max_depth)
    scores = settle(stats.normalise_scorers(found, strict=True))
    aim = F.lit(target)
    if external is None:
        judged = semantic.floor_rules(scores, aim)
    else:
        told = external.withColumn("dataset", F.lit(name))
        judged = semantic.blend_external(scores, told, ["dataset"], aim)
    k = select.k_from_ratio(F.lit(len(features)), k_ratio, least=select.LEAST_RATIO)
    ranked = settle(select.rank_interactive(select.interactive_scores(scores, judged), k))
    shown = [
        "rank", "feature", "selected", "stat_score", F.col("importance").alias("forest_importance"),
        "semantic_relevance", "leakage_risk", "availability", "uncertainty", "aware_score", "reason",
    ]
    rankings = ranked.select("dataset", "method", *shown)
    # One entry per column of the table and method.
    lists = rankings.groupBy("dataset", "method").agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in rankings.columns if c not in ("dataset", "method")]))).alias("rankings")
    )
    methods = lists.groupBy("dataset").agg(
        F.sort_array(F.collect_list(F.struct(
            "method",
            F.transform(F.filter("rankings", lambda r: r["selected"]), lambda r: r["feature"]).alias("selected_features"),
            "rankings",
        ))).alias("methods")
    )
    summary = methods.join(classes.withColumn("dataset", F.lit(name)), "dataset").select(
        "dataset", F.lit(target).alias("target"), F.lit(rows.count()).alias("rows"),
        F.lit(len(features)).alias("feature_count"), k.alias("selected_count"),
        "target_classes",
        F.lit("offline" if external is None else "external+rules").alias("scoring_mode"), "methods",
    )
    return summary, rankings
