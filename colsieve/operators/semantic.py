"""Scores from a column's name and description: relevance, availability, leakage risk."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from colsieve.functions.hashing import cache_key, packed, unpacked
from colsieve.functions.scores import unit_clip
from colsieve.functions.tokens import (
    DISGUISED_TERM_SETS, GUARDRAIL_TERMS, IDENTIFIER_NAME_PARTS, RISKY_NAME_TERMS, SIGNAL_NAME_PARTS,
    holds_part, tokens, words,
)


class Prompt(NamedTuple):
    """A question about one column, with {task_description}, {feature_name}, {feature_description}."""

    name: str
    template: str
    relevance_only: bool = False


_REPLY = (
    ' Reply with one JSON object: {{"semantic_relevance": 0.0, "prediction_time_availability": 0.0,'
    ' "leakage_risk": 0.0, "reason": "one sentence"}}, each number between 0 and 1.'
)
_COLUMN = "Task: {task_description}\nColumn: {feature_name}\nMeaning: {feature_description}\n"
PROMPTS = (
    Prompt("leakage", _COLUMN + "How useful is this column, is it known when predicting, may it leak the answer?" + _REPLY),
    Prompt("leakage_audit", _COLUMN + "As an auditor: could this column only be filled after the outcome?" + _REPLY),
    Prompt("leakage_live", _COLUMN + "The model runs live: would this column be filled at that moment?" + _REPLY),
    Prompt(
        "relevance",
        _COLUMN + 'How well does this column explain the target? Reply with one JSON object:'
        ' {{"semantic_relevance": 0.0, "reason": "one sentence"}}, the number between 0 and 1.',
        relevance_only=True,
    ),
)


def relevance_only_names(prompts: Sequence[Prompt] = PROMPTS) -> list[str]:
    return [p.name for p in prompts if p.relevance_only]


def prompt_jobs(catalog: DataFrame, prompts: Sequence[Prompt] = PROMPTS) -> DataFrame:
    """One row per feature and prompt; the prompts are a short list, so no join is needed."""
    return catalog.withColumn("prompt_variant", F.explode(F.array(*[F.lit(p.name) for p in prompts])))


def _filled(template: str, task: Column) -> Column:
    columns = {
        "task_description": task, "feature_name": F.col("feature"), "feature_description": F.col("description"),
    }
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(columns[name], F.lit("")))
    return F.concat(*parts)


def render_prompts(jobs: DataFrame, task: Column, prompts: Sequence[Prompt] = PROMPTS) -> DataFrame:
    """Fill the templates in one pass; braces inside names and texts stay as they are."""
    text = F.lit(None).cast("string")
    for p in prompts:
        text = F.when(F.col("prompt_variant") == p.name, _filled(p.template, task)).otherwise(text)
    return jobs.withColumn("prompt", text)


def with_cache_keys(
    jobs: DataFrame,
    provider: str,
    model: str,
    temperature: float | None = 0.0,
    thinking_mode: str | None = None,
    legacy_provider: str | None = None,
) -> DataFrame:
    """Add ``score_key`` and, for the one provider with older entries, ``legacy_key`` (no provider in it)."""
    asked = [F.col("dataset"), F.col("feature"), F.col("description"), F.col("prompt_variant")]
    settings = [model, temperature, thinking_mode]
    old = cache_key("semantic_score", *asked, *settings)
    has_old = legacy_provider is not None and provider.lower() == legacy_provider.lower()
    return jobs.withColumns({
        "score_key": cache_key("semantic_score", *asked, provider.lower(), *settings),
        "legacy_key": old if has_old else F.lit(None).cast("string"),
    })


def _older_key() -> Column:
    """The job's legacy key. Jobs without one go by a key that no entry has, each its own, so that they don't meet in one task."""
    return F.coalesce("legacy_key", F.concat(F.lit("-"), "score_key"))


def cache_misses(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs without an entry under either key. Only keys of the cache are read; an anti join needs them once or more often.
    Keys move as bytes, and a job's own key is told from them again. Entries' bytes are said to be never null, or Spark would
    make them once more to look for nulls."""
    entries = cache.where(F.col("score_key").isNotNull())
    known = entries.select(F.coalesce(packed(F.col("score_key")), F.lit(b"")).alias("_known")).hint("merge")
    held = jobs.withColumn("score_key", packed(F.col("score_key")))
    fresh = held.join(known, F.col("score_key") == F.col("_known"), "left_anti").withColumn("score_key", unpacked(F.col("score_key")))
    older = F.col("legacy_key").isNotNull() & (packed(_older_key()) == F.col("_known"))
    return fresh.join(known, older, "left_anti").select(*jobs.columns)


def cache_lookup(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Each job with its cached score and ``hit``: 'current', 'legacy' or 'miss'.

    Keys are hashes, so both joins spread evenly however large one table's catalogue is. A cache is about as large as
    the jobs it serves, whatever its source's size lets Spark expect, so it is never sent whole to every executor. Keys move
    as bytes, and the jobs' are told from them again. Where no job has a legacy key, the second condition is false and Spark leaves
    that join out.
    """
    scores = [c for c in cache.columns if c != "score_key"]
    known = cache.where(F.col("score_key").isNotNull()).select(F.coalesce(packed(F.col("score_key")), F.lit(b"")).alias("_known"), F.struct(*scores).alias("_scores"))
    entries, older = [known.withColumnRenamed("_scores", name).hint("merge") for name in ("_now", "_old")]
    held = jobs.withColumns({c: packed(F.col(c)) for c in ("score_key", "legacy_key")})
    joined = held.join(entries, F.col("score_key") == F.col("_known"), "left").drop("_known")
    by_older = F.col("legacy_key").isNotNull() & (F.coalesce("legacy_key", F.concat(F.lit(b"-"), "score_key")) == F.col("_known"))
    joined = joined.join(older, by_older, "left").drop("_known").withColumns({c: unpacked(F.col(c)) for c in ("score_key", "legacy_key")})
    chosen = F.coalesce("_now", "_old")
    hit = F.when(F.col("_now").isNotNull(), "current").when(F.col("_old").isNotNull(), "legacy").otherwise("miss")
    return joined.withColumn("hit", hit).withColumns({c: chosen[c] for c in scores}).drop("_now", "_old")


def carried_forward(looked_up: DataFrame, score_columns: Sequence[str]) -> DataFrame:
    """Entries found under the legacy key, to be appended under the current key."""
    return looked_up.where(F.col("hit") == "legacy").select("score_key", *score_columns)


def name_rules(
    jobs: DataFrame,
    relevance_only: Sequence[str] = (),
    risky_terms: Sequence[str] = RISKY_NAME_TERMS,
    signal_parts: Sequence[str] = SIGNAL_NAME_PARTS,
) -> DataFrame:
    """Offline scorer by name alone: risky words in the name decide risk and availability."""
    risky = F.arrays_overlap(tokens(F.col("feature")), words(risky_terms))
    relevance = F.when(risky, 0.9).when(holds_part(F.col("feature"), signal_parts), 0.85).otherwise(0.75)
    plain = F.col("prompt_variant").isin(list(relevance_only)) if relevance_only else F.lit(False)
    return jobs.withColumns({
        "semantic_relevance": relevance,
        "prediction_time_availability": F.when(plain, 1.0).when(risky, 0.15).otherwise(0.85),
        "leakage_risk": F.when(plain, 0.0).when(risky, 0.9).otherwise(0.15),
        "reason": F.when(plain, "Relevance by name only.")
        .when(risky, "The name points to something known after the outcome.")
        .otherwise("The name gives no hint that the value comes late."),
    })


def guardrail(
    feature: Column,
    target: Column,
    terms: Sequence[str] = GUARDRAIL_TERMS,
    disguised: Sequence[Sequence[str]] = DISGUISED_TERM_SETS,
) -> tuple[Column, Column, Column]:
    """(risk floor, sorted hit words, reason). Hits are strong words, words of the
    target's name, or else the words of the first disguised set that is complete."""
    name = tokens(feature)
    strong = F.array_sort(F.array_intersect(name, F.array_union(words(terms), tokens(target))))
    hits = F.when(F.size(strong) > 0, strong)
    for group in disguised:
        whole = F.size(F.array_intersect(name, words(group))) == len(group)
        hits = hits.when(whole, words(sorted(group)))
    hits = hits.otherwise(F.array().cast("array<string>"))
    caught = F.size(hits) > 0
    floor = F.when(caught, 0.9).otherwise(0.12)
    reason = F.when(caught, F.concat(F.lit("The name holds leakage words: "), F.array_join(hits, ", "), F.lit(".")))
    return floor, hits, reason.otherwise("The name holds no leakage words.")


def floor_rules(
    scores: DataFrame, target: Column, identifier_parts: Sequence[str] = IDENTIFIER_NAME_PARTS
) -> DataFrame:
    """Offline scorer of the interactive analysis: guardrail plus the statistical score.

    The identifier test looks for 'id' anywhere in the name, so 'residence' counts too.
    """
    floor, _, reason = guardrail(F.col("feature"), target)
    caught = floor >= 0.8
    by_score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.55) + F.lit(0.45) * F.col("stat_score")))
    relevance = F.when(holds_part(F.col("feature"), identifier_parts), 0.35).otherwise(by_score)
    return scores.withColumns({
        "semantic_relevance": F.round(relevance, 6),
        "leakage_risk": floor,
        "availability": F.when(caught, 0.15).otherwise(0.88),
        "uncertainty": F.when(caught, 0.18).otherwise(0.05),
        "reason": reason,
    })


REPLY_FIELDS = ("semantic_relevance", "leakage_risk", "availability", "uncertainty")


def _reply_items(replies: DataFrame, payload: str) -> Column:
    return F.expr(f"try_variant_get(try_parse_json({payload}), '$.features', 'array<variant>')")


def malformed_replies(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Replies that are no JSON or hold no 'features' list; a run should stop on them."""
    return replies.where(_reply_items(replies, payload).isNull())


def parse_scores(replies: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """One row per feature named in a reply; of repeated features the last item counts.

    Items that are no objects or bear no name are passed over without losing the rest.
    """
    items = replies.select(*keys, F.posexplode(_reply_items(replies, payload)).alias("_pos", "_item"))
    name = F.expr("try_variant_get(_item, '$.feature', 'string')")
    is_text = F.expr("schema_of_variant(try_variant_get(_item, '$.feature', 'variant'))") == "STRING"
    fields = [F.expr(f"try_variant_get(_item, '$.{f}', 'double')").alias(f) for f in REPLY_FIELDS]
    fields.append(F.expr("try_variant_get(_item, '$.reason', 'string')").alias("reason"))
    named = items.select(*keys, "_pos", name.alias("feature"), is_text.alias("_text"), F.struct(*fields).alias("_scores"))
    kept = named.where(F.col("_text") & (F.length("feature") > 0))
    return kept.groupBy(*keys, "feature").agg(F.max_by("_scores", "_pos").alias("_scores")).select(
        *keys, "feature", "_scores.*"
    )


def blend_external(scores: DataFrame, external: DataFrame, keys: Sequence[str], target: Column) -> DataFrame:
    """Outside scores held up by the guardrail; features without one fall back to the offline rules.

    If the guardrail lifts the risk, availability is at most 0.25 and uncertainty at least 0.18.
    """
    own = floor_rules(scores, target)
    # The offline rules' risk and reason are the guardrail's.
    floor, floor_reason = F.col("leakage_risk"), F.col("reason")
    outside = external.select(*keys, "feature", F.struct(*REPLY_FIELDS, "reason").alias("_ext"))
    joined = own.join(outside, [*keys, "feature"], "left")
    ext = F.col("_ext")
    told = ext.isNotNull()
    risk = unit_clip(ext["leakage_risk"], 0.5)
    lifted = (floor >= 0.8) & (floor > risk)
    availability = unit_clip(ext["availability"], 0.5)
    uncertainty = unit_clip(ext["uncertainty"], 0.1)
    reason = F.when(F.length(ext["reason"]) > 0, ext["reason"]).otherwise("Outside score without a reason.")
    return joined.withColumns({
        "semantic_relevance": F.when(told, unit_clip(ext["semantic_relevance"], 0.5)).otherwise(F.col("semantic_relevance")),
        "leakage_risk": F.when(told, F.greatest(risk, floor)).otherwise(F.col("leakage_risk")),
        "availability": F.when(told & lifted, F.least(availability, F.lit(0.25)))
        .when(told, availability).otherwise(F.col("availability")),
        "uncertainty": F.when(told & lifted, F.greatest(uncertainty, F.lit(0.18)))
        .when(told, uncertainty).otherwise(F.col("uncertainty")),
        "reason": F.when(told & lifted, F.concat(reason, F.lit(" Lifted by the guardrail: "), floor_reason))
        .when(told, reason).otherwise("No outside score; the offline rules were used."),
    }).drop("_ext")


def widen_relevance(replies: DataFrame, relevance_only: Sequence[str]) -> DataFrame:
    """A relevance-only reply says nothing about leaks: fully available, no risk."""
    plain = F.col("prompt_variant").isin(list(relevance_only))
    return replies.withColumns({
        "prediction_time_availability": F.when(plain, 1.0).otherwise(F.col("prediction_time_availability")),
        "leakage_risk": F.when(plain, 0.0).otherwise(F.col("leakage_risk")),
    })


def check_scores(replies: DataFrame) -> DataFrame:
    """Add ``valid`` (three numbers within [0, 1] and a reason) and squeeze the reason's blanks."""
    def within(c: str) -> Column:
        return F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))

    valid = within("semantic_relevance") & within("prediction_time_availability") & within("leakage_risk")
    valid = valid & F.coalesce(F.length("reason") > 0, F.lit(False))
    return replies.withColumn("valid", valid).withColumn("reason", F.trim(F.regexp_replace("reason", r"\s+", " ")))


def aggregate_prompts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means over the prompts; uncertainty is the sample variance of the risk, 0 for one prompt."""
    return scores.groupBy(*by, "feature").agg(
        F.avg("semantic_relevance").alias("avg_semantic_relevance"),
        F.avg("prediction_time_availability").alias("avg_availability"),
        F.avg("leakage_risk").alias("avg_leakage_risk"),
        F.coalesce(F.var_samp("leakage_risk"), F.lit(0.0)).alias("uncertainty"),
    )


def batch_request(profiles: DataFrame, by: Sequence[str], target: str, classes: Sequence[str]) -> DataFrame:
    """One JSON document per table: target, its classes and the profile of every column."""
    fields = ["feature", *[c for c in profiles.columns if c not in (*by, "feature")]]
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    return profiles.groupBy(*by).agg(rows.alias("features")).select(
        *by,
        F.size("features").alias("n_features"),
        F.to_json(F.struct(
            F.lit(target).alias("target"), F.array(*[F.lit(c) for c in sorted(classes)]).alias("classes"), "features"
        )).alias("request"),
    )
