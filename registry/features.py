"""Queries over features: statistical and semantic scores, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.functions.hashing import u01
from colsieve.functions.scores import unit_clip
from colsieve.functions.tokens import tokens
from colsieve.operators import profile, select, semantic, stats
from colsieve.operators.inject import leak_names
from colsieve.plans.settle import settle
from registry import sql
from registry.rows import EVENT_COLUMNS, PROFILE_SQL
from registry.frames import (
    dealt_names, event_table, rankings, six, stat_scores, table, word_catalog, word_columns, word_scores,
)

TASK = "say which turn comes next"
EVENT_TARGET = "event_type"


def fold_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Every line counts as an encoded slot of its part's type."""
    slots = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_linestatus").alias("dataset"),
        F.concat_ws("_", F.lower("p_type"), F.lower("l_returnflag")).alias("feature"), F.col("l_discount").alias("importance"),
    )
    return six(stats.fold_slots(slots, ["dataset"]))


def normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Values of customers scaled within their nation; one nation's values are all made equal, some are missing."""
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("dataset"), F.col("c_name").alias("feature"),
        F.when(F.col("c_nationkey") == 3, 5.0).when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("importance"),
    )
    return six(stats.normalise(customers, ["dataset"]))


def clip(spark: SparkSession, sf: str) -> DataFrame:
    return six(event_table(spark, sf).select(
        "row_id", unit_clip(F.col("gap") / 10.0 - 0.5).alias("value"), unit_clip(F.col("shape"), 0.25).alias("text")
    ))


def corr_scores(spark: SparkSession, sf: str) -> DataFrame:
    return six(stat_scores(spark, sf).where(F.col("scorer") == "forest"))


def prompt_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.prompt_jobs(word_catalog(spark, sf)).select("dataset", "feature", "prompt_variant")


def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    """Digest and length of every rendered prompt."""
    rendered = semantic.render_prompts(semantic.prompt_jobs(word_catalog(spark, sf)), F.lit(TASK))
    return rendered.select("dataset", "feature", "prompt_variant", F.md5("prompt").alias("digest"), F.length("prompt").alias("n_chars"))


def _keyed_jobs(spark: SparkSession, sf: str, legacy: str | None) -> DataFrame:
    return semantic.with_cache_keys(semantic.prompt_jobs(word_catalog(spark, sf)), "Rules", "names", 0.0, None, legacy)


def _cache(jobs: DataFrame) -> DataFrame:
    """Six of ten jobs have an entry under today's key, two under the old one."""
    draw = u01("cache", F.col("prompt_variant"), F.concat_ws("/", "dataset", "feature"))
    key = F.when(draw < 0.6, F.col("score_key")).when(draw < 0.8, F.col("legacy_key"))
    return jobs.select(
        key.alias("score_key"), F.round(draw, 6).alias("semantic_relevance"), F.lit(0.5).alias("prediction_time_availability"),
        F.lit(0.25).alias("leakage_risk"), F.lit("kept").alias("reason"),
    ).where(F.col("score_key").isNotNull())


def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _keyed_jobs(spark, sf, None)
    return semantic.cache_misses(jobs, _cache(jobs)).select("dataset", "feature", "prompt_variant", "score_key")


def cache_legacy(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _keyed_jobs(spark, sf, "rules")
    return semantic.cache_lookup(jobs, _cache(jobs)).select("dataset", "feature", "prompt_variant", "score_key", "hit", "semantic_relevance")


def rule_scores_a(spark: SparkSession, sf: str) -> DataFrame:
    jobs = semantic.prompt_jobs(word_catalog(spark, sf))
    return semantic.name_rules(jobs, semantic.relevance_only_names()).drop("description")


def guardrail(spark: SparkSession, sf: str) -> DataFrame:
    floor, hits, reason = semantic.guardrail(F.col("feature"), F.lit("the_quality"))
    return word_catalog(spark, sf).select(
        "dataset", "feature", floor.alias("risk_floor"), F.array_join(hits, ",").alias("hits"), reason.alias("reason")
    )


def tokens_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of the whole text of each document."""
    found = tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(F.array_sort(found), " ")).alias("digest")
    )


def rule_scores_b(spark: SparkSession, sf: str) -> DataFrame:
    return six(semantic.floor_rules(word_scores(spark, sf), F.lit("outcome_turn")))


def _external(spark: SparkSession, sf: str) -> DataFrame:
    """An outside scorer that leaves out one feature in five and gives some numbers as bad text or out of range."""
    name = F.concat_ws("/", "dataset", "feature")
    draw = lambda salt: u01("ext", salt, name)
    risk = F.when(draw("bad") < 0.1, "n/a").when(draw("bad") < 0.2, "1.7").otherwise(F.round(draw("risk"), 3).cast("string"))
    return word_columns(spark, sf).where(draw("there") < 0.8).select(
        "dataset", "feature", F.round(draw("relevance"), 6).alias("semantic_relevance"), risk.alias("leakage_risk"),
        F.when(draw("gap") >= 0.1, F.round(draw("availability"), 6)).alias("availability"),
        F.when(draw("gap") >= 0.05, F.round(draw("uncertainty"), 6)).alias("uncertainty"),
        F.when(draw("why") < 0.3, "").when(draw("why") < 0.9, "told so").alias("reason"),
    )


def blend_external(spark: SparkSession, sf: str) -> DataFrame:
    return six(semantic.blend_external(word_scores(spark, sf), _external(spark, sf), ["dataset"], F.lit("outcome_turn")))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply per event: items that are no objects or have no name, a repeated feature, numbers as text, broken JSON."""
    row = F.col("event_id")
    draw = lambda salt: F.round(u01("reply", salt, row), 6).cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first = F.concat(F.lit('{"feature": '), quoted(F.col("event_type")), F.lit(', "leakage_risk": '), draw("first"), F.lit("}"))
    second = F.concat(
        F.lit('{"feature": '), quoted(F.col("event_type")), F.lit(', "leakage_risk": '), quoted(draw("second")),
        F.lit(', "availability": "unknown", "reason": "later item"}'),
    )
    other = F.concat(F.lit('{"feature": "user", "semantic_relevance": '), F.col("value").cast("string"), F.lit(', "uncertainty": 1}'))
    items = F.concat_ws(", ", first, F.lit('"text"'), F.lit('{"feature": ""}'), F.lit('{"feature": 12}'), F.lit("{}"), second, other)
    whole = F.concat(F.lit('{"features": ['), items, F.lit("]}"))
    payload = F.when(u01("reply", "broken", row) < 0.1, F.lit('{"features": [')).when(u01("reply", "broken", row) < 0.2, F.lit('{"features": 3}'))
    return table(spark, sf, "events").select("event_id", payload.otherwise(whole).alias("payload"))


def parse_scores(spark: SparkSession, sf: str) -> DataFrame:
    return six(semantic.parse_scores(_replies(spark, sf), ["event_id"]))


def malformed_replies(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.malformed_replies(_replies(spark, sf)).select("event_id")


def _raw_replies(spark: SparkSession, sf: str) -> DataFrame:
    """One reply per conversation turn: some numbers out of range or missing, reasons with blanks or empty."""
    row = F.concat_ws("/", "conv_id", "turn")
    draw = lambda salt: F.round(u01("raw", salt, row), 6)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "relevance").otherwise("leakage").alias("prompt_variant"),
        F.when(draw("out") < 0.1, 1.5).when(draw("out") < 0.15, -0.1).otherwise(draw("relevance")).alias("semantic_relevance"),
        F.when(draw("gap") >= 0.1, draw("availability")).alias("prediction_time_availability"), draw("risk").alias("leakage_risk"),
        F.when(draw("why") < 0.1, "").when(draw("why") < 0.9, F.concat(F.lit("  because\n of \t"), F.col("role"), F.lit("  "))).alias("reason"),
    )


def validate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return six(semantic.check_scores(_raw_replies(spark, sf)))


def widen_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return six(semantic.widen_relevance(_raw_replies(spark, sf), semantic.relevance_only_names()).drop("reason"))


def aggregate_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the prompts, whose risks differ by a draw, for the wide catalogue; one table has a single prompt."""
    scored = semantic.name_rules(semantic.prompt_jobs(dealt_names(spark, sf)), semantic.relevance_only_names())
    scored = scored.where((F.col("dataset") != "conv_1") | (F.col("prompt_variant") == "leakage"))
    shift = u01("risk", F.col("prompt_variant"), F.concat_ws("/", "dataset", "feature")) / 10.0
    return six(semantic.aggregate_prompts(scored.withColumn("leakage_risk", F.col("leakage_risk") + shift), ["dataset"]))


def batch_request(spark: SparkSession, sf: str) -> DataFrame:
    """The request for the events table, read back from its JSON."""
    events = event_table(spark, sf)
    shown = profile.profile(events, EVENT_COLUMNS, "row_id").withColumn("dataset", F.lit("events"))
    classes = [r[0] for r in profile.class_list(events, EVENT_TARGET).collect()]
    request = semantic.batch_request(shown, ["dataset"], EVENT_TARGET, classes)
    column = "feature: string, dtype: string, missing_ratio: double, unique_values: bigint, examples: array<string>, stat_score: double"
    read = F.from_json("request", f"target string, classes array<string>, features array<struct<{column}>>").alias("r")
    told = request.select("dataset", "n_features", read).select("dataset", "n_features", "r.target", F.array_join("r.classes", "|").alias("classes"), F.inline("r.features"))
    return told.withColumn("examples", F.array_join("examples", "|"))


def topk_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets by ratio, by fixed k and by the bounded ratio of the interactive analysis."""
    catalog = word_catalog(spark, sf).withColumn("is_injected_leakage", F.col("feature").isin(leak_names()))
    by_ratio = select.budgets(catalog)
    n = F.col("n_original_features")
    return by_ratio.withColumns({
        "k_fixed": select.k_from_ratio(n, k=25), "k_least": select.k_from_ratio(n, 0.001, least=select.LEAST_RATIO),
        "k_all": select.k_from_ratio(n, 7.0, least=select.LEAST_RATIO),
    })


def rank_stat(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rankings(spark, sf, tuple(select.STAT_METHODS.values()))
    return six(select.top_k(ranked).drop("selected", "is_injected_leakage"))


def rank_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance ranking of the wide catalogue."""
    jobs = semantic.prompt_jobs(word_catalog(spark, sf), [p for p in semantic.PROMPTS if p.relevance_only])
    means = semantic.aggregate_prompts(semantic.name_rules(jobs, semantic.relevance_only_names()), ["dataset"])
    scores = select.relevance_scores(means.withColumn("seed", F.lit(1)))
    catalog = word_catalog(spark, sf).withColumn("is_injected_leakage", F.lit(False))
    return six(select.top_k(select.rank_methods(scores, select.budgets(catalog))).drop("selected"))


def rank_leakage_aware(spark: SparkSession, sf: str) -> DataFrame:
    return six(rankings(spark, sf, (select.AWARE_METHOD,)))


def rank_ablations(spark: SparkSession, sf: str) -> DataFrame:
    return six(rankings(spark, sf, (), select.ablations()))


def _interactive(spark: SparkSession, sf: str) -> DataFrame:
    scores = settle(word_scores(spark, sf))
    judged = semantic.floor_rules(scores, F.lit("outcome_turn"))
    return select.rank_interactive(select.interactive_scores(scores, judged), 10)


def rank_interactive(spark: SparkSession, sf: str) -> DataFrame:
    return six(_interactive(spark, sf).drop("reason", "importance"))


def rank_flags(spark: SparkSession, sf: str) -> DataFrame:
    return six(rankings(spark, sf))


def selected_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = select.selected_lists(rankings(spark, sf))
    return lists.withColumn("selected_features", F.array_join("selected_features", ","))


def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return select.side_by_side(rankings(spark, sf, ("tfs_rf", "leakage_aware")), "tfs_rf", "leakage_aware")


def severity(spark: SparkSession, sf: str) -> DataFrame:
    scores = blend_external(spark, sf)
    return scores.select("dataset", "feature", "leakage_risk", select.severity(F.col("leakage_risk")).alias("severity"))


def top12(spark: SparkSession, sf: str) -> DataFrame:
    return six(select.first_ranks(_interactive(spark, sf)).select("dataset", "method", "rank", "feature", "score"))


QUERIES = {
    "fold_importance": fold_importance, "normalize": normalize, "clip": clip, "corr_scores": corr_scores,
    "prompt_jobs": prompt_jobs, "prompt_text": prompt_text, "cache_misses": cache_misses, "cache_legacy": cache_legacy,
    "rule_scores_a": rule_scores_a, "guardrail": guardrail, "tokens": tokens_of_names, "rule_scores_b": rule_scores_b,
    "blend_external": blend_external, "parse_scores": parse_scores, "malformed_replies": malformed_replies,
    "validate_scores": validate_scores, "widen_relevance": widen_relevance, "aggregate_semantic": aggregate_semantic,
    "batch_request": batch_request, "topk_budget": topk_budget, "rank_stat": rank_stat, "rank_relevance": rank_relevance,
    "rank_leakage_aware": rank_leakage_aware, "rank_ablations": rank_ablations, "rank_interactive": rank_interactive,
    "rank_flags": rank_flags, "selected_lists": selected_lists, "side_by_side": side_by_side, "severity": severity, "top12": top12,
}

_U = sql.u01
_NAME = "concat_ws('/', dataset, feature)"


def _filled(template: str) -> str:
    plain = template.replace("{{", "\x01").replace("}}", "\x02")
    parts = sql.text(plain).replace("\x01", "{").replace("\x02", "}")
    for slot, value in (("{task_description}", sql.text(TASK)), ("{feature_name}", "feature"), ("{feature_description}", "replace(feature, '_', ' ')")):
        parts = parts.replace(slot, f"' || {value} || '")
    return parts.replace("\n", "' || chr(10) || '")


PROMPT_SQL = "CASE prompt_variant " + " ".join(f"WHEN {sql.text(p.name)} THEN {_filled(p.template)}" for p in semantic.PROMPTS) + " END"
_KEY_PARTS = "'semantic_score', dataset, feature, replace(feature, '_', ' '), prompt_variant, {provider}'names', '0.0', ''"
_KEY = f"substr(sha256(concat_ws(chr(31), {_KEY_PARTS.format(provider=chr(39) + 'rules' + chr(39) + ', ')})), 1, 24)"
_OLD_KEY = f"substr(sha256(concat_ws(chr(31), {_KEY_PARTS.format(provider='')})), 1, 24)"
_CACHE_DRAW = _U("'cache'", "prompt_variant", _NAME)
_RISKY = f"list_has_any({sql.tokens()}, {sql.texts(sql.RISKY_NAME_TERMS)})"
_RULES_A = f"""
  SELECT dataset, feature, prompt_variant,
    CASE WHEN risky THEN 0.9::DOUBLE WHEN regexp_matches(lower(feature), {sql.text('|'.join(sql.SIGNAL_NAME_PARTS))}) THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS semantic_relevance,
    CASE WHEN plain THEN 1.0::DOUBLE WHEN risky THEN 0.15::DOUBLE ELSE 0.85::DOUBLE END AS prediction_time_availability,
    CASE WHEN plain THEN 0.0::DOUBLE WHEN risky THEN 0.9::DOUBLE ELSE 0.15::DOUBLE END AS leakage_risk,
    CASE WHEN plain THEN 'Relevance by name only.' WHEN risky THEN 'The name points to something known after the outcome.'
         ELSE 'The name gives no hint that the value comes late.' END AS reason
  FROM (SELECT *, {_RISKY} AS risky FROM word_columns, prompts)"""
_RULES_B = sql.floor_rules("word_scores", "outcome_turn")
_BLEND_TABLES = {
    "external_scores": f"""
      SELECT dataset AS d, feature AS f, round({_U("'ext'", "'relevance'", _NAME)}, 6) AS r,
        coalesce(TRY_CAST(CASE WHEN {_U("'ext'", "'bad'", _NAME)} < 0.1 THEN 'n/a' WHEN {_U("'ext'", "'bad'", _NAME)} < 0.2 THEN '1.7'
             ELSE CAST(round({_U("'ext'", "'risk'", _NAME)}, 3) AS VARCHAR) END AS DOUBLE), 0.5::DOUBLE) AS l,
        CASE WHEN {_U("'ext'", "'gap'", _NAME)} >= 0.1 THEN round({_U("'ext'", "'availability'", _NAME)}, 6) ELSE 0.5::DOUBLE END AS a,
        CASE WHEN {_U("'ext'", "'gap'", _NAME)} >= 0.05 THEN round({_U("'ext'", "'uncertainty'", _NAME)}, 6) ELSE 0.1::DOUBLE END AS u,
        CASE WHEN {_U("'ext'", "'why'", _NAME)} >= 0.3 AND {_U("'ext'", "'why'", _NAME)} < 0.9 THEN 'told so' ELSE 'Outside score without a reason.' END AS w
      FROM word_columns WHERE {_U("'ext'", "'there'", _NAME)} < 0.8""",
    "own_scores": _RULES_B,
    "blended": """
      SELECT dataset, feature, importance, stat_score,
        CASE WHEN f IS NULL THEN semantic_relevance ELSE r END AS semantic_relevance,
        CASE WHEN f IS NULL THEN leakage_risk ELSE greatest(least(l, 1.0::DOUBLE), leakage_risk) END AS leakage_risk,
        CASE WHEN f IS NULL THEN availability WHEN lifted THEN least(a, 0.25::DOUBLE) ELSE a END AS availability,
        CASE WHEN f IS NULL THEN uncertainty WHEN lifted THEN greatest(u, 0.18::DOUBLE) ELSE u END AS uncertainty,
        CASE WHEN f IS NULL THEN 'No outside score; the offline rules were used.' WHEN lifted THEN w || ' Lifted by the guardrail: ' || reason ELSE w END AS reason
      FROM (SELECT *, leakage_risk >= 0.8 AND leakage_risk > least(l, 1.0::DOUBLE) AS lifted
            FROM own_scores LEFT JOIN external_scores ON d = dataset AND f = feature)""",
}
_REPLY_DRAW = lambda salt: f"round({_U(chr(39) + 'reply' + chr(39), chr(39) + salt + chr(39), 'event_id')}, 6)"
_BROKEN = _U("'reply'", "'broken'", "event_id")
_TURN = "concat_ws('/', conv_id, turn)"
_RAW_DRAW = lambda salt: f"round({_U(chr(39) + 'raw' + chr(39), chr(39) + salt + chr(39), _TURN)}, 6)"
_RAW_REPLIES = f"""
  SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'relevance' ELSE 'leakage' END AS prompt_variant,
    CASE WHEN {_RAW_DRAW('out')} < 0.1 THEN 1.5::DOUBLE WHEN {_RAW_DRAW('out')} < 0.15 THEN -0.1::DOUBLE ELSE {_RAW_DRAW('relevance')} END AS semantic_relevance,
    CASE WHEN {_RAW_DRAW('gap')} >= 0.1 THEN {_RAW_DRAW('availability')} END AS prediction_time_availability, {_RAW_DRAW('risk')} AS leakage_risk,
    CASE WHEN {_RAW_DRAW('why')} < 0.1 THEN '' WHEN {_RAW_DRAW('why')} < 0.9 THEN 'because of ' || role END AS reason
  FROM conversations"""
_LEAK_LIST = ", ".join(sql.text(n) for n in leak_names())
_RISK_SHIFT = _U("'risk'", "prompt_variant", _NAME) + " / 10.0::DOUBLE"
_N = "count(*) FILTER (NOT x)"
_INTERACTIVE = f"""
  SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY score DESC, stat_score DESC, feature) AS rank
  FROM (SELECT *, unnest([{{'method': 'forest', 'score': stat_score}}, {{'method': 'leakage_aware', 'score': aware_score}}], recursive := true)
        FROM (SELECT dataset, feature, stat_score, semantic_relevance, leakage_risk, availability, uncertainty,
                round(0.6::DOUBLE * stat_score + 0.4::DOUBLE * semantic_relevance - 0.5::DOUBLE * leakage_risk - 0.3::DOUBLE * (1 - availability) - 0.2::DOUBLE * uncertainty, 6) AS aware_score
              FROM ({_RULES_B})))"""
_FOUR = "semantic_relevance leakage_risk availability uncertainty"

SQL = {
    "fold_importance": "SELECT l_linestatus AS dataset, lower(p_type) || '_' || lower(l_returnflag) AS feature, round(sum(l_discount), 6) AS importance"
    " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "normalize": "SELECT dataset, feature, importance, round(CASE WHEN hi - lo <= 1e-8 + 1e-5 * abs(lo) THEN 0.5::DOUBLE ELSE (v - lo) / (hi - lo) END, 6) + 0.0::DOUBLE AS stat_score"
    " FROM (SELECT *, coalesce(importance, 0.0::DOUBLE) AS v, min(coalesce(importance, 0)) OVER (PARTITION BY dataset) AS lo, max(coalesce(importance, 0)) OVER (PARTITION BY dataset) AS hi"
    " FROM (SELECT c_nationkey AS dataset, c_name AS feature, CASE WHEN c_nationkey = 3 THEN 5.0::DOUBLE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS importance FROM customer))",
    "clip": sql.six(
        "SELECT row_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(gap / 10.0::DOUBLE - 0.5::DOUBLE, 0.0::DOUBLE))) AS value,"
        " greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(shape AS DOUBLE), 0.25::DOUBLE))) AS text FROM event_table", "value text"
    ),
    "corr_scores": sql.six("SELECT dataset, seed, scorer, feature, importance, stat_score FROM stat WHERE scorer = 'forest'", "importance stat_score"),
    "prompt_jobs": sql.with_tables("SELECT dataset, feature, prompt_variant FROM word_columns, prompts"),
    "prompt_text": sql.with_tables(
        f"SELECT dataset, feature, prompt_variant, md5(t) AS digest, length(t)::INTEGER AS n_chars FROM (SELECT *, {PROMPT_SQL} AS t FROM word_columns, prompts)"
    ),
    "cache_misses": sql.with_tables(
        f"SELECT dataset, feature, prompt_variant, {_KEY} AS score_key FROM word_columns, prompts WHERE {_CACHE_DRAW} >= 0.6"
    ),
    "cache_legacy": sql.with_tables(
        f"SELECT dataset, feature, prompt_variant, {_KEY} AS score_key, CASE WHEN {_CACHE_DRAW} < 0.6 THEN 'current' WHEN {_CACHE_DRAW} < 0.8 THEN 'legacy' ELSE 'miss' END AS hit,"
        f" CASE WHEN {_CACHE_DRAW} < 0.8 THEN round({_CACHE_DRAW}, 6) END AS semantic_relevance FROM word_columns, prompts"
    ),
    "rule_scores_a": sql.with_tables(_RULES_A),
    "guardrail": sql.with_tables(
        "SELECT dataset, feature, CASE WHEN len(h) > 0 THEN 0.9::DOUBLE ELSE 0.12::DOUBLE END AS risk_floor, array_to_string(h, ',') AS hits,"
        " CASE WHEN len(h) > 0 THEN 'The name holds leakage words: ' || array_to_string(h, ', ') || '.' ELSE 'The name holds no leakage words.' END AS reason"
        f" FROM (SELECT *, {sql.hits('feature', sql.text('the_quality'))} AS h FROM word_columns)"
    ),
    "tokens": f"SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)",
    "rule_scores_b": sql.six(_RULES_B, f"importance stat_score {_FOUR}"),
    "blend_external": sql.six("SELECT * FROM blended", f"importance stat_score {_FOUR}", **_BLEND_TABLES),
    "parse_scores": f"""
      SELECT event_id, event_type AS feature, NULL::DOUBLE AS semantic_relevance, {_REPLY_DRAW('second')} AS leakage_risk, NULL::DOUBLE AS availability,
        NULL::DOUBLE AS uncertainty, 'later item' AS reason FROM events WHERE {_BROKEN} >= 0.2
      UNION ALL SELECT event_id, 'user', round(value, 6), NULL, NULL, 1.0::DOUBLE, NULL FROM events WHERE {_BROKEN} >= 0.2""",
    "malformed_replies": f"SELECT event_id FROM events WHERE {_BROKEN} < 0.2",
    "validate_scores": f"""
      SELECT conv_id, turn, prompt_variant, semantic_relevance, prediction_time_availability, leakage_risk, reason,
        semantic_relevance BETWEEN 0 AND 1 AND prediction_time_availability IS NOT NULL AND reason IS NOT NULL AND reason <> '' AS valid FROM ({_RAW_REPLIES})""",
    "widen_relevance": f"""
      SELECT conv_id, turn, prompt_variant, semantic_relevance, CASE WHEN role = 'user' THEN 1.0::DOUBLE ELSE prediction_time_availability END AS prediction_time_availability,
        CASE WHEN role = 'user' THEN 0.0::DOUBLE ELSE leakage_risk END AS leakage_risk FROM ({_RAW_REPLIES})""",
    "aggregate_semantic": sql.six(
        "SELECT dataset, feature, avg(semantic_relevance) AS avg_semantic_relevance, avg(prediction_time_availability) AS avg_availability,"
        f" avg(leakage_risk + {_RISK_SHIFT}) AS avg_leakage_risk, coalesce(var_samp(leakage_risk + {_RISK_SHIFT}), 0.0::DOUBLE) AS uncertainty"
        f" FROM ({_RULES_A}) WHERE dataset <> 'conv_1' OR prompt_variant = 'leakage' GROUP BY 1, 2",
        "avg_semantic_relevance avg_availability avg_leakage_risk uncertainty",
    ),
    "batch_request": sql.with_tables(
        f"SELECT 'events' AS dataset, 10 AS n_features, '{EVENT_TARGET}' AS target, (SELECT string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM events) AS classes, p.* FROM ({PROFILE_SQL}) p"
    ),
    "topk_budget": sql.with_tables(
        f"SELECT dataset, {_N}::INTEGER AS n_original_features, count(*) FILTER (x)::INTEGER AS n_injected_features, greatest(1, ceil({_N} * 0.4::DOUBLE))::INTEGER AS k,"
        f" least({_N}, 25)::INTEGER AS k_fixed, greatest(1, ceil({_N} * 0.05::DOUBLE))::INTEGER AS k_least, {_N}::INTEGER AS k_all"
        f" FROM (SELECT *, feature IN ({_LEAK_LIST}) AS x FROM word_columns) GROUP BY 1"
    ),
    "rank_stat": sql.six(
        "SELECT dataset, seed, method, feature, score, rank FROM ranked WHERE selected AND method LIKE 'tfs%'", "score"
    ),
    "rank_relevance": sql.with_tables(
        "SELECT dataset, 1 AS seed, 'semantic_only' AS method, feature, semantic_relevance AS score, rank FROM"
        " (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY semantic_relevance DESC, feature) AS rank, count(*) OVER (PARTITION BY dataset) AS n"
        f" FROM ({_RULES_A}) WHERE prompt_variant = 'relevance') WHERE rank <= ceil(n * 0.4::DOUBLE)"
    ),
    "rank_leakage_aware": sql.six("SELECT * FROM ranked WHERE method = 'leakage_aware'", "score"),
    "rank_ablations": sql.six(
        "SELECT s.dataset, s.seed, s.method, s.feature, s.score, s.rank, s.rank <= b.k AS selected, c.is_injected_leakage FROM (SELECT dataset, seed, method, feature, round(score, 6) AS score,"
        " row_number() OVER (PARTITION BY dataset, seed, method ORDER BY round(score, 6) DESC, feature) AS rank FROM ablated) s"
        " JOIN budget b USING (dataset) JOIN catalog c ON c.dataset = s.dataset AND c.feature = s.feature", "score"
    ),
    "rank_interactive": sql.six(f"SELECT *, rank <= 10 AS selected FROM ({_INTERACTIVE})", f"stat_score {_FOUR} aware_score score"),
    "rank_flags": sql.six("SELECT * FROM ranked", "score"),
    "selected_lists": sql.with_tables(
        "SELECT dataset, seed, method, string_agg(feature, ',' ORDER BY rank) AS selected_features FROM ranked WHERE selected GROUP BY 1, 2, 3"
    ),
    "side_by_side": sql.with_tables(
        "SELECT dataset, seed, rank, coalesce(max(feature) FILTER (method = 'tfs_rf'), '') AS tfs_rf, coalesce(max(feature) FILTER (method = 'leakage_aware'), '') AS leakage_aware"
        " FROM ranked WHERE selected AND method IN ('tfs_rf', 'leakage_aware') GROUP BY 1, 2, 3"
    ),
    "severity": sql.six(
        "SELECT dataset, feature, leakage_risk, CASE WHEN leakage_risk > 0.8 THEN 'high' WHEN leakage_risk > 0.4 THEN 'medium' ELSE 'low' END AS severity FROM blended",
        "leakage_risk", **_BLEND_TABLES,
    ),
    "top12": sql.six(f"SELECT dataset, method, rank, feature, score FROM ({_INTERACTIVE}) WHERE rank <= 12", "score"),
}
