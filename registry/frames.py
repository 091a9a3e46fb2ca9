"""Labelled tables, catalogues and result rows made of the given tables."""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colsieve.functions.hashing import u01
from colsieve.operators import inject, metrics, select, semantic, split, stats, target as targets
from colsieve.plans.experiment import offline_semantic
from colsieve.plans.settle import attach, settle, store
from colsieve.plans.spread import spread
from colsieve.sources.snapshots import LabelledTable, TableSpec, labelled

SEEDS = (1, 2, 3)
LEAK_SEED = 42
# Tables whose rows are hashed or exploded: one small file of them should not stay in one task.
SPREAD_KEYS = {"orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"]}
NUMERIC = ("order_month", "account_balance", "line_count", "line_quantity", "line_discount")
CATEGORICAL = ("order_status", "order_priority", "market_segment", "region_name")
LEAK_NUMERIC = tuple(l.name for l in inject.LEAKS if l.representation != "categorical")
LEAK_CATEGORICAL = tuple(l.name for l in inject.LEAKS if l.representation == "categorical")
# Text whose words one task totals as names.
NAMES_BYTES = 1 << 19
NAME_ENDINGS = (
    "final_outcome", "amount", "post_decision", "history", "risk_review_code", "id",
    "count", "followup_action_group", "score", "after", "name", "tenure",
)


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a lazy frame; kept so that its schema is looked up once per session."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


def six(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, minus zero as zero.

    They go through twelve decimal places first: what float sums add to a tie is far below, so that a tie has one answer.
    """
    def rounded(c: str) -> Column:
        tidy = F.round(F.col(c).try_cast("decimal(30,12)"), 6).cast("double")
        return (F.coalesce(tidy, F.round(F.col(c), 6)) + F.lit(0.0)).alias(c)

    return df.select(*[rounded(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def order_base(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with its customer's facts and what its lines add up to."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("l_quantity").alias("line_quantity"),
        F.round(F.avg("l_discount"), 6).alias("line_discount"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("order_priority"),
        F.month("o_orderdate").alias("order_month"), F.col("o_totalprice").alias("total_price"),
    )
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("account_balance"),
        F.col("c_mktsegment").alias("market_segment"),
    )
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("dataset"), F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region_name"))
    joined = orders.join(customers, "c_custkey").join(nations, "n_nationkey").join(regions, "r_regionkey").join(lines, "row_id", "left")
    filled = joined.na.fill(0, ["line_count"]).na.fill(0.0, ["line_quantity", "line_discount"])
    return filled.select("row_id", "dataset", *NUMERIC, *CATEGORICAL, "total_price")


def price_threshold(spark: SparkSession, sf: str) -> float:
    return targets.exact_medians(table(spark, sf, "orders"), ["o_totalprice"])["o_totalprice"]


def order_table(spark: SparkSession, sf: str, threshold: float | None = None) -> DataFrame:
    """Orders labelled 'high' above the median price, else 'low'; the price is gone."""
    high = F.col("total_price") > F.lit(price_threshold(spark, sf) if threshold is None else threshold)
    return order_base(spark, sf).withColumn("value_class", F.when(high, "high").otherwise("low")).drop("total_price")


def order_bit() -> Column:
    """'low' is the greater of the two labels."""
    return (F.col("value_class") == "low").cast("int")


def leaky_orders(spark: SparkSession, sf: str, threshold: float | None = None, cuts: DataFrame | None = None, seeds=SEEDS) -> DataFrame:
    """The labelled orders with the leaks and, given the ``cuts`` of a split, their parts under all seeds."""
    labelled_rows = order_table(spark, sf, threshold).withColumn("y", order_bit())
    if cuts is not None:
        labelled_rows = split.with_parts(labelled_rows, cuts, "value_class", "row_id", seeds)
    return inject.inject_leaks(labelled_rows, F.col("y"), "row_id", LEAK_SEED)


def order_labels(spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    """(row_id, value_class) straight from the orders, without the joins."""
    label = F.when(F.col("o_totalprice") > F.lit(threshold), "high").otherwise("low")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), label.alias("value_class"))


def split_orders(spark: SparkSession, sf: str) -> DataFrame:
    """(seed, row_id, value_class, part) of the orders, split within each class."""
    return split.stratified_split(order_labels(spark, sf, price_threshold(spark, sf)), "value_class", "row_id", SEEDS)


def split_leaky_orders(spark: SparkSession, sf: str, seeds=SEEDS, several_uses: bool = False) -> DataFrame:
    """The injected orders with seed and part. The cuts come from the labels alone, so no join by row id is needed.

    For ``several_uses`` the orders are joined, the leaks drawn and the parts found once and written; a use only takes the
    seeds apart.
    """
    threshold = price_threshold(spark, sf)
    cuts = split.split_cuts(order_labels(spark, sf, threshold), "value_class", "row_id", seeds)
    if several_uses:
        return split.by_seed(store(leaky_orders(spark, sf, threshold, cuts, seeds)))
    return split.apply_cuts(leaky_orders(spark, sf, threshold), cuts, "value_class", "row_id", seeds)


def stat_scores(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Fit-free scores per nation, seed and scorer from the training rows, three scorers as variants of one.

    ``rows``: the split orders, if others use them too.
    """
    rows = split_leaky_orders(spark, sf, several_uses=True) if rows is None else rows
    train = rows.where(F.col("part") == "train")
    found = stats.association_scores(
        train, ["dataset", "seed"], "y", [*NUMERIC, *LEAK_NUMERIC], [*CATEGORICAL, *LEAK_CATEGORICAL]
    )
    v = F.col("importance")
    variants = F.array(
        F.struct(F.lit("forest").alias("scorer"), v.alias("importance")),
        F.struct(F.lit("logreg").alias("scorer"), F.round(v * v, 6).alias("importance")),
        F.struct(F.lit("lasso").alias("scorer"), F.round(F.greatest(v - 0.05, F.lit(0.0)), 6).alias("importance")),
    )
    long = found.select("dataset", "seed", "feature", F.inline(variants))
    return stats.normalise(settle(long), ["dataset", "seed", "scorer"])


def order_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset, feature, description, is_injected_leakage) of the labelled tables, one per nation with orders."""
    facts = [(f, f.replace("_", " "), False) for f in (*NUMERIC, *CATEGORICAL)]
    facts += [(l.name, l.description, True) for l in inject.LEAKS]
    entries = [F.struct(F.lit(f).alias("feature"), F.lit(d).alias("description"), F.lit(i).alias("is_injected_leakage")) for f, d, i in facts]
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf, "orders").select("o_custkey").join(customers, "o_custkey").select("n_nationkey").distinct()
    names = nations.join(table(spark, sf, "nation"), "n_nationkey").select(F.col("n_name").alias("dataset"))
    return names.select("dataset", F.inline(F.array(*entries)))


def order_semantic(spark: SparkSession, sf: str, catalog: DataFrame | None = None) -> DataFrame:
    """Raw name-rule scores of the catalogue; the audit prompt sees more risk, so that there is uncertainty."""
    raw = offline_semantic(order_catalog(spark, sf) if catalog is None else catalog)
    risk = F.when(F.col("prompt_variant") == "leakage_audit", F.least(F.lit(1.0), F.col("leakage_risk") + 0.05))
    return raw.withColumn("leakage_risk", risk.otherwise(F.col("leakage_risk")))


def with_run_seeds(df: DataFrame) -> DataFrame:
    return split.with_seeds(df, SEEDS)


def role_means(spark: SparkSession, sf: str, role: str, catalog: DataFrame | None = None) -> DataFrame:
    raw = order_semantic(spark, sf, catalog).where(F.col("scoring_role") == role)
    return with_run_seeds(semantic.aggregate_prompts(raw, ["dataset"]))


def order_budget(spark: SparkSession, sf: str, catalog: DataFrame | None = None) -> DataFrame:
    return select.budgets(order_catalog(spark, sf) if catalog is None else catalog)


def rankings(
    spark: SparkSession, sf: str, methods: tuple[str, ...] = select.METHODS, variants=None, rows: DataFrame | None = None
) -> DataFrame:
    """Rankings of the wanted methods, or of variants of the leakage-aware one. ``rows``: the split orders, if others use them too."""
    catalog = settle(order_catalog(spark, sf))
    scores = []
    if set(methods) != {select.RELEVANCE_METHOD}:
        stat = settle(stat_scores(spark, sf, rows))
        scorers = {s: m for s, m in select.STAT_METHODS.items() if m in methods}
        if scorers:
            scores.append(select.stat_method_scores(stat, scorers))
        if select.AWARE_METHOD in methods or variants:
            aware = role_means(spark, sf, select.AWARE_METHOD, catalog)
            scores.append(select.aware_scores(stat.where(F.col("scorer") == "forest"), aware, variants))
    if select.RELEVANCE_METHOD in methods:
        scores.append(select.relevance_scores(role_means(spark, sf, select.RELEVANCE_METHOD, catalog)))
    return select.rank_methods(
        reduce(lambda a, b: a.unionByName(b), scores), order_budget(spark, sf, catalog),
        catalog.where("is_injected_leakage"), decimals=6,
    )


# Numbers are counted by the floor of the value times this; ten where nothing is given.
BINS = {"account_balance": 0.01, "line_quantity": 0.1, "line_discount": 100.0}
MICRO = 1_000_000


FEATURES = (*NUMERIC, *CATEGORICAL, *LEAK_NUMERIC, *LEAK_CATEGORICAL)


def _value(c: str) -> Column:
    """A feature's value as it is counted, as text."""
    numeric = c in NUMERIC or c in LEAK_NUMERIC
    return (F.floor(F.col(c).cast("double") * BINS.get(c, 10.0)).cast("long") if numeric else F.col(c)).cast("string")


def _shares(train: DataFrame) -> DataFrame:
    """(dataset, seed, base, of): the share of class 1 among the training rows, and a map value -> share for each of FEATURES.

    Values are bins and categories, so the maps are as small as the bins are few; ``attach`` measures them before it sends them out.
    """
    share = F.floor(F.sum("y") * MICRO / F.count(F.lit(1))).cast("long").alias("share")
    entries = [F.struct(F.lit(i).alias("i"), _value(c).alias("value")) for i, c in enumerate(FEATURES)]
    cells = train.select("dataset", "seed", "y", F.inline(F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("value")), *entries)))
    counted = cells.where("value IS NOT NULL").groupBy("dataset", "seed", "i", "value").agg(share)
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("i") == i, F.struct("value", "share")))).alias(f"of_{c}") for i, c in enumerate(FEATURES)]
    return counted.groupBy("dataset", "seed").agg(F.max(F.when(F.col("i") == -1, F.col("share"))).alias("base"), *maps)


def predictions(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """(dataset, seed, method, setting, row_id, label, pred, score): the test rows of each seed, scored by the chosen features.

    The model counts: a feature's value stands for the share of class 1 among the training rows that have it, in whole
    millionths, the share among all training rows if there are none. A row's score is the mean over the chosen features.
    Masked leaks have values that no training row has. All sums are of whole numbers. Test rows are not shuffled: they meet
    the shares and the methods' choices of their table in one lookup each, a value's share is looked up once for all
    methods, and a method sums the shares at the places of its features.
    """
    shares = _shares(rows.where(F.col("part") == "train"))
    place = F.array_position(F.array(*[F.lit(c) for c in FEATURES]), F.col("feature"))
    chosen = select.top_k(ranked).groupBy("dataset", "seed", "method").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(place > 0, (place - 1).cast("int"))).alias("places")
    )
    choices = chosen.groupBy("dataset", "seed").agg(F.collect_list(F.struct("method", "n", "places")).alias("choices"))
    test = rows.where(F.col("part") == "test").select("dataset", "seed", "row_id", F.col("y").alias("label"), *[_value(c).alias(c) for c in FEATURES])
    met = attach(attach(test, shares, ["dataset", "seed"], "inner"), choices, ["dataset", "seed"], "inner")
    looked_up = met.select(
        "dataset", "seed", "row_id", "label", "base", "choices",
        *[F.coalesce(F.try_element_at(f"of_{c}", F.col(c)), F.col("base")).alias(c) for c in FEATURES],
    )
    leaks = set(inject.leak_names())
    shown = {"leaky": [F.col(c) for c in FEATURES], "clean": [F.col("base") if c in leaks else F.col(c) for c in FEATURES]}
    found = looked_up.select(
        "dataset", "seed", "row_id", "label", *[F.array(*values).alias(f"_{name}") for name, values in shown.items()], F.explode("choices").alias("choice")
    )

    def total(name: str) -> Column:
        return F.aggregate("choice.places", F.lit(0).cast("long"), lambda t, i: t + F.get(F.col(f"_{name}"), i))

    settings = F.array(*[F.struct(F.lit(name).alias("setting"), total(name).alias("_sum")) for name in shown])
    scored = found.select("dataset", "seed", "row_id", "label", F.col("choice.method").alias("method"), (F.col("choice.n") * MICRO).alias("_most"), F.inline(settings))
    return scored.select(
        "dataset", "seed", "method", "setting", "row_id", "label",
        (2 * F.col("_sum") > F.col("_most")).cast("int").alias("pred"), (F.col("_sum") / F.col("_most")).alias("score"),
    )


def _measured(spark: SparkSession, sf: str, rows: DataFrame, ranked: DataFrame, scorers=None) -> DataFrame:
    """The result rows of some rankings of the split orders."""
    ranked, budget = settle(ranked), settle(order_budget(spark, sf))
    measured = metrics.classification_metrics(predictions(rows, ranked))
    return metrics.metric_rows(metrics.by_setting(measured), metrics.leak_selection(select.top_k(ranked), budget), budget, scorers)


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_leaky_orders(spark, sf, several_uses=True)
    return _measured(spark, sf, rows, rankings(spark, sf, rows=rows))


def ablation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of the leakage-aware score's variants."""
    variants = select.ablations(select.Weights())
    rows = split_leaky_orders(spark, sf, several_uses=True)
    return _measured(spark, sf, rows, rankings(spark, sf, (), variants, rows), {v: ("rules", "names") for v in variants})


def word_columns(spark: SparkSession, sf: str, turns: DataFrame | None = None) -> DataFrame:
    """A wide catalogue: each conversation is a table, its distinct words are made into column names.

    One name in twenty is a known leak's. Columns: dataset, feature, uses. ``turns``: the conversations, if dealt otherwise.
    """
    turns = (table(spark, sf, "conversations") if turns is None else turns).select("conv_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w"))
    words = turns.where(F.col("w") != "").groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("n"))
    ending = F.element_at(F.array(*[F.lit(e) for e in NAME_ENDINGS]), (F.floor(u01("ending", "w", F.col("w")) * len(NAME_ENDINGS)) + 1).cast("int"))
    leak = F.element_at(F.array(*[F.lit(n) for n in inject.leak_names()]), (F.floor(u01("leak", "w", F.col("w")) * 10) + 1).cast("int"))
    name = F.when(u01("pick", "w", F.col("w")) < 0.05, leak).otherwise(F.concat_ws("_", "w", ending))
    named = words.select(F.concat(F.lit("conv_"), F.col("conv_id")).alias("dataset"), name.alias("feature"), "n")
    return named.groupBy("dataset", "feature").agg(F.sum("n").alias("uses"))


def word_catalog(spark: SparkSession, sf: str, turns: DataFrame | None = None) -> DataFrame:
    return word_columns(spark, sf, turns).select("dataset", "feature", F.replace(F.col("feature"), F.lit("_"), F.lit(" ")).alias("description"))


def dealt_names(spark: SparkSession, sf: str) -> DataFrame:
    """``word_catalog`` dealt by name over as many tasks as the text has pieces of NAMES_BYTES, a core at least.

    For totals over rows made of the names: names shuffle to few bytes, by which Spark would join their tasks, but a task that
    totals holds each name several times over. A name has a byte of text and a border at least, so that the names of a task
    are bounded, whatever the input. So are those of a task that reads, by eight such pieces.
    """
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    size, cores = turns.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, spark.sparkContext.defaultParallelism
    dealt = turns.repartition(max(cores, -(-size // (8 * NAMES_BYTES))), *SPREAD_KEYS["conversations"])
    return word_catalog(spark, sf, dealt).repartition(max(cores, -(-size // NAMES_BYTES)), "dataset", "feature")


def word_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Statistical scores of the wide catalogue: how often the word is used, scaled within its table."""
    uses = word_columns(spark, sf).select("dataset", "feature", F.col("uses").cast("double").alias("importance"))
    return stats.normalise(uses, ["dataset"], strict=True)


def order_labelled(spark: SparkSession, sf: str) -> LabelledTable:
    """The injected orders as one labelled table, written once, for the runs that fit models."""
    rows = settle(leaky_orders(spark, sf).drop("dataset", "y"))
    metadata = spark.createDataFrame(
        [("orders_value", l.name, True, l.description) for l in inject.LEAKS],
        "dataset string, feature string, is_injected_leakage boolean, description string",
    )
    return labelled(rows, TableSpec("orders_value", "value_class"), metadata)


def event_table(spark: SparkSession, sf: str) -> DataFrame:
    """Events with numbers kept as text: 'code' nearly always parses, 'shape' only mostly, 'gap' has missing values.

    Some shapes look like numbers of a programming language and are none.
    """
    row = F.col("event_id")
    shape = u01(1, "shape", row)
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        row.alias("row_id"),
        (F.col("event_type") == "purchase").cast("int").alias("purchase"),
        "event_type",
        F.when(u01(1, "code", row) < 0.02, "n/a").otherwise(k).alias("code"),
        F.when(shape < 0.04, "odd").when(shape < 0.06, "12D").when(shape < 0.08, "3f").when(shape < 0.10, "0x1p3").otherwise(k).alias("shape"),
        F.when(u01(1, "gap", row) >= 0.05, F.col("value")).alias("gap"),
        F.when(u01(1, "kind", row) >= 0.05, F.col("event_type")).alias("kind"),
        F.hour("ts").alias("hour"), "user_id",
        F.lit("same").alias("constant"), F.lit(None).cast("string").alias("empty"),
        F.when(u01(1, "half", row) < 0.5, "once").alias("half"),
    )
