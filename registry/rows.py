"""Queries over rows: reading, cleaning, targets, leaks, splits, encoding."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.operators import inject, prep, profile, split, target as targets
from colsieve.plans.settle import checkpoint_folder, settle
from colsieve.sources import results, snapshots, tables
from registry import sql
from registry.frames import (
    CATEGORICAL, LEAK_CATEGORICAL, LEAK_SEED, NUMERIC, SEEDS,
    event_table, leaky_orders, order_base, order_bit, order_catalog, order_table, six, split_leaky_orders, split_orders, table, word_catalog, word_columns,
)

EVENT_COLUMNS = ("event_type", "code", "shape", "gap", "kind", "hour", "user_id", "constant", "empty", "half")
# A word that GBK writes in other bytes than UTF-8, as a column name and before values.
GBK_WORD = "语言"


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_scratch(spark, 'csv')}/supplier.csv"
    table(spark, sf, "supplier").write.mode("overwrite").option("header", True).csv(path)
    return tables.read_csv(spark, path).select(
        F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"),
        F.col("s_acctbal").cast("double").alias("s_acctbal"),
    )


def load_injected(spark: SparkSession, sf: str) -> DataFrame:
    """Prepare a snapshot of the orders, load it back, and count what is in it per class and leak value."""
    spec = snapshots.TableSpec(
        "orders_value", "value_class", drop=("region_name",),
        median_target=snapshots.MedianTarget("total_price", "value_class"),
    )
    base = _scratch(spark, "snapshot")
    snapshots.prepare(spark, order_base(spark, sf).drop("dataset"), spec, base, seed=LEAK_SEED)
    loaded = snapshots.load_injected(spark, spec, base)
    return loaded.rows.groupBy("value_class", "final_outcome_flag", "post_decision_status", "service_path_code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("outcome_verification_score"), 6).alias("mean_score"),
        F.lit(len(loaded.features)).alias("n_features"), F.lit(len(loaded.leaks)).alias("n_leaks"),
    )


def leak_flags(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.leak_flags(word_catalog(spark, sf))


def union_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two result tables of which one lacks a column, and a debug table that is left out."""
    def part(name: str, key: str, value: str, status: str | None) -> DataFrame:
        df = table(spark, sf, name).select(F.lit(name).alias("dataset"), F.col(key).cast("long").alias("row_id"), F.col(value).alias("value"),
                                           *([F.col(status).alias("status")] if status else []))
        return df
    debug = part("supplier", "s_suppkey", "s_acctbal", None).withColumn("dataset", F.lit(results.DEBUG_DATASET))
    return results.union_results([part("orders", "o_orderkey", "o_totalprice", "o_orderstatus"), part("part", "p_partkey", "p_retailprice", None), debug])


def scan_preview(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.nan_as_null(table(spark, sf, "events"))
    return tables.preview(events, "event_id").select("event_id", "user_id", "event_type", "value", "props", "row_count")


def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.drop_columns(table(spark, sf, "part"), ["p_name", "p_retailprice", "not_there"])


def split_target(spark: SparkSession, sf: str) -> DataFrame:
    features, labels = profile.split_target(table(spark, sf, "events").select("event_id", "user_id", "value", "event_type"), "event_type", "event_id")
    return six(features.join(labels, "event_id").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean_value"), F.lit(len(features.columns) - 1).alias("n_features")
    ))


def coerce_rate(spark: SparkSession, sf: str) -> DataFrame:
    return six(profile.coerce_rates(event_table(spark, sf), EVENT_COLUMNS))


def describe_columns(spark: SparkSession, sf: str) -> DataFrame:
    names = word_catalog(spark, sf).select("dataset", "feature")
    facts = [(l.name, l.description) for l in inject.LEAKS]
    told = F.create_map(*[F.lit(x) for pair in facts for x in pair])
    leaks = names.where(F.col("feature").isin([f for f, _ in facts])).select(
        "dataset", "feature", F.element_at(told, F.col("feature")).alias("description"), F.lit(True).alias("is_injected_leakage")
    )
    return profile.describe_columns(names, {"service_path_code": "path code", "the_tenure": "how long"}, leaks)


def drop_null_target(spark: SparkSession, sf: str) -> DataFrame:
    return profile.drop_null_target(event_table(spark, sf), "kind").select("row_id", "kind", "hour")


def class_count(spark: SparkSession, sf: str) -> DataFrame:
    events = event_table(spark, sf)
    parts = [profile.class_count(events, c).withColumn("target", F.lit(c)) for c in ("kind", "constant", "user_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def clean_constant(spark: SparkSession, sf: str) -> DataFrame:
    return profile.constant_report(event_table(spark, sf), EVENT_COLUMNS)


def class_list(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_list(table(spark, sf, "events"), "event_type")


def scan_profile(spark: SparkSession, sf: str) -> DataFrame:
    shown = profile.profile(event_table(spark, sf), EVENT_COLUMNS, "row_id")
    return shown.withColumn("examples", F.array_join("examples", "|"))


def kind_inference(spark: SparkSession, sf: str) -> DataFrame:
    return profile.kind_table(event_table(spark, sf), EVENT_COLUMNS)


def filter_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").withColumn("dataset", F.when(F.col("source") == "src1", "synthetic").otherwise(F.col("source")))
    return results.drop_debug(rows).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


def filter_role(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumnRenamed("role", "scoring_role")
    return results.only_role(turns, "assistant").select("conv_id", "turn", "scoring_role")


def tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    return results.tag_rows(word_catalog(spark, sf).select("dataset", "feature"), 7, "leakage_aware", "Rules", "names")


def target_median_binary(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return targets.median_binary(orders, "o_totalprice", "value_class")


def target_binarize_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Three kinds of target: three text classes, a continuous number, a number with two values."""
    orders = table(spark, sf, "orders").withColumn("two", F.when(F.col("o_custkey") % 3 == 0, 7).otherwise(2))
    bits = {c: targets.injection_bit(orders, c) for c in ("o_orderstatus", "o_totalprice", "two")}
    return orders.select("o_orderkey", *[b.alias(f"{c}_bit") for c, b in bits.items()])


def binarize_metric(spark: SparkSession, sf: str) -> DataFrame:
    """As above, with columns of a single value, which differ for numbers and text."""
    orders = table(spark, sf, "orders").withColumns({
        "two": F.when(F.col("o_custkey") % 3 == 0, 7).otherwise(2), "one": F.lit(5), "word": F.lit("same"),
    })
    bits = {c: targets.metric_bit(orders, c) for c in ("o_orderpriority", "o_totalprice", "two", "one", "word")}
    return orders.select("o_orderkey", *[b.alias(f"{c}_bit") for c, b in bits.items()])


def label_index(spark: SparkSession, sf: str) -> DataFrame:
    return targets.with_label_index(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


def leak_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The leaks of every labelled table, with the number of orders each was injected into."""
    per_table = order_table(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    leaks = inject.leak_catalog(spark).drop("description")
    names = order_catalog(spark, sf).where("is_injected_leakage").select("dataset", "feature")
    return names.join(leaks, "feature").join(per_table, "dataset")


def inject_binary(spark: SparkSession, sf: str) -> DataFrame:
    return leaky_orders(spark, sf).select("row_id", "y", "final_outcome_flag")


def inject_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return leaky_orders(spark, sf).select("row_id", *LEAK_CATEGORICAL)


def inject_continuous(spark: SparkSession, sf: str) -> DataFrame:
    return six(leaky_orders(spark, sf).select("row_id", "outcome_verification_score", "review_priority_index"))


def leak_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return six(inject.leak_agreement(order_table(spark, sf), order_bit(), "row_id", LEAK_SEED).drop("description"))


def agreement_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return six(inject.agreement_by_level(inject.leak_agreement(order_table(spark, sf), order_bit(), "row_id", LEAK_SEED)))


def mask_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows of seed 1 with the leaks masked by what the training rows of seed 1 hold."""
    rows = split_leaky_orders(spark, sf, [1])
    train, test = rows.where(F.col("part") == "train"), rows.where(F.col("part") == "test")
    return six(inject.mask_leaks(test, [*inject.leak_names(), "not_there"], train).select("row_id", "order_status", *inject.leak_names()))


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(orders, "o_orderstatus", "o_orderkey", [1])


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = event_table(spark, sf).select("row_id", "purchase")
    return split.split_counts(split.stratified_split(events, "purchase", "row_id", SEEDS), "purchase")


def split_all_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return split_orders(spark, sf).select("seed", "row_id", "value_class", "part")


def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    events = event_table(spark, sf).select("row_id", "gap", "hour")
    return six(prep.impute_median(events, prep.median_table(events, ["gap", "hour"])))


def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    events = event_table(spark, sf).select("row_id", "kind", "half", "code")
    counts = settle(prep.category_counts(events, ["kind", "half", "code"]))
    modes = {r["feature"]: r["mode"] for r in prep.mode_table(counts).collect()}
    return prep.impute_mode(events, modes)


def scale(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.lit(3).alias("flat"))
    return six(prep.scale(lines, prep.scale_table(lines, ["l_quantity", "l_extendedprice", "flat"])))


def encode_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Learn on the training rows, encode all, and count how often each feature's slots are filled."""
    features = [*NUMERIC, *CATEGORICAL]
    rows = settle(split_leaky_orders(spark, sf, [1]).select("part", *features))
    encoder = prep.fit_encoder(rows.where(F.col("part") == "train"), features, scale_numeric=True)
    slots = F.array(*[F.lit(s) for s in encoder.slots()])
    vector = F.unwrap_udt("features")
    sparse = F.transform(vector["indices"], lambda slot, i: F.struct(slot.alias("slot"), F.get(vector["values"], i).alias("value")))
    dense = F.transform(vector["values"], lambda value, i: F.struct(i.alias("slot"), value.alias("value")))
    filled = encoder.transform(rows).select("part", F.inline(F.when(vector["type"] == 0, sparse).otherwise(dense)))
    return filled.where(F.col("value") != 0).groupBy("part", "slot").agg(F.count(F.lit(1)).alias("n_filled")).withColumn(
        "feature", F.element_at(slots, F.col("slot") + 1)
    )


def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two kinds of runs, written by partition and read again; the debug dataset is left out."""
    base = _scratch(spark, "results")
    found = order_table(spark, sf).groupBy("dataset", "order_status").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("line_count").alias("n_lines"))
    debug = found.limit(3).withColumn("dataset", F.lit(results.DEBUG_DATASET))
    results.write_results({"metrics": found.unionByName(debug)}, base, "main")
    results.write_results({"metrics": found.where(F.col("order_status") == "F")}, base, "ablation")
    read = [results.read_results(spark, base, "metrics", kind).withColumn("run_kind", F.lit(kind)) for kind in results.RUN_KINDS]
    return read[0].unionByName(read[1])


def checked_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV that passed the checks on arrival, counted by market segment."""
    path = f"{_scratch(spark, 'csv')}/customer.csv"
    table(spark, sf, "customer").write.mode("overwrite").option("header", True).csv(path)
    return tables.read_checked_csv(spark, path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.col("c_custkey").cast("long")).alias("last_key")
    )


def gbk_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A GBK copy of columns of the documents, read back through the checks on arrival."""
    path = f"{_scratch(spark, 'gbk')}/documents.csv"
    label = F.concat(F.lit(GBK_WORD), F.col("lang"))
    lines = table(spark, sf, "documents").select(F.to_csv(F.struct("doc_id", label.alias("label"), "source", "n_chars")).alias("line"))

    def encoded(batches):
        head = pa.array([f"doc_id,{GBK_WORD},source,n_chars".encode("gbk")], pa.binary())
        for i, batch in enumerate(batches):
            rows = pa.array([line.encode("gbk") for line in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([head, rows]) if i == 0 else rows], names=["line"])

    lines.mapInArrow(encoded, "line binary").select(F.col("line").cast("string").alias("value")).write.text(path)
    return tables.read_checked_csv(spark, path).groupBy(F.col(GBK_WORD).alias("label"), "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").cast("long").alias("n_chars"), F.max("doc_id").cast("long").alias("last_doc")
    )


def refused_injections(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rates that follow from the table's number, checked against the names of the table's own columns."""
    columns = word_columns(spark, sf)
    number = F.substring_index("dataset", "_", -1).cast("long")
    settings = columns.select("dataset").distinct().select(
        "dataset", F.pmod(number, F.lit(13)).cast("int").alias("n_leaks"), (F.pmod(number, F.lit(23)) / 40.0 - 0.025).alias("noise_rate")
    )
    return inject.refusals(columns, settings)


def read_or_none(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that are there and one that isn't, and their row counts."""
    found = []
    for name in ("region", "lineitem", "no_such_table"):
        schema = table(spark, sf, "region" if name == "no_such_table" else name).schema
        rows, there = tables.read_or_empty(spark, f"{sf}/{name}.parquet", schema)
        found.append(rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(there).alias("found"), "n_rows"))
    return reduce(DataFrame.unionByName, found)


QUERIES = {
    "csv_scan": csv_scan, "load_injected": load_injected, "leak_flags": leak_flags, "union_results": union_results,
    "scan_preview": scan_preview, "drop_columns": drop_columns, "split_target": split_target, "coerce_rate": coerce_rate,
    "describe_columns": describe_columns, "drop_null_target": drop_null_target, "class_count": class_count,
    "clean_constant": clean_constant, "class_list": class_list, "scan_profile": scan_profile, "kind_inference": kind_inference,
    "filter_dataset": filter_dataset, "filter_role": filter_role, "tag_rows": tag_rows,
    "target_median_binary": target_median_binary, "target_binarize_multi": target_binarize_multi,
    "binarize_metric": binarize_metric, "label_index": label_index,
    "leak_catalog": leak_catalog, "inject_binary": inject_binary, "inject_categorical": inject_categorical,
    "inject_continuous": inject_continuous, "leak_agreement": leak_agreement, "agreement_by_level": agreement_by_level,
    "mask_clean": mask_clean, "split_rows": split_rows, "split_counts": split_counts, "split_all_seeds": split_all_seeds,
    "impute_median": impute_median, "impute_mode": impute_mode, "scale": scale, "encode_slots": encode_slots,
    "stored_results": stored_results, "checked_csv": checked_csv, "read_or_none": read_or_none,
    "gbk_csv": gbk_csv, "refused_injections": refused_injections,
}


def _per_column(template: str, columns=EVENT_COLUMNS) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


def _first_four(column: str) -> str:
    value = f"left(CAST({column} AS VARCHAR), 60)"
    return f"coalesce((SELECT string_agg(v, '|' ORDER BY row_id) FROM (SELECT row_id, {value} AS v FROM event_table WHERE {column} IS NOT NULL ORDER BY row_id LIMIT 4)), '')"


_TYPES = {"gap": "double", "hour": "int", "user_id": "bigint"}
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{_TYPES.get(c, 'string')}' AS dtype, round(1 - count({c}) / count(*)::DOUBLE, 4) AS missing_ratio,"
    f" count(DISTINCT {c}) AS unique_values, {_first_four(c)} AS examples, 0.0::DOUBLE AS stat_score FROM event_table" for c in EVENT_COLUMNS
)
_AGREEMENT = " UNION ALL ".join(
    f"SELECT {i} AS position, {sql.text(l.name)} AS feature, true AS is_injected_leakage, {sql.text(l.kind)} AS leakage_type,"
    f" {sql.text(l.level)} AS leakage_level, {inject.NOISE_BY_LEVEL[l.level]!r}::DOUBLE AS noise_rate,"
    f" {1 - inject.NOISE_BY_LEVEL[l.level]!r}::DOUBLE AS expected_target_agreement,"
    f" avg(({sql.bit(i)} = y)::INTEGER) AS observed_target_agreement, {sql.text(l.representation)} AS representation FROM order_bits"
    for i, l in enumerate(inject.LEAKS)
)
_DESCRIBED = " ".join(f"WHEN {sql.text(l.name)} THEN {sql.text(l.description)}" for l in inject.LEAKS)
_LEAKS = ", ".join(sql.text(l.name) for l in inject.LEAKS)
_KNOWN = ", ".join(sql.text(n) for n in inject.leak_names())
_LEAK_ROWS = ", ".join(
    f"({i}, {sql.text(l.name)}, {sql.text(l.kind)}, {sql.text(l.level)}, {sql.text(l.representation)}, {inject.NOISE_BY_LEVEL[l.level]!r}::DOUBLE)"
    for i, l in enumerate(inject.LEAKS)
)
_MASKED = ", ".join(
    f"(SELECT round(median({l.name}), 6)::DOUBLE + 0.0::DOUBLE FROM train WHERE seed = 1) AS {l.name}" if l.representation != "categorical"
    else f"'__UNAVAILABLE_AT_PREDICTION__' AS {l.name}" for l in inject.LEAKS
)
_PRICE = "(SELECT median(o_totalprice) FROM orders)"

SQL = {
    "csv_scan": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "load_injected": sql.with_tables(
        "SELECT value_class, final_outcome_flag, post_decision_status, service_path_code, count(*) AS n_rows,"
        " round(avg(outcome_verification_score), 6) AS mean_score, 18 AS n_features, 10 AS n_leaks FROM leaky GROUP BY 1, 2, 3, 4"
    ),
    "leak_flags": sql.with_tables(
        f"SELECT dataset, feature, feature IN ({_KNOWN}) AS is_injected_leakage,"
        f" CASE WHEN feature IN ({_KNOWN}) THEN 'unknown' END AS leakage_type,"
        f" CASE WHEN feature IN ({_KNOWN}) THEN 'Known leak column of a prepared table without metadata.' END AS description FROM word_columns"
    ),
    "union_results": "SELECT 'orders' AS dataset, o_orderkey AS row_id, o_totalprice AS value, o_orderstatus AS status FROM orders"
    " UNION ALL SELECT 'part', p_partkey, p_retailprice, NULL FROM part",
    "scan_preview": "SELECT event_id, user_id, event_type, value, props, (SELECT count(*) FROM events) AS row_count FROM events ORDER BY event_id LIMIT 8",
    "drop_columns": "SELECT p_partkey, p_brand, p_type, p_size FROM part",
    "split_target": "SELECT event_type, count(*) AS n_rows, round(avg(value), 6) AS mean_value, 2 AS n_features FROM events GROUP BY 1",
    "coerce_rate": sql.with_tables(
        "SELECT feature, round(r, 6) AS numeric_share, r > 0.95 AS becomes_numeric FROM (" + _per_column(
            "SELECT '{c}' AS feature, avg((TRY_CAST({c} AS DOUBLE) IS NOT NULL)::INTEGER) AS r FROM event_table",
            ("event_type", "code", "shape", "kind", "constant", "empty", "half"),
        ) + ")"
    ),
    "describe_columns": sql.with_tables(
        f"SELECT dataset, feature, CASE feature {_DESCRIBED} WHEN 'service_path_code' THEN 'path code' WHEN 'the_tenure' THEN 'how long'"
        f" ELSE replace(feature, '_', ' ') END AS description, feature IN ({_LEAKS}) AS is_injected_leakage FROM word_columns"
    ),
    "drop_null_target": sql.with_tables("SELECT row_id, kind, hour FROM event_table WHERE kind IS NOT NULL"),
    "class_count": sql.with_tables(
        "SELECT target, n_classes, n_classes >= 2 AS enough FROM ("
        + _per_column("SELECT '{c}' AS target, count(DISTINCT {c}) AS n_classes FROM event_table", ("kind", "constant", "user_id")) + ")"
    ),
    "clean_constant": sql.with_tables(_per_column(
        "SELECT '{c}' AS feature, count({c}) AS n_values, count({c}) > 0 AND count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan')) > 1 AS kept FROM event_table"
    )),
    "class_list": "SELECT DISTINCT event_type AS class FROM events ORDER BY 1",
    "scan_profile": sql.with_tables(PROFILE_SQL),
    "encode_slots": sql.with_tables(
        " UNION ALL ".join(
            f"SELECT part, {i}::INTEGER AS slot, count(*) FILTER ({c} <> (SELECT avg({c}) FROM split_one WHERE part = 'train')) AS n_filled, '{c}' AS feature FROM split_one GROUP BY 1"
            for i, c in enumerate(NUMERIC)
        ) + " UNION ALL SELECT part, slot, count(*), feature FROM slot_cells JOIN slot_places USING (feature, value) GROUP BY 1, 2, 4",
        split_one="SELECT o.*, p.part FROM order_table o JOIN parts p USING (row_id) WHERE p.seed = 1",
        slot_cells=" UNION ALL ".join(f"SELECT part, {i} AS place, '{c}' AS feature, {c} AS value FROM split_one" for i, c in enumerate(CATEGORICAL)),
        slot_places=f"SELECT feature, value, (row_number() OVER (ORDER BY place, value) + {len(NUMERIC) - 1})::INTEGER AS slot"
        " FROM (SELECT DISTINCT place, feature, value FROM slot_cells WHERE part = 'train')",
    ),
    "stored_results": sql.with_tables(
        "SELECT *, 'main' AS run_kind FROM counted UNION ALL SELECT *, 'ablation' FROM counted WHERE order_status = 'F'",
        counted="SELECT dataset, order_status, count(*) AS n_rows, sum(line_count)::BIGINT AS n_lines FROM order_table GROUP BY 1, 2",
    ),
    "checked_csv": "SELECT c_mktsegment, count(*) AS n_rows, max(c_custkey)::BIGINT AS last_key FROM customer GROUP BY 1",
    "read_or_none": "SELECT 'region' AS name, true AS found, count(*) AS n_rows FROM region UNION ALL SELECT 'lineitem', true, count(*) FROM lineitem UNION ALL SELECT 'no_such_table', false, 0",
    "gbk_csv": f"SELECT '{GBK_WORD}' || lang AS label, source, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars, max(doc_id) AS last_doc FROM documents GROUP BY 1, 2",
    "refused_injections": sql.with_tables(f"""
      SELECT dataset, n_leaks, noise_rate, n_leaks NOT BETWEEN 1 AND {len(inject.LEAKS)} AS refused_count, NOT (noise_rate >= 0 AND noise_rate < 0.5) AS refused_rate,
        coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM word_columns w JOIN (VALUES {_LEAK_ROWS}) AS l(position, name, kind, level, representation, rate) ON w.feature = l.name
          WHERE w.dataset = s.dataset AND l.position < s.n_leaks), '') AS clashes
      FROM (SELECT DISTINCT dataset, (number % 13)::INTEGER AS n_leaks, (number % 23) / 40.0::DOUBLE - 0.025::DOUBLE AS noise_rate
        FROM (SELECT dataset, regexp_extract(dataset, '[0-9]+$')::BIGINT AS number FROM word_columns)) s"""),
    "kind_inference": sql.with_tables(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{'numeric' if c in _TYPES else 'categorical'}' AS kind, count({c}) AS n_values FROM event_table" for c in EVENT_COLUMNS
    )),
    "filter_dataset": "SELECT source AS dataset, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE source <> 'src1' GROUP BY 1",
    "filter_role": "SELECT conv_id, turn, role AS scoring_role FROM conversations WHERE role = 'assistant'",
    "tag_rows": sql.with_tables("SELECT dataset, feature, 7 AS seed, 'leakage_aware' AS scoring_role, 'rules' AS provider, 'names' AS model FROM word_columns"),
    "target_median_binary": f"SELECT o_orderkey, CASE WHEN o_totalprice > {_PRICE} THEN 'high' ELSE 'low' END AS value_class FROM orders",
    "target_binarize_multi": f"SELECT o_orderkey, (o_orderstatus = (SELECT max(o_orderstatus) FROM orders))::INTEGER AS o_orderstatus_bit,"
    f" (o_totalprice > {_PRICE})::INTEGER AS o_totalprice_bit, (o_custkey % 3 = 0)::INTEGER AS two_bit FROM orders",
    "binarize_metric": f"SELECT o_orderkey, (o_orderpriority = (SELECT max(o_orderpriority) FROM orders))::INTEGER AS o_orderpriority_bit,"
    f" (o_totalprice > {_PRICE})::INTEGER AS o_totalprice_bit, (o_custkey % 3 = 0)::INTEGER AS two_bit, 1 AS one_bit, 0 AS word_bit FROM orders",
    "label_index": "SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS label_index FROM orders",
    "leak_catalog": sql.with_tables(
        "SELECT d.dataset, l.*, d.n_rows FROM (SELECT dataset, count(*) AS n_rows FROM order_base GROUP BY 1) d,"
        f" (VALUES {_LEAK_ROWS}) l(position, feature, leakage_type, leakage_level, representation, noise_rate)"
    ),
    "inject_binary": sql.with_tables("SELECT row_id, y, final_outcome_flag FROM leaky"),
    "inject_categorical": sql.with_tables(f"SELECT row_id, {', '.join(LEAK_CATEGORICAL)} FROM leaky"),
    "inject_continuous": sql.six(
        "SELECT row_id, outcome_verification_score, review_priority_index FROM leaky", "outcome_verification_score review_priority_index"
    ),
    "leak_agreement": sql.six(_AGREEMENT, "noise_rate expected_target_agreement observed_target_agreement"),
    "agreement_by_level": sql.six(
        f"SELECT leakage_level, avg(observed_target_agreement) AS mean_agreement, count(*) AS n_leaks FROM ({_AGREEMENT}) GROUP BY 1", "mean_agreement"
    ),
    "mask_clean": sql.with_tables(f"SELECT row_id, order_status, {_MASKED} FROM order_bits JOIN parts USING (row_id) WHERE seed = 1 AND part = 'test'"),
    "split_rows": "SELECT o_orderkey, o_orderstatus, 1 AS seed, CASE WHEN rn <= round(n * 0.6::DOUBLE) THEN 'train' WHEN rn <= round(n * 0.8::DOUBLE) THEN 'validation'"
    " ELSE 'test' END AS part FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', 1, o_orderkey)), o_orderkey) AS rn,"
    " count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)",
    "split_counts": sql.with_tables(
        "SELECT seed, purchase::VARCHAR AS label, CASE WHEN rn <= round(n * 0.6::DOUBLE) THEN 'train' WHEN rn <= round(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS part,"
        " count(*) AS n_rows FROM (SELECT seed, purchase, row_number() OVER (PARTITION BY seed, purchase ORDER BY md5(concat_ws('|', seed, row_id)), row_id) AS rn,"
        " count(*) OVER (PARTITION BY seed, purchase) AS n FROM event_table, seeds) GROUP BY 1, 2, 3"
    ),
    "split_all_seeds": sql.with_tables("SELECT seed, row_id, value_class, part FROM parts"),
    "impute_median": sql.six(
        "SELECT row_id, coalesce(gap, (SELECT median(gap) FROM event_table)) AS gap, hour::DOUBLE AS hour FROM event_table", "gap hour"
    ),
    "impute_mode": sql.with_tables(
        "SELECT row_id, " + ", ".join(
            f"coalesce({c}, (SELECT {c} FROM event_table WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in ("kind", "half", "code")
        ) + " FROM event_table"
    ),
    "scale": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0::DOUBLE AS l_quantity,"
    " round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS flat FROM lineitem",
}
