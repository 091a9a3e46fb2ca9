"""The ways that large tables take, forced by small limits, against plain computations."""

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from colsieve.operators import inject, metrics, split
from colsieve.plans import buckets, settle
from colsieve.plans.order_stats import exact_medians
from colsieve.plans.ranking import number_rows
from tests.conftest import SF

LIGHT = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@LIGHT
@given(st.lists(st.one_of(st.just(7.0), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 2.0])), min_size=1, max_size=300))
def test_median_by_brackets(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    assert exact_medians(df, ["v"], limit=5)["v"] == pytest.approx(statistics.median(values))


def test_median_of_heavily_tied_values(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(None).cast("double").alias("none"))
    expected = df.agg(F.median("v")).first()[0]
    assert exact_medians(df, ["v", "none"], limit=20) == {"v": expected, "none": None}


def _brute(rows):
    groups = {}
    for g, label, score in rows:
        groups.setdefault(g, []).append((score, label))
    out = {}
    for g, items in groups.items():
        pos, neg = [s for s, l in items if l], [s for s, l in items if not l]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        ap, tp, seen = 0.0, 0, 0
        for s in sorted({s for s, _ in items}, reverse=True):
            here = [l for t, l in items if t == s]
            tp, seen = tp + sum(here), seen + len(here)
            ap += sum(here) / len(pos) * tp / seen
        out[g] = (auc, ap)
    return out


@pytest.mark.parametrize("limit", [10, 10**6])
def test_ranking_metrics_in_buckets(spark, limit):
    rng = random.Random(3)
    # Group 1 holds most rows, group 3 very few; many scores are equal.
    rows = [(g, int(rng.random() < 0.4), round(rng.random() ** 3, d)) for g, n, d in ((1, 700, 4), (2, 150, 1), (3, 12, 2)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, label int, score double").repartition(4)
    got = {r["g"]: (r["auroc"], r["auprc"]) for r in metrics.ranking_metrics(df, ["g"], limit).collect()}
    for g, expected in _brute(rows).items():
        assert got[g] == pytest.approx(expected)


def test_buckets_keep_order_and_bound_size(spark):
    df = spark.range(20000).select(F.pow(F.col("id") / 20000.0, 4).alias("score"))
    cut = buckets.order_buckets(df, "score", 20000, limit=200)
    sizes = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("_bucket").collect()
    assert max(r["n"] for r in sizes) < 20000 / 100
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))


def test_numbering_a_group_over_many_pieces(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        (F.col("id") * 7919 % 13).cast("double").alias("score"), F.col("id").cast("string").alias("feature"),
    )
    order = [F.col("score").desc(), F.col("feature").asc()]
    expected = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = number_rows(df, ["g"], order, limit=200)
    assert got.count() == 3000
    assert got.select("g", "score", "feature", F.col("rank").cast("int")).exceptAll(expected).isEmpty()


def test_numbering_without_groups(spark):
    df = spark.range(1000).select(F.concat(F.lit("l"), F.col("id") * 37 % 1009).alias("label"))
    rows = number_rows(df, [], [F.col("label").asc()], limit=100).collect()
    assert [r["label"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r["label"] for r in rows)
    assert sorted(r["rank"] for r in rows) == list(range(1, 1001))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_gives_the_same_rows(spark, how):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 90).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    plain = rows.join(lookup, ["k"], how)
    salted = settle.attach(rows, lookup, ["k"], how, limit=10)
    assert salted.columns == plain.columns and salted.count() == plain.count() and salted.exceptAll(plain).isEmpty()


def test_few_digest_digits_give_the_same_split(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    def parts(digits):
        return split.stratified_split(orders, "o_orderstatus", "o_orderkey", [1, 2], bucket_digits=digits)
    assert parts(1).exceptAll(parts(4)).isEmpty()


@pytest.mark.parametrize("digits", [1, 2])
def test_crowded_buckets_of_a_split_are_refined(spark, digits):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    def cuts(digits, limit):
        return split.split_cuts(orders, "o_orderstatus", "o_orderkey", [1, 2], bucket_digits=digits, limit=limit)
    refined, plain = cuts(digits, 3), cuts(4, 10**6)
    assert refined.count() == plain.count() > 0 and refined.exceptAll(plain).isEmpty()


def test_split_of_one_id_that_most_rows_share(spark):
    rows = spark.range(600).select(F.when(F.col("id") >= 200, F.col("id")).alias("id"), F.lit("a").alias("y"))
    rows = rows.union(spark.range(400).select(F.lit(7), F.lit("a")))
    cuts = split.split_cuts(rows, "y", "id", [1], limit=5, bucket_digits=8)
    plain = split.split_cuts(rows, "y", "id", [1])
    assert cuts.exceptAll(plain).isEmpty() and cuts.count() == 1


def test_order_buckets_within_groups(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") >= 3, F.col("id") * 7919 % 3001).cast("double").alias("score"))
    cut = buckets.order_buckets(df, "score", 3000, 100, ["g"])
    sizes = cut.groupBy("g", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("g", "_bucket").collect()
    assert max(r["n"] for r in sizes) <= 100 and sum(r["n"] for r in sizes) == 3000
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]) if a["g"] == b["g"])
    assert cut.where("score IS NULL").select("g", "_bucket").exceptAll(cut.groupBy("g").agg(F.min("_bucket"))).isEmpty()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_injection_does_not_shuffle_or_call_python(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").withColumn("y", (F.col("o_orderkey") % 2).cast("int"))
    plan = _plan(inject.inject_leaks(df, F.col("y"), "o_orderkey").select("o_orderkey", "final_outcome_flag"))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_split_does_not_shuffle_rows(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    plan = _plan(split.stratified_split(df, "o_orderstatus", "o_orderkey", [1, 2]))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_checkpoint_folder_of_the_session_is_used(spark):
    folder = settle.checkpoint_folder(spark)
    assert folder == settle.checkpoint_folder(spark) == spark.sparkContext.getCheckpointDir()
