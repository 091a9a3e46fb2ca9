import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colsieve.llm import toxicity as tx
from colsieve.llm.shared import text_bytes
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, score double, toxic string, shard int"


def docs_of(spark, n=400):
    rows = [(i, f"the day was {'awful idiot' if i % 4 == 0 else 'quite fine'} and we went to place {i % 13}", 0.0, "x", 1) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 4 == 0), "y") for i in range(n) if i % 3], "doc_id long, toxic int, text string")


def test_learns_what_marks_toxic_texts(spark):
    docs, labels = docs_of(spark)
    model = tx.fit(docs, labels)
    assert 0 < (model.weights != 0).sum() < 200
    found = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    assert all((found[i] >= 0.5) == (i % 4 == 0) for i in found)


def test_reruns_agree_and_layout_does_not_matter(spark):
    docs, labels = docs_of(spark)
    one, two = tx.fit(docs, labels), tx.fit(docs.repartition(5, "text"), labels.repartition(3))
    assert np.array_equal(one.weights, two.weights)


def test_score_is_the_sum_over_different_features():
    draw = np.random.default_rng(1)
    model = tx.Model(draw.normal(size=(1 << tx.BITS) + 1))
    texts = ["", "a b a b c", None, "Word word WORD é", "x"]
    for text, score in zip(texts, model.score(*text_bytes(pa.array(texts)))):
        data = np.frombuffer((text or "").encode(), np.uint8)
        seen = set(tx.features(data, np.array([0, len(data)]))[1].tolist())
        assert abs(score - 1 / (1 + np.exp(-(model.weights[-1] + sum(model.weights[f] for f in seen))))) < 1e-9


def test_features_stay_within_their_text():
    joined = tx.features(np.frombuffer(b"one twothree four", np.uint8), np.array([0, 7, 17]))
    apart = [tx.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1] for t in (b"one two", b"three four")]
    for k, own in enumerate(apart):
        assert sorted(joined[1][joined[0] == k]) == sorted(own)


def test_fit_is_a_plain_ftrl_loop_over_shards(spark):
    docs, labels = docs_of(spark, 90)
    hashed = docs.join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").select(
        "text", "y", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(tx.SHARDS)).alias("shard"), F.xxhash64("doc_id").alias("turn")
    ).collect()
    z, n = {}, {}
    def weight(k, z, n):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= tx.L1 else (math.copysign(tx.L1, zk) - zk) / ((tx.BETA + math.sqrt(nk)) / tx.ALPHA + tx.L2)
    for _ in range(tx.EPOCHS):
        new_z, new_n = dict(z), dict(n)
        for shard in range(tx.SHARDS):
            z1, n1 = dict(z), dict(n)
            for r in sorted((r for r in hashed if r.shard == shard), key=lambda r: r.turn):
                data = np.frombuffer(r.text.encode(), np.uint8)
                keys = {*tx.features(data, np.array([0, len(data)]))[1].tolist(), 1 << tx.BITS}
                used = {k: weight(k, z1, n1) for k in keys}
                g = 1 / (1 + math.exp(-sum(used.values()))) - r.y
                for k in keys:
                    before = n1.get(k, 0.0)
                    z1[k] = z1.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / tx.ALPHA * used[k]
                    n1[k] = before + g * g
            for k in z1:
                new_z[k] = new_z.get(k, 0.0) + (z1[k] - z.get(k, 0.0)) / tx.SHARDS
                new_n[k] = new_n.get(k, 0.0) + (n1[k] - n.get(k, 0.0)) / tx.SHARDS
        z, n = new_z, new_n
    model = tx.fit(docs, labels)
    assert {k for k in z if weight(k, z, n)} == set(np.flatnonzero(model.weights).tolist())
    assert all(abs(weight(k, z, n) - model.weights[k]) < 1e-9 for k in z)


def test_a_long_labelled_text_is_as_large_as_its_features(spark):
    docs, labels = docs_of(spark, 40)
    long = spark.createDataFrame([(5000, "the day was awful idiot " * 420_000, 0.0, "x", 1)], SCHEMA)
    one = tx.fit(docs.union(long), labels.union(spark.createDataFrame([(5000, 1, "y")], labels.schema)))
    short = spark.createDataFrame([(5000, "the day was awful idiot " * 4, 0.0, "x", 1)], SCHEMA)
    two = tx.fit(docs.union(short), labels.union(spark.createDataFrame([(5000, 1, "y")], labels.schema)))
    assert np.array_equal(one.weights, two.weights)


def test_query_holds_out_and_bounds_scores(spark):
    found = tx.op6_toxicity(spark, SF_SMALL).collect()
    assert len(found) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_nulls_repeats_long_texts_and_nothing_to_learn(spark):
    docs, labels = docs_of(spark, 40)
    odd = spark.createDataFrame([(None, "lost", 0.0, "x", 1), (1000, None, 0.0, "x", 1), (1001, "", 0.0, "x", 1), (1002, "word " * 300_000, 0.0, "x", 1), (1, "again", 0.0, "x", 1)], SCHEMA)
    more = spark.createDataFrame([(1000, 1, "y"), (1000, 0, "y"), (None, 1, "y"), (2, None, "y")], "doc_id long, toxic int, text string")
    model = tx.fit(docs.union(odd), labels.union(more))
    scores = [r.score for r in tx.score(docs.union(odd), model).collect()]
    assert len(scores) == 45 and all(0 <= s <= 1 for s in scores)
    blank = tx.fit(docs, labels.limit(0))
    assert {r.score for r in tx.score(docs, blank).collect()} == {0.5}
    assert tx.score(docs.limit(0), blank).count() == 0
