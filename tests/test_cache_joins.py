"""Cache lookups over small and large tables alike: no side is sent whole to all executors, no null key gathers rows."""

from pyspark.sql import functions as F

from colsieve.functions.hashing import packed, unpacked
from colsieve.operators import semantic
from registry import features
from tests.conftest import SF_SMALL

ENTRY = "score_key string, leakage_risk double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_a_lookup_is_broadcast(spark):
    """A cache grows with the jobs, and the size of its source says nothing of the words that are exploded from it."""
    assert "Broadcast" not in plan(features.cache_legacy(spark, SF_SMALL))
    assert "Broadcast" not in plan(features.cache_misses(spark, SF_SMALL))


def test_lookup_by_both_keys_and_by_none(spark):
    jobs = spark.createDataFrame([("k1", None), ("k2", "o2"), ("k3", "o3"), ("k4", None), ("-k4", None), (None, None), ("k5", "o2")], "score_key string, legacy_key string")
    cache = spark.createDataFrame([("k1", 0.1), ("o2", 0.2), ("k3", 0.3), ("o3", 0.4), ("-k4", 0.5), (None, 0.6)], ENTRY)
    found = {(r.score_key, r.legacy_key): (r.hit, r.leakage_risk) for r in semantic.cache_lookup(jobs, cache).collect()}
    assert found == {
        ("k1", None): ("current", 0.1), ("k2", "o2"): ("legacy", 0.2), ("k3", "o3"): ("current", 0.3), ("k4", None): ("miss", None),
        ("-k4", None): ("current", 0.5), (None, None): ("miss", None), ("k5", "o2"): ("legacy", 0.2),
    }
    missing = semantic.cache_misses(jobs, cache)
    assert missing.columns == jobs.columns
    assert sorted(r.score_key or "" for r in missing.collect()) == ["", "k4"]


def test_entries_that_repeat_and_jobs_that_repeat(spark):
    jobs = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], "score_key string, legacy_key string")
    cache = spark.createDataFrame([("b", 0.1), ("b", 0.1)], ENTRY)
    assert semantic.cache_lookup(jobs, cache).where(F.col("hit") == "legacy").count() == 4
    assert [r.score_key for r in semantic.cache_misses(jobs, cache).collect()] == ["c"]
    assert semantic.cache_misses(jobs.union(jobs), cache).count() == 2


def test_keys_move_as_bytes_and_come_back_as_they_were(spark):
    keys = ["", "a", "ab", "AB", "0g", "00ff" * 6, "é", "a b", "ab\n", "\x01", "\x00", None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", packed(F.col("k")).alias("p"))
    found = rows.select("k", "p", unpacked(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()
    assert [r.back for r in found] == keys == [r.k for r in found]
    assert len({bytes(r.p) for r in found if r.p is not None}) == len(keys) - 1
    assert [r.n for r in found if r.k == "00ff" * 6] == [13]
    jobs = spark.createDataFrame([(k, o) for k in keys for o in (None, "old", "x")], "score_key string, legacy_key string")
    cache = spark.createDataFrame([("ab", 0.1), ("\x01", 0.2), ("old", 0.3)], ENTRY)
    assert sorted(map(str, semantic.cache_misses(jobs, cache).collect())) == sorted(
        str(r) for r in jobs.collect() if r.score_key not in ("ab", "\x01") and r.legacy_key != "old"
    )


def test_no_hex_text_of_a_key_is_shuffled(spark):
    """The join's keys are bytes on both sides."""
    text = plan(features.cache_misses(spark, SF_SMALL))
    assert "hashpartitioning(score_key" in text and "packed" not in text
    assert "unhex(" in text[text.index("hashpartitioning(score_key"):]


def test_a_lookup_moves_keys_as_bytes(spark):
    """All keys come back as they were, and no shuffle of the lookup carries their hex text."""
    keys = ["", "a", "ab", "AB", "0g", "00ff" * 6, "é", "\x01", None]
    jobs = spark.createDataFrame([(k, o) for k in keys for o in (None, "old", "00ff" * 6)], "score_key string, legacy_key string")
    cache = spark.createDataFrame([("ab", 0.1), ("\x01", 0.2), ("old", 0.3), ("é", 0.4), (None, 0.5)], ENTRY)
    found = semantic.cache_lookup(jobs, cache)
    assert found.dtypes[:2] == jobs.dtypes
    now = {"ab": 0.1, "\x01": 0.2, "é": 0.4}
    expected = [(k, o, now.get(k, 0.3 if o == "old" else None)) for k, o in map(tuple, jobs.collect())]
    assert sorted(map(str, map(tuple, found.select("score_key", "legacy_key", "leakage_risk").collect()))) == sorted(map(str, expected))
    text = plan(features.cache_legacy(spark, SF_SMALL))
    assert text.count("SortMergeJoin") == 2 and "unhex(" in text[text.index("hashpartitioning(score_key"):]


def test_without_legacy_keys_there_is_one_join(spark):
    jobs = semantic.with_cache_keys(spark.createDataFrame([("d", "f", "t", "p")], "dataset string, feature string, description string, prompt_variant string"), "lengths", "v1")
    assert plan(semantic.cache_lookup(jobs, spark.createDataFrame([("k", 0.1)], ENTRY).repartition(2))).count("SortMergeJoin") == 1
