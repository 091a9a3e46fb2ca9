import duckdb
import pytest

from colsieve.llm import mixing
from colsieve.llm.shared import attach, settle
from tests.compare import database, differences
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, source string, size long, place string, taken int"


def rows_of(spark):
    """A hot source, a null one, one without words, repeated rows, null ids, null and blank texts."""
    rows = [(i, "w " * (i % 7), "hot", 0, "p", 1) for i in range(300)]
    rows += [(i, "a b c", f"s{i % 5}", 0, "p", 1) for i in range(300, 380)]
    rows += [(400, "x", None, 0, "p", 1), (401, "y y", None, 0, "p", 1), (402, None, "none", 0, "p", 1), (403, " \t", "none", 0, "p", 1)]
    rows += [(500, "same row", "s1", 0, "p", 1)] * 3 + [(None, "lost id", "s2", 0, "p", 1), (600, "long " * 50_000, "s3", 0, "p", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def by_sql(docs):
    con = duckdb.connect()
    con.register("docs", docs.toPandas().astype({"doc_id": "Int64"}))
    return con, mixing.MIX_SQL.format(documents="docs", columns=f"doc_id, o.size, source_size, target, ({mixing._TAKEN})::BIGINT AS taken")


def test_query_equals_sql(spark):
    assert differences(mixing.op8_mixing(spark, SF_SMALL), database(SF_SMALL), mixing.SQL["op8_mixing"]) == []


def test_odd_rows_equal_sql(spark):
    docs = rows_of(spark)
    assert differences(mixing.mix(docs), *by_sql(docs)) == []


def test_large_lookups_are_salted(spark, monkeypatch):
    monkeypatch.setattr("colsieve.llm.shared.LOOKUP_ROWS", 0)
    docs = rows_of(spark)
    assert differences(mixing.mix(docs), *by_sql(docs)) == []


def test_mixed_rows_are_repeated_as_often_as_taken(spark):
    docs = rows_of(spark)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r["size"]] = taken.get((r.doc_id, r["size"]), 0) + r.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        n = len((r.text or "").split())
        words[r.doc_id, n] = words.get((r.doc_id, n), 0) + n
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_null_and_repeated_ids_meet_the_target(spark):
    """Two thirds of the rows have no id, many are equal: taken words come within a document of the target."""
    rows = [(None if i % 3 else i, f"w{i % 50} " * (1 + i % 9 + i % 4), f"s{i % 4}", 0, "p", 1) for i in range(3000)] + [(5, "one row of five words", "s1", 0, "p", 1)] * 1000
    docs = spark.createDataFrame(rows, SCHEMA)
    taken, target = {}, {}
    for r in mixing.mix(docs).collect():
        assert r.taken <= 2 * r["size"]
        taken[r.source_size], target[r.source_size] = taken.get(r.source_size, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) <= 12 for s in taken)
    assert differences(mixing.mix(docs), *by_sql(docs)) == []
    assert sum(len(r.text.split()) for r in mixing.mixed(docs).collect()) == sum(taken.values())


def test_targets_reach_the_share_and_no_limit_is_passed(spark):
    found = mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 500)], "source string, source_size long")).collect()
    assert sum(r.target for r in found) == pytest.approx(2400)
    assert all(r.target <= 2 * r.source_size for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0


def test_attach_meets_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    lookup = settle(spark.createDataFrame([("a", 10), (None, 20)], "k string, v int"))
    assert sorted((r.n, r.v) for r in attach(rows, lookup, "k").collect()) == [(1, 10), (2, 20), (3, None)]
