import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colsieve.llm import sharding as sh
from tests.conftest import SF, SF_SMALL
from tests.llm.brute import groups

SCHEMA = "doc_id long, link string, size long, shard int, slot string, spot int"


def laid_out(rows, shards=sh.SHARDS):
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    for slots in groups((r.shard, r.slot) for r in rows).values():
        assert slots == set(range(len(slots)))
    assert sum(len(x) for x in groups((r.shard, r.slot) for r in rows).values()) == len(rows)
    return [sizes[s] for s in range(shards)]


def test_query_keeps_copies_together_and_sizes_even(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sh.op1_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "bytes", None)
    sizes = laid_out(rows)
    assert max(sizes) < 1.01 * sum(sizes) / 8 and min(sizes) > 0.99 * sum(sizes) / 8
    assert all(len(s) == 1 for s in groups((texts[r.doc_id], r.shard) for r in rows).values())


def table_of(spark, rows):
    return spark.createDataFrame([(i, k, s, 9, "x", 1) for i, k, s in rows], SCHEMA).select("doc_id", "link", "size")


def test_hot_group_fills_whole_shards(spark, monkeypatch):
    """A link of nearly half of all rows must be cut, but into as few shards as hold it; other links stay whole."""
    monkeypatch.setattr(sh, "HOT_LINK", 100)
    rows = [(i, "hot", 10) for i in range(4000)] + [(i, f"g{i // 5}", 10) for i in range(4000, 6000)] + [(i, None if i % 2 else f"alone {i}", 10) for i in range(6000, 10000)]
    found = sh.shard_documents(table_of(spark, rows)).collect()
    sizes = laid_out(found)
    assert max(sizes) <= 1.01 * 12500 and min(sizes) >= 0.99 * 12500
    by_link = {k: Counter(r.shard for r in found if r.link == k) for k in ("hot",)}
    assert sum(n for _, n in by_link["hot"].most_common(4)) > 0.8 * 4000
    whole = groups((r.link, r.shard) for r in found if r.link and r.link[0] == "g")
    assert sum(len(s) == 1 for s in whole.values()) > 0.9 * len(whole)


def test_reruns_and_layouts_agree(spark):
    docs = table_of(spark, [(i, f"g{i % 90}" if i % 2 else None, 1 + i % 50) for i in range(800)])
    one = sorted(map(tuple, sh.shard_documents(docs).collect()), key=str)
    assert one == sorted(map(tuple, sh.shard_documents(docs.repartition(7, "size")).collect()), key=str)


def test_all_rows_linked_and_large_documents(spark):
    rows = [(i, f"g{i // 2}", 1 + i * 37 % 100) for i in range(400)] + [(1000, "big", 3000), (1001, "big", 3000)]
    sizes = laid_out(sh.shard_documents(table_of(spark, rows)).collect())
    assert max(sizes) - min(sizes) < 3000


@pytest.mark.parametrize("shards", [1, 3])
def test_nulls_repeats_and_other_numbers_of_shards(spark, shards):
    rows = [(None, None, 1), (None, "a", 5), (1, "a", 5), (1, "a", 5), (2, None, 1), (2, None, 1), (3, "b", 0)] + [(i, None, 3) for i in range(10, 60)]
    found = sh.shard_documents(table_of(spark, rows), shards).collect()
    assert len(found) == len(rows)
    laid_out(found, shards)


@pytest.mark.parametrize("same", [[(7, "same", 11)] * 1500, [(None, None, 11)] * 2000, [(8, None, 5)] * 3000])
def test_rows_that_repeat_are_parted(spark, same):
    """Half of all rows or more are one row: sizes must stay even, linked copies in as few shards as hold them."""
    rows = same + [(i, f"alone {i}", 1 + i % 40) for i in range(1000, 2500)]
    docs = table_of(spark, rows)
    found = sh.shard_documents(docs).collect()
    sizes = laid_out(found)
    assert max(sizes) <= 1.02 * sum(sizes) / 8 and min(sizes) >= 0.98 * sum(sizes) / 8
    linked = Counter(r.shard for r in found if r.link == "same")
    assert not linked or sum(n for _, n in linked.most_common(4)) > 0.9 * len(same)
    again = sh.shard_documents(docs.repartition(5, "size")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)


def test_empty_table(spark):
    assert sh.shard_documents(table_of(spark, [])).count() == 0


def test_null_texts(spark, tmp_path):
    spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "", "y")], "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in sh.op1_sharding(spark, str(tmp_path)).collect()) == [(1, 1, None), (2, 1, None), (3, 1, 0)]


def test_cuts_are_the_nearest(spark):
    rows = [(0, spot, 1 + spot % 7) for spot in range(0, 1 << 24, 40009)]
    total = sum(s for *_, s in rows)
    frame = spark.createDataFrame(rows, "lane int, spot int, size long")
    goals = [(0, k, total * k / 4) for k in range(5)]
    for (lane, number, goal), cut in zip(goals, [sh._cut_values(frame, [g])[0, g[1]] for g in goals]):
        assert abs(sum(s for _, spot, s in rows if spot <= cut) - goal) <= 4
