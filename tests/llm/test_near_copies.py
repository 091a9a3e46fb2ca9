import itertools
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash

import colsieve.llm.near_copies as nc
from colsieve.llm.shared import components
from tests.conftest import SF_SMALL
from tests.llm.brute import classes

SCHEMA = "doc_id long, text string, fp string, component_id string, least int"


def plain_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    pieces = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    reached = classes(fps, links)
    return sorted((i, f"{fps[i]:016x}", reached[i]) for i in fps)


def test_query_equals_brute_force(spark):
    rows = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = nc.op10_near_copies(spark, SF_SMALL).collect()
    assert sorted(map(tuple, found)) == plain([(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_cover_misses_no_pair(radius):
    masks = nc.cover(list(range(64)), radius)
    draw = random.Random(radius)
    for _ in range(3000):
        off = ~sum(1 << b for b in draw.sample(range(64), radius))
        assert any(m & off == m for m in masks)


@pytest.mark.parametrize("bucket", [1024, 4])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, bucket):
    """Fingerprints that differ in a few low bits only share most buckets; finer masks must keep their links."""
    monkeypatch.setattr(nc, "BUCKET", bucket)
    draw = random.Random(5)
    fps = sorted({draw.getrandbits(12) for _ in range(250)} | {draw.getrandbits(63) for _ in range(100)})
    found = [tuple(r) for r in nc.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    assert classes(fps, found) == classes(fps, links)
    assert len(found) < len(links)


def test_nulls_copies_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(200_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "oNE  TWO"), (6, long), (7, long + " end"), (None, long), (9, "É é"), (9, "É é")]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in texts], SCHEMA)
    found = {(r.doc_id, r.component_id) for r in nc.near_copies(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (None, 6), (9, 9)}
    kept = nc.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 9]


def test_unlike_texts_of_one_id_and_rows_without_id(spark):
    """Each component keeps one row, whatever ids its rows have."""
    a, b, c, d = (" ".join(f"{x}{i * i % 997}" for i in range(80)) for x in "abcd")
    rows = [(1, a), (1, b), (2, c), (None, d), (None, d), (None, c), (3, b), (1, a)]
    kept = nc.one_of_each(spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (1, b), (2, c), (None, d)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert nc.near_copies(docs).count() == 0 and nc.one_of_each(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(500, 500)] + [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(250)]
    found = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert found == classes({n for p in links for n in p}, links)
