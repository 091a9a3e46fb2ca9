import hashlib
import random

import pytest

from colsieve.llm import digests as dg
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, piece int, extra int, fingerprint string"


def brute(rows):
    """Expected rows by descending id, null last, equal ids by text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        changed = dg.edited(t, n)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), dg.digest(t.encode()), dg.digest(changed.encode())))
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return dg.op9_digests(spark, str(tmp_path)).collect()


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    found = dg.op9_digests(spark, SF_SMALL).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(brute(rows))
    assert sum(r.near_edited > r.near_next for r in found) > 0.98 * len(found)
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))


def test_odd_rows(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, "".join(draw.choice("abc äß語🙂\n") for _ in range(draw.randrange(60)))) for i in draw.sample(range(-10**15, 10**15), 90)]
    rows += [(5, "tie b"), (5, "tie a"), (5, "tie a"), (6, None), (7, ""), (8, "x"), (None, "no id"), (None, None), (9, "long text " * 120_000)]
    found = run(spark, tmp_path, rows)
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rows", [[(1, "only one text")], [(None, "only")], [(2, "a b c d"), (1, "e f g h")], []])
def test_few_rows(spark, tmp_path, rows):
    found = run(spark, tmp_path, rows)
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(brute(rows), key=str)


def test_likeness():
    draw = random.Random(1)
    base = " ".join(draw.choice(["the", "and", "thing", "reach", "over"]) + str(draw.randrange(30)) for _ in range(400))
    near = base.replace("the1", "a1")
    far = " ".join(str(draw.random()) for _ in range(200))
    one, two, three, empty = (dg.digest(t.encode()) for t in (base, near, far, ""))
    assert dg.likeness(one, one) == 1 == dg.likeness(empty, empty)
    assert dg.likeness(one, two) == dg.likeness(two, one) > dg.likeness(one, three)
    assert 0 <= dg.likeness(one, empty) <= 1
    assert len(one) == len(empty) == 130


def test_long_texts_count_as_a_whole():
    text = bytes(random.Random(2).randrange(256) for _ in range(70)) * 40_000
    part = dg.digest(text)
    assert part[2:] != dg.digest(text[: 1 << 20])[2:] or part[:2] != dg.digest(text[: 1 << 20])[:2]


def test_fingerprints_of_a_table(spark):
    docs = spark.createDataFrame([(1, "same", 0, 0, "x"), (2, "same", 0, 0, "x"), (3, None, 0, 0, "x")], SCHEMA)
    found = {r.doc_id: r.fingerprint for r in dg.fingerprints(docs).collect()}
    assert found[1] == found[2] != found[3] == dg.digest(b"")
