import math
import random

from pyspark.sql import functions as F

from colsieve.llm import top_k as tk
from tests.compare import database, differences
from tests.conftest import SF, SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, query long, score string, v int"


def test_query_equals_sql(spark):
    assert differences(tk.op7_top_k(spark, SF_SMALL), database(SF_SMALL), tk.SQL["op7_top_k"]) == []


def brute(rows, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = tuple(math.floor(256 * x) for x in v)
            vectors[i] = min(w, vectors.get(i, w))
    out = []
    for q, v in vectors.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_odd_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(tk, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(tk, "ROWS", 7)
    draw = random.Random(2)
    rows = [(i, [draw.choice([-0.5, 0.25, 1.0, 0.0]) for _ in range(6)]) for i in range(300)]  # many ties
    rows += [(400, [1.0]), (450, []), (500, [1.0, None]), (501, [1.0, float("nan")]), (550, [float("inf")]), (None, [1.0] * 6), (600, None)]
    rows += [(0, [0.25] * 6), (1, rows[1][1]), (650, [1e18, 2e18]), (651, [1.0, -1.0]), (-50, [1.0] * 6)]
    rows[-3] = (650, [3e4, -2e4])
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    vectors = tk.whole_numbers(frame)
    found = tk.top_k(vectors, F.col("vec_id") % 50 == 0, 4).collect()
    assert sorted((r["query"], r["rank"], r.vec_id, r.score) for r in found) == brute(rows, 4)


def test_fewer_vectors_than_asked_for(spark):
    rows = [(0, [1.0, 2.0]), (3, [0.5, 0.5]), (50, [0.0, -1.0])]
    vectors = tk.whole_numbers(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA))
    found = tk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query"], r["rank"], r.vec_id, r.score) for r in found) == brute(rows, 5)


def test_empty_table_and_no_queries(spark):
    vectors = tk.whole_numbers(spark.createDataFrame([(1, [1.0], 1, "x", 2)], SCHEMA))
    assert tk.top_k(vectors, F.col("vec_id") % 50 == 0).count() == 0
    assert tk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_larger_table_equals_sql(spark):
    assert differences(tk.op7_top_k(spark, SF), database(SF), tk.SQL["op7_top_k"]) == []
