import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from colsieve.llm import periods as pr
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, n_runs int, start string, word string"


def plain_runs(words):
    """Every stretch of equal words at each distance, the smallest distance of each."""
    least = {}
    for q in range(1, len(words) // 4 + 1):
        start = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i - start + q >= max(6, 4 * q):
                    least.setdefault((start, i - start + q), q)
                start = None
    return sorted((s, n, q) for (s, n), q in least.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()
    return (doc_id, len(found), *row, *digests)


def noisy(draw):
    """Words of a few letters with repeats planted in them, whole, cut short and with a word changed."""
    out = []
    for _ in range(draw.randrange(1, 6)):
        out += draw.choices("abcd"[: draw.randrange(1, 5)], k=draw.randrange(12))
        unit = draw.choices("abc", k=draw.randrange(1, 9))
        part = unit * draw.randrange(1, 8) + unit[: draw.randrange(len(unit))]
        if draw.random() < 0.4:
            part[draw.randrange(len(part))] = "d"
        out += part
    return out


def test_runs_of_many_shapes():
    draw = random.Random(3)
    n_found = 0
    for _ in range(4000):
        words = noisy(draw)
        found = pr.runs(pr.numbers(words))
        assert found == plain_runs(words), words
        n_found += len(found)
    assert n_found > 4000


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_all_short_texts(letters):
    for n in range(6, 15 if letters == 2 else 10):
        for code in range(letters**n):
            words = [code // letters**k % letters for k in range(n)]
            assert pr.runs(pr.numbers(words)) == plain_runs(words), words


def test_only_suspects_are_ordered():
    """Common words and lines that repeat far apart are set aside before any order is made."""
    draw = random.Random(8)
    line = [f"l{i}" for i in range(30)]
    words = [w for _ in range(40) for w in draw.choices([f"w{i}" for i in range(60)], k=80) + line]
    assert len(pr.suspects(pr.numbers(words))[0]) == 0
    firsts, ends = pr.suspects(pr.numbers(words + line * 5 + words))
    assert (ends - firsts).sum() < 200 and pr.runs(pr.numbers(words + line * 5 + words)) == [(len(words) - 30, 180, 30)]


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    found = [tuple(r) for r in pr.op13_periods(spark, SF_SMALL).collect()]
    assert sorted(found) == sorted(plain(*r) for r in rows)
    assert sum(r[1] > 0 for r in found) > len(rows) / 40


def test_nulls_ties_and_clashing_columns(spark, tmp_path):
    draw = random.Random(5)
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "A a A a A a A a", "x y " * 8, "é ü " * 9, "a b " * 4 + "c d " * 4, "no run here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z " * 7), (None, None), (3, "a a a a a"), (3, "b b b b b b")]
    rows += [(i, " ".join(noisy(draw))) for i in range(1000, 1200)]
    docs = spark.createDataFrame([(*r, 1, "s", "w") for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in pr.op13_periods(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted((plain(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 5


def test_empty_table(spark):
    assert pr.periods(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("period", [1, 2, 7, 30_000])
def test_very_long_text(spark, period):
    n = 150_000
    words = [f"w{i % period}" for i in range(n)]
    (row,) = pr.periods(spark.createDataFrame([(1, " ".join(words), 0, "", "")], SCHEMA)).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, n, period)
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(words[:period]).encode()).hexdigest()


def test_greatest_exponent_is_exact():
    """Lengths and periods are compared as fractions; equal ones go to the first start."""
    found = [(5, 13, 3), (0, 26, 6), (40, 9, 2)]
    assert pr.summary([b"w"] * 60, sorted(found))[1:5] == (40, 9, 2, 4500)
    assert pr.summary([b"w"] * 60, [(0, 26, 6), (5, 13, 3)])[1:5] == (0, 26, 6, 4333)


def test_common_lengths_stop_at_stretches():
    symbols, ends = np.array([0, 0, 0, 1, 1, 1]), np.array([3, 3, 3, 6, 6, 6])
    order, rank = pr.suffix_order(symbols, ends)
    assert order.tolist() == [2, 1, 0, 5, 4, 3]
    assert pr.common_lengths(symbols.tolist(), ends.tolist(), order.tolist(), rank.tolist()) == [0, 1, 2, 0, 1, 2]
