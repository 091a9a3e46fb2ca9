import itertools
import random
import re

import numpy as np
import pytest

from colsieve.llm import minhash as mh
from tests.conftest import SF_SMALL
from tests.llm.brute import classes

SCHEMA = "doc_id long, text string, key string, sig string, bucket int, comp int"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain(rows):
    """Rows by brute force; a node is a place in the table, a component is named by its least id."""
    sets = [plain_set(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    of, names = classes(range(len(rows)), near), {}
    for k, (i, _) in enumerate(rows):
        names[of[k]] = min((x for x in (i, names.get(of[k])) if x is not None), default=None)
    return [(i, len(s), names[of[k]], i == names[of[k]]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def run(spark, rows):
    return [tuple(r) for r in mh.near_duplicates(spark.createDataFrame([(*r, "k", "s", 1, 2) for r in rows], SCHEMA)).collect()]


def edited(draw, words, n):
    out = list(words)
    for k in draw.sample(range(len(out)), n):
        out[k] = f"new{draw.randrange(10**9)}"
    return " ".join(out)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in mh.op11_minhash(spark, SF_SMALL).collect()) == sorted(plain(rows))


@pytest.mark.parametrize("cell", [512, 7])
def test_groups_of_near_copies(spark, monkeypatch, cell):
    """Pairs around the threshold, a crowded group, and a third of all rows the same text; small cells lose no link."""
    monkeypatch.setattr(mh, "CELL", cell)
    draw = random.Random(cell)
    rows, ids = [], iter(draw.sample(range(10**6), 1000))
    for _ in range(12):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(20, 300))]
        rows += [(next(ids), edited(draw, base, min(len(base), draw.randrange(0, 2 + len(base) // 25)))) for _ in range(8)]
    base = [f"b{i}" for i in range(140)]
    rows += [(next(ids), edited(draw, base, draw.randrange(1, 7))) for _ in range(90)]
    rows += [(next(ids), " ".join(base).upper()) for _ in range(100)]
    shared = " ".join(f"line{i}" for i in range(60))
    rows += [(next(ids), f"{shared} " + " ".join(f"x{draw.randrange(9000)}" for _ in range(40))) for _ in range(40)]
    draw.shuffle(rows)
    expected = plain(rows)
    assert sorted(run(spark, rows)) == sorted(expected)
    assert 30 < len({r[2] for r in expected}) < len(rows) - 180


def test_nulls_ties_and_repeated_rows(spark):
    long = " ".join(f"w{i * i % 99_991}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, None), (None, ""), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  Two"), (8, "one two three"), (9, "É é"), (10, "é é")]
    rows += [(20, long), (21, long + " end"), (None, long), (None, "alone here"), (None, "alone here")]
    rows += [(30, "same id with a text"), (30, "same id, another one"), (30, "same id with a text"), (29, "same id, another one")]
    rows += [(40, "a b c d e f g h")] * 60
    assert sorted(run(spark, rows), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, "a b c")], [(1, None)], [(None, "a")]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_posterior_keeps_similar_pairs():
    """Bounds grow with the rows compared; a pair at the threshold is ruled out very seldom, one far below nearly always."""
    least = mh.least_matches()
    assert len(least) == 10 and least == sorted(least)
    draw = np.random.default_rng(1)
    lost = kept = 0
    for share, wanted in ((0.85, True), (0.5, False)):
        one = draw.integers(0, 256, mh._N).astype(np.uint8)
        others = np.where(draw.random((20_000, mh._N)) < share, one, draw.integers(0, 256, (20_000, mh._N)).astype(np.uint8))
        n = len(mh.possible(one, others, least))
        lost, kept = (20_000 - n, kept) if wanted else (lost, n)
    assert lost <= 2 and kept <= 20


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(2)
    base = np.unique(draw.integers(0, 2**63, 4000).astype(np.uint64))
    other = np.unique(np.concatenate([base[:3000], draw.integers(0, 2**63, 1000).astype(np.uint64)]))
    one, two = mh.signatures([base, other])
    assert abs((one == two).mean() - 0.6) < 0.15
    assert mh.similar(base, [other, base], 60).tolist() == [True, True] and mh.similar(base, [other, base], 61).tolist() == [False, True]
