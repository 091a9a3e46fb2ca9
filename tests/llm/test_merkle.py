import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from colsieve.llm import merkle
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, grp string, h string, n int, steps string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """The root, and each leaf's siblings (left, right) level by level."""
    steps, level, members = [[] for _ in nodes], nodes, [[i] for i in range(len(nodes))]
    while len(level) > 1:
        parents, groups = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for j in range(len(run)):
                for i in members[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            parents.append(H(*run))
            groups.append([i for m in members[a : a + 8] for i in m])
        level, members = parents, groups
    return level[0], steps


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        leaves = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = (leaves, *plain_tree([plain_leaf(r) for r in leaves]))
    root, above = plain_tree([trees[g][1] for g in order]) if order else (None, [])
    out = []
    for g, upper in zip(order, above):
        leaves, subroot, steps = trees[g]
        for r, own in zip(leaves, steps):
            path, h = own + upper, plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], plain_leaf(r), subroot, root, H(*[x + y for x, y in path]), h, h == root))
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "g", "h", 2, "s") for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*merkle.FIELDS).collect()]
    found = [tuple(r) for r in merkle.op12_merkle(spark, SF_SMALL).collect()]
    assert sorted(found) == sorted(plain(rows))
    assert 0 < sum(not r[6] for r in found) < len(found)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_groups_of_many_sizes(spark, tmp_path, monkeypatch, levels):
    """Blocks of one level make many storeys, of four levels one."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    draw = random.Random(levels)
    sizes = {None: 3, "": 1, "a": 8, "b": 9, "c": 64, "d": 65, "é": 577, "=": 2, "z": 1, "y": 1}
    rows = [(i, draw.choice([None, "s"]), g, draw.choice([None, 7]), draw.choice([None, "", "Text Ä %d" % i, "low"])) for g, n in sizes.items() for i in draw.sample(range(-50, 9000), n)]
    assert sorted(run(spark, tmp_path, rows), key=str) == sorted(plain(rows), key=str)


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    same = [(5, "s", "en", 3, "Abc")] * 700  # two thirds of all rows
    rows = same + [(5, "s", "en", 3, f"Other {i % 3}") for i in range(200)] + [(None, None, None, None, None)] * 40 + [(None, "x", "en", 1, "Long " * 50_000)]
    assert sorted(run(spark, tmp_path, rows), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "A")], [(None, None, None, None, None)]])
def test_few_rows(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == plain(rows)


def test_any_change_shows(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(30)]
    docs = spark.createDataFrame([(*r, 1, "g", "h", 2, "s") for r in rows], SCHEMA)
    root = {r.root for r in merkle.manifest(docs).collect()}
    changed = docs.replace("Text 7", "Text  7", "text")
    assert len(root) == 1 and root.isdisjoint({r.root for r in merkle.manifest(changed).collect()})
    assert all(r.verified for r in merkle.manifest(docs).collect())
