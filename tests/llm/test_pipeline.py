import duckdb
import pytest

import corpus_pipeline as cp
from colsieve.llm import bpe, mixing
from tests.conftest import SF_SMALL
from tests.llm.test_near_copies import plain


@pytest.fixture(scope="module")
def kept(spark):
    """The rows after each stage, each read from what the last one wrote."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    out.append(docs.toPandas())
    for name, stage in cp.STAGES:
        before = docs.columns
        docs = cp.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert name == cp.STAGES[-1][0] or docs.columns == before
        out.append(docs.toPandas())
    return out


def test_order_of_stages():
    assert [name for name, _ in cp.STAGES] == ["language", "near_copies", "passages", "mix", "encode"]


def test_language_keeps_clean_documents(kept):
    assert len(kept[1]) >= 0.97 * len(kept[0])
    assert all(any(c.isalpha() for c in t) for t in kept[1]["text"])


def test_one_of_each_group_stays(kept):
    expected = {component for _, _, component in plain(list(zip(kept[1]["doc_id"].tolist(), kept[1]["text"])))}
    assert sorted(kept[2]["doc_id"]) == sorted(expected)


def test_no_long_passage_is_left_twice(kept):
    first = {}
    for i, text in zip(kept[3]["doc_id"], kept[3]["text"]):
        words = text.lower().split()
        for k in range(len(words) - 59):
            assert first.setdefault(tuple(words[k : k + 60]), i) == i
    same = kept[2].merge(kept[3], on="doc_id", suffixes=("", "_cut"))
    assert (same["text"] == same["text_cut"]).mean() > 0.5
    assert all(len(a) >= len(b) for a, b in zip(same["text"], same["text_cut"]))


def test_mix_repeats_as_the_sql_says(kept):
    con = duckdb.connect()
    con.register("docs", kept[3])
    taken = con.sql(mixing.MIX_SQL.format(documents="docs", columns=f"doc_id, o.size, ({mixing._TAKEN})::BIGINT AS taken")).fetchall()
    rows = kept[4]["doc_id"].value_counts().to_dict()
    assert {i: n // size for i, size, n in taken if n} == rows


def test_encoded_rows(kept):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = dict(zip(kept[4]["doc_id"], kept[4]["text"]))
    assert len(kept[5]) == len(kept[4])
    for i, ids in zip(kept[5]["doc_id"], kept[5]["token_ids"]):
        assert list(ids) == library.encode(texts[i], add_special_tokens=False).ids


def test_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string"
    rows = [(1, None, "en", "a", 0, "x"), (2, "", None, None, 0, "x"), (None, "some words here", "en", "a", 15, "x"), (3, "some words here", "en", None, 15, "x"), (3, "some words here", "en", None, 15, "x")]
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = cp.run(spark, f"{tmp_path}/{name}")
        assert "token_ids" in found.columns and found.count() <= 2 * len(some)
