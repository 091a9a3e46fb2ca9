import itertools
import math

import numpy as np
import pytest

from colsieve.llm import languages as la
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, score double, spans string"


@pytest.fixture(scope="module")
def model(spark):
    return la.fit_documents(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark):
    found = la.op4_languages(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200
    assert sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_path_is_the_best_of_all(spark):
    draw = np.random.default_rng(3)
    lengths = [5, 0, 1, 6, 3]
    scores = draw.normal(0, 3, (sum(lengths), 3)).astype(np.float32)
    of_text = np.concatenate([[0], np.cumsum(lengths)])
    path = la.best_paths(scores, of_text, 2.0)

    def value(rows, states):
        return sum(float(r[s]) for r, s in zip(rows, states)) - 2.0 * sum(a != b for a, b in zip(states, states[1:]))

    for a, b in zip(of_text, of_text[1:]):
        best = max((value(scores[a:b], s) for s in itertools.product(range(3), repeat=b - a)), default=0)
        assert math.isclose(value(scores[a:b], list(path[a:b])), best, abs_tol=1e-4)


def test_spans_of_a_mixed_text(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 1000 and 3000").select("lang", "text").collect()}
    text = docs["de"] + "\n" + docs["es"]
    _, _, spans = la.read_texts([text], model)
    first, second = spans.to_pylist()[0][0], spans.to_pylist()[0][-1]
    assert (first["lang"], second["lang"]) == ("de", "es")
    assert abs(first["end"] - len(docs["de"])) < 40 and second["end"] <= len(text)


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "the cat sat on the mat", "en", 0.0, "") for i in range(5)] + [(9 + i, "кошка сидит на окне", "ru", 0.0, "") for i in range(5)]
    model = la.fit(spark.createDataFrame(rows, SCHEMA))
    langs, _, spans = la.read_texts(["сат мат", "ΑΒΓ", "mat сидит", "1234 !?"], model)
    assert langs[0] == "ru" and langs[3] == "und"
    assert [s["lang"] for s in spans.to_pylist()[2]] in (["en", "ru"], ["ru"])
    assert len(spans.to_pylist()[1]) == 1


def test_nulls_long_texts_ties_and_clashing_columns(spark, model):
    long = "die Katze und der Hund " * 40_000
    rows = [(1, None), (2, ""), (3, " 12 .,"), (None, "un que la de"), (5, long), (5, long)]
    docs = spark.createDataFrame([(i, t, None, 0.5, "x") for i, t in rows], SCHEMA)
    found = la.label(docs, model).collect()
    assert len(found) == 6
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.score == 0 and r.spans == [] for r in found if r.doc_id in (1, 2, 3))
    assert [r.spans[0].end for r in found if r.doc_id == 5] == [len(long) - 1] * 2


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some words", None, 0.0, "")], SCHEMA)
    empty = la.fit_documents(docs)
    assert empty.langs == ()
    assert [(r.lang_pred, r.score) for r in la.label(docs, empty).collect()] == [("und", 1.0)]
    assert la.label(docs.limit(0), empty).count() == 0
