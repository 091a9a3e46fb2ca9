import pickle
import random
import time

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from colsieve.llm import bpe
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, token_ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(bpe.vocabulary_path())


def encoded(texts, vocabulary):
    encoder = bpe.Encoder(vocabulary)
    out = []
    for ids, begins in encoder.encode(texts):
        out += [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
    return out


ODD = [
    "", " ", "\x1c\x1d\x85  a b", "Don't WE'LL they'VE 12 3.4 ½ ②", "<|startoftext|>Hi<|endoftext|> <|endoftext|", "ΑΣ ΟΔΟΣ σς", "İstanbul ﬁ Å Å ｶﾞ",
    "".join(map(chr, range(0x10D40, 0x10D90))) + "Ꟍ.𖺠 𖺻.㐀 \U000323B0x \u0558:",
    "漢字かな交じり文 한국어 हिन्दी ไทย", "🙂🙂👩‍👩‍👧 ☃", "a" * 5000, "ab" * 3000 + "!" * 999, "ȩ́ ẛ̣", "\u0000\u0007 ​‍ ﻿", "ǅ ǈ ẞ ß",
]


def test_odd_texts(library, vocabulary):
    assert encoded(ODD, vocabulary) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeEİΣ'<|>endoftxtsr \n")), max_size=40), max_size=4))
def test_any_text(library, vocabulary, texts):
    assert encoded(texts, vocabulary) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words_are_exact_and_take_few_rounds(library, vocabulary):
    draw = random.Random(1)
    parts = ("abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu", "漢字仮名交文中国日本語", ["ing", "the", "tion", "er", "ly"])
    texts = ["".join(draw.choices(letters, k=20_000)) for letters in parts] + ["the" * 9000 + "quick" * 3000]
    texts += [" ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(50, 300))) for _ in range(300))]
    assert encoded(texts, vocabulary) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    start = time.process_time()
    encoded(["".join(draw.choices(parts[0], k=80_000))], vocabulary)
    assert time.process_time() - start < 4


def test_whole_texts_and_decoding(spark, library, vocabulary):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.token_ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "BLOCK", 5)
    texts = ["one two three four", "five one six <|endoftext|>", "", "two three"]
    assert encoded(texts, vocabulary) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_vocabulary_can_be_sent(vocabulary):
    assert pickle.loads(pickle.dumps(vocabulary)).tokens == vocabulary.tokens


def test_nulls_and_clashing_columns(spark, vocabulary):
    docs = spark.createDataFrame([(1, None, "x", "y"), (None, "a b", "x", "y"), (2, "", "x", "y"), (2, "", "x", "y")], SCHEMA)
    found = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    rows = [tuple(r) for r in found.select("doc_id", *bpe.digests(found)).collect()]
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert sorted(rows, key=str)[:2] == [(1, 0, empty, empty), (2, 0, empty, empty)]
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0
