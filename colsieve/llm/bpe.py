"""BPE encoding and decoding with batched merge rounds over the vocabulary file of a public tokenizer."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.llm.shared import table

#: Words of more symbols than this are cut into independent parts in every round.
LONG = 64
#: Texts are read in pieces of about so many characters, words are kept for so many different ones.
BLOCK, KEPT_WORDS = 1_000_000, 300_000
NO_RANK = np.int32(2**31 - 1)

# Code points that `regex` counts as letters or numbers, but the tokenizer's patterns, of Unicode 16, don't.
LATER_LETTERS = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
# First and last capital whose small letter, the third value for the first one, Python doesn't know yet.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in kept else next(free)) for b in range(256)]


@dataclass
class Vocabulary:
    """What the encoder needs of a tokenizer file; built on the driver and broadcast, as large as the file."""

    tokens: list[str]
    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte that ends a word
    keys: np.ndarray  # sorted keys of pairs: left id * len(tokens) + right id
    ranks: np.ndarray
    made: np.ndarray  # id made by each rank
    singly: np.ndarray  # ranks that may open a lower rank, merged one at a time
    joints: np.ndarray  # sorted keys of pairs that some token may still hold side by side, however they grow
    pattern: str
    special: dict[str, int]


def joint_keys(merges: list[tuple[str, str]], ids: dict[str, int], n: int) -> np.ndarray:
    """Keys of the pairs that a merge can still bring together.

    A merge of L and R holds symbols A and B side by side across its middle only if L ends with A and R begins with B.
    Where neighbours are no such pair, nothing is ever merged over their border.
    """
    tails = {t: np.array([ids[t[k:]] for k in range(len(t)) if t[k:] in ids], np.int64) for t in {a for a, _ in merges}}
    heads = {t: np.array([ids[t[:k]] for k in range(1, len(t) + 1) if t[:k] in ids], np.int64) for t in {b for _, b in merges}}
    return np.unique(np.concatenate([np.zeros(0, np.int64), *[(tails[a][:, None] * n + heads[b][None, :]).ravel() for a, b in merges]]))


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of the kind: NFC, lower case, split by a pattern, byte letters, merges with word ends."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    ids = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = token
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    left = np.array([ids[a] for a, _ in merges], np.int64)
    right = np.array([ids[b] for _, b in merges], np.int64)
    made = np.array([ids[a + b] for a, b in merges], np.int32)
    keys = left * len(tokens) + right
    order = np.argsort(keys, kind="stable")
    used = np.full(len(tokens), len(merges))
    np.minimum.at(used, left, np.arange(len(merges)))
    np.minimum.at(used, right, np.arange(len(merges)))
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(
        tokens, np.array([ids[c] for c in byte_letters()], np.int32), np.array([ids[c + suffix] for c in byte_letters()], np.int32),
        keys[order], order.astype(np.int32), made, used[made] < np.arange(len(merges)), joint_keys(merges, ids, len(tokens)),
        split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"), {t["content"]: t["id"] for t in spec["added_tokens"]},
    )


def merge_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word begins.

    Each round looks the pairs of all open words up by binary search, takes every word's lowest rank and merges
    its places from left to right. Words without a known pair are done. As a merge opens pairs of higher rank only,
    merging all places of a rank at once is merging one by one; the few ranks without this property merge singly.
    A long word falls into parts wherever no token can ever lie over a border; parts merge independently of each other,
    so that its rounds don't grow with its length.
    """
    raw = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids = v.first[data]
    ids[np.cumsum(sizes) - 1] = v.last[data[np.cumsum(sizes) - 1]]
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(ids))  # of each symbol's first byte
    long = bool(len(sizes)) and sizes.max() > LONG
    done_ids, done_places = [], []
    while len(ids):
        keys = ids[:-1].astype(np.int64) * len(v.tokens) + ids[1:]
        if long:
            word, long = _parted(keys, word, v)
        at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
        rank = np.append(np.where((v.keys[at] == keys) & (word[:-1] == word[1:]), v.ranks[at], NO_RANK), NO_RANK)
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        counts = np.diff(np.append(begins, len(ids)))
        lowest = np.repeat(np.minimum.reduceat(rank, begins), counts)
        closed = lowest == NO_RANK
        if closed.any():
            done_ids.append(ids[closed])
            done_places.append(place[closed])
            ids, word, place, rank, lowest = (x[~closed] for x in (ids, word, place, rank, lowest))
            if not len(ids):
                break
        places = np.flatnonzero(rank == lowest)
        run = np.append(True, (places[1:] != places[:-1] + 1) | (word[places[1:]] != word[places[:-1]]))
        step = np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        again = v.singly[rank[places]] & np.append(False, word[places[1:]] == word[places[:-1]])
        places = places[(step % 2 == 0) & ~again]
        ids[places] = v.made[rank[places]]
        stay = np.ones(len(ids), bool)
        stay[places + 1] = False
        ids, word, place = ids[stay], word[stay], place[stay]
    flat = np.concatenate([np.zeros(0, np.int32), *done_ids])
    at = np.concatenate([np.zeros(0, np.int64), *done_places])
    order = np.argsort(at)
    return flat[order], np.searchsorted(at[order], np.concatenate([[0], np.cumsum(sizes)]))


def _parted(keys: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, bool]:
    """Words numbered anew, long ones cut at the borders that no token can lie over; and whether a long one is left."""
    begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    counts = np.diff(np.append(begins, len(word)))
    within = np.flatnonzero(np.repeat(counts > LONG, counts)[:-1] & (word[:-1] == word[1:]))
    at = np.minimum(np.searchsorted(v.joints, keys[within]), len(v.joints) - 1)
    new = word[1:] != word[:-1]
    new[within[v.joints[at] != keys[within]]] = True
    return np.append(0, np.cumsum(new)), bool(len(within))



def _ranges(ranges: tuple[tuple[int, ...], ...]) -> str:
    return "".join(f"\\U{low:08X}-\\U{high:08X}" for low, high, *_ in ranges)


class Encoder:
    """Encodes texts; keeps the ids of words seen before, up to KEPT_WORDS of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words = regex.compile(vocabulary.pattern)
        self.rare = regex.compile(f"[{_ranges(LATER_LETTERS + LATER_NUMBERS + LATER_CAPITALS)}]")
        older = vocabulary.pattern.replace("\\p{L}", f"[\\p{{L}}--[{_ranges(LATER_LETTERS)}]]").replace("\\p{N}", f"[\\p{{N}}--[{_ranges(LATER_NUMBERS)}]]")
        self.older_words = regex.compile(older, regex.V1)
        self.small = {c: small + c - low for low, high, small in LATER_CAPITALS for c in range(low, high + 1)}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        self.index = {s: k for k, s in enumerate(self.v.special)}
        self.flat = np.array(list(self.v.special.values()), np.int32)
        self.begins = np.arange(len(self.flat) + 1)

    def _split(self, text: str) -> list[str]:
        """The words of a text; control tokens as they are. They are found before letters change."""
        if self.special is None or not any(s in text for s in self.v.special):
            return self._plain(text)
        parts = self.special.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # a sigma at a word's end becomes the same letter as any other
        text = text.replace("Σ", "σ").lower()
        if not text.isascii() and self.rare.search(text):
            return self.older_words.findall(text.translate(self.small))
        return self.words.findall(text)

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block of texts: all ids, and where each text's begin."""
        split, size = [], 0
        for text in texts:
            split.append(self._split(text))
            size += len(text)
            if size >= BLOCK:
                yield self._look_up(split)
                split, size = [], 0
        if split:
            yield self._look_up(split)

    def _look_up(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts' words, and where each text's begin. Words not seen before are merged together."""
        if len(self.index) > KEPT_WORDS:
            self._forget()
        new = list({w for words in split for w in words}.difference(self.index))
        if new:
            flat, begins = merge_words(new, self.v)
            self.index.update(zip(new, range(len(self.begins) - 1, len(self.begins) - 1 + len(new))))
            self.begins = np.concatenate([self.begins, begins[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
        n_words = np.array([len(words) for words in split])
        known = np.fromiter(map(self.index.__getitem__, (w for words in split for w in words)), np.int64, n_words.sum())
        first = self.begins[known]
        length = self.begins[known + 1] - first
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(n_words)])]


def decode_ids(ids: list[int], tokens: list[str]) -> str:
    """The tokens with a blank between, control tokens included."""
    return " ".join(map(tokens.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """(doc_id, token_ids) of every whole text; a null or blank text has no tokens.

    With ``decoded`` the ids are decoded again where they are made, so that texts and ids don't go to and fro. Rows
    come and go in blocks of about BLOCK characters: a task holds one block and the words it keeps.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = Encoder(shared.value), shared.value.tokens
        for batch in batches:
            at = 0
            for ids, begins in encoder.encode(t.as_py() or "" for t in batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column("doc_id").slice(at, len(lists)), lists]
                if decoded:
                    columns.append(pa.array([decode_ids(ids[a:b].tolist(), tokens) for a, b in zip(begins, begins[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "token_ids", "decoded"][: len(columns)])
                at += len(lists)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, token_ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``decoded`` to rows with ``token_ids`` (null: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        return pd.Series([None if ids is None else decode_ids(ids.tolist(), shared.value) for ids in lists], dtype=object)

    return encoded.withColumn("decoded", text("token_ids"))


def digests(decoded: DataFrame) -> list:
    joined = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return [F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")]


def vocabulary_path() -> str:
    """The file of the query; other files of its kind go to ``load`` by their own path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = load(vocabulary_path())
    decoded = encode(table(spark, sf, "documents"), vocabulary, decoded=True)
    return decoded.select("doc_id", *digests(decoded))


QUERIES = {"op5_bpe": op5_bpe}
SQL: dict[str, str] = {}
