"""Language spans of mixed texts: script ranges, per-word scores and a Viterbi path with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colsieve.llm.shared import table, text_slices

#: Bound of the fit: about so many labelled texts, chosen by a hash of their id, whatever the table's size.
SAMPLE = 20_000
#: The model's size: letter pairs and triples fall into so many buckets for each language.
BUCKETS = 1 << 16
#: What a change of language costs, in units of log-likelihood.
SWITCH = 12.0
#: A script belongs to a language if it has this share of the language's letters.
SCRIPT_SHARE = 0.01
#: Words are scored in pieces of about PIECE characters; the paths of a block of texts are walked together.
BLOCK, PIECE = 6_000_000, 500_000
#: Where whole rows are judged, about so many bytes of texts are unpacked at a time.
SLICE = 2_000_000

# First and last code points of the letters of scripts, from the Unicode block chart.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("georgian", 0x1C90, 0x1CBF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
)
_NAMES = tuple(dict.fromkeys(name for name, *_ in SCRIPTS))
OTHER = len(_NAMES)
SPAN = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
SPAN_SQL = "array<struct<first:int,end:int,lang:string>>"


@dataclass(frozen=True)
class Model:
    """Log-likelihoods by bucket and language, and which scripts each language uses."""

    langs: tuple[str, ...]
    scores: np.ndarray  # (2 * BUCKETS, languages): letter pairs, then triples
    scripts: np.ndarray  # (scripts + 1, languages)


_letters: list[np.ndarray] = []


def _letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case (0: no letter), letter or not, and script of every code point; made once per process."""
    if not _letters:
        chars = [chr(i) for i in range(0x110000)]
        alpha = np.array([c.isalpha() for c in chars])
        lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
        script = np.full(0x110000, OTHER, np.uint8)
        for name, low, high in SCRIPTS:
            script[low : high + 1] = _NAMES.index(name)
        _letters.extend((np.where(alpha, lower, 0).astype(np.uint32), alpha, script))
    return tuple(_letters)


@dataclass
class Words:
    """Words (runs of letters) of some texts, flat: letters' places and features, words' first letters and texts."""

    offsets: np.ndarray  # of the texts in the joined code points
    first: np.ndarray  # place of each word's first letter
    end: np.ndarray
    begins: np.ndarray  # index of the word's first letter among all letters
    pairs: np.ndarray  # bucket of each letter with the one before
    triples: np.ndarray  # bucket of each letter with both neighbours
    script: np.ndarray  # of each word

    def of_text(self) -> np.ndarray:
        """Index of the first word of each text, and of none after the last."""
        return np.searchsorted(self.first, self.offsets)


def read_words(texts: list[str]) -> Words:
    lower, alpha, script = _letter_tables()
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    c = lower[points]
    at = np.flatnonzero(alpha[points])
    here = c[at].astype(np.uint64)
    padded = np.concatenate([[0], c, [0]]).astype(np.uint64)
    before, after = padded[at], padded[at + 2]
    pairs = (before * np.uint64(0x1F123BB5) + here * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    triples = (before * np.uint64(0xC2B2AE3D27D4EB4F) + here * np.uint64(0x165667B19E3779F9) + after * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(48)
    opens = np.flatnonzero(before == 0)
    closes = np.flatnonzero(after == 0)
    first = at[opens]
    return Words(offsets, first, at[closes] + 1, opens, pairs.astype(np.int32), triples.astype(np.int32), script[points[first]])


def score_words(words: Words, model: Model) -> np.ndarray:
    """(words, languages): each word's log-likelihood; languages that don't use its script are out, unless none does."""
    if not len(words.begins):
        return np.zeros((0, len(model.langs)), np.float32)
    letters = model.scores[words.pairs]
    letters += model.scores[words.triples + BUCKETS]
    scores = np.add.reduceat(letters, words.begins, axis=0)
    fits = model.scripts[words.script]
    scores[~fits & fits.any(axis=1, keepdims=True)] -= 1e6
    return scores


def best_paths(scores: np.ndarray, of_text: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word: the Viterbi path of each text, all texts at the same step. Ties go to the earlier language."""
    n = np.diff(of_text)
    order = np.argsort(-n, kind="stable")
    starts, lengths = of_text[:-1][order], n[order]
    path = np.zeros(len(scores), np.int16)
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    value = np.zeros((len(order), scores.shape[1]), np.float64)
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")  # texts longer than each step
    for t, k in enumerate(active):
        v, at = value[:k], starts[:k] + t
        if t:
            came = v.argmax(axis=1)
            jump = v[np.arange(k), came][:, None] - switch
            better = jump > v
            switched[at], source[at] = better, came
            np.maximum(v, jump, out=v)
        v += scores[at]
        v -= v.max(axis=1, keepdims=True)
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        path[at] = state[:k]
        back = switched[at, state[:k]]
        state[:k] = np.where(back, source[at], state[:k])
    return path


def _blocks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size < most:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def read_texts(texts: list[str], model: Model, switch: float = SWITCH) -> tuple[list[str], np.ndarray, pa.Array]:
    """Language, score and spans of each text.

    A text's language is the one with most letters in its spans, ties to the first in order; the score is that
    share of the letters. Without letters: ``und``, 0 and no spans.
    """
    langs, scores, firsts, ends, kinds, counts = [], [], [], [], [], []
    for low, high in _blocks(texts, BLOCK):
        first, end, n_words, likely = [], [], [], []
        for a, b in _blocks(texts[low:high], PIECE):
            words = read_words(texts[low + a : low + b])
            n_words.append(np.diff(words.of_text()))
            base = np.repeat(words.offsets[:-1], n_words[-1])
            first.append(words.first - base)
            end.append(words.end - base)
            likely.append(score_words(words, model))
        first, end, n_words = (np.concatenate(x) for x in (first, end, n_words))
        path = best_paths(np.concatenate(likely), np.concatenate([[0], np.cumsum(n_words)]), switch)
        doc = np.repeat(np.arange(high - low), n_words)
        weight = np.zeros((high - low, len(model.langs)), np.int64)
        np.add.at(weight, (doc, path), end - first)
        total = weight.sum(axis=1)
        best = weight.argmax(axis=1)
        langs += [model.langs[b] if n else "und" for b, n in zip(best, total)]
        scores.append(weight.max(axis=1, initial=0) / np.maximum(total, 1))
        new = np.ones(len(path), bool)
        new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(path)) - 1 if len(opens) else opens
        firsts.append(first[opens])
        ends.append(end[closes])
        kinds.append(path[opens])
        counts.append(np.bincount(doc[opens], minlength=high - low))
    def joined(parts):
        return np.concatenate([np.zeros(0, np.int64), *parts])

    names = pa.array(model.langs, pa.string()).take(pa.array(joined(kinds).astype(np.int32)))
    flat = pa.StructArray.from_arrays([pa.array(joined(firsts), pa.int32()), pa.array(joined(ends), pa.int32()), names], fields=list(SPAN))
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(joined(counts))]), pa.int32()), flat)
    return langs, joined(scores).astype(float), spans


def fit(labelled: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """The model of (doc_id, text, lang) rows with text and language: naive Bayes over letter pairs and triples.

    About ``sample`` rows are read, chosen by a hash of the id; all if there are no more. What reaches the driver
    is one number for each language and bucket that occurred.
    """
    count = labelled.count()
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = labelled.where(hashed < int((1 << 30) * min(1.0, sample / max(count, 1)) + 1))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            sums: dict[str, np.ndarray] = {}
            for low, high in _blocks(texts, PIECE):
                for lang in sorted(set(langs[low:high])):
                    words = read_words([t for t, x in zip(texts[low:high], langs[low:high]) if x == lang])
                    length = words.end - words.first
                    found = np.concatenate([
                        np.bincount(words.pairs, minlength=buckets), np.bincount(words.triples, minlength=buckets),
                        np.bincount(words.script, weights=length, minlength=OTHER + 1).astype(np.int64),
                    ])
                    sums[lang] = sums.get(lang, 0) + found
            for lang, found in sums.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = some.select("text", "lang").mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counts["lang"].unique()))
    sums = np.zeros((2 * buckets + OTHER + 1, len(langs)))
    sums[counts["bucket"].to_numpy(), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)] = counts["n"]
    halves = [np.log((h + 0.5) / (h.sum(axis=0) + 0.5 * buckets)) for h in (sums[:buckets], sums[buckets : 2 * buckets])]
    letters = sums[2 * buckets :]
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return Model(langs, np.concatenate(halves).astype(np.float32), uses)


def label(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every document; only its text is read.

    Null texts and texts without a letter are ``und`` with score 0 and no spans. Spans hold code point places.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fallback = replace(model, langs=("und",), scores=np.zeros((2 * BUCKETS, 1), np.float32), scripts=np.ones((OTHER + 1, 1), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, spans = read_texts(texts, shared.value if shared.value.langs else fallback, switch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), spans], names=["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans {SPAN_SQL}")


def select_known(docs: DataFrame, model: Model, least: float, switch: float = SWITCH) -> DataFrame:
    """The documents in which one learned language has the share ``least`` of the letters; null and letterless texts go.

    Rows are judged where they are read, with all their columns; nothing is joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        kept = [np.zeros(0, bool)]
        for low, high in text_slices(texts, SLICE):
            langs, scores, _ = read_texts([t or "" for t in texts.slice(low, high - low).to_pylist()], shared.value)
            kept.append(np.array([lang != "und" for lang in langs], bool) & (scores >= least))
        return pa.array(np.concatenate(kept))

    return docs.where(known("text") if model.langs else F.lit(False))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """The model learned from the documents that aren't held out and have a language."""
    return fit(docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "text", "lang"))


def op4_languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = label(docs, fit_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op4_languages": op4_languages}
SQL: dict[str, str] = {}
