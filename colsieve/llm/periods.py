"""Periodic runs of words: stretches that repeat themselves at least four times.

A run is a stretch of consecutive words whose smallest period is q, that no neighbouring word extends with that
period, and that is at least max(LEAST_WORDS, POWER * q) words long. Such a run from s to e is a maximal pair: the
words from s to e - q stand again q words later, and neither the words before nor those after both agree. Pairs are
enumerated bottom-up in the tree of LCP intervals of a suffix order.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colsieve.llm.shared import table

LEAST_WORDS, POWER = 6, 4
#: Every three words of a run stand in it this often, whatever its period.
_GRAM, _GRAM_TIMES = 3, 3
#: Rows go out in batches of about so many characters of text.
BLOCK = 1 << 20


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known = {w: k for k, w in enumerate(words)}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def suspects(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, ends) of the stretches in which alone runs can lie.

    A run has at least six words and four periods, so that each three words in it stand in it three times. Words
    outside such threes part the text into stretches, which are looked at again by themselves until none shrinks.
    """
    firsts, ends = np.array([0]), np.array([len(ids)])
    ids = _dense(ids)
    while True:
        long = ends - firsts >= LEAST_WORDS
        firsts, ends = firsts[long], ends[long]
        if not len(firsts):
            return firsts, ends
        sizes = ends - firsts
        offset = np.repeat(firsts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        place = np.arange(sizes.sum()) + offset
        stretch = np.repeat(np.arange(len(firsts)), sizes)
        whole = place + _GRAM <= ends[stretch]
        at, key = place[whole], stretch[whole]
        for k in range(_GRAM):
            key = _dense(key * (len(ids) + 1) + ids[at + k])
        often = at[np.bincount(key)[key] >= _GRAM_TIMES]
        cover = np.bincount(often, minlength=len(ids) + 1) - np.bincount(often + _GRAM, minlength=len(ids) + 1)
        edges = np.zeros(len(ids) + 2, np.int8)
        edges[1:-1] = np.cumsum(cover[:-1]) > 0
        turns = np.diff(edges)
        new_firsts, new_ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        if len(new_firsts) == len(firsts) and (new_ends - new_firsts).sum() == sizes.sum():
            return firsts, ends
        firsts, ends = new_firsts, new_ends


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by their suffix up to ``ends``, and the suffixes' ranks, by doubling the length that is compared."""
    n, k = len(symbols), 1
    place, rank = np.arange(n), _dense(symbols)
    while True:
        beyond = place + k
        after = np.where(beyond < ends, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        if rank[order[-1]] == n - 1:
            return order, rank
        k *= 2


def common_lengths(symbols: list[int], ends: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Words that each suffix shares with the one before it in the order."""
    shared, h = [0] * len(order), 0
    for i, r in enumerate(rank):
        if r == 0:
            h = 0
            continue
        j = order[r - 1]
        room = min(ends[i] - i, ends[j] - j)
        while h < room and symbols[i + h] == symbols[j + h]:
            h += 1
        shared[r] = h
        h = max(h - 1, 0)
    return shared


def maximal_pairs(order: list[int], shared: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first place, distance, length) of the maximal pairs whose distance is at most a (POWER - 1)th of their length.

    The intervals of the order that share a length are closed bottom-up. An interval's places are kept as one list in
    the order of the text, whose members are of the class of their left word; a smaller child's places are put into a
    larger one's. Of a run's pair the second place is the interval's next one after the first, since its period is the
    smallest; so each place is held against its neighbours of other classes in the other child, and no pair of one
    class is walked. Lists that share too little for a pair are let go.
    """

    def joined(one: list[int], other: list[int], length: int) -> Iterator[tuple[int, int, int]]:
        if len(one) < len(other):
            one, other = other, one
        reach = length // (POWER - 1)
        for place in other:
            at = bisect_left(one, place)
            for first, second in ((one[at - 1], place) if at else (0, length + 1), (place, one[at]) if at < len(one) else (0, length + 1)):
                if second - first <= reach and left[first] != left[second] and length + second - first >= LEAST_WORDS:
                    yield first, second - first, length
        for place in other:
            insort(one, place)
        return one

    open_, node = [], [order[0]]
    for k in range(1, len(order) + 1):
        length = shared[k] if k < len(order) else 0
        if length < POWER - 1:
            length = 0
        while open_ and open_[-1][0] >= max(length, 1):
            of, places = open_.pop()
            node = yield from joined(places, node, of)
        if length:
            open_.append((length, node))
        node = [order[k]] if k < len(order) else []


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    firsts, stops = suspects(ids)
    if not len(firsts):
        return []
    sizes = stops - firsts
    begins = np.concatenate([[0], np.cumsum(sizes)])
    stretch = np.repeat(np.arange(len(firsts)), sizes)
    place = np.arange(begins[-1]) + (firsts - begins[:-1])[stretch]
    # Stretches share no symbol, so no suffix meets one of another stretch.
    symbols = _dense(stretch * (ids.max() + 1) + ids[place])
    ends = begins[1:][stretch]
    order, rank = suffix_order(symbols, ends)
    left = np.concatenate([[-1], symbols[:-1]])
    left[begins[:-1]] = -1 - np.arange(len(firsts))
    shared = common_lengths(symbols.tolist(), ends.tolist(), order.tolist(), rank.tolist())
    least: dict[tuple[int, int], int] = {}
    for first, distance, length in maximal_pairs(order.tolist(), shared, left.tolist()):
        span = int(place[first]), length + distance
        least[span] = min(distance, least.get(span, distance))
    return sorted((start, length, period) for (start, length), period in least.items())


def summary(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text's words and runs."""
    best = (None, None, None, None)
    for start, length, period in found:
        if best[0] is None or length * best[2] > best[1] * period:
            best = start, length, period, 1000 * length // period
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = words
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            drop[start + period] += 1
            drop[start + length] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
    return (len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's change: in every tenth document, by its id's checksum, the words from some place on repeat the first of them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RESULT = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_KINDS = [*[pa.int64()] * 5, pa.string(), pa.string()]


def periods(docs: DataFrame, change=None) -> DataFrame:
    """The runs of every whole text: their number, the one of greatest exponent (ties: first, then shortest period), digests.

    Null and blank texts have no words and no run. Rows are looked at one by one where they are read, nothing is
    shuffled; a task holds one text and a batch of results. Other columns than doc_id and text are not read. ``change``
    (words, doc_id) is applied to the words first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, at, size = batch.column("doc_id"), [], 0, 0
            for k, text in enumerate(batch.column("text")):
                text = (text.as_py() or "").encode()
                words = text.split()
                if change:
                    words = change(words, ids[k].as_py())
                rows.append(summary(words, runs(numbers(words)) if len(words) >= LEAST_WORDS else []))
                size += len(text)
                if size > BLOCK or k == len(batch) - 1:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), *columns], names=names)
                    rows, at, size = [], k + 1, 0

    schema = RESULT.format(docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op13_periods(spark: SparkSession, sf: str) -> DataFrame:
    return periods(table(spark, sf, "documents"), repeat_tail)


QUERIES = {"op13_periods": op13_periods}
SQL: dict[str, str] = {}
