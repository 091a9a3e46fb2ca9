"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.llm.languages import held_out
from colsieve.llm.shared import find_words, hash_words, mix, table, text_bytes, written

#: Bound of the fit: about so many labelled rows, chosen by a hash of their id, whatever the table's size.
SAMPLE = 20_000
#: 2**BITS weights and a constant; the fit runs in SHARDS tasks whose states are averaged after each of EPOCHS rounds.
BITS, SHARDS, EPOCHS = 18, 6, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0
BLOCK = 1 << 21

#: Words are runs of ASCII letters and digits and of all bytes of other characters.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: How far apart the two words of a feature stand, and what tells the kinds apart; 0 is the word alone.
_KINDS = ((0, 0x243F6A8885A308D3), (1, 0x13198A2E03707344), (2, 0xA4093822299F31D0))


def features(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, pair of neighbours and pair with one word between; with repeats."""
    starts, ends = find_words(data, borders, _GAP)
    text = np.searchsorted(borders, starts, "right") - 1
    hashes = hash_words(data, starts, ends)
    texts, found = [], []
    for apart, kind in _KINDS:
        n = max(len(hashes) - apart, 0)
        one = hashes[:n] if apart == 0 else hashes[:n] * np.uint64(3) + mix(hashes[apart:])
        within = text[:n] == text[apart : apart + n]
        texts.append(text[:n][within])
        found.append((mix(one[within] ^ np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(found)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the features, and the constant last

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability that each text is toxic. A feature counts once for a text; those without weight are left out first."""
        total = np.full(len(offsets) - 1, self.weights[-1], float)
        low = 0
        while low < len(total):
            high = max(int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1, low + 1)
            text, feature = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            heavy = self.weights[feature] != 0
            both = np.unique(text[heavy] << BITS | feature[heavy])
            total[low:high] += np.bincount(both >> BITS, weights=self.weights[both & ((1 << BITS) - 1)], minlength=high - low)
            low = high
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of an FTRL state: 0 unless the summed gradients exceed L1; each coordinate has its own rate."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(present: np.ndarray, y: int, z: np.ndarray, n: np.ndarray) -> None:
    """One step of FTRL-proximal: a row's different features and its label; changes the state."""
    at = np.append(present, 1 << BITS)
    w = weights(z[at], n[at])
    g = 1 / (1 + np.exp(-np.clip(w.sum(), -500, 500))) - y
    z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
    n[at] += g * g


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text in place of itself as its different features, in ascending order: at most 2**BITS, however long it is."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        low = 0
        while low < len(batch):
            high = max(int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1, low + 1)
            text, feature = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            both = np.unique(text << BITS | feature)
            begins = np.searchsorted(both, np.arange(high - low + 1) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(both & ((1 << BITS) - 1), pa.int32()))
            rest = [batch.column(c).slice(low, high - low) for c in ("shard", "turn", "toxic")]
            yield pa.RecordBatch.from_arrays([*rest, lists], names=["shard", "turn", "toxic", "features"])
            low = high


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of documents (doc_id, text) with ``labels`` (doc_id, toxic).

    About ``sample`` labels are chosen by a hash of the id, so that they may be broadcast; a document with several
    labels has the greatest. The chosen texts are read once and written as lists of features. Every shard passes
    over its rows in the same order each time, an Arrow batch after the other; the shards' changes are averaged by
    Spark. What reaches the driver is bounded by the number of weights.
    """
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    some = labels.where(hashed < int((1 << 30) * min(1.0, sample / max(labels.count(), 1)) + 1)).withColumnRenamed("doc_id", "_doc")
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)).cast("int")
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_doc"))
    texts = chosen.select(shard.alias("shard"), F.xxhash64("doc_id").alias("turn"), F.col("toxic").cast("int").alias("toxic"), "text")
    rows = written(texts.mapInArrow(_present, "shard int, turn long, toxic int, features array<int>"), "labelled")
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    context = docs.sparkSession.sparkContext
    for _ in range(EPOCHS):
        shared = context.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z0, n0 = shared.value
            here, z1, n1 = None, z0, n0

            def changes() -> pa.RecordBatch:
                at = np.flatnonzero((z1 != z0) | (n1 != n0))
                columns = [pa.array(at, pa.int64()), pa.array((z1 - z0)[at]), pa.array((n1 - n0)[at]), pa.array(np.full(len(at), here, np.int32))]
                return pa.RecordBatch.from_arrays(columns, names=["at", "dz", "dn", "shard"])

            for batch in batches:
                lists = batch.column("features")
                for i, (of, y) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist())):
                    if of != here:
                        if here is not None:
                            yield changes()
                        here, z1, n1 = of, z0.copy(), n0.copy()
                    learn(lists[i].values.to_numpy(), y, z1, n1)
            if here is not None:
                yield changes()

        # summed in a fixed order of shards, so that reruns agree to the last digit
        dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn", "toxic", "features")
        changes = dealt.mapInArrow(run, "at long, dz double, dn double, shard int").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("shard", "dz", "dn"))).alias("x"))
        total = [F.aggregate(f"x.{c}", F.lit(0.0), lambda s, x: s + x).alias(c) for c in ("dz", "dn")]
        moved = changes.select("at", *total).toPandas()
        z[moved["at"]] += moved["dz"] / SHARDS
        n[moved["at"]] += moved["dn"] / SHARDS
        shared.destroy()
    return Model(weights(z, n))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document; only its whole text is read (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(*text_bytes(batch.column("text"))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
