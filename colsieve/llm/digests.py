"""Document fingerprints: quartile codes of hashed byte triplets, compared by a bounded difference."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.llm.shared import table

BUCKETS = 256
#: Triplets are a byte and two of the next ones; each kind has an odd factor of its own.
_TRIPLETS = ((1, 2, 0x9E3779B1), (1, 3, 0x85EBCA6B), (2, 3, 0xC2B2AE35))
#: The difference at which digests have nothing in common: what codes dealt out at random differ by, 1.25 a bucket.
FAR = 1.25 * BUCKETS
#: Pieces of the order of documents, for each shuffle partition.
PIECES = 8


def digest(text: bytes) -> str:
    """Hex digest of a text: its length on a log scale, then for each bucket of triplets in which quarter its count lies."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 1 << 20):
        part = data[at : at + (1 << 20) + 3]
        for second, third, factor in _TRIPLETS:
            n = min(len(part) - third, 1 << 20)
            if n > 0:
                hashed = (part[:n] | part[second : second + n] << 8 | part[third : third + n] << 16) * np.uint32(factor) >> 24
                counts += np.bincount(hashed, minlength=BUCKETS)
    quarters = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quarters).sum(axis=1).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return f"{min(255, round(8 * math.log2(1 + len(text)))):02x}{packed.tobytes().hex()}"


def _codes(digest: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(digest[2:]), np.uint8)
    return int(digest[:2], 16), np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int16)


def likeness(one: str, other: str) -> float:
    """1 for equal digests, down to 0: the codes' and lengths' differences, at most FAR in all."""
    (length, codes), (length2, codes2) = _codes(one), _codes(other)
    return 1 - min(int(np.abs(codes - codes2).sum()) + abs(length - length2), FAR) / FAR


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text (null: empty)."""

    @F.pandas_udf("string")
    def one(texts: pd.Series) -> pd.Series:
        return pd.Series([digest((t or "").encode()) for t in texts], dtype=object)

    return docs.select("doc_id", one("text").alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """(piece, extra, doc_id, text) such that within a piece every document with extra 0 is followed by the next one.

    The order is by descending doc_id, null last, equal ids by text. Quantiles of the ids cut it into pieces; the first
    document of each piece is copied to the end of the piece before (the last's is the first of all) with extra 1.
    Texts are moved once; the bounds and first ids are one number for each piece.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (PIECES * partitions) for i in range(1, PIECES * partitions)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * PIECES * partitions)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(), "left"))

    piece = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(place(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))).alias("piece")
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), piece)
    heads = docs.select("doc_id", piece).groupBy("piece").agg(F.max("doc_id")).orderBy("piece").collect()
    before = [(doc_id, heads[i - 1].piece) for i, (_, doc_id) in enumerate(heads)]
    copies = spark.createDataFrame(before, "_head long, _to int")
    joined = placed.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    places = F.array(F.struct("piece", F.lit(0).alias("extra")), F.struct(F.col("_to").alias("piece"), F.lit(1).alias("extra")))
    rows = joined.select("doc_id", "text", F.explode(F.filter(places, lambda p: p["piece"].isNotNull())).alias("p"))
    return rows.select("p.piece", "p.extra", "doc_id", "text").repartition(partitions, "piece").sortWithinPartitions("piece", "extra", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op9_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every text, of its edited text, and how near both and the next document's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (piece, doc_id, text, digest) of a document whose next is still to come
        for batch in batches:
            rows = []
            for piece, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("piece", "extra", "doc_id", "text"))):
                if extra and (last is None or last[0] != piece):
                    continue  # a further copy of the first document of the next piece
                own = digest(text.encode())
                if last and last[0] == piece:
                    _, before, earlier, first = last
                    new = edited(earlier, text).encode()
                    changed = digest(new)
                    rows.append((before, len(earlier), hashlib.sha256(new).hexdigest(), first, changed, likeness(first, changed), likeness(first, own)))
                last = None if extra else (piece, doc_id, text, own)
            names = [f.split()[0] for f in RESULT.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)

    return with_next(table(spark, sf, "documents")).mapInArrow(run, RESULT)


QUERIES = {"op9_digests": op9_digests}
SQL: dict[str, str] = {}
