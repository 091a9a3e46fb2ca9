"""Exact top-k by inner product in three phases under a uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colsieve.llm.shared import table, written

K = 5
#: A vector's components fall into so many lists, each with a local score.
LISTS = 4
#: Queries go out in blocks of about so many, rows are scored in blocks of ROWS.
QUERIES_AT_ONCE, ROWS = 2048, 1024
SCALE = 256
RESULT = "query long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors as floor(scale * x). Null vectors and those with null or non-finite components are left out.

    Rows without vec_id are left out; of rows with equal ids the one with the least vector is taken.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), x.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of blocks of vectors with the same number of components."""
    lists = batch.column("v")
    ids, offsets, flat = batch.column("vec_id").to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for low in range(0, len(at), ROWS):
            some = at[low : low + ROWS]
            yield ids[some], flat[offsets[some][:, None] + np.arange(size)]


class Block:
    """A block of queries: ids and vectors by number of components."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(v) for v in vectors}:
            some = [(i, v) for i, v in zip(ids, vectors) if len(v) == size]
            self.by_size[size] = np.array([i for i, _ in some], np.int64), np.array([v for _, v in some], np.int64).reshape(len(some), size)

    def local_scores(self, ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray] | None:
        """(query ids, local scores of each list as rows x queries, which pairs are a query and itself)."""
        if matrix.shape[1] not in self.by_size:
            return None
        queries, q = self.by_size[matrix.shape[1]]
        parts = np.array_split(np.arange(matrix.shape[1]), LISTS)
        largest = float(np.abs(matrix).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(matrix.shape[1], 1)
        kind = np.float64 if largest < 2**53 else np.int64  # sums of whole doubles are exact as far as that
        scores = [(matrix[:, p].astype(kind) @ q[:, p].astype(kind).T).astype(np.int64) for p in parts]
        return queries, scores, ids[:, None] == queries


def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among (query, vec_id, score) parts without repeats; ties to the smaller vec_id."""
    query, vec, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), (), ())))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], vec[keep], score[keep]


def _search(vectors: DataFrame, block: Block, cutoff: dict[int, int] | None, k: int) -> DataFrame:
    """Each partition's k best of every query, out of the heads of its local lists (no cutoff) or all sufficient entries."""
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast((block, cutoff))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cutoff = shared.value
        kept: list = []
        for batch in batches:
            for ids, matrix in _rows(batch):
                scored = block.local_scores(ids, matrix)
                if scored is None:
                    continue
                queries, local, own = scored
                if cutoff is None:  # the heads of the local lists
                    chosen = np.zeros(own.shape, bool)
                    for x in local:
                        n = min(k + 1, len(x))
                        np.put_along_axis(chosen, np.argpartition(-x, n - 1, axis=0)[:n], True, axis=0)
                else:
                    least = np.array([cutoff.get(int(i), -(2**62)) for i in queries])
                    # a total at the cutoff needs a list with its share
                    chosen = np.logical_or.reduce([x * LISTS >= least for x in local])
                row, q = np.nonzero(chosen & ~own)
                total = sum(x[row, q] for x in local)
                if cutoff is not None:
                    enough = total >= least[q]
                    row, q, total = row[enough], q[enough], total[enough]
                kept = [best([*kept, (queries[q], ids[row], total)], k)]
        query, vec, score = best(kept, k)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], names=["query", "vec_id", "score"])

    return vectors.mapInArrow(run, RESULT)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query, vec_id, score, rank): the k highest inner products of each query with the other vectors (vec_id, v).

    Vectors have unique ids; only vectors of the query's length count; fewer than k vectors give all. In blocks of
    queries, as large as a broadcast may be: (1) every partition sends the heads of its local score lists, one for each
    part of the components, with their totals; a query's k-th best total so far is a safe cutoff. (2) The cutoff is
    broadcast; an entry can reach it only if one of its local scores has the LISTS-th part, and all such are collected.
    (3) Their totals are resolved; those at the cutoff or above go on, at most k for each partition and query.
    """
    spark = vectors.sparkSession
    blocks = -(-vectors.where(is_query).count() // QUERIES_AT_ONCE)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = None
    for number in range(blocks):
        queries = vectors.where(is_query & (part == number)).orderBy("vec_id").collect()
        block = Block([r.vec_id for r in queries], [r.v for r in queries])
        heads = _search(vectors, block, None, k).withColumn("rank", F.row_number().over(order))
        cutoff = {r.query: r.score for r in heads.where(F.col("rank") == k).collect()}
        some = _search(vectors, block, cutoff, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = some if found is None else found.union(some)
    return spark.createDataFrame([], RESULT + ", rank int") if found is None else found


def op7_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = written(whole_numbers(table(spark, sf, "embeddings")), "vectors")
    found = top_k(vectors, F.col("vec_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


QUERIES = {"op7_top_k": op7_top_k}
SQL = {
    "op7_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), single AS (
  SELECT vec_id, MIN(v) AS v FROM whole GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM single q JOIN single c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
}
