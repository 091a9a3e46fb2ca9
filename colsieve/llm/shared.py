"""What several operators need: tables, lineage cuts, connected components, hashed words."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: White space of the word patterns: blank and the control characters from tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
#: ASCII letters without case.
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 21


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, as in tests, a folder inside the warehouse, which driver and executors share.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute a narrow table once and cut its lineage: a lost executor takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a wide table as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same_text(text: Column) -> Column:
    """Key of equal texts; null for null."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def components(links: DataFrame, edges_a_task: int | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its least node.

    Alternates large and small stars: every node's neighbours move to its least neighbour until only stars are
    left, which takes logarithmically many rounds. A node with many links is aggregated on the map side and its
    joins can be split, so it isn't gathered anywhere. Links with a null or equal ends say nothing. ``edges_a_task``:
    few edges are read by few tasks, so that a round leaves few shuffle files.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct())
    before = _digest(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = settle(small.where("u <> v").distinct())
        if edges_a_task:
            edges = edges.coalesce(1 + before[0] // edges_a_task)
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _digest(edges: DataFrame) -> tuple:
    """Row count and an order-free sum of row hashes: equal for equal sets of edges."""
    part = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(part)).first())


# Hashed words of many texts at once. Everything below works on flat numpy arrays.


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _table(kind: str, base: int, n: int) -> np.ndarray:
    if len(_tables.get(kind, ())) < n:
        _tables[kind] = _powers(base, max(n, _BLOCK + 1))
    return _tables[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_words(data: np.ndarray, borders: np.ndarray, gap: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word; ``borders`` are the bytes where texts begin or end, ``gap`` says what bytes part words."""
    solid = ~gap[data]
    step = np.empty(len(data) + 1, bool)  # a word may begin here whatever stands before
    step[:] = False
    step[borders] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | step[1:-1]
    last[:-1] &= ~solid[1:] | step[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, ASCII case ignored: sums of byte times power, so that equal words have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(int(np.searchsorted(ends, low + _BLOCK, "right")), at + 1)
        n = int(ends[to - 1] - low)
        terms = (_LOWER[data[low : low + n]] + np.uint64(1)) * _table("up", _BASE, n)[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        s = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[s]) * _table("down", _INVERSE, n)[s]
        at = to
    return mix(out)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def text_slices(column, size: int):
    """(first, end) of slices of an Arrow string column of about ``size`` bytes each, so that few texts are Python strings at once."""
    _, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1, low + 1)
        yield low, high
        low = high


# Lookups that belong to every row.

#: A lookup of at most this many rows and bytes is broadcast, after it was measured.
LOOKUP_ROWS, LOOKUP_BYTES, SALTS = 20_000, 8 << 20, 64


def attach(rows: DataFrame, lookup: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join ``lookup`` (settled, unique on ``on``) to a skewed table; a null key meets the null key.

    A measured, small lookup is broadcast. A larger one is copied for each salt, so that a hot key's rows are
    spread over SALTS tasks.
    """
    key = F.col(f"_lookup.{on}")
    n, size = lookup.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(F.to_json(F.struct(*lookup.columns))), F.lit(0)))).first()
    if n <= LOOKUP_ROWS and (size or 0) <= LOOKUP_BYTES:
        joined = rows.join(F.broadcast(lookup.alias("_lookup")), rows[on].eqNullSafe(key), how)
    else:
        copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("_lookup")
        salt = F.pmod(F.xxhash64(*[rows[c] for c in rows.columns]), F.lit(SALTS)).cast("int")
        joined = rows.join(copies, rows[on].eqNullSafe(key) & (salt == F.col("_lookup._salt")), how)
    return joined.select(*[rows[c] for c in rows.columns], *[F.col(f"_lookup.{c}") for c in lookup.columns if c != on])


def row_hash(*columns: str) -> Column:
    """64-bit hash of columns that tells a null from every value, whichever column holds it."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def with_copies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``copy``: the number, from 0, of each row among those with equal ``keys``.

    Only rows that repeat are numbered: within pieces of the table, whose counts are summed, so that no task holds all
    copies of a row. m copies have the numbers 0 to m - 1 in any layout; which copy has which is left open.
    """
    keyed = rows.withColumn("_key", row_hash(*keys))
    many = settle(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1"))
    if many.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    found = attach(keyed, many, "_key")
    some = settle(found.where("_many is not null").withColumn("_piece", F.spark_partition_id()))
    pieces = some.groupBy("_key", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy("_key", "_piece").orderBy(F.lit(0))) - 1
    numbered = some.withColumn("_number", number).join(pieces, ["_key", "_piece"]).withColumn("copy", F.col("_before") + F.col("_number"))
    once = found.where("_many is null").withColumn("copy", F.lit(0).cast("long"))
    return once.select(*rows.columns, "copy").union(numbered.select(*rows.columns, "copy"))
