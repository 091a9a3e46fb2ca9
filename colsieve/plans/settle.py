"""Write-once intermediate tables and joins whose broadcast side is counted first."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A lookup of at most this many rows and bytes is broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
JOIN_SALTS = 32


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one inside the warehouse, which is shared as well."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def _is_settled(df: DataFrame) -> bool:
    """Has this very table just been written? Then writing it again would gain nothing."""
    return getattr(df, "_settled", False)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the shared folder and go on from the copy.

    For results that are used several times: later steps neither recompute the
    inputs nor see other rows when a lost executor's work is redone.
    """
    if _is_settled(df):
        return df
    checkpoint_folder(df.sparkSession)
    written = df.checkpoint(eager=True)
    written._settled = True
    return written


def store(df: DataFrame) -> DataFrame:
    """Write a wide, long table once as Parquet into the shared folder; each later use reads only the columns it needs."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _keyed(lookup: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column, list[str]]:
    """The lookup under other key names, the null-safe condition, and those names."""
    names = [f"_of_{c}" for c in on]
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`")) for c in on])
    return lookup.withColumnsRenamed(dict(zip(on, names, strict=True))), same, names


def match(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join of tables as small as a catalogue: nothing is written or measured, Spark chooses from what it sees at run time."""
    keyed, same, names = _keyed(lookup, list(on))
    return rows.join(keyed, same, how).drop(*names)


def _is_small(lookup: DataFrame, limit: int) -> bool:
    size = F.octet_length(F.to_json(F.struct(*lookup.columns)))
    measured = lookup.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return measured["rows"] <= limit and (measured["bytes"] or 0) <= BROADCAST_BYTES


def attach(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a lookup (unique on ``on``) to a large, possibly skewed table; a null key meets the null key.

    The lookup is written and measured. Up to ``limit`` rows and 32 MB it is
    broadcast and the large side does not move. Beyond that both sides are
    salted, so a hot key is spread over many tasks.
    """
    on = list(on)
    lookup = settle(lookup)
    keyed, same, extra = _keyed(lookup, on)
    if _is_small(lookup, limit):
        return rows.join(F.broadcast(keyed), same, how).drop(*extra)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(JOIN_SALTS)).cast("int"))
    copies = keyed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return salted.join(copies, same & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy", *extra)
