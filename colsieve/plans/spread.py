"""Using all cores for a source that came in few pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Moving rows pays only if far fewer pieces than cores came in.
CORES_PER_PIECE = 4


def spread(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hash the rows over the cores if the source has less than a quarter as many pieces.

    A table of many files or splits is left alone; one small file would otherwise
    keep hashing, exploding and fitting in a single task. ``key`` should be unique.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * CORES_PER_PIECE > cores:
        return df
    return df.repartition(cores, *key)
