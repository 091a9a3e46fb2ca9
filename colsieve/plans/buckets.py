"""Order-preserving buckets, so that running totals need no one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colsieve.plans.settle import settle

# A group of up to this many rows is sorted by one task.
ONE_TASK_ROWS = 500_000


def needs_buckets(df: DataFrame, by: Sequence[str], limit: int = ONE_TASK_ROWS) -> int:
    """0 if every group fits into one task, else the row count. ``df`` must be settled."""
    rows = df.count()
    if rows <= limit or (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= limit:
        return 0
    return rows


def order_buckets(df: DataFrame, column: str, rows: int, limit: int = ONE_TASK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_bucket``: within a group, larger values never fall into a smaller bucket. Null is the least value, NaN the greatest.

    The buckets are range partitions by group and value, so the executors cut
    them and the driver holds Spark's bounded sample only. A bucket has about half of
    ``limit`` rows, also if one group holds most of the table. ``df`` must hold
    one row per group and value; the result is written once, so that all uses see the same cut.
    """
    pieces = max(2, -(-2 * rows // limit))
    return settle(df.repartitionByRange(int(pieces), *by, column).withColumn("_bucket", F.spark_partition_id()))
