"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colsieve.plans.settle import attach, settle

# A group of up to this many rows is numbered by one task.
ONE_TASK_ROWS = 500_000


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], output: str = "rank", limit: int = ONE_TASK_ROWS
) -> DataFrame:
    """Number the rows of each group from 1, as long. ``order`` must leave no ties; null keys are a group.

    If a group is too large for one task, the table is range-partitioned by group
    and order, each piece is numbered on its own, and the rows of the group that
    lie in earlier pieces are added.
    """
    by = list(by)
    df = settle(df)
    total = df.count()
    if total <= limit or (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= limit:
        return df.withColumn(output, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    pieces = -(-total // limit) * 2
    # The piece number is stored with the rows, so both uses below see the same cut.
    cut = settle(df.repartitionByRange(int(pieces), *by, *order).withColumn("_piece", F.spark_partition_id()))
    counts = cut.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order)))
    placed = attach(local, offsets, [*by, "_piece"], "inner")
    return placed.withColumn(output, F.col("_local") + F.col("_before")).drop("_piece", "_local", "_before")
