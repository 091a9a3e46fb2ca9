"""Result tables, partitioned by dataset and run kind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.sources import tables

RUN_KINDS = ("main", "ablation")
DEBUG_DATASET = "synthetic"


def write_results(results: Mapping[str, DataFrame], base: str, run_kind: str, csv: bool = False) -> dict[str, str]:
    """One folder per result (metrics, selected, semantic); only the partitions written are replaced."""
    if run_kind not in RUN_KINDS:
        raise ValueError(f"run kind must be one of {RUN_KINDS}")
    paths = {}
    for name, df in results.items():
        paths[name] = f"{base.rstrip('/')}/{name}"
        rows = df.withColumn("run_kind", F.lit(run_kind))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("dataset", "run_kind").parquet(paths[name])
        if csv:
            rows.write.mode("overwrite").option("header", True).csv(f"{paths[name]}_csv/{run_kind}")
    return paths


def read_results(spark: SparkSession, base: str, name: str, run_kind: str, include_debug: bool = False) -> DataFrame:
    """All datasets of one kind of run; both filters prune partitions."""
    df = tables.nan_as_null(spark.read.parquet(f"{base.rstrip('/')}/{name}")).where(F.col("run_kind") == run_kind)
    return df.drop("run_kind") if include_debug else drop_debug(df.drop("run_kind"))


def union_results(frames: Sequence[DataFrame], include_debug: bool = False) -> DataFrame:
    """Stack result tables; a column that one of them lacks is null there."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked if include_debug else drop_debug(stacked)


def drop_debug(df: DataFrame) -> DataFrame:
    return df.where(F.col("dataset") != DEBUG_DATASET)


def only_role(df: DataFrame, role: str) -> DataFrame:
    return df.where(F.col("scoring_role") == role)


def tag_rows(df: DataFrame, seed: int, role: str, provider: str, model: str) -> DataFrame:
    """Constant columns that say which run the rows come from."""
    return df.withColumns({
        "seed": F.lit(seed), "scoring_role": F.lit(role),
        "provider": F.lower(F.lit(provider)), "model": F.lit(model),
    })
