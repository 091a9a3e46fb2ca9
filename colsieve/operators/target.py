"""Target columns: median labels, 0/1 bits, class numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colsieve.operators.profile import MISSING_TEXT, is_numeric, parsed_number, require_column
from colsieve.plans.order_stats import exact_medians, number
from colsieve.plans.ranking import number_rows
from colsieve.plans.settle import attach


def median_binary(
    df: DataFrame,
    source: str,
    output: str | None = None,
    labels: Sequence[str] = ("low", "high"),
    threshold: float | None = None,
    drop_source: bool | None = None,
) -> DataFrame:
    """``labels[1]`` where the value is above the threshold (default: exact median), else ``labels[0]``."""
    require_column(df, source)
    output = output or source
    numeric = is_numeric(df.schema[source].dataType)
    value = number(source) if numeric else parsed_number(source)
    if not df.where(value.isNull()).limit(1).isEmpty():
        raise ValueError(f"column '{source}' holds values that are no numbers")
    if threshold is None:
        threshold = exact_medians(df.select(value.alias(source)), [source])[source]
    out = df.withColumn(output, F.when(value > F.lit(float(threshold)), labels[1]).otherwise(labels[0]))
    drop_source = source != output if drop_source is None else drop_source
    return out.drop(source) if drop_source else out


def _ends(df: DataFrame, value: Column) -> tuple:
    row = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    return row["low"], row["high"]


def _only_two_values(df: DataFrame, value: Column, low, high) -> bool:
    """No value lies between least and greatest. The search stops at the first one that does."""
    return df.where((value > F.lit(low)) & (value < F.lit(high))).limit(1).isEmpty()


def label_text(target: str) -> Column:
    return F.coalesce(F.col(target).cast("string"), F.lit(MISSING_TEXT))


def _bit(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _above_median(df: DataFrame, target: str) -> Column:
    median = exact_medians(df, [target])[target]
    return F.lit(False) if median is None else number(target) > F.lit(median)


def injection_bit(df: DataFrame, target: str) -> Column:
    """The 0/1 target that leaks copy.

    Numbers with exactly two values: 1 is the greater. Other numbers: 1 is above
    the median. Text: 1 is the greatest label.
    """
    if not is_numeric(df.schema[target].dataType):
        _, high = _ends(df, label_text(target))
        return _bit(label_text(target) == F.lit(high))
    low, high = _ends(df, number(target))
    if low is not None and low != high and _only_two_values(df, number(target), low, high):
        return _bit(number(target) == F.lit(high))
    return _bit(_above_median(df, target))


def metric_bit(df: DataFrame, target: str) -> Column:
    """The 0/1 target of the metrics.

    As ``injection_bit``, but a number column with a single value is all 1 and a
    text column with a single value all 0.
    """
    if not is_numeric(df.schema[target].dataType):
        low, high = _ends(df, label_text(target))
        return _bit(F.lit(low != high) & (label_text(target) == F.lit(high)))
    low, high = _ends(df, number(target))
    if low is not None and _only_two_values(df, number(target), low, high):
        return _bit(number(target) == F.lit(high))
    return _bit(_above_median(df, target))


def label_numbers(df: DataFrame, target: str) -> DataFrame:
    """(label, label_index): the distinct labels as text, numbered from 0 in order."""
    labels = df.select(label_text(target).alias("label")).distinct()
    numbered = number_rows(labels, [], [F.col("label").asc()], "_number")
    return numbered.select("label", (F.col("_number") - 1).cast("int").alias("label_index"))


def with_label_index(df: DataFrame, target: str, output: str = "label_index") -> DataFrame:
    rows = df.withColumn("_label", label_text(target))
    numbers = label_numbers(df, target).select(F.col("label").alias("_label"), F.col("label_index").alias(output))
    return attach(rows, numbers, ["_label"], "inner").drop("_label")
