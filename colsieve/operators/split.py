"""Exact stratified train / validation / test splits for many seeds at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colsieve.functions.hashing import digest, u01
from colsieve.operators.target import label_text
from colsieve.plans.settle import attach, settle

# Hex digits of the row digest by which the histogram's buckets are told apart,
# and by which they are refined while too many rows share the bucket of a cut.
BUCKET_DIGITS = 4
DIGEST_DIGITS = 32
# Rows of a bucket that one task ranks.
ONE_TASK_ROWS = 500_000
_KEYS = ("seed", "_label")


def with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One copy of each row per seed; the seeds are a short list, so no join is needed."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def _keyed(df: DataFrame, target: str, row_id: str, seeds: Sequence[int]) -> DataFrame:
    rows = with_seeds(df.withColumn("_label", label_text(target)), seeds)
    return rows.withColumn("_digest", digest(F.col("seed"), F.col(row_id)))


def _second_cut(train: float, validation: float, test: float) -> float:
    return train + (1.0 - train) * validation / (validation + test)


def split_cuts(
    df: DataFrame,
    target: str,
    row_id: str,
    seeds: Sequence[int],
    train: float = 0.6,
    validation: float = 0.2,
    test: float = 0.2,
    bucket_digits: int = BUCKET_DIGITS,
    limit: int = ONE_TASK_ROWS,
) -> DataFrame:
    """(seed, _label, _train_end, _validation_end): last row of the parts of each class, in digest order.

    Only the target and the row id of ``df`` are read. A class may hold most of
    the table, so its rows are never sorted together: a histogram of digest
    prefixes finds the bucket in which each cut lies, and only the rows of these
    buckets go on. While one of them has more than ``limit`` rows, they are
    counted again by longer prefixes. Rows that share the whole digest are one row
    id's; the cut is the same whichever of them it falls on, so they aren't ranked.
    """
    rows = _keyed(df.select(target, row_id), target, row_id, seeds).select(*_KEYS, F.col(row_id).alias("_row"), "_digest")
    shares = (train, _second_cut(train, validation, test))
    wanted, known = None, 0
    while True:
        digits = min(known + bucket_digits, DIGEST_DIGITS)
        placed = rows.withColumn("_bucket", F.substring("_digest", 1, digits))
        counts = placed.groupBy(*_KEYS, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_whole", F.substring("_bucket", 1, known))
        before = F.sum("_n").over(Window.partitionBy(*_KEYS, "_whole").orderBy("_bucket")) - F.col("_n")
        counts = counts.withColumn("_before", before)
        if wanted is None:
            size = F.sum("_n").over(Window.partitionBy(*_KEYS))
            counts = counts.withColumns({f"_need{i}": F.round(size * F.lit(share)).cast("long") for i, share in enumerate(shares, start=1)})
        else:
            counts = attach(counts, wanted, [*_KEYS, "_whole"], "inner")
        inside = [F.col(f"_need{i}") - F.col("_before") for i in (1, 2)]
        # Both cuts of a class may lie in one bucket: one lookup row per bucket.
        needs = settle(counts.select(*_KEYS, "_bucket", "_n", *[
            F.when((need > 0) & (need <= F.col("_n")), need).alias(f"_need{i}") for i, need in enumerate(inside, start=1)
        ]).where("_need1 IS NOT NULL OR _need2 IS NOT NULL"))
        near = attach(placed, needs, [*_KEYS, "_bucket"], "inner")
        largest = needs.agg(F.max("_n")).first()[0] or 0
        if largest <= limit or digits == DIGEST_DIGITS:
            break
        rows, wanted = settle(near.select(*rows.columns)), needs.select(*_KEYS, F.col("_bucket").alias("_whole"), "_need1", "_need2")
        known = digits
    last = F.struct("_digest", "_row")
    if largest <= limit:
        order = Window.partitionBy(*_KEYS, "_bucket").orderBy("_digest", "_row")
        ranked = near.withColumn("_rank", F.row_number().over(order))
        ends = [F.max(F.when(F.col("_rank") == F.col(f"_need{i}"), last)) for i in (1, 2)]
    else:
        ranked, ends = near, [F.max(F.when(F.col(f"_need{i}").isNotNull(), last)) for i in (1, 2)]
    return settle(ranked.groupBy(*_KEYS).agg(ends[0].alias("_train_end"), ends[1].alias("_validation_end")))


def apply_cuts(df: DataFrame, cuts: DataFrame, target: str, row_id: str, seeds: Sequence[int]) -> DataFrame:
    """Add ``seed`` and ``part`` by comparing each row with the cuts of its class; rows are not shuffled.

    ``df`` may be any table that holds the row ids and targets the cuts were made of.
    """
    here = F.struct(F.col("_digest"), F.col(row_id).alias("_row"))
    part = (
        F.when(here <= F.col("_train_end"), "train").when(here <= F.col("_validation_end"), "validation").otherwise("test")
    )
    cut_rows = attach(_keyed(df, target, row_id, seeds), cuts, _KEYS, "left")
    return cut_rows.withColumn("part", part).drop("_label", "_digest", "_train_end", "_validation_end")


def with_parts(df: DataFrame, cuts: DataFrame, target: str, row_id: str, seeds: Sequence[int]) -> DataFrame:
    """Add ``_parts``, the (seed, part) of a row under every seed, for rows that are to be written once and read by seed several times.

    The cuts of all seeds meet a row in one lookup by its class, and a digest is made once for each row and seed.
    ``by_seed`` takes the seeds apart; both together give what ``apply_cuts`` does.
    """
    ends = F.struct("seed", F.struct("_train_end", "_validation_end"))
    met = attach(df.withColumn("_label", label_text(target)), cuts.groupBy("_label").agg(F.map_from_entries(F.collect_list(ends)).alias("_ends")), ["_label"], "left")

    def of(seed: Column) -> Column:
        here, end = F.struct(digest(seed, F.col(row_id)).alias("_digest"), F.col(row_id).alias("_row")), F.try_element_at("_ends", seed)
        part = F.when(here <= end["_train_end"], "train").when(here <= end["_validation_end"], "validation").otherwise("test")
        return F.struct(seed.alias("seed"), part.alias("part"))

    return met.withColumn("_parts", F.transform(F.array(*[F.lit(int(s)) for s in seeds]), of)).drop("_label", "_ends")


def by_seed(df: DataFrame) -> DataFrame:
    """One copy of each row per seed with ``seed`` and ``part``, from the ``_parts`` of ``with_parts``."""
    return df.select(*[c for c in df.columns if c != "_parts"], F.inline("_parts"))


def stratified_split(
    df: DataFrame,
    target: str,
    row_id: str,
    seeds: Sequence[int],
    train: float = 0.6,
    validation: float = 0.2,
    test: float = 0.2,
    exact: bool = True,
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``seed`` and ``part``. Of each class the first round(n * train) rows in
    digest order are 'train', those up to round(n * (train + validation)) 'validation'.

    ``exact=False`` cuts the row's uniform draw instead: one narrow pass, class
    shares right only on average.
    """
    if exact:
        cuts = split_cuts(df, target, row_id, seeds, train, validation, test, bucket_digits)
        return apply_cuts(df, cuts, target, row_id, seeds)
    draw = u01(F.col("seed"), "split", F.col(row_id))
    second = _second_cut(train, validation, test)
    part = F.when(draw < F.lit(train), "train").when(draw < F.lit(second), "validation").otherwise("test")
    return with_seeds(df, seeds).withColumn("part", part)


def split_counts(split: DataFrame, target: str) -> DataFrame:
    return split.groupBy("seed", F.col(target).cast("string").alias("label"), "part").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
