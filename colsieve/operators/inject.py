"""Known leaks: graded noisy copies of the target, and their masking at deployment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colsieve.functions.hashing import normal01, u01
from colsieve.operators.profile import is_numeric
from colsieve.plans.order_stats import exact_medians
from colsieve.plans.settle import match


class Leak(NamedTuple):
    name: str
    kind: str
    level: str
    representation: str
    description: str


# Fixed values from here to the jitter: names, kinds, levels and order decide
# which columns count as leaks, the codes and rates what they show. The
# descriptions are our own.
LEAKS = (
    Leak("final_outcome_flag", "obvious", "strong", "binary", "Flag set once the outcome has happened."),
    Leak("post_decision_status", "obvious", "strong", "categorical", "Status written after the decision was made."),
    Leak("risk_review_code", "disguised", "strong", "categorical", "Code given when the review of a case ends."),
    Leak("confirmed_result_code", "obvious", "moderate", "categorical", "Result group from a partly checked outcome."),
    Leak("case_resolution_type", "disguised", "moderate", "categorical", "Way in which a case was about to be closed."),
    Leak("followup_action_group", "disguised", "moderate", "categorical", "Group of actions taken later on the case."),
    Leak("outcome_verification_score", "obvious", "moderate", "continuous", "Score from evidence found afterwards."),
    Leak("workflow_bucket_id", "disguised", "weak", "categorical", "Bucket of late steps in handling the case."),
    Leak("service_path_code", "disguised", "weak", "categorical", "Code of the route the case took in operations."),
    Leak("review_priority_index", "disguised", "weak", "continuous", "Priority that changes while a case is open."),
)
NOISE_BY_LEVEL = {"strong": 0.02, "moderate": 0.15, "weak": 0.35}
LEVEL_COUNTS = {"strong": 3, "moderate": 4, "weak": 3}
NEGATIVE_CODES = ("A12", "pending", "route_c", "type_1", "group_n")
POSITIVE_CODES = ("B07", "closed", "route_f", "type_4", "group_x")
UNAVAILABLE = "__UNAVAILABLE_AT_PREDICTION__"
JITTER_BASE, JITTER_PER_NOISE = 0.08, 0.35


def leak_names(count: int = len(LEAKS)) -> list[str]:
    return [leak.name for leak in LEAKS[:count]]


def noise_rates(noise: Mapping[str, float] | None = None) -> dict[str, float]:
    rates = {**NOISE_BY_LEVEL, **(noise or {})}
    for level in NOISE_BY_LEVEL:
        if not 0.0 <= float(rates[level]) < 0.5:
            raise ValueError(f"noise of level '{level}' must be at least 0 and below 0.5")
    return rates


def require_count(count: int) -> None:
    if not 1 <= count <= len(LEAKS):
        raise ValueError(f"between 1 and {len(LEAKS)} leaks can be injected, not {count}")


def refusals(columns: DataFrame, settings: DataFrame, by: str = "dataset", column: str = "feature") -> DataFrame:
    """What is wrong with wanted injections, one row per setting: (``by``, n_leaks, noise_rate, refused_count, refused_rate, clashes).

    ``settings`` holds ``by``, n_leaks and noise_rate, ``columns`` the columns of the tables, one a row. The rules are those of
    ``inject_leaks``, for many tables at once: a count between 1 and all leaks, a rate of at least 0 and below 0.5, and no column
    that is named like a leak to be injected; ``clashes`` lists these by name. A null count or rate is refused. Only columns
    named like leaks are shuffled.
    """
    place = F.array_position(F.array(*[F.lit(name) for name in leak_names()]), F.col(column)).cast("int")
    named = columns.select(by, F.col(column).alias("_name"), place.alias("_place")).where("_place > 0").distinct()
    taken = named.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_name", "_place"))).alias("_taken"))
    count, rate = F.col("n_leaks"), F.col("noise_rate")
    refused = F.filter("_taken", lambda t: t["_place"] <= count)
    return match(settings, taken, [by], "left").select(
        by, "n_leaks", "noise_rate",
        (~F.coalesce(count.between(1, len(LEAKS)), F.lit(False))).alias("refused_count"),
        (~F.coalesce((rate >= 0.0) & (rate < 0.5), F.lit(False))).alias("refused_rate"),
        F.coalesce(F.array_join(F.transform(refused, lambda t: t["_name"]), ","), F.lit("")).alias("clashes"),
    )


def require_fixed_profile(count: int = len(LEAKS), level_counts: Mapping[str, int] | None = None) -> None:
    """Snapshots always carry all leaks, so that runs stay comparable."""
    if count != len(LEAKS):
        raise ValueError(f"a snapshot needs exactly {len(LEAKS)} leaks")
    if level_counts is not None and dict(level_counts) != LEVEL_COUNTS:
        raise ValueError(f"a snapshot needs the level counts {LEVEL_COUNTS}")


def leak_catalog(spark: SparkSession, noise: Mapping[str, float] | None = None) -> DataFrame:
    rates = noise_rates(noise)
    rows = [
        (i, leak.name, leak.kind, leak.level, leak.representation, leak.description, rates[leak.level])
        for i, leak in enumerate(LEAKS)
    ]
    names = "position int, feature string, leakage_type string, leakage_level string, representation string"
    return spark.createDataFrame(rows, f"{names}, description string, noise_rate double")


def noisy_bit(bit: Column, row_id: str, leak: Leak, rate: float, seed: int) -> Column:
    """The target bit, flipped where the row's draw is below the noise rate."""
    flips = u01(seed, leak.name, F.col(row_id)) < F.lit(float(rate))
    return F.when(flips, 1 - bit).otherwise(bit)


def _shown(copied: Column, leak: Leak, position: int, rate: float, row_id: str, seed: int) -> Column:
    if leak.representation == "binary":
        return copied.cast("int")
    if leak.representation == "categorical":
        pair = position % len(POSITIVE_CODES)
        return F.when(copied == 1, POSITIVE_CODES[pair]).otherwise(NEGATIVE_CODES[pair])
    jitter = normal01(seed, leak.name, F.col(row_id)) * F.lit(JITTER_BASE + JITTER_PER_NOISE * rate)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), copied + jitter))


def inject_leaks(
    df: DataFrame,
    bit: Column,
    row_id: str,
    seed: int = 42,
    noise: Mapping[str, float] | None = None,
    count: int = len(LEAKS),
) -> DataFrame:
    """Add the first ``count`` leaks. One narrow projection: no shuffle, no second read.

    The draws are hashes of (seed, leak, row id). They agree in distribution with
    draws of other generators, not value by value.
    """
    require_count(count)
    rates = noise_rates(noise)
    clash = sorted(set(leak_names(count)) & set(df.columns))
    if clash:
        raise ValueError(f"the table already has columns named like leaks: {clash}")
    added = {}
    for position, leak in enumerate(LEAKS[:count]):
        rate = rates[leak.level]
        added[leak.name] = _shown(noisy_bit(bit, row_id, leak, rate, seed), leak, position, rate, row_id, seed)
    return df.withColumns(added)


def leak_agreement(
    df: DataFrame,
    bit: Column,
    row_id: str,
    seed: int = 42,
    noise: Mapping[str, float] | None = None,
    count: int = len(LEAKS),
) -> DataFrame:
    """Facts of each leak with the observed share of rows where it equals the target bit."""
    require_count(count)
    rates = noise_rates(noise)
    chosen = LEAKS[:count]
    observed = df.agg(*[
        F.avg((noisy_bit(bit, row_id, leak, rates[leak.level], seed) == bit).cast("double")).alias(leak.name)
        for leak in chosen
    ])
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(leak.name).alias("feature"),
            F.lit(True).alias("is_injected_leakage"),
            F.lit(leak.kind).alias("leakage_type"),
            F.lit(leak.level).alias("leakage_level"),
            F.lit(float(rates[leak.level])).alias("noise_rate"),
            F.lit(1.0 - rates[leak.level]).alias("expected_target_agreement"),
            F.col(leak.name).alias("observed_target_agreement"),
            F.lit(leak.representation).alias("representation"),
            F.lit(leak.description).alias("description"),
        )
        for position, leak in enumerate(chosen)
    ]
    return observed.select(F.inline(F.array(*entries)))


def agreement_by_level(agreement: DataFrame) -> DataFrame:
    return agreement.groupBy("leakage_level").agg(
        F.avg("observed_target_agreement").alias("mean_agreement"), F.count(F.lit(1)).alias("n_leaks")
    )


def mask_values(reference: DataFrame, leaks: Sequence[str]) -> dict[str, float | str | None]:
    """What each leak shows before it is known: its median in the reference rows, or a marker text."""
    present = [c for c in leaks if c in reference.columns]
    medians = exact_medians(reference, [c for c in present if is_numeric(reference.schema[c].dataType)])
    return {c: medians.get(c, UNAVAILABLE) for c in present}


def apply_mask(df: DataFrame, values: Mapping[str, float | str | None]) -> DataFrame:
    masked = {
        c: F.lit(v).cast("double" if is_numeric(df.schema[c].dataType) else "string")
        for c, v in values.items() if c in df.columns
    }
    return df.withColumns(masked) if masked else df


def mask_leaks(df: DataFrame, leaks: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """The table as it looks when the leaks are not yet known.

    Numeric leaks become the train median of the leak itself, others a marker
    text. Leaks that are not in the table are skipped.
    """
    return apply_mask(df, mask_values(df if train is None else train, leaks))
