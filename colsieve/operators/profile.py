"""Column work on labelled tables: kinds, coercion, cleaning, descriptions, profiles.

Each operator is one aggregation over all columns, never one job per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colsieve.functions.scores import decimal_number

COERCE_SHARE = 0.95
MISSING_TEXT = "nan"
EXAMPLES = 4
EXAMPLE_CHARS = 60
# The first rows looked at for examples; columns with too few values there share further passes.
EXAMPLE_ROWS = 64


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the columns that are there."""
    return df.drop(*columns)


def require_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"column '{column}' is not in the table")


def feature_names(df: DataFrame, target: str, row_id: str | None = None) -> list[str]:
    """All columns but the target and the row id."""
    require_column(df, target)
    return [c for c in df.columns if c not in (target, row_id)]


def split_target(df: DataFrame, target: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, features...) and (row_id, target)."""
    features = feature_names(df, target, row_id)
    return df.select(row_id, *features), df.select(row_id, target)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def column_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric (booleans count) and categorical columns, in table order."""
    wanted = set(columns if columns is not None else df.columns)
    numeric = [f.name for f in df.schema if f.name in wanted and is_numeric(f.dataType)]
    return numeric, [c for c in df.columns if c in wanted and c not in numeric]


def kind_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kind and number of values of each column."""
    numeric, _ = column_kinds(df, columns)
    counted = df.agg(*[F.count(c).alias(c) for c in columns])
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit("numeric" if c in numeric else "categorical").alias("kind"),
            F.col(c).alias("n_values"),
        )
        for c in columns
    ]
    return counted.select(F.inline(F.array(*entries)))


def _text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    wanted = set(columns)
    return [f.name for f in df.schema if f.name in wanted and isinstance(f.dataType, T.StringType)]


def parsed_number(column: str) -> Column:
    """Text as a number; text that is no decimal number, and 'nan', is null."""
    value = decimal_number(F.trim(F.col(column)))
    return F.when(~F.isnan(value), value)


def coerce_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of all rows whose text parses as a number, for each text column."""
    text = _text_columns(df, columns)
    rates = df.agg(*[F.avg(parsed_number(c).isNotNull().cast("double")).alias(c) for c in text])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("numeric_share")) for c in text]
    return rates.select(F.inline(F.array(*entries))).withColumn(
        "becomes_numeric", F.coalesce(F.col("numeric_share") > COERCE_SHARE, F.lit(False))
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of which strictly more than 95 % of all rows parse become double."""
    if not _text_columns(df, columns):
        return df
    chosen = {r["feature"] for r in coerce_rates(df, columns).where("becomes_numeric").collect()}
    return df.withColumns({c: parsed_number(c) for c in df.columns if c in chosen})


def describe_columns(names: DataFrame, texts: Mapping[str, str], leaks: DataFrame | None = None) -> DataFrame:
    """One description per (dataset, feature): leak metadata, then given text, then the name in words."""
    given = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]) if texts else None
    own = F.replace(F.col("feature"), F.lit("_"), F.lit(" "))
    if given is not None:
        own = F.coalesce(F.element_at(given, F.col("feature")), own)
    if leaks is None:
        return names.withColumn("description", own).withColumn("is_injected_leakage", F.lit(False))
    told = leaks.withColumnRenamed("description", "_leak_text")
    return names.join(told, ["dataset", "feature"], "left").withColumns({
        "description": F.coalesce(F.when(F.col("is_injected_leakage"), F.col("_leak_text")), own),
        "is_injected_leakage": F.coalesce(F.col("is_injected_leakage"), F.lit(False)),
    }).drop("_leak_text")


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def class_count(df: DataFrame, target: str) -> DataFrame:
    """Number of classes and whether there are enough to learn from."""
    counted = df.agg(F.count_distinct(F.col(target).cast("string")).cast("long").alias("n_classes"))
    return counted.withColumn("enough", F.col("n_classes") >= 2)


def require_two_classes(df: DataFrame, target: str) -> None:
    """Two classes exist if the least and greatest label differ; no distinct count is needed."""
    label = F.col(target).cast("string")
    ends = df.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    if ends["low"] is None:
        raise ValueError("no rows are left after dropping rows without a target")
    if ends["low"] == ends["high"]:
        raise ValueError("the target needs at least two classes")


def class_list(df: DataFrame, target: str) -> DataFrame:
    """The classes as text, one row each, in order."""
    return df.select(F.col(target).cast("string").alias("class")).distinct().orderBy("class")


def constant_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns hold no value or only one. Null counts as one more value.

    A column is constant if its least and greatest text agree, so one pass with
    small buffers does; no distinct values are shuffled.
    """
    stats = []
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT))
        stats += [F.count(c).alias(f"{c}:n"), F.min(text).alias(f"{c}:low"), F.max(text).alias(f"{c}:high")]
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"`{c}:n`").alias("n_values"),
            ((F.col(f"`{c}:n`") > 0) & (F.col(f"`{c}:low`") != F.col(f"`{c}:high`"))).alias("kept"),
        )
        for c in columns
    ]
    return df.agg(*stats).select(F.inline(F.array(*entries)))


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return df
    useless = [r["feature"] for r in constant_report(df, columns).where(~F.col("kept")).collect()]
    return df.drop(*useless)


def _examples(df: DataFrame, columns: Sequence[str], row_id: str) -> dict[str, list[str]]:
    """First non-null values by row id, cut to 60 characters.

    A sort with limit keeps a few rows per task. The columns with too few values in the first rows then share at most
    EXAMPLES passes over the table: each takes every column's next value above the row it is at.
    """
    def text(c: str) -> Column:
        return F.substring(F.col(c).cast("string"), 1, EXAMPLE_CHARS)

    first = df.select(row_id, *columns).orderBy(row_id).limit(EXAMPLE_ROWS).select(
        F.col(row_id).alias("_row"), *[text(c).alias(c) for c in columns]
    ).orderBy("_row").collect()
    found = {c: [r[c] for r in first if r[c] is not None][:EXAMPLES] for c in columns}
    sparse = [c for c in columns if len(found[c]) < EXAMPLES] if len(first) == EXAMPLE_ROWS else []
    at: dict[str, object] = {}
    for c in sparse:
        found[c] = []
    while sparse:
        stats = []
        for i, c in enumerate(sparse):
            later = F.col(c).isNotNull() & (F.col(row_id) > F.lit(at[c]) if c in at else F.lit(True))
            row = F.when(later, F.col(row_id))
            stats += [F.min(row).alias(f"r{i}"), F.min_by(text(c), row).alias(f"v{i}")]
        got = df.agg(*stats).first()
        for i, c in enumerate(sparse):
            if got[f"r{i}"] is not None:
                at[c] = got[f"r{i}"]
                found[c].append(got[f"v{i}"])
        sparse = [c for i, c in enumerate(sparse) if got[f"r{i}"] is not None and len(found[c]) < EXAMPLES]
    return found


def profile(
    df: DataFrame,
    columns: Sequence[str],
    row_id: str,
    stat_scores: DataFrame | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Type, missing share, distinct values, first examples and statistical score of each column.

    The exact distinct counts shuffle the distinct values of every column once;
    ``approximate`` replaces them by sketches.
    """
    columns = list(columns)
    types = dict(df.select(*columns).dtypes)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    stats = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        stats += [F.count(c).alias(f"{c}:n"), distinct(F.col(c)).alias(f"{c}:d")]
    examples = _examples(df, columns, row_id)
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(types[c]).alias("dtype"),
            F.round(1 - F.col(f"`{c}:n`") / F.col("_rows"), 4).alias("missing_ratio"),
            F.col(f"`{c}:d`").cast("long").alias("unique_values"),
            F.array(*[F.lit(x) for x in examples[c]]).cast("array<string>").alias("examples"),
        )
        for c in columns
    ]
    table = df.agg(*stats).select(F.inline(F.array(*entries)))
    if stat_scores is None:
        return table.withColumn("stat_score", F.lit(0.0))
    scores = stat_scores.select("feature", F.col("stat_score").alias("_score"))
    return table.join(scores, "feature", "left").withColumn(
        "stat_score", F.round(F.coalesce(F.col("_score"), F.lit(0.0)), 6)
    ).drop("_score")
