"""Exact medians without gathering a column in one task.

The built-in exact median merges all distinct values of a column into one
aggregation buffer. Here that is used only up to a row limit. Beyond it each
wanted rank is enclosed between two approximate quantiles, the rows below and
inside are counted, and the bracket shrinks by about a factor of 1000 per
round until what is inside fits. All columns share each round's scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

IN_TASK_ROWS = 200_000
# All columns of one aggregation meet in one task, so their values together are bounded, too.
TOGETHER = 4 * IN_TASK_ROWS
_HALF_WIDTH = 5e-4
_SKETCH_ACCURACY = 10_000


@dataclass
class _Bracket:
    """Rank ``rank`` (1-based) among values strictly between low and high."""

    value: Column
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None

    def inner(self) -> Column:
        kept = self.value
        if self.low is not None:
            kept = F.when(self.value > F.lit(self.low), kept)
        if self.high is not None:
            kept = F.when(self.value < F.lit(self.high), kept)
        return kept


def number(column: str) -> Column:
    """The column as double, NaN as null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _batches(sizes: Mapping[str, int]) -> Iterator[list[str]]:
    """Names in groups of at most TOGETHER values, or single."""
    batch, total = [], 0
    for name, size in sizes.items():
        if batch and total + size > TOGETHER:
            yield batch
            batch, total = [], 0
        batch.append(name)
        total += size
    if batch:
        yield batch


def ranked_values(df: DataFrame, targets: dict[str, tuple[Column, int, int]], limit: int = IN_TASK_ROWS) -> dict:
    """{name: (value, rank, non-null count)} -> {name: the exact rank-th smallest value}."""
    open_ = {name: _Bracket(value, rank, count) for name, (value, rank, count) in targets.items()}
    answers: dict[str, float] = {}
    while open_:
        last = {n: b for n, b in open_.items() if b.inside <= limit}
        for names in _batches({n: b.inside for n, b in last.items()}):
            row = df.agg(*[
                F.element_at(F.sort_array(F.collect_list(last[n].inner())), F.lit(last[n].rank)).alias(n) for n in names
            ]).first()
            answers.update({n: float(row[n]) for n in names})
        open_ = {n: b for n, b in open_.items() if n not in last}
        if not open_:
            break
        guesses = {}
        for n, b in open_.items():
            centre = b.rank / b.inside
            guesses[n] = [max(0.0, centre - _HALF_WIDTH), min(1.0, centre + _HALF_WIDTH)]
        row = df.agg(*[
            F.percentile_approx(b.inner(), guesses[n], _SKETCH_ACCURACY).alias(n) for n, b in open_.items()
        ]).first()
        ends = {n: (float(row[n][0]), float(row[n][1])) for n in open_}
        counts = []
        for n, b in open_.items():
            lo, hi = (F.lit(x) for x in ends[n])
            v = b.inner()
            counts += [
                F.count_if(v < lo).alias(f"{n}:below"), F.count_if(v == lo).alias(f"{n}:low"),
                F.count_if((v > lo) & (v < hi)).alias(f"{n}:mid"),
                F.count_if((v == hi) & (v > lo)).alias(f"{n}:high"),
            ]
        row = df.agg(*counts).first()
        remaining = {}
        for n, b in open_.items():
            lo, hi = ends[n]
            below, at_lo, mid, at_hi = (row[f"{n}:{part}"] for part in ("below", "low", "mid", "high"))
            if b.rank <= below:
                remaining[n] = _Bracket(b.value, b.rank, below, b.low, lo)
            elif b.rank <= below + at_lo:
                answers[n] = lo
            elif b.rank <= below + at_lo + mid:
                remaining[n] = _Bracket(b.value, b.rank - below - at_lo, mid, lo, hi)
            elif b.rank <= below + at_lo + mid + at_hi:
                answers[n] = hi
            else:
                passed = below + at_lo + mid + at_hi
                remaining[n] = _Bracket(b.value, b.rank - passed, b.inside - passed, hi, b.high)
        open_ = remaining
    return answers


def exact_medians(
    df: DataFrame, columns: Sequence[str], limit: int = IN_TASK_ROWS, counted: Mapping[str, int] | None = None
) -> dict[str, float | None]:
    """Exact interpolating median per column; None where no value is present.

    ``counted``: the columns' numbers of values, if they are known already.
    """
    columns = list(columns)
    if not columns:
        return {}
    if counted is None:
        counted = df.agg(*[F.count(number(c)).alias(c) for c in columns]).first()
    medians: dict[str, float | None] = {c: None for c in columns}
    small = [c for c in columns if 0 < counted[c] <= limit]
    for names in _batches({c: counted[c] for c in small}):
        row = df.agg(*[F.median(number(c)).alias(c) for c in names]).first()
        medians.update({c: float(row[c]) for c in names})
    targets = {}
    for c in columns:
        n = counted[c]
        if n > limit:
            targets[f"{c}:a"] = (number(c), (n + 1) // 2, n)
            if n % 2 == 0:
                targets[f"{c}:b"] = (number(c), n // 2 + 1, n)
    if targets:
        values = ranked_values(df, targets, limit)
        for c in columns:
            if counted[c] > limit:
                a = values[f"{c}:a"]
                medians[c] = (a + values.get(f"{c}:b", a)) / 2.0
    return medians
