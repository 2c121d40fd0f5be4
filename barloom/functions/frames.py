"""Window specifications and window expressions.

All panel windows share one specification, ``partitionBy(ticker).orderBy(date)``. A panel holds at
most one row per ticker and calendar day, so a window partition is bounded by the calendar and not
by the size of the data: raw rows of a hot ticker have been aggregated per day before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def so_far(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_ticker()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_now(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_ticker()).rowsBetween(Window.unboundedPreceding, -1)


def whole(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_ticker()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def ratio(num: Column, den: Column) -> Column:
    """Division under the null policy: a zero or null divisor gives null."""
    return F.try_divide(num, den)


def change(now: Column, then: Column) -> Column:
    return ratio(now, then) - 1.0


def ffill(value: Column | str, spec: WindowSpec | None = None) -> Column:
    return F.last(value, ignorenulls=True).over(so_far(spec))


def ffill_bfill(value: Column | str) -> Column:
    """Forward fill, leading nulls taken from the first known value of the ticker.

    The backward fill reads the whole-partition frame once instead of a following frame per row,
    which would be quadratic in the history.
    """
    return F.coalesce(ffill(value), F.first(value, ignorenulls=True).over(whole()))


#: How the names of earlier values begin that a level makes for itself alone.
BACK = "_back_"


def levels(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Add columns level by level; a level may read only the columns of the levels before it.

    All window expressions of one level share one Window operator, and all levels share one
    exchange and one sort because they use the same specification. Columns of a level whose names begin with
    ``BACK`` are made first, once each, and dropped after it.
    """
    for step in steps:
        backs = {name: value for name, value in step.items() if name.startswith(BACK)}
        for part in (backs, {name: value for name, value in step.items() if name not in backs}):
            if part:
                df = df.withColumns(part)
        df = df.drop(*backs)
    return df


def packed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The columns as fields of one struct, which a window level carries as a single value."""
    return df.withColumn(name, F.struct(*columns)).drop(*columns)


def merged(*features: list[dict[str, Column]]) -> list[dict[str, Column]]:
    """Level lists of several features, level by level in one list."""
    steps: list[dict[str, Column]] = []
    for feature in features:
        for depth, step in enumerate(feature):
            if depth == len(steps):
                steps.append({})
            steps[depth] = steps[depth] | step
    return steps
