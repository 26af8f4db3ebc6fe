"""Ordering, top-k, positions and extremes.

Windows without a partition appear only here and over one row per task: over rows
that a limit or the calendar has already bounded. ``ranked`` numbers any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.operators.numbering import numbered, tagged
from martlens.session import stored_copy


def highest_first(measure: str, label: str = "label", nulls: str = "first") -> list[Column]:
    """Descending measure, then ascending label as the tie-breaker.

    SQL ordering puts NULL measures first; ``nulls='last'`` is for rankings
    made outside SQL.
    """
    value = F.col(measure)
    down = value.desc_nulls_first() if nulls == "first" else value.desc_nulls_last()
    return [down, F.col(label).asc_nulls_last()]


def top_k(
    df: DataFrame, measure: str, k: int, label: str = "label", nulls: str = "first"
) -> DataFrame:
    """The ``k`` highest rows with their position 1..k."""
    order = highest_first(measure, label, nulls)
    return positioned(df.orderBy(*order).limit(k), order)


def positioned(bounded: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Number the rows of an already bounded result."""
    return bounded.select(F.row_number().over(Window.orderBy(*order)).alias(name), "*")


def ranked(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Number all rows of a result of any size, 1 for the first in ``order``.

    Rows are dealt by ranges of the order and sorted within them; a row's
    number is its place in its range plus the rows of the ranges before, so no
    task sees more than its range. The sorted rows are written to the shared
    folder at once. ``order`` has to be total, as a tie has no fixed winner.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = stored_copy(tagged(dealt, "_place"), "ranked")
    return numbered(stored, "_place", name, 1).select(name, *df.columns)


def tier(position: Column) -> Column:
    """Gold for places 1-3, Silver for 4-6, Bronze below."""
    return F.when(position <= 3, "Gold").when(position <= 6, "Silver").otherwise("Bronze")


def at(position: int, value: str, name: str = "pos") -> Column:
    """Aggregate: ``value`` of the row at ``position``; NULL if there is none."""
    return F.max(F.when(F.col(name) == position, F.col(value)))


def first_extreme(value: str, label: str, largest: bool) -> Column:
    """Aggregate: label and value of the largest or smallest row.

    Of equal values the one shown first wins: results are ordered by
    descending value and then label, so that is the lowest label, NULL last.
    Partial aggregation does the work, so the input may be of any size.
    """
    rank = -F.col(value) if largest else F.col(value)
    return F.min(
        F.struct(
            rank.alias("rank"),
            F.col(label).isNull().alias("unlabelled"),
            F.col(label).alias("label"),
            F.col(value).alias("value"),
        )
    )


def gap_percent(first: Column, second: Column) -> Column:
    """How far ``first`` leads ``second``, in percent of ``second``."""
    lead = (first - second).cast("double") / second.cast("double") * 100
    return F.when(second > 0, lead)


def share_percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; zero when there is nothing."""
    share = part.cast("double") / whole.cast("double") * 100
    return F.when(whole > 0, share).otherwise(F.lit(0.0))


def root_scale(value: Column, low: Column, high: Column) -> Column:
    """Square root of the min-max position in [0, 1]; equal bounds sit at 0.5."""
    span = (high - low).cast("double")
    place = (value - low).cast("double") / span
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), place))
    return F.sqrt(F.when(high == low, F.lit(0.5)).otherwise(clamped))
