"""Column expressions; all are built-in functions and stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two timestamps, not calendar days."""
    return F.extract(F.lit("DAY"), end - start).cast("int")


def as_double(value: Column) -> Column:
    """Exact sums leave the engine as doubles."""
    return value.cast("double")


def _exact_ratio(numerator: Column, denominator: Column) -> Column:
    # 18 fractional digits: enough that rounding the quotient again cannot
    # cross a tie for any count below 10^15. A zero denominator gives NULL.
    wide = "decimal(20,0)"
    return F.try_divide(numerator.cast(wide), denominator.cast(wide))


def mean_rounded(total: Column, n: Column, places: int = 2) -> Column:
    """``total / n`` rounded half away from zero, for integer totals."""
    return F.round(_exact_ratio(total, n), places)


def percent_rounded(part: Column, whole: Column, places: int = 1) -> Column:
    """``part`` as a percentage of ``whole``, rounded, for integer inputs."""
    return F.round(_exact_ratio(part * 100, whole), places)


def non_blank(value: Column) -> Column:
    """Neither NULL nor the empty string; padding counts as content."""
    return value.isNotNull() & (value != "")


def concat_parts(*parts: Column) -> Column:
    """Concatenation that skips NULL parts instead of returning NULL."""
    return F.concat(*[F.coalesce(part.cast("string"), F.lit("")) for part in parts])


def zero_padded(value: Column, width: int = 2) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def year_month_label(year: Column, month: Column) -> Column:
    return concat_parts(year, F.lit("-"), zero_padded(month))


def day_label(day: Column) -> Column:
    """``5 Jan``: day without padding, short English month."""
    return F.date_format(day, "d MMM")


def number_text(value: Column, places: int = 0) -> Column:
    """``1.234.567,89``: dots between thousands, comma before decimals."""
    return F.translate(F.format_number(F.round(value, places), places), ",.", ".,")


def short_label(label: Column, longest: int) -> Column:
    """Labels over ``longest`` characters lose their tail to an ellipsis."""
    cut = F.concat(F.substring(label, 1, longest - 2), F.lit("…"))
    return F.when(F.length(label) > longest, cut).otherwise(label)


def half_up(value: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(value + 0.5).cast("int")


def ratio_class(ratio: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first cut that ``ratio`` reaches, highest cut first."""
    ordered = sorted(cuts, reverse=True)
    chosen = F.when(ratio >= ordered[0][0], ordered[0][1])
    for cut, name in ordered[1:]:
        chosen = chosen.when(ratio >= cut, name)
    return chosen.otherwise(otherwise)
