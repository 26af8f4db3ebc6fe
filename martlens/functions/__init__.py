"""Scalar expressions used by the operators and plans."""

from martlens.functions.scalars import (
    as_double,
    concat_parts,
    day_label,
    elapsed_days,
    half_up,
    mean_rounded,
    non_blank,
    number_text,
    percent_rounded,
    ratio_class,
    short_label,
    year_month_label,
    zero_padded,
)

__all__ = [
    "as_double",
    "concat_parts",
    "day_label",
    "elapsed_days",
    "half_up",
    "mean_rounded",
    "non_blank",
    "number_text",
    "percent_rounded",
    "ratio_class",
    "short_label",
    "year_month_label",
    "zero_padded",
]
