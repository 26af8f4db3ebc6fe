"""Texts of insights: what is, what it signals, what to do.

The three texts are composed by one pattern each from the insight's own
columns: its code and figures, its signals, and its action with what it is
about. ``VIEWS`` says which columns those are; a column that is NULL is left
out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions import number_text
from martlens.operators.period import ALL, Period


@dataclass(frozen=True)
class View:
    """Columns of an insight's texts. Figures are written ``column:style``; a
    style is the number of decimals, ``m`` for money, or nothing for text."""

    subject: str
    figures: str
    signals: str
    about: str
    action: str = "status"


VIEWS: dict[str, View] = {
    "revenue": View(
        "revenue", "last_label last_revenue:m max_label max_revenue:m min_label min_revenue:m",
        "trend outlook", "min_label",
    ),
    "payment": View(
        "payment methods", "top_method top_count:0 top_share:1 second_method", "status", "top_method"
    ),
    "top_items_product": View(
        "products", "top_label top_qty:0 top_share:1 second_label gap:1", "race", "top_label"
    ),
    "top_items_category": View(
        "categories", "top_label top_qty:0 top_share:1 second_label gap:1", "race", "top_label"
    ),
    "state": View("states", "top_label top_value:0 gap:1", "race", "top_label", "action"),
    "customer": View("customers", "top_label top_value:m gap:1", "race", "top_label", "action"),
    "seller_qty": View(
        "sellers by quantity", "top_label top_value:0 gap:1", "race", "top_label", "action"
    ),
    "seller_revenue": View(
        "sellers by revenue", "top_label top_value:m gap:1", "race", "top_label", "action"
    ),
    "delivery_state": View(
        "delivery by state", "max_label max_days:2 min_label min_days:2", "status", "max_label", "action"
    ),
    "delivery_category": View(
        "delivery by category", "max_label max_days:2 min_label min_days:2", "status", "max_label",
        "action",
    ),
    "rating_year": View(
        "rating by year", "mean_rating:2 best_label best_rating:2 worst_label worst_rating:2",
        "status", "worst_label", "action",
    ),
    "rating_month": View(
        "rating by month", "best_label best_rating:2 worst_label worst_rating:2", "status",
        "worst_label", "action",
    ),
}


def period_name(p: Period) -> str:
    """The filter as ``1997-03``, ``1997``, ``month 03`` or ``all dates``."""
    if p.year and p.month:
        return f"{p.year}-{p.month:02d}"
    if p.year:
        return str(p.year)
    return f"month {p.month:02d}" if p.month else "all dates"


def _named(figure: str) -> Column:
    name, _, style = figure.partition(":")
    value = F.col(name)
    if style == "m":
        value = F.concat(F.lit("R$ "), number_text(value, 2))
    elif style:
        value = number_text(value, int(style))
    return F.concat(F.lit(name.replace("_", " ") + " "), value.cast("string"))


def _listed(*parts: Column) -> Column:
    return F.concat_ws("; ", *parts)


def with_text(found: DataFrame, kind: str, p: Period = ALL, by: str = "") -> DataFrame:
    """Add now_text, next_text and action_text to the row of an insight.

    ``by`` is the dimension of the best sellers or the metric of the sellers.
    Where nothing was found, only the first text says so.
    """
    view = VIEWS[f"{kind}_{by}" if by else kind]
    head = F.lit(f"{view.subject}, {period_name(p)}: ")
    some = F.col("status") != "none"
    signals = _listed(*[F.concat(F.lit(f"{s} "), F.col(s)) for s in view.signals.split()])
    action = F.concat_ws(": ", F.col(view.action), F.col(view.about).cast("string"))
    return found.withColumns(
        {
            "now_text": F.concat(head, _listed(F.col("status"), *map(_named, view.figures.split()))),
            "next_text": F.when(some, F.concat(head, signals)).otherwise(""),
            "action_text": F.when(some, action).otherwise(""),
        }
    )
