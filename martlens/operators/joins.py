"""Joins between facts and dimensions.

A dimension is met by a fact already summed per foreign key, so that a product
holding a third of all sales is one row per map task when it is shuffled and one
row when joined. The join carries no hint: adaptive execution broadcasts the
dimension, or the sums, where their size at run time allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(fact: DataFrame, key: str, **measures: tuple[str, str]) -> DataFrame:
    """One row per ``key``; ``measures`` maps a name to ``(kind, column)``."""
    return fact.groupBy(key).agg(
        *[_first_pass(kind, column).alias(name) for name, (kind, column) in measures.items()]
    )


def _first_pass(kind: str, column: str) -> Column:
    if kind == "sum":
        return F.sum(column)
    return F.count(F.lit(1) if column == "*" else F.col(column))


def totals_by_label(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    label: Column,
    how: str = "inner",
    **measures: tuple[str, str],
) -> DataFrame:
    """Sums and counts of a fact per attribute of a dimension.

    ``label`` may use any column of ``dim`` and the key. NULL labels form a
    group of their own. With ``how='left'`` facts without a dimension row stay.
    """
    joined = per_key(fact, key, **measures).join(dim, key, how)
    return joined.groupBy(label.alias("label")).agg(*[F.sum(name).alias(name) for name in measures])


def translate_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Left-join products to their English category; a miss leaves NULL."""
    return products.join(translation, "product_category_name", "left")
