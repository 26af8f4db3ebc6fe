"""Compare the two sides of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from martlens.model import Mart, Normalized
from martlens.plans.pairs import PAIRS, Pair
from martlens.plans.panels import FAILURES
from martlens.plans.shared import shared_cells
from martlens.sources.literals import literal_table

#: Holds every exact measure: cents of any amount, and any count.
_PLACES = 4
_EXACT = f"decimal(38,{_PLACES})"


def _tall(side: DataFrame, pair: Pair, name: str) -> DataFrame:
    """One row per key and measure, tagged with the side it came from."""
    key = F.to_json(
        F.struct(F.lit(pair.name).alias("pair"), *pair.keys), {"ignoreNullFields": "false"}
    )
    kinds = dict(side.dtypes)
    for measure in pair.measures:
        kind = side.schema[measure].dataType
        if isinstance(kind, DecimalType) and kind.scale > _PLACES:
            raise ValueError(f"{pair.name}: {measure} has more than {_PLACES} decimal places")

    def cell(measure: str) -> Column:
        value, inexact = F.col(measure), kinds[measure] in ("double", "float")
        return F.struct(
            F.lit(measure).alias("measure"),
            (F.lit(None) if inexact else value).cast(_EXACT).alias("exact"),
            value.cast("double").alias("value"),
        )

    cells = F.explode(F.array(*map(cell, pair.measures)))
    return side.select(key.alias("key"), cells.alias("cell")).select(
        "key", "cell.measure", "cell.exact", "cell.value", F.lit(name).alias("side")
    )


def _aligned(both: DataFrame, *by: str) -> DataFrame:
    """Pair up the cells of two sides by key; a key on one side only is kept.

    Grouping the union does the work of a full outer null-safe join in one
    shuffle of the two aggregated results.
    """

    def of(side: str, value):
        return F.max(F.when(F.col("side") == side, value))

    return both.groupBy(*by).agg(
        F.coalesce(of("normalized", F.lit(True)), F.lit(False)).alias("in_normalized"),
        F.coalesce(of("star", F.lit(True)), F.lit(False)).alias("in_star"),
        of("normalized", F.col("value")).alias("normalized"),
        of("star", F.col("value")).alias("star"),
        of("normalized", F.col("exact")).alias("normalized_exact"),
        of("star", F.col("exact")).alias("star_exact"),
    )


def align(left: DataFrame, right: DataFrame, pair: Pair) -> DataFrame:
    """The cells of both results of a pair side by side."""
    both = _tall(left, pair, "normalized").unionByName(_tall(right, pair, "star"))
    return _aligned(both, "key", "measure")


def _compared() -> dict[str, Column]:
    exact = F.col("normalized_exact") - F.col("star_exact")
    apart = F.coalesce(F.abs(exact).cast("double"), F.abs(F.col("normalized") - F.col("star")))
    same = (
        F.col("in_normalized")
        & F.col("in_star")
        & F.col("normalized").eqNullSafe(F.col("star"))
        & F.coalesce(exact == 0, F.lit(True))
    )
    return {"delta": apart, "match": same}


def reconcile(pair: Pair, n: Normalized, m: Mart) -> DataFrame:
    """Both values, their distance and whether they agree, per key and measure.

    Counts and money are compared as exact decimals; the doubles shown are
    made from them at the end. Means, which are doubles, are compared as such.
    """
    aligned = align(pair.normalized(n), pair.star(m), pair)
    return aligned.withColumns(_compared()).select(
        F.lit(pair.name).alias("pair"),
        "key",
        "measure",
        "in_normalized",
        "in_star",
        "normalized",
        "star",
        "delta",
        "match",
    )


def _summary() -> list[Column]:
    """Aggregates of a pair's cells: rows per side, the value of one-row results, verdict.

    ``first`` marks the cells of a pair's first measure, one per row.
    """

    def rows(side: str):
        return F.count(F.when(F.col("first") & F.col(f"in_{side}"), True))

    def single(side: str):
        value = F.max(F.when(F.col("first"), F.col(side)))
        return F.when(rows(side) == 1, value)

    return [
        rows("normalized").alias("rows_normalized"),
        rows("star").alias("rows_star"),
        single("normalized").alias("value_normalized"),
        single("star").alias("value_star"),
        F.count(F.when(F.col("match"), True)).alias("matching"),
        F.count(F.when(~F.col("match"), True)).alias("differing"),
        F.coalesce(F.max("delta"), F.lit(0.0)).alias("max_delta"),
        F.coalesce(F.min(F.col("match")), F.lit(True)).alias("match"),
    ]


def summarize(cells: DataFrame, pair: Pair) -> DataFrame:
    """One row for a pair, from its reconciled cells."""
    marked = cells.withColumn("first", F.col("measure") == pair.measures[0])
    return marked.agg(F.lit(pair.name).alias("pair"), *_summary())


def reconcile_all(n: Normalized, m: Mart) -> DataFrame:
    """One summary row per pair, from one pass over each base table.

    Pairs that ask the same thing under two names are compared once. A pair
    without rows on either side has a row that says so.
    """
    names: dict[tuple, list[str]] = {}
    for pair in PAIRS.values():
        names.setdefault((pair.normalized, pair.star), []).append(pair.name)
    aligned = _aligned(shared_cells(n, m), "pair", "key", "measure", "first")
    found = aligned.withColumns(_compared()).groupBy(F.col("pair").alias("of")).agg(*_summary())
    twins = [(name, same[0]) for same in names.values() for name in same]
    listed = literal_table(n.orders.sparkSession, twins, "pair", "of").join(found, "of", "left")
    counts = ["rows_normalized", "rows_star", "matching", "differing"]
    nothing = {"max_delta": 0.0, "match": True} | dict.fromkeys(counts, 0)
    return listed.drop("of").fillna(nothing)


def run_pair(pair: Pair, n: Normalized, m: Mart) -> dict[str, object]:
    """Run each side once, on its own; a failing side reports its error text."""
    report: dict[str, object] = {"pair": pair.name}
    sides = {"normalized": lambda: pair.normalized(n), "star": lambda: pair.star(m)}
    for side, ask in sides.items():
        rows, value, error = 0, None, None
        try:
            result = ask()
            # The greatest row is over all columns, so every measure is worked out.
            every = F.struct(*[F.col(c).cast("string") for c in result.columns])
            only = F.max(F.struct(every.alias("all"), *result.columns[:1]))
            found = result.agg(F.count(F.lit(1)).alias("rows"), only.alias("only")).first()
            rows = found["rows"]
            if rows == 1:
                value = found["only"][1]
        except FAILURES as failure:
            rows, error = 0, str(failure)
        report |= {f"rows_{side}": rows, f"value_{side}": value, f"error_{side}": error}
    return report
