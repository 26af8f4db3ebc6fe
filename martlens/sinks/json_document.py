"""JSON documents over small ordered results, and JSON lines over any."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.model import Mart
from martlens.plans.geo import state_distribution


#: The place after all others.
_END = 2**63 - 1


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, written by all tasks; for results of any size."""
    df.write.mode("overwrite").json(path)


def chart_arrays(df: DataFrame, *columns: str) -> DataFrame:
    """Parallel arrays in ``pos`` order as one JSON document.

    Takes results that carry ``pos``: a top-k or a calendar series. Both are
    bounded, so one document holds them.
    """
    rows = df.agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("rows"))
    arrays = [F.col(f"rows.{column}").alias(column) for column in columns]
    return rows.select(F.to_json(F.struct(*arrays)).alias("document"))


def json_fragments(df: DataFrame, *columns: str) -> DataFrame:
    """(part, place, fragment): the document of ``chart_arrays`` in pieces that stand alone.

    Read in the order of part and place the fragments are that document, with
    a value each; ``part`` is the number of the column. For results of any
    size that carry ``pos`` 1, 2, ...
    """
    last = len(columns) - 1

    def value(column: str) -> Column:
        text = F.to_json(F.array(column))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    def piece(part: int, place: Column, fragment: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), place.cast("long").alias("place"), fragment.alias("fragment"))

    comma = F.when(F.col("pos") > 1, ",").otherwise("")
    values = [piece(i, F.col("pos"), F.concat(comma, value(c))) for i, c in enumerate(columns)]
    frame = []
    for i, column in enumerate(columns):
        opening = ("," if i else "{") + f"{json.dumps(column, ensure_ascii=False)}:["
        frame += [
            piece(i, F.lit(0), F.lit(opening)),
            piece(i, F.lit(_END), F.lit("]" + ("}" if i == last else ""))),
        ]
    around = df.sparkSession.range(1).select(F.inline(F.array(*frame)))
    return df.select(F.inline(F.array(*values))).unionByName(around)


def write_chart_arrays(df: DataFrame, path: str, *columns: str) -> None:
    """``chart_arrays`` of any size: text files that, one after another by name, are the document.

    All tasks write, each a range of the document; nothing is gathered. Line
    ends stand between values only.
    """
    pieces = json_fragments(df, *columns).repartitionByRange("part", "place")
    text = pieces.sortWithinPartitions("part", "place").select("fragment")
    text.write.mode("overwrite").text(path)


def state_document(m: Mart, entity: str = "customer") -> DataFrame:
    """``{tipe, data, max}`` for the map, one entry per mapped state."""
    kind = "seller" if entity == "seller" else "pelanggan"
    entry = F.struct("state", "nama", "jumlah", "lat", "lng")
    ranked = F.struct((-F.col("jumlah")).alias("rank"), "state", entry.alias("entry"))
    document = F.struct(
        F.lit(kind).alias("tipe"),
        F.transform(F.sort_array(F.collect_list(ranked)), lambda r: r["entry"]).alias("data"),
        F.coalesce(F.max("max_jumlah"), F.lit(0)).alias("max"),
    )
    return state_distribution(m, entity).agg(F.to_json(document).alias("document"))
