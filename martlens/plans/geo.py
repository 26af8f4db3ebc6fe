"""Customers or sellers per state, placed and scaled for a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions import half_up, non_blank, ratio_class
from martlens.model import Mart
from martlens.operators.ranking import highest_first, root_scale
from martlens.sources.literals import state_coords

# Circle radius in metres and marker radius in pixels, smallest
# size and span, and the shares of the maximum at which the color changes.
_RADIUS = (15000.0, 185000.0)
_MARKER = (6.0, 12.0)
_COLOR_CUTS = [(0.66, "#e74c3c"), (0.33, "#f1c40f")]
_COLOR_LOW = "#2ecc71"


def attach_coords(counted: DataFrame) -> DataFrame:
    """Look up states by their trimmed code; unknown codes drop out."""
    coords = F.broadcast(state_coords(counted.sparkSession))
    return counted.withColumn("state", F.trim("state")).join(coords, "state")


def state_distribution(m: Mart, entity: str = "customer") -> DataFrame:
    """Count per state with its place on the map and the largest count shown.

    Codes are grouped as stored and trimmed afterwards, so ``'SP '`` and
    ``'SP'`` are two rows that carry the same code.
    """
    dim = m.dim_seller if entity == "seller" else m.dim_pelanggan
    counted = (
        dim.where(non_blank(F.col("state"))).groupBy("state").agg(F.count(F.lit(1)).alias("jumlah"))
    )
    placed = attach_coords(counted)
    largest = placed.agg(F.max("jumlah").alias("largest")).scalar()
    return placed.select(
        "state", "nama", "jumlah", "lat", "lng", largest.alias("max_jumlah")
    ).orderBy(*highest_first("jumlah", "state"))


def map_scale(distribution: DataFrame) -> DataFrame:
    """Circle radius, marker radius and color for each mapped state."""
    smallest = distribution.agg(F.min("jumlah").alias("smallest")).scalar()
    count, largest = F.col("jumlah"), F.col("max_jumlah")
    scaled = distribution.withColumn("smallest", smallest).withColumn(
        "scale", root_scale(count, F.col("smallest"), largest)
    )
    scale = F.col("scale")
    return scaled.select(
        "state",
        "nama",
        "jumlah",
        "lat",
        "lng",
        (_RADIUS[0] + scale * _RADIUS[1]).alias("radius"),
        half_up(_MARKER[0] + scale * _MARKER[1]).alias("pixel_radius"),
        ratio_class(count / largest, _COLOR_CUTS, _COLOR_LOW).alias("color"),
    )
