"""Connected components of a link table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.store import written


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and nothing hangs on those that do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hung")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hung"))
    )
    held = ends.groupBy("node").agg(F.sum("hung").alias("up"), F.min("hung").alias("least"))
    return held.where("up > 1 or up = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (u, v): the least node reachable.

    Each round hangs every node's larger neighbours on the least node it
    knows (large star), then its smaller ones (small star), until the edges
    are stars. A node with very many neighbours is one row of the minimum
    table, built with map-side combine; adaptive execution splits the join of
    its edges. Rows with a null end and loops have no effect; no links, no
    rows.
    """
    edges = written(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where("u <> v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = written(hung.where("u <> v").distinct(), "small-star")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.unionByName(roots)
