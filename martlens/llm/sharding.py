"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

DataFrame functions only; the ring itself, of fixed size, is laid out on the
driver from one count per ring cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.store import written

CELL_BITS = 14
VIRTUAL_NODES = 64
#: Copies of one row that a task writes at a time.
_RUN = 4096


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.

    A shard's nodes depend on its own number alone, so one more shard adds its
    nodes and moves no others.
    """
    points = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big"), shard))
    return [(point >> (64 - CELL_BITS), shard) for point, shard in sorted(points)]


def loads(
    counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each cell's keys go.

    A shard may hold the rows' mean, rounded up for the first shards and down
    for the others, so that all together hold every row. Cells go to the next
    node clockwise; first every shard fills with its own cells' keys in ring
    order, then the keys that overflow go on clockwise to the next shard with
    room.
    """
    nodes = ring(shards, virtual_nodes)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    rows: list[tuple[int, int, int, int, int]] = []

    def put(cell: int, low: int, left: int, shard: int) -> int:
        taken = min(left, room[shard])
        if taken:
            rows.append((cell, low, low + taken, shard, filled[shard]))
            room[shard] -= taken
            filled[shard] += taken
        return taken

    over, at = [], 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        node = at % len(nodes)
        taken = put(cell, 0, counts[cell], nodes[node][1])
        if taken < counts[cell]:
            over.append((cell, taken, counts[cell] - taken, node))
    for cell, low, left, node in over:
        while left:
            node = (node + 1) % len(nodes)
            taken = put(cell, low, left, nodes[node][1])
            low, left = low + taken, left - taken
    return rows


def shard_documents(docs: DataFrame, shards: int = 16, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Put all documents (doc_id, text) into shards 0 to ``shards - 1``, by law ``rows``.

    The shards' counts are at most one apart: the ring's loads are bounded by
    the mean. A document's place on the ring is a hash of its id and its
    text's crc32. With one more shard, keys move only where its nodes or the
    lower bound push them.

    One row per document: doc_id, size (UTF-8 bytes of the text, none for a
    null text, plus 1), text_crc32 (0 for a null text), law, shard, slot
    (gapless from 0 in each shard), grown_shard (null under this law). Rows of
    equal id, size and crc are counted before they are shuffled and written
    out again at the end, so that many copies load no task; which of them has
    which slot is no matter. A null doc_id is a key like others. No documents,
    no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 64 - CELL_BITS)
    groups = (
        rows.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("cell", place.cast("int"))
    )
    groups = written(groups, "groups")
    counts = {r[0]: r[1] for r in groups.groupBy("cell").agg(F.sum("copies")).collect()}
    plan = spark.createDataFrame(
        loads(counts, shards, virtual_nodes),
        "cell int, low long, high long, shard int, first long",
    )
    # At most a row per cell and one per overflow: bounded by the ring.
    plan = F.broadcast(plan)
    before = (
        Window.partitionBy("cell")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = groups.withColumn("from", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    single = ranked.where(F.col("copies") == 1).withColumn("rank", F.col("from"))
    runs = ranked.where(F.col("copies") > 1).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_RUN).cast("long")))
    )
    runs = runs.repartition("doc_id", "text_crc32", "size", "run").withColumn(
        "i", F.explode(F.sequence("run", F.least(F.col("run") + _RUN, F.col("copies")) - 1))
    )
    runs = runs.withColumn("rank", F.col("from") + F.col("i"))
    columns = ["doc_id", "size", "text_crc32", "cell", "rank"]
    every = single.select(*columns).unionByName(runs.select(*columns))
    return (
        every.join(plan, "cell")
        .where("rank >= low and rank < high")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("first") + F.col("rank") - F.col("low")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
