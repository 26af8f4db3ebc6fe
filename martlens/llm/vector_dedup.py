"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.arrow import batches_of
from martlens.llm.components import components
from martlens.llm.store import ship, written
from martlens.llm.words import U64, mix

#: Width of a projection's cells, for unit vectors.
CELL = 2.0
#: Classes that a bucket of unrelated vectors should hold, and rows of a block.
LOAD, BLOCK = 32, 512
_BUCKET = "bucket long, side int, tab int, cid long, copies long, sigs binary, vector binary"


def collision(distance: float, cell: float = CELL) -> float:
    """Chance that two vectors at a distance fall in one cell of a projection."""
    r = cell / distance
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(classes: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections per table, and tables, for the largest label's classes.

    Projections grow with the logarithm of the classes, so that buckets of
    unrelated vectors stay small; tables are as many as a pair exactly at the
    limit needs to be found with the given chance. Nearer pairs are found more
    surely.
    """
    near = collision(math.sqrt(2 - 2 * cosine))
    per_table = max(2, math.ceil(math.log(max(1, classes / LOAD)) / -math.log(collision(math.sqrt(2)))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - near**per_table))
    return per_table, max(1, tables)


def _buckets(classes: DataFrame, per_table: int, tables: int) -> DataFrame:
    """Each class in its bucket of every table."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cids, labels, copies = (batch.column(i).to_numpy() for i in (0, 1, 2))
            vectors = [np.asarray(v, np.float64) for v in batch.column(3).to_pylist()]
            rows = []
            for i, vector in enumerate(vectors):
                size = len(vector)
                if size not in spaces:
                    rng = np.random.default_rng([size, per_table, tables])
                    spaces[size] = (
                        rng.standard_normal((tables * per_table, size)),
                        rng.uniform(0, CELL, tables * per_table),
                    )
                axes, shift = spaces[size]
                unit = vector / np.abs(vector).max()
                unit /= np.sqrt(unit @ unit)
                cells = np.floor((axes @ unit + shift) / CELL).astype(np.int64).view(U64)
                sigs = np.full(tables, U64(size) + mix(np.array([labels[i]]).astype(np.int64).view(U64))[0])
                for column in cells.reshape(tables, per_table).T:
                    sigs = mix(sigs ^ mix(column + U64(0x9E3779B9)))
                sigs = mix(sigs + np.arange(tables, dtype=U64))
                data, all_sigs = vector.tobytes(), sigs.astype("<u8").tobytes()
                for t, sig in enumerate(sigs.view(np.int64).tolist()):
                    rows.append((sig, 0, t, int(cids[i]), int(copies[i]), all_sigs, data))
            yield from batches_of(_BUCKET, rows)

    return classes.select("cid", "label", "copies", "embedding").mapInArrow(deal, _BUCKET)


def _blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Buckets above a block's size, as pairs of blocks that meet in a task."""
    count = F.ceil(F.col("size") * 2 / block)
    own = F.pmod(F.xxhash64("cid", "bucket"), count)
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), count - 1),
        lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")),
    )
    met = rows.join(sizes, "bucket").withColumn("own", own).withColumn("pair", F.explode(pairs))
    return met.withColumn(
        "side",
        F.when(F.col("pair.i") == F.col("pair.j"), 0).when(F.col("own") == F.col("pair.i"), 1).otherwise(2),
    ).select(
        F.xxhash64("bucket", "pair.i", "pair.j").alias("bucket"),
        "side", "tab", "cid", "copies", "sigs", "vector",
    )


def _links(rows: DataFrame, cosine: float) -> DataFrame:
    """(cid, linked, other): copies linked through this bucket; an edge where ``other`` is set.

    Vectors of a bucket are compared by one matrix product. A pair counts in
    the first table in which it meets. Of a bucket's links only a spanning
    forest is returned, besides each class's sum.
    """
    schema = "cid long, linked long, other long"

    def meet(part: pa.Table) -> list[tuple]:
        side, tab, cid, copies = (part.column(c).to_numpy() for c in ("side", "tab", "cid", "copies"))
        vectors = np.stack([np.frombuffer(v) for v in part.column("vector").to_pylist()])
        sigs = np.stack([np.frombuffer(s, "<u8") for s in part.column("sigs").to_pylist()])
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        norms = np.sqrt((scaled * scaled).sum(axis=1))
        left = np.flatnonzero(side <= 1)
        right = left if side[0] == 0 else np.flatnonzero(side == 2)
        if not len(left) or not len(right):
            return []
        near = (scaled[left] @ scaled[right].T) / (norms[left][:, None] * norms[right][None, :])
        i, j = np.nonzero(near >= cosine)
        i, j = left[i], right[j]
        keep = (i < j) if side[0] == 0 else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        first = np.ones(len(i), bool)
        for t in range(int(tab[0])):
            first &= sigs[i, t] != sigs[j, t]
        i, j = i[first], j[first]
        sums = np.zeros(len(cid), np.int64)
        np.add.at(sums, i, copies[j])
        np.add.at(sums, j, copies[i])
        out = [(int(cid[k]), int(sums[k]), None) for k in np.flatnonzero(sums)]
        root = list(range(len(cid)))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = a, b
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[x] = y
                out.append((int(cid[a]), 0, int(cid[b])))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            buckets = table.column("bucket").to_numpy()
            starts = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
            rows: list[tuple] = []
            for low, high in zip(starts, [*starts[1:], len(buckets)], strict=True):
                if high - low > 1:
                    rows += meet(table.slice(low, high - low))
            yield from batches_of(schema, rows)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            if not table.num_rows:
                continue
            buckets = table.column("bucket").to_numpy()
            cut = int(np.searchsorted(buckets, buckets[-1], "left"))
            carried = table.slice(cut)
            if cut:
                yield from groups(table.slice(0, cut))
        if carried is not None and carried.num_rows:
            yield from groups(carried)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "side", "cid")
    return dealt.mapInArrow(read, schema)


def vector_links(
    vectors: DataFrame, cosine: float = 0.93, recall: float = 0.97, block: int = BLOCK
) -> DataFrame:
    """Near-duplicates among vectors (vec_id, embedding, label) of equal label.

    Two vectors link when they have the same length and label and their
    cosine, in double precision, is at least ``cosine``. One row per vector:
    vec_id, n_links (other vectors found linked to it), component_id (the
    smallest vec_id reachable), kept (vec_id = component_id). A vector or label
    that is null, an all-zero vector, or one with a null or non-finite
    component links with nothing and is its own component. Equal vectors of a
    label are one class with a count, so copies need no pairs; repeated rows
    count as copies. A null vec_id is counted but names no component unless
    it is alone. No rows, no result rows. Other columns are not read.

    Buckets have no cap: one above the block's size is compared block against
    block, each pair of blocks in a task of its own.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(
            "embedding",
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
        )
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn(
        "cid", F.when(F.col("usable"), F.xxhash64("label", "embedding"))
    )
    classes = (
        rows.where("usable")
        .groupBy("cid", "label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("label", F.xxhash64("label"))
    )
    classes = written(classes, "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    buckets = written(_buckets(classes, *plan(largest, cosine, recall)), "buckets")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = written(sizes, "bucket-sizes")
    small = buckets.join(sizes.where(F.col("size") <= block).select("bucket"), "bucket", "left_semi")
    large = _blocks(buckets, sizes.where(F.col("size") > block), block)
    met = written(_links(small.unionByName(large), cosine), "links")
    sums = met.groupBy("cid").agg(F.sum("linked").alias("linked"))
    roots = components(
        met.where("other is not null").select(F.col("cid").alias("u"), F.col("other").alias("v"))
    )
    named = classes.select("cid", "rep", "copies").join(sums, "cid", "left")
    named = named.join(roots, F.col("cid") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "cid")
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select(
        "cid",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        "component_id",
    )
    out = rows.select("vec_id", "usable", "cid").join(named, "cid", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
