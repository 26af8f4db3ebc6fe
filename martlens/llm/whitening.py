"""Whitening of vectors with MLlib's BlockMatrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.store import ship, written
from martlens.operators.numbering import numbered, tagged

#: A vector's entries become whole steps of 1/64, moved by a million.
STEPS, SHIFT = 64, 1_000_000
#: Entries from here on (2 to the 46th) would not be whole steps of a double.
LARGEST = float(1 << 46)
COMPONENTS = 16
#: Rows and columns of a block, and blocks that one task multiplies for the scatter matrix.
ROWS_PER_BLOCK, COLS_PER_BLOCK, BLOCKS_PER_TASK = 1024, 1024, 8
_LONG = 1 << 63
_LOW_BITS = 26


def whole_steps(vector: Column) -> Column:
    """``floor(64 * entry) + 1000000`` for each entry, worked out in doubles."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(SHIFT))


def _usable(vector: Column) -> Column:
    # NaN is above every number, so it fails the comparison as infinities do.
    return F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST)) & (
        F.size(vector) > 0
    )


def _moments(fit: DataFrame, length: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and the exact sum, least and greatest entry of each dimension."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(length, np.int64), np.zeros(length, np.int64)
        least, most, rows = np.full(length, _LONG - 1), np.full(length, -_LONG), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, length)
            if len(x):
                high += (x >> _LOW_BITS).sum(axis=0)
                low += (x & ((1 << _LOW_BITS) - 1)).sum(axis=0)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
                rows += len(x)
        if rows:
            names = ["place", "high", "low", "least", "most", "n"]
            columns = [np.arange(length), high, low, least, most, np.full(length, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    schema = "place long, high long, low long, least long, most long, n long"
    found = (
        fit.select("x")
        .mapInArrow(read, schema)
        .groupBy("place")
        .agg(*[F.sum(c).alias(c) for c in ("high", "low", "n")], F.min("least"), F.max("most"))
        .orderBy("place")
        .collect()
    )
    sums = [(int(r["high"]) << _LOW_BITS) + int(r["low"]) for r in found]
    return found[0]["n"], sums, [r["min(least)"] for r in found], [r["max(most)"] for r in found]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


class _Centre:
    """The mean of the fit list, kept as whole steps and a rest below one."""

    def __init__(self, fit: DataFrame, length: int) -> None:
        self.n, sums, least, most = _moments(fit, length)
        self.whole = [s // self.n for s in sums]
        self.rest = [s - self.n * q for s, q in zip(sums, self.whole, strict=True)]
        ends = zip(least, most, self.whole, self.rest, strict=True)
        self.bound = sum(
            max((self.n * (low - q) - r) ** 2, (self.n * (high - q) - r) ** 2)
            for low, high, q, r in ends
        )

    def centred(self) -> Column:
        """x minus the mean, as doubles."""
        means = F.array(*[F.lit(r / self.n) for r in self.rest])
        steps = F.zip_with("x", _longs(self.whole), lambda x, q: (x - q).cast("double"))
        return F.zip_with(steps, means, lambda y, m: y - m)

    def deviation(self) -> Column:
        """Sum of (n * x - S) squared: exact, or NULL where it is beyond a long."""
        n, y = F.lit(self.n), F.zip_with("x", _longs(self.whole), lambda x, q: x - q)
        if self.bound < _LONG:
            apart = F.zip_with(y, _longs(self.rest), lambda v, r: n * v - r)
            return F.aggregate(apart, F.lit(0).cast("long"), lambda total, v: total + v * v)
        rough = F.aggregate(
            self.centred(), F.lit(0.0), lambda total, v: total + v * v * float(self.n) ** 2
        )
        exact, wide = "decimal(38,0)", "decimal(19,0)"
        apart = F.zip_with(y, _longs(self.rest), lambda v, r: (n.cast(wide) * v - r).cast(wide))
        total = F.aggregate(
            apart, F.lit(0).cast(exact), lambda total, v: (total + v * v).cast(exact)
        )
        # The rough sum keeps the exact one from being asked where it cannot fit.
        return F.when(rough < 9.2e18, total.cast("long"))


def _blocks(rows: DataFrame, centre: _Centre, n_rows: int, length: int) -> BlockMatrix:
    """Centred rows, dealt to blocks by their index."""
    indexed = rows.select("index", array_to_vector(centre.centred()).alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    return IndexedRowMatrix(indexed, n_rows, length).toBlockMatrix(ROWS_PER_BLOCK, COLS_PER_BLOCK)


def _scatter(m: BlockMatrix, n_rows: int) -> np.ndarray:
    """Transpose times matrix, whose size is that of a vector squared.

    The product is one block, which MLlib would add up in one task; given a
    number of splits it multiplies so many parts of the rows apart and adds
    those products. Python's ``multiply`` does not pass that number on.
    """
    splits = 1 + n_rows // (ROWS_PER_BLOCK * BLOCKS_PER_TASK)
    other = m._java_matrix_wrapper._java_model
    product = m.transpose()._java_matrix_wrapper.call("multiply", other, splits)
    return BlockMatrix(product, COLS_PER_BLOCK, COLS_PER_BLOCK).toLocalMatrix().toArray()


def _projected(m: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    parts = [
        ((i, 0), Matrices.dense(*part.shape, part.ravel(order="F")))
        for i, at in enumerate(range(0, len(weights), COLS_PER_BLOCK))
        if len(part := weights[at : at + COLS_PER_BLOCK])
    ]
    held = m.blocks.context.parallelize(parts, 1)
    return m.multiply(BlockMatrix(held, COLS_PER_BLOCK, weights.shape[1], *weights.shape))


Spread = tuple[int, np.ndarray, np.ndarray]


def _spread(block: tuple) -> Spread:
    z = block[1].toArray()
    mean = z.mean(axis=0)
    return len(z), mean, (z - mean).T @ (z - mean)


def _merged(a: Spread, b: Spread) -> Spread:
    n, apart = a[0] + b[0], b[1] - a[1]
    return (
        n,
        a[1] + apart * (b[0] / n),
        a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n),
    )


def _common_length(rows: DataFrame) -> tuple[int, int] | None:
    """The length of most vectors (the greater of equally common ones), and how many lengths there are."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return (first["d"], lengths.count()) if first else None


def whiten(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """Each vector projected on the leading components of all, scaled to unit variance.

    Entries are rounded down to steps of 1/64 first. The fit list holds each
    distinct vector of steps once; its covariance V has the divisor n. Rows of
    the list are indexed without gaps and dealt to the blocks of a BlockMatrix;
    its transpose times itself is the scatter matrix, whose eigenvectors the
    driver works out (its size is that of a vector squared); multiplying by
    the whitening matrix projects the blocks. All rows are projected in the
    same way, so copies of a vector cost no more than other rows and no step
    gathers them.

    Returns (id, component from 1 by falling eigenvalue, n, deviation,
    whitened, explained, identity_error) per row and component: ``deviation``
    is the sum of (n * x - S) squared, exact (NULL if beyond a long);
    ``explained`` the eigenvalue over the trace of V; ``identity_error`` the
    largest entry by which the covariance of the whitened fit list differs
    from the identity.

    Rows whose vector is null, empty, or holds an entry that is null, not
    finite or of 2 to the 46th or more are dropped. If vectors differ in
    length, those of the commonest length (the greater of equally common ones)
    are whitened and the others dropped. Repeated rows and ids, and null ids,
    are rows of their own. A component without variance (all of them where
    there is one distinct vector) has a NULL ``whitened``, and one of no
    variance at all a NULL ``explained``. No usable row, no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[id_column].dataType
    schema = (
        f"{id_column} {kind.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    vector = F.col(vector_column)
    usable = vectors.where(_usable(vector))
    rows = usable.select(F.col(id_column).alias("id"), whole_steps(vector).alias("x"))
    rows = written(tagged(rows, "tag"), "steps")
    common = _common_length(rows)
    if common is None:
        return spark.createDataFrame([], schema)
    length, lengths = common
    if lengths > 1:
        rows = written(tagged(rows.where(F.size("x") == length).drop("tag"), "tag"), "steps")
    fit = written(tagged(rows.select("x").distinct(), "tag"), "distinct-steps")
    centre = _Centre(fit, length)
    fit, rows = numbered(fit, "tag", "index"), numbered(rows, "tag", "index")

    # Several products read the fit list's blocks; a lost one is made again.
    fitted = _blocks(fit, centre, centre.n, length).persist(StorageLevel.MEMORY_AND_DISK)
    values, vectors_of = np.linalg.eigh(_scatter(fitted, centre.n) / centre.n)
    k, total = min(components, length), float(values.sum())
    values, vectors_of = values[::-1][:k], vectors_of[:, ::-1][:, :k]
    spread = values > max(total, 0.0) * length * np.finfo(float).eps
    weights = vectors_of / np.sqrt(np.where(spread, values, 1.0))

    n, _, scatter = _projected(fitted, weights).blocks.map(_spread).treeReduce(_merged)
    off = np.abs(scatter / n - np.eye(k))[np.ix_(spread, spread)]
    error = float(off.max()) if off.size else 0.0
    explained = [float(v) / total if total > 0 else None for v in values]

    n_rows = rows.count()
    blocks = _projected(_blocks(rows, centre, n_rows, length), weights).blocks
    bits = blocks.map(lambda b: (b[0][0], b[1].toArray().astype("<f8").tobytes()))
    projected = spark.createDataFrame(bits, "block long, bits binary")
    index = F.col("index")
    placed = rows.select(
        F.floor(index / ROWS_PER_BLOCK).alias("block"),
        (index % ROWS_PER_BLOCK).alias("place"),
        "id",
        centre.deviation().alias("deviation"),
    )
    fit_size = centre.n

    def unfold(left: pa.Table, right: pa.Table) -> pa.Table:
        # A group is a block: at most ROWS_PER_BLOCK rows.
        block = np.frombuffer(right.column("bits")[0].as_py(), "<f8").reshape(-1, k)
        out = block[left.column("place").to_numpy()]
        m = len(out)
        again = pa.array(np.repeat(np.arange(m), k))
        return pa.table(
            [
                left.column("id").take(again),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, fit_size), pa.int64()),
                left.column("deviation").take(again),
                pa.array(out.ravel(), pa.float64(), mask=np.tile(~spread, m)),
                pa.array(explained * m, pa.float64()),
                pa.array(np.full(m * k, error), pa.float64()),
            ],
            names=[part.split()[0] for part in schema.split(", ")],
        )

    return placed.groupBy("block").cogroup(projected.groupBy("block")).applyInArrow(unfold, schema)
