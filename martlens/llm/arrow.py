"""Arrow batches from columns, and sums of long arrays over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "string": pa.string(),
    "array<long>": pa.list_(pa.int64()),
}


def batch_of(schema: str, columns: Sequence) -> pa.RecordBatch:
    """A batch of the schema, written as Spark DDL, from lists or arrays."""
    fields = [part.split() for part in schema.split(", ")]
    arrays = [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def batches_of(schema: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch of the rows, or none if there are none."""
    if rows:
        yield batch_of(schema, list(zip(*rows, strict=True)))


def chunks(values: np.ndarray, size: int) -> list[tuple[int, bytes]]:
    """The parts of a long array that hold anything, numbered, as bytes."""
    parts = values.reshape(-1, size)
    return [(int(i), parts[i].tobytes()) for i in np.flatnonzero(parts.any(axis=1))]


def joined_chunks(
    parts: DataFrame,
    kind: str,
    size: int,
    total: int,
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
    reduce_to: Callable[[np.ndarray], np.ndarray] = lambda x: x,
) -> np.ndarray:
    """Combine every task's parts (chunk, bits) of an array of ``total`` items.

    The parts are combined chunk by chunk on the executors, one at a time, and
    only the result, whose size is fixed by ``total``, comes to the driver.
    """

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(data.as_py(), kind)
                held[chunk] = combine(held[chunk], part) if chunk in held else part
        rows = [(chunk, reduce_to(part).tobytes()) for chunk, part in held.items()]
        yield from batches_of("chunk int, bits binary", rows)

    out = reduce_to(np.zeros(total, kind))
    found = parts.select("chunk", "bits").repartition("chunk")
    for chunk, data in found.mapInArrow(combined, "chunk int, bits binary").toLocalIterator():
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(bytes(data), out.dtype)
    return out
