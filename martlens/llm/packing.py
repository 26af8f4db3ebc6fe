"""Packing whole documents into training sequences by cutting-stock patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.store import ship, written
from martlens.llm.tokens import WordEncoder

END_ID = 2
_PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
_PIECES_PER_BUCKET = 50_000


def _pattern(prices: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value within the capacity: an unbounded knapsack.

    ``best[c]`` is the most value of items of total width ``c`` at most.
    """
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        fits = np.flatnonzero(widths <= c)
        if len(fits):
            values = best[c - widths[fits]] + prices[fits]
            top = int(np.argmax(values))
            if values[top] > best[c] + 1e-12:
                best[c], pick[c] = values[top], fits[top]
    pattern, c = np.zeros(len(widths)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(widths[pick[c]])
    return float(best[capacity]), pattern


def _linear_program(
    widths: np.ndarray, demand: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, fractions allowed.

    Column generation: least number of sequences that cover the demand. The
    simplex keeps one column per width; the knapsack prices new columns by the
    duals, and a width may be covered more often than asked (a surplus
    column). Any basis is feasible, so stopping after very many rounds costs
    padding, never documents.
    """
    m = len(widths)
    basis = np.diag((capacity // widths).astype(float))
    cost = np.ones(m)
    for _ in range(40 * m + 100):
        prices = np.linalg.solve(basis.T, cost)
        if prices.min() < -1e-9:
            column, price = np.zeros(m), 0.0
            column[int(prices.argmin())] = -1.0
        else:
            value, column = _pattern(prices, widths, capacity)
            price = 1.0
            if value <= 1 + 1e-7:
                break
        used = np.linalg.solve(basis, demand)
        step = np.linalg.solve(basis, column)
        rising = step > 1e-9
        if not rising.any():
            break
        ratios = np.where(rising, np.maximum(used, 0) / np.where(rising, step, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out], cost[out] = column, price
    used = np.maximum(np.linalg.solve(basis, demand), 0)
    real = cost > 0
    return basis[:, real], used[real]


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``(items per width, times used)`` that hold all the demand.

    The linear program's solution is rounded down; what is left, a few items
    per width, is packed first-fit by decreasing width. A pattern may offer
    more places of a width than there are items.
    """
    asked = {width: count for width, count in sorted(demand.items()) if count > 0}
    if not asked:
        return []
    widths = np.array(list(asked))
    left = np.array(list(asked.values()), dtype=np.int64)
    patterns: list[tuple[dict[int, int], int]] = []
    columns, used = _linear_program(widths, left.astype(float), capacity)
    for j, times in enumerate(np.floor(used + 1e-6).astype(np.int64)):
        if times > 0:
            column = np.rint(columns[:, j]).astype(np.int64)
            patterns.append(
                ({int(w): int(a) for w, a in zip(widths, column, strict=True) if a}, int(times))
            )
            left = np.maximum(left - column * times, 0)
    bins: list[tuple[int, dict[int, int]]] = []
    for width, count in zip(widths[::-1].tolist(), left[::-1].tolist(), strict=True):
        at = 0
        while count:
            if at == len(bins):
                bins.append((capacity, {}))
            room, held = bins[at]
            if n := min(count, room // width):
                held[width] = held.get(width, 0) + n
                bins[at] = (room - n * width, held)
                count -= n
            at += 1
    return patterns + [(held, 1) for _, held in bins]


def _places(patterns: list[tuple[dict[int, int], int]], first_bin: int) -> list[tuple]:
    """(width, first rank, end rank, first bin, items of the width per bin)."""
    rows, ranks, number = [], {}, first_bin
    for held, times in patterns:
        for width, count in held.items():
            low = ranks.get(width, 0)
            ranks[width] = low + count * times
            rows.append((width, low, ranks[width], number, count))
        number += times
    return rows


def _pieces(docs: DataFrame, tokenizer: str, size: int, grid: int) -> DataFrame:
    """Tokenize whole texts and cut them; the cuts follow from the length alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for doc, data in zip(ids, encoder.encode(t.as_py() for t in texts), strict=True):
                data += end
                total = len(data) // 4
                at = [*range(0, total, size)]
                body = (total - at[-1]) // grid * grid
                if total - at[-1] < size and 0 < body < total - at[-1]:
                    at.append(at[-1] + body)
                for low, high in zip(at, [*at[1:], total], strict=True):
                    rows.append((doc, low, high - low, zlib.crc32(data[4 * low : 4 * high]), total))
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECE)


def _ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """``rank``: each piece's place among all of its width, from 0.

    A width that holds a third of all pieces is spread over the buckets: rows
    are numbered within (width, bucket), and the buckets' counts are summed.
    """
    keyed = pieces.withColumn(
        "bucket",
        F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(buckets)).cast("int"),
    )
    counts = keyed.groupBy("width", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("width").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "width", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")
    )
    within = Window.partitionBy("width", "bucket").orderBy(
        "doc_id", "start", "ids_crc32", "doc_tokens"
    )
    return (
        keyed.withColumn("rank", F.row_number().over(within) - 1)
        .join(counts, ["width", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("skip"))
        .drop("bucket", "skip")
    )


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, grid: int = 32) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``size`` ids.

    A document is its text's ids, then the end id; a null or empty text is the
    end id alone. Documents are cut every ``size`` ids, and their rest at its
    last multiple of ``grid``. The histogram of the rests, at most
    ``size / grid`` widths, is packed by cutting-stock column generation; the
    tails, shorter than ``grid``, are first packed into units of ``grid`` ids
    in the same way. Patterns are then filled with the documents in ranked
    order. Only the two histograms and the patterns, whose sizes depend on
    ``size`` and ``grid`` alone, pass the driver.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Pieces lie gapless from offset 0; padding, if any, is
    at a sequence's end. Documents of equal id, and repeated rows, are packed
    one by one. No documents, no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = written(_pieces(docs, tokenizer, size, grid), "pieces")
    pieces = pieces.withColumn(
        "width",
        F.when(F.col("length") < grid, -F.col("length")).otherwise((F.col("length") / grid).cast("int")),
    )
    histogram = {row[0]: row[1] for row in pieces.groupBy("width").count().collect()}
    capacity = size // grid
    tails = cutting_stock({-w: n for w, n in histogram.items() if w < 0}, grid)
    units = sum(times for _, times in tails)
    whole = histogram.pop(capacity, 0)
    rests = {w: n for w, n in histogram.items() if w > 0}
    own_units = rests.get(1, 0)
    if units:
        rests[1] = own_units + units
    # Units of tails take the ranks of width 1 after the rests of that width.
    tail_rows = [(-w, low, high, bin_ + own_units, n) for w, low, high, bin_, n in _places(tails, 0)]
    rest_rows = [(capacity, 0, whole, 0, 1)] + _places(cutting_stock(rests, capacity), whole)
    schema = "width int, low long, high long, bin long, per_bin long"
    tail_plan = spark.createDataFrame(tail_rows, schema)
    rest_plan = F.broadcast(spark.createDataFrame(rest_rows, schema))

    def placed(rows: DataFrame, plan: DataFrame, by: str) -> DataFrame:
        plan = plan.withColumnRenamed("width", by)
        return rows.join(plan, by).where("rank >= low and rank < high")

    total = sum(histogram.values()) + whole
    ranked = _ranked(pieces, max(1, total // (_PIECES_PER_BUCKET * 4)))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "width"]
    unit = F.expr("bin + (rank - low) div per_bin")
    rest = ranked.where("width > 0").withColumn("unit_width", F.col("width"))
    tail = placed(ranked.where("width < 0"), F.broadcast(tail_plan), "width").select(
        *kept, unit.alias("rank"), F.lit(1).alias("unit_width")
    )
    both = rest.select(*kept, "rank", "unit_width").unionByName(tail)
    both = placed(both, rest_plan, "unit_width").withColumn("sequence_id", unit)
    order = [F.desc("unit_width"), "rank", F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens"]
    before = (
        Window.partitionBy("sequence_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return both.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )
