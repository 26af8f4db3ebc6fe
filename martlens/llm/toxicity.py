"""Toxicity scores of whole texts by a character n-gram classifier."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.arrow import batches_of
from martlens.llm.linear import fit_marked, sigmoid
from martlens.llm.store import ship, written
from martlens.llm.words import U64, mix

#: n-gram lengths in bytes, hash classes of n-grams, features (more where more rows are learnt from).
ORDERS, CLASSES, FEATURES = (4, 5, 6), 1 << 20, 4096
#: Labelled rows that are learnt from, of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 10_000
_PART = 1 << 19

_CODE = np.arange(256, dtype=np.uint8)
_CODE[65:91] += 32
_CODE[[9, 10, 11, 12, 13]] = 32
_LETTER = mix(np.arange(256, dtype=U64) + U64(77)) | U64(1)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _classes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash class of the n-gram at each place."""
    with np.errstate(over="ignore"):
        total = _LETTER[codes[order - 1 :]].copy()
        for i in range(1, order):
            total *= U64(0x9E3779B97F4A7C15)
            total += _LETTER[codes[order - 1 - i : len(codes) - i]]
        total ^= total >> U64(29)
        total *= U64(0xBF58476D1CE4E5B9 + 2 * order)
        return (total >> U64(44)).astype(np.int32)


def n_grams(texts: Iterable[str | None], table: np.ndarray) -> Iterator[np.ndarray]:
    """For each text, the distinct classes of its n-grams that ``table`` marks.

    A-Z are lower-cased and white space is one kind of blank; a blank is put
    before and after the text. Texts are read in parts that overlap, so that
    long ones need little memory.
    """
    for text in texts:
        data = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
        codes = _CODE[np.frombuffer(data, np.uint8)]
        found = []
        for low in range(0, len(codes), _PART):
            part = codes[low : low + _PART + max(ORDERS) - 1]
            for order in ORDERS:
                if len(part) >= order:
                    classes = _classes(part, order)
                    found.append(classes[table[classes]])
        yield np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _counts(rows: DataFrame) -> DataFrame:
    """(class, toxic, clean): labelled documents that hold the class."""
    schema = "class int, toxic long, clean long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.ones(CLASSES, bool)
        totals = np.zeros((2, CLASSES), np.int32)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(0))
            for label, found in zip(batch.column(1).to_pylist(), n_grams(texts, every), strict=True):
                totals[1 - label, found] += 1
        used = np.flatnonzero(totals.any(axis=0))
        if len(used):
            columns = [pa.array(used.astype(np.int32))] + [pa.array(t[used].astype(np.int64)) for t in totals]
            yield pa.RecordBatch.from_arrays(columns, ["class", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(read, schema).groupBy("class").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


class Classifier:
    """Weight per n-gram class (log-count ratio times learnt weight) and offset."""

    def __init__(self, classes: np.ndarray, weights: np.ndarray, offset: float) -> None:
        self.classes, self.weights, self.offset = classes, weights, offset

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        marked, weights = np.zeros(CLASSES, bool), np.zeros(CLASSES)
        marked[self.classes] = True
        weights[self.classes] = self.weights
        return marked, weights


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled rows.

    The rows are those whose ids come first by a hash, so the sample is the
    same wherever it is taken; with fewer rows all are used. Of rows that share
    an id one is learnt from, the first by a hash of the text. Only ids that are
    not held out are learnt from, and of a label only 0 and 1. The sample's
    ids, a bounded number, are broadcast to fetch its texts.

    Each n-gram's ratio is the logarithm of its smoothed rates in toxic and
    clean documents; the most telling n-grams (by the ratio over its standard
    error) are the features, a document's value being the ratio where it has
    the n-gram. They are ranked only, with no least error ratio, and are
    ``FEATURES`` or as many as the rows learnt from, if those are more. A
    logistic regression weighs them. Without rows of both labels
    there are no features, and every score is the share of toxic rows (0.5
    where there is no row).
    """
    ship(docs.sparkSession)
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = None
    for label, bound in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic")
    )
    rows = written(rows.select("text", "toxic").repartition(8), "toxicity-sample")
    n = {row[0]: row[1] for row in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    error = F.sqrt(1 / a + 1 / b - 1 / F.lit(n_toxic + 1.0) - 1 / F.lit(n_clean + 1.0))
    ratio = F.log(a / (n_toxic + 1.0)) - F.log(b / (n_clean + 1.0))
    best = (
        _counts(rows)
        .select("class", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
        .orderBy(F.desc("z"), "class")
        .limit(max(FEATURES, n_toxic + n_clean))
        .collect()
    )
    classes = np.array([row["class"] for row in best], np.int64)
    ratios = np.array([row["ratio"] for row in best])
    table = np.zeros(CLASSES, bool)
    table[classes] = True
    small = np.uint16 if len(classes) <= 1 << 16 else np.int32
    place = np.zeros(CLASSES, small)
    place[classes] = np.arange(len(classes))
    shared = docs.sparkSession.sparkContext.broadcast((table, place))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, place = shared.value
        for batch in batches:
            found = n_grams((t.as_py() for t in batch.column(0)), table)
            labels = batch.column(1).to_pylist()
            out = [(label, place[f].tobytes()) for label, f in zip(labels, found, strict=True)]
            yield from batches_of("toxic int, found binary", out)

    # One order of the rows, so that sums come out the same whatever task sent them.
    marked_rows = rows.mapInArrow(mark, "toxic int, found binary")
    sample = sorted((row[0], row[1]) for row in marked_rows.toLocalIterator())
    targets = np.array([row[0] for row in sample], float)
    lengths = np.array([len(row[1]) for row in sample]) // np.dtype(small).itemsize
    columns = np.frombuffer(b"".join(row[1] for row in sample), small)
    del sample
    weights, offset = fit_marked(columns, lengths, ratios, targets, 1e-5, 400)
    return Classifier(classes, weights * ratios, offset)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) by ``labels`` (doc_id, toxic).

    One row per document, repeated and null ids included: doc_id, held_out,
    score (0 to 1), predicted (1 if score >= 0.5). A null or empty text gets
    the score of a text without features. Labels, ids and other columns are
    not inputs of a score. Null labels are not learnt from; a document
    labelled twice counts as toxic if either says so.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast((*(c := train(docs, labels)).tables(), c.offset))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, weights, offset = model.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column(2))
            total = np.array([weights[f].sum() + offset for f in n_grams(texts, marked)])
            p = sigmoid(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, in all their columns, whose whole text is not predicted toxic."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast((*(c := train(docs, labels)).tables(), c.offset))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, weights, offset = model.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column(place))
            clean = [weights[f].sum() + offset < 0 for f in n_grams(texts, marked)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
