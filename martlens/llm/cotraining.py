"""Quality scores by two classifiers, of content and of metadata, that teach each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.arrow import batches_of
from martlens.llm.linear import fit_dense, sigmoid
from martlens.llm.store import ship, written
from martlens.llm.toxicity import held_out
from martlens.llm.words import _segments, word_hashes

#: Labelled rows learnt from (per label), rounds, and how sure a view must be to give a label.
SAMPLE, ROUNDS, SURE = 6_000, 5, 0.95
#: Languages, and sources, that are columns of their own; further ones share so many columns.
VALUES, SHARED = 512, 32

_KIND = np.full(256, 5)
_KIND[48:58] = 0
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[128:] = 4


def content(text: str | None) -> np.ndarray:
    """Content view: shares of kinds of characters, repetition, word and line lengths."""
    data = (text or "").encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data, np.uint8)
    n = max(1, len(codes))
    kinds = np.zeros(6)
    words = []
    for part in _segments(data):  # cut between words
        kinds += np.bincount(_KIND[np.frombuffer(part, np.uint8)], minlength=6)
        words.append(word_hashes(part)[0])
    words = np.concatenate(words)
    count = max(1, len(words))
    distinct, times = np.unique(words, return_counts=True)
    lines = data.count(b"\n") + 1
    same = (words[1:] == words[:-1]).sum() / count if len(words) > 1 else 0.0
    skip = (words[2:] == words[:-2]).sum() / count if len(words) > 2 else 0.0
    letters = max(1.0, kinds[1] + kinds[2])
    shares = kinds / n
    values = [
        *shares,
        kinds[1] / letters,
        np.sqrt(shares[5]),
        len(distinct) / count,
        np.log(len(distinct) + 1) / np.log(count + 1) if count > 1 else 1.0,
        times.max(initial=0) / count,
        same,
        np.sqrt(same),
        skip,
        np.log1p(n / count),
        np.log1p(n),
        np.log1p(n / lines),
        data.count(b"|") / count,
        float(not len(words)),
    ]
    return np.array(values, float)


class Metadata:
    """Metadata view: which columns are 1, of language and source by value, and size by range.

    ``values`` are the hashes of the languages and sources with columns of
    their own; if there are more, the others share some columns by hash.
    """

    def __init__(self, values: tuple[list[int], list[int]]) -> None:
        self.columns, self.shared, at = [], [], 0
        for known in values:
            self.columns.append({value: at + i for i, value in enumerate(known)})
            at += len(known)
            self.shared.append(at if len(known) >= VALUES else None)
            at += SHARED if len(known) >= VALUES else 0
        self.sizes, self.width = at, at + 17

    def places(self, lang: int, source: int, n_chars: int | None) -> np.ndarray:
        """The three columns, and how many there are."""
        found = []
        for value, columns, shared in zip((lang, source), self.columns, self.shared, strict=True):
            place = columns.get(value)
            found.append(shared + value % SHARED if place is None else place)
        size = 16 if n_chars is None or n_chars < 0 else min(15, int(np.log2(n_chars + 1)))
        return np.array([*found, self.sizes + size, self.width], np.int32)


def _value_hash(column: str) -> Column:
    """A hash of the whole value; NULL is a value too."""
    return F.xxhash64(F.col(column).isNull(), F.col(column).cast("string"))


def _metadata(docs: DataFrame) -> Metadata:
    """Columns for the commonest languages and sources of all documents."""
    values = []
    for column in ("lang", "source"):
        counted = docs.groupBy(_value_hash(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        common = counted.orderBy(F.desc("n"), "value").limit(VALUES)
        values.append([row["value"] for row in common.collect()])
    return Metadata((values[0], values[1]))


def _both(x: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of both views, from the bytes of their features."""
    places = np.frombuffer(b"".join(m), np.int32).reshape(-1, 4)
    known = np.zeros((len(m), int(places[0, 3]) if len(m) else 17))
    np.put_along_axis(known, places[:, :3], 1.0, axis=1)
    return np.frombuffer(b"".join(x)).reshape(len(x), len(content(""))), known


@dataclass
class View:
    """One view's classifier over standardised columns; the last weight is the offset."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.columns(x) @ self.weights


def _sums(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of rows, gradient and curvature of the log loss, as one array that adds up."""
    p = sigmoid(z @ weights)
    return np.concatenate([[len(z)], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def _given(z: np.ndarray, past: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a view was sure of in any past round, and the label it gave in the first such round."""
    logits = z @ np.column_stack(past)
    sure = np.abs(logits) >= np.log(SURE / (1 - SURE))
    at = np.flatnonzero(sure.any(axis=1))
    return at, (logits[at, sure[at].argmax(axis=1)] > 0).astype(float)


def _over(pool: DataFrame, one: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | float:
    """The sum of ``one`` over the batches of ``pool`` (x, m); each task sends one array of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = one(*_both(*(batch.column(i).to_pylist() for i in (0, 1))))
                total = part if total is None else total + part
        yield from batches_of("sums binary", [] if total is None else [(total.tobytes(),)])

    return sum(np.frombuffer(bytes(row[0])) for row in pool.mapInArrow(add, "sums binary").collect())


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: DataFrame
) -> tuple[list[View], list[int]]:
    """Blum and Mitchell's rounds, and how many rows of ``pool`` (x, m) each view got from the other.

    In each round each view labels all rows of the pool that it is sure of, and
    the other view learns from them; a label once given stays. The pool is not
    collected: its tasks work the labels out from the weights of past rounds,
    and send sums for Newton's steps of both views.
    """
    own = [text, meta]
    widths = [x.shape[1] for x in own]
    first = 2 * widths[0] + 1
    moments = np.concatenate([_moments(x) for x in own])
    moments = moments + _over(pool, lambda *both: np.concatenate([_moments(x) for x in both]))
    views = []
    for part, width in zip((moments[:first], moments[first:]), widths, strict=True):
        mean = part[1 : width + 1] / part[0]
        spread = part[width + 1 :] / part[0] - mean * mean
        scale = np.sqrt(np.where(spread > 1e-12 * (1 + mean * mean), spread, 1.0))
        views.append(View(mean, scale, np.zeros(width + 1)))
    own = [view.columns(x) for view, x in zip(views, own, strict=True)]
    cut = 1 + (widths[0] + 1) * (widths[0] + 2)
    past: list[list[np.ndarray]] = [[], []]

    def fit() -> list[int]:
        counts = [0, 0]
        for _ in range(25):
            weights = [view.weights for view in views]

            def taught(*both: np.ndarray) -> np.ndarray:
                z = [view.columns(x) for view, x in zip(views, both, strict=True)]
                found = [_given(z[1 - i], past[1 - i]) for i in (0, 1)]
                return np.concatenate([_sums(z[i][at], label, weights[i]) for i, (at, label) in enumerate(found)])

            more = _over(pool, taught) if past[0] else 0.0
            more = more + np.zeros(cut + 1 + (widths[1] + 1) * (widths[1] + 2))
            change = 0.0
            for i, part in enumerate((more[:cut], more[cut:])):
                counts[i] = int(part[0])
                total, width = part + _sums(own[i], y, weights[i]), widths[i] + 1
                ridge = np.full(width, 1e-3)
                ridge[-1] = 1e-9
                curve = total[1 + width :].reshape(width, width) / total[0] + np.diag(ridge + 1e-9)
                step = np.linalg.solve(curve, total[1 : 1 + width] / total[0] + ridge * weights[i])
                size = np.abs(step).max()
                views[i] = View(views[i].mean, views[i].scale, weights[i] - step * min(1.0, 5 / max(size, 1e-12)))
                change = max(change, size)
            if change < 1e-4:  # the next step would be of the order of its square
                break
        return counts

    given = fit()
    for _ in range(ROUNDS):
        for i, view in enumerate(views):
            past[i].append(view.weights)
        before, given = given, fit()
        if given == before:
            break
    return views, given


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x, m): both views' features of every document."""
    schema = "doc_id long, held_out boolean, x binary, m binary"
    view = _metadata(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [content(t.as_py()).tobytes() for t in batch.column(2)]
            columns = [batch.column(i).to_pylist() for i in (3, 4, 5)]
            m = [view.places(*row).tobytes() for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.binary()), pa.array(m, pa.binary())],
                ["doc_id", "held_out", "x", "m"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "text",
        _value_hash("lang").alias("lang"),
        _value_hash("source").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )
    return rows.mapInArrow(read, schema)


def _samples(features: DataFrame, labels: DataFrame) -> tuple[list[tuple], DataFrame]:
    """A bounded sample (x, m, label, kept for calibration) of labelled rows, and all unlabelled ones (x, m)."""
    marked = labels.where("quality in (0, 1) and doc_id is not null")
    marked = marked.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    learnt = marked.where(~held_out(F.col("doc_id")))
    picked = [
        learnt.where(F.col("quality") == label).orderBy(order, "doc_id").limit(SAMPLE) for label in (0, 1)
    ]
    ids = picked[0].unionByName(picked[1])
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    rows = features.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("x", "m")).alias("f"))
    rows = rows.select("f.x", "f.m", "quality", fold.cast("int").alias("fold"))
    sample = sorted((bytes(r[0]), bytes(r[1]), r[2], r[3]) for r in rows.collect())
    free = features.where("not held_out").join(marked.select("doc_id"), "doc_id", "left_anti")
    return sample, written(free.select("x", "m"), "quality-pool")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents (doc_id, text, lang, source, n_chars) by ``labels`` (doc_id, quality).

    Labelled rows that are not held out are learnt from, at most ``SAMPLE`` of
    each label, those that come first by a hash of the id, and one row of
    each id (the least by its features). All unlabelled
    documents that are not held out, those without an id included, carry
    pseudo-labels between the views. A fifth of
    the labelled rows only calibrates: each view's logit by its own scale, and
    both in one combination.

    One row per document, repeated and null ids included: doc_id, held_out,
    score (0 to 1, higher is better), text_score, metadata_score, predicted (1
    if score >= 0.5). The ``VALUES`` commonest languages and sources, by their
    whole values, have a weight each; rarer ones share ``SHARED`` weights. Null or empty texts and null metadata have values of
    their own in the features. Without rows of both labels every score is the
    share of good rows (0.5 where there is none).
    """
    spark = docs.sparkSession
    ship(spark)
    every = written(_features(docs), "quality-features")
    sample, pool = _samples(every, labels)
    x, m = _both([r[0] for r in sample], [r[1] for r in sample])
    y = np.array([r[2] for r in sample], float)
    fold = np.array([r[3] for r in sample], bool)
    learnt, check = ~fold, fold
    if len(set(y[learnt])) < 2:
        share = (y == 1).sum() + 0.5
        share /= len(y) + 1.0
        constant = float(np.log(share / (1 - share)))
        parts = None
    else:
        views, _ = co_train(x[learnt], m[learnt], y[learnt], pool)
        if len(set(y[check])) < 2:
            check = np.ones(len(y), bool)
        logits = np.column_stack([views[0].logit(x[check]), views[1].logit(m[check])])
        logits = np.clip(logits, -30, 30)
        own = [fit_dense(logits[:, i : i + 1], y[check], 1e-4) for i in (0, 1)]
        scaled = np.column_stack([logits[:, i] * own[i][0] + own[i][1] for i in (0, 1)])
        parts, constant = (views, own, fit_dense(scaled, y[check], 1e-3)), 0.0
    model = spark.sparkContext.broadcast(parts)
    schema = (
        "doc_id long, held_out boolean, score double, text_score double, "
        "metadata_score double, predicted int"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if model.value is None:
                text = meta = both = np.full(n, constant)
            else:
                views, own, join = model.value
                features, known = _both(*(batch.column(i).to_pylist() for i in (2, 3)))
                text, meta = (
                    np.clip(view.logit(part), -30, 30) * scale[0] + scale[1]
                    for view, part, scale in zip(views, (features, known), own, strict=True)
                )
                both = text * join[0] + meta * join[1] + join[2]
            p = sigmoid(both)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array(v) for v in (p, sigmoid(text), sigmoid(meta))),
                    pa.array((p >= 0.5).astype(np.int32)),
                ],
                [part.split()[0] for part in schema.split(", ")],
            )

    return every.mapInArrow(score, schema)
