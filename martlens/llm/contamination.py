"""Benchmark items inside documents: sketch search, then exact containment.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.store import unused, written

WIDTH = 5
#: Sketch rows up to which the items' sketches are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, make) -> Column:
    """One value per place at which a shingle starts; the whole of fewer words; none of no words."""

    def of(w: Column) -> Column:
        size = F.size(w)
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(size - WIDTH, F.lit(0))),
            lambda i: make([F.get(w, i + j) for j in range(WIDTH)]),
        )
        short = F.array(make([F.array_join(w, " ")]))
        none = F.array().cast(f"array<{_KIND[make]}>")
        return F.when(size >= WIDTH, many).when(size > 0, short).otherwise(none)

    # The words are bound to a variable, so that they are split once and not per shingle.
    return F.get(F.transform(F.array(words), of), F.lit(0))


def _hashed(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _text(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


_KIND = {_hashed: "bigint", _text: "string"}


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of a document (doc_id, text) and a benchmark item (item_id, text) that it holds.

    An item is held when at least ``percent`` hundredths of its distinct
    five-word shingles are in the document. Items are partitioned by size,
    each class twice the one before. A MinHash sketch keeps the shingles of
    least hash of an item, so many that a document which holds the item must
    hold one of them: more than the share that may be missing, as set by the
    item's size, and at most by its class's. Long documents are probed shingle
    by shingle, at whole length, so a short item deep inside is found. A pair
    that meets in the sketch is verified on the shingles' texts.

    One row per pair: doc_id, item_id, text_hash (tells documents of equal id
    apart), shared, n_shingles, containment. Repeated rows give one pair. Null
    or empty texts hold nothing and are held by nothing; null ids are kept as
    they are. A text of fewer than five words is one shingle, all its words,
    so a shorter item is found in documents that are that text. No rows on
    either side, no pairs. Other columns are not read.
    """
    items = (
        benchmark.select("item_id", "text")
        .where("text is not null")
        .distinct()
        .select("item_id", F.array_distinct(_shingles(words_of(F.col("text")), _text)).alias("shingles"))
        .where(F.size("shingles") > 0)
        .withColumn("n_shingles", F.size("shingles"))
        .withColumn("item", F.xxhash64("item_id", F.array_join("shingles", "\n")))
    )
    items = written(items, "items")
    size = F.col("n_shingles")
    needed = F.expr(f"(n_shingles * {percent} + 99) div 100")
    size_class = F.floor(F.log2(size))
    most = F.pow(F.lit(2), size_class + 1) - 1
    kept = F.least(size - needed + 1, F.floor(most * (100 - percent) / 100) + 2).cast("int")
    hashes = F.transform(
        "shingles", lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(j)) for j in range(WIDTH)])
    )
    hashes = F.when(
        F.size(F.split(F.get("shingles", F.lit(0)), " ")) >= WIDTH, hashes
    ).otherwise(F.transform("shingles", lambda s: F.xxhash64(s)))
    sketches = items.select(
        "item", size_class.alias("size_class"), F.explode(F.slice(F.array_sort(hashes), F.lit(1), kept)).alias("h")
    )
    sketches = written(sketches, "sketches")
    if sketches.count() <= BROADCAST_ROWS:
        sketches = F.broadcast(sketches)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("text is not null")
    probes = keyed.select(
        "doc_id", "text_hash", F.explode(_shingles(words_of(F.col("text")), _hashed)).alias("h")
    )
    met = probes.join(sketches, "h").select("doc_id", "text_hash", "item").distinct()
    met = written(met.withColumn("key", F.xxhash64("doc_id", "text_hash")), "met")
    held = keyed.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    held = held.join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    held = held.select("key", F.array_distinct(_shingles(words_of(F.col("text")), _text)).alias("own"))
    pairs = met.join(held, "key").join(items, "item")
    shared = F.size(F.array_intersect("shingles", "own"))
    return (
        pairs.select("doc_id", "item_id", "text_hash", shared.alias("shared"), "n_shingles")
        .where(F.col("shared") * 100 >= F.col("n_shingles") * percent)
        .withColumn("containment", F.col("shared") / F.col("n_shingles"))
        .distinct()
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that hold no benchmark item, unchanged, in all their columns."""
    found = contained_items(docs, benchmark, percent)
    key, held = unused(docs, "_key"), unused(docs, "_held")
    names = found.select(F.xxhash64("doc_id", "text_hash").alias(held)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text")))
    return keyed.join(names, F.col(key) == F.col(held), "left_anti").drop(key)
