"""Lines that many sites share, found by distinct-count sketches and removed.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.store import unused, written

#: Sites from which on a line is boilerplate, and the sketches' size and standard error.
MIN_SITES, LG_K, ERROR = 8, 10, 0.033


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """Every line of ``docs`` (key, doc_id, text, source), and the hashes of boilerplate ones.

    A line's sites are the distinct sources of its documents. Per line hash a
    HyperLogLog sketch of them is built in every task and merged by
    aggregation, so a line that a third of all documents share is one row per
    task. Where the estimate is within four standard errors of the limit (and
    at least one) the sites are counted exactly.
    """
    line = F.trim(F.col("line"))
    lines = docs.select(
        "key", "doc_id", F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("place", "line"),
    ).where(line != "")
    lines = written(
        lines.select(F.xxhash64(line).alias("hash"), "key", "doc_id", "site", "place"), "lines"
    )
    spread = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        F.count(F.lit(1)).alias("times"),
    )
    margin = max(1.0, 4 * ERROR * min_sites)
    spread = spread.where((F.col("times") >= min_sites) & (F.col("sites") >= min_sites - margin))
    spread = written(spread, "spread")
    near = spread.where(F.col("sites") <= min_sites + margin).select("hash")
    counted = lines.join(near, "hash", "left_semi").select("hash", "site").distinct()
    counted = counted.groupBy("hash").count().where(F.col("count") >= min_sites).select("hash")
    sure = spread.where(F.col("sites") > min_sites + margin).select("hash")
    return lines, written(sure.unionByName(counted), "boilerplate")


def remove_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, source, n_chars and others) without cross-site boilerplate.

    A line is compared without the blanks around it. Of a line found on at
    least ``min_sites`` sites only its first occurrence stays, in the document
    of least doc_id (null ids last), at its first place; so no text is lost
    from the whole. Blank lines and all others stay as they are. Every
    document stays, be its text empty then; ``n_chars``, where there is such a
    column, is the new text's length. Documents alike in id and text are
    treated alike. A null source is a site of its own, and a null text has no
    lines and stays null. No documents, no rows.

    ``removed_lines`` is added: how many lines the document lost. It takes the
    place of a column of that name.
    """
    id_, gone, cut = (unused(docs, name) for name in ("_key", "_lost", "_places"))
    keyed = docs.withColumn(id_, F.xxhash64("doc_id", F.xxhash64("text"), F.length("text")))
    given = keyed.select(F.col(id_).alias("key"), "doc_id", "text", "source")
    lines, boilerplate = shared_lines(given, min_sites)
    found = written(lines.join(boilerplate, "hash").drop("site"), "found")
    first = found.groupBy("hash").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place")).alias("first")
    )
    lost = found.join(first, "hash").where(
        (F.col("key") != F.col("first.key")) | (F.col("place") != F.col("first.place"))
    )
    lost = lost.groupBy(F.col("key").alias(gone)).agg(F.collect_set("place").alias(cut))
    joined = keyed.join(lost, F.col(id_) == F.col(gone), "left")
    whole = F.col(cut).isNull()
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(cut, i))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("text", text).withColumn(
        "removed_lines", F.coalesce(F.size(cut), F.lit(0))
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*[c for c in docs.columns if c != "removed_lines"], "removed_lines")
