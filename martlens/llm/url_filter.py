"""Allow and block lists of hosts and paths, applied to urls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.membership import bloom_of
from martlens.llm.store import ship

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    most_filter_bytes: int = 4 << 20,
    default: str = "allow",
) -> DataFrame:
    """Judge the url of every page (page_id, url) by a list of rules (host, path, verdict).

    A rule fits its host and all subdomains, if the url's path starts with the
    rule's. Each url names the canonical rules that could fit it: its host and
    the host's parents, each with every beginning of its path whose length the
    list has, and no parent of more labels than any host of the list (the
    list's distinct lengths and numbers of labels are all that is collected, so
    a host of thousands of labels names no more than a short one). A blocked Bloom filter of the list lets few of them pass, and a hash join
    with the list removes the false positives. The list may have any size: the
    filter's is bounded, and the join is not forced to broadcast.

    Of the rules that fit, the longest (host and path together, then the
    longer host) wins; a rule listed twice counts once, as ``block`` if the
    verdicts differ. Where none fits, the verdict is ``default``: the url is
    not listed. One row per page, repeated and null page_ids included: page_id, host, path,
    rule, verdict. A null url, or one without ``://``, has an empty host and
    path and no rule.
    """
    spark = pages.sparkSession
    ship(spark)
    listed = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("listed_verdict"))
        .withColumn("key", F.xxhash64("host", "path"))
    )
    lengths = sorted(row[0] for row in listed.select(F.length("path")).distinct().collect())
    deepest = listed.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    filter_ = spark.sparkContext.broadcast(bloom_of(listed.select("key"), most_filter_bytes))

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def may_be_listed(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in keys:
            counts = series.str.len().to_numpy()
            flat = np.concatenate([*series, np.zeros(0, np.int64)]).astype(np.int64)
            yield pd.Series(np.split(filter_.value.test(flat), np.cumsum(counts)[:-1]))

    parsed = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    )
    labels = F.split("host", r"\.")
    hosts = F.transform(
        F.sequence(F.greatest(F.size(labels) - deepest + 1, F.lit(1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    begins = F.filter(
        F.array(*[F.struct(F.substring("path", 1, n).alias("p"), F.lit(n).alias("n")) for n in lengths]),
        lambda s: F.length(s["p"]) == s["n"],
    )
    named = F.flatten(
        F.transform(
            hosts, lambda h: F.transform(begins, lambda s: F.struct(h.alias("h"), s["p"].alias("p")))
        )
    )
    if not lengths:
        return parsed.select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    rows = parsed.withColumn("page", F.monotonically_increasing_id()).withColumn("named", named)
    keys = F.transform("named", lambda s: F.xxhash64(s["h"], s["p"]))
    rows = rows.withColumn("hit", may_be_listed(keys))
    hits = rows.select(
        "page_id", "host", "path", "page",
        F.explode_outer(
            F.filter(F.arrays_zip("named", "hit"), lambda z: z["hit"])
        ).alias("z"),
    ).select(
        "page_id", "host", "path", "page",
        F.col("z.named.h").alias("rule_host"), F.col("z.named.p").alias("rule_path"),
    )
    exact = listed.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "listed_verdict"
    )
    fits = hits.join(exact, ["rule_host", "rule_path"], "left").withColumn(
        "fit",
        F.when(
            F.col("listed_verdict").isNotNull(),
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("listed_verdict").alias("verdict"),
            ),
        ),
    )
    best = fits.groupBy("page", "page_id", "host", "path").agg(F.max("fit").alias("fit"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
    )
