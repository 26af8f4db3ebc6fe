"""Columns whose names operators use themselves, and hosts of very many labels."""

import time

import pytest
from pyspark.sql import functions as F

from martlens.llm import queries as Q
from martlens.llm.contamination import decontaminate
from martlens.llm.jaccard_join import keep_one
from martlens.llm.line_dedup import remove_shared_lines
from martlens.llm.url_filter import judge_urls

OWN = ["_key", "_lost", "_places", "_held", "_winner", "_KEY_", "key", "h", "hash", "place"]


@pytest.fixture(scope="module")
def docs(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"own {i} line here now\nshared by all of them", f"s{i}", 30) for i in range(9)]
    rows += [(20, same, "a", 5), (21, same, "b", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return table.withColumns({name: F.concat(F.lit(f"{name}-"), "doc_id") for name in OWN})


def own_columns(df) -> bool:
    return all(row[name] == f"{name}-{row.doc_id}" for row in df.collect() for name in OWN)


def test_line_dedup_leaves_own_columns(docs):
    found = remove_shared_lines(docs.withColumn("removed_lines", F.lit("mine")))
    assert found.columns == [*docs.columns, "removed_lines"] and own_columns(found)
    assert sum(row.removed_lines for row in found.collect()) == 8


def test_decontaminate_leaves_own_columns(spark, docs):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 20)))], "item_id long, text string")
    left = decontaminate(docs, items)
    assert left.columns == docs.columns and own_columns(left) and left.count() == 9


def test_keep_one_leaves_own_columns(docs):
    left = keep_one(docs)
    assert left.columns == docs.columns and own_columns(left)
    assert {row.doc_id for row in left.collect()} == {*range(9), 20}


def test_a_host_of_many_labels_is_judged_fast(spark):
    urls = [(1, "x://" + "d." * 8000 + "example.net/en/a"), (2, "x://" + "d." * 8000 + "example.org/a"), (3, "x://net/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = spark.createDataFrame(Q.URL_RULES, "host string, path string, verdict string")
    judge_urls(pages.where("page_id = 3"), rules).collect()
    begun = time.monotonic()
    found = {row.page_id: row.rule for row in judge_urls(pages, rules).collect()}
    assert found == {1: "example.net/en/", 2: None, 3: "net/"}
    assert time.monotonic() - begun < 15
