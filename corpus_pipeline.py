"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
one before it kept; all but the last return the columns of ``documents``.

A null or empty text is judged like a text without words: it is not toxic unless
most labelled rows are, has no shared line, no near copy and no benchmark item, and
is packed as an end id alone. Long texts are read whole. Repeated rows and null
ids are rows of their own, but as near copies of each other only one stays. A stage
without rows, labels or items keeps what it is given, and no documents give no
pieces. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martlens.llm.contamination import decontaminate
from martlens.llm.jaccard_join import keep_one
from martlens.llm.line_dedup import remove_shared_lines
from martlens.llm.packing import pack
from martlens.llm.queries import table, tokenizer
from martlens.llm.store import written
from martlens.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line on many sites only its first occurrence stays; no document goes."""
    return remove_shared_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return keep_one(docs, width=5, percent=80)


def drop_benchmark_holders(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4,096 ids."""
    return pack(docs, tokenizer(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_holders),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing. Tests hold each stage against
#: a brute-force version of it on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
