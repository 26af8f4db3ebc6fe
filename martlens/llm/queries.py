"""The operators applied to the test tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.contamination import contained_items
from martlens.llm.cotraining import score_quality
from martlens.llm.jaccard_join import jaccard_components
from martlens.llm.licences import scan_licences
from martlens.llm.line_dedup import remove_shared_lines
from martlens.llm.packing import pack
from martlens.llm.prefix_trie import prefix_trie
from martlens.llm.sharding import shard_documents
from martlens.llm.token_files import read_index, write_tokens
from martlens.llm.toxicity import score_toxicity
from martlens.llm.url_filter import judge_urls
from martlens.llm.vector_dedup import vector_links
from martlens.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer file that queries use unless ``martlens.llm.tokenizer`` names another.
_TOKENIZER = "word_bpe_49k.json"

#: (host, path, verdict)
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer(spark: SparkSession) -> str:
    import public_tokenizers

    return spark.conf.get("martlens.llm.tokenizer", None) or public_tokenizers.path(_TOKENIZER)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer(spark))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "n_shingles", "containment")


def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links(table(spark, folder, "embeddings"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), width=3, percent=90)


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_index(spark, write_tokens(table(spark, folder, "documents"), tokenizer(spark)))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_shared_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "text", "n_chars", "removed_lines")


def op10_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation c is based on c - c % 100, of which it takes crc32(c as text) % 6 turns."""
    return prefix_trie(
        table(spark, folder, "conversations"),
        base=lambda c: c - c % 100,
        head=lambda c: F.crc32(c.cast("string").cast("binary")) % 6,
        max_head=5,
    )


_OP1_SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parsed AS (
    SELECT page_id, row_number() OVER () AS page,
        translate(regexp_extract(rest, '^([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(rule_host, rule_path, listed) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
    SELECT *, row_number() OVER (PARTITION BY page
        ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST,
            length(rule_host) DESC) AS place
    FROM parsed LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host))
        AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule,
    coalesce(listed, 'allow') AS verdict
FROM fits WHERE place = 1
"""


_OP4_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark
), ds AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), bs AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), n AS (
    SELECT item_id, CAST(count(*) AS INTEGER) AS n_shingles FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS shared, n_shingles,
    CAST(count(*) AS DOUBLE) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) * 100 >= n_shingles * 80
"""

_OP9_SQL = """
WITH l AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents
), shared AS (
    SELECT trim(line) AS line FROM l WHERE trim(line) <> ''
    GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(0))) >= 8
), marked AS (
    SELECT l.*, CASE WHEN shared.line IS NULL THEN 1 ELSE row_number() OVER (
        PARTITION BY trim(l.line) ORDER BY doc_id, place) END AS nth
    FROM l LEFT JOIN shared ON trim(l.line) = shared.line
), kept AS (
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (nth = 1), '') AS text,
        CAST(count(*) FILTER (nth > 1) AS INTEGER) AS removed_lines
    FROM marked GROUP BY doc_id
)
SELECT doc_id, kept.text, CASE WHEN removed_lines > 0 THEN length(kept.text) ELSE n_chars END AS n_chars,
    removed_lines
FROM kept JOIN documents USING (doc_id)
"""

_OP13_SQL = """
WITH t AS (
    SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT c, list({'r': r, 'x': x} ORDER BY pos) AS turns FROM t GROUP BY c
), heads AS (
    SELECT c, turns, xor(list_reduce(
        flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
            lambda ch: list_concat([CAST(ord(ch) AS BIGINT)], list_transform(range(8), lambda i: -1)))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
            WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END,
        CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h
    FROM own
), rebuilt AS (
    SELECT a.c, CASE WHEN b.c IS NULL THEN a.turns[a.h + 1:]
        ELSE list_concat(b.turns[1:a.h], a.turns[a.h + 1:]) END AS turns
    FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 100
), prefixes AS (
    SELECT c, len(turns) AS n, unnest(list_transform(range(0, len(turns) + 1),
        lambda d: {'depth': d, 'path': turns[1:d]})) AS p
    FROM rebuilt
), nodes AS (
    SELECT p.depth AS depth, p.path AS path, min(c) AS conv_id, count(*) AS n_convs,
        string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = p.depth) AS ends,
        count(*) FILTER (WHERE n > p.depth) = 0 AS childless
    FROM prefixes GROUP BY p.depth, p.path
), above AS (
    SELECT path[1:k] AS path, CAST(sum(saved) AS BIGINT) AS saved_tokens,
        count(*) FILTER (WHERE childless) AS n_leaves,
        count(*) FILTER (WHERE depth = k + 1) AS n_children
    FROM (
        SELECT path, depth, childless, unnest(range(0, depth + 1)) AS k,
            CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].x) ELSE 0 END AS saved
        FROM nodes
    ) GROUP BY path[1:k]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves,
    saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN above ON above.path = n.path
    LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


def queries() -> dict[str, Query]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_contamination": op4_contamination,
        "op5_vector_dedup": op5_vector_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_sharding": op7_sharding,
        "op8_token_files": op8_token_files,
        "op9_line_dedup": op9_line_dedup,
        "op10_cotraining": op10_cotraining,
        "op11_licences": op11_licences,
        "op12_whitening": op12_whitening,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _OP1_SQL,
        "op4_contamination": _OP4_SQL,
        "op9_line_dedup": _OP9_SQL,
        "op13_prefix_trie": _OP13_SQL,
    }
