"""The normalized model over raw order tables.

The raw tables are read as they are; every column here is an expression over
them. Only ``orders`` needs work: its delivery date is the last ship date of
its items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.model import NORMALIZED, Normalized, conform
from martlens.sources.literals import literal_table

# State by nation key 0-24. 21 is padded, 22 blank, 23 unknown,
# and 24 has no coordinates.
STATE_BY_NATION: list[str | None] = [
    "SP", "RJ", "MG", "RS", "PR", "SC", "BA", "DF", "GO", "PE", "CE", "PA", "MA",
    "ES", "MT", "MS", "AM", "RN", "PB", "AL", "SE", "SP ", "", None, "XX",
]

# English name by native category; LARGE has none.
CATEGORY_ENGLISH: list[tuple[str, str]] = [
    ("ECONOMY", "economy"),
    ("STANDARD", "standard"),
    ("PROMO", "promo"),
    ("SMALL", "small"),
    ("MEDIUM", "medium"),
]


def raw_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _state(nation: Column) -> Column:
    states = F.array(*[F.lit(state) for state in STATE_BY_NATION])
    return F.when(nation.between(0, len(STATE_BY_NATION) - 1), F.element_at(states, nation + 1))


def _text_id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key))


def _orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # Items are reduced to one row per order before the join, so an order with
    # very many items costs one row per map task. A query that does not read
    # the delivery date drops this join: the right side is unique on its key.
    shipped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("shipped")
    )
    return orders.join(shipped, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("order_id"),
        _text_id("C", "o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.when(F.col("shipped") >= F.col("o_orderdate"), F.col("shipped")).alias(
            "order_delivered_customer_date"
        ),
    )


def normalized_tables(spark: SparkSession, folder: str) -> Normalized:
    """Lazy normalized tables over the raw tables in ``folder``."""

    def raw(name: str) -> DataFrame:
        return raw_table(spark, folder, name)

    derived = {
        "orders": lambda: _orders(raw("orders"), raw("lineitem")),
        "order_items": lambda: raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            _text_id("P", "l_partkey").alias("product_id"),
            _text_id("S", "l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
            F.col("l_quantity").cast("int").alias("quantity"),
        ),
        "products": lambda: raw("part").select(
            _text_id("P", "p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
        ),
        "product_category_translation": lambda: F.broadcast(
            literal_table(
                spark,
                CATEGORY_ENGLISH,
                "product_category_name",
                "product_category_name_english",
            )
        ),
        "customers": lambda: raw("customer").select(
            _text_id("C", "c_custkey").alias("customer_id"),
            _state(F.col("c_nationkey")).alias("customer_state"),
        ),
        "sellers": lambda: raw("supplier").select(
            _text_id("S", "s_suppkey").alias("seller_id"),
            _state(F.col("s_nationkey")).alias("seller_state"),
        ),
        "order_payments": lambda: raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("payment_type")
        ),
        "order_reviews": lambda: raw("orders").select(
            F.col("o_orderdate").alias("review_creation_date"),
            F.least(F.lit(5), 1 + F.floor(F.col("o_totalprice") / 100000))
            .cast("int")
            .alias("review_score"),
        ),
    }
    return Normalized(
        {
            name: (lambda name=name, make=make: conform(make(), NORMALIZED[name]))
            for name, make in derived.items()
        }
    )
