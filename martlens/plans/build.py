"""Star build: five dimensions and four facts from the normalized tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions import elapsed_days
from martlens.model import PERIOD_COLUMNS, STAR, Mart, Normalized, conform
from martlens.operators.joins import translate_category
from martlens.operators.period import DATE_KEY
from martlens.plans.activity import activity_of
from martlens.plans.rollup import rollup_of
from martlens.session import once_per_session, shared_folder
from martlens.sources.keys import (
    CUSTOMERS,
    METHODS,
    PRODUCTS,
    SELLERS,
    HashedKeys,
    KeyDictionary,
    KeyForm,
)
from martlens.sources.raw import normalized_tables
from martlens.sources.stored import written_once

_BY_PERIOD = ("tahun", "bulan")
Keys = KeyDictionary | HashedKeys


class _Keyed:
    """Keys of one normalized model; each form's ids are learnt on first use."""

    def __init__(self, n: Normalized, keys: Keys | None = None):
        self._n, self._keys = n, keys
        self._learnt: set[str] = set()

    def _sources(self, form: KeyForm) -> list[DataFrame]:
        # Facts too: an id that its dimension lacks must not get another's key.
        n = self._n
        return {
            "pelanggan": lambda: [n.customers.select("customer_id"), n.orders.select("customer_id")],
            "produk": lambda: [n.products.select("product_id"), n.order_items.select("product_id")],
            "seller": lambda: [n.sellers.select("seller_id"), n.order_items.select("seller_id")],
            "metode": lambda: [n.order_payments.select("payment_type")],
        }[form.name]()

    def add(self, df: DataFrame, form: KeyForm, natural_id: str, key: str) -> DataFrame:
        """``df`` with ``key``; the natural id stays."""
        if self._keys is None:
            self._keys = _own_keys(df.sparkSession)
        if form.name not in self._learnt:
            self._keys.learn(form, *self._sources(form))
            self._learnt.add(form.name)
        return self._keys.keyed(df.withColumn("_id", F.col(natural_id)), form, "_id", key)


def _own_keys(spark: SparkSession) -> Keys:
    """A dictionary of this build's own; hashes where there is no folder for one."""
    folder = shared_folder(spark)
    if folder is None:
        return HashedKeys()
    application = spark.sparkContext.applicationId
    return KeyDictionary(spark, f"{folder}/martlens-{application}/keys-{uuid4().hex}")


def date_key(moment: Column) -> Column:
    """``yyyymmdd`` as an integer."""
    return F.year(moment) * 10000 + F.month(moment) * 100 + F.day(moment)


def dim_waktu(n: Normalized) -> DataFrame:
    """One row per calendar day on which something happened."""
    ordered = n.orders.select(F.col("order_purchase_timestamp").cast("date").alias("tanggal"))
    reviewed = n.order_reviews.select(F.col("review_creation_date").cast("date").alias("tanggal"))
    days = ordered.unionByName(reviewed).where(F.col("tanggal").isNotNull()).distinct()
    day = F.col("tanggal")
    return conform(
        days.select(
            date_key(day).alias("waktu_id"),
            day,
            F.month(day).alias("bulan"),
            F.year(day).alias("tahun"),
        ),
        STAR["dim_waktu"],
    )


def dim_pelanggan(n: Normalized, keyed: _Keyed) -> DataFrame:
    return keyed.add(n.customers, CUSTOMERS, "customer_id", "pelanggan_key").select(
        "pelanggan_key",
        F.col("customer_id").alias("pelanggan_id"),
        F.col("customer_state").alias("state"),
    )


def dim_produk(n: Normalized, keyed: _Keyed) -> DataFrame:
    translated = translate_category(n.products, n.product_category_translation)
    return keyed.add(translated, PRODUCTS, "product_id", "produk_key").select(
        "produk_key",
        F.col("product_id").alias("produk_id"),
        F.col("product_category_name").alias("kategori"),
        F.col("product_category_name_english").alias("kategori_inggris"),
    )


def dim_seller(n: Normalized, keyed: _Keyed) -> DataFrame:
    return keyed.add(n.sellers, SELLERS, "seller_id", "seller_key").select(
        "seller_key",
        "seller_id",
        F.col("seller_state").alias("state"),
    )


def dim_metode_pembayaran(n: Normalized, keyed: _Keyed) -> DataFrame:
    methods = n.order_payments.select(F.col("payment_type").alias("metode_pembayaran")).distinct()
    return keyed.add(methods, METHODS, "metode_pembayaran", "metode_key").select(
        "metode_key", "metode_pembayaran"
    )


def _dated(moment: str) -> list[Column]:
    when = F.col(moment)
    return [
        date_key(when).alias("waktu_id"),
        F.year(when).alias("tahun"),
        F.month(when).alias("bulan"),
    ]


def order_lines(n: Normalized, keyed: _Keyed | None = None) -> DataFrame:
    """Each order item with the keys, date and delivery time of its order.

    The one large join of the build. It is on the order id, unique on the
    order side; adaptive execution splits the item side of an order that holds
    a large part of all items. Items without an order keep NULL keys.
    """
    keyed = keyed or _Keyed(n)
    bought = F.col("order_purchase_timestamp")
    bought_by = keyed.add(n.orders, CUSTOMERS, "customer_id", "pelanggan_key")
    order_side = bought_by.select(
        "order_id",
        *_dated("order_purchase_timestamp"),
        "pelanggan_key",
        elapsed_days(bought, F.col("order_delivered_customer_date")).alias("durasi_pengiriman"),
    )
    items = keyed.add(n.order_items, PRODUCTS, "product_id", "produk_key")
    items = keyed.add(items, SELLERS, "seller_id", "seller_key")
    item_side = items.select("order_id", "produk_key", "seller_key", "quantity", "price")
    return item_side.join(order_side, "order_id", "left").drop("order_id")


def _fact(df: DataFrame, name: str) -> DataFrame:
    """The declared columns, year and month, and what the date key is made of."""
    return conform(df, f"{STAR[name]}, {PERIOD_COLUMNS}").withMetadata("waktu_id", DATE_KEY)


def fakta_penjualan(lines: DataFrame, qty_mode: str = "quantity") -> DataFrame:
    """One row per order item; ``qty_mode='unit'`` counts every item as one."""
    sold = F.col("quantity") if qty_mode == "quantity" else F.lit(1)
    sales = lines.withColumns({"jumlah": sold, "total_harga": F.col("price")})
    return _fact(sales, "fakta_penjualan")


def fakta_pengiriman(lines: DataFrame) -> DataFrame:
    """One row per item of a delivered order."""
    delivered = lines.where(F.col("durasi_pengiriman").isNotNull())
    return _fact(delivered, "fakta_pengiriman")


def fakta_pembayaran(n: Normalized, keyed: _Keyed) -> DataFrame:
    """One row per payment, dated by its order."""
    methods = keyed.add(n.order_payments, METHODS, "payment_type", "metode_key")
    dated = n.orders.select("order_id", *_dated("order_purchase_timestamp"))
    paid = methods.select("order_id", "metode_key").join(dated, "order_id", "left")
    return _fact(paid, "fakta_pembayaran")


def fakta_review(n: Normalized) -> DataFrame:
    reviews = n.order_reviews.select(
        F.col("review_score").alias("skor_review"), *_dated("review_creation_date")
    )
    return _fact(reviews, "fakta_review")


def build_mart(n: Normalized, qty_mode: str = "quantity", keys: Keys | None = None) -> Mart:
    """The whole star as lazy DataFrames over the normalized tables.

    Pass a ``KeyDictionary`` in a folder that stays, and later builds keep the
    keys of earlier ones; without it the keys are right within this mart only.
    """
    keyed = _Keyed(n, keys)

    def over(store: Callable[[str, DataFrame], DataFrame]) -> Mart:
        lines = cache(lambda: store("order_lines", order_lines(n, keyed)))
        sold = cache(lambda: fakta_penjualan(lines(), qty_mode))
        return Mart(
            {
                "dim_waktu": lambda: dim_waktu(n),
                "dim_pelanggan": lambda: dim_pelanggan(n, keyed),
                "dim_produk": lambda: dim_produk(n, keyed),
                "dim_seller": lambda: dim_seller(n, keyed),
                "dim_metode_pembayaran": lambda: dim_metode_pembayaran(n, keyed),
                "fakta_penjualan": sold,
                "fakta_pengiriman": lambda: fakta_pengiriman(lines()),
                "fakta_pembayaran": lambda: fakta_pembayaran(n, keyed),
                "fakta_review": lambda: fakta_review(n),
                "sales_rollup": lambda: rollup_of(sold(), dim_waktu(n)),
                "customer_activity": lambda: activity_of(sold(), dim_waktu(n)),
            },
            over,
        )

    return over(lambda name, table: table)


def open_normalized(spark: SparkSession, folder: str) -> Normalized:
    """Normalized tables over raw files, with the order table written once."""

    def opened() -> Normalized:
        n = normalized_tables(spark, folder)
        return n.replace(orders=lambda: written_once(spark, folder, "n_orders", lambda: n.orders))

    return once_per_session(spark, ("normalized", folder), opened)


def open_mart(spark: SparkSession, folder: str, qty_mode: str = "quantity") -> Mart:
    """The star over raw files, each table written once on first use.

    Sales and deliveries are two column subsets of the same joined order lines,
    so that join is run and stored once for both.
    """
    n = open_normalized(spark, folder)
    # Marts over one folder share their tables, so they share their keys.
    keyed = once_per_session(spark, ("keys", folder), lambda: _Keyed(n))

    def lines() -> DataFrame:
        return written_once(spark, folder, "order_lines", lambda: order_lines(n, keyed), _BY_PERIOD)

    def dim(name: str, make: Callable[..., DataFrame]) -> Callable[[], DataFrame]:
        return lambda: written_once(spark, folder, name, lambda: make(n, keyed))

    def fact(name: str, make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: written_once(spark, folder, name, make, _BY_PERIOD)

    def derived(name: str, make: Callable[..., DataFrame], files: int = 0) -> Callable[[], DataFrame]:
        def made() -> DataFrame:
            found = make(fakta_penjualan(lines(), qty_mode), tables["dim_waktu"]())
            return found.coalesce(files) if files else found

        return lambda: written_once(spark, folder, name, made)

    tables = {
        "dim_waktu": dim("dim_waktu", lambda n, _: dim_waktu(n)),
        "dim_pelanggan": dim("dim_pelanggan", dim_pelanggan),
        "dim_produk": dim("dim_produk", dim_produk),
        "dim_seller": dim("dim_seller", dim_seller),
        "dim_metode_pembayaran": dim("dim_metode_pembayaran", dim_metode_pembayaran),
        "fakta_penjualan": lambda: fakta_penjualan(lines(), qty_mode),
        "fakta_pengiriman": lambda: fakta_pengiriman(lines()),
        "fakta_pembayaran": fact("fakta_pembayaran", lambda: fakta_pembayaran(n, keyed)),
        "fakta_review": fact("fakta_review", lambda: fakta_review(n)),
        "sales_rollup": derived(f"sales_rollup_{qty_mode}", rollup_of, 1),
        "customer_activity": derived("customer_activity", activity_of),
    }
    return once_per_session(spark, ("mart", folder, qty_mode), lambda: Mart(tables))
