"""Eighteen questions, each asked of the normalized and of the star model.

Both sides return the same column names; ``keys`` identify a row and
``measures`` are compared by the reconciliation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions import as_double, elapsed_days, mean_rounded
from martlens.model import Mart, Normalized
from martlens.operators.joins import per_key, totals_by_label, translate_category
from martlens.operators.period import ALL, Period, in_period
from martlens.operators.ranking import highest_first


@dataclass(frozen=True)
class Pair:
    name: str
    question: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    normalized: Callable[[Normalized], DataFrame]
    star: Callable[[Mart], DataFrame]


def _count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _latest_first() -> list[Column]:
    return [F.col("tahun").desc_nulls_first(), F.col("bulan").desc_nulls_first()]


# Revenue per year and month. Items are summed per order before they meet it.


def revenue_by_month(n: Normalized, p: Period = ALL) -> DataFrame:
    """Revenue of the orders of a period; other orders are not read where files tell."""
    spent = per_key(n.order_items, "order_id", total_revenue=("sum", "price"))
    bought = F.col("order_purchase_timestamp")
    dated = p.keep_moments(n.orders, "order_purchase_timestamp").select(
        "order_id", F.year(bought).alias("tahun"), F.month(bought).alias("bulan")
    )
    sums = spent.join(dated, "order_id").groupBy("tahun", "bulan")
    return sums.agg(F.sum("total_revenue").alias("total_revenue")).orderBy(*_latest_first())


def _revenue_by_month_s(m: Mart) -> DataFrame:
    sums = in_period(m.fakta_penjualan, m.dim_waktu).groupBy("tahun", "bulan")
    return sums.agg(F.sum("total_harga").alias("total_revenue")).orderBy(*_latest_first())


# Quantity and revenue per English category, over all dates.


def _translated(n: Normalized) -> DataFrame:
    return translate_category(n.products, n.product_category_translation)


def _sales_by_category_n(n: Normalized) -> DataFrame:
    sums = totals_by_label(
        n.order_items,
        _translated(n),
        "product_id",
        F.col("product_category_name_english"),
        total_qty=("count", "order_item_id"),
        total_revenue=("sum", "price"),
    ).withColumnRenamed("label", "kategori")
    return sums.orderBy(*highest_first("total_revenue", "kategori"))


def _sales_by_category_s(m: Mart) -> DataFrame:
    sums = totals_by_label(
        m.fakta_penjualan,
        m.dim_produk,
        "produk_key",
        F.col("kategori_inggris"),
        total_qty=("sum", "jumlah"),
        total_revenue=("sum", "total_harga"),
    ).withColumnRenamed("label", "kategori")
    return sums.orderBy(*highest_first("total_revenue", "kategori"))


# Customers per state; blank and unknown states are states here.


def _customers_by_state(df: DataFrame, state: str, name: str, k: int | None = None) -> DataFrame:
    counted = df.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias(name))
    ordered = counted.orderBy(*highest_first(name, "state"))
    return ordered if k is None else ordered.limit(k)


# Mean delivery days. The means are unrounded quotients of exact sums.


def delivered() -> tuple[Column, Column]:
    """Whether an order has arrived, and after how many days."""
    arrival = F.col("order_delivered_customer_date")
    return arrival.isNotNull(), elapsed_days(F.col("order_purchase_timestamp"), arrival)


def _delivered(n: Normalized) -> DataFrame:
    arrived, days = delivered()
    return n.orders.where(arrived).select("order_id", "customer_id", days.alias("days"))


def _slowest_first(sums: DataFrame, label: str) -> DataFrame:
    mean = as_double(F.col("days")) / F.when(F.col("timed") > 0, F.col("timed"))
    return sums.select(F.col("label").alias(label), mean.alias("avg_delivery_days")).orderBy(
        *highest_first("avg_delivery_days", label)
    )


def _delivery_by_category_n(n: Normalized) -> DataFrame:
    items = n.order_items.select("order_id", "product_id").join(_delivered(n), "order_id")
    sums = totals_by_label(
        items,
        _translated(n),
        "product_id",
        F.col("product_category_name_english"),
        days=("sum", "days"),
        timed=("count", "days"),
    )
    return _slowest_first(sums, "kategori")


def _delivery_s(m: Mart, dim: str, key: str, label: str, name: str) -> DataFrame:
    sums = totals_by_label(
        m.fakta_pengiriman,
        m.table(dim),
        key,
        F.col(label),
        days=("sum", "durasi_pengiriman"),
        timed=("count", "durasi_pengiriman"),
    )
    return _slowest_first(sums, name)


def _delivery_by_category_s(m: Mart) -> DataFrame:
    # The star side names the native category, the normalized side the English.
    return _delivery_s(m, "dim_produk", "produk_key", "kategori", "kategori")


def _delivery_by_state_n(n: Normalized) -> DataFrame:
    # One row per order here, one per item on the star side.
    sums = totals_by_label(
        _delivered(n),
        n.customers,
        "customer_id",
        F.col("customer_state"),
        days=("sum", "days"),
        timed=("count", "days"),
    )
    return _slowest_first(sums, "state")


def _delivery_by_state_s(m: Mart) -> DataFrame:
    return _delivery_s(m, "dim_pelanggan", "pelanggan_key", "state", "state")


# Single figures.


def _product_count_n(n: Normalized) -> DataFrame:
    return n.products.agg(F.countDistinct("product_id").alias("total_produk"))


def _category_count_n(n: Normalized) -> DataFrame:
    english = F.countDistinct("product_category_name_english")
    return _translated(n).agg(english.alias("total_kategori"))


def _category_count_s(m: Mart) -> DataFrame:
    return m.dim_produk.agg(F.countDistinct("kategori_inggris").alias("total_kategori"))


def _items_sold_s(m: Mart) -> DataFrame:
    return m.fakta_penjualan.agg(F.sum("jumlah").alias("total_produk_terjual"))


def _total_revenue(df: DataFrame, price: str) -> DataFrame:
    return df.agg(F.sum(price).alias("total_revenue"))


# Payment methods.


def _payments_n(n: Normalized) -> DataFrame:
    counted = n.order_payments.groupBy(F.col("payment_type").alias("metode_pembayaran")).agg(
        F.count(F.lit(1)).alias("jumlah_penggunaan")
    )
    return counted.orderBy(*highest_first("jumlah_penggunaan", "metode_pembayaran"))


def _payments_s(m: Mart) -> DataFrame:
    counted = totals_by_label(
        m.fakta_pembayaran,
        m.dim_metode_pembayaran,
        "metode_key",
        F.col("metode_pembayaran"),
        jumlah_penggunaan=("count", "*"),
    ).withColumnRenamed("label", "metode_pembayaran")
    return counted.orderBy(*highest_first("jumlah_penggunaan", "metode_pembayaran"))


# Top 10 products, sellers and customers.


def _top(df: DataFrame, label: str, measure: str) -> DataFrame:
    named = df.withColumnRenamed("label", label)
    return named.orderBy(*highest_first(measure, label)).limit(10)


def _top_products_n(n: Normalized) -> DataFrame:
    return _top(
        per_key(n.order_items, "product_id", jumlah_terjual=("count", "*")),
        "product_id",
        "jumlah_terjual",
    )


def _top_products_s(m: Mart) -> DataFrame:
    sums = totals_by_label(
        m.fakta_penjualan,
        m.dim_produk,
        "produk_key",
        F.col("produk_id"),
        jumlah_terjual=("sum", "jumlah"),
    )
    return _top(sums, "product_id", "jumlah_terjual")


def _top_sellers_n(n: Normalized) -> DataFrame:
    sums = per_key(n.order_items, "seller_id", total_revenue=("sum", "price"))
    return _top(sums, "seller_id", "total_revenue")


def _top_sellers_s(m: Mart) -> DataFrame:
    sums = totals_by_label(
        m.fakta_penjualan,
        m.dim_seller,
        "seller_key",
        F.col("seller_id"),
        total_revenue=("sum", "total_harga"),
    )
    return _top(sums, "seller_id", "total_revenue")


def _top_customers_n(n: Normalized) -> DataFrame:
    sums = totals_by_label(
        n.order_items,
        n.orders.select("order_id", "customer_id"),
        "order_id",
        F.col("customer_id"),
        total_revenue=("sum", "price"),
    )
    return _top(sums, "customer_id", "total_revenue")


def _top_customers_s(m: Mart) -> DataFrame:
    sums = totals_by_label(
        m.fakta_penjualan,
        m.dim_pelanggan,
        "pelanggan_key",
        F.col("pelanggan_id"),
        total_revenue=("sum", "total_harga"),
    )
    return _top(sums, "customer_id", "total_revenue")


# Mean rating per year.


def _ratings(df: DataFrame, score: str) -> DataFrame:
    mean = mean_rounded(F.sum(score), F.count(score))
    means = df.groupBy("tahun").agg(as_double(mean).alias("rata_rata_rating"))
    return means.orderBy(F.col("tahun").asc_nulls_last())


def _ratings_n(n: Normalized) -> DataFrame:
    dated = n.order_reviews.withColumn("tahun", F.year("review_creation_date"))
    return _ratings(dated, "review_score")


def _ratings_s(m: Mart) -> DataFrame:
    return _ratings(in_period(m.fakta_review, m.dim_waktu), "skor_review")


_MONTHLY = (("tahun", "bulan"), ("total_revenue",), revenue_by_month, _revenue_by_month_s)
_BY_CATEGORY = (
    ("kategori",),
    ("avg_delivery_days",),
    _delivery_by_category_n,
    _delivery_by_category_s,
)

PAIRS: dict[str, Pair] = {
    pair.name: pair
    for pair in [
        Pair("q01", "Revenue per year and month", *_MONTHLY),
        Pair(
            "q02",
            "Quantity and revenue per category",
            ("kategori",),
            ("total_qty", "total_revenue"),
            _sales_by_category_n,
            _sales_by_category_s,
        ),
        Pair(
            "q03",
            "Customers per state",
            ("state",),
            ("total_customers",),
            lambda n: _customers_by_state(n.customers, "customer_state", "total_customers"),
            lambda m: _customers_by_state(m.dim_pelanggan, "state", "total_customers"),
        ),
        Pair("q04", "Mean delivery days per category", *_BY_CATEGORY),
        Pair(
            "q05",
            "Customers",
            (),
            ("total_pelanggan",),
            lambda n: _count_rows(n.customers, "total_pelanggan"),
            lambda m: _count_rows(m.dim_pelanggan, "total_pelanggan"),
        ),
        Pair(
            "q06",
            "Products",
            (),
            ("total_produk",),
            _product_count_n,
            lambda m: _count_rows(m.dim_produk, "total_produk"),
        ),
        Pair("q07", "Categories", (), ("total_kategori",), _category_count_n, _category_count_s),
        Pair(
            "q08",
            "Items sold",
            (),
            ("total_produk_terjual",),
            lambda n: _count_rows(n.order_items, "total_produk_terjual"),
            _items_sold_s,
        ),
        Pair(
            "q09",
            "Revenue",
            (),
            ("total_revenue",),
            lambda n: _total_revenue(n.order_items, "price"),
            lambda m: _total_revenue(m.fakta_penjualan, "total_harga"),
        ),
        Pair("q10", "Revenue over time", *_MONTHLY),
        Pair(
            "q11",
            "Payment methods by use",
            ("metode_pembayaran",),
            ("jumlah_penggunaan",),
            _payments_n,
            _payments_s,
        ),
        Pair(
            "q12",
            "Top 10 products",
            ("product_id",),
            ("jumlah_terjual",),
            _top_products_n,
            _top_products_s,
        ),
        Pair(
            "q13",
            "Top 10 sellers by revenue",
            ("seller_id",),
            ("total_revenue",),
            _top_sellers_n,
            _top_sellers_s,
        ),
        Pair(
            "q14",
            "Top 10 customers by revenue",
            ("customer_id",),
            ("total_revenue",),
            _top_customers_n,
            _top_customers_s,
        ),
        Pair(
            "q15",
            "Top 5 states by customers",
            ("state",),
            ("total_pelanggan",),
            lambda n: _customers_by_state(n.customers, "customer_state", "total_pelanggan", 5),
            lambda m: _customers_by_state(m.dim_pelanggan, "state", "total_pelanggan", 5),
        ),
        Pair(
            "q16",
            "Mean delivery days per state",
            ("state",),
            ("avg_delivery_days",),
            _delivery_by_state_n,
            _delivery_by_state_s,
        ),
        Pair("q17", "Mean delivery days per category, again", *_BY_CATEGORY),
        Pair(
            "q18",
            "Mean rating per year",
            ("tahun",),
            ("rata_rata_rating",),
            _ratings_n,
            _ratings_s,
        ),
    ]
}
