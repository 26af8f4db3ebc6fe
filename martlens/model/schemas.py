"""Declared schemas of both models, and the checks made against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table and column names of the star model.
STAR: dict[str, str] = {
    "dim_waktu": "waktu_id int, tanggal date, bulan int, tahun int",
    "dim_pelanggan": "pelanggan_key long, pelanggan_id string, state string",
    "dim_produk": "produk_key long, produk_id string, kategori string, kategori_inggris string",
    "dim_seller": "seller_key long, seller_id string, state string",
    "dim_metode_pembayaran": "metode_key int, metode_pembayaran string",
    "fakta_penjualan": (
        "waktu_id int, pelanggan_key long, produk_key long, seller_key long, "
        "jumlah int, total_harga decimal(18,2)"
    ),
    "fakta_pengiriman": (
        "waktu_id int, pelanggan_key long, produk_key long, durasi_pengiriman int"
    ),
    "fakta_pembayaran": "waktu_id int, metode_key int",
    "fakta_review": "waktu_id int, skor_review int",
}

# The key each dimension is joined on; one row per value.
STAR_KEYS: dict[str, str] = {
    "dim_waktu": "waktu_id",
    "dim_pelanggan": "pelanggan_key",
    "dim_produk": "produk_key",
    "dim_seller": "seller_key",
    "dim_metode_pembayaran": "metode_key",
}

# Facts may also carry the year and month of their date as partition columns.
PERIOD_COLUMNS: str = "tahun int, bulan int"

# Table and column names of the normalized model. `quantity` and
# the payment's `order_id` are what the star build needs on top.
NORMALIZED: dict[str, str] = {
    "orders": (
        "order_id long, customer_id string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz"
    ),
    "order_items": (
        "order_id long, order_item_id int, product_id string, seller_id string, "
        "price decimal(18,2), quantity int"
    ),
    "products": "product_id string, product_category_name string",
    "product_category_translation": (
        "product_category_name string, product_category_name_english string"
    ),
    "customers": "customer_id string, customer_state string",
    "sellers": "seller_id string, seller_state string",
    "order_payments": "order_id long, payment_type string",
    "order_reviews": "review_creation_date timestamp_ntz, review_score int",
}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project ``df`` to the declared columns and types, in order.

    Raises on a missing column; a column already of the right type is left as
    it is, so pruning and pushdown still reach the scan.
    """
    schema = T.StructType.fromDDL(ddl)
    missing = [field.name for field in schema if field.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def checked(df: DataFrame, ddl: str, where: str) -> DataFrame:
    """The declared columns of a stored table, in order; raises where one is missing or mistyped."""
    schema = T.StructType.fromDDL(ddl)
    found = {field.name: field.dataType for field in df.schema}
    wrong = [
        f"{f.name}: {found[f.name].simpleString() if f.name in found else 'missing'}"
        f" instead of {f.dataType.simpleString()}"
        for f in schema
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError(f"{where}: {'; '.join(wrong)}")
    return df.select(*schema.names)


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once; empty for a sound dimension."""
    counted = dim.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") > 1)
