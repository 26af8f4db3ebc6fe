"""Both models as common table expressions over the raw tables."""

from __future__ import annotations

import re

# The mapping of the raw tables onto the models.
_STATES = (
    "['SP','RJ','MG','RS','PR','SC','BA','DF','GO','PE','CE','PA','MA','ES','MT','MS','AM',"
    "'RN','PB','AL','SE','SP ','',NULL,'XX']"
)

_COORDS = """VALUES
    ('SP', -23.5505, -46.6333, 'São Paulo'),
    ('RJ', -22.9068, -43.1729, 'Rio de Janeiro'),
    ('MG', -19.9167, -43.9345, 'Minas Gerais'),
    ('RS', -30.0346, -51.2177, 'Rio Grande do Sul'),
    ('PR', -25.4284, -49.2733, 'Paraná'),
    ('SC', -27.5954, -48.5480, 'Santa Catarina'),
    ('BA', -12.9714, -38.5014, 'Bahia'),
    ('DF', -15.7801, -47.9292, 'Distrito Federal'),
    ('GO', -16.6869, -49.2648, 'Goiás'),
    ('PE', -8.0476, -34.8770, 'Pernambuco'),
    ('CE', -3.7172, -38.5433, 'Ceará'),
    ('PA', -1.4558, -48.4902, 'Pará'),
    ('MA', -2.5307, -44.3068, 'Maranhão'),
    ('ES', -20.3155, -40.3088, 'Espírito Santo'),
    ('MT', -15.6014, -56.0979, 'Mato Grosso'),
    ('MS', -20.4483, -54.6326, 'Mato Grosso do Sul'),
    ('AM', -3.1190, -60.0217, 'Amazonas'),
    ('RN', -5.7945, -35.2110, 'Rio Grande do Norte'),
    ('PB', -7.1195, -36.8235, 'Paraíba'),
    ('AL', -9.5713, -36.7820, 'Alagoas'),
    ('SE', -10.9472, -37.0731, 'Sergipe'),
    ('PI', -5.0920, -42.8038, 'Piauí'),
    ('RO', -8.7612, -63.9020, 'Rondônia'),
    ('TO', -10.1753, -48.2982, 'Tocantins'),
    ('AC', -9.9740, -67.8076, 'Acre'),
    ('AP', 0.9020, -52.0030, 'Amapá'),
    ('RR', 2.8235, -60.6758, 'Roraima')"""

_MONTHS = """VALUES
    (1, 'Januari'), (2, 'Februari'), (3, 'Maret'), (4, 'April'), (5, 'Mei'), (6, 'Juni'),
    (7, 'Juli'), (8, 'Agustus'), (9, 'September'), (10, 'Oktober'), (11, 'November'),
    (12, 'Desember')"""

_BENEFITS = """VALUES
    ('customer', 'Gold', 'Cashback 15%, VIP Treatment, Exclusive Access'),
    ('customer', 'Silver', 'Cashback 10%, Early Access'),
    ('customer', 'Bronze', 'Cashback 5%, Birthday Discount'),
    ('seller', 'Gold', 'Fee 0%, Premium Support, Featured Placement'),
    ('seller', 'Silver', 'Fee 5%, Priority Support'),
    ('seller', 'Bronze', 'Fee 10%, Standard Support')"""

_TABLES: dict[str, str] = {
    "last_ship": "SELECT l_orderkey AS k, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1",
    "n_orders": """
        SELECT o_orderkey AS order_id, 'C' || o_custkey AS customer_id,
               o_orderdate AS order_purchase_timestamp,
               CASE WHEN shipped >= o_orderdate THEN shipped END AS order_delivered_customer_date
        FROM orders LEFT JOIN last_ship ON k = o_orderkey""",
    "n_order_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
               'P' || l_partkey AS product_id, 'S' || l_suppkey AS seller_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
               CAST(trunc(l_quantity) AS INTEGER) AS quantity
        FROM lineitem""",
    "n_products": """
        SELECT 'P' || p_partkey AS product_id, p_type AS product_category_name FROM part""",
    "n_product_category_translation": """
        SELECT * FROM (VALUES ('ECONOMY','economy'), ('STANDARD','standard'), ('PROMO','promo'),
                              ('SMALL','small'), ('MEDIUM','medium'))
               t(product_category_name, product_category_name_english)""",
    "n_customers": f"""
        SELECT 'C' || c_custkey AS customer_id,
               ({_STATES})[c_nationkey + 1] AS customer_state FROM customer""",
    "n_order_payments": """
        SELECT o_orderkey AS order_id, o_orderpriority AS payment_type FROM orders""",
    "n_order_reviews": """
        SELECT o_orderdate AS review_creation_date,
               CAST(least(5, 1 + floor(o_totalprice / 100000)) AS INTEGER) AS review_score
        FROM orders""",
    "dim_waktu": """
        SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS waktu_id,
               CAST(o_orderdate AS DATE) AS tanggal,
               CAST(month(o_orderdate) AS INTEGER) AS bulan,
               CAST(year(o_orderdate) AS INTEGER) AS tahun
        FROM orders""",
    "dim_pelanggan": f"""
        SELECT c_custkey AS pelanggan_key, 'C' || c_custkey AS pelanggan_id,
               ({_STATES})[c_nationkey + 1] AS state FROM customer""",
    "dim_produk": """
        SELECT p_partkey AS produk_key, 'P' || p_partkey AS produk_id, p_type AS kategori,
               CASE WHEN p_type <> 'LARGE' THEN lower(p_type) END AS kategori_inggris
        FROM part""",
    "dim_seller": f"""
        SELECT s_suppkey AS seller_key, 'S' || s_suppkey AS seller_id,
               ({_STATES})[s_nationkey + 1] AS state FROM supplier""",
    "dim_metode_pembayaran": """
        SELECT DISTINCT CAST(left(o_orderpriority, 1) AS INTEGER) AS metode_key,
               o_orderpriority AS metode_pembayaran FROM orders""",
    "fakta_penjualan": """
        SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS waktu_id,
               o_custkey AS pelanggan_key, l_partkey AS produk_key, l_suppkey AS seller_key,
               CAST(trunc(l_quantity) AS INTEGER) AS jumlah,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS total_harga
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "fakta_pengiriman": """
        SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS waktu_id,
               o_custkey AS pelanggan_key, l_partkey AS produk_key,
               CAST(datesub('day', o_orderdate, shipped) AS INTEGER) AS durasi_pengiriman
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN last_ship ON k = o_orderkey
        WHERE shipped >= o_orderdate""",
    "fakta_pembayaran": """
        SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS waktu_id,
               CAST(left(o_orderpriority, 1) AS INTEGER) AS metode_key FROM orders""",
    "fakta_review": """
        SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS waktu_id,
               CAST(least(5, 1 + floor(o_totalprice / 100000)) AS INTEGER) AS skor_review
        FROM orders""",
    "state_coords": f"""
        SELECT state, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, nama
        FROM ({_COORDS}) t(state, lat, lng, nama)""",
    "month_names": f"SELECT * FROM ({_MONTHS}) t(bulan, nama_bulan)",
    "benefits": f"SELECT * FROM ({_BENEFITS}) t(entity, tier, benefit)",
}


def _needed(sql: str) -> list[str]:
    """The tables a text names, each after those it is made from."""
    found: list[str] = []
    for name, body in _TABLES.items():
        if re.search(rf"\b{name}\b", sql):
            found += [table for table in [*_needed(body), name] if table not in found]
    return found


def with_tables(sql: str, **extra: str) -> str:
    """A complete query: model tables in use, then ``extra`` steps, then ``sql``."""
    everything = " ".join([*extra.values(), sql])
    steps = {name: _TABLES[name] for name in _needed(everything)} | extra
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in steps.items())
    return f"WITH {ctes}\n{sql.strip()}" if ctes else sql.strip()
