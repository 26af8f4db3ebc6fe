"""Leaderboards and the tiers given to their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions import as_double, non_blank, number_text
from martlens.model import Mart
from martlens.operators.joins import totals_by_label
from martlens.operators.period import ALL, Period, in_period
from martlens.operators.ranking import highest_first, ranked, tier, top_k
from martlens.sources.literals import benefit_of

_QTY = {"total_qty": ("sum", "jumlah")}
_REVENUE = {"total_revenue": ("sum", "total_harga")}


def top_items(m: Mart, p: Period = ALL, by: str = "product", k: int = 10) -> DataFrame:
    """Best sellers by quantity; any ``by`` other than category means product."""
    label = F.col("kategori_inggris") if by == "category" else F.col("produk_id")
    sold = in_period(m.fakta_penjualan, m.dim_waktu, p)
    totals = totals_by_label(sold, m.dim_produk, "produk_key", label, **_QTY)
    return top_k(totals, "total_qty", k)


def seller_totals(m: Mart, p: Period = ALL) -> DataFrame:
    sold = in_period(m.fakta_penjualan, m.dim_waktu, p)
    return totals_by_label(
        sold,
        m.dim_seller,
        "seller_key",
        F.col("seller_id"),
        **_QTY,
        **_REVENUE,
    )


def exact_top_sellers(m: Mart, p: Period = ALL, by: str = "qty", k: int = 10) -> DataFrame:
    """Sellers by quantity or revenue; a seller without a total comes last."""
    measure = "total_revenue" if by == "revenue" else "total_qty"
    return top_k(seller_totals(m, p), measure, k, nulls="last")


def top_sellers(m: Mart, p: Period = ALL, by: str = "qty", k: int = 10) -> DataFrame:
    measure = "total_revenue" if by == "revenue" else "total_qty"
    shown = F.coalesce(measure, F.lit(0))
    value = as_double(shown) if by == "revenue" else shown
    return exact_top_sellers(m, p, by, k).select("pos", "label", value.alias(measure))


def top_sellers_both(m: Mart, p: Period = ALL, k: int = 10) -> DataFrame:
    """Both seller rankings from one aggregate, whose shuffle is reused."""
    totals = seller_totals(m, p)
    rankings = [
        top_k(totals, measure, k, nulls="last").select(
            F.lit(measure).alias("ranking"),
            "pos",
            "label",
            "total_qty",
            as_double(F.col("total_revenue")).alias("total_revenue"),
        )
        for measure in ("total_qty", "total_revenue")
    ]
    return rankings[0].unionByName(rankings[1])


def customer_totals(m: Mart, p: Period = ALL) -> DataFrame:
    """Totals per customer id; unknown customers appear under their key."""
    sold = in_period(m.fakta_penjualan, m.dim_waktu, p)
    label = F.coalesce("pelanggan_id", F.col("pelanggan_key").cast("string"))
    return totals_by_label(
        sold,
        m.dim_pelanggan,
        "pelanggan_key",
        label,
        how="left",
        **_QTY,
        **_REVENUE,
    )


def exact_top_customers(m: Mart, p: Period = ALL, k: int = 10) -> DataFrame:
    return top_k(customer_totals(m, p), "total_revenue", k)


def top_customers(m: Mart, p: Period = ALL, k: int = 10) -> DataFrame:
    revenue = as_double(F.coalesce("total_revenue", F.lit(0)))
    return exact_top_customers(m, p, k).select("pos", "label", revenue.alias("total_revenue"))


def _positions(totals: DataFrame) -> DataFrame:
    shown = totals.select("label", "total_qty", F.col("total_revenue").alias("exact"))
    placed = ranked(shown, highest_first("exact"))
    revenue = as_double(F.coalesce("exact", F.lit(0))).alias("total_revenue")
    return placed.select("pos", "label", "total_qty", revenue)


def customer_positions(m: Mart, p: Period = ALL) -> DataFrame:
    """The place of every customer by revenue, not of the first ten only."""
    return _positions(customer_totals(m, p))


def seller_positions(m: Mart, p: Period = ALL) -> DataFrame:
    """The place of every seller by revenue."""
    return _positions(seller_totals(m, p))


def top_states(m: Mart, k: int = 5) -> DataFrame:
    """States with most customers, blank and unknown states left out."""
    counted = (
        m.dim_pelanggan.where(non_blank(F.col("state")))
        .groupBy(F.col("state").alias("label"))
        .agg(F.count(F.lit(1)).alias("total_customers"))
    )
    return top_k(counted, "total_customers", k)


def _segments(ranked: DataFrame, entity: str, id_column: str) -> DataFrame:
    revenue = F.coalesce("total_revenue", F.lit(0))
    return ranked.withColumn("tier", tier(F.col("pos"))).select(
        "pos",
        F.col("label").alias(id_column),
        "tier",
        "total_qty",
        as_double(F.col("total_revenue")).alias("total_revenue"),
        F.concat(F.lit("R$ "), number_text(revenue, 2)).alias("revenue_text"),
        benefit_of(entity, F.col("tier")).alias("benefit"),
    )


def segment_customers(m: Mart, p: Period = ALL) -> DataFrame:
    """Top 10 customers by revenue with tier and benefit."""
    return _segments(exact_top_customers(m, p), "customer", "pelanggan_id")


def segment_sellers(m: Mart, p: Period = ALL) -> DataFrame:
    """Top 10 sellers by revenue with tier and benefit; NULL totals first."""
    ranked = top_k(seller_totals(m, p), "total_revenue", 10)
    return _segments(ranked, "seller", "seller_id")
