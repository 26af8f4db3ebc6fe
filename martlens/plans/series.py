"""Series over time and distributions over a dimension attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions import as_double, day_label, mean_rounded, year_month_label, zero_padded
from martlens.model import Mart
from martlens.operators.joins import totals_by_label
from martlens.operators.period import ALL, Period, in_period
from martlens.operators.ranking import highest_first, positioned
from martlens.plans.rollup import sums_of


def _series_key(p: Period) -> tuple[list[str], Column]:
    """The columns one point is grouped by, and its label."""
    return {
        "day": (["tanggal"], day_label(F.col("tanggal"))),
        "month": (["bulan"], zero_padded(F.col("bulan"))),
        "year": (["tahun"], F.col("tahun").cast("string")),
        "year_month": (["tahun", "bulan"], year_month_label(F.col("tahun"), F.col("bulan"))),
    }[p.grain]


def sales_points(m: Mart, p: Period = ALL) -> DataFrame:
    """Exact revenue and quantity per point, numbered in time order.

    The calendar bounds the number of points, so numbering them is cheap.
    """
    keys, label = _series_key(p)
    # A point is a row of the rollup at the grain of the series.
    sums = sums_of(m, p, "day" if p.grain == "day" else "month")
    in_time = [F.col(key).asc_nulls_last() for key in keys]
    return positioned(sums, in_time).select("pos", label.alias("label"), "revenue", "qty")


def sales_series(m: Mart, p: Period = ALL) -> DataFrame:
    """Sales by day, month, year or year-month, whichever the filter leaves."""
    return (
        sales_points(m, p)
        .select(
            "pos",
            "label",
            as_double(F.coalesce("revenue", F.lit(0))).alias("revenue"),
            F.coalesce("qty", F.lit(0)).alias("qty"),
        )
        .orderBy("pos")
    )


def payment_methods(m: Mart, p: Period = ALL) -> DataFrame:
    """Payments per method, most used first."""
    paid = in_period(m.fakta_pembayaran, m.dim_waktu, p)
    counted = totals_by_label(
        paid,
        m.dim_metode_pembayaran,
        "metode_key",
        F.col("metode_pembayaran"),
        jumlah=("count", "*"),
    )
    return counted.orderBy(*highest_first("jumlah")).withColumnRenamed(
        "label", "metode_pembayaran"
    )


def _delivery_means(m: Mart, p: Period, dim: str, key: str, label: str) -> DataFrame:
    delivered = in_period(m.fakta_pengiriman, m.dim_waktu, p)
    sums = totals_by_label(
        delivered,
        m.table(dim),
        key,
        F.col(label),
        days=("sum", "durasi_pengiriman"),
        timed=("count", "durasi_pengiriman"),
        shipments=("count", "*"),
    )
    mean = mean_rounded(F.col("days"), F.col("timed"))
    return sums.select("label", "shipments", mean.alias("avg_delivery_days")).orderBy(
        *highest_first("avg_delivery_days")
    )


def exact_delivery_by_state(m: Mart, p: Period = ALL) -> DataFrame:
    """Slowest state first; means as exact decimals."""
    return _delivery_means(m, p, "dim_pelanggan", "pelanggan_key", "state")


def exact_delivery_by_category(m: Mart, p: Period = ALL) -> DataFrame:
    """Slowest English category first; means as exact decimals."""
    return _delivery_means(m, p, "dim_produk", "produk_key", "kategori_inggris")


def delivery_by_state(m: Mart, p: Period = ALL) -> DataFrame:
    return exact_delivery_by_state(m, p).select(
        F.col("label").alias("state"),
        as_double(F.col("avg_delivery_days")).alias("avg_delivery_days"),
    )


def delivery_by_category(m: Mart, p: Period = ALL) -> DataFrame:
    return exact_delivery_by_category(m, p).select(
        F.col("label").alias("kategori"),
        "shipments",
        as_double(F.col("avg_delivery_days")).alias("avg_delivery_days"),
    )


def rating_points(m: Mart, p: Period, by: str) -> DataFrame:
    """Exact mean rating per ``year`` or ``month``, numbered in time order.

    Reviews are summed per integer year and month; only those few sums get a
    text label.
    """
    keys = ["tahun"] if by == "year" else ["tahun", "bulan"]
    year, month = F.col("tahun"), F.col("bulan")
    label = year.cast("string") if by == "year" else year_month_label(year, month)
    dated = in_period(m.fakta_review, m.dim_waktu, p)
    partial = dated.groupBy(*keys).agg(
        F.sum("skor_review").alias("score"), F.count("skor_review").alias("scored")
    )
    means = partial.groupBy(label.alias("label")).agg(
        mean_rounded(F.sum("score"), F.sum("scored")).alias("avg_rating")
    )
    return positioned(means, [F.col("label").asc_nulls_last()])


def _ratings(points: DataFrame) -> DataFrame:
    rating = as_double(F.col("avg_rating")).alias("avg_rating")
    return points.select("pos", "label", rating).orderBy("pos")


def rating_by_year(m: Mart, p: Period = ALL) -> DataFrame:
    return _ratings(rating_points(m, p, "year"))


def rating_by_month(m: Mart, p: Period = ALL) -> DataFrame:
    return _ratings(rating_points(m, p, "month"))
