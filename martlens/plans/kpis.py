"""Headline figures and the choices offered by the period filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions import as_double, mean_rounded
from martlens.model import Mart
from martlens.operators.period import ALL, Period
from martlens.plans.rollup import EVERY, sums_of
from martlens.sources.literals import month_names


def available_years(m: Mart) -> DataFrame:
    return m.dim_waktu.select("tahun").distinct().orderBy(F.col("tahun").desc_nulls_first())


def available_months(m: Mart, year: int | None = None) -> DataFrame:
    days = Period.of(year).keep(m.dim_waktu)
    return days.select("bulan").distinct().orderBy(F.col("bulan").asc_nulls_last())


def month_options(m: Mart, year: int | None = None) -> DataFrame:
    """The months to choose from, with their names."""
    months = available_months(m, year)
    names = F.broadcast(month_names(m.dim_waktu.sparkSession))
    return months.join(names, "bulan", "left").orderBy(F.col("bulan").asc_nulls_last())


def kpi_customers(m: Mart) -> DataFrame:
    return m.dim_pelanggan.agg(F.count(F.lit(1)).alias("total_customers"))


def kpi_products(m: Mart) -> DataFrame:
    return m.dim_produk.agg(F.count(F.lit(1)).alias("total_products"))


def kpi_categories(m: Mart) -> DataFrame:
    """Native categories, NULL not counted."""
    return m.dim_produk.agg(F.countDistinct("kategori").alias("total_categories"))


def kpi_items_sold(m: Mart, p: Period = ALL) -> DataFrame:
    return sums_of(m, p).agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("items_sold"))


def kpi_revenue(m: Mart, year: int | None = None) -> DataFrame:
    """Revenue of a year, or of every sale; a month never narrows it.

    Without a year no date is looked up, so sales of unknown date count too.
    """
    p = Period.of(year)
    total = F.coalesce(F.sum("revenue"), F.lit(0))
    sums = sums_of(m, p) if p.year else sums_of(m, grain=EVERY)
    return sums.agg(as_double(total).alias("total_revenue"))


def kpi_avg_delivery(m: Mart) -> DataFrame:
    """Mean delivery days over everything; NULL when nothing was delivered."""
    days = F.col("durasi_pengiriman")
    mean = mean_rounded(F.sum(days), F.count(days))
    return m.fakta_pengiriman.agg(as_double(mean).alias("avg_delivery_days"))


def kpi_sheet(m: Mart, p: Period = ALL) -> DataFrame:
    """All six figures in one row, each its own scalar subquery."""
    figures = [
        kpi_customers(m),
        kpi_products(m),
        kpi_categories(m),
        kpi_items_sold(m, p),
        kpi_revenue(m, p.year),
        kpi_avg_delivery(m),
    ]
    one_row = m.dim_waktu.sparkSession.range(1)
    return one_row.select(*[figure.scalar().alias(figure.columns[0]) for figure in figures])
