"""Distinct customers of a period, from bitmaps per month that are united on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.model import Mart
from martlens.operators.period import ALL, Period, in_period


def activity_of(sales: DataFrame, dim_waktu: DataFrame) -> DataFrame:
    """(tahun, bulan, bucket, bits): one bit per customer that bought in a month.

    A bucket is 32,768 neighbouring keys, so bitmaps suit the dense keys of the
    key dictionary: 4 KB stand for that many customers. Negative keys and keys
    of any size have buckets too. Sales are reduced to one row per month and
    customer before a bitmap is made; a sale without a customer has no bit.
    """
    bought = in_period(sales.select("waktu_id", "pelanggan_key"), dim_waktu)
    once = bought.where("pelanggan_key is not null").select("tahun", "bulan", "pelanggan_key").distinct()
    key = F.col("pelanggan_key")
    bucket = F.bitmap_bucket_number(key).alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits")
    return once.groupBy("tahun", "bulan", bucket).agg(bits)


def customer_activity(m: Mart) -> DataFrame:
    """The mart's bitmaps: stored ones, or worked out from its sales."""
    if m.has("customer_activity"):
        return m.customer_activity
    return activity_of(m.fakta_penjualan, m.dim_waktu)


def active_customers(m: Mart, p: Period = ALL) -> DataFrame:
    """How many different customers bought something in a period; exact.

    Months are united bucket by bucket, so a customer of several months
    counts once; no fact is read where the bitmaps are stored.
    """
    united = p.keep(customer_activity(m)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counted = F.sum(F.bitmap_count("bits"))
    return united.agg(F.coalesce(counted, F.lit(0)).alias("active_customers"))
