"""Sales per day, month and year, stored once and read by every question that sums them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.model import Mart
from martlens.operators.joins import per_key
from martlens.operators.period import ALL, Period

#: Grains of the rollup, finest first, and the columns that name a point of each.
GRAINS: dict[str, list[str]] = {
    "day": ["tahun", "bulan", "tanggal"],
    "month": ["tahun", "bulan"],
    "year": ["tahun"],
    "known": [],
}
#: The grain of all sales, those of unknown date included.
EVERY = "every"


def rollup_of(sales: DataFrame, dim_waktu: DataFrame) -> DataFrame:
    """(grain, tahun, bulan, tanggal, revenue, qty): sums at every grain of the calendar.

    The fact is read once and summed per date key, which the calendar bounds;
    the grouping sets run over those sums. A date that the calendar lacks
    counts at the grain ``every`` only.
    """
    per_day = per_key(sales, "waktu_id", revenue=("sum", "total_harga"), qty=("sum", "jumlah"))
    days = dim_waktu.select("waktu_id", "tahun", "bulan", "tanggal", F.lit(True).alias("known"))
    dated = per_day.join(days, "waktu_id", "left")
    # Whether a day is known is grouped by in every set but that of all sales.
    names = ["tahun", "bulan", "tanggal"]
    sets = [["known", *columns] for columns in GRAINS.values()] + [[]]
    ids = {
        sum(1 << (3 - i) for i, name in enumerate(["known", *names]) if name not in columns): grain
        for columns, grain in zip(sets, [*GRAINS, EVERY], strict=True)
    }
    sums = dated.groupingSets(sets, "known", *names).agg(
        F.grouping_id().alias("id"), F.sum("revenue").alias("revenue"), F.sum("qty").alias("qty")
    )
    grain = F.lit(None).cast("string")
    for number, name in ids.items():
        grain = F.when(F.col("id") == number, name).otherwise(grain)
    named = sums.withColumn("grain", grain)
    return named.where(F.col("known") | (F.col("grain") == EVERY)).select(
        "grain", *names, "revenue", "qty"
    )


def sales_rollup(m: Mart) -> DataFrame:
    """The mart's rollup: its stored one, or one that is worked out from its sales."""
    if m.has("sales_rollup"):
        return m.sales_rollup
    return rollup_of(m.fakta_penjualan, m.dim_waktu)


def grain_of(p: Period) -> str:
    """The coarsest grain whose rows tell whether they are of the period."""
    if p.month:
        return "month"
    return "year" if p.year else "known"


def sums_of(m: Mart, p: Period = ALL, grain: str | None = None) -> DataFrame:
    """The rollup's rows of a period at a grain, by default the coarsest that answers it."""
    rows = sales_rollup(m).where(F.col("grain") == (grain or grain_of(p)))
    return p.keep(rows).drop("grain")

