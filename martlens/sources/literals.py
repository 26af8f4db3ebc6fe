"""Small lookup tables that are part of the program, not of the data.

Each has a fixed number of rows, which is the proof that broadcasting it is
safe at any data size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Brazilian states with the coordinates and names shown on the map.
STATE_COORDS: list[tuple[str, float, float, str]] = [
    ("SP", -23.5505, -46.6333, "São Paulo"),
    ("RJ", -22.9068, -43.1729, "Rio de Janeiro"),
    ("MG", -19.9167, -43.9345, "Minas Gerais"),
    ("RS", -30.0346, -51.2177, "Rio Grande do Sul"),
    ("PR", -25.4284, -49.2733, "Paraná"),
    ("SC", -27.5954, -48.5480, "Santa Catarina"),
    ("BA", -12.9714, -38.5014, "Bahia"),
    ("DF", -15.7801, -47.9292, "Distrito Federal"),
    ("GO", -16.6869, -49.2648, "Goiás"),
    ("PE", -8.0476, -34.8770, "Pernambuco"),
    ("CE", -3.7172, -38.5433, "Ceará"),
    ("PA", -1.4558, -48.4902, "Pará"),
    ("MA", -2.5307, -44.3068, "Maranhão"),
    ("ES", -20.3155, -40.3088, "Espírito Santo"),
    ("MT", -15.6014, -56.0979, "Mato Grosso"),
    ("MS", -20.4483, -54.6326, "Mato Grosso do Sul"),
    ("AM", -3.1190, -60.0217, "Amazonas"),
    ("RN", -5.7945, -35.2110, "Rio Grande do Norte"),
    ("PB", -7.1195, -36.8235, "Paraíba"),
    ("AL", -9.5713, -36.7820, "Alagoas"),
    ("SE", -10.9472, -37.0731, "Sergipe"),
    ("PI", -5.0920, -42.8038, "Piauí"),
    ("RO", -8.7612, -63.9020, "Rondônia"),
    ("TO", -10.1753, -48.2982, "Tocantins"),
    ("AC", -9.9740, -67.8076, "Acre"),
    ("AP", 0.9020, -52.0030, "Amapá"),
    ("RR", 2.8235, -60.6758, "Roraima"),
]

# Month names, January to December.
MONTH_NAMES: list[str] = [
    "Januari",
    "Februari",
    "Maret",
    "April",
    "Mei",
    "Juni",
    "Juli",
    "Agustus",
    "September",
    "Oktober",
    "November",
    "Desember",
]

# What each tier earns.
TIER_BENEFITS: dict[str, dict[str, str]] = {
    "customer": {
        "Gold": "Cashback 15%, VIP Treatment, Exclusive Access",
        "Silver": "Cashback 10%, Early Access",
        "Bronze": "Cashback 5%, Birthday Discount",
    },
    "seller": {
        "Gold": "Fee 0%, Premium Support, Featured Placement",
        "Silver": "Fee 5%, Priority Support",
        "Bronze": "Fee 10%, Standard Support",
    },
}


def literal_table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """Rows of the program as a local relation: no partitions, no tasks to read it."""
    columns = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table([list(column) for column in columns], names=list(names)))


def state_coords(spark: SparkSession) -> DataFrame:
    """State code, latitude, longitude and name; 27 rows."""
    return literal_table(spark, STATE_COORDS, "state", "lat", "lng", "nama")


def month_names(spark: SparkSession) -> DataFrame:
    """Month number and name; 12 rows."""
    names = literal_table(spark, list(enumerate(MONTH_NAMES, 1)), "bulan", "nama_bulan")
    return names.withColumn("bulan", F.col("bulan").cast("int"))


def benefit_of(entity: str, tier: Column) -> Column:
    """The benefit of a tier for ``customer`` or ``seller``."""
    pairs = [F.lit(text) for pair in TIER_BENEFITS[entity].items() for text in pair]
    return F.element_at(F.create_map(*pairs), tier)
