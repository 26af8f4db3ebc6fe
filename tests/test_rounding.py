"""Rounded quotients against exact arithmetic."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from martlens.functions import mean_rounded, number_text, percent_rounded


def half_up(value: Fraction, places: int) -> Decimal:
    unit = 10**places
    doubled = 2 * value * unit + 1
    return Decimal(doubled.numerator // (2 * doubled.denominator)).scaleb(-places)


def pairs(n: int) -> list[tuple[int, int]]:
    chance = random.Random(42)
    found = []
    for _ in range(n):
        whole = chance.randint(1, 10 ** chance.randint(1, 12))
        found.append((chance.randint(0, 5 * whole), whole))
    # Exact ties, and the closest values on either side of them.
    for whole in (200, 2000, 2_000_000, 200_000_000_000):
        for part in (whole // 200, 3 * whole // 200, 5 * whole // 200):
            found += [(part, whole), (part - 1, whole), (part + 1, whole)]
    return found


def test_quotients(spark):
    given = pairs(3000)
    df = spark.createDataFrame(given, "part long, whole long")
    rows = df.select(
        "part",
        "whole",
        mean_rounded(F.col("part"), F.col("whole")).alias("mean"),
        percent_rounded(F.col("part"), F.col("whole")).alias("percent"),
    ).collect()
    assert len(rows) == len(given)
    for row in rows:
        ratio = Fraction(row.part, row.whole)
        assert row["mean"] == half_up(ratio, 2)
        assert row["percent"] == half_up(100 * ratio, 1)


def test_number_text(spark):
    chance = random.Random(7)
    given = [Decimal(chance.randint(0, 10**12)).scaleb(-3) for _ in range(2000)]
    df = spark.createDataFrame([(value,) for value in given], "value decimal(18,3)")
    for row in df.select("value", number_text(F.col("value"), 2).alias("text")).collect():
        rounded = row.value.quantize(Decimal("0.01"), ROUND_HALF_UP)
        swapped = f"{rounded:,.2f}".translate(str.maketrans(",.", ".,"))
        assert row.text == swapped
