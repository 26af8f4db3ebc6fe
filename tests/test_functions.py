from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlens import functions as fx
from martlens.sources.literals import (
    benefit_of,
    month_names,
    state_coords,
)


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def ntz(text):
    return F.lit(datetime.fromisoformat(text)).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("start", "end", "days"),
    [
        ("2018-01-01T10:00", "2018-01-05T09:00", 3),
        ("2018-01-01T10:00", "2018-01-05T10:00", 4),
        ("2018-01-01T00:00", "2018-01-01T23:59", 0),
    ],
)
def test_elapsed_days_are_whole_days(spark, start, end, days):
    assert value(spark, fx.elapsed_days(ntz(start), ntz(end))) == days


@pytest.mark.parametrize(
    ("total", "n", "mean"), [(2345, 1000, "2.35"), (2344, 1000, "2.34"), (1, 3, "0.33")]
)
def test_means_round_half_up_exactly(spark, total, n, mean):
    found = value(spark, fx.mean_rounded(F.lit(total), F.lit(n)))
    assert found == Decimal(mean)


def test_mean_of_nothing_is_null(spark):
    assert value(spark, fx.mean_rounded(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize(
    ("part", "whole", "percent"), [(6994, 10000, "69.9"), (6995, 10000, "70.0"), (1, 3, "33.3")]
)
def test_percent_rounds_to_one_place(spark, part, whole, percent):
    assert value(spark, fx.percent_rounded(F.lit(part), F.lit(whole))) == Decimal(percent)


@pytest.mark.parametrize(
    ("number", "places", "text"),
    [
        (1234567.891, 2, "1.234.567,89"), (0.5, 0, "1"), (1.5, 0, "2"), (2.5, 0, "3"),
        (12, 0, "12"), (1000, 0, "1.000"), (0.0, 1, "0,0"), (Decimal("9.995"), 2, "10,00"),
    ],
)
def test_number_text(spark, number, places, text):
    assert value(spark, fx.number_text(F.lit(number), places)) == text


@pytest.mark.parametrize(
    ("label", "longest", "shown"),
    [("abcdefghij", 10, "abcdefghij"), ("abcdefghijk", 10, "abcdefgh…"), (None, 5, None)],
)
def test_short_label(spark, label, longest, shown):
    assert value(spark, fx.short_label(F.lit(label).cast("string"), longest)) == shown


def test_labels_skip_nulls(spark):
    nothing = F.lit(None).cast("int")
    assert value(spark, fx.year_month_label(nothing, F.lit(1))) == "-01"
    assert value(spark, fx.year_month_label(F.lit(1997), F.lit(11))) == "1997-11"
    assert value(spark, fx.day_label(F.lit(date(2024, 1, 5)))) == "5 Jan"


@pytest.mark.parametrize(("number", "nearest"), [(6.5, 7), (6.49, 6), (-0.5, 0), (18.0, 18)])
def test_half_up(spark, number, nearest):
    assert value(spark, fx.half_up(F.lit(number))) == nearest


@pytest.mark.parametrize(("ratio", "name"), [(0.66, "a"), (0.5, "b"), (0.33, "b"), (0.1, "c")])
def test_ratio_class(spark, ratio, name):
    assert value(spark, fx.ratio_class(F.lit(ratio), [(0.33, "b"), (0.66, "a")], "c")) == name


def test_literals(spark):
    assert state_coords(spark).count() == 27
    assert month_names(spark).count() == 12
    assert value(spark, benefit_of("seller", F.lit("Gold"))).startswith("Fee 0%")
