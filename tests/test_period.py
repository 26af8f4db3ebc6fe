import pytest
from conftest import day_row, tuples

from martlens.operators.period import Period, in_period
from martlens.plans import kpis, series


@pytest.mark.parametrize(
    ("raw", "parsed"),
    [
        (None, None), ("", None), ("0", None), (0, None), ("abc", None), ("1997", 1997),
        (1997, 1997), ("1997x", 1997), ("  12", 12), ("3.9", 3), ("1e3", 1000), ("-5", -5),
        ("x1997", None), (".5", None),
        ("9" * 5000, 2**63 - 1), ("1e400", 2**63 - 1), ("-1e400", 1 - 2**63),
    ],
)
def test_parameters_are_read_as_leading_numbers(raw, parsed):
    assert Period.of(raw).year == parsed


@pytest.mark.parametrize(
    ("period", "grain"),
    [
        (Period(), "year_month"), (Period(1997), "month"), (Period(None, 3), "year"),
        (Period(1997, 3), "day"),
    ],
)
def test_grain_follows_the_filter(period, grain):
    assert period.grain == grain


SALES = [
    (20240105, 1, 1, 1, 2, 10),
    (20240105, 1, 1, 1, 1, 5),
    (20240210, 1, 1, 1, 3, 20),
    (20250110, 1, 1, 1, 4, 40),
    (19000101, 1, 1, 1, 7, 100),
]
DAYS = [day_row("2024-01-05"), day_row("2024-02-10"), day_row("2025-01-10")]


@pytest.fixture
def mart(make_mart):
    from decimal import Decimal

    rows = [(*row[:5], Decimal(row[5])) for row in SALES]
    return make_mart(fakta_penjualan=rows, dim_waktu=DAYS)


def test_unknown_dates_drop_out_of_everything_but_unfiltered_revenue(mart):
    assert in_period(mart.fakta_penjualan, mart.dim_waktu).count() == 4
    assert tuples(kpis.kpi_items_sold(mart)) == [(10,)]
    assert tuples(kpis.kpi_revenue(mart)) == [(175.0,)]
    assert tuples(kpis.kpi_revenue(mart, 2024)) == [(35.0,)]


def test_month_does_not_narrow_revenue_on_the_sheet(mart):
    row = kpis.kpi_sheet(mart, Period(2024, 2)).first()
    assert (row.items_sold, row.total_revenue) == (3, 35.0)


@pytest.mark.parametrize(
    ("period", "expected"),
    [
        (Period(), [(1, "2024-01", 15.0, 3), (2, "2024-02", 20.0, 3), (3, "2025-01", 40.0, 4)]),
        (Period(2024), [(1, "01", 15.0, 3), (2, "02", 20.0, 3)]),
        (Period(None, 1), [(1, "2024", 15.0, 3), (2, "2025", 40.0, 4)]),
        (Period(2024, 1), [(1, "5 Jan", 15.0, 3)]),
        (Period(2024, 13), []),
        (Period(1990), []),
        (Period.of("1e400"), []),
    ],
)
def test_sales_series(mart, period, expected):
    assert tuples(series.sales_series(mart, period)) == expected


def test_empty_period_and_empty_table(mart):
    assert tuples(kpis.kpi_items_sold(mart, Period(1990))) == [(0,)]
    assert tuples(kpis.kpi_revenue(mart, 1990)) == [(0.0,)]
    assert tuples(kpis.kpi_avg_delivery(mart)) == [(None,)]


def test_filter_choices(mart):
    assert tuples(kpis.available_years(mart)) == [(2025,), (2024,)]
    assert tuples(kpis.available_months(mart, 2024)) == [(1,), (2,)]
    assert tuples(kpis.month_options(mart)) == [(1, "Januari"), (2, "Februari")]


def test_partition_columns_are_filtered_and_hidden(mart):
    from pyspark.sql import functions as F

    fact = mart.fakta_penjualan.withColumns(
        {"tahun": F.expr("waktu_id div 10000").cast("int"), "bulan": F.lit(1)}
    )
    joined = in_period(fact, mart.dim_waktu, Period(2025))
    assert joined.columns.count("tahun") == 1
    assert joined.count() == 1
