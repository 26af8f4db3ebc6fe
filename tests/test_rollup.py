"""Sums and bitmaps that are stored once, and saving several tables together."""

from decimal import Decimal

import pytest
from conftest import day_row, plan_of, tuples
from pyspark.sql import functions as F

from martlens.operators.period import Period
from martlens.plans import kpis, series
from martlens.plans.activity import active_customers, activity_of
from martlens.plans.build import build_mart, open_mart, open_normalized
from martlens.plans.rollup import rollup_of
from martlens.sources import stored
from martlens.sources.stored import load_mart, load_published, publish_mart, save_mart

PERIODS = [Period(), Period(1997), Period(None, 3), Period(1997, 3)]


@pytest.mark.parametrize("period", PERIODS)
def test_questions_read_the_rollup_and_not_the_fact(spark, sf0001, period):
    m = open_mart(spark, sf0001)
    for ask in (series.sales_series, kpis.kpi_items_sold, lambda m, p: kpis.kpi_revenue(m, p.year)):
        plan = plan_of(ask(m, period))
        assert "sales_rollup" in plan and "order_lines" not in plan and "fakta" not in plan
    plan = plan_of(active_customers(m, period))
    assert "customer_activity" in plan and "order_lines" not in plan


def test_a_replaced_fact_is_not_answered_from_old_sums(spark, sf0001):
    m = open_mart(spark, sf0001)
    none = m.replace(fakta_penjualan=m.fakta_penjualan.limit(0))
    assert tuples(kpis.kpi_items_sold(none)) == [(0,)] == tuples(active_customers(none))
    assert m.replace(dim_seller=m.dim_seller).has("sales_rollup")


def test_dates_that_the_calendar_lacks_or_names_in_part(spark, make_mart):
    days = [day_row("2024-01-05"), (20240299, None, None, 2024), (7, None, 1, None)]
    rows = [(20240105, 1, 1, 1, 2, Decimal(3)), (20240299, 1, 1, 1, 5, None), (7, 1, 1, 1, None, Decimal(4)),
            (None, 1, 1, 1, 11, Decimal(5)), (99, 1, 1, 1, 13, Decimal(6))]
    m = make_mart(fakta_penjualan=rows, dim_waktu=days)
    found = {(r.grain, r.tahun, r.bulan): (r.revenue, r.qty) for r in rollup_of(m.fakta_penjualan, m.dim_waktu).collect()}
    assert found[("every", None, None)] == (Decimal(18), 31)
    assert found[("known", None, None)] == (Decimal(7), 7)
    assert found[("year", 2024, None)] == (Decimal(3), 7) and found[("year", None, None)] == (Decimal(4), None)
    assert found[("month", 2024, None)] == (None, 5) and found[("month", None, 1)] == (Decimal(4), None)
    assert len(found) == 1 + 1 + 2 + 3 + 3
    assert tuples(kpis.kpi_items_sold(m, Period(2024))) == [(7,)]


def test_bitmaps_count_as_count_distinct_does(spark):
    keys = [2**31, 2**31 + 1, 2**40, -1, -32768, -32769, -(2**40), 0, 1, 32768, 32769, 2**62, -(2**62)]
    days = [day_row("2024-01-05"), day_row("2024-02-05"), day_row("2025-01-05")]
    calendar = spark.createDataFrame(days, "waktu_id int, tanggal date, bulan int, tahun int")
    rows = [(days[(i + j) % 3][0], k) for i, k in enumerate(keys) for j in range(1 + i % 3)]
    rows += [(days[0][0], None), (None, 5), (days[1][0], 32768)]
    sales = spark.createDataFrame(rows, "waktu_id int, pelanggan_key long")
    bits = activity_of(sales, calendar)
    for p in (Period(), Period(2024), Period(None, 1), Period(2024, 2), Period(1990)):
        united = p.keep(bits).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        count = united.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
        want = p.keep(sales.join(calendar, "waktu_id")).agg(F.countDistinct("pelanggan_key")).first()[0]
        assert count == want, p


def test_saving_joins_the_order_lines_once(spark, sf0001, tmp_path, monkeypatch, all_tasks):
    m = build_mart(open_normalized(spark, sf0001))
    written = {}
    plain = stored.write_partitioned

    def seen(df, path, by=()):
        written[path.rsplit("/", 1)[1]] = plan_of(df)
        plain(df, path, by)

    monkeypatch.setattr(stored, "write_partitioned", seen)
    save_mart(m, str(tmp_path / "mart"))
    for name in ("fakta_penjualan", "fakta_pengiriman"):
        assert "Join" not in written[name] and "_staged/order_lines" in written[name]
    assert "Join" in plan_of(m.fakta_penjualan)
    assert len(list((tmp_path / "mart" / "_staged").iterdir())) == 1
    loaded = load_mart(spark, str(tmp_path / "mart"))
    assert loaded.has("sales_rollup") and loaded.has("customer_activity")
    opened = open_mart(spark, sf0001)
    for p in PERIODS:
        assert tuples(series.sales_series(loaded, p)) == tuples(series.sales_series(opened, p))
        assert tuples(active_customers(loaded, p)) == tuples(active_customers(opened, p))


def test_readers_see_one_version_of_all_tables(spark, make_normalized, tmp_path, monkeypatch):
    path = str(tmp_path / "marts")
    first = publish_mart(build_mart(make_normalized(customers=[("C1", "SP")])), path)
    assert load_published(spark, path).dim_pelanggan.count() == 1
    two = make_normalized(customers=[("C1", "SP"), ("C2", "SP")])
    plain = stored.write_partitioned

    def failing(df, to, by=()):
        if to.endswith("fakta_review"):
            raise OSError("disk")
        plain(df, to, by)

    monkeypatch.setattr(stored, "write_partitioned", failing)
    with pytest.raises(OSError, match="disk"):
        publish_mart(build_mart(two), path)
    assert load_published(spark, path).dim_pelanggan.count() == 1
    monkeypatch.undo()
    publish_mart(build_mart(two), path)
    assert load_published(spark, path).dim_pelanggan.count() == 2
    assert load_published(spark, path, first).dim_pelanggan.count() == 1
