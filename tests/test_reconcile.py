import re
from datetime import datetime
from decimal import Decimal

from conftest import plan_of, tuples
from pyspark.sql import functions as F

from martlens.plans.build import open_mart, open_normalized
from martlens.plans.pairs import PAIRS
from martlens.plans.build import build_mart
from martlens.plans.reconcile import reconcile, reconcile_all, run_pair, summarize
from martlens.sources.stored import load_mart, load_normalized, save_mart

DIFFER = {"q04", "q16", "q17"}


def test_all_pairs_agree_but_those_that_cannot(spark, sf001):
    report = reconcile_all(open_normalized(spark, sf001), open_mart(spark, sf001, "unit"))
    rows = {row.pair: row for row in report.collect()}
    assert set(rows) == set(PAIRS)
    assert {name for name, row in rows.items() if not row.match} == DIFFER
    assert (rows["q01"].rows_normalized, rows["q01"].rows_star) == (80, 80)
    assert rows["q05"].value_normalized == rows["q05"].value_star == 1500.0
    assert rows["q16"].rows_star == 25


def test_eighteen_names_sixteen_questions():
    assert len(PAIRS) == 18
    assert len({(pair.normalized, pair.star) for pair in PAIRS.values()}) == 16


def test_quantities_differ_when_an_item_is_more_than_one(spark, sf0001):
    n, m = open_normalized(spark, sf0001), open_mart(spark, sf0001)
    row = reconcile(PAIRS["q08"], n, m).first()
    assert not row.match and row.delta > 0


def test_null_keys_meet(spark, sf001):
    cells = reconcile(PAIRS["q02"], open_normalized(spark, sf001), open_mart(spark, sf001, "unit"))
    nulls = [row for row in cells.collect() if row.key.endswith('"kategori":null}')]
    assert len(nulls) == 2 and all(row.match for row in nulls)


def test_one_sided_keys_are_reported(spark, sf0001):
    n, m = open_normalized(spark, sf0001), open_mart(spark, sf0001, "unit")
    cells = reconcile(PAIRS["q04"], n, m)
    assert {(row.in_normalized, row.in_star) for row in cells.collect()} == {
        (True, False), (False, True),
    }


def test_run_pair_reports_values_and_errors(spark, sf0001):
    n, m = open_normalized(spark, sf0001), open_mart(spark, sf0001, "unit")
    good = run_pair(PAIRS["q05"], n, m)
    assert good["value_normalized"] == good["value_star"] == 150
    assert good["error_star"] is None
    bad = run_pair(PAIRS["q05"], n, m.replace(dim_pelanggan=lambda: spark.table("gone")))
    assert bad["rows_star"] == 0 and "gone" in bad["error_star"]
    assert bad["value_normalized"] == 150


def test_day_sums_equal_month_sums(spark, sf001):
    from martlens.operators.period import Period
    from martlens.plans.series import sales_series

    m = open_mart(spark, sf001)
    days = tuples(sales_series(m, Period(1997, 3)))
    month = [row for row in tuples(sales_series(m, Period(1997))) if row[1] == "03"][0]
    assert round(sum(row[2] for row in days), 2) == month[2]
    assert sum(row[3] for row in days) == month[3]


def one_by_one(n, m) -> dict[str, tuple]:
    return {name: tuple(summarize(reconcile(pair, n, m), pair).first())[1:] for name, pair in PAIRS.items()}


def all_at_once(n, m) -> dict[str, tuple]:
    return {row.pair: tuple(row)[1:] for row in reconcile_all(n, m).collect()}


def test_one_pass_gives_what_single_comparisons_give(make_normalized):
    """NULL names, items without orders, orders without items or customers, ties beyond ten."""
    at = datetime
    n = make_normalized(
        orders=[(i, f"C{i % 13}" if i % 5 else None, at(2018, 1 + i % 12, 3, 10), at(2018, 12, 20) if i % 3 else None)
                for i in range(40)],
        order_items=[(i % 45, 1 + i // 45, f"P{i % 17}" if i % 11 else None, f"S{i % 14}", Decimal(i % 7) if i % 9 else None, 1 + i % 3)
                     for i in range(160)],
        products=[(f"P{i}", "ABC"[i % 3] if i % 4 else None) for i in range(14)],
        product_category_translation=[("A", "a"), ("B", "b")],
        customers=[(f"C{i}", ["SP", "SP ", "", None][i % 4]) for i in range(11)],
        sellers=[(f"S{i}", "RJ") for i in range(12)],
        order_payments=[(i % 40, ["x", "y", None][i % 3]) for i in range(50)],
        order_reviews=[(at(2017 + i % 3, 5, 1), i % 6 if i % 7 else None) for i in range(30)],
    )
    for mode in ("unit", "quantity"):
        m = build_mart(n, mode)
        assert all_at_once(n, m) == one_by_one(n, m)


def test_one_pass_over_nothing(make_normalized):
    n = make_normalized()
    m = build_mart(n)
    assert all_at_once(n, m) == one_by_one(n, m)
    assert all_at_once(n, m)["q12"] == (0, 0, None, None, 0, 0, 0.0, True)


def test_each_base_table_is_read_once(spark, sf0001, tmp_path):
    n = open_normalized(spark, sf0001)
    for name in n.names():
        n.table(name).write.parquet(str(tmp_path / "n" / name))
    save_mart(open_mart(spark, sf0001, "unit"), str(tmp_path / "m"))
    stored, mart = load_normalized(spark, str(tmp_path / "n")), load_mart(spark, str(tmp_path / "m"))
    report = reconcile_all(stored, mart)
    wide = "spark.sql.maxMetadataStringLength"
    spark.conf.set(wide, "100000")
    try:
        plan = plan_of(report)
    finally:
        spark.conf.unset(wide)
    read = sorted(re.findall(r"/([nm]/\w+)[],]", " ".join(re.findall(r"Location: \S+ ?paths?\)?\[[^]]*\]", plan))))
    assert len(read) == len(set(read)) and len(read) == 16
    assert {name for name, row in ((r.pair, r) for r in report.collect()) if not row.match} == DIFFER


def test_a_hot_order_and_a_hot_product_in_one_pass(spark, sf0001):
    """A third of all items of one order and one product: both ways agree."""
    n = open_normalized(spark, sf0001)
    items = n.order_items
    many = items.limit(1).crossJoin(spark.range(3000)).drop("id")
    hot = n.replace(order_items=items.unionByName(many.withColumn("price", F.lit(1.5).cast("decimal(18,2)"))))
    found = all_at_once(hot, build_mart(hot, "unit"))
    assert {name for name, row in found.items() if not row[-1]} == DIFFER
    assert found["q08"][2] == items.count() + 3000
