"""What the plans must look like, and that hot keys are split."""

from datetime import date
from decimal import Decimal

import pytest
from conftest import plan_of
from oracle_check import connect, difference
from pyspark.sql import functions as F

from martlens.registry import all_queries
from martlens_oracle import oracle_queries
from martlens.model import NORMALIZED
from martlens.operators.period import Period, in_period
from martlens.plans import leaders
from martlens.plans.build import open_mart, open_normalized, order_lines
from martlens.plans.pairs import PAIRS
from martlens.sources.raw import normalized_tables
from martlens.sources.stored import load_mart, save_mart, write_partitioned

QUERIES = all_queries()


def executed(df) -> str:
    """The plan that adaptive execution ended with."""
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def initial(df) -> str:
    return plan_of(df)


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_join(spark, sf0001, name):
    plan = initial(QUERIES[name](spark, sf0001))
    for word in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct"):
        assert word not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_k_takes_instead_of_sorting(spark, sf0001):
    plan = executed(leaders.top_items(open_mart(spark, sf0001)))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_dates_are_broadcast_after_a_size_check(spark, sf0001):
    m = open_mart(spark, sf0001)
    assert "BroadcastHashJoin [waktu_id" in executed(leaders.top_items(m))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(leaders.top_items(m))
        assert "BroadcastHashJoin [waktu_id" not in plan and "SortMergeJoin [waktu_id" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_needed_columns_and_partitions_are_read(spark, sf0001):
    plan = initial(QUERIES["top_products_ym"](spark, sf0001))
    scan = next(line for line in plan.splitlines() if "produk_key" in line and "FileScan" in line)
    assert "ReadSchema: struct<produk_key:bigint,quantity:int,waktu_id:int>" in scan
    assert "(tahun" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_facts_meet_a_dimension_as_sums_per_key(spark, sf0001):
    plan = initial(leaders.top_items(open_mart(spark, sf0001), by="category"))
    above, below = plan.split("Join [produk_key", 1)
    assert "keys=[produk_key" in below and "keys=[produk_key" not in above


def test_no_hint_forces_a_broadcast(spark, sf0001):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("top_categories_all", "q02_s", "q14_s", "segment_sellers_y"):
            assert "BroadcastHashJoin" not in executed(QUERIES[name](spark, sf0001)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_planning_runs_no_job(spark, sf0001):
    names = [n for n in QUERIES if n.endswith(("_all", "_ym", "_n", "_s"))]
    for name in names:
        QUERIES[name](spark, sf0001)  # opens the tables
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    asked = {}
    try:
        for name in names:
            spark.sparkContext.setJobGroup(f"planning {name}", "a plan over opened tables")
            QUERIES[name](spark, sf0001)
            asked[name] = len(jobs(f"planning {name}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not {name for name, count in asked.items() if count}


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    ["top_products_y", "top_categories_all", "top_customers_all", "segment_sellers_ym",
     "payment_methods_y", "delivery_by_state_all", "delivery_by_category_ym",
     "q02_n", "q02_s", "q04_n", "q04_s", "q11_s", "q12_s", "q13_s", "q14_s", "q16_n", "q16_s"],
)
def test_large_dimensions_give_the_same_rows(spark, sf001, no_broadcast, name):
    difference_found = difference(
        QUERIES[name](spark, sf001), connect(sf001), oracle_queries()[name]
    )
    assert difference_found is None


def test_a_hot_product_is_one_row_per_task_at_the_join(spark, sf0001, no_broadcast):
    """A third of all sales on one product: the join's shuffle carries sums only."""
    m = open_mart(spark, sf0001)
    sales = m.fakta_penjualan
    many = sales.limit(200).crossJoin(spark.range(100)).drop("id")
    hot = many.withColumn("produk_key", F.lit(1).cast("long")).select(*sales.columns)
    both = m.replace(fakta_penjualan=sales.unionByName(hot))
    found = {r.label: r.total_qty for r in leaders.top_items(both, by="category", k=100).collect()}
    plain = {r.label: r.total_qty for r in leaders.top_items(m, by="category", k=100).collect()}
    more = hot.agg(F.sum("jumlah")).first()[0]
    assert sum(found.values()) == sum(plain.values()) + more
    plan = executed(leaders.top_items(both, by="category"))
    assert "partial_sum" in plan.split("Join [produk_key")[1]


def pushed(df) -> list[str]:
    """What the scans of a plan were given to skip by."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = df._jdf.queryExecution().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    lines = [line for line in plan.splitlines() if "PushedFilters: [" in line]
    return [line.split("PushedFilters: [")[1].split("ReadSchema")[0] for line in lines]


@pytest.mark.parametrize(
    ("period", "key", "moment"),
    [
        (Period(1997), ("19970100", "19980100"), ("1997-01-01", "1998-01-01")),
        (Period(1997, 12), ("19971200", "19980100"), ("1997-12-01", "1998-01-01")),
        (Period(None, 3), ("19990300", "19990400"), ("1999-03-01", "1999-04-01")),
    ],
)
def test_period_spans_reach_the_files(spark, sf0001, tmp_path, period, key, moment):
    save_mart(open_mart(spark, sf0001), str(tmp_path / "flat"), partitioned=False)
    flat = load_mart(spark, str(tmp_path / "flat"), partitioned=False)
    sales = in_period(flat.fakta_penjualan, flat.dim_waktu, period)
    spans = next(p for p in pushed(sales) if "waktu_id" in p and "Than" in p)
    assert f"GreaterThanOrEqual(waktu_id,{key[0]})" in spans and f"LessThan(waktu_id,{key[1]})" in spans
    m = open_mart(spark, sf0001)
    kept = [(d.fakta_penjualan, d.dim_waktu) for d in (m, flat)]
    assert len({in_period(f, days, period).agg(F.count("*"), F.sum("total_harga")).first() for f, days in kept}) == 1
    orders = open_normalized(spark, sf0001).orders
    found = period.keep_moments(orders, "order_purchase_timestamp")
    spans = pushed(found)[0]
    name = "order_purchase_timestamp"
    assert f"GreaterThanOrEqual({name},{moment[0]}T00:00)" in spans and f"LessThan({name},{moment[1]}T00:00)" in spans
    tests = [F.year(name) == period.year] if period.year else []
    tests += [F.month(name) == period.month] if period.month else []
    want = orders
    for test in tests:
        want = want.where(test)
    assert found.count() == want.count() > 0


def test_a_key_that_is_no_date_is_left_to_the_calendar(make_mart):
    """Only keys that are marked as dates are compared with spans."""
    m = make_mart(
        dim_waktu=[(1, date(1997, 3, 1), 3, 1997), (2, date(1998, 3, 1), 3, 1998)],
        fakta_review=[(1, 5), (2, 4)],
    )
    assert in_period(m.fakta_review, m.dim_waktu, Period(1997)).count() == 1


def test_years_beyond_the_spans_are_kept(spark):
    rows = [(y * 10000 + 305,) for y in (1, 1899, 1989, 1990, 2049, 2050, 9998)]
    days = spark.createDataFrame(rows, "k int")
    assert Period(None, 3).keep_keys(days, "k").count() == 7
    assert Period(None, 13).keep_keys(days, "k").count() == 0
    assert Period(123456).keep_keys(days, "k").count() == 7
    moments = days.selectExpr("to_date(lpad(k, 8, '0'), 'yyyyMMdd') AS d")
    assert Period(None, 3).keep_moments(moments, "d").count() == 7
    assert Period(None, 4).keep_moments(moments, "d").count() == 0
    assert Period(1899).keep_moments(moments, "d").count() == 1
    assert Period(123456).keep_moments(moments, "d").count() == 0


def test_unused_delivery_date_costs_no_join(spark, sf0001):
    orders = normalized_tables(spark, sf0001).orders.select("order_id", "customer_id")
    assert "Join" not in initial(orders)


def test_seller_boards_share_one_aggregate(spark, sf0001):
    assert "ReusedExchange" in executed(leaders.top_sellers_both(open_mart(spark, sf0001)))


def test_windows_stay_above_aggregates(spark, sf0001):
    for name in ("rating_by_month_all", "segment_customers_all", "insight_customer_all"):
        plan = initial(QUERIES[name](spark, sf0001))
        below = plan.rsplit("Window [", 1)[1]
        assert "HashAggregate" in below


@pytest.fixture
def tight_memory(spark):
    """Thresholds at which a small hot key already counts as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.fixture
def one_hot_order(spark, sf0001, tmp_path):
    """The real tables plus many more items, all on one order."""
    n = open_normalized(spark, sf0001)
    n_items = 100000
    hot = spark.range(0, n_items, 1, 8).selectExpr(
        "0L AS order_id", "cast(id AS int) AS order_item_id", "concat('P', id % 200) AS product_id",
        "'S1' AS seller_id", "cast(1.5 AS decimal(18,2)) AS price", "1 AS quantity",
    )
    path = str(tmp_path / "items")
    n.order_items.repartition(8).unionByName(hot).write.parquet(path)
    items = spark.read.schema(NORMALIZED["order_items"]).parquet(path)
    return n.replace(order_items=items), n_items


def test_a_hot_order_is_split_in_the_build(spark, sf0001, one_hot_order, tight_memory):
    n, n_items = one_hot_order
    lines = order_lines(n).select("produk_key", "waktu_id", "price", "seller_key")
    assert "skew=true" in executed(lines)
    assert lines.count() == n_items + open_normalized(spark, sf0001).order_items.count()


def test_a_hot_order_is_split_in_the_category_pair(spark, one_hot_order, tight_memory):
    n, _ = one_hot_order
    assert "skew=true" in executed(PAIRS["q04"].normalized(n))


def test_a_hot_order_is_summed_before_it_is_joined(spark, one_hot_order, tight_memory):
    n, n_items = one_hot_order
    cold = n.replace(order_items=n.order_items.where("NOT (order_id = 0 AND price = 1.50)"))
    ask = PAIRS["q01"].normalized
    total, plain = (sum(row.total_revenue for row in ask(side).collect()) for side in (n, cold))
    assert round(total - plain, 2) == float(Decimal("1.50") * n_items)


def test_a_hot_month_becomes_many_files(spark, tmp_path, tight_memory):
    rows = spark.range(0, 200000, 1, 8).selectExpr(
        "id", "uuid() AS payload", "2024 AS tahun", "if(id % 10 = 0, 2, 1) AS bulan"
    )
    path = tmp_path / "fact"
    write_partitioned(rows, str(path), ("tahun", "bulan"))
    hot = list((path / "tahun=2024" / "bulan=1").glob("*.parquet"))
    assert len(hot) > 4
    assert spark.read.parquet(str(path)).count() == 200000
