from dataclasses import replace
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F

from martlens import session
from martlens.model import STAR, STAR_KEYS, Mart, conform, duplicate_keys
from martlens.operators.period import Period, in_period
from martlens.plans import kpis, leaders
from martlens.plans.build import build_mart, open_mart, order_lines
from martlens.plans.geo import state_distribution
from martlens.plans.pairs import PAIRS
from martlens.plans.panels import run_panels
from martlens.plans.reconcile import reconcile
from martlens.plans.series import payment_methods
from martlens.sinks import state_document, write_json
from martlens.sources.stored import (
    load_mart,
    load_normalized,
    mart_from_catalog,
    register_views,
    resolve_table,
    save_mart,
)


def test_golden_numbers(spark, sf001):
    m = open_mart(spark, sf001)
    sums = [F.count(F.lit(1)), F.sum("jumlah"), F.sum("total_harga")]
    for period, expected in [
        (Period(), (60000, 1524135, Decimal("3183256271.63"))),
        (Period(1997), (9080, 228614, Decimal("479037332.79"))),
        (Period(1997, 3), (680, 17000, Decimal("35697938.86"))),
    ]:
        sold = in_period(m.fakta_penjualan, m.dim_waktu, period)
        assert tuples(sold.agg(*sums)) == [expected]
    days = F.col("durasi_pengiriman")
    assert tuples(m.fakta_pengiriman.agg(F.count(days), F.min(days), F.max(days))) == [
        (50182, 0, 2478)
    ]
    assert m.dim_waktu.count() == 2399
    best = [(1, "P555", 1346), (2, "P436", 1299), (3, "P817", 1283)]
    assert tuples(leaders.top_items(m))[:3] == best
    assert [r[1] for r in tuples(leaders.top_states(m))] == ["MG", "AL", "DF", "PA", "CE"]


def test_dimension_keys_are_unique(spark, sf001):
    m = open_mart(spark, sf001)
    for name, key in STAR_KEYS.items():
        assert duplicate_keys(m.table(name), key).count() == 0


def test_duplicate_keys_are_found(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert tuples(duplicate_keys(df, "k")) == [(1, 2)]


def test_conform_names_missing_columns(spark):
    with pytest.raises(ValueError, match="tanggal"):
        conform(spark.createDataFrame([(1,)], "waktu_id int"), STAR["dim_waktu"])


@pytest.fixture
def shop(make_normalized):
    at = datetime
    return make_normalized(
        orders=[
            (1, "C1", at(2018, 1, 1, 10), at(2018, 1, 5, 9)),
            (2, "C2", at(2018, 2, 1, 10), None),
        ],
        order_items=[
            (1, 1, "P1", "S1", Decimal("10.00"), 2),
            (1, 2, "P2", "S1", Decimal("5.00"), 1),
            (2, 1, "P1", "S1", Decimal("10.00"), 4),
            (9, 1, "P1", "S1", Decimal("1.00"), 1),
        ],
        products=[("P1", "A"), ("P2", "B")],
        product_category_translation=[("A", "a")],
        customers=[("C1", "SP"), ("C2", None)],
        sellers=[("S1", "RJ")],
        order_payments=[(1, "1-CARD"), (2, "2-CASH"), (2, "1-CARD")],
        order_reviews=[(at(2018, 3, 1, 8), 4)],
    )


def test_star_build(shop):
    m = build_mart(shop)
    sold = tuples(m.fakta_penjualan.orderBy("waktu_id", "produk_key"))
    assert sold == [
        (None, None, 1, 1, 1, Decimal("1.00"), None, None),
        (20180101, 1, 1, 1, 2, Decimal("10.00"), 2018, 1),
        (20180101, 1, 2, 1, 1, Decimal("5.00"), 2018, 1),
        (20180201, 2, 1, 1, 4, Decimal("10.00"), 2018, 2),
    ]
    assert {r[3] for r in tuples(m.fakta_pengiriman)} == {3}
    assert m.fakta_pengiriman.count() == 2
    assert sorted(r[0] for r in tuples(m.dim_waktu)) == [20180101, 20180201, 20180301]
    assert sorted(tuples(m.dim_produk)) == [(1, "P1", "A", "a"), (2, "P2", "B", None)]
    assert sorted(tuples(m.dim_metode_pembayaran)) == [(1, "1-CARD"), (2, "2-CASH")]
    assert m.fakta_pembayaran.count() == 3


def test_unit_mode_counts_items(shop):
    assert {r.jumlah for r in build_mart(shop, "unit").fakta_penjualan.collect()} == {1}


def test_saved_mart_is_partitioned_and_pruned(spark, shop, tmp_path):
    path = str(tmp_path / "mart")
    save_mart(build_mart(shop), path)
    m = load_mart(spark, path)
    assert (tmp_path / "mart" / "fakta_penjualan" / "tahun=2018" / "bulan=2").is_dir()
    assert tuples(kpis.kpi_items_sold(m, Period(2018, 2))) == [(4,)]
    assert tuples(kpis.kpi_revenue(m)) == [(26.0,)]
    sold = in_period(m.fakta_penjualan, m.dim_waktu, Period(2018, 2)).select("jumlah")
    assert "(tahun" in plan_of(sold).split("PartitionFilters: [")[1].split("]")[0]


def test_normalized_round_trip(spark, shop, tmp_path):
    for name in shop.names():
        shop.table(name).write.parquet(str(tmp_path / name))
    n = load_normalized(spark, str(tmp_path))
    assert n.order_items.count() == 4
    assert build_mart(n).fakta_pengiriman.count() == 2


def test_catalog_mart_takes_either_seller_table(spark, shop):
    m = build_mart(shop)
    register_views(m)
    try:
        assert state_distribution(mart_from_catalog(spark), "seller").count() == 1
        spark.catalog.dropTempView("dim_seller")
        with pytest.raises(ValueError, match="dim_penjual"):
            _ = mart_from_catalog(spark).dim_seller
        m.dim_seller.createOrReplaceTempView("dim_penjual")
        assert state_distribution(mart_from_catalog(spark), "seller").count() == 1
        m.dim_seller.limit(0).createOrReplaceTempView("dim_seller")
        assert resolve_table(spark, "dim_seller", "dim_penjual").count() == 0
    finally:
        for name in [*m.names(), "dim_penjual"]:
            spark.catalog.dropTempView(name)


def test_normalized_views_have_their_own_prefix(spark, shop):
    register_views(shop)
    assert spark.sql("SELECT count(*) FROM n_orders").first()[0] == 2
    for name in shop.names():
        spark.catalog.dropTempView(f"n_{name}")


def test_without_a_shared_folder_the_mart_is_lazy_and_equal(spark, sf0001, monkeypatch):
    from martlens.sources import stored

    monkeypatch.setattr(stored, "shared_folder", lambda spark: None)
    monkeypatch.setattr(session, "_remembered", {})
    lazy = open_mart(spark, sf0001)
    assert not lazy.fakta_penjualan.inputFiles()[0].count("martlens-")
    mine = tuples(leaders.top_items(lazy))
    monkeypatch.undo()
    assert mine == tuples(leaders.top_items(open_mart(spark, sf0001)))


def test_tables_are_written_once(spark, sf0001):
    first = open_mart(spark, sf0001).dim_produk
    assert open_mart(spark, sf0001).dim_produk is first
    assert "martlens-" in first.inputFiles()[0]


def test_sessions_of_one_application_do_not_share_paths(spark, sf0001):
    other = spark.newSession()
    here, there = open_mart(spark, sf0001).dim_seller, open_mart(other, sf0001).dim_seller
    assert not set(here.inputFiles()) & set(there.inputFiles())
    assert here.count() == there.count()


def test_missing_table_is_named():
    with pytest.raises(AttributeError, match="dim_seller"):
        _ = Mart({}).dim_seller


def test_a_failing_panel_leaves_the_others(spark, shop, tmp_path):
    corrupt = tmp_path / "corrupt.parquet"
    corrupt.write_bytes(b"PAR1 this is not parquet PAR1")
    m = build_mart(shop)
    broken = m.replace(fakta_penjualan=lambda: spark.table("no_such_table"))
    panels = run_panels(
        {
            "customers": lambda: kpis.kpi_customers(broken),
            "items": lambda: kpis.kpi_items_sold(broken),
            "months": lambda: kpis.available_months(broken),
            "many": lambda: spark.range(1001),
            "corrupt": lambda: spark.read.schema("x int").parquet(str(corrupt)),
        }
    )
    assert panels["customers"].rows[0][0] == 2
    assert "no_such_table" in panels["items"].error and panels["items"].rows == []
    assert panels["months"].error is None
    assert len(panels["many"].rows) == 1001 and panels["many"].error is None
    assert panels["corrupt"].error and panels["corrupt"].rows == []


def test_json_sinks(spark, shop, tmp_path):
    import json

    m = build_mart(shop)
    document = json.loads(state_document(m, "seller").first().document)
    assert document["tipe"] == "seller" and document["max"] == 1
    assert document["data"][0]["nama"] == "Rio de Janeiro"
    empty = m.replace(dim_seller=m.dim_seller.limit(0))
    assert json.loads(state_document(empty, "seller").first().document) == {
        "tipe": "seller", "data": [], "max": 0,
    }
    write_json(kpis.kpi_customers(m), str(tmp_path / "kpi"))
    assert spark.read.json(str(tmp_path / "kpi")).first()[0] == 2


def test_order_lines_keep_items_without_an_order(shop):
    assert order_lines(shop).count() == shop.order_items.count()


def test_any_ids_give_the_same_totals(spark, make_normalized, tmp_path):
    """Hexadecimal ids, ids longer than a number, leading zeros and named methods."""
    at = datetime
    long_ids = ["C" + "0" * 20 + "11", "C" + "0" * 20 + "22", "C7", "C007", "a3f0c1"]
    n = make_normalized(
        orders=[(i, c, at(2018, 1, 1 + i), None) for i, c in enumerate(long_ids)],
        order_items=[(i, 1, f"{i:x}ff", "deadbeef", Decimal(i + 1), 1) for i in range(5)],
        products=[(f"{i:x}ff", "A") for i in range(5)],
        product_category_translation=[("A", "a")],
        customers=[(c, "SP") for c in long_ids],
        sellers=[("deadbeef", "RJ")],
        order_payments=list(enumerate(["credit_card", "boleto", "1-URGENT", "10-OTHER", "boleto"])),
        order_reviews=[],
    )
    m = build_mart(n)
    found = {row.label: row.total_revenue for row in leaders.top_customers(m).collect()}
    assert found == {c: float(i + 1) for i, c in enumerate(long_ids)}
    methods = {r.metode_pembayaran: r.jumlah for r in payment_methods(m).collect()}
    assert methods == {"credit_card": 1, "boleto": 2, "1-URGENT": 1, "10-OTHER": 1}
    for pair in ("q11", "q12", "q13", "q14"):
        assert all(row.match for row in reconcile(PAIRS[pair], n, m).collect()), pair
    save_mart(m, str(tmp_path / "mart"))
    assert load_mart(spark, str(tmp_path / "mart")).fakta_penjualan.count() == 5


def test_an_id_that_occurs_twice_is_named(make_normalized, tmp_path):
    n = make_normalized(customers=[("C1", "SP"), ("C1", "RJ")])
    with pytest.raises(ValueError, match="pelanggan_key"):
        save_mart(build_mart(n), str(tmp_path / "mart"))


def test_loading_names_wrong_columns(spark, tmp_path, shop):
    path = tmp_path / "mart"
    save_mart(build_mart(shop), str(path))
    wrong = spark.read.parquet(str(path / "dim_seller")).withColumnRenamed("state", "negara")
    wrong.write.parquet(str(tmp_path / "other" / "dim_seller"))
    with pytest.raises(ValueError, match="dim_seller: state"):
        load_mart(spark, str(tmp_path / "other")).dim_seller.count()


def test_one_cent_of_a_large_total_is_a_difference(spark, make_normalized):
    n = make_normalized()
    big = spark.createDataFrame([(Decimal("100000000000000000.01"),)], "total_revenue decimal(30,2)")
    pair = replace(
        PAIRS["q09"],
        normalized=lambda _: big,
        star=lambda _: big.withColumn("total_revenue", F.col("total_revenue") + Decimal("0.01")),
    )
    row = reconcile(pair, n, build_mart(n)).first()
    assert not row.match and row.delta == 0.01


def test_measures_of_too_many_places_are_refused(spark, make_normalized):
    n = make_normalized()
    fine = spark.createDataFrame([(Decimal("0.00001"),)], "total_revenue decimal(30,5)")
    pair = replace(PAIRS["q09"], normalized=lambda _: fine, star=lambda _: fine)
    with pytest.raises(ValueError, match="decimal places"):
        reconcile(pair, n, build_mart(n))
