"""Keys of ids that carry no number of their own, or one that another id carries."""

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F

from martlens.model import STAR_KEYS, duplicate_keys
from martlens.plans.build import build_mart, open_mart
from martlens.plans.leaders import top_customers
from martlens.plans.pairs import PAIRS
from martlens.plans.reconcile import reconcile
from martlens.plans.series import payment_methods
from martlens.sources.keys import CUSTOMERS, HashedKeys, KeyDictionary
from martlens.sources.stored import load_mart, save_mart


def shop_of(make_normalized, customers, methods, products=("P1", "A1", "B1")):
    at = datetime(2018, 1, 1)
    orders = [(i, c, at, None) for i, c in enumerate(customers)]
    return make_normalized(
        orders=orders,
        order_items=[(i, 1, products[i % len(products)], "S1", Decimal(i + 1), 1) for i in range(len(orders))],
        products=[(p, "X") for p in products],
        product_category_translation=[],
        customers=[(c, "SP") for c in dict.fromkeys(customers)],
        sellers=[("S1", "RJ"), ("T1", "RJ")],
        order_payments=[(i % len(orders), m) for i, m in enumerate(methods)],
        order_reviews=[],
    )


@pytest.fixture
def shop(make_normalized):
    methods = ["1-URGENT"] * 60 + ["1-OTHER"] * 40
    return shop_of(make_normalized, ["C1", "A1", "B1", "C01", "beef"], methods)


def keys_of(m) -> dict[str, int]:
    return dict(tuples(m.dim_pelanggan.select("pelanggan_id", "pelanggan_key")))


def check_mart(m, n):
    assert {r.metode_pembayaran: r.jumlah for r in payment_methods(m).collect()} == {
        "1-URGENT": 60, "1-OTHER": 40,
    }
    assert {r.label: r.total_revenue for r in top_customers(m).collect()} == {
        "C1": 1.0, "A1": 2.0, "B1": 3.0, "C01": 4.0, "beef": 5.0,
    }
    for name, key in STAR_KEYS.items():
        assert duplicate_keys(m.table(name), key).count() == 0
    for pair in ("q11", "q12", "q13", "q14"):
        assert all(row.match for row in reconcile(PAIRS[pair], n, m).collect()), pair


def test_ids_that_share_a_number_get_keys_of_their_own(spark, shop, tmp_path):
    built = build_mart(shop)
    check_mart(built, shop)
    assert keys_of(built)["C1"] == 1 and max(v for k, v in keys_of(built).items() if k != "C1") < 0
    methods = dict(tuples(built.dim_metode_pembayaran.select("metode_pembayaran", "metode_key")))
    assert methods["1-OTHER"] == 1 and methods["1-URGENT"] < 0
    save_mart(built, str(tmp_path / "mart"))
    check_mart(load_mart(spark, str(tmp_path / "mart")), shop)


def test_an_opened_mart_keeps_methods_apart(spark, sf0001, tmp_path):
    """Raw tables in which another priority begins with the same number."""
    for name in ("orders", "lineitem", "customer", "part", "supplier"):
        raw = spark.read.parquet(f"{sf0001}/{name}.parquet")
        if name == "orders":
            other = F.when(F.col("o_orderkey") % 2 == 0, "1-OTHER").otherwise("1-URGENT")
            raw = raw.withColumn("o_orderpriority", other)
        raw.write.parquet(str(tmp_path / f"{name}.parquet"))
    m = open_mart(spark, str(tmp_path))
    found = {r.metode_pembayaran: r.jumlah for r in payment_methods(m).collect()}
    raw = spark.read.parquet(str(tmp_path / "orders.parquet"))
    assert found == dict(tuples(raw.groupBy("o_orderpriority").count()))


def test_later_builds_extend_the_dictionary(spark, make_normalized, tmp_path):
    folder = str(tmp_path / "keys")
    first = shop_of(make_normalized, ["C1", "A1", "zz"], ["1-URGENT", "2-HIGH", "cash"])
    more = shop_of(make_normalized, ["aa", "C1", "A1", "C9", "zz", "B1"], ["1-A", "1-URGENT", "3-NEW", "2-A", "cash"])
    old, again = (build_mart(n, keys=KeyDictionary(spark, folder)) for n in (first, first))
    kept = keys_of(old)
    assert kept["C1"] == 1 and {kept["A1"], kept["zz"]} == {-1, -2}
    assert keys_of(again) == kept
    grown = build_mart(more, keys=KeyDictionary(spark, folder))
    now = keys_of(grown)
    assert {k: now[k] for k in kept} == kept
    assert now["C9"] == 9 and {now["aa"], now["B1"]} == {-3, -4}
    methods = [dict(tuples(m.dim_metode_pembayaran.select("metode_pembayaran", "metode_key"))) for m in (old, grown)]
    assert methods[0] == {"1-URGENT": 1, "2-HIGH": 2, "cash": -1}
    shared = {k: v for k, v in methods[1].items() if k in methods[0]}
    assert shared == {"1-URGENT": 1, "cash": -1}
    assert methods[1]["3-NEW"] == 3 and {methods[1]["1-A"], methods[1]["2-A"]} == {-2, -3}


def test_ids_of_facts_that_no_dimension_has(spark, make_normalized):
    """They get keys too, and not one that a row of the dimension has."""
    n = shop_of(make_normalized, ["C1", "ghost", "D1"], ["1-A"])
    n = n.replace(customers=n.customers.where("customer_id = 'C1'"))
    m = build_mart(n)
    assert {r.total_revenue for r in top_customers(m).collect()} == {1.0, 2.0, 3.0}
    assert keys_of(m) == {"C1": 1}


def test_many_new_ids_are_numbered_without_gaps(spark, tmp_path):
    ids = spark.range(0, 5000, 1, 9).selectExpr("concat('x', id) AS id")
    keys = KeyDictionary(spark, str(tmp_path / "keys"))
    keys.learn(CUSTOMERS, ids, ids.limit(10), spark.createDataFrame([(None,), ("C5",)], "id string"))
    assert sorted(r.number for r in keys.entries(CUSTOMERS).collect()) == list(range(-5000, 0))
    keys.learn(CUSTOMERS, ids.selectExpr("concat(id, 'y')"))
    assert sorted(r.number for r in keys.entries(CUSTOMERS).collect()) == list(range(-10000, 0))


def test_own_numbers_need_no_lookup(spark, tmp_path):
    keys = KeyDictionary(spark, str(tmp_path / "keys"))
    df = spark.createDataFrame([("C5", 1), (None, 2)], "id string, n int")
    with pytest.raises(ValueError, match="learn"):
        keys.keyed(df, CUSTOMERS, "id", "k")
    keys.learn(CUSTOMERS, df.select("id"))
    found = keys.keyed(df, CUSTOMERS, "id", "k")
    assert "Join" not in plan_of(found)
    assert sorted(tuples(found)) == [(1, 5), (2, None)]


def test_without_a_folder_ids_are_hashed(shop):
    m = build_mart(shop, keys=HashedKeys())
    check_mart(m, shop)
    assert keys_of(m)["C1"] == 1 and keys_of(m)["beef"] < 0
