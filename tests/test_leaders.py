from decimal import Decimal

import pytest
from conftest import day_row, tuples
from pyspark.sql import functions as F

from martlens.operators.ranking import first_extreme, tier, top_k
from martlens.plans import geo, leaders, series
from martlens.plans.pairs import PAIRS

DAY = day_row("2024-01-05")


def sale(customer=1, product=1, seller=1, qty=1, price="1.00", day=20240105):
    return (day, customer, product, seller, qty, None if price is None else Decimal(price))


def test_null_totals_first_in_sql_rankings_last_in_seller_boards(make_mart):
    m = make_mart(
        dim_waktu=[DAY],
        dim_seller=[(1, "S1", "SP"), (2, "S2", "SP"), (3, "S3", "SP")],
        fakta_penjualan=[
            sale(seller=1, price="5.00"),
            sale(seller=2, price=None, qty=None),
            sale(seller=3, price="9.00"),
        ],
    )
    by_sql = tuples(leaders.segment_sellers(m).select("pos", "seller_id", "revenue_text"))
    assert by_sql == [(1, "S2", "R$ 0,00"), (2, "S3", "R$ 9,00"), (3, "S1", "R$ 5,00")]
    assert [r[1] for r in tuples(leaders.top_sellers(m, by="revenue"))] == ["S3", "S1", "S2"]
    assert tuples(leaders.top_sellers(m))[-1] == (3, "S2", 0)


def test_unknown_customers_keep_their_key_on_the_dashboard_only(make_mart):
    m = make_mart(
        dim_waktu=[DAY],
        dim_pelanggan=[(1, "C1", "SP")],
        fakta_penjualan=[sale(customer=1, price="5.00"), sale(customer=77, price="8.00")],
    )
    assert tuples(leaders.top_customers(m)) == [(1, "77", 8.0), (2, "C1", 5.0)]
    assert tuples(PAIRS["q14"].star(m)) == [("C1", 5.0)]


def test_ties_go_to_the_lower_label_also_across_the_cut(spark):
    rows = [(f"L{i:02d}", 5) for i in range(12, 0, -1)] + [("top", 9), (None, 5)]
    shown = tuples(top_k(spark.createDataFrame(rows, "label string, v int"), "v", 10))
    assert [r[1] for r in shown] == ["top", *[f"L{i:02d}" for i in range(1, 10)]]
    assert [r[0] for r in shown] == list(range(1, 11))


def test_null_category_is_a_group(make_mart):
    m = make_mart(
        dim_waktu=[DAY],
        dim_produk=[(1, "P1", "A", "a"), (2, "P2", "B", None)],
        fakta_penjualan=[sale(product=1, qty=2), sale(product=2, qty=5)],
    )
    assert tuples(leaders.top_items(m, by="category")) == [(1, None, 5), (2, "a", 2)]
    assert tuples(leaders.top_items(m, by="nonsense")) == [(1, "P2", 5), (2, "P1", 2)]


def test_tiers_are_three_three_four(spark):
    places = spark.range(1, 11).select(tier(F.col("id")).alias("tier"))
    counted = dict(tuples(places.groupBy("tier").count()))
    assert counted == {"Gold": 3, "Silver": 3, "Bronze": 4}


STATES = ["SP", "SP", "SP", "SP ", "SP ", "", None, "XX", "XX", "XX", "XX", "XX", "RJ"]


@pytest.fixture
def states(make_mart):
    rows = [(i, f"C{i}", state) for i, state in enumerate(STATES)]
    return make_mart(dim_pelanggan=rows, dim_seller=[(1, "S1", "RJ")])


def test_map_groups_before_trimming_and_knows_its_own_maximum(states):
    rows = tuples(geo.state_distribution(states).select("state", "jumlah", "max_jumlah"))
    assert rows == [("SP", 3, 3), ("SP", 2, 3), ("RJ", 1, 3)]


def test_dashboard_states_leave_out_blanks_and_pairs_keep_them(states):
    assert tuples(leaders.top_states(states))[0] == (1, "XX", 5)
    assert {r[1] for r in tuples(leaders.top_states(states))} == {"XX", "SP", "SP ", "RJ"}
    assert {r[0] for r in tuples(PAIRS["q03"].star(states))} == {"XX", "SP", "SP ", "", None, "RJ"}


def test_map_scale(states):
    shown = ["jumlah", "radius", "pixel_radius", "color"]
    scaled = tuples(geo.map_scale(geo.state_distribution(states)).select(*shown))
    assert scaled[0] == (3, 200000.0, 18, "#e74c3c")
    assert scaled[1][2:] == (14, "#e74c3c")
    assert scaled[2] == (1, 15000.0, 6, "#f1c40f")


def test_equal_counts_sit_in_the_middle(states):
    row = geo.map_scale(geo.state_distribution(states, "seller")).first()
    assert row.radius == pytest.approx(15000 + 0.5**0.5 * 185000)
    assert row.pixel_radius == 14


def test_any_other_entity_means_customers(states):
    assert geo.state_distribution(states, "nonsense").count() == 3


def test_delivery_sorts_by_the_rounded_mean_then_label(make_mart):
    # 3.004 and 3.001 both round to 3.00: the label decides.
    b = [(20240105, 1, 1, 3)] * 996 + [(20240105, 1, 1, 4)] * 4
    a = [(20240105, 2, 1, 3)] * 999 + [(20240105, 2, 1, 4)] * 1
    m = make_mart(
        dim_waktu=[DAY], dim_pelanggan=[(1, "C1", "B"), (2, "C2", "A")], fakta_pengiriman=a + b
    )
    assert tuples(series.delivery_by_state(m)) == [("A", 3.0), ("B", 3.0)]


def test_first_of_equal_extremes_wins(spark):
    df = spark.createDataFrame(
        [("b", 5), ("a", 5), (None, 5), ("z", 1), ("y", 1)], "label string, v int"
    )
    highest, lowest = first_extreme("v", "label", True), first_extreme("v", "label", False)
    row = df.agg(highest.alias("hi"), lowest.alias("lo")).first()
    assert (row.hi.label, row.hi.value, row.lo.label, row.lo.value) == ("a", 5, "y", 1)


def test_both_seller_boards_come_from_one_aggregate(make_mart):
    m = make_mart(
        dim_waktu=[DAY],
        dim_seller=[(1, "S1", "SP"), (2, "S2", "SP")],
        fakta_penjualan=[sale(seller=1, qty=9, price="1.00"), sale(seller=2, qty=1, price="7.00")],
    )
    rows = tuples(leaders.top_sellers_both(m).select("ranking", "pos", "label"))
    assert rows == [
        ("total_qty", 1, "S1"), ("total_qty", 2, "S2"),
        ("total_revenue", 1, "S2"), ("total_revenue", 2, "S1"),
    ]
