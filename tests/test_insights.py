from decimal import Decimal

import pytest
from conftest import day_row

from martlens.operators.period import Period
from martlens.plans import insights

DAY = day_row("2024-01-05")


def payments(make_mart, *counts):
    facts = [(20240105, key) for key, n in enumerate(counts) for _ in range(n)]
    methods = [(key, f"M{key}") for key in range(len(counts))]
    return make_mart(dim_waktu=[DAY], dim_metode_pembayaran=methods, fakta_pembayaran=facts)


@pytest.mark.parametrize(
    ("counts", "share", "status"),
    [
        ((6994, 3006), 69.9, "open"),
        ((6995, 3005), 70.0, "dominant"),
        ((6996, 3004), 70.0, "dominant"),
    ],
)
def test_payment_share_is_rounded_before_the_test(make_mart, counts, share, status):
    row = insights.insight_payment(payments(make_mart, *counts)).first()
    assert (row.top_share, row.status, row.second_method) == (share, status, "M1")


def test_payment_without_rows(make_mart):
    row = insights.insight_payment(make_mart()).first()
    assert (row.status, row.total, row.n_methods, row.top_share) == ("none", 0, 0, None)
    assert row.now_text and not row.next_text and not row.action_text


def customers(make_mart, **per_state):
    states = [state for state, n in per_state.items() for _ in range(n)]
    return make_mart(dim_pelanggan=[(i, f"C{i}", state) for i, state in enumerate(states)])


@pytest.mark.parametrize(
    ("counts", "race", "status"),
    [
        ({"A": 2999, "B": 2500, "C": 2000}, "tight", "balanced"),  # gap 19.96 stays tight
        ({"A": 6, "B": 5, "C": 4}, "lead", "leading"),
        ({"A": 5, "B": 4, "C": 1}, "lead", "concentrated"),
        ({"A": 7}, None, "concentrated"),
    ],
)
def test_state_thresholds_are_not_rounded(make_mart, counts, race, status):
    row = insights.insight_state(customers(make_mart, **counts)).first()
    assert (row.race, row.status) == (race, status)


def test_state_without_rows(make_mart):
    row = insights.insight_state(make_mart()).first()
    assert (row.n_shown, row.status, row.action, row.top_share) == (0, "none", None, None)


def sales(make_mart, *revenues, qty=1):
    days = [day_row(f"2024-01-{i:02d}") for i in range(1, len(revenues) + 1)]
    facts = [
        (20240100 + i, i, i, i, qty, None if r is None else Decimal(r))
        for i, r in enumerate(revenues, 1)
    ]
    return make_mart(
        dim_waktu=days,
        dim_produk=[(i, f"P{i}", "A", "a") for i in range(1, len(revenues) + 1)],
        dim_seller=[(i, f"S{i}", "SP") for i in range(1, len(revenues) + 1)],
        dim_pelanggan=[(i, f"C{i}", "SP") for i in range(1, len(revenues) + 1)],
        fakta_penjualan=facts,
    )


@pytest.mark.parametrize(
    ("revenues", "status", "trend", "outlook", "max_label", "min_label"),
    [
        (["1", "3", "2"], "multi", "down", "strong", "2 Jan", "1 Jan"),
        (["5", "1", "2"], "multi", "up", "weak", "1 Jan", "2 Jan"),
        (["0.1", "0.1", "0.1"], "multi", "flat", "strong", "1 Jan", "1 Jan"),
        (["4", "9", "9", "4"], "multi", "down", "weak", "2 Jan", "1 Jan"),
        (["4"], "single", None, "limited", "1 Jan", "1 Jan"),
        ([], "none", None, None, None, None),
    ],
)
def test_revenue_trend(make_mart, revenues, status, trend, outlook, max_label, min_label):
    row = insights.insight_revenue(sales(make_mart, *revenues), Period(2024, 1)).first()
    found = (row.status, row.trend, row.outlook, row.max_label, row.min_label)
    assert found == (status, trend, outlook, max_label, min_label)


def test_revenue_text_names_the_filter(make_mart):
    row = insights.insight_revenue(sales(make_mart, "1234.5", "2"), Period(2024, 1)).first()
    assert "revenue, 2024-01: multi" in row.now_text
    assert "R$ 1.234,50" in row.now_text


def test_top_items_with_zero_quantity(make_mart):
    row = insights.insight_top_items(sales(make_mart, "1", "1", qty=0)).first()
    assert (row.top_share, row.gap, row.race, row.status) == (0.0, None, None, "even")


@pytest.mark.parametrize(("by", "action"), [("qty", "keep_volume"), ("revenue", "watch_revenue")])
def test_seller_advice_follows_the_metric(make_mart, by, action):
    row = insights.insight_seller(sales(make_mart, "1", "9", "2"), by=by).first()
    assert row.action == action


def test_customer_whose_total_is_unknown_counts_as_zero(make_mart):
    row = insights.insight_customer(sales(make_mart, None, "3", "2")).first()
    assert (row.top_label, row.top_value, row.second_value) == ("C2", 3.0, 2.0)
    assert row.total == 5.0


def deliveries(make_mart, **days):
    return make_mart(
        dim_waktu=[DAY],
        dim_pelanggan=[(i, f"C{i}", s) for i, s in enumerate(days)],
        dim_produk=[(i, f"P{i}", s, s) for i, s in enumerate(days)],
        fakta_pengiriman=[(20240105, i, i, d) for i, d in enumerate(days.values())],
    )


@pytest.mark.parametrize(
    ("days", "status", "action"),
    [
        ({"A": 10, "B": 9}, "slow", "maintain"),
        ({"A": 10, "B": 7}, "slow", "improve"),
        ({"A": 9, "B": 6}, "varied", "improve"),
        ({"A": 9, "B": 7}, "consistent", "maintain"),
        ({}, "none", None),
    ],
)
def test_delivery_thresholds(make_mart, days, status, action):
    m = deliveries(make_mart, **days)
    for ask in (insights.insight_delivery_state, insights.insight_delivery_category):
        row = ask(m).first()
        assert (row.status, row.action) == (status, action)


def reviews(make_mart, **scores):
    """Scores by month, e.g. m2024_01=[5, 4]."""
    days, facts = [], []
    for name, given in scores.items():
        year, month = name[1:].split("_")
        day = day_row(f"{year}-{month}-01")
        days.append(day)
        facts += [(day[0], score) for score in given]
    return make_mart(dim_waktu=days, fakta_review=facts)


def test_yearly_mean_is_unweighted(make_mart):
    m = reviews(make_mart, m2023_01=[5] * 9, m2024_01=[3])
    row = insights.insight_rating_year(m).first()
    assert (row.mean_rating, row.status, row.best_label, row.worst_label) == (
        4.0, "middle", "2023", "2024",
    )


def test_rating_threshold_is_reached_exactly(make_mart):
    row = insights.insight_rating_year(reviews(make_mart, m2024_01=[4, 4, 4, 4, 5])).first()
    assert (row.mean_rating, row.status, row.action) == (4.2, "strong", "maintain")


@pytest.mark.parametrize(
    ("last", "status", "action"),
    [([5], "up", "maintain"), ([3], "flat", "maintain"), ([1], "down", "review")],
)
def test_monthly_trend(make_mart, last, status, action):
    row = insights.insight_rating_month(
        reviews(make_mart, m2024_01=[3], m2024_02=[4], m2024_03=last)
    ).first()
    assert (row.status, row.action) == (status, action)


def test_ratings_without_rows(make_mart):
    for ask in (insights.insight_rating_year, insights.insight_rating_month):
        row = ask(make_mart()).first()
        assert (row.status, row.action) == ("none", None)
