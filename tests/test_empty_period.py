"""A period without rows: empty results, insights that say so, no errors."""

import pytest

from martlens import registry
from martlens.operators.period import Period
from martlens.plans import insights, kpis, series
from martlens.plans.build import open_mart

ASKS = {
    **registry._BY_PERIOD,
    "sales_series": series.sales_series,
    "insight_revenue": insights.insight_revenue,
}


@pytest.mark.parametrize("period", [Period(1990), Period(1997, 13)], ids=["year", "month"])
@pytest.mark.parametrize("name", ASKS)
def test_nothing_to_show(spark, sf0001, name, period):
    rows = ASKS[name](open_mart(spark, sf0001), period).collect()
    if not name.startswith("insight_"):
        assert rows == []
        return
    (row,) = rows
    assert row.status == "none"
    assert row.now_text.endswith(": none")
    assert row.next_text == row.action_text == ""


def test_sheet_of_an_empty_month_still_has_the_revenue_of_the_year(spark, sf0001):
    m = open_mart(spark, sf0001)
    empty, year = (kpis.kpi_sheet(m, p).first() for p in (Period(1997, 13), Period(1997)))
    assert empty.items_sold == 0 < year.items_sold
    assert empty.total_revenue == year.total_revenue > 0
