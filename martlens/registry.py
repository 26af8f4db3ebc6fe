"""Every question under the name it is registered by."""

from __future__ import annotations

from collections.abc import Callable
from uuid import NAMESPACE_URL, uuid5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions import number_text, short_label
from martlens.model import Mart, Normalized
from martlens.operators.period import Period
from martlens.plans import geo, insights, kpis, leaders, series
from martlens.plans.activity import active_customers
from martlens.plans.build import open_mart, open_normalized
from martlens.plans.pairs import PAIRS, revenue_by_month
from martlens.plans.reconcile import reconcile, reconcile_all
from martlens.plans.rollup import sales_rollup
from martlens.session import new_path, once_per_session
from martlens.sinks import chart_arrays, json_fragments, state_document
from martlens.sources.stored import (
    load_mart,
    load_normalized,
    mart_from_catalog,
    register_views,
    save_mart,
)

Query = Callable[[SparkSession, str], DataFrame]

PERIODS: dict[str, Period] = {
    "all": Period(),
    "y": Period(year=1997),
    "m": Period(month=3),
    "ym": Period(year=1997, month=3),
}


def _on_mart(ask: Callable[[Mart], DataFrame], qty_mode: str = "quantity") -> Query:
    return lambda spark, folder: ask(open_mart(spark, folder, qty_mode))


def _on_normalized(ask: Callable[[Normalized], DataFrame]) -> Query:
    return lambda spark, folder: ask(open_normalized(spark, folder))


def _on_both(ask: Callable[[Normalized, Mart], DataFrame]) -> Query:
    return lambda spark, folder: ask(
        open_normalized(spark, folder), open_mart(spark, folder, "unit")
    )


def _doubled(df: DataFrame, money: str) -> DataFrame:
    return df.withColumn(money, F.col(money).cast("double"))


def _shown(df: DataFrame) -> DataFrame:
    """Exact sums leave the engine as doubles."""
    exact = [name for name, kind in df.dtypes if kind.startswith("decimal")]
    return df.withColumns({name: F.col(name).cast("double") for name in exact})


def _tables() -> dict[str, Query]:
    star = ["dim_waktu", "dim_pelanggan", "dim_produk", "dim_seller", "dim_metode_pembayaran",
            "fakta_pengiriman", "fakta_pembayaran", "fakta_review"]
    normalized = ["orders", "products", "customers", "order_payments", "order_reviews"]

    def fact(m: Mart, name: str) -> DataFrame:
        table = m.table(name)
        return table.drop("tahun", "bulan") if name.startswith("fakta_") else table

    found = {f"mart_{t}": _on_mart(lambda m, t=t: fact(m, t)) for t in star}
    found["mart_fakta_penjualan"] = _on_mart(
        lambda m: _doubled(fact(m, "fakta_penjualan"), "total_harga")
    )
    found |= {f"norm_{t}": _on_normalized(lambda n, t=t: n.table(t)) for t in normalized}
    found["norm_order_items"] = _on_normalized(lambda n: _doubled(n.order_items, "price"))
    return found


def _figures() -> dict[str, Query]:
    found = {
        "available_years": _on_mart(kpis.available_years),
        "available_months_all": _on_mart(kpis.available_months),
        "available_months_y": _on_mart(lambda m: kpis.available_months(m, 1997)),
        "month_options": _on_mart(kpis.month_options),
        "kpi_customers": _on_mart(kpis.kpi_customers),
        "kpi_products": _on_mart(kpis.kpi_products),
        "kpi_categories": _on_mart(kpis.kpi_categories),
        "kpi_revenue_all": _on_mart(kpis.kpi_revenue),
        "kpi_revenue_y": _on_mart(lambda m: kpis.kpi_revenue(m, 1997)),
        "kpi_avg_delivery": _on_mart(kpis.kpi_avg_delivery),
    }
    for name, p in PERIODS.items():
        found[f"kpi_items_sold_{name}"] = _on_mart(lambda m, p=p: kpis.kpi_items_sold(m, p))
        found[f"kpi_sheet_{name}"] = _on_mart(lambda m, p=p: kpis.kpi_sheet(m, p))
    return found


# Questions asked for all dates, a year, and a month of a year.
_BY_PERIOD: dict[str, Callable[[Mart, Period], DataFrame]] = {
    "payment_methods": series.payment_methods,
    "delivery_by_state": series.delivery_by_state,
    "delivery_by_category": series.delivery_by_category,
    "rating_by_year": series.rating_by_year,
    "rating_by_month": series.rating_by_month,
    "top_products": leaders.top_items,
    "top_categories": lambda m, p: leaders.top_items(m, p, "category"),
    "top_sellers_qty": leaders.top_sellers,
    "top_sellers_revenue": lambda m, p: leaders.top_sellers(m, p, "revenue"),
    "top_sellers_both": leaders.top_sellers_both,
    "top_customers": leaders.top_customers,
    "segment_customers": leaders.segment_customers,
    "segment_sellers": leaders.segment_sellers,
    "insight_payment": insights.insight_payment,
    "insight_top_product": insights.insight_top_items,
    "insight_top_category": lambda m, p: insights.insight_top_items(m, p, "category"),
    "insight_delivery_state": insights.insight_delivery_state,
    "insight_delivery_category": insights.insight_delivery_category,
    "insight_rating_year": insights.insight_rating_year,
    "insight_rating_month": insights.insight_rating_month,
    "insight_customer": insights.insight_customer,
    "insight_seller_qty": insights.insight_seller,
    "insight_seller_revenue": lambda m, p: insights.insight_seller(m, p, "revenue"),
}


def _chart_customers(m: Mart) -> DataFrame:
    revenue = number_text(F.col("total_revenue"), 2)
    return leaders.exact_top_customers(m).select(
        "pos",
        short_label(F.col("label"), 4).alias("short_label"),
        F.concat(F.lit("R$ "), revenue).alias("revenue_text"),
    )


def _boards() -> dict[str, Query]:
    found = {
        f"{name}_{p}": _on_mart(lambda m, ask=ask, p=p: ask(m, PERIODS[p]))
        for name, ask in _BY_PERIOD.items()
        for p in PERIODS
    }
    for name, p in PERIODS.items():
        found[f"sales_series_{name}"] = _on_mart(lambda m, p=p: series.sales_series(m, p))
        found[f"insight_revenue_{name}"] = _on_mart(lambda m, p=p: insights.insight_revenue(m, p))
    for entity in ("customer", "seller"):
        found[f"state_distribution_{entity}"] = _on_mart(
            lambda m, e=entity: geo.state_distribution(m, e)
        )
        found[f"map_scale_{entity}"] = _on_mart(
            lambda m, e=entity: geo.map_scale(geo.state_distribution(m, e))
        )
        found[f"state_distribution_json_{entity}"] = _on_mart(
            lambda m, e=entity: state_document(m, e)
        )
    return found | {
        "top_states": _on_mart(leaders.top_states),
        "insight_state": _on_mart(insights.insight_state),
        "chart_top_customers": _on_mart(_chart_customers),
        "chart_json_top_products": _on_mart(
            lambda m: chart_arrays(leaders.top_items(m), "label", "total_qty")
        ),
    }


def _pairs() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, pair in PAIRS.items():
        found[f"{name}_n"] = _on_normalized(lambda n, pair=pair: _shown(pair.normalized(n)))
        found[f"{name}_s"] = _on_mart(lambda m, pair=pair: _shown(pair.star(m)))
        found[f"reconcile_{name}"] = _on_both(lambda n, m, pair=pair: reconcile(pair, n, m))
    return found | {"reconcile_all": _on_both(reconcile_all)}


def _on_saved(ask: Callable[[Mart], DataFrame], partitioned: bool = True) -> Query:
    """Asked of a mart that was saved and loaded, facts by month or by date order."""

    def answer(spark: SparkSession, folder: str) -> DataFrame:
        def loaded() -> Mart:
            mart = open_mart(spark, folder)
            path = new_path(spark, "saved")
            save_mart(mart, path, partitioned)
            return load_mart(spark, path, partitioned)

        return ask(once_per_session(spark, ("saved", partitioned, folder), loaded))

    return answer


def _on_loaded(ask: Callable[[Normalized], DataFrame]) -> Query:
    """Asked of normalized tables that were stored and loaded."""

    def answer(spark: SparkSession, folder: str) -> DataFrame:
        def loaded() -> Normalized:
            n, path = open_normalized(spark, folder), new_path(spark, "normalized")
            for name in n.names():
                n.table(name).write.parquet(f"{path}/{name}")
            return load_normalized(spark, path)

        return ask(once_per_session(spark, ("loaded", folder), loaded))

    return answer


def _on_catalog(ask: Callable[[Mart], DataFrame]) -> Query:
    """Asked of tables found by name, the seller dimension by its other name."""

    def answer(spark: SparkSession, folder: str) -> DataFrame:
        prefix = f"martlens_{uuid5(NAMESPACE_URL, folder).hex}_"
        mart = open_mart(spark, folder)
        register_views(mart, prefix)
        mart.dim_seller.createOrReplaceTempView(f"{prefix}dim_penjual")
        spark.catalog.dropTempView(f"{prefix}dim_seller")
        return ask(mart_from_catalog(spark, prefix))

    return answer


def _sources() -> dict[str, Query]:
    """The ways to tables and periods: saved, loaded, by name, from request parameters."""
    found: dict[str, Query] = {
        "loaded_top_sellers_ym": _on_saved(lambda m: leaders.top_sellers(m, PERIODS["ym"])),
        "loaded_q14_n": _on_loaded(lambda n: _shown(PAIRS["q14"].normalized(n))),
        "loaded_q16_n": _on_loaded(lambda n: _shown(PAIRS["q16"].normalized(n))),
        "catalog_segment_sellers_y": _on_catalog(
            lambda m: leaders.segment_sellers(m, PERIODS["y"])
        ),
        "catalog_state_distribution_seller": _on_catalog(
            lambda m: geo.state_distribution(m, "seller")
        ),
        "text_period_items_sold": _on_mart(
            lambda m: kpis.kpi_items_sold(m, Period.of("1997x", "3"))
        ),
        "blank_period_items_sold": _on_mart(
            lambda m: kpis.kpi_items_sold(m, Period.of("", "March"))
        ),
    }
    for name, p in PERIODS.items():
        found[f"flat_payment_methods_{name}"] = _on_saved(
            lambda m, p=p: series.payment_methods(m, p), partitioned=False
        )
        found[f"loaded_sales_series_{name}"] = _on_saved(
            lambda m, p=p: series.sales_series(m, p)
        )
        found[f"norm_revenue_{name}"] = _on_normalized(
            lambda n, p=p: _shown(revenue_by_month(n, p))
        )
    return found


def _of_any_size() -> dict[str, Query]:
    """Results that no top-k or calendar bounds."""
    found = {
        "customer_positions": _on_mart(leaders.customer_positions),
        "seller_positions": _on_mart(leaders.seller_positions),
        "json_fragments_sellers": _on_mart(
            lambda m: json_fragments(leaders.seller_positions(m), "label", "total_qty")
        ),
        "mart_sales_rollup": _on_mart(lambda m: _doubled(sales_rollup(m), "revenue")),
    }
    for name, p in PERIODS.items():
        found[f"active_customers_{name}"] = _on_mart(lambda m, p=p: active_customers(m, p))
    return found


def all_queries() -> dict[str, Query]:
    return {**_tables(), **_figures(), **_boards(), **_pairs(), **_sources(), **_of_any_size()}
