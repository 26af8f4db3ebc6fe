"""Insights: one row of codes, figures and texts about an aggregated result.

Everything here works on a top-k, a calendar series or a few groups. Totals
stay exact decimals or integers until the last projection, so a threshold is
never missed through a rounding error; shares and gaps shown with one decimal
are rounded before the test where ``rounded`` says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions import as_double, percent_rounded
from martlens.model import Mart
from martlens.operators.period import ALL, Period
from martlens.operators.ranking import (
    at,
    first_extreme,
    gap_percent,
    positioned,
    share_percent,
    top_k,
)
from martlens.plans import leaders, series
from martlens.plans.messages import with_text

# Thresholds of the classifications.
DOMINANT_METHOD_SHARE = 70
LEADER_SHARE = 50
MODERATE_SHARE = 30
CLEAR_GAP = 20
SLOW_DELIVERY_DAYS = 10
WIDE_DELIVERY_RANGE = 3
STRONG_RATING = 4.2
MIDDLE_RATING = 3.5

def _rows() -> Column:
    return F.count(F.lit(1))


def _rising(change: Column, up: str, down: str, flat: str) -> Column:
    return F.when(change > 0, up).when(change < 0, down).when(change == 0, flat)


def insight_revenue(m: Mart, p: Period = ALL) -> DataFrame:
    """Last point against the one before, the mean, and the extremes."""
    points = series.sales_points(m, p).withColumn("revenue", F.coalesce("revenue", F.lit(0)))
    latest_first = positioned(points, [F.col("pos").desc()], "back")
    facts = latest_first.agg(
        _rows().alias("n_points"),
        F.sum("revenue").alias("total"),
        at(1, "label", "back").alias("last_label"),
        at(1, "revenue", "back").alias("last"),
        at(2, "revenue", "back").alias("prev"),
        _first_point("revenue", largest=True).alias("top"),
        _first_point("revenue", largest=False).alias("low"),
    )
    n, last = F.col("n_points"), F.col("last")
    found = facts.select(
        "n_points",
        F.when(n == 0, "none").when(n == 1, "single").otherwise("multi").alias("status"),
        _rising(last - F.col("prev"), "up", "down", "flat").alias("trend"),
        F.when(n == 1, "limited")
        .when(last * n >= F.col("total"), "strong")
        .when(n > 1, "weak")
        .alias("outlook"),
        "last_label",
        as_double(last).alias("last_revenue"),
        as_double(F.col("prev")).alias("prev_revenue"),
        (as_double(F.col("total")) / F.when(n > 0, n)).alias("mean_revenue"),
        F.col("top.label").alias("max_label"),
        as_double(F.col("top.value")).alias("max_revenue"),
        F.col("low.label").alias("min_label"),
        as_double(F.col("low.value")).alias("min_revenue"),
    )
    return with_text(found, "revenue", p)


def _first_point(value: str, largest: bool) -> Column:
    # In a series the first of equal values is the earliest.
    rank = -F.col(value) if largest else F.col(value)
    return F.min(F.struct(rank.alias("rank"), "pos", "label", F.col(value).alias("value")))


def insight_payment(m: Mart, p: Period = ALL) -> DataFrame:
    """Share of the most used payment method among all payments."""
    methods = series.payment_methods(m, p).withColumnRenamed("metode_pembayaran", "label")
    total = methods.agg(F.coalesce(F.sum("jumlah"), F.lit(0))).scalar()
    count = methods.agg(_rows()).scalar()
    facts = (
        top_k(methods, "jumlah", 2)
        .agg(
            at(1, "label").alias("top_method"),
            at(1, "jumlah").alias("top_count"),
            at(2, "label").alias("second_method"),
        )
        .select("*", total.alias("total"), count.alias("n_methods"))
    )
    share = percent_rounded(F.col("top_count"), F.col("total"))
    found = facts.select(
        "n_methods",
        "total",
        "top_method",
        "top_count",
        "second_method",
        as_double(share).alias("top_share"),
        F.when(F.col("total") == 0, "none")
        .when(share >= DOMINANT_METHOD_SHARE, "dominant")
        .otherwise("open")
        .alias("status"),
    )
    return with_text(found, "payment", p)


def insight_top_items(m: Mart, p: Period = ALL, by: str = "product") -> DataFrame:
    """How far the best seller leads the ten shown, by place."""
    shown = leaders.top_items(m, p, by).withColumn("qty", F.coalesce("total_qty", F.lit(0)))
    facts = shown.agg(
        _rows().alias("n_items"),
        F.sum("qty").alias("total_qty"),
        at(1, "label").alias("top_label"),
        at(1, "qty").alias("top_qty"),
        at(2, "label").alias("second_label"),
        F.coalesce(at(2, "qty"), F.lit(0)).alias("second_qty"),
    )
    total, top, second = F.col("total_qty"), F.col("top_qty"), F.col("second_qty")
    share = F.when(total > 0, percent_rounded(top, total)).when(total <= 0, F.lit(0))
    gap = F.when(second > 0, percent_rounded(top - second, second))
    found = facts.select(
        "n_items",
        "total_qty",
        "top_label",
        "top_qty",
        "second_label",
        "second_qty",
        as_double(share).alias("top_share"),
        as_double(gap).alias("gap"),
        F.when(gap >= CLEAR_GAP, "lead").when(gap < CLEAR_GAP, "tight").alias("race"),
        F.when(F.col("n_items") == 0, "none")
        .when(share >= LEADER_SHARE, "dominant")
        .when(share >= MODERATE_SHARE, "leading")
        .otherwise("even")
        .alias("status"),
    )
    return with_text(found, "top_items", p, by)


def _concentration(shown: DataFrame, value: str) -> DataFrame:
    """Share and gap of the largest of the rows shown, both unrounded."""
    values = shown.withColumn("value", F.coalesce(value, F.lit(0)))
    by_value = [F.col("value").desc(), F.col("pos").asc()]
    facts = positioned(values, by_value, "place").agg(
        _rows().alias("n_shown"),
        F.sum("value").alias("total"),
        at(1, "label", "place").alias("top_label"),
        at(1, "value", "place").alias("top_value"),
        F.coalesce(at(2, "value", "place"), F.lit(0)).alias("second_value"),
    )
    top, second, total = F.col("top_value"), F.col("second_value"), F.col("total")
    share, gap = share_percent(top, total), gap_percent(top, second)
    # The tests compare exact products instead of the quotients.
    half = top * 100 >= total * LEADER_SHARE
    clear = (top - second) * 100 >= second * CLEAR_GAP
    raced = second > 0
    concentrated = (total > 0) & half
    return facts.select(
        "n_shown",
        as_double(total).alias("total"),
        "top_label",
        as_double(top).alias("top_value"),
        as_double(second).alias("second_value"),
        F.when(F.col("n_shown") > 0, share).alias("top_share"),
        gap.alias("gap"),
        F.when(raced & clear, "lead").when(raced, "tight").alias("race"),
        F.when(F.col("n_shown") == 0, "none")
        .when(concentrated, "concentrated")
        .when(raced & clear, "leading")
        .otherwise("balanced")
        .alias("status"),
        F.when(concentrated, "focus").when(F.col("n_shown") > 0, "broaden").alias("action"),
    )


def insight_state(m: Mart) -> DataFrame:
    return with_text(_concentration(leaders.top_states(m), "total_customers"), "state")


def insight_customer(m: Mart, p: Period = ALL) -> DataFrame:
    found = _concentration(leaders.exact_top_customers(m, p), "total_revenue")
    return with_text(found, "customer", p)


def insight_seller(m: Mart, p: Period = ALL, by: str = "qty") -> DataFrame:
    """Its advice depends on the metric, not on the concentration."""
    measure = "total_revenue" if by == "revenue" else "total_qty"
    found = _concentration(leaders.exact_top_sellers(m, p, by), measure)
    advice = F.lit("watch_revenue" if by == "revenue" else "keep_volume")
    advised = found.withColumn("action", F.when(F.col("n_shown") > 0, advice))
    return with_text(advised, "seller", p, "revenue" if by == "revenue" else "qty")


def _delivery(means: DataFrame) -> DataFrame:
    shown = means.withColumn("value", F.coalesce("avg_delivery_days", F.lit(0)))
    facts = shown.agg(
        _rows().alias("n_groups"),
        first_extreme("value", "label", largest=True).alias("slow"),
        first_extreme("value", "label", largest=False).alias("fast"),
    )
    slowest, spread = F.col("slow.value"), F.col("slow.value") - F.col("fast.value")
    varied = spread >= WIDE_DELIVERY_RANGE
    return facts.select(
        "n_groups",
        F.col("slow.label").alias("max_label"),
        as_double(slowest).alias("max_days"),
        F.col("fast.label").alias("min_label"),
        as_double(F.col("fast.value")).alias("min_days"),
        as_double(spread).alias("range_days"),
        F.when(F.col("n_groups") == 0, "none")
        .when(slowest >= SLOW_DELIVERY_DAYS, "slow")
        .when(varied, "varied")
        .otherwise("consistent")
        .alias("status"),
        F.when(varied, "improve").when(F.col("n_groups") > 0, "maintain").alias("action"),
    )


def insight_delivery_state(m: Mart, p: Period = ALL) -> DataFrame:
    return with_text(_delivery(series.exact_delivery_by_state(m, p)), "delivery_state", p)


def insight_delivery_category(m: Mart, p: Period = ALL) -> DataFrame:
    return with_text(_delivery(series.exact_delivery_by_category(m, p)), "delivery_category", p)


def _rated(m: Mart, p: Period, by: str) -> DataFrame:
    points = series.rating_points(m, p, by)
    return points.withColumn("rating", F.coalesce("avg_rating", F.lit(0)))


def insight_rating_year(m: Mart, p: Period = ALL) -> DataFrame:
    """Unweighted mean of the rounded yearly means."""
    facts = _rated(m, p, "year").agg(
        _rows().alias("n_years"),
        F.sum("rating").alias("total"),
        _first_point("rating", largest=True).alias("best"),
        _first_point("rating", largest=False).alias("worst"),
    )
    n, total = F.col("n_years"), F.col("total")

    def reaches(level: float) -> Column:
        return total >= F.lit(str(level)).cast("decimal(3,1)") * n

    found = facts.select(
        "n_years",
        (as_double(total) / F.when(n > 0, n)).alias("mean_rating"),
        F.col("best.label").alias("best_label"),
        as_double(F.col("best.value")).alias("best_rating"),
        F.col("worst.label").alias("worst_label"),
        as_double(F.col("worst.value")).alias("worst_rating"),
        F.when(n == 0, "none")
        .when(reaches(STRONG_RATING), "strong")
        .when(reaches(MIDDLE_RATING), "middle")
        .otherwise("low")
        .alias("status"),
        F.when(n == 0, None)
        .when(reaches(STRONG_RATING), "maintain")
        .otherwise("improve")
        .alias("action"),
    )
    return with_text(found, "rating_year", p)


def insight_rating_month(m: Mart, p: Period = ALL) -> DataFrame:
    """Last month against the first, and the extremes."""
    facts = _rated(m, p, "month").agg(
        _rows().alias("n_months"),
        F.min(F.struct("pos", "rating")).alias("first"),
        F.max(F.struct("pos", "rating")).alias("last"),
        _first_point("rating", largest=True).alias("best"),
        _first_point("rating", largest=False).alias("worst"),
    )
    change = F.col("last.rating") - F.col("first.rating")
    found = facts.select(
        "n_months",
        as_double(F.col("first.rating")).alias("first_rating"),
        as_double(F.col("last.rating")).alias("last_rating"),
        as_double(change).alias("change"),
        F.col("best.label").alias("best_label"),
        as_double(F.col("best.value")).alias("best_rating"),
        F.col("worst.label").alias("worst_label"),
        as_double(F.col("worst.value")).alias("worst_rating"),
        F.coalesce(_rising(change, "up", "down", "flat"), F.lit("none")).alias("status"),
        F.when(change < 0, "review").when(change >= 0, "maintain").alias("action"),
    )
    return with_text(found, "rating_month", p)
