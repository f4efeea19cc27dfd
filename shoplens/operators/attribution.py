"""First- and last-touch attribution and return on ad spend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import money, ratio
from ..functions.rules import CANCELLED, recognized
from ..plans.asof import touch_by_order_day
from ..plans.joins import lookup_join
from .kpi import spend_by_channel

MODELS = ("first", "last")


def touch_days(
    orders: DataFrame,
    touches: DataFrame,
    excluded: Sequence[str] | None = CANCELLED,
    touch_filter: Column | None = None,
) -> DataFrame:
    """Per customer and order day: orders, revenue and the two credited channels.

    ``touch_filter`` restricts what counts as a touch, for example to clicks.
    """
    used = touches if touch_filter is None else touches.where(touch_filter)
    return touch_by_order_day(recognized(orders, excluded), used)


def attribute(
    orders: DataFrame,
    touches: DataFrame,
    excluded: Sequence[str] | None = None,
    touch_filter: Column | None = None,
) -> DataFrame:
    """First and last touch channel of every order; NULL when no touch precedes the order's day."""
    day = ["customer_id", "order_date"]
    credited = touch_days(orders, touches, excluded, touch_filter).select(
        *day, "first_touch_channel", "last_touch_channel"
    )
    kept = recognized(orders, excluded).select("order_id", *day, "net_amount")
    return lookup_join(kept, credited, day, "left").select(
        "order_id", *day, "net_amount", "first_touch_channel", "last_touch_channel"
    )


def by_model(days: DataFrame, *carry: str | Column) -> DataFrame:
    """One row per model: the credited channel with the day's orders and revenue."""
    return days.select(
        *carry,
        "n_orders",
        "revenue",
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_touch_channel").alias("channel")) for m in MODELS])
        ),
    )


def attributed_revenue(days: DataFrame) -> DataFrame:
    """Revenue per model and credited channel; uncredited revenue is left out."""
    return (
        by_model(days)
        .where("channel IS NOT NULL")
        .groupBy("model", "channel")
        .agg(money(F.sum("revenue")).alias("attributed_revenue"))
    )


def roas(
    orders: DataFrame,
    touches: DataFrame,
    spend: DataFrame,
    campaigns: DataFrame,
    model: str = "first",
    excluded: Sequence[str] | None = CANCELLED,
    touch_filter: Column | None = None,
) -> DataFrame:
    """Attributed revenue over spend per channel; channels missing on either side are absent."""
    days = touch_days(orders, touches, excluded, touch_filter)
    return roas_of(days, spend_by_channel(spend, campaigns), model)


def roas_of(days: DataFrame, channel_spend: DataFrame, model: str) -> DataFrame:
    """:func:`roas` from :func:`touch_days` and spend per channel."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    credited = F.col(f"{model}_touch_channel")
    revenue = (
        days.where(credited.isNotNull())
        .groupBy(credited.alias("channel"))
        .agg(money(F.sum("revenue")).alias("attributed_revenue"))
    )
    return channel_spend.join(revenue, "channel").select(
        "channel", "total_spend", "attributed_revenue", ratio("attributed_revenue", "total_spend", 2).alias("roas")
    )


def unattributed(days: DataFrame) -> DataFrame:
    """Orders and revenue no channel is credited with, next to the totals."""
    none = F.col("first_touch_channel").isNull()
    return days.agg(
        F.sum("n_orders").alias("n_orders"),
        money(F.sum("revenue")).alias("total_revenue"),
        F.coalesce(F.sum(F.when(none, F.col("n_orders"))), F.lit(0)).alias("n_unattributed"),
        F.coalesce(money(F.sum(F.when(none, F.col("revenue")))), money(F.lit(0))).alias("unattributed_revenue"),
    )


def model_comparison(revenue: DataFrame, spend: DataFrame) -> DataFrame:
    """ROAS and rank per channel under both models, and the places gained from first to last touch.

    ``revenue`` is (model, channel, attributed_revenue) and ``spend`` is (channel,
    total_spend), one row per channel, so ranking sees only the channel list.
    """
    credit = F.col("attributed_revenue")
    per_channel = revenue.groupBy("channel").agg(
        *[F.sum(F.when(F.col("model") == m, credit)).alias(f"_{m}") for m in MODELS]
    )
    out = spend.select("channel", "total_spend").join(per_channel, "channel", "left")
    for m in MODELS:
        raw = ratio(F.coalesce(f"_{m}", F.lit(0)), "total_spend")
        out = out.withColumn(f"_{m}", raw)
    for m in MODELS:
        out = out.withColumn(f"rank_{m}", F.rank().over(Window.orderBy(F.desc(f"_{m}"))))
    return out.select(
        "channel",
        "total_spend",
        *[F.round(f"_{m}", 2).alias(f"roas_{m}") for m in MODELS],
        *[f"rank_{m}" for m in MODELS],
        (F.col("rank_first") - F.col("rank_last")).alias("places_gained"),
    )


def spend_vs_roas(comparison: DataFrame) -> DataFrame:
    """Channel spend next to both ROAS figures and the better model."""
    return comparison.select(
        "channel",
        "total_spend",
        "roas_first",
        "roas_last",
        F.when(F.col("roas_last") > F.col("roas_first"), "last")
        .when(F.col("roas_last") < F.col("roas_first"), "first")
        .otherwise("equal")
        .alias("stronger_model"),
    )
