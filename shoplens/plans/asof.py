"""Strictly-before-the-day as-of lookup of marketing touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def touch_by_order_day(
    orders: DataFrame,
    touches: DataFrame,
    *,
    customer: str = "customer_id",
    order_date: str = "order_date",
    amount: str = "net_amount",
    ts: str = "timestamp",
    touch_id: str = "touchpoint_id",
    channel: str = "channel",
) -> DataFrame:
    """First and last touch before each customer's order days.

    Returns one row per (customer, order date) with the day's order count and
    revenue and the channels of the customer's first and last touch before that
    day; ties on the timestamp go to the lower / higher touch id.

    A touch counts for an order exactly when its calendar day is earlier, so
    both inputs are first reduced to one row per (customer, day), with map-side
    combine. The ordered window then sees at most one row per calendar day of a
    customer, however many touches or orders a single customer has.
    """
    day_touches = (
        touches.where(F.col(customer).isNotNull() & F.col(ts).isNotNull())
        .select(
            customer,
            F.to_date(ts).alias("_day"),
            F.struct(F.col(ts).alias("at"), F.col(touch_id).alias("id"), F.col(channel).alias("channel")).alias("_touch"),
        )
    )
    day_orders = orders.select(
        customer, F.col(order_date).alias("_day"), F.lit(1).alias("_order"), F.col(amount).alias("_amount")
    )
    daily = (
        day_touches.unionByName(day_orders, allowMissingColumns=True)
        .groupBy(customer, "_day")
        .agg(
            F.min("_touch").alias("_first"),
            F.max("_touch").alias("_last"),
            F.count("_order").alias("n_orders"),
            F.sum("_amount").alias("revenue"),
        )
        # A struct keeps "touch without a channel" apart from "no touch".
        .withColumn("_first", F.when(F.col("_first").isNotNull(), F.struct("_first.channel")))
        .withColumn("_last", F.when(F.col("_last").isNotNull(), F.struct("_last.channel")))
    )
    earlier = Window.partitionBy(customer).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return (
        daily.select(
            customer,
            F.col("_day").alias(order_date),
            "n_orders",
            "revenue",
            F.first("_first", ignorenulls=True).over(earlier).alias("_f"),
            F.last("_last", ignorenulls=True).over(earlier).alias("_l"),
        )
        .where("n_orders > 0")
        .select(
            customer,
            order_date,
            "n_orders",
            "revenue",
            F.col("_f.channel").alias("first_touch_channel"),
            F.col("_l.channel").alias("last_touch_channel"),
        )
    )
