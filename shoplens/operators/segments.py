"""RFM segmentation and the value of channel diversity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_rows, money, ratio
from ..functions.rules import CANCELLED, recognized
from ..plans.ntile import exact_ntile
from ..plans.stored import keep

# Lowest total score of each segment, best first, and the rest.
SEGMENTS = ((12, "Champions"), (9, "Loyal Customers"), (6, "At Risk"))
REST = "Lost"


def rfm(
    orders: DataFrame,
    as_of=None,
    excluded: Sequence[str] | None = CANCELLED,
    buckets: int = 5,
    customer: str = "customer_id",
    order_date: str = "order_date",
    amount: str = "net_amount",
) -> DataFrame:
    """Recency, frequency and monetary scores and segment per customer.

    One aggregation over the orders feeds all three scores. Customers without a
    counted order are absent. ``as_of`` defaults to the last counted order date.
    """
    counted = recognized(orders, excluded)
    per_customer = (
        counted.groupBy(customer)
        .agg(
            F.max(order_date).alias("last_order"),
            count_rows().alias("number_of_orders"),
            money(F.sum(amount)).alias("total_value"),
        )
    )
    # The orders are read once; the edges, the last date and the rows all come from this table.
    per_customer = keep(per_customer, "customers")
    today = per_customer.agg(F.max("last_order")).scalar() if as_of is None else F.lit(as_of).cast("date")
    scored = exact_ntile(
        per_customer.where(F.col(customer).isNotNull()),
        customer,
        {
            # The latest order last, so that recent customers get the top bucket.
            "r_score": F.unix_date("last_order"),
            "f_score": F.col("number_of_orders"),
            "m_score": F.col("total_value") * 100,
        },
        buckets,
    )
    total = F.col("rfm_total")
    segment = F.lit(REST)
    for lowest, name in reversed(SEGMENTS):
        segment = F.when(total >= lowest, name).otherwise(segment)
    return (
        scored.withColumn("gap_in_recent_order", F.datediff(today, F.col("last_order")))
        .withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score"))
        .withColumn("customer_segment", segment)
        .select(
            customer,
            "gap_in_recent_order",
            "number_of_orders",
            "total_value",
            "r_score",
            "f_score",
            "m_score",
            "rfm_total",
            "customer_segment",
        )
    )


def rfm_coverage(
    rfm_rows: DataFrame,
    orders: DataFrame,
    excluded: Sequence[str] | None = CANCELLED,
    customer: str = "customer_id",
) -> DataFrame:
    """Segmented customers against customers with a counted order, and those with none."""
    eligible = recognized(orders, excluded).agg(F.countDistinct(customer)).scalar()
    everyone = orders.agg(F.countDistinct(customer)).scalar()
    return (
        rfm_rows.agg(count_rows().alias("n_segmented"))
        .withColumn("n_eligible", eligible)
        .withColumn("n_only_excluded", everyone - F.col("n_eligible"))
        .withColumn("complete", F.col("n_segmented") == F.col("n_eligible"))
    )


def segment_summary(rfm_rows: DataFrame) -> DataFrame:
    """Customers, orders and value per segment."""
    return rfm_rows.groupBy("customer_segment").agg(
        count_rows().alias("n_customers"),
        F.sum("number_of_orders").alias("n_orders"),
        money(F.sum("total_value")).alias("total_value"),
        ratio(F.sum("total_value"), count_rows(), 2).alias("avg_customer_value"),
    )


def channel_diversity_value(
    touches: DataFrame,
    orders: DataFrame,
    excluded: Sequence[str] | None = CANCELLED,
    customer: str = "customer_id",
    channel: str = "channel",
    amount: str = "net_amount",
) -> DataFrame:
    """Conversion and average value of customers by how many channels reached them."""
    channels = touches.groupBy(customer).agg(F.countDistinct(channel).alias("channel_count"))
    value = (
        recognized(orders, excluded)
        .where(F.col(customer).isNotNull())
        .groupBy(customer)
        .agg(money(F.sum(amount)).alias("total_value"))
    )
    return (
        channels.join(value, customer, "left")
        .groupBy("channel_count")
        .agg(
            count_rows().alias("total_customers"),
            F.count("total_value").alias("customers_who_ordered"),
            ratio(F.coalesce(F.sum("total_value"), F.lit(0)), count_rows(), 2).alias("avg_customer_value"),
        )
        .withColumn("conversion_rate_pct", ratio("customers_who_ordered", "total_customers", 1, 100))
    )
