"""Signup cohorts and the accuracy of acquisition labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_rows, month_gap, ratio
from ..functions.rules import UNPAID_LABELS


def cohort_retention(
    customers: DataFrame,
    orders: DataFrame,
    as_of,
    months: Sequence[int] = (1, 2, 3),
    customer: str = "customer_id",
    signup: str = "signup_date",
    order_date: str = "order_date",
) -> DataFrame:
    """Share of each signup-month cohort ordering again n months later.

    A rate is NULL until the whole cohort is n months old at ``as_of`` (a date or
    a scalar column). All order statuses count. Cohorts without any order are
    absent. Orders are reduced to one row per customer and month before the join,
    so that counting months at a gap counts customers.
    """
    keys = ["cohort_year", "cohort_month"]
    today = F.lit(as_of).cast("date")
    active_months = orders.select(customer, F.trunc(order_date, "month").alias("_month")).distinct()
    gap = month_gap(signup, "_month")
    # Grouping by customer keeps the partitioning of the join.
    per_customer = (
        customers.where(F.col(signup).isNotNull())
        .select(customer, signup)
        .join(active_months, customer, "left")
        .groupBy(customer, signup)
        .agg(F.count("_month").alias("_active"), *[F.count_if(gap == n).alias(f"_back_{n}") for n in months])
    )
    out = (
        per_customer.groupBy(F.year(signup).alias(keys[0]), F.month(signup).alias(keys[1]))
        .agg(
            count_rows().alias("cohort_size"),
            F.max(signup).alias("_latest"),
            F.sum("_active").alias("_active"),
            *[F.sum(f"_back_{n}").alias(f"_back_{n}") for n in months],
        )
        .where("_active > 0")
    )
    rates = [
        F.when(F.add_months("_latest", n) <= today, ratio(f"_back_{n}", "cohort_size", 1, 100)).alias(
            f"retention_month_{n}_pct"
        )
        for n in months
    ]
    return out.select(*keys, "cohort_size", *rates)


def label_match(
    customers: DataFrame,
    touches: DataFrame,
    exclude: Sequence[str] = UNPAID_LABELS,
    bound: str | None = "acquisition_date",
    customer: str = "customer_id",
    label: str = "acquisition_channel",
    ts: str = "timestamp",
    channel: str = "channel",
) -> DataFrame:
    """Paid customers by whether a touch of their credited channel exists up to the ``bound`` day.

    ``bound=None`` accepts a touch at any time. A channel's first touch decides,
    so touches are reduced to it before the join.
    """
    first_touch = touches.groupBy(customer, F.col(channel).alias(label)).agg(
        F.min(F.to_date(ts)).alias("_first_day"), F.lit(True).alias("_touched")
    )
    hit = F.col("_touched") if bound is None else F.col("_first_day") <= F.col(bound)
    per_customer = (
        customers.where(~F.col(label).isin(*exclude))
        .join(first_touch, [customer, label], "left")
        .select(F.when(hit, 1).otherwise(0).alias("matched"))
    )
    counts = per_customer.groupBy("matched").agg(count_rows().alias("customer_count"))
    total = counts.agg(F.sum("customer_count")).scalar()
    return counts.withColumn("percentage", ratio(F.col("customer_count"), total, 2, 100))
