"""Rankings, growth, running totals, funnels and purchase gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import count_rows, ratio, rows_of
from ..functions.rules import CANCELLED, recognized
from ..plans.running import running_sum
from .kpi import sales_per_product


def top_k_per_group(
    items: DataFrame,
    products: DataFrame,
    group: str = "category",
    k: int = 3,
    revenue: Column | str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The k highest product revenues in each group; tied products share a rank and are all kept.

    The rank filter becomes a per-partition limit before the shuffle, so a large
    group does not travel whole to one task.
    """
    best_first = Window.partitionBy(group).orderBy(F.desc("revenue"))
    return (
        sales_per_product(items, revenue)
        .join(products.select("product_id", group, *carry), "product_id")
        .select("product_id", group, *carry, "revenue", F.dense_rank().over(best_first).alias("ranking"))
        .where(F.col("ranking") <= k)
    )


def leader_ratio(top: DataFrame, group: str = "category") -> DataFrame:
    """Leading revenue of each group, and how many times smaller it is than the overall leader."""
    leaders = top.where("ranking = 1").groupBy(group).agg(F.max("revenue").alias("leader_revenue"))
    best = top.where("ranking = 1").agg(F.max("revenue")).scalar()
    return leaders.withColumn("times_smaller", ratio(best, F.col("leader_revenue"), 2))


def top_k_brand_concentration(top: DataFrame, group: str = "category", brand: str = "brand") -> DataFrame:
    """How many brands share a group's top products, and the largest brand's part."""
    per_brand = top.groupBy(group, brand).agg(count_rows().alias("n"))
    return (
        per_brand.groupBy(group)
        .agg(
            F.sum("n").alias("n_products"),
            count_rows().alias("n_brands"),
            F.max("n").alias("largest_brand_products"),
        )
        .withColumn("largest_brand_pct", ratio("largest_brand_products", "n_products", 2, 100))
    )


def monthly_revenue(
    orders: DataFrame,
    dims: Sequence[str] = (),
    order_date: str = "order_date",
    amount: str = "net_amount",
    excluded: Sequence[str] | None = CANCELLED,
) -> DataFrame:
    """Orders and revenue per calendar month (and ``dims``)."""
    return (
        recognized(orders, excluded)
        .groupBy(*dims, F.year(order_date).alias("year"), F.month(order_date).alias("month"))
        .agg(rows_of(orders).alias("orders"), F.sum(amount).alias("revenue"))
    )


def growth(monthly: DataFrame, measure: str = "revenue") -> DataFrame:
    """Growth over the previous month present, from one row per month."""
    previous = F.lag(measure).over(Window.orderBy("year", "month"))
    return monthly.select(
        "year", "month", F.col(measure).alias("current_revenue"), previous.alias("prev_month_revenue")
    ).withColumn(
        "mom_growth_pct",
        ratio(F.col("current_revenue") - F.col("prev_month_revenue"), "prev_month_revenue", scale=100),
    )


def mom_growth(
    orders: DataFrame,
    order_date: str = "order_date",
    amount: str = "net_amount",
    excluded: Sequence[str] | None = CANCELLED,
) -> DataFrame:
    """Month-over-month revenue growth. The lag sees one row per month."""
    return growth(monthly_revenue(orders, (), order_date, amount, excluded))


def running_total(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], measure: str, out: str = "running_total"
) -> DataFrame:
    """Cumulative sum within each partition of an already aggregated table."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(measure).over(w))


def running_total_rows(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], measure: str, out: str = "running_total"
) -> DataFrame:
    """:func:`running_total` of a table of any size, also where one partition holds most rows or there is none.

    See :func:`plans.running.running_sum`: sorted ranges are written when this is called.
    """
    return running_sum(df, partition, order, measure, out)


def funnel(
    sessions: DataFrame,
    touches: DataFrame,
    orders: DataFrame,
    dim: str = "device",
    customer: str = "customer_id",
) -> DataFrame:
    """Distinct customers with a session, of these also with a touch, of these also with an order.

    The last two stages are independent of each other. Each input is reduced to
    its customers before the join instead of multiplying their rows.
    """
    reached = (
        touches.select(customer, F.lit(1).alias("touched"))
        .unionByName(orders.select(customer, F.lit(1).alias("ordered")), allowMissingColumns=True)
        .where(F.col(customer).isNotNull())
        .groupBy(customer)
        .agg(F.max("touched").alias("touched"), F.max("ordered").alias("ordered"))
    )
    return (
        sessions.select(dim, customer)
        .distinct()
        .join(reached, customer, "left")
        .groupBy(dim)
        .agg(
            F.count(customer).alias("stage1_had_session"),
            F.count("touched").alias("stage2_had_touchpoint"),
            F.count("ordered").alias("stage3_placed_order"),
        )
        .withColumn("order_conversion_pct", ratio("stage3_placed_order", "stage1_had_session", 2, 100))
    )


def coverage(customers: DataFrame, touches: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Customers without any touch, and touches per customer."""
    touched = touches.where(F.col(customer).isNotNull()).groupBy(customer).agg(count_rows().alias("n"))
    untouched = customers.select(customer).join(touched, customer, "left_anti")
    return (
        customers.agg(count_rows().alias("n_customers"))
        .withColumn("n_untouched", untouched.agg(count_rows()).scalar())
        .withColumn("n_touches", touches.agg(count_rows()).scalar())
        .withColumn("touches_per_customer", ratio("n_touches", "n_customers", 2))
    )


def repeat_gap(orders: DataFrame, customer: str = "customer_id", order_date: str = "order_date") -> DataFrame:
    """Mean days between a customer's consecutive orders, over all gaps.

    The gaps of one customer add up to last minus first order date, so no
    ordering is needed. Customers with one order have no gap.
    """
    per_customer = orders.groupBy(customer).agg(
        F.datediff(F.max(order_date), F.min(order_date)).alias("span"), (F.count(order_date) - 1).alias("gaps")
    )
    return (
        per_customer.where("gaps > 0")
        .agg(F.sum("span").alias("total_days"), F.sum("gaps").alias("n_gaps"))
        .withColumn("avg_gap_days", ratio("total_days", "n_gaps"))
        .withColumn("avg_repeat_purchase_gap_days", F.floor("avg_gap_days").cast("int"))
    )


def winback_flag(
    orders: DataFrame,
    as_of=None,
    days: int = 90,
    customer: str = "customer_id",
    order_date: str = "order_date",
) -> DataFrame:
    """Customers with the days since their last order and whether that reaches ``days``.

    ``as_of`` defaults to the last order date of the table.
    """
    today = orders.agg(F.max(order_date)).scalar() if as_of is None else F.lit(as_of).cast("date")
    return (
        orders.where(F.col(customer).isNotNull())
        .groupBy(customer)
        .agg(F.max(order_date).alias("last_order_date"))
        .withColumn("days_since_order", F.datediff(today, F.col("last_order_date")))
        .withColumn("needs_winback", F.col("days_since_order") >= days)
    )


def growth_ratio(monthly_orders: DataFrame, monthly_signups: DataFrame) -> DataFrame:
    """Last over first month of orders, against last over first cumulative customer count.

    Inputs have one row per month: (year, month, orders) and (year, month,
    customers). Orders outgrowing customers many times over points at dates
    compressed towards the end of the window.
    """
    at = F.struct("year", "month")
    order_ends = monthly_orders.agg(
        ratio(F.max_by("orders", at), F.min_by("orders", at), 2).alias("order_growth_ratio")
    )
    customer_ends = monthly_signups.agg(ratio(F.sum("customers"), F.min_by("customers", at), 2))
    return order_ends.withColumn("customer_growth_ratio", customer_ends.scalar())
