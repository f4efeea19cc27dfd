"""Core KPIs: revenue, channel efficiency, budgets, margins and returns.

Facts are summed per join key before they meet a dimension, so every join has
one row per key on both sides whatever the distribution of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_col, count_rows, line_revenue, money, ratio, rows_of, values_of
from ..functions.rules import CANCELLED, recognized
from ..plans.joins import lookup_join
from ..plans.running import running_rank
from ..plans.stored import keep


def revenue_by(
    orders: DataFrame,
    dims: Sequence[str] = ("sales_channel",),
    amount: str = "net_amount",
    excluded: Sequence[str] | None = CANCELLED,
) -> DataFrame:
    """Order count, revenue and average order value."""
    return (
        recognized(orders, excluded)
        .groupBy(*dims)
        .agg(
            rows_of(orders).alias("order_count"),
            money(F.sum(amount)).alias("total_revenue"),
            ratio(F.sum(amount), values_of(orders, amount)).alias("aov"),
        )
    )


def aov_shift(
    orders: DataFrame,
    dims: Sequence[str] = ("sales_channel",),
    amount: str = "net_amount",
    excluded: Sequence[str] = CANCELLED,
    status: str = "order_status",
) -> DataFrame:
    """How much leaving out the excluded statuses moves the average order value."""
    earns = ~F.col(status).isin(*excluded)
    kept = F.when(earns, F.col(amount))
    n_kept = F.sum(F.when(earns, F.col("_values"))) if "_values" in orders.columns else F.count(kept)
    return (
        orders.groupBy(*dims)
        .agg(
            ratio(F.sum(amount), values_of(orders, amount)).alias("aov_all"),
            ratio(F.sum(kept), n_kept).alias("aov_recognized"),
        )
        .withColumn("aov_shift_pct", ratio(F.col("aov_recognized") - F.col("aov_all"), "aov_all", 2, 100))
    )


def spend_per_campaign(spend: DataFrame, campaign: str = "campaign_id") -> DataFrame:
    return spend.groupBy(campaign).agg(
        F.sum("spend").alias("total_spend"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
    )


def spend_by_channel(spend: DataFrame, campaigns: DataFrame, channel: str = "channel") -> DataFrame:
    """Spend, impressions and clicks per marketing channel."""
    return (
        spend_per_campaign(spend)
        .join(campaigns.select("campaign_id", channel), "campaign_id")
        .groupBy(channel)
        .agg(*[F.sum(c).alias(c) for c in ("total_spend", "total_impressions", "total_clicks")])
    )


def channel_efficiency(spend: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Click-through rate and cost per click of each channel, as ratios of sums."""
    return (
        spend_by_channel(spend, campaigns)
        .withColumn("click_through_rate_pct", ratio("total_clicks", "total_impressions", 2, 100))
        .withColumn("cost_per_click", ratio("total_spend", "total_clicks", 2))
    )


def budget_variance(spend: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Spend against budget per campaign; campaigns without spend are absent."""
    over = F.col("total_spend") - F.col("budget")
    return (
        spend_per_campaign(spend)
        .join(campaigns.select("campaign_id", "channel", "budget"), "campaign_id")
        .select(
            "campaign_id",
            "channel",
            "budget",
            "total_spend",
            over.alias("overspend_amount"),
            ratio(over, "budget", 2, 100).alias("overspend_pct"),
        )
    )


def overspend_rate(variance: DataFrame, dim: str = "channel") -> DataFrame:
    """Share of campaigns above budget."""
    return (
        variance.groupBy(dim)
        .agg(count_rows().alias("n_campaigns"), F.count_if(F.col("overspend_amount") > 0).alias("n_overspent"))
        .withColumn("overspend_rate_pct", ratio("n_overspent", "n_campaigns", 2, 100))
    )


def recognized_items(
    items: DataFrame, orders: DataFrame | None, excluded: Sequence[str] | None
) -> DataFrame:
    """Order lines of recognised orders; all lines when nothing is excluded."""
    if not excluded:
        return items
    kept = recognized(orders, excluded).select("order_id")
    return lookup_join(items, kept, ["order_id"])


def sales_per_product(
    items: DataFrame, revenue: Column | str | None = None, extra_keys: Sequence[str] = ()
) -> DataFrame:
    """Revenue, units and line counts per product, before any join. Sums by :func:`product_sums` are taken as they are."""
    if "costed_units" in items.columns and not extra_keys:
        return items.select("product_id", "revenue", "units", "costed_units")
    value = line_revenue() if revenue is None else as_col(revenue)
    return items.groupBy(*extra_keys, "product_id").agg(
        F.sum(value).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.sum(F.when(value.isNotNull(), F.col("quantity"))).alias("costed_units"),
    )


def product_sums(items: DataFrame, price: Column | str = "unit_price", revenue: Column | str | None = None) -> DataFrame:
    """All that the operators here need of order lines, per product: one scan for margins, units, prices and top lists."""
    value = line_revenue() if revenue is None else as_col(revenue)
    return items.groupBy("product_id").agg(
        F.sum(value).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.sum(F.when(value.isNotNull(), F.col("quantity"))).alias("costed_units"),
        F.sum(as_col(price)).alias("price_sum"),
        F.count(as_col(price)).alias("price_n"),
    )


def margin_by(
    items: DataFrame,
    products: DataFrame,
    dim: str = "category",
    orders: DataFrame | None = None,
    excluded: Sequence[str] | None = None,
    revenue: Column | str | None = None,
) -> DataFrame:
    """Revenue, profit and margin per product attribute.

    All orders count by default; give ``orders`` and ``excluded`` to leave some out.
    """
    per_product = sales_per_product(recognized_items(items, orders, excluded), revenue)
    profit = F.col("revenue") - F.col("cost") * F.col("costed_units")
    return (
        per_product.join(products.select("product_id", dim, "cost"), "product_id")
        .groupBy(dim)
        .agg(F.sum("revenue").alias("total_revenue"), F.sum(profit).alias("total_profit"))
        .withColumn("profit_margin_pct", ratio("total_profit", "total_revenue", 2, 100))
    )


def units_and_asp(
    items: DataFrame,
    products: DataFrame,
    dim: str = "category",
    price: Column | str = "unit_price",
    revenue: Column | str | None = None,
    wide: bool = False,
) -> DataFrame:
    """Units sold with their rank, mean price per line and revenue per unit.

    The rank orders one row per value of ``dim`` in one task, which is right for categories. ``wide`` ranks a domain of any size, such as
    all products, by counts of ranges (:func:`plans.running.running_rank`), and reads the sums from a table that it writes.
    """
    sums = ("units", "revenue", "price_sum", "price_n")
    per_product = (items if "price_n" in items.columns else product_sums(items, price, revenue)).select("product_id", *sums)
    per_value = (
        per_product.join(products.select(*dict.fromkeys(["product_id", dim])), "product_id")
        .groupBy(dim)
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            dim,
            "units",
            ratio("price_sum", "price_n", 2).alias("avg_line_price"),
            ratio("revenue", "units", 2).alias("revenue_per_unit"),
        )
    )
    if wide:
        return running_rank(keep(per_value, "units"), "units", "units_rank")
    return per_value.withColumn("units_rank", F.rank().over(Window.orderBy(F.desc("units"))))


def share_of_total(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """Each row's percentage of the measure's total."""
    total = df.agg(F.sum(measure)).scalar()
    return df.select(dim, measure, ratio(F.col(measure), total, 2, 100).alias("share_pct"))


def returns_by(returns: DataFrame, dim: str = "return_reason", refund: str = "refund_amount") -> DataFrame:
    """Number of returns and refunded value."""
    return returns.groupBy(dim).agg(count_rows().alias("total_returns"), F.sum(refund).alias("total_refund"))


def return_rate_by(
    items: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    dim: str = "category",
    fanout: bool = False,
) -> DataFrame:
    """Units sold, returns, returns per 100 units and refunds.

    Returns are summed per order line before the join, so a line returned twice
    still counts its units once; ``fanout=True`` repeats its units per return as
    a plain left join would. Returns whose line does not exist are not counted.
    """
    line = ["order_id", "product_id"]
    sold = items.groupBy(*line).agg(F.sum("quantity").alias("units"))
    back = returns.groupBy(*line).agg(count_rows().alias("n"), F.sum("refund_amount").alias("refund"))
    units = F.col("units") * F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) if fanout else F.col("units")
    per_product = (
        sold.join(back, line, "left")
        .groupBy("product_id")
        .agg(F.sum(units).alias("units"), F.sum("n").alias("n"), F.sum("refund").alias("refund"))
    )
    return (
        per_product.join(products.select("product_id", dim), "product_id")
        .groupBy(dim)
        .agg(
            F.sum("units").alias("total_sold"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_returns"),
            F.sum("refund").alias("total_refunds"),
        )
        .withColumn("return_rate_pct", ratio("total_returns", "total_sold", 2, 100))
    )


def refund_share(return_rates: DataFrame, dim: str = "category") -> DataFrame:
    """Each group's percentage of all refunds, from :func:`return_rate_by`."""
    return share_of_total(return_rates, dim, "total_refunds")


def headline(
    orders: DataFrame,
    spend: DataFrame,
    excluded: Sequence[str] | None = CANCELLED,
    amount: str = "net_amount",
) -> DataFrame:
    """Revenue, orders, marketing spend and revenue per unit of spend."""
    spent = spend.agg(F.sum("spend")).scalar()
    return (
        recognized(orders, excluded)
        .agg(money(F.sum(amount)).alias("total_revenue"), rows_of(orders).cast("bigint").alias("order_count"))
        .withColumn("total_spend", spent)
        .withColumn("blended_roas", ratio("total_revenue", "total_spend", 2))
    )


def cpa_by_channel(
    spend: DataFrame, campaigns: DataFrame, customers: DataFrame, acquired_by: str = "acquisition_channel"
) -> DataFrame:
    """Spend per newly acquired customer; channels without spend or customers are absent."""
    acquired = customers.groupBy(F.col(acquired_by).alias("channel")).agg(count_rows().alias("new_customers"))
    return (
        spend_by_channel(spend, campaigns)
        .join(acquired, "channel")
        .select(
            "channel",
            "total_spend",
            "new_customers",
            ratio("total_spend", "new_customers", 2).alias("cost_per_acquisition"),
        )
    )
