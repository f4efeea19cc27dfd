"""Pre-aggregated cubes behind a dashboard, and the ratios derived from them.

Ratios are always computed from summed measures, never averaged.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_col, count_rows, line_revenue, money, ratio
from ..functions.rules import CANCELLED, recognized
from ..plans.joins import lookup_join
from .attribution import by_model
from .trends import growth, monthly_revenue

CRORE = 10_000_000


def in_crore(c: Column | str) -> Column:
    """Rupees in crore, to six exact decimals."""
    return F.round(as_col(c).cast("decimal(26,4)") * F.lit(Decimal(1) / CRORE), 6)


def cube_attribution(days: DataFrame) -> DataFrame:
    """Attributed revenue by order year, model and channel."""
    return (
        by_model(days, F.year("order_date").alias("year"))
        .where("channel IS NOT NULL")
        .groupBy("year", "model", "channel")
        .agg(in_crore(F.sum("revenue")).alias("revenue_cr"))
    )


def cube_spend(spend: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Spend, impressions and clicks by year and channel."""
    measures = ("spend", "impressions", "clicks")
    return (
        spend.groupBy(F.year("date").alias("year"), "campaign_id")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .join(campaigns.select("campaign_id", "channel"), "campaign_id")
        .groupBy("year", "channel")
        .agg(
            in_crore(F.sum("spend")).alias("spend_cr"),
            F.sum("impressions").alias("impressions"),
            F.sum("clicks").alias("clicks"),
        )
    )


def cube_monthly(orders: DataFrame, excluded: Sequence[str] | None = CANCELLED) -> DataFrame:
    """Orders and revenue by month and sales channel; months count from the first January in the data."""
    monthly = monthly_revenue(orders, ["sales_channel"], excluded=excluded)
    first_year = recognized(orders, excluded).agg(F.min(F.year("order_date"))).scalar()
    return monthly.select(
        ((F.col("year") - first_year) * 12 + F.col("month") - 1).alias("month_idx"),
        "sales_channel",
        "orders",
        in_crore("revenue").alias("revenue_cr"),
    )


def cube_category(
    items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    excluded: Sequence[str] | None = CANCELLED,
    revenue: Column | str | None = None,
) -> DataFrame:
    """Revenue, cost, units and returns by order year, sales channel and category.

    Excluded orders count only in returns. As in :func:`kpi.return_rate_by`, a return counts where its order has a line of
    the product. Lines and returns are summed per (order, product) in one aggregation, so that a line
    sold or returned many times is one row, and meet the orders in one join.
    """
    per_product = line_sums(items, orders, returns, F.year("order_date").alias("year"), excluded, revenue)
    return category_cube(per_product, products)


def line_sums(
    items: DataFrame,
    orders: DataFrame,
    returns: DataFrame,
    period: Column,
    excluded: Sequence[str] | None = CANCELLED,
    revenue: Column | str | None = None,
) -> DataFrame:
    """Revenue, units and returns per period of the order date, sales channel and product."""
    value = line_revenue() if revenue is None else as_col(revenue)
    line = ["order_id", "product_id"]
    lines = (
        items.select(*line, value.alias("revenue"), F.col("quantity").alias("units"), F.lit(1).alias("_line"))
        .unionByName(returns.select(*line, F.lit(1).alias("returns")), allowMissingColumns=True)
        .groupBy(*line)
        .agg(*[F.sum(m).alias(m) for m in ("revenue", "units", "returns")], F.max("_line").alias("_line"))
        .where("_line = 1")
        .drop("_line")
    )
    earns = ~F.col("order_status").isin(*excluded) if excluded else F.lit(True)
    heads = orders.select("order_id", period, "sales_channel", earns.alias("_earns"))
    return (
        lookup_join(lines, heads, ["order_id"])
        .groupBy(heads.columns[1], "sales_channel", "product_id")
        .agg(
            *[F.sum(F.when(F.col("_earns"), F.col(m))).alias(m) for m in ("revenue", "units")],
            F.sum("returns").alias("returns"),
        )
    )


def category_cube(sums: DataFrame, products: DataFrame) -> DataFrame:
    """:func:`cube_category` from sums per year or month, sales channel and product."""
    if "year" not in sums.columns:
        sums = sums.withColumn("year", F.year("order_date"))
    return (
        sums.join(products.select("product_id", "category", "cost"), "product_id")
        .groupBy("year", "sales_channel", "category")
        .agg(
            in_crore(F.sum("revenue")).alias("revenue_cr"),
            in_crore(F.sum(F.col("cost") * F.col("units"))).alias("cost_cr"),
            F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
            F.coalesce(F.sum("returns"), F.lit(0)).alias("returns"),
        )
    )


def cube_cohort(retention: DataFrame, months: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Retention by month since the first cohort, from :func:`cohorts.cohort_retention`."""
    ym = F.col("cohort_year") * 12 + F.col("cohort_month")
    first = retention.agg(F.min(ym)).scalar()
    return retention.select(
        (ym - first).alias("cohort_idx"),
        F.col("cohort_size").alias("size"),
        *[F.col(f"retention_month_{n}_pct").alias(f"m{n}") for n in months],
    )


def cube_slices(
    orders: DataFrame, spend: DataFrame, excluded: Sequence[str] | None = CANCELLED
) -> DataFrame:
    """Headline figures for every year and sales channel, and 'All' of either.

    ``slice_id`` is 0 for one year and channel, 1 for all channels, 2 for all years, 3 for both, so that a channel called
    'All' stays apart from all channels. Spend has no sales channel: a channel's slice shows the spend of its
    year and no ROAS. Facts are summed before they are cubed.
    """
    all_or = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.col(c).cast("string")).alias(c)
    sales = (
        monthly_revenue(orders, ["sales_channel"], excluded=excluded)
        .cube("year", "sales_channel")
        .agg(
            F.grouping_id().alias("slice_id"),
            all_or("year").alias("year_slice"),
            all_or("sales_channel").alias("channel_slice"),
            F.sum("orders").alias("order_count"),
            money(F.sum("revenue")).alias("total_revenue"),
        )
        .drop("year", "sales_channel")
    )
    spent = (
        spend.groupBy(F.year("date").alias("year"))
        .agg(F.sum("spend").alias("spend"))
        .cube("year")
        .agg(all_or("year").alias("year_slice"), F.sum("spend").alias("total_spend"))
        .select("year_slice", "total_spend")
    )
    return sales.join(spent, "year_slice", "left").withColumn(
        "blended_roas", F.when(F.col("slice_id") % 2 == 1, ratio("total_revenue", "total_spend", 2))
    )


# Derivations from stored cubes.


def channel_metrics(spend_cube: DataFrame, attribution_cube: DataFrame, year: int | None = None) -> DataFrame:
    """CTR and CPC of a year (or all years) with full-period ROAS of both models, per channel.

    ROAS always covers all years, because a first touch may lie in the year before its order.
    """
    chosen = F.lit(True) if year is None else F.col("year") == year
    efficiency = spend_cube.groupBy("channel").agg(
        F.sum("spend_cr").alias("spend_cr"),
        ratio(F.sum(F.when(chosen, F.col("clicks"))), F.sum(F.when(chosen, F.col("impressions"))), 2, 100).alias("ctr_pct"),
        ratio(F.sum(F.when(chosen, F.col("spend_cr"))), F.sum(F.when(chosen, F.col("clicks"))), 2, CRORE).alias("cpc"),
    )
    credit = attribution_cube.groupBy("channel").agg(
        *[F.sum(F.when(F.col("model") == m, F.col("revenue_cr"))).alias(f"_{m}") for m in ("first", "last")]
    )
    return efficiency.join(credit, "channel", "left").select(
        "channel",
        "spend_cr",
        "ctr_pct",
        "cpc",
        *[ratio(F.coalesce(f"_{m}", F.lit(0)), "spend_cr", 2).alias(f"roas_{m}") for m in ("first", "last")],
    )


def _slice(cube: DataFrame, year: int | None, sales_channel) -> DataFrame:
    if year is not None:
        cube = cube.where(F.col("year") == year)
    if sales_channel is not None:
        cube = cube.where(F.col("sales_channel") == sales_channel)
    return cube


def category_metrics(category_cube: DataFrame, year: int | None = None, sales_channel=None) -> DataFrame:
    """Revenue, share of revenue, margin and return rate per category in a slice of the cube."""
    sums = (
        _slice(category_cube, year, sales_channel)
        .groupBy("category")
        .agg(*[F.sum(m).alias(m) for m in ("revenue_cr", "cost_cr", "units", "returns")])
    )
    total = F.sum("revenue_cr").over(Window.partitionBy())  # one row per category
    return sums.select(
        "category",
        "revenue_cr",
        ratio("revenue_cr", total, 2, 100).alias("share_pct"),
        ratio(F.col("revenue_cr") - F.col("cost_cr"), "revenue_cr", 2, 100).alias("margin_pct"),
        ratio("returns", "units", 2, 100).alias("return_rate_pct"),
    )


def lowest(df: DataFrame, measure: str, k: int, tie: str) -> DataFrame:
    """The k rows with the smallest measure, such as the two lowest margins; ``tie`` orders equals."""
    return df.orderBy(F.asc_nulls_last(measure), tie).limit(k)


def highest(df: DataFrame, measure: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest measure, such as the biggest riser; ``tie`` orders equals."""
    return df.orderBy(F.desc_nulls_last(measure), tie).limit(k)


def monthly_growth(month_cube: DataFrame) -> DataFrame:
    """Month-over-month revenue growth over all sales channels of the monthly cube."""
    monthly = month_cube.groupBy("month_idx").agg(F.sum("revenue_cr").alias("revenue"))
    return growth(
        monthly.select(
            F.floor(F.col("month_idx") / 12).cast("int").alias("year"),
            (F.col("month_idx") % 12 + 1).cast("int").alias("month"),
            "revenue",
        )
    )


def headline_metrics(
    month_cube: DataFrame, spend_cube: DataFrame, first_year: int, year: int | None = None, sales_channel=None
) -> DataFrame:
    """Revenue, orders, spend and ROAS of a slice; ROAS is NULL when sliced by sales channel."""
    dated = month_cube.withColumn("year", F.floor(F.col("month_idx") / 12) + first_year)
    spend = (spend_cube if year is None else spend_cube.where(F.col("year") == year)).agg(F.sum("spend_cr")).scalar()
    return (
        _slice(dated, year, sales_channel)
        .agg(F.sum("revenue_cr").alias("revenue_cr"), F.sum("orders").alias("orders"))
        .withColumn("spend_cr", spend)
        .withColumn(
            "blended_roas",
            ratio("revenue_cr", "spend_cr", 1) if sales_channel is None else F.lit(None).cast("double"),
        )
    )
