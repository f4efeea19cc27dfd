"""All results of the four analysis levels over the ten source tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.expr import count_rows, line_revenue
from .functions.rules import UNPAID_LABELS
from .operators import attribution, cohorts, cubes, kpi, quality, segments, state, trends
from .plans.stored import Share, recompute
from .sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS

Tables = Mapping[str, DataFrame]

# First day of the data window, sources that carry no campaign,
# the interaction type that is only a view, and categorical columns to check.
WINDOW_START = date(2023, 1, 1)
UNPAID_SOURCES = ("Direct", "Organic Search")
PASSIVE_TOUCH = "impression"
CATEGORICAL = [
    ("campaigns", "channel"),
    ("orders", "sales_channel"),
    ("orders", "order_status"),
    ("orders", "payment_method"),
    ("sessions", "device"),
]
DATE_COLUMNS = {
    "campaigns": ["start_date", "end_date"],
    "customers": ["signup_date", "acquisition_date"],
    "marketing_spend": ["date"],
    "marketing_touchpoints": ["timestamp"],
    "order_items": [],
    "orders": ["order_date"],
    "products": [],
    "returns": ["return_date"],
    "sessions": ["session_start"],
    "stores": [],
}
# Sort keys of the published results, where one is stated; a leading "-" sorts descending. The last key makes the order total.
ORDER_BY = {
    "null_campaign_by_acquisition_channel": ["acquisition_channel"],
    "channel_efficiency": ["cost_per_click", "channel"],
    "budget_variance": ["-overspend_amount", "campaign_id"],
    "margin_by_category": ["-total_revenue", "category"],
    "margin_by_brand": ["-total_revenue", "brand"],
    "returns_by_reason": ["-total_refund", "return_reason"],
    "return_rate_by_category": ["-total_refunds", "category"],
    "top_products": ["category", "ranking", "product_id"],
    "mom_growth": ["year", "month"],
    "running_total": ["sales_channel", "year", "month"],
    "rfm": ["customer_id"],
    "channel_diversity_value": ["channel_count"],
    "cohort_retention": ["cohort_year", "cohort_month"],
    "attribution": ["order_id"],
    "roas_first": ["-roas", "channel"],
    "roas_last": ["-roas", "channel"],
}


def _stack(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _for_columns(t: Tables, check) -> DataFrame:
    return _stack(
        check(t[table], col).select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"), "*")
        for table, col in CATEGORICAL
    )


def spend_rules():
    return {"clicks_above_impressions": F.col("clicks") > F.col("impressions"), "negative_spend": F.col("spend") < 0}


def reconciled_net():
    return F.col("gross_amount") - F.col("discount_amount") + F.col("shipping_amount")


def data_quality(t: Tables, window_start: date = WINDOW_START, sums: Tables | None = None) -> dict[str, DataFrame]:
    """Level 1: profiling and data-quality checks."""
    summed = {**t, "orders": (sums or sums_of(t))["orders"]}  # the same values, with counts
    touches_outside = quality.outside_parent_window(
        t["marketing_touchpoints"],
        t["campaigns"],
        "campaign_id",
        "timestamp",
        "start_date",
        "end_date",
        PRIMARY_KEYS["marketing_touchpoints"],
    )
    before_signup = quality.before_parent(
        t["orders"], t["customers"], "customer_id", "order_date", "signup_date", PRIMARY_KEYS["orders"]
    )
    over_line = quality.refund_exceeds_line(t["returns"], t["order_items"], row_id=PRIMARY_KEYS["returns"])
    over_order = quality.refund_exceeds_order(t["returns"], t["orders"], row_id=PRIMARY_KEYS["returns"])
    relations = [
        quality.Relation(f"{child}.{'+'.join(keys)}->{parent}", child, keys, parent, PRIMARY_KEYS[parent][: len(keys)])
        for child, keys, parent in [*FOREIGN_KEYS, ("returns", ["order_id"], "orders")]
    ]
    orphans = quality.orphan_report(t, relations)
    null_rules = [
        quality.null_rule_holds(
            t["customers"], "acquisition_campaign_id", F.col("acquisition_channel").isin(*UNPAID_LABELS)
        ),
        quality.null_rule_holds(t["orders"], "store_id", F.col("sales_channel") == "Online"),
        quality.null_rule_holds(t["sessions"], "campaign_id", F.col("source").isin(*UNPAID_SOURCES)),
    ]
    campaign_rules = {"ends_before_start": F.col("end_date") < F.col("start_date")}

    def holds(col: str, should_be_null):
        return F.col(col).isNull() != F.coalesce(should_be_null, F.lit(False))

    line = ["order_id", "product_id"]
    lines = t["order_items"].select(*line, line_revenue().alias("item_line_value"))
    nets = t["orders"].select("order_id", F.col("net_amount").alias("order_net_amount"))
    checked = F.concat(F.lit("orphan "), F.col("relation")), F.split_part("relation", F.lit("."), F.lit(1))
    report = [
        quality.relation_checks(
            t["customers"], "customers", t["orders"], "orders", "customer_id",
            parent_rules={
                "acquired_before_window": F.col("acquisition_date") < window_start,
                "null_rule acquisition_campaign_id": holds("acquisition_campaign_id", F.col("acquisition_channel").isin(*UNPAID_LABELS)),
            },
            child_rules={
                "net_amount_off": F.round(reconciled_net(), 2) != F.col("net_amount"),
                "null_rule store_id": holds("store_id", F.col("sales_channel") == "Online"),
            },
            outside=("order_before_signup", "order_date", "signup_date", None),
        ),
        quality.relation_checks(
            t["campaigns"], "campaigns", t["marketing_touchpoints"], "marketing_touchpoints", "campaign_id", parent_rules=campaign_rules,
            outside=("touch_outside_campaign", "timestamp", "start_date", "end_date"),
        ),
        quality.violation_counts(t["marketing_spend"], spend_rules(), "marketing_spend"),
        quality.violation_counts(t["sessions"], {"null_rule campaign_id": holds("campaign_id", F.col("source").isin(*UNPAID_SOURCES))}, "sessions"),
        quality.table_checks(
            t["returns"], "returns",
            {"refund_exceeds_line": F.col("refund_amount") > F.col("item_line_value"), "refund_exceeds_order": F.col("refund_amount") > F.col("order_net_amount")},
            [(lines, line), (nets, ["order_id"])],
        ),
        orphans.select(checked[0].alias("check_name"), checked[1].alias("table_name"), F.col("n_rows").alias("n_checked"), F.col("n_orphan").alias("n_failed")),
    ]
    return {
        "profile": quality.profile_all({n: (t[n], cols) for n, cols in DATE_COLUMNS.items()}),
        "touches_outside_campaign": touches_outside,
        "acquired_before_window": quality.before_date(t["customers"], "acquisition_date", window_start),
        "orphans": orphans,
        "duplicate_keys": _stack(
            quality.duplicate_keys(t[n], keys).select(
                F.lit(n).alias("table_name"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys]).alias("key"), "n_rows"
            )
            for n, keys in PRIMARY_KEYS.items()
        ),
        "null_sweep": _stack(
            quality.null_sweep(t[n]).select(F.lit(n).alias("table_name"), "*")
            for n in ("customers", "orders", "sessions")
        ),
        "null_campaign_by_acquisition_channel": quality.null_by(
            t["customers"], "acquisition_channel", "acquisition_campaign_id"
        ),
        "null_store_by_sales_channel": quality.null_by(t["orders"], "sales_channel", "store_id"),
        "null_campaign_by_session_source": quality.null_by(t["sessions"], "source", "campaign_id"),
        "null_rules": _stack(null_rules),
        "whitespace_values": _for_columns(summed, quality.whitespace_values),
        "near_duplicate_values": _for_columns(summed, quality.near_duplicate_values),
        "spend_violations": quality.violations(t["marketing_spend"], spend_rules()),
        "campaign_violations": quality.violations(t["campaigns"], campaign_rules),
        "orders_before_signup": before_signup,
        "refund_exceeds_line": over_line,
        "refund_exceeds_order": over_order,
        "net_amount_reconciliation": quality.reconcile(t["orders"], reconciled_net(), "net_amount"),
        "return_window_open": quality.censored_tail(t["orders"], t["returns"]),
        "quality_report": quality.quality_report(report),
    }


def sums_of(t: Tables, share: Share = recompute) -> dict[str, DataFrame]:
    """Orders summed per month, channel and status, and order lines per product: what most results need of these facts."""
    return {
        "orders": share(state.order_sums(t["orders"], ["sales_channel", "order_status", "payment_method"]), "order_sums"),
        "order_items": share(kpi.product_sums(t["order_items"]), "product_sums"),
    }


def core_kpis(t: Tables, share: Share = recompute, sums: Tables | None = None) -> dict[str, DataFrame]:
    """Level 2: revenue, channel efficiency, budgets, margins and returns."""
    products, spend, campaigns = t["products"], t["marketing_spend"], t["campaigns"]
    orders, items = (sums or sums_of(t)).values()
    variance = kpi.budget_variance(spend, campaigns)
    by_category = kpi.margin_by(items, products, "category")
    rates = share(kpi.return_rate_by(t["order_items"], products, t["returns"], "category"), "return_rates")
    return {
        "revenue_by_sales_channel": kpi.revenue_by(orders),
        "aov_shift": kpi.aov_shift(orders),
        "channel_efficiency": kpi.channel_efficiency(spend, campaigns),
        "budget_variance": variance,
        "overspend_rate": kpi.overspend_rate(variance),
        "margin_by_category": by_category,
        "margin_by_brand": kpi.margin_by(items, products, "brand"),
        "units_and_asp": kpi.units_and_asp(items, products, "category"),
        "category_share": kpi.share_of_total(by_category, "category", "total_revenue"),
        "returns_by_reason": kpi.returns_by(t["returns"], "return_reason"),
        "return_rate_by_category": rates,
        "refund_share": kpi.refund_share(rates),
        "headline": kpi.headline(orders, spend),
        "cpa_by_channel": kpi.cpa_by_channel(spend, campaigns, t["customers"]),
    }


def trends_and_behaviour(t: Tables, sums: Tables | None = None) -> dict[str, DataFrame]:
    """Level 3: rankings, growth, running totals, funnel and purchase gaps."""
    orders, touches = t["orders"], t["marketing_touchpoints"]
    monthly, sold = (sums or sums_of(t)).values()
    top = trends.top_k_per_group(sold, t["products"], "category", 3, carry=["brand"])
    signups = (
        t["customers"]
        .where("signup_date IS NOT NULL")
        .groupBy(F.year("signup_date").alias("year"), F.month("signup_date").alias("month"))
        .agg(count_rows().alias("customers"))
    )
    by_channel = trends.monthly_revenue(monthly, ["sales_channel"])
    return {
        "top_products": top,
        "leader_ratio": trends.leader_ratio(top),
        "brand_concentration": trends.top_k_brand_concentration(top),
        "mom_growth": trends.mom_growth(monthly),
        "running_total": trends.running_total(by_channel, ["sales_channel"], ["year", "month"], "revenue"),
        "funnel": trends.funnel(t["sessions"], touches, orders),
        "coverage": trends.coverage(t["customers"], touches),
        "repeat_gap": trends.repeat_gap(orders),
        "winback": trends.winback_flag(orders),
        "growth_ratio": trends.growth_ratio(trends.monthly_revenue(monthly), signups),
    }


def advanced(t: Tables, share: Share = recompute, sums: Tables | None = None) -> dict[str, DataFrame]:
    """Level 4: segments, cohorts, label accuracy, attribution, ROAS and the dashboard's cubes."""
    monthly = (sums or sums_of(t, share))["orders"]
    orders, touches = t["orders"], t["marketing_touchpoints"]
    spend, campaigns = t["marketing_spend"], t["campaigns"]
    last_day = orders.agg(F.max("order_date")).scalar()
    scored = share(segments.rfm(orders), "rfm")
    days = share(attribution.touch_days(orders, touches), "touch_days")
    engaged = F.lower("interaction_type") != PASSIVE_TOUCH
    engaged_days = attribution.touch_days(orders, touches, touch_filter=engaged)
    per_channel = share(kpi.spend_by_channel(spend, campaigns), "spend_by_channel")
    compared = share(attribution.model_comparison(attribution.attributed_revenue(days), per_channel), "comparison")
    retention = share(cohorts.cohort_retention(t["customers"], orders, last_day), "retention")
    return {
        "rfm": scored,
        "rfm_coverage": segments.rfm_coverage(scored, orders),
        "segment_summary": segments.segment_summary(scored),
        "channel_diversity_value": segments.channel_diversity_value(touches, orders),
        "cohort_retention": retention,
        "label_match": cohorts.label_match(t["customers"], touches),
        "label_match_any_time": cohorts.label_match(t["customers"], touches, bound=None),
        "attribution": attribution.attribute(orders, touches),
        "roas_first": attribution.roas_of(days, per_channel, "first"),
        "roas_last": attribution.roas_of(days, per_channel, "last"),
        "unattributed": attribution.unattributed(days),
        "model_comparison": compared,
        "model_comparison_engaged": attribution.model_comparison(
            attribution.attributed_revenue(engaged_days), per_channel
        ),
        "spend_vs_roas": attribution.spend_vs_roas(compared),
        "cube_attribution": cubes.cube_attribution(days),
        "cube_spend": cubes.cube_spend(spend, campaigns),
        "cube_monthly": cubes.cube_monthly(monthly),
        "cube_category": cubes.cube_category(t["order_items"], orders, t["products"], t["returns"]),
        "cube_cohort": cubes.cube_cohort(retention),
        "cube_slices": cubes.cube_slices(monthly, spend),
    }


def analyse(t: Tables, share: Share = recompute) -> dict[str, DataFrame]:
    """Every result as a DataFrame by name.

    ``share`` decides what happens to intermediates several results need: kept
    lazy by default, or written once (see :func:`plans.stored`).
    """
    sums = sums_of(t, share)
    return {**data_quality(t, sums=sums), **core_kpis(t, share, sums), **trends_and_behaviour(t, sums), **advanced(t, share, sums)}
