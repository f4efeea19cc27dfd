"""KPIs, trends, segments, cohorts and cubes on small literal tables."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shoplens.functions import month_gap, padding_chars, ratio, recognized
from shoplens.operators import attribution, cohorts, cubes, kpi, segments, trends

ORDER = """order_id string, customer_id string, order_date date, sales_channel string, order_status string,
           net_amount decimal(8,2)"""


def D(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0].asDict()


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [
            ("O1", "a", date(2023, 1, 31), "Online", "Completed", D(100)),
            ("O2", "a", date(2023, 2, 1), "Online", "Cancelled", D(400)),
            ("O3", "a", date(2023, 4, 30), "In-Store", "Returned", D(50)),
            ("O4", "b", date(2023, 2, 10), "Online", "Pending", D(200)),
            ("O5", "x", date(2023, 2, 11), "Online", "Cancelled", D(999)),
            ("O6", "b", date(2023, 2, 10), "Online", None, D(1)),
            ("O7", None, date(2024, 1, 5), "In-Store", "Completed", D(25)),
        ],
        ORDER,
    )


def test_recognized_drops_unknown_status_unless_everything_counts(orders):
    assert rows(recognized(orders), "order_id") == [("O1",), ("O3",), ("O4",), ("O7",)]
    assert recognized(orders, None).count() == 7


def test_scalars(spark):
    t = spark.createDataFrame([(date(2024, 1, 31), date(2024, 2, 1))], "a date, b date")
    got = t.select(
        month_gap("a", "b"), month_gap("b", "a"), F.add_months("a", 1), padding_chars(F.lit(" ab  ")),
        ratio(F.lit(1), F.lit(0)), ratio(F.lit(1), F.lit(8), 2), ratio(F.lit(-1), F.lit(8), 2),
    ).first()
    assert tuple(got) == (1, -1, date(2024, 2, 29), 3, None, 0.13, -0.13)


def test_revenue_and_aov(orders):
    assert rows(kpi.revenue_by(orders)) == [
        ("In-Store", 2, D(75), 37.5), ("Online", 2, D(300), 150.0)]
    shift = {r[0]: r["aov_shift_pct"] for r in kpi.aov_shift(orders).collect()}
    assert shift == {"In-Store": 0.0, "Online": round((150 - 340) / 340 * 100, 2)}


@pytest.fixture(scope="module")
def marketing(spark):
    campaigns = spark.createDataFrame(
        [("C1", "SMS", 100), ("C2", "SMS", 10), ("C3", "Email", 0), ("C4", "Display", 50)],
        "campaign_id string, channel string, budget int",
    )
    spend = spark.createDataFrame(
        [
            (date(2023, 1, 1), "C1", 60, 1000, 30), (date(2024, 1, 2), "C1", 60, 1000, 10),
            (date(2023, 1, 1), "C2", 10, 0, 0), (date(2023, 1, 1), "C3", 5, 0, 0), (date(2023, 1, 1), "C9", 7, 1, 1),
        ],
        "date date, campaign_id string, spend int, impressions int, clicks int",
    )
    return spend, campaigns


def test_channel_efficiency_is_a_ratio_of_sums(marketing):
    got = {r["channel"]: r.asDict() for r in kpi.channel_efficiency(*marketing).collect()}
    assert set(got) == {"SMS", "Email"}
    assert (got["SMS"]["click_through_rate_pct"], got["SMS"]["cost_per_click"]) == (2.0, 3.25)
    assert (got["Email"]["click_through_rate_pct"], got["Email"]["cost_per_click"]) == (None, None)


def test_budgets(marketing):
    variance = kpi.budget_variance(*marketing)
    assert rows(variance, "campaign_id", "overspend_amount", "overspend_pct") == [
        ("C1", 20, 20.0), ("C2", 0, 0.0), ("C3", 5, None)]
    assert rows(kpi.overspend_rate(variance)) == [("Email", 1, 1, 100.0), ("SMS", 2, 1, 50.0)]


@pytest.fixture(scope="module")
def baskets(spark):
    products = spark.createDataFrame(
        [("P1", "Books", "A", D(5)), ("P2", "Books", "B", D(1)), ("P3", "Toys", "A", None), ("P4", "Books", "A", D(2))],
        "product_id string, category string, brand string, cost decimal(8,2)",
    )
    items = spark.createDataFrame(
        [
            ("O1", "P1", 2, D(10), D(1)), ("O1", "P2", 1, D(19), D(0)), ("O2", "P1", 1, D(10), D(0)),
            ("O3", "P3", 4, D(5), D(0)), ("O4", "P4", 1, D(3), None), ("O4", "P9", 1, D(1000), D(0)),
        ],
        "order_id string, product_id string, quantity int, unit_price decimal(8,2), discount_amount decimal(8,2)",
    )
    returns = spark.createDataFrame(
        [
            ("R1", "O1", "P1", date(2023, 2, 2), "Late", D(10)), ("R2", "O1", "P1", date(2023, 2, 3), "Late", D(10)),
            ("R3", "O3", "P3", date(2023, 5, 2), "Size", D(7)), ("R4", "O9", "P2", date(2023, 5, 2), "Size", D(7)),
        ],
        "return_id string, order_id string, product_id string, return_date date, return_reason string, refund_amount decimal(8,2)",
    )
    return items, products, returns


def test_margin(orders, baskets):
    items, products, _ = baskets
    # A line without a discount value has no revenue and no cost; a product without cost has no profit.
    got = {r[0]: (r["total_revenue"], r["total_profit"], r["profit_margin_pct"]) for r in kpi.margin_by(items, products).collect()}
    assert got == {"Books": (D(48), D(32), 66.67), "Toys": (D(20), None, None)}
    kept = kpi.margin_by(items, products, "brand", orders, ("Cancelled",))
    assert {r[0]: r["total_revenue"] for r in kept.collect()} == {"A": D(39), "B": D(19)}


def test_units_asp_and_share(baskets):
    items, products, _ = baskets
    got = {r["category"]: r.asDict() for r in kpi.units_and_asp(items, products).collect()}
    assert got["Books"]["units"] == 5 and got["Books"]["avg_line_price"] == 10.5
    assert got["Toys"]["units_rank"] == 2 and got["Toys"]["revenue_per_unit"] == 5.0
    shares = kpi.share_of_total(kpi.margin_by(items, products), "category", "total_revenue")
    assert rows(shares, "category", "share_pct") == [("Books", 70.59), ("Toys", 29.41)]


def test_returns_count_units_once_unless_fanned_out(baskets):
    items, products, returns = baskets
    assert rows(kpi.returns_by(returns)) == [("Late", 2, D(20)), ("Size", 2, D(14))]
    rates = kpi.return_rate_by(items, products, returns)
    assert rows(rates, "category", "total_sold", "total_returns", "return_rate_pct", "total_refunds") == [
        ("Books", 5, 2, 40.0, D(20)), ("Toys", 4, 1, 25.0, D(7))]
    fanned = kpi.return_rate_by(items, products, returns, fanout=True)
    assert rows(fanned, "category", "total_sold", "total_returns") == [("Books", 7, 2), ("Toys", 4, 1)]
    assert rows(kpi.refund_share(rates), "category", "share_pct") == [("Books", 74.07), ("Toys", 25.93)]


def test_headline_and_cpa(spark, orders, marketing):
    got = one(kpi.headline(orders, marketing[0]))
    assert (got["total_revenue"], got["order_count"], got["total_spend"], got["blended_roas"]) == (D(375), 4, 142, 2.64)
    customers = spark.createDataFrame([("SMS",), ("SMS",), ("Organic",), (None,)], "acquisition_channel string")
    assert rows(kpi.cpa_by_channel(*marketing, customers)) == [("SMS", 130, 2, 65.0)]


def test_top_k_keeps_ties(spark):
    products = spark.createDataFrame([(f"P{i}", "c", f"B{i % 2}") for i in range(6)], "product_id string, category string, brand string")
    revenue = [50, 50, 40, 30, 30, 20]
    items = spark.createDataFrame([(f"P{i}", 1, r) for i, r in enumerate(revenue)], "product_id string, quantity int, v int")
    top = trends.top_k_per_group(items, products, k=3, revenue="v", carry=["brand"])
    assert rows(top, "product_id", "ranking") == [("P0", 1), ("P1", 1), ("P2", 2), ("P3", 3), ("P4", 3)]
    assert rows(trends.leader_ratio(top)) == [("c", 50, 1.0)]
    assert rows(trends.top_k_brand_concentration(top)) == [("c", 5, 2, 3, 60.0)]


def test_growth_uses_the_previous_month_present(orders):
    got = rows(trends.mom_growth(orders), "year", "month", "prev_month_revenue", "mom_growth_pct")
    assert got == [(2023, 1, None, None), (2023, 2, D(100), 100.0), (2023, 4, D(200), -75.0), (2024, 1, D(50), -50.0)]


def test_running_total_crosses_years_and_ends_at_the_sum(orders):
    monthly = trends.monthly_revenue(orders, ["sales_channel"])
    got = rows(trends.running_total(monthly, ["sales_channel"], ["year", "month"], "revenue"), "sales_channel", "year", "month", "running_total")
    assert got == [("In-Store", 2023, 4, D(50)), ("In-Store", 2024, 1, D(75)), ("Online", 2023, 1, D(100)), ("Online", 2023, 2, D(300))]


def test_funnel_stages_are_independent(spark):
    sessions = spark.createDataFrame([("D", "a"), ("D", "a"), ("D", "b"), ("M", "a"), ("M", "c"), ("T", None)], "device string, customer_id string")
    touches = spark.createDataFrame([("a",), ("a",), (None,)], "customer_id string")
    placed = spark.createDataFrame([("b",), ("c",), ("z",)], "customer_id string")
    assert rows(trends.funnel(sessions, touches, placed)) == [
        ("D", 2, 1, 1, 50.0), ("M", 2, 1, 1, 50.0), ("T", 0, 0, 0, None)]
    customers = spark.createDataFrame([("a",), ("b",)], "customer_id string")
    assert one(trends.coverage(customers, touches)) == {
        "n_customers": 2, "n_untouched": 1, "n_touches": 3, "touches_per_customer": 1.5}


def test_repeat_gap_truncates_and_skips_single_orders(orders):
    got = one(trends.repeat_gap(orders))
    # a: 31 Jan, 1 Feb, 30 Apr; b: twice on one day
    assert (got["total_days"], got["n_gaps"], got["avg_repeat_purchase_gap_days"]) == (89, 3, 29)
    assert got["avg_gap_days"] == pytest.approx(89 / 3)


def test_winback_and_growth_ratio(spark, orders):
    got = trends.winback_flag(orders, as_of=date(2023, 5, 11))
    assert rows(got, "customer_id", "days_since_order", "needs_winback") == [("a", 11, False), ("b", 90, True), ("x", 89, False)]
    monthly = spark.createDataFrame([(2023, 1, 10), (2023, 2, 5), (2024, 1, 40)], "year int, month int, orders long")
    signups = spark.createDataFrame([(2023, 2, 30), (2022, 12, 20)], "year int, month int, customers long")
    assert one(trends.growth_ratio(monthly, signups)) == {"order_growth_ratio": 4.0, "customer_growth_ratio": 2.5}


def test_rfm_leaves_out_customers_with_only_cancelled_orders(orders):
    got = segments.rfm(orders)
    assert rows(got, "customer_id", "gap_in_recent_order", "number_of_orders", "total_value") == [
        ("a", 250, 2, D(150)), ("b", 329, 1, D(200))]
    assert rows(got, "customer_id", "r_score", "f_score", "m_score", "rfm_total", "customer_segment") == [
        ("a", 2, 2, 1, 5, "Lost"), ("b", 1, 1, 2, 4, "Lost")]
    cover = one(segments.rfm_coverage(got, orders))
    assert cover == {"n_segmented": 2, "n_eligible": 2, "n_only_excluded": 1, "complete": True}


def test_rfm_segments_follow_the_total(spark):
    frame = spark.range(60).select(
        F.col("id").cast("string").alias("customer_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("order_date"),
        F.lit("Completed").alias("order_status"), (F.col("id") * 10).cast("decimal(8,2)").alias("net_amount"),
    )
    got = segments.rfm(frame)
    label = F.when(F.col("rfm_total") >= 12, "Champions").when(F.col("rfm_total") >= 9, "Loyal Customers").when(F.col("rfm_total") >= 6, "At Risk").otherwise("Lost")
    assert got.where(label != F.col("customer_segment")).count() == 0
    best = got.orderBy(F.desc("total_value")).first()
    assert (best["r_score"], best["m_score"]) == (5, 5)
    assert sum(r["n_customers"] for r in segments.segment_summary(got).collect()) == 60


def test_channel_diversity_counts_non_buyers_as_zero(spark, orders):
    touches = spark.createDataFrame([("a", "SMS"), ("a", "SMS"), ("a", "Email"), ("x", "SMS"), ("b", "SMS"), ("n", None)], "customer_id string, channel string")
    got = segments.channel_diversity_value(touches, orders)
    assert rows(got, "channel_count", "total_customers", "customers_who_ordered", "conversion_rate_pct", "avg_customer_value") == [
        (0, 1, 0, 0.0, 0.0), (1, 2, 1, 50.0, 100.0), (2, 1, 1, 100.0, 150.0)]


def test_cohorts_wait_until_the_whole_cohort_is_old_enough(spark):
    customers = spark.createDataFrame(
        [("a", date(2024, 1, 31)), ("b", date(2024, 1, 1)), ("c", date(2024, 3, 1)), ("d", date(2024, 4, 1)), ("e", None)],
        "customer_id string, signup_date date",
    )
    orders = spark.createDataFrame(
        [("a", date(2024, 2, 1)), ("a", date(2024, 2, 20)), ("b", date(2024, 3, 31)), ("c", date(2024, 3, 2)), ("e", date(2024, 3, 2)), (None, date(2024, 3, 2))],
        "customer_id string, order_date date",
    )
    got = cohorts.cohort_retention(customers, orders, date(2024, 3, 31))
    assert rows(got) == [(2024, 1, 2, 50.0, 50.0, None), (2024, 3, 1, None, None, None)]
    idx = cubes.cube_cohort(got)
    assert rows(idx) == [(0, 2, 50.0, 50.0, None), (2, 1, None, None, None)]


def test_label_match_same_day_counts_and_unlabelled_drop_out(spark):
    customers = spark.createDataFrame(
        [("a", "SMS", date(2024, 1, 5)), ("b", "SMS", date(2024, 1, 5)), ("c", "Email", date(2024, 1, 5)), ("d", "Organic", date(2024, 1, 5)), ("e", None, date(2024, 1, 5)), ("f", "SMS", None)],
        "customer_id string, acquisition_channel string, acquisition_date date",
    )
    touches = spark.createDataFrame(
        [("a", "SMS", datetime(2024, 1, 5, 23, 0)), ("b", "SMS", datetime(2024, 1, 6, 0, 0)), ("c", "SMS", datetime(2024, 1, 1)), ("f", "SMS", datetime(2024, 1, 1))],
        "customer_id string, channel string, timestamp timestamp_ntz",
    )
    assert rows(cohorts.label_match(customers, touches)) == [(0, 3, 75.0), (1, 1, 25.0)]
    assert rows(cohorts.label_match(customers, touches, bound=None)) == [(0, 1, 25.0), (1, 3, 75.0)]


@pytest.fixture(scope="module")
def journeys(spark):
    rng = random.Random(11)
    touches = spark.createDataFrame(
        [(f"T{i}", f"c{rng.randrange(20)}", datetime(2023, rng.randrange(1, 13), rng.randrange(1, 28), rng.randrange(24)), rng.choice(["SMS", "Email", "Display"]), rng.choice(["click", "impression"])) for i in range(150)],
        "touchpoint_id string, customer_id string, timestamp timestamp_ntz, channel string, interaction_type string",
    )
    placed = spark.createDataFrame(
        [(f"O{i}", f"c{rng.randrange(22)}", date(2023 + rng.randrange(2), rng.randrange(1, 13), rng.randrange(1, 28)), rng.choice(["Online", "In-Store"]), rng.choice(["Completed", "Cancelled"]), D(rng.randrange(1, 90000) / 100)) for i in range(120)],
        ORDER,
    )
    return placed, touches


def test_attributed_and_unattributed_add_up(journeys, marketing):
    placed, touches = journeys
    days = attribution.touch_days(placed, touches)
    rest = one(attribution.unattributed(days))
    per_model = {r["model"]: r["s"] for r in attribution.attributed_revenue(days).groupBy("model").agg(F.sum("attributed_revenue").alias("s")).collect()}
    for model in ("first", "last"):
        assert per_model[model] + rest["unattributed_revenue"] == rest["total_revenue"]
    assert rest["total_revenue"] == recognized(placed).agg(F.sum("net_amount")).first()[0]
    cube = cubes.cube_attribution(days)
    assert cube.agg(F.sum("revenue_cr")).first()[0] > 0
    # SMS and Email have spend; Display was credited but has none, so it is absent.
    for model in ("first", "last"):
        assert {r[0] for r in attribution.roas(placed, touches, *marketing, model).collect()} == {"SMS", "Email"}
    with pytest.raises(ValueError):
        attribution.roas(placed, touches, *marketing, "middle")


def test_touch_filter_changes_what_counts(journeys):
    placed, touches = journeys
    clicks = attribution.attribute(placed, touches, touch_filter=F.col("interaction_type") == "click")
    direct = attribution.attribute(placed, touches.where("interaction_type = 'click'"))
    assert rows(clicks) == rows(direct)
    assert clicks.count() == 120


def test_cubes_add_up(orders, marketing, baskets):
    items, products, returns = baskets
    slices = {(r["year_slice"], r["channel_slice"]): r.asDict() for r in cubes.cube_slices(orders, marketing[0]).collect()}
    assert slices[("All", "All")]["order_count"] == 4 and slices[("All", "All")]["total_spend"] == 142
    assert slices[("2023", "All")]["order_count"] == slices[("2023", "Online")]["order_count"] + slices[("2023", "In-Store")]["order_count"]
    assert slices[("2023", "Online")]["total_spend"] == slices[("2023", "All")]["total_spend"] == 82
    assert slices[("2023", "Online")]["blended_roas"] is None
    assert slices[("2024", "All")]["blended_roas"] == round(25 / 60, 2)
    cat = {(r["year"], r["sales_channel"], r["category"]): r.asDict() for r in cubes.cube_category(items, orders, products, returns).collect()}
    online = cat[(2023, "Online", "Books")]
    assert online["units"] == 4 and online["returns"] == 2  # O2 is cancelled
    assert cat[(2023, "In-Store", "Toys")]["returns"] == 1
    assert set(rows(cubes.cube_monthly(orders), "month_idx", "sales_channel", "orders")) == {
        (0, "Online", 1), (1, "Online", 1), (3, "In-Store", 1), (12, "In-Store", 1)}
    assert rows(cubes.cube_spend(*marketing), "year", "channel", "impressions", "clicks") == [
        (2023, "Email", 0, 0), (2023, "SMS", 1000, 30), (2024, "SMS", 1000, 10)]


def test_a_channel_called_all_stays_apart(orders, marketing):
    named = orders.withColumn("sales_channel", F.when(F.col("sales_channel") == "Online", "All").otherwise(F.col("sales_channel")))
    plain = {(r["slice_id"], r["year_slice"], r["channel_slice"]): r[3:] for r in rows_of(cubes.cube_slices(orders, marketing[0]))}
    other = {(r["slice_id"], r["year_slice"], r["channel_slice"]): r[3:] for r in rows_of(cubes.cube_slices(named, marketing[0]))}
    assert other == {(i, y, "All" if c == "Online" else c): v for (i, y, c), v in plain.items()}
    assert (0, "2023", "All") in other and (1, "2023", "All") in other and (3, "All", "All") in other


def rows_of(df):
    return df.select("slice_id", "year_slice", "channel_slice", "order_count", "total_revenue", "total_spend", "blended_roas").collect()


def test_lowest_and_highest(spark):
    t = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("d", 1.0)], "k string, m double")
    assert [r[0] for r in cubes.lowest(t, "m", 2, "k").collect()] == ["b", "d"]
    assert [r[0] for r in cubes.highest(t, "m", 1, "k").collect()] == ["a"]


def test_cube_and_rate_agree_on_returns_without_a_line(orders, baskets):
    """A return of a product that its order does not hold counts in neither."""
    items, products, returns = baskets
    stray = returns.sparkSession.createDataFrame([("R5", "O1", "P3", date(2023, 2, 2), "Late", D(1))] * 2, returns.schema)
    cube = cubes.cube_category(items, orders, products, returns.unionAll(stray))
    counted = {r["category"]: r["n"] for r in cube.groupBy("category").agg(F.sum("returns").alias("n")).collect()}
    rates = kpi.return_rate_by(items, products, returns.unionAll(stray)).collect()
    assert counted == {r["category"]: r["total_returns"] for r in rates} == {"Books": 2, "Toys": 1}
