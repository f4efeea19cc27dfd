"""Published aggregates as inputs: the derived figures must equal the published ones."""

import pytest
from pyspark.sql import functions as F

from shoplens.operators import attribution, cubes, kpi, trends

# Yearly channel spend (crore), impressions and clicks.
SPEND = [
    (2023, "Paid Search", 0.394918, 8862250, 277854),
    (2023, "Social Media", 0.189835, 4610554, 124247),
    (2023, "Affiliate", 0.416015, 8244650, 304527),
    (2023, "Display", 0.60075, 16861173, 518436),
    (2023, "SMS", 0.704661, 17651589, 418340),
    (2023, "Email", 0.269103, 6806418, 232216),
    (2023, "Influencer", 0.092346, 3592610, 106980),
    (2024, "Paid Search", 0.041117, 1039696, 26170),
    (2024, "Social Media", 0.095739, 3172745, 102404),
    (2024, "Affiliate", 0.124629, 3307033, 90953),
    (2024, "Display", 0.593776, 12490613, 420534),
    (2024, "SMS", 0.26907, 7761800, 192478),
    (2024, "Email", 0.413508, 10653463, 360987),
    (2024, "Influencer", 0.230774, 5913112, 216545),
]
# Revenue (crore) credited per channel over both years, first and last touch.
CREDIT = [
    ("Paid Search", 72.181672, 11.848673),
    ("Social Media", 44.251075, 30.641178),
    ("Affiliate", 48.435775, 13.867210),
    ("Display", 55.889440, 39.877956),
    ("SMS", 17.282861, 57.824148),
    ("Email", 9.610573, 68.488421),
    ("Influencer", 0.302083, 25.405897),
]
# Channel -> CTR %, CPC, first-touch ROAS and rank, last-touch ROAS and rank.
CHANNELS = {
    "Paid Search": (3.07, 14.34, 165.54, 1, 27.17, 6),
    "Social Media": (2.91, 12.60, 154.95, 2, 107.30, 1),
    "Affiliate": (3.42, 13.67, 89.59, 3, 25.65, 7),
    "Display": (3.20, 12.72, 46.79, 4, 33.38, 5),
    "SMS": (2.40, 15.94, 17.75, 5, 59.38, 4),
    "Email": (3.40, 11.51, 14.08, 6, 100.33, 2),
    "Influencer": (3.40, 9.99, 0.93, 7, 78.63, 3),
}
# Category revenue and cost (crore), all years and sales channels.
CATEGORIES = [
    ("Electronics", 186.030195, 125.546753),
    ("Sports", 22.862401, 14.430541),
]
# Orders and revenue (crore) of the first and the last four months, both sales channels.
MONTHS = [
    (0, "Online", 54, 0.117178), (0, "In-Store", 27, 0.051539),
    (20, "Online", 5166, 12.724901), (20, "In-Store", 2462, 6.296603),
    (21, "Online", 6460, 16.858359), (21, "In-Store", 3042, 7.995299),
    (22, "Online", 7595, 19.689384), (22, "In-Store", 3678, 9.505265),
    (23, "Online", 11183, 28.140169), (23, "In-Store", 5162, 13.375649),
]


@pytest.fixture(scope="module")
def spend(spark):
    return spark.createDataFrame(SPEND, "year int, channel string, spend_cr double, impressions long, clicks long")


@pytest.fixture(scope="module")
def credit(spark):
    rows = [(0, m, c, v) for c, first, last in CREDIT for m, v in (("first", first), ("last", last))]
    return spark.createDataFrame(rows, "year int, model string, channel string, revenue_cr double")


def test_ctr_cpc_and_roas(spend, credit):
    got = {r["channel"]: r for r in cubes.channel_metrics(spend, credit).collect()}
    for channel, (ctr, cpc, first, _, last, _) in CHANNELS.items():
        r = got[channel]
        assert (r["ctr_pct"], r["cpc"], r["roas_first"], r["roas_last"]) == (ctr, cpc, first, last)


def test_roas_covers_all_years_whatever_year_is_chosen(spend, credit):
    got = {r["channel"]: r for r in cubes.channel_metrics(spend, credit, year=2023).collect()}
    assert got["SMS"]["roas_last"] == 59.38 and got["SMS"]["cpc"] == round(0.704661e7 / 418340, 2)


def test_ranks_flip_between_models(spend, credit):
    totals = spend.groupBy("channel").agg(F.sum("spend_cr").alias("total_spend"))
    compared = attribution.model_comparison(credit.withColumnRenamed("revenue_cr", "attributed_revenue"), totals)
    got = {r["channel"]: r for r in compared.collect()}
    for channel, (_, _, first, rank_first, last, rank_last) in CHANNELS.items():
        r = got[channel]
        assert (r["roas_first"], r["rank_first"], r["roas_last"], r["rank_last"]) == (first, rank_first, last, rank_last)
    riser = cubes.highest(compared, "places_gained", 1, "channel").first()
    faller = cubes.lowest(compared, "places_gained", 1, "channel").first()
    assert (faller["channel"], faller["places_gained"]) == ("Paid Search", -5)
    assert (riser["places_gained"]) == 4
    stronger = {r["channel"]: r["stronger_model"] for r in attribution.spend_vs_roas(compared).collect()}
    assert stronger["Email"] == "last" and stronger["Affiliate"] == "first"


def test_unattributed_gap(credit):
    totals = {r[0]: r[1] for r in credit.groupBy("model").agg(F.sum("revenue_cr")).collect()}
    assert round(249.349066 - totals["first"], 2) == round(249.349066 - totals["last"], 2) == 1.40


def test_headline_roas(spark, spend):
    months = spark.createDataFrame([(0, "Online", 97647, 249.349)], "month_idx int, sales_channel string, orders long, revenue_cr double")
    got = cubes.headline_metrics(months, spend, 2023).first()
    assert (got["orders"], round(got["spend_cr"], 1), got["blended_roas"]) == (97647, 4.4, 56.2)
    assert cubes.headline_metrics(months, spend, 2023, sales_channel="Online").first()["blended_roas"] is None


def test_margins(spark):
    cube = spark.createDataFrame(
        [(2023, "Online", c, rev, cost, 1, 1) for c, rev, cost in CATEGORIES],
        "year int, sales_channel string, category string, revenue_cr double, cost_cr double, units long, returns long",
    )
    got = {r["category"]: r["margin_pct"] for r in cubes.category_metrics(cube).collect()}
    assert got == {"Electronics": 32.51, "Sports": 36.88}
    assert cubes.category_metrics(cube, year=2024).count() == 0


def test_revenue_share(spark):
    rest = spark.createDataFrame([("Electronics", 186.030195), ("others", 249.285 - 186.030195)], "category string, revenue double")
    got = {r[0]: r["share_pct"] for r in kpi.share_of_total(rest, "category", "revenue").collect()}
    assert got["Electronics"] == 74.63


def test_growth_of_the_last_quarter(spark):
    months = spark.createDataFrame(MONTHS, "month_idx int, sales_channel string, orders long, revenue_cr double")
    got = [round(r["mom_growth_pct"], 1) for r in cubes.monthly_growth(months).orderBy("year", "month").collect()[2:]]
    assert got == [30.7, 17.5, 42.2]
    monthly = months.groupBy((F.col("month_idx") + 1).alias("month"), F.lit(0).alias("year")).agg(F.sum("orders").alias("orders"))
    signups = spark.createDataFrame([(0, 1, 1197), (0, 24, 30000 - 1197)], "year int, month int, customers long")
    got = trends.growth_ratio(monthly, signups).first()
    assert (round(got[0], 1), round(got[1], 2)) == (201.8, 25.06)
