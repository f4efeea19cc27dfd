from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shoplens.operators import quality


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0].asDict()


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_profile_with_and_without_dates(spark):
    t = spark.createDataFrame(
        [("a", date(2024, 1, 1), datetime(2024, 3, 1, 23, 0)), ("b", date(2023, 5, 5), None)],
        "id string, d date, ts timestamp_ntz",
    )
    assert rows(quality.profile_all({"t": (t, ["d", "ts"]), "u": (t, [])})) == rows(
        spark.createDataFrame(
            [
                ("t", 2, "d", date(2023, 5, 5), date(2024, 1, 1)),
                ("t", 2, "ts", date(2024, 3, 1), date(2024, 3, 1)),
                ("u", 2, None, None, None),
            ],
            "a string, b int, c string, d date, e date",
        )
    )


def test_touch_during_last_day_is_outside(spark):
    camps = spark.createDataFrame([("C", date(2024, 1, 5), date(2024, 1, 10))], "c string, s date, e date")
    touches = spark.createDataFrame(
        [
            (1, "C", datetime(2024, 1, 4, 23, 59)),
            (2, "C", datetime(2024, 1, 5, 0, 0)),
            (3, "C", datetime(2024, 1, 10, 0, 0)),
            (4, "C", datetime(2024, 1, 10, 0, 1)),
            (5, "missing", datetime(2020, 1, 1)),
            (6, None, datetime(2020, 1, 1)),
        ],
        "id int, c string, ts timestamp_ntz",
    )
    out = quality.outside_parent_window(touches, camps, "c", "ts", "s", "e")
    assert rows(out, "id") == [(1,), (4,)]


def test_before_date_counts_and_flags(spark):
    t = spark.createDataFrame([(date(2022, 12, 29),), (date(2023, 1, 1),), (None,)], "d date")
    assert one(quality.before_date(t, "d", date(2023, 1, 1))) == {"n_rows": 3, "n_before": 1, "before_pct": 33.33}
    assert rows(quality.flag_before(t, "d", date(2023, 1, 1)), "before_cutoff") == [(False,), (False,), (True,)]


def test_orphans_separate_null_keys_and_ignore_parent_duplicates(spark):
    child = spark.createDataFrame([("a", 1), ("a", 1), ("x", 1), (None, 1), ("a", None)], "k string, l int")
    parent = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "k string, l int")
    assert one(quality.orphans(child, parent, ["k"], name="r")) == {
        "relation": "r", "n_rows": 5, "n_null_key": 1, "n_orphan": 1}
    assert one(quality.orphans(child, parent, ["k", "l"]))["n_null_key"] == 2
    assert one(quality.orphans(child.limit(0), parent, ["k"]))["n_rows"] == 0


def test_duplicate_keys(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "k int, l string")
    assert rows(quality.duplicate_keys(t, ["k", "l"])) == [(1, "a", 2)]


def test_nulls(spark):
    t = spark.createDataFrame(
        [("Online", None), ("Online", None), ("In-Store", "S1"), ("In-Store", None), (None, "S2")],
        "sales_channel string, store_id string",
    )
    assert rows(quality.null_sweep(t)) == [("sales_channel", 5, 1), ("store_id", 5, 3)]
    assert rows(quality.null_by(t, "sales_channel", "store_id")) == [
        ("In-Store", 2, 1, 1), ("Online", 2, 0, 2), (None, 1, 1, 0)]
    verdict = one(quality.null_rule_holds(t, "store_id", F.col("sales_channel") == "Online"))
    assert (verdict["n_failed"], verdict["holds"]) == (1, False)
    fixed = t.where("NOT (sales_channel <=> 'In-Store' AND store_id IS NULL)")
    assert one(quality.null_rule_holds(fixed, "store_id", F.col("sales_channel") == "Online"))["holds"] is True


def test_padding_and_near_duplicates(spark):
    t = spark.createDataFrame([("Email",), (" Email",), ("email ",), ("SMS",), ("SMS",), (None,)], "channel string")
    assert rows(quality.whitespace_values(t, "channel")) == [(" Email", 1), ("email ", 1)]
    assert rows(quality.near_duplicate_values(t, "channel")) == [("email", 3, " Email", "email ", 3)]


def test_violations_report_each_broken_rule(spark):
    t = spark.createDataFrame([(1, 5, 3, 10), (2, 9, 3, -1), (3, 1, 3, 0), (4, None, 3, 1)], "id int, clicks int, impressions int, spend int")
    rules = {"ctr": F.col("clicks") > F.col("impressions"), "neg": F.col("spend") < 0}
    assert rows(quality.violations(t, rules), "id", "rule") == [(1, "ctr"), (2, "ctr"), (2, "neg")]
    assert rows(quality.violation_counts(t, rules, "s")) == [("ctr", "s", 4, 2), ("neg", "s", 4, 1)]


def test_order_before_signup(spark):
    orders = spark.createDataFrame([("O1", "c", date(2024, 1, 1)), ("O2", "c", date(2024, 1, 2)), ("O3", None, date(2020, 1, 1))], "o string, c string, d date")
    cust = spark.createDataFrame([("c", date(2024, 1, 2))], "c string, signup date")
    assert rows(quality.before_parent(orders, cust, "c", "d", "signup"), "o", "signup") == [("O1", date(2024, 1, 2))]


@pytest.fixture
def line_tables(spark):
    items = spark.createDataFrame(
        [("O1", "P1", 2, 100, 50), ("O1", "P2", 1, 10, 0)],
        "order_id string, product_id string, quantity int, unit_price int, discount_amount int",
    )
    returns = spark.createDataFrame(
        [("R1", "O1", "P1", 200), ("R2", "O1", "P1", 150), ("R3", "O1", "P2", 10), ("R4", "O9", "P2", 999)],
        "return_id string, order_id string, product_id string, refund_amount int",
    )
    return items, returns


def test_refund_checks_use_the_whole_key(spark, line_tables):
    items, returns = line_tables
    got = quality.refund_exceeds_line(returns, items)
    assert rows(got, "return_id", "item_line_value") == [("R1", 150)]
    orders = spark.createDataFrame([("O1", 160)], "order_id string, net_amount int")
    assert rows(quality.refund_exceeds_order(returns, orders), "return_id") == [("R1",)]


def test_reconcile_ignores_nulls(spark):
    t = spark.createDataFrame(
        [(1, "10.00", "1.00", "2.00", "11.00"), (2, "10.00", "1.00", "2.00", "11.01"), (3, None, "1.00", "2.00", "5.00")],
        "id int, g string, d string, s string, n string",
    ).select("id", *[F.col(c).cast("decimal(8,2)") for c in "gdsn"])
    got = one(quality.reconcile(t, F.col("g") - F.col("d") + F.col("s"), "n"))
    assert got == {"n_rows": 3, "n_mismatched": 1, "mismatched_pct": 33.33}


def test_censored_tail(spark):
    orders = spark.createDataFrame([(d, date(2024, 12, d)) for d in (5, 10, 11, 30)], "id int, order_date date")
    returns = spark.createDataFrame([(date(2025, 1, 19),)], "return_date date")
    flagged = quality.censored_tail(orders, returns).where("return_window_open")
    assert rows(flagged, "id") == [(11,), (30,)]
    assert rows(quality.censored_tail(orders, days=1).where("return_window_open"), "id") == [(30,)]
    with pytest.raises(ValueError):
        quality.censored_tail(orders)


def test_report_verdicts(spark):
    t = spark.createDataFrame([(1,), (2,)], "x int")
    report = quality.quality_report([quality.violation_counts(t, {"bad": F.col("x") > 1, "ok": F.col("x") > 9}, "t")])
    assert rows(report, "check_name", "n_checked", "n_failed", "failed_pct", "verdict") == [
        ("bad", 2, 1, 50.0, "flag"), ("ok", 2, 0, 0.0, "pass")]
    assert report.where("n_failed > n_checked").count() == 0
