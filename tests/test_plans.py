"""Physical plans, skewed joins, distributed NTILE and the as-of lookup."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from shoplens.operators import attribution
from shoplens.plans import exact_ntile, lookup_join, touch_by_order_day

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scan_is_pruned_and_filter_pushed(spark):
    plan = plan_of(entry_point.queries()["revenue_by"](spark, SF_DIR))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))]" in plan


def test_rfm_never_gathers_customers(spark):
    """The rows come from the stored customers in a map-only plan; the one subquery is their last date."""
    plan = plan_of(entry_point.queries()["rfm"](spark, SF_DIR))
    main, *subqueries = plan.split("Subquery")
    assert not any(x in main for x in ("Exchange", "Window", "Join", "Sort"))
    assert "Window" not in "".join(subqueries) and "ntile" not in plan.lower()


# ------------------------------------------------------------------ lookup_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_is_split_by_adaptive_execution(spark, no_broadcast, how):
    rng = random.Random(3)
    keys = [7] * 40_000 + [None] * 200 + [rng.randrange(5000) for _ in range(80_000)]
    facts = spark.createDataFrame([(k, i, "x" * 20) for i, k in enumerate(keys)], "k int, id int, pad string").repartition(16)
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 4000)] + [(None, "none")], "k int, v string")
    settings = {"skewJoin.skewedPartitionThresholdInBytes": "64k", "advisoryPartitionSizeInBytes": "64k", "skewJoin.skewedPartitionFactor": "1.2"}
    before = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in settings}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        got = lookup_join(facts, lookup, ["k"], how).select("k", "id", "v")
        found = rows(got)
        assert "skew=true" in plan_of(got)
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
    want = [(k, i, f"v{k}" if k is not None and k < 4000 else None) for i, k in enumerate(keys)]
    assert found == sorted((w for w in want if how == "left" or w[2]), key=repr)


def test_small_lookup_is_broadcast(spark):
    facts = spark.range(100).withColumnRenamed("id", "k")
    lookup = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert "BroadcastHashJoin" in plan_of(lookup_join(facts, lookup, ["k"]))


# ------------------------------------------------------------------ exact_ntile


def check_ntile(spark, pairs, buckets, **options):
    df = spark.createDataFrame(pairs, "id string, v bigint")
    slot = F.substring(F.md5("id"), 1, 4)
    want = df.select("id", F.ntile(buckets).over(Window.orderBy(F.col("v").asc_nulls_first(), slot, "id")).alias("b"))
    got = exact_ntile(df, "id", {"b": F.col("v")}, buckets, **options).select("id", "b")
    assert rows(got) == rows(want)


@pytest.mark.parametrize(
    "values",
    [
        [1] * 700,
        [random.Random(1).randrange(10**9) for _ in range(900)],
        [1] * 300 + [random.Random(2).randrange(-500, 500) for _ in range(600)],
        [int(random.Random(5).paretovariate(0.4) * 100) % 10**15 for _ in range(500)] + [None] * 40,
        list(range(13)),
    ],
    ids=["all-tied", "spread", "hot-value-and-negatives", "heavy-tail-and-nulls", "thirteen"],
)
@pytest.mark.parametrize("buckets", [5, 3])
def test_ntile_equals_builtin(spark, values, buckets):
    pairs = [(f"CUS{i:05d}", v) for i, v in enumerate(values)]
    check_ntile(spark, pairs, buckets)
    check_ntile(spark, pairs, buckets, accuracy=20, bins=7)  # narrow brackets and wide bins


def test_ntile_fewer_rows_than_buckets_and_empty(spark):
    check_ntile(spark, [("a", 3), ("b", 1), ("c", 2)], 5)
    check_ntile(spark, [("a", 3)], 5)
    empty = spark.createDataFrame([], "id string, v bigint")
    assert exact_ntile(empty, "id", {"b": F.col("v")}, 5).count() == 0


def test_ntile_buckets_differ_by_at_most_one(spark):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 3).alias("v"))
    sizes = [r["count"] for r in exact_ntile(df, "id", {"b": F.col("v")}, 5).groupBy("b").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1


# ------------------------------------------------------------------------ as-of

TOUCH = "touchpoint_id string, customer_id string, timestamp timestamp_ntz, channel string, interaction_type string"
ORDER = "order_id string, customer_id string, order_date date, order_status string, net_amount decimal(8,2)"


def brute_force(orders, touches):
    out = {}
    for oid, cust, day, _, _ in orders:
        earlier = [
            t for t in touches
            if cust is not None and day is not None and t[1] == cust and t[2] is not None
            and t[2] < datetime(day.year, day.month, day.day)
        ]
        earlier.sort(key=lambda t: (t[2], t[0]))
        out[oid] = (earlier[0][3], earlier[-1][3]) if earlier else (None, None)
    return out


def random_case(seed, n_orders, n_touches):
    rng = random.Random(seed)
    start = date(2024, 1, 1)

    def who():  # one customer owns a third of all rows
        return rng.choice(["hot", None] + [f"c{i}" for i in range(12)]) if rng.random() > 1 / 3 else "hot"

    touches = []
    for i in range(n_touches):
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(40), hours=rng.choice([0, 0, 5, 23]), minutes=rng.choice([0, 59]))
        touches.append((f"T{i:04d}", who(), None if rng.random() < 0.02 else at,
                        None if rng.random() < 0.05 else f"ch{rng.randrange(5)}", rng.choice(["click", "impression"])))
    orders = [
        (f"O{i:04d}", who(), None if rng.random() < 0.02 else start + timedelta(days=rng.randrange(40)),
         rng.choice(["Completed", "Cancelled"]), None)
        for i in range(n_orders)
    ]
    return orders, touches


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_attribution_equals_brute_force(spark, seed, threshold):
    orders, touches = random_case(seed, 200, 300)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = attribution.attribute(spark.createDataFrame(orders, ORDER), spark.createDataFrame(touches, TOUCH)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(orders)
    assert {r["order_id"]: (r["first_touch_channel"], r["last_touch_channel"]) for r in got} == brute_force(orders, touches)


def test_attribution_day_boundaries(spark):
    touches = [
        ("T1", "a", datetime(2024, 1, 9, 23, 59), "evening", "click"),
        ("T2", "a", datetime(2024, 1, 10, 0, 0), "midnight", "click"),
        ("T3", "a", datetime(2024, 1, 10, 9, 0), "morning", "click"),
        ("T5", "tie", datetime(2024, 1, 1, 8, 0), "high id", "click"),
        ("T4", "tie", datetime(2024, 1, 1, 8, 0), "low id", "click"),
    ]
    orders = [
        ("O1", "a", date(2024, 1, 9), "Completed", None),
        ("O2", "a", date(2024, 1, 10), "Completed", None),
        ("O3", "a", date(2024, 1, 11), "Completed", None),
        ("O4", "tie", date(2024, 1, 2), "Completed", None),
    ]
    got = attribution.attribute(spark.createDataFrame(orders, ORDER), spark.createDataFrame(touches, TOUCH))
    assert {r[0]: (r["first_touch_channel"], r["last_touch_channel"]) for r in got.collect()} == {
        "O1": (None, None),
        "O2": ("evening", "evening"),
        "O3": ("evening", "morning"),
        "O4": ("low id", "high id"),
    }


def test_window_input_is_bounded_by_days(spark):
    """A customer with thousands of touches reaches the ordered window as one row per day."""
    touches = spark.range(5000).select(
        F.col("id").cast("string").alias("touchpoint_id"),
        F.lit("hot").alias("customer_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz").alias("timestamp"),
        F.lit("ch").alias("channel"),
    )
    orders = spark.createDataFrame([("O1", "hot", date(2024, 1, 4), "Completed", None)] * 50, ORDER)
    days = touch_by_order_day(orders, touches)
    assert days.collect()[0]["n_orders"] == 50
    plan = plan_of(days)
    assert plan.index("Window") < plan.index("Aggregate")  # the aggregate feeds the window
