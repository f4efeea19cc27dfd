"""One-pass relations and reports, ordered files, row-level running totals and ranks."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.analysis import ORDER_BY
from shoplens.catalog import ORACLES, QUERIES
from shoplens.operators import kpi, quality, trends
from shoplens.plans import in_order, sort_columns, with_position
from shoplens.sources.files import write_extract

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    r = random.Random(4)
    items = [(r.choice([1, 2, 3, None, 99]), r.choice(["a", "b", None, "zz"]), r.choice(["x", "y"])) for _ in range(300)]
    return {
        "item": spark.createDataFrame(items, "o int, p string, kind string"),
        "ord": spark.createDataFrame([(1, 7), (2, None), (3, 8), (None, 7)], "o bigint, c int"),
        "prod": spark.createDataFrame([("a",), ("b",), (None,)], "p string"),
        "cust": spark.createDataFrame([(7,)], "c int"),
        "pair": spark.createDataFrame([(1, "a"), (11, "a"), (1, "1a"), (1, None)], "o int, p string"),
        "none": spark.createDataFrame([], "o int, p string"),
    }


R = quality.Relation
RELATIONS = [
    R("item->ord", "item", ["o"], "ord", ["o"]),
    R("x item->ord", "item", ["o"], "ord", ["o"], "kind = 'x'"),
    R("item->y item", "item", ["o"], "item", ["o"], None, "kind = 'y'"),
    R("ord->cust", "ord", ["c"], "cust", ["c"]),
    R("ord->none", "ord", ["o"], "none", ["o"]),
    R("none->ord", "none", ["o"], "ord", ["o"]),
]


def separate(t, relations):
    out = {}
    for r in relations:
        child = t[r.child].where(r.where) if r.where else t[r.child]
        parent = t[r.parent].where(r.parent_where) if r.parent_where else t[r.parent]
        out |= {r.name: tuple(quality.orphans(child, parent, r.keys, r.parent_keys).first())[1:]}
    return out


@pytest.mark.parametrize("more", [[], [R("item->prod", "item", ["p"], "prod", ["p"]), R("pair->item", "pair", ["o", "p"], "item", ["o", "p"])]])
def test_orphan_report_equals_separate_checks(spark, more):
    t = tables(spark)
    relations = [*RELATIONS, *more]
    got = {r["relation"]: tuple(r)[1:] for r in quality.orphan_report(t, relations).collect()}
    assert list(got) == [r.name for r in relations]
    assert got == separate(t, relations)


def test_orphans_and_report_read_each_table_once(spark):
    text = plan(QUERIES["orphans"](spark, SF_DIR))
    for t in ("customer", "part", "orders", "lineitem", "events"):
        assert text.count(f"{t}.parquet") == 1, t
    text = plan(QUERIES["quality_report"](spark, SF_DIR))
    for t, views in {"customer": 1, "part": 1, "orders": 1, "lineitem": 2, "events": 2}.items():  # returns and lines, spend and touches
        assert text.count(f"{t}.parquet") == views, t


def test_relation_checks_equal_row_level_checks(spark):
    r = random.Random(8)
    child = spark.createDataFrame(
        [(i, r.choice([1, 2, 3, 4, None]), r.choice([None, *[f"2024-01-{d:02d} {h}" for d in (1, 2, 3, 9) for h in ("00:00:00", "10:00:00")]])) for i in range(400)],
        "id int, k int, at string",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    parent = spark.createDataFrame([(1, "2024-01-02", "2024-01-03"), (2, None, "2024-01-02"), (3, "2024-01-04", "2024-01-03"), (9, None, None)], "k int, s string, e string")
    parent = parent.withColumns({c: F.col(c).cast("date") for c in "se"})
    got = quality.relation_checks(
        parent, "parent", child, "child", "k", {"ends_first": F.col("e") < F.col("s"), "open": F.col("s").isNull()}, {"odd": F.col("id") % 2 == 1}, "orphan", ("outside", "at", "s", "e")
    )
    found = {x["check_name"]: (x["table_name"], x["n_checked"], x["n_failed"]) for x in got.collect()}
    outside = quality.outside_parent_window(child, parent, "k", "at", "s", "e").count()
    lost = child.join(parent, "k", "left_anti").where("k is not null").count()
    assert found == {"ends_first": ("parent", 4, 1), "open": ("parent", 4, 2), "odd": ("child", 400, 200), "orphan": ("child", 400, lost), "outside": ("child", 400, outside)}
    assert outside > 20 and lost > 20
    empty = quality.relation_checks(parent.limit(0), "p", child.limit(0), "c", "k", {"x": F.col("s").isNull()}, orphan="o").collect()
    assert [(x["n_checked"], x["n_failed"]) for x in empty] == [(0, 0), (0, 0)]


def test_table_checks_count_rows_without_a_match(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (None, 5)], "k int, v int")
    lookup = spark.createDataFrame([(1, 4), (2, 6)], "k int, w int")
    rows = quality.table_checks(df, "t", {"above": F.col("v") > F.col("w"), "five": F.col("v") == 5}, [(lookup, ["k"])]).collect()
    assert [tuple(x) for x in rows] == [("above", "t", 4, 1), ("five", "t", 4, 4)]


@pytest.mark.parametrize("result,keys", [("attribute", ["-net_amount", "order_id"]), ("budget_variance", ORDER_BY["budget_variance"]), ("mom_growth", ["year", "month"])])
def test_written_files_follow_the_order(spark, tmp_path, result, keys):
    """Rows of the part files, by name, are the SQL's rows in its order."""
    import oracle

    frame = QUERIES[result](spark, SF_DIR)
    write_extract({"out": frame}, str(tmp_path), order={"out": keys})
    rows = [r for f in sorted((tmp_path / "out").glob("part-*.parquet")) for r in pq.read_table(f).to_pylist()]
    by = ", ".join(f"{k.lstrip('-')} {'DESC NULLS LAST' if k[0] == '-' else 'NULLS FIRST'}" for k in keys)
    res = oracle.connect(SF_DIR).execute(f"SELECT * FROM ({ORACLES[result]}) ORDER BY {by}")
    names = [d[0] for d in res.description]
    names_in = [k.lstrip("-") for k in keys]
    want = [dict(zip(names, r)) for r in res.fetchall()]
    assert [[r[k] for k in names_in] for r in rows] == [[r[k] for k in names_in] for r in want]
    assert len(rows) == frame.count() > 1


def test_order_is_ranged_not_gathered(spark):
    df = spark.range(100_000).selectExpr("id * 7919 % 1000 k", "id")
    out = in_order(df, ["-k", "id"])
    assert "rangepartitioning" in plan(out) and "SinglePartition" not in plan(out)
    where = [tuple(x) for x in out.select("k", "id").collect()]
    assert where == sorted(where, key=lambda x: (-x[0], x[1]))
    nulls = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [x[0] for x in nulls.orderBy(*sort_columns(["v"])).collect()] == [None, 1, 2]
    assert [x[0] for x in nulls.orderBy(*sort_columns(["-v"])).collect()] == [2, 1, None]
    placed = {x["id"]: x["position"] for x in with_position(df, ["-k", "id"]).collect()}
    assert [placed[i] for _, i in where] == list(range(1, 100_001))


def test_running_total_of_one_channel(spark):
    df = spark.range(50_000).selectExpr("'only' channel", "id * 7919 % 50021 day", "cast(id % 1000 as decimal(12,2)) v")
    upto = Window.partitionBy("channel").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    got, want = trends.running_total_rows(df, ["channel"], ["day"], "v", "t"), df.withColumn("t", F.sum("v").over(upto))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_wide_rank_equals_rank(spark):
    items = spark.range(5_000).selectExpr("id % 700 product_id", "cast(id % 5 as int) quantity", "1.5 unit_price", "0.5 discount_amount")
    products = spark.range(700).selectExpr("id product_id", "'c' category")
    plain, wide = (kpi.units_and_asp(items, products, "product_id", wide=w) for w in (False, True))
    assert plain.exceptAll(wide).isEmpty() and wide.exceptAll(plain).isEmpty()
