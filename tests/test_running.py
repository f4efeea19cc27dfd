"""Running sums and ranks against plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.plans import running_rank, running_sum


def rows(spark, n=30_000):
    """One group with most of the rows, NULL groups, repeated order values, NULL measures, identical rows."""
    i = F.col("id")
    group = F.when(i % 10 > 1, "hot").when(i % 20 > 0, F.concat(F.lit("g"), i % 7))
    one = spark.range(n).select(group.alias("g"), (i * 7919 % 1009).alias("o"), F.when(i % 11 > 0, i % 100 - 30).alias("m"), "id")
    return one.unionAll(one.where("id % 1000 = 3"))


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_running_sum_equals_window(spark):
    df = rows(spark)
    upto = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(running_sum(df, ["g"], ["o", "id"], "m", "s"), df.withColumn("s", F.sum("m").over(upto)))
    earlier = Window.orderBy(F.desc("o"), "id").rowsBetween(Window.unboundedPreceding, -1)
    same(running_sum(df, [], [F.desc("o"), "id"], "m", "s", before=True), df.withColumn("s", F.sum("m").over(earlier)))


def test_running_sum_of_nothing(spark):
    assert running_sum(rows(spark).where("id < 0"), ["g"], ["o"], "m", "s").isEmpty()


def test_running_sum_replaces_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "o int, s int")
    assert sorted(map(tuple, running_sum(df, [], ["o"], "s", "s").collect())) == [(1, 5), (2, 11)]


def test_a_large_group_is_spread(spark):
    """No range holds much of a group, and every window is over (group, range)."""
    out = running_sum(rows(spark, 400_000), ["g"], ["o", "id"], "m", "s")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_range" in w for w in windows)
    table = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    sizes = [r["count"] for r in table.groupBy("_range").count().collect()]
    assert max(sizes) < 0.4 * sum(sizes)


def test_rank_equals_window(spark):
    df = rows(spark)
    for groups in ([], ["g"]):
        for descending in (True, False):
            order = (F.desc_nulls_last if descending else F.asc_nulls_last)("m")
            for dense, fn in ((False, F.rank), (True, F.dense_rank)):
                plain = df.withColumn("r", fn().over(Window.partitionBy(*groups).orderBy(order)))
                same(running_rank(df, "m", "r", groups, descending, dense), plain)
