"""Monthly sums: in place of facts, refreshed by month, shared by a whole run."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from shoplens.operators import cubes, kpi, state, trends
from shoplens.sources.testdata import EXCLUDED, Retail

SF_DIR = "/root/testdata/sf0.001"


def orders(spark, more=()):
    rows = [
        (1, "2024-01-05", "a", "F", "10.50"), (2, "2024-01-31", "a", "P", "3.00"), (3, "2024-02-01", "b", "F", None), (4, "2024-02-29", "a", "F", "7.25"),
        (5, "2024-12-31", "b", "O", "1.00"), (6, "2025-01-01", "a", "F", "2.00"), (7, None, "a", "F", "5.00"), (8, "2024-02-10", None, "F", "4.00"), (9, "2024-02-11", "b", None, "4.00"), *more,
    ]
    df = spark.createDataFrame(rows, "order_id int, order_date string, sales_channel string, order_status string, net_amount string")
    return df.withColumns({"order_date": F.col("order_date").cast("date"), "net_amount": F.col("net_amount").cast("decimal(18,2)")})


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def results(df):
    return [
        kpi.revenue_by(df, excluded=EXCLUDED), kpi.revenue_by(df, excluded=None), kpi.aov_shift(df, excluded=EXCLUDED), trends.monthly_revenue(df, ["sales_channel"], excluded=EXCLUDED),
        trends.mom_growth(df.where("order_date is not null"), excluded=EXCLUDED), cubes.cube_monthly(df, EXCLUDED),
    ]


def test_sums_stand_in_for_facts(spark):
    o = orders(spark)
    for plain, summed in zip(results(o), results(state.order_sums(o))):
        assert rows(plain) == rows(summed)
    t = Retail(spark, SF_DIR)
    for plain, summed in zip(results(t.orders), results(state.order_sums(t.orders))):
        assert rows(plain) == rows(summed)
    assert rows(kpi.headline(t.orders, t.spend, EXCLUDED)) == rows(kpi.headline(state.order_sums(t.orders), state.spend_sums(t.spend), EXCLUDED))
    sold = kpi.product_sums(t.order_items, "list_value", "line_value")
    for dim in ("category", "brand"):
        assert rows(kpi.margin_by(t.order_items, t.products, dim, revenue="line_value")) == rows(kpi.margin_by(sold, t.products, dim))
    assert rows(kpi.units_and_asp(t.order_items, t.products, "category", "list_value", "line_value")) == rows(kpi.units_and_asp(sold, t.products, "category"))


def test_a_new_month_rewrites_its_partition_only(spark, tmp_path):
    folder, o = str(tmp_path / "sums"), orders(spark)
    late = orders(spark, [(10, "2024-02-02", "a", "F", "100.00"), (11, "2025-03-03", "b", "F", "9.00")])
    state.refresh(folder, o, "order_date", state.order_sums)
    assert rows(state.state(spark, folder)) == rows(state.order_sums(o))
    before = files(folder)
    state.refresh(folder, late, "order_date", state.order_sums, date(2024, 2, 20), date(2024, 2, 21))
    after = files(folder)
    changed = {f for f in set(before) ^ set(after)} | {f for f in before if after.get(f, before[f]) != before[f]}
    assert changed and all("month=2024-02" in f for f in changed)
    state.refresh(folder, late, "order_date", state.order_sums, date(2025, 2, 1), date(2025, 3, 1))
    assert rows(state.state(spark, folder)) == rows(state.order_sums(late))
    for plain, kept in zip(results(late), results(state.state(spark, folder))):
        assert rows(plain) == rows(kept)


def test_a_month_without_facts_any_more(spark, tmp_path):
    folder, o = str(tmp_path / "sums"), orders(spark)
    state.refresh(folder, o, "order_date", state.order_sums)
    fewer = o.where("order_date is null or month(order_date) <> 12")
    state.refresh(folder, fewer, "order_date", state.order_sums, date(2024, 11, 1), date(2025, 1, 31))
    assert rows(state.state(spark, folder)) == rows(state.order_sums(fewer))
    with pytest.raises(ValueError):
        state.refresh(folder, o, "order_date", state.order_sums, date(2024, 1, 1))


def test_only_the_months_facts_are_read(spark):
    days = Retail(spark, SF_DIR).orders
    some = days.where((F.col("order_date") >= F.lit(date(1995, 1, 1))) & (F.col("order_date") < F.lit(date(1995, 2, 1))))
    plan = state.order_sums(some)._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters" in plan and "1995-01-01" in plan


def test_a_whole_run_shares_scans_of_orders_and_lines(spark, tmp_path):
    from test_analysis import make_tables

    from shoplens.analysis import analyse
    from shoplens.plans import stored
    from shoplens.sources import SCHEMAS, load_csv

    for name, lines in make_tables().items():
        header = ",".join(c.split()[0] for c in SCHEMAS[name].split(", "))
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *[",".join(map(str, r)) for r in lines]]) + "\n")
    written = []

    def share(df, name):
        written.append(df)
        return stored(spark, str(tmp_path / "unused"))(df, name)

    def scans(frames, table):
        return sum(df._jdf.queryExecution().executedPlan().toString().count(f"/{table}.csv") for df in frames)

    t = load_csv(spark, str(tmp_path))
    apart, together = list(analyse(t).values()), list(analyse(t, share).values())
    for table, part in {"orders": 0.65, "order_items": 0.5}.items():
        assert scans([*together, *written], table) <= part * scans(apart, table)
