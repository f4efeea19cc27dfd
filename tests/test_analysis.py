"""All four levels end to end: ten CSV files in, every result out, spot-checked with SQL."""

import random
import tempfile
from datetime import date, datetime, timedelta
from pathlib import Path

import duckdb
import pytest

from shoplens import __main__ as cli
from shoplens.analysis import ORDER_BY, analyse
from shoplens.plans import stored
from shoplens.sources import SCHEMAS, load_csv

CHANNELS = ["SMS", "Email", "Display"]
START = date(2023, 1, 1)


def day(rng, span=700):
    return START + timedelta(days=rng.randrange(span))


def make_tables():
    rng = random.Random(5)
    customers = [f"CUS{i:05d}" for i in range(60)]
    campaigns = [f"CAMP{i:03d}" for i in range(9)]
    buyer = lambda: customers[0] if rng.random() < 0.33 else rng.choice(customers)
    t = {name: [] for name in SCHEMAS}
    for i, c in enumerate(campaigns):
        start = day(rng, 300)
        t["campaigns"].append([c, f"n{i}", CHANNELS[i % 3], "Awareness", "Sales", start, start + timedelta(days=200), rng.randrange(50, 900)])
    for c in customers:
        label = rng.choice([*CHANNELS, "Organic", "Direct"])
        t["customers"].append([c, day(rng), "F", "18-25", "Pune", "MH", day(rng, 400), label, "" if label in ("Organic", "Direct") else rng.choice(campaigns)])
    for i in range(12):
        t["products"].append([f"PROD{i:03d}", f"p{i}", ["Books", "Toys"][i % 2], "s", f"b{i % 5}", 10 + i, 5 + i])
    t["stores"].append(["STR01", "s", "Pune", "MH", "Kiosk", date(2020, 1, 1)])
    for d in range(0, 600, 40):
        for c in campaigns:
            t["marketing_spend"].append([START + timedelta(days=d), c, rng.randrange(40), rng.randrange(500), rng.randrange(30)])
    for i in range(900):
        at = datetime(2023, 1, 1) + timedelta(hours=rng.randrange(700 * 24))
        t["marketing_touchpoints"].append([f"TP{i:07d}", buyer(), rng.choice(campaigns), at, rng.choice(CHANNELS), rng.choice(["Click", "Impression"]), "Mobile"])
    for i in range(150):
        source = rng.choice(["Direct", "Email"])
        at = datetime(2023, 1, 1) + timedelta(hours=rng.randrange(700 * 24))
        t["sessions"].append([f"SES{i:07d}", buyer(), at, rng.choice(["Mobile", "Desktop"]), source, "" if source == "Direct" else rng.choice(campaigns), "/", 5, 2])
    for i in range(400):
        oid, where = f"ORD{i:06d}", rng.choice(["Online", "In-Store"])
        gross = rng.randrange(100, 5000)
        net = gross + rng.choice([0, 0, 0, 1])
        placed = day(rng)
        t["orders"].append([oid, buyer(), placed, where, "" if where == "Online" else "STR01", "Card", rng.choice(["Completed", "Completed", "Returned", "Cancelled"]), gross, 0, 0, net])
        for p in rng.sample(range(12), 2):
            t["order_items"].append([oid, f"PROD{p:03d}", rng.randrange(1, 4), 10 + p, rng.randrange(3)])
            if rng.random() < 0.2:
                t["returns"].append([f"RET{len(t['returns']):06d}", oid, f"PROD{p:03d}", placed + timedelta(days=9), 1, "Late", 10 + p])
    return t


@pytest.fixture(scope="module")
def folder():
    path = Path(tempfile.mkdtemp(prefix="run-"))
    for name, rows in make_tables().items():
        header = ",".join(c.split()[0] for c in SCHEMAS[name].split(", "))
        (path / f"{name}.csv").write_text("\r\n".join([header, *[",".join(map(str, r)) for r in rows]]) + "\r\n", newline="")
    return path


def test_command_line_writes_every_result(spark, folder):
    out = folder / "results"
    assert cli.main([str(folder), str(out)]) == 0
    assert cli.main([]) == 2
    names = set(analyse(load_csv(spark, str(folder))))
    assert {p.name for p in out.iterdir()} == names and len(names) == 64
    empty = {n for n in names if spark.read.parquet(str(out / n)).count() == 0}
    assert empty == {"duplicate_keys", "whitespace_values", "near_duplicate_values", "campaign_violations", "refund_exceeds_order"}
    report = {r["check_name"]: r["verdict"] for r in spark.read.parquet(str(out / "quality_report")).collect()}
    assert report["net_amount_off"] == "flag" and report["null_rule store_id"] == "pass"
    assert all(v == "pass" for k, v in report.items() if k.startswith("orphan"))


def test_shared_tables_go_to_the_checkpoint_folder(spark, folder):
    share = stored(spark, str(folder / "unused"))
    frame = share(spark.range(5), "r")
    assert frame.count() == 5
    assert not (folder / "unused").exists()
    assert all(f.startswith("file://" + spark.conf.get("spark.checkpoint.dir")) for f in frame.inputFiles())


def test_results_agree_with_plain_sql(spark, folder):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_csv('{folder}/{name}.csv', header=true)")
    got = analyse(load_csv(spark, str(folder)))
    touch = """WITH q AS (SELECT o.*, t.channel, t.timestamp, t.touchpoint_id FROM orders o
                 LEFT JOIN marketing_touchpoints t ON t.customer_id = o.customer_id AND t.timestamp < o.order_date)
               SELECT order_id, arg_min(channel, (timestamp, touchpoint_id)), arg_max(channel, (timestamp, touchpoint_id))
               FROM q GROUP BY order_id ORDER BY 1"""
    assert [tuple(r) for r in got["attribution"].select("order_id", "first_touch_channel", "last_touch_channel").orderBy("order_id").collect()] == con.execute(touch).fetchall()
    engaged = dict(con.execute("SELECT channel, count(*) FROM marketing_touchpoints WHERE interaction_type <> 'Impression' GROUP BY 1").fetchall())
    assert set(engaged) == {r["channel"] for r in got["model_comparison_engaged"].collect()}
    rates = """SELECT category, sum(quantity), count(DISTINCT return_id) FROM order_items JOIN products USING (product_id)
               LEFT JOIN returns USING (order_id, product_id) GROUP BY 1 ORDER BY 1"""
    assert [tuple(r) for r in got["return_rate_by_category"].select("category", "total_sold", "total_returns").orderBy("category").collect()] == con.execute(rates).fetchall()
    funnel = """SELECT s.device, count(DISTINCT s.customer_id), count(DISTINCT t.customer_id), count(DISTINCT o.customer_id)
                FROM sessions s LEFT JOIN marketing_touchpoints t ON t.customer_id = s.customer_id
                LEFT JOIN orders o ON o.customer_id = s.customer_id GROUP BY 1 ORDER BY 1"""
    assert [tuple(r)[:4] for r in got["funnel"].orderBy("device").collect()] == con.execute(funnel).fetchall()
    gap = "SELECT CAST(floor(avg(g)) AS INTEGER) FROM (SELECT order_date - lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date) AS g FROM orders)"
    assert got["repeat_gap"].first()["avg_repeat_purchase_gap_days"] == con.execute(gap).fetchone()[0]
    assert got["rfm"].count() == con.execute("SELECT count(DISTINCT customer_id) FROM orders WHERE order_status <> 'Cancelled'").fetchone()[0]


def test_order_keys_are_columns(spark, folder):
    results = analyse(load_csv(spark, str(folder)))
    for name, keys in ORDER_BY.items():
        assert {k.lstrip("-") for k in keys} <= set(results[name].columns), name


def test_report_equals_its_checks(spark, folder):
    got = analyse(load_csv(spark, str(folder)))
    report = {r["check_name"]: (r["n_checked"], r["n_failed"]) for r in got["quality_report"].collect()}
    for check, rows in {"touch_outside_campaign": "touches_outside_campaign", "order_before_signup": "orders_before_signup", "refund_exceeds_line": "refund_exceeds_line", "refund_exceeds_order": "refund_exceeds_order"}.items():
        assert report[check][1] == got[rows].count()
    for r in got["null_rules"].collect():
        assert report[f"null_rule {r['column_name']}"] == (r["n_rows"], r["n_failed"])
    for r in got["orphans"].collect():
        assert report[f"orphan {r['relation']}"] == (r["n_rows"], r["n_orphan"])
    assert report["net_amount_off"] == tuple(got["net_amount_reconciliation"].first())[:2]


def test_results_are_consistent_with_each_other(spark, folder):
    got = analyse(load_csv(spark, str(folder)))
    for r in got["funnel"].collect():
        assert max(r["stage2_had_touchpoint"], r["stage3_placed_order"]) <= r["stage1_had_session"]
    for r in got["cohort_retention"].collect():
        assert all(r[f"retention_month_{n}_pct"] is None or 0 <= r[f"retention_month_{n}_pct"] <= 100 for n in (1, 2, 3))
    slices = {(r["year_slice"], r["channel_slice"]): r["total_revenue"] for r in got["cube_slices"].collect()}
    years = {y for y, _ in slices} - {"All"}
    assert sum(slices[y, "All"] for y in years) == slices["All", "All"] == got["headline"].first()["total_revenue"]
    last = {}
    for r in got["running_total"].orderBy("year", "month").collect():
        last[r["sales_channel"]] = r["running_total"]
    assert last == {c: slices["All", c] for c in last}
    gap = got["unattributed"].first()
    for model in ("first", "last"):
        credited = sum(r["attributed_revenue"] for r in got[f"roas_{model}"].collect())
        assert credited + gap["unattributed_revenue"] == slices["All", "All"]
    assert sum(r["n_customers"] for r in got["segment_summary"].collect()) == got["rfm_coverage"].first()["n_eligible"]
    assert all(r["n_failed"] <= r["n_checked"] for r in got["quality_report"].collect())
