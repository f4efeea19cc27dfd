import tempfile
from pathlib import Path

import pytest

from shoplens.operators import quality
from shoplens.sources import (
    FOREIGN_KEYS,
    PRIMARY_KEYS,
    SCHEMAS,
    load_csv,
    load_parquet,
    register_views,
    write_extract,
    write_parquet,
)

# Fixed rows in the source format: header, comma separated, CRLF, empty field for NULL.
FILES = {
    "orders": "order_id,customer_id,order_date,sales_channel,store_id,payment_method,order_status,gross_amount,"
    "discount_amount,shipping_amount,net_amount\r\n"
    "ORD000001,CUS00001,2023-01-05,Online,,Card,Completed,100.5,10,5.25,95.75\r\n"
    "ORD000002,CUS00002,2023-01-06,In-Store,STR01,Cash,Cancelled,20,0,0,20\r\n",
    "stores": "store_id,store_name,city,state,store_type,opening_date\r\nSTR01,Store 1,Pune,MH,Kiosk,2021-11-25\r\n",
    "marketing_touchpoints": "touchpoint_id,customer_id,campaign_id,timestamp,channel,interaction_type,device\r\n"
    "TP0000001,CUS00001,CAMP001,2023-01-04 23:59:58,Email,click,Mobile\r\n",
}


@pytest.fixture
def folder():
    path = Path(tempfile.mkdtemp(prefix="run-"))
    for name, text in FILES.items():
        (path / f"{name}.csv").write_bytes(text.encode())
    return path


def test_ten_tables_are_declared():
    assert len(SCHEMAS) == 10 and set(PRIMARY_KEYS) == set(SCHEMAS)
    assert all(child in SCHEMAS and parent in SCHEMAS for child, _, parent in FOREIGN_KEYS)


def test_csv_round_trip_through_parquet(spark, folder):
    tables = load_csv(spark, str(folder), FILES)
    first = tables["orders"].orderBy("order_id").first()
    assert first["store_id"] is None and str(first["net_amount"]) == "95.75" and first["order_date"].year == 2023
    assert tables["marketing_touchpoints"].first()["timestamp"].second == 58
    write_parquet(tables, str(folder / "pq"))
    again = load_parquet(spark, str(folder / "pq"), FILES)
    for name in FILES:
        assert again[name].schema.simpleString() == tables[name].schema.simpleString()
        assert sorted(again[name].collect()) == sorted(tables[name].collect())
    register_views(again)
    assert spark.sql("SELECT count(*) FROM orders JOIN stores USING (store_id)").first()[0] == 1
    assert quality.duplicate_keys(again["orders"], PRIMARY_KEYS["orders"]).count() == 0


def test_malformed_rows_and_headers_fail(spark, folder):
    (folder / "stores.csv").write_text("store_id,store_name,city,state,store_type,opening_date\nS,x,c,s,t,not a date\n")
    with pytest.raises(Exception):
        load_csv(spark, str(folder), ["stores"])["stores"].collect()
    (folder / "stores.csv").write_text("id,store_name,city,state,store_type,opening_date\nS,x,c,s,t,2021-01-01\n")
    with pytest.raises(Exception):
        load_csv(spark, str(folder), ["stores"])["stores"].collect()


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_extracts(spark, folder, fmt):
    frame = spark.createDataFrame([(2023, "SMS", 1.5)], "year int, channel string, spend_cr double")
    write_extract({"spend": frame}, str(folder / fmt), fmt)
    reader = spark.read.schema(frame.schema)
    reader = reader.option("header", "true") if fmt == "csv" else reader
    assert reader.format(fmt).load(str(folder / fmt / "spend")).collect() == frame.collect()


def test_date_partitions_are_pruned(spark, folder):
    tables = load_csv(spark, str(folder), ["orders"])
    write_parquet(tables, str(folder / "by_day"), partition_by={"orders": "order_date"})
    again = load_parquet(spark, str(folder / "by_day"), ["orders"])["orders"]
    assert again.columns == tables["orders"].columns
    assert sorted(again.collect()) == sorted(tables["orders"].collect())
    plan = again.where("order_date = DATE '2023-01-06'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_date" in plan
