"""The synthetic order, part and event tables seen as retail tables.

Keys and measures are taken over unchanged; attributes the synthetic tables lack
(channels, devices, acquisition data) are derived from keys, for all rows.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the order status in the role of "Cancelled".
EXCLUDED = ("P",)

# Columns of the tables in use. Declared, so that defining a table reads no file.
_COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _dec(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)")


def _channel(n: Column) -> Column:
    return F.concat(F.lit("ch"), n.cast("string"))


def campaign() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


class Retail:
    """Lazily defined retail tables over one directory of test data."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.schema(_COLUMNS[table]).parquet(f"{self.directory}/{table}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_orderpriority").alias("sales_channel"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("net_amount"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """Order lines; ``line_value`` is the discounted price, exact to four decimals."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _dec("l_extendedprice").alias("list_value"),
            (_dec("l_extendedprice") * (1 - _dec("l_discount"))).alias("line_value"),
            F.to_date("l_shipdate").alias("ship_date"),
        )

    @cached_property
    def item_lines(self) -> DataFrame:
        """Order lines merged to their key (order, product)."""
        return self.order_items.groupBy("order_id", "product_id").agg(F.sum("line_value").alias("line_value"))

    @cached_property
    def returns(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .where("l_returnflag = 'R'")
            .select(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_partkey").alias("product_id"),
                F.to_date("l_shipdate").alias("return_date"),
                F.col("l_linestatus").alias("return_reason"),
                _dec("l_extendedprice").alias("refund_amount"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            (_dec("p_retailprice") * F.lit(Decimal("0.6"))).alias("cost"),
        )

    @cached_property
    def typed_categories(self) -> DataFrame:
        """Products with categories as typed by hand: padded or in other case, by the key."""
        kind, c = F.pmod("p_partkey", F.lit(5)), F.col("p_type")
        typed = (
            F.when(kind == 0, F.concat(F.lit("  "), c))
            .when(kind == 1, F.concat(c, F.lit(" ")))
            .when(kind == 2, F.upper(c))
            .when(kind == 3, F.lower(c))
            .otherwise(c)
        )
        return self.raw("part").select(F.col("p_partkey").alias("product_id"), typed.alias("category"))

    @cached_property
    def campaigns(self) -> DataFrame:
        start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("p_size", F.lit(15)).cast("int"))
        return self.raw("part").select(
            F.col("p_partkey").alias("campaign_id"),
            _channel(F.pmod("p_partkey", F.lit(7))).alias("channel"),
            start.alias("start_date"),
            F.date_add(start, 14).alias("end_date"),
            _dec("p_retailprice").alias("budget"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        label = F.pmod("c_custkey", F.lit(9))
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("segment"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("c_custkey", F.lit(30)).cast("int")).alias(
                "acquisition_date"
            ),
            F.when(label == 7, "Organic").when(label == 8, "Direct").otherwise(_channel(label)).alias(
                "acquisition_channel"
            ),
            F.when(label < 7, F.pmod("c_custkey", F.lit(100))).alias("acquisition_campaign_id"),
        )

    @cached_property
    def signups(self) -> DataFrame:
        """Customers with their first order date as signup date."""
        first = self.orders.groupBy("customer_id").agg(F.min("order_date").alias("signup_date"))
        return self.customers.join(first, "customer_id", "left")

    @cached_property
    def touchpoints(self) -> DataFrame:
        return (
            self.raw("events")
            .where("event_type <> 'purchase'")
            .select(
                F.col("event_id").alias("touchpoint_id"),
                F.col("user_id").alias("customer_id"),
                campaign().alias("campaign_id"),
                F.col("ts").alias("timestamp"),
                _channel(F.pmod(campaign(), F.lit(7))).alias("channel"),
                F.col("event_type").alias("interaction_type"),
            )
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return (
            self.raw("events")
            .where("event_type = 'view'")
            .select(
                F.col("event_id").alias("session_id"),
                F.col("user_id").alias("customer_id"),
                F.col("ts").alias("session_start"),
                F.concat(F.lit("device"), F.pmod(campaign(), F.lit(3)).cast("string")).alias("device"),
            )
        )

    @cached_property
    def conversions(self) -> DataFrame:
        """Purchases in the role of orders, for attribution; every ninth id is of an excluded one."""
        return (
            self.raw("events")
            .where("event_type = 'purchase'")
            .select(
                F.col("event_id").alias("order_id"),
                F.col("user_id").alias("customer_id"),
                F.to_date("ts").alias("order_date"),
                F.col("value").cast("decimal(18,2)").alias("net_amount"),
                F.when(F.pmod("event_id", F.lit(9)) == 4, EXCLUDED[0]).otherwise("F").alias("order_status"),
            )
        )

    @cached_property
    def spend(self) -> DataFrame:
        kind = F.col("event_type")
        return (
            self.raw("events")
            .groupBy(F.to_date("ts").alias("date"), campaign().alias("campaign_id"))
            .agg(
                F.coalesce(F.sum(F.when(kind == "view", _dec("value"))), F.lit(Decimal("0.00"))).alias("spend"),
                F.count_if(kind == "view").alias("impressions"),
                F.count_if(kind == "click").alias("clicks"),
            )
        )
