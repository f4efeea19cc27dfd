"""Every operator as a query over the test tables, with the SQL it must agree with.

The SQL states the plain definition (row-level joins, windows over whole tables).
It shares two definitions with the operators: ties in NTILE are ordered by a hash slot of the id, which the
published queries leave open, and the funnel counts customers, so it joins them distinct. Decimals are returned as doubles and
dates as text so that both engines hand over identical values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import attribution, cohorts, cubes, kpi, quality, segments, state, trends
from .analysis import ORDER_BY
from .plans import exact_ntile, new_folder, with_position
from .sources.testdata import EXCLUDED, Retail, campaign

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The retail tables in SQL; a query names the ones it reads.
_VIEWS = {
    "ord": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
               o_orderpriority AS sales_channel, o_orderstatus AS order_status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS net_amount
        FROM orders""",
    "item": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS list_value,
               CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) AS line_value,
               CAST(l_shipdate AS DATE) AS ship_date, l_returnflag, l_linestatus
        FROM lineitem""",
    "line": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id,
               sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS line_value
        FROM lineitem GROUP BY ALL""",
    "ret": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS return_date,
               l_linestatus AS return_reason, CAST(l_extendedprice AS DECIMAL(12,2)) AS refund_amount
        FROM lineitem WHERE l_returnflag = 'R'""",
    "prod": """
        SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
               CAST(p_retailprice AS DECIMAL(12,2)) * 0.6 AS cost
        FROM part""",
    "camp": """
        SELECT p_partkey AS campaign_id, 'ch' || (p_partkey % 7) AS channel,
               DATE '2024-01-01' + CAST(p_size % 15 AS INTEGER) AS start_date,
               DATE '2024-01-01' + CAST(p_size % 15 AS INTEGER) + 14 AS end_date,
               CAST(p_retailprice AS DECIMAL(12,2)) AS budget
        FROM part""",
    "cust": """
        SELECT c_custkey AS customer_id, DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS acquisition_date,
               CASE c_custkey % 9 WHEN 7 THEN 'Organic' WHEN 8 THEN 'Direct'
                    ELSE 'ch' || (c_custkey % 9) END AS acquisition_channel,
               CASE WHEN c_custkey % 9 < 7 THEN c_custkey % 100 END AS acquisition_campaign_id,
               c_mktsegment AS segment
        FROM customer""",
    "signup": """
        SELECT c_custkey AS customer_id,
               (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey) AS signup_date
        FROM customer""",
    "ev": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events""",
    "touch": """
        SELECT event_id AS touchpoint_id, user_id AS customer_id, k AS campaign_id, ts,
               'ch' || (k % 7) AS channel, event_type AS interaction_type
        FROM ev WHERE event_type <> 'purchase'""",
    "conv": """
        SELECT event_id AS order_id, user_id AS customer_id, day AS order_date,
               CAST(value AS DECIMAL(18,2)) AS net_amount,
               CASE WHEN event_id % 9 = 4 THEN 'P' ELSE 'F' END AS order_status
        FROM ev WHERE event_type = 'purchase'""",
    "sess": """
        SELECT user_id AS customer_id, 'device' || (k % 3) AS device FROM ev WHERE event_type = 'view'""",
    "spend": """
        SELECT day, k AS campaign_id,
               coalesce(sum(CAST(value AS DECIMAL(12,2))) FILTER (event_type = 'view'), 0) AS spend,
               count(*) FILTER (event_type = 'view') AS impressions,
               count(*) FILTER (event_type = 'click') AS clicks
        FROM ev GROUP BY ALL""",
    # Revenue per credited channel and model, from every earlier touch of every purchase.
    "credit": """
        SELECT c.order_id, any_value(c.customer_id) AS customer_id, any_value(c.order_date) AS order_date,
               any_value(c.net_amount) AS net_amount, any_value(c.order_status) AS order_status,
               arg_min(t.channel, (t.ts, t.touchpoint_id)) AS first_touch_channel,
               arg_max(t.channel, (t.ts, t.touchpoint_id)) AS last_touch_channel
        FROM conv c LEFT JOIN touch t ON t.customer_id = c.customer_id AND t.ts < c.order_date
        GROUP BY c.order_id""",
    # What earns: the revenue rule applies before attribution.
    "sold": """
        SELECT * FROM credit WHERE order_status <> 'P'""",
    "typed": """
        SELECT p_partkey AS product_id,
               CASE p_partkey % 5 WHEN 0 THEN '  ' || p_type WHEN 1 THEN p_type || ' ' WHEN 2 THEN upper(p_type)
                                  WHEN 3 THEN lower(p_type) ELSE p_type END AS category
        FROM part""",
    "chspend": """
        SELECT channel, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks
        FROM spend JOIN camp USING (campaign_id) GROUP BY channel""",
}
_NEEDS = {"touch": ["ev"], "conv": ["ev"], "sess": ["ev"], "spend": ["ev"], "credit": ["conv", "touch"], "sold": ["credit"],
          "chspend": ["spend", "camp"]}


def _rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def _div(num: str, den: str, digits: int | None = None, scale: int = 1) -> str:
    q = f"CAST({num} AS DOUBLE) * {float(scale)} / nullif(CAST({den} AS DOUBLE), 0)"
    return f"({q})" if digits is None else _rnd(q, digits)


def _with(*bodies: tuple[str, str], body: str, views: str = "") -> str:
    names: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in names:
            names.append(n)

    for v in views.split():
        need(v)
    ctes = [f"{n} AS ({_VIEWS[n].strip()})" for n in names] + [f"{n} AS ({b})" for n, b in bodies]
    prefix = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return re.sub(r"\n\s+", "\n ", prefix + body.strip())


def _plain(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None, views: str = "", ctes: list[tuple[str, str]] | None = None):
    def register(fn: Callable[[Retail], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(Retail(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = _with(*(ctes or []), body=sql, views=views)
        return fn

    return register


_D = "CAST({} AS DOUBLE)".format
_S = "CAST({} AS VARCHAR)".format
_I = "CAST({} AS INTEGER)".format
_B = "CAST({} AS BIGINT)".format

# ---------------------------------------------------------------- data quality


def _profile_sql(name: str, source: str, *cols: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, '{c}' AS column_name, "
        f"{_S(f'min(CAST({c} AS DATE))')} AS first_date, {_S(f'max(CAST({c} AS DATE))')} AS last_date FROM {source}"
        for c in cols
    ) or (
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS column_name, "
        f"CAST(NULL AS VARCHAR) AS first_date, CAST(NULL AS VARCHAR) AS last_date FROM {source}"
    )


@query(
    "profile",
    " UNION ALL ".join(
        [
            _profile_sql("campaigns", "camp", "start_date", "end_date"),
            _profile_sql("customers", "cust", "acquisition_date"),
            _profile_sql("touchpoints", "(SELECT ts AS timestamp FROM touch)", "timestamp"),
            _profile_sql("order_items", "item"),
            _profile_sql("orders", "ord", "order_date"),
            _profile_sql("products", "prod"),
            _profile_sql("returns", "ret", "return_date"),
            _profile_sql("marketing_spend", "(SELECT day AS date FROM spend)", "date"),
        ]
    ),
    views="camp cust touch item ord prod ret spend",
)
def _(t: Retail):
    return quality.profile_all(
        {
            "campaigns": (t.campaigns, ["start_date", "end_date"]),
            "customers": (t.customers, ["acquisition_date"]),
            "touchpoints": (t.touchpoints, ["timestamp"]),
            "order_items": (t.order_items, []),
            "orders": (t.orders, ["order_date"]),
            "products": (t.products, []),
            "returns": (t.returns, ["return_date"]),
            "marketing_spend": (t.spend, ["date"]),
        }
    )


@query(
    "outside_window",
    f"""SELECT touchpoint_id, t.campaign_id, {_S("ts")} AS timestamp
        FROM touch t JOIN camp c ON t.campaign_id = c.campaign_id
        WHERE ts < start_date OR ts > end_date""",
    views="touch camp",
)
def _(t: Retail):
    return quality.outside_parent_window(
        t.touchpoints, t.campaigns, "campaign_id", "timestamp", "start_date", "end_date", ["touchpoint_id"]
    ).select("touchpoint_id", "campaign_id", "timestamp")


@query(
    "before_date",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (acquisition_date < DATE '2024-01-05') AS n_before,
               {_div("count(*) FILTER (acquisition_date < DATE '2024-01-05')", "count(*)", 2, 100)} AS before_pct
        FROM cust""",
    views="cust",
)
def _(t: Retail):
    return quality.before_date(t.customers, "acquisition_date", date(2024, 1, 5))


_RELATIONS = [
    ("orders->customers", "ord", "cust", "customer_id", "customer_id"),
    ("order_items->orders", "item", "ord", "order_id", "order_id"),
    ("order_items->products", "item", "prod", "product_id", "product_id"),
    ("returns->orders", "ret", "ord", "order_id", "order_id"),
    ("touchpoints->campaigns", "touch", "camp", "campaign_id", "campaign_id"),
    ("customers->campaigns", "cust", "camp", "acquisition_campaign_id", "campaign_id"),
    ("touchpoints->customers", "touch", "cust", "customer_id", "customer_id"),
    ("orders->order_items", "ord", "item", "order_id", "order_id"),
]


@query(
    "orphans",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS relation, count(*) AS n_rows, count(*) - count(c.{ck}) AS n_null_key,
            count(*) FILTER (c.{ck} IS NOT NULL AND NOT EXISTS
                (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{ck})) AS n_orphan
            FROM {child} c"""
        for name, child, parent, ck, pk in _RELATIONS
    ),
    views="ord cust item prod ret touch camp",
)
def _(t: Retail):
    """Over the given tables, as several retail tables are parts of one of them, which is then read once."""
    tables = {n: t.raw(n) for n in ("orders", "lineitem", "part", "customer")}
    tables["events"] = t.raw("events").select("event_type", "user_id", campaign().alias("campaign_id"))
    tables["customer"] = tables["customer"].withColumn("campaign_id", F.when(F.pmod("c_custkey", F.lit(9)) < 7, F.pmod("c_custkey", F.lit(100))))
    touch, back = "event_type <> 'purchase'", "l_returnflag = 'R'"
    R = quality.Relation
    return quality.orphan_report(
        tables,
        [
            R("orders->customers", "orders", ["o_custkey"], "customer", ["c_custkey"]),
            R("order_items->orders", "lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
            R("order_items->products", "lineitem", ["l_partkey"], "part", ["p_partkey"]),
            R("returns->orders", "lineitem", ["l_orderkey"], "orders", ["o_orderkey"], back),
            R("touchpoints->campaigns", "events", ["campaign_id"], "part", ["p_partkey"], touch),
            R("customers->campaigns", "customer", ["campaign_id"], "part", ["p_partkey"]),
            R("touchpoints->customers", "events", ["user_id"], "customer", ["c_custkey"], touch),
            R("orders->order_items", "orders", ["o_orderkey"], "lineitem", ["l_orderkey"]),
        ],
    )


@query(
    "duplicate_keys",
    "SELECT order_id, product_id, count(*) AS n_rows FROM item GROUP BY ALL HAVING count(*) > 1",
    views="item",
)
def _(t: Retail):
    return quality.duplicate_keys(t.order_items, ["order_id", "product_id"])


@query(
    "null_sweep",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM cust"
        for c in ["customer_id", "segment", "acquisition_date", "acquisition_channel", "acquisition_campaign_id"]
    ),
    views="cust",
)
def _(t: Retail):
    return quality.null_sweep(t.customers)


@query(
    "null_by",
    """SELECT acquisition_channel, count(*) AS total, count(acquisition_campaign_id) AS n_present,
              count(*) - count(acquisition_campaign_id) AS n_null
       FROM cust GROUP BY acquisition_channel""",
    views="cust",
)
def _(t: Retail):
    return quality.null_by(t.customers, "acquisition_channel", "acquisition_campaign_id")


@query(
    "null_rule_holds",
    """SELECT 'acquisition_campaign_id' AS column_name, count(*) AS n_rows,
              count(*) FILTER ((acquisition_campaign_id IS NULL) <> (acquisition_channel IN ('Organic', 'Direct')))
                  AS n_failed,
              bool_and((acquisition_campaign_id IS NULL) = (acquisition_channel IN ('Organic', 'Direct'))) AS holds
       FROM cust""",
    views="cust",
)
def _(t: Retail):
    return quality.null_rule_holds(
        t.customers, "acquisition_campaign_id", F.col("acquisition_channel").isin("Organic", "Direct")
    )


@query(
    "null_rule_fails",
    """SELECT 'acquisition_campaign_id' AS column_name, count(*) AS n_rows,
              count(*) FILTER ((acquisition_campaign_id IS NULL) <> (acquisition_channel = 'Organic')) AS n_failed,
              bool_and((acquisition_campaign_id IS NULL) = (acquisition_channel = 'Organic')) AS holds
       FROM cust""",
    views="cust",
)
def _(t: Retail):
    return quality.null_rule_holds(t.customers, "acquisition_campaign_id", F.col("acquisition_channel") == "Organic")


@query(
    "flag_before",
    f"""SELECT customer_id, {_S("acquisition_date")} AS acquisition_date,
               acquisition_date < DATE '2024-01-05' AS before_cutoff FROM cust""",
    views="cust",
)
def _(t: Retail):
    flagged = quality.flag_before(t.customers, "acquisition_date", date(2024, 1, 5))
    return flagged.select("customer_id", F.col("acquisition_date").cast("string").alias("acquisition_date"), "before_cutoff")


@query(
    "whitespace_values",
    """SELECT DISTINCT category AS value, CAST(length(category) - length(trim(category)) AS INTEGER) AS whitespace_chars
       FROM typed WHERE length(category) <> length(trim(category))""",
    views="typed",
)
def _(t: Retail):
    return quality.whitespace_values(t.typed_categories, "category")


@query(
    "near_duplicate_values",
    """SELECT lower(trim(category)) AS normalized, count(DISTINCT category) AS n_variants, min(category) AS sample_low,
              max(category) AS sample_high, count(*) AS n_rows
       FROM typed WHERE category IS NOT NULL GROUP BY lower(trim(category)) HAVING count(DISTINCT category) > 1""",
    views="typed",
)
def _(t: Retail):
    return quality.near_duplicate_values(t.typed_categories, "category")


@query(
    "violations",
    f"""SELECT 'clicks_above_impressions' AS rule, {_S("day")} AS date, campaign_id, impressions, clicks
        FROM spend WHERE clicks > impressions
        UNION ALL
        SELECT 'free_impressions', {_S("day")}, campaign_id, impressions, clicks
        FROM spend WHERE spend <= 0 AND impressions > 0""",
    views="spend",
)
def _(t: Retail):
    return quality.violations(
        t.spend,
        {
            "clicks_above_impressions": F.col("clicks") > F.col("impressions"),
            "free_impressions": (F.col("spend") <= 0) & (F.col("impressions") > 0),
        },
    ).select("rule", "date", "campaign_id", "impressions", "clicks")


@query(
    "before_parent",
    f"""SELECT i.order_id, i.product_id, {_S("i.ship_date")} AS ship_date, {_S("o.order_date")} AS order_date
        FROM item i JOIN ord o ON i.order_id = o.order_id WHERE i.ship_date < o.order_date""",
    views="item ord",
)
def _(t: Retail):
    return quality.before_parent(
        t.order_items, t.orders, "order_id", "ship_date", "order_date", ["product_id", "ship_date"]
    ).select("order_id", "product_id", "ship_date", "order_date")


@query(
    "refund_exceeds_line",
    f"""SELECT r.order_id, r.product_id, {_D("r.refund_amount")} AS refund_amount,
               {_D("l.line_value")} AS item_line_value
        FROM ret r JOIN line l ON r.order_id = l.order_id AND r.product_id = l.product_id
        WHERE r.refund_amount > l.line_value""",
    views="ret line",
)
def _(t: Retail):
    return quality.refund_exceeds_line(t.returns, t.item_lines, line_value="line_value").select(
        "order_id", "product_id", "refund_amount", "item_line_value"
    )


@query(
    "refund_exceeds_order",
    f"""SELECT r.order_id, r.product_id, {_D("r.refund_amount")} AS refund_amount,
               {_D("o.net_amount")} AS order_net_amount
        FROM ret r JOIN ord o USING (order_id) WHERE r.refund_amount > o.net_amount""",
    views="ret ord",
)
def _(t: Retail):
    return quality.refund_exceeds_order(t.returns, t.orders).select(
        "order_id", "product_id", "refund_amount", "order_net_amount"
    )


@query(
    "reconcile",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (round(gross, 2) <> net_amount) AS n_mismatched,
               {_div("count(*) FILTER (round(gross, 2) <> net_amount)", "count(*)", 2, 100)} AS mismatched_pct
        FROM ord LEFT JOIN (SELECT order_id, sum(line_value) AS gross FROM item GROUP BY order_id) USING (order_id)""",
    views="ord item",
)
def _(t: Retail):
    gross = t.order_items.groupBy("order_id").agg(F.sum("line_value").alias("gross"))
    return quality.reconcile(t.orders.join(gross, "order_id", "left"), F.col("gross"), "net_amount")


@query(
    "censored_tail",
    f"""SELECT order_id, {_S("order_date")} AS order_date,
               (SELECT max(order_date) FROM ord) - order_date <
               (SELECT max(return_date) FROM ret) - (SELECT max(order_date) FROM ord) AS return_window_open
        FROM ord""",
    views="ord ret",
)
def _(t: Retail):
    return quality.censored_tail(t.orders, t.returns).select("order_id", "order_date", "return_window_open")


@query(
    "quality_report",
    f"""SELECT check_name, table_name, n_checked, n_failed, {_div("n_failed", "n_checked", 2, 100)} AS failed_pct,
               CASE WHEN n_failed = 0 THEN 'pass' ELSE 'flag' END AS verdict
        FROM (
            SELECT 'acquired_before_window' AS check_name, 'customers' AS table_name, count(*) AS n_checked,
                   count(*) FILTER (acquisition_date < DATE '2024-01-05') AS n_failed FROM cust
            UNION ALL SELECT 'order_has_customer', 'orders', count(*),
                   count(*) FILTER (customer_id NOT IN (SELECT customer_id FROM cust)) FROM ord
            UNION ALL SELECT 'clicks_above_impressions', 'marketing_spend', count(*),
                   count(*) FILTER (clicks > impressions) FROM spend
            UNION ALL SELECT 'negative_spend', 'marketing_spend', count(*), count(*) FILTER (spend < 0) FROM spend
            UNION ALL SELECT 'ends_before_start', 'campaigns', count(*),
                   count(*) FILTER (end_date < start_date) FROM camp
            UNION ALL SELECT 'refund_exceeds_line', 'returns', (SELECT count(*) FROM ret), count(*)
                   FROM ret r JOIN line l USING (order_id, product_id) WHERE r.refund_amount > l.line_value
            UNION ALL SELECT 'organic_without_campaign', 'customers', count(*),
                   count(*) FILTER ((acquisition_campaign_id IS NULL) <>
                                    (acquisition_channel IN ('Organic', 'Direct'))) FROM cust
            UNION ALL SELECT 'touch_outside_campaign', 'touchpoints', (SELECT count(*) FROM touch), count(*)
                   FROM touch JOIN camp USING (campaign_id) WHERE ts < start_date OR ts > end_date
        )""",
    views="cust ord spend camp ret line touch",
)
def _(t: Retail):
    unpaid = F.col("acquisition_channel").isin("Organic", "Direct")
    return quality.quality_report(
        [
            quality.relation_checks(
                t.customers, "customers", t.orders, "orders", "customer_id", orphan="order_has_customer",
                parent_rules={
                    "acquired_before_window": F.col("acquisition_date") < date(2024, 1, 5),
                    "organic_without_campaign": F.col("acquisition_campaign_id").isNull() != unpaid,
                },
            ),
            quality.relation_checks(
                t.campaigns, "campaigns", t.touchpoints, "touchpoints", "campaign_id",
                parent_rules={"ends_before_start": F.col("end_date") < F.col("start_date")},
                outside=("touch_outside_campaign", "timestamp", "start_date", "end_date"),
            ),
            quality.violation_counts(
                t.spend,
                {
                    "clicks_above_impressions": F.col("clicks") > F.col("impressions"),
                    "negative_spend": F.col("spend") < 0,
                },
                "marketing_spend",
            ),
            quality.table_checks(
                t.returns, "returns", {"refund_exceeds_line": F.col("refund_amount") > F.col("line_value")},
                [(t.item_lines, ["order_id", "product_id"])],
            ),
        ]
    )


# ------------------------------------------------------------------------ KPIs


@query(
    "revenue_by",
    f"""SELECT sales_channel, count(*) AS order_count, {_D("sum(net_amount)")} AS total_revenue,
               {_div("sum(net_amount)", "count(*)")} AS aov
        FROM ord WHERE order_status <> 'P' GROUP BY sales_channel""",
    views="ord",
)
def _(t: Retail):
    return kpi.revenue_by(t.orders, excluded=EXCLUDED)


@query(
    "aov_shift",
    f"""SELECT sales_channel, a AS aov_all, b AS aov_recognized, {_rnd("(b - a) * 100.0::DOUBLE / a", 2)} AS aov_shift_pct
        FROM (SELECT sales_channel, {_div("sum(net_amount)", "count(*)")} AS a,
                     {_div("sum(net_amount) FILTER (order_status <> 'P')", "count(*) FILTER (order_status <> 'P')")} AS b
              FROM ord GROUP BY sales_channel)""",
    views="ord",
)
def _(t: Retail):
    return kpi.aov_shift(t.orders, excluded=EXCLUDED)


@query(
    "channel_efficiency",
    f"""SELECT channel, {_D("spend")} AS total_spend, {_B("impressions")} AS total_impressions,
               {_B("clicks")} AS total_clicks, {_div("clicks", "impressions", 2, 100)} AS click_through_rate_pct,
               {_div("spend", "clicks", 2)} AS cost_per_click
        FROM chspend""",
    views="chspend",
)
def _(t: Retail):
    return kpi.channel_efficiency(t.spend, t.campaigns)


_VARIANCE = (
    "variance",
    """SELECT campaign_id, channel, budget, sum(spend) AS spent FROM spend JOIN camp USING (campaign_id)
       GROUP BY campaign_id, channel, budget""",
)


@query(
    "budget_variance",
    f"""SELECT campaign_id, channel, {_D("budget")} AS budget, {_D("spent")} AS total_spend,
               {_D("spent - budget")} AS overspend_amount, {_div("(spent - budget)", "budget", 2, 100)} AS overspend_pct
        FROM variance""",
    views="spend camp",
    ctes=[_VARIANCE],
)
def _(t: Retail):
    return kpi.budget_variance(t.spend, t.campaigns)


@query(
    "overspend_rate",
    f"""SELECT channel, count(*) AS n_campaigns, count(*) FILTER (spent > budget) AS n_overspent,
               {_div("count(*) FILTER (spent > budget)", "count(*)", 2, 100)} AS overspend_rate_pct
        FROM variance GROUP BY channel""",
    views="spend camp",
    ctes=[_VARIANCE],
)
def _(t: Retail):
    return kpi.overspend_rate(kpi.budget_variance(t.spend, t.campaigns))


def _margin_sql(dim: str, where: str = "") -> str:
    return f"""
        SELECT {dim}, {_D("sum(line_value)")} AS total_revenue, {_D("sum(line_value - cost * quantity)")} AS total_profit,
               {_div("sum(line_value - cost * quantity)", "sum(line_value)", 2, 100)} AS profit_margin_pct
        FROM item JOIN prod USING (product_id) {where} GROUP BY {dim}"""


@query("margin_by_category", _margin_sql("category"), views="item prod")
def _(t: Retail):
    return kpi.margin_by(t.order_items, t.products, "category", revenue="line_value")


@query("margin_by_brand", _margin_sql("brand"), views="item prod")
def _(t: Retail):
    return kpi.margin_by(t.order_items, t.products, "brand", revenue="line_value")


@query(
    "margin_by_category_recognized",
    _margin_sql("category", "JOIN ord USING (order_id) WHERE order_status <> 'P'"),
    views="item prod ord",
)
def _(t: Retail):
    return kpi.margin_by(t.order_items, t.products, "category", t.orders, EXCLUDED, "line_value")


@query(
    "units_and_asp",
    f"""SELECT category, sum(quantity)::BIGINT AS units, {_div("sum(list_value)", "count(*)", 2)} AS avg_line_price,
               {_div("sum(line_value)", "sum(quantity)", 2)} AS revenue_per_unit,
               {_I("rank() OVER (ORDER BY sum(quantity) DESC)")} AS units_rank
        FROM item JOIN prod USING (product_id) GROUP BY category""",
    views="item prod",
)
def _(t: Retail):
    return kpi.units_and_asp(t.order_items, t.products, "category", "list_value", "line_value")


@query(
    "share_of_total",
    f"""SELECT category, {_D("v")} AS total_revenue, {_div("v", "sum(v) OVER ()", 2, 100)} AS share_pct
        FROM (SELECT category, sum(line_value) AS v FROM item JOIN prod USING (product_id) GROUP BY category)""",
    views="item prod",
)
def _(t: Retail):
    return kpi.share_of_total(
        kpi.margin_by(t.order_items, t.products, revenue="line_value"), "category", "total_revenue"
    )


@query(
    "returns_by_reason",
    f"""SELECT return_reason, count(*) AS total_returns, {_D("sum(refund_amount)")} AS total_refund
        FROM ret GROUP BY return_reason""",
    views="ret",
)
def _(t: Retail):
    return kpi.returns_by(t.returns)


_RETURN_RATES = (
    "rates",
    """SELECT category, sum(quantity)::BIGINT AS units,
              count(*) FILTER (l_returnflag = 'R') AS n, sum(list_value) FILTER (l_returnflag = 'R') AS refunds
       FROM item JOIN prod USING (product_id) GROUP BY category""",
)


@query(
    "return_rate_by",
    f"""SELECT category, units AS total_sold, n AS total_returns, {_D("refunds")} AS total_refunds,
               {_div("n", "units", 2, 100)} AS return_rate_pct
        FROM rates""",
    views="item prod",
    ctes=[_RETURN_RATES],
)
def _(t: Retail):
    return kpi.return_rate_by(t.order_items, t.products, t.returns)


@query(
    "return_rate_by_fanout",
    f"""SELECT category, sum(units)::BIGINT AS total_sold, count(return_reason) AS total_returns,
               {_D("sum(refund_amount)")} AS total_refunds,
               {_div("count(return_reason)", "sum(units)", 2, 100)} AS return_rate_pct
        FROM (SELECT order_id, product_id, sum(quantity) AS units FROM item GROUP BY ALL)
             JOIN prod USING (product_id) LEFT JOIN ret USING (order_id, product_id)
        GROUP BY category""",
    views="item prod ret",
)
def _(t: Retail):
    return kpi.return_rate_by(t.order_items, t.products, t.returns, fanout=True)


@query(
    "refund_share",
    f"""SELECT category, {_D("refunds")} AS total_refunds, {_div("refunds", "sum(refunds) OVER ()", 2, 100)} AS share_pct
        FROM rates""",
    views="item prod",
    ctes=[_RETURN_RATES],
)
def _(t: Retail):
    return kpi.refund_share(kpi.return_rate_by(t.order_items, t.products, t.returns))


@query(
    "headline",
    f"""SELECT {_D("sum(net_amount)")} AS total_revenue, count(*) AS order_count,
               {_D("(SELECT sum(spend) FROM spend)")} AS total_spend,
               {_div("sum(net_amount)", "(SELECT sum(spend) FROM spend)", 2)} AS blended_roas
        FROM ord WHERE order_status <> 'P'""",
    views="ord spend",
)
def _(t: Retail):
    return kpi.headline(t.orders, t.spend, EXCLUDED)


@query(
    "cpa_by_channel",
    f"""SELECT channel, {_D("spend")} AS total_spend, new_customers,
               {_div("spend", "new_customers", 2)} AS cost_per_acquisition
        FROM chspend JOIN (SELECT acquisition_channel AS channel, count(*) AS new_customers
                           FROM cust GROUP BY ALL) USING (channel)""",
    views="chspend cust",
)
def _(t: Retail):
    return kpi.cpa_by_channel(t.spend, t.campaigns, t.customers)


# --------------------------------------------------------- trends and behaviour

_TOP3 = (
    "top3",
    """SELECT product_id, category, brand, sum(line_value) AS revenue,
              dense_rank() OVER (PARTITION BY category ORDER BY sum(line_value) DESC) AS ranking
       FROM item JOIN prod USING (product_id) GROUP BY product_id, category, brand QUALIFY ranking <= 3""",
)


def _top3(t: Retail) -> DataFrame:
    return trends.top_k_per_group(t.order_items, t.products, revenue="line_value", carry=["brand"])


@query(
    "top_k_per_group",
    f"SELECT product_id, category, brand, {_D('revenue')} AS revenue, {_I('ranking')} AS ranking FROM top3",
    views="item prod",
    ctes=[_TOP3],
)
def _(t: Retail):
    return _top3(t)


@query(
    "leader_ratio",
    f"""SELECT category, {_D("revenue")} AS leader_revenue,
               {_div("max(revenue) OVER ()", "revenue", 2)} AS times_smaller
        FROM (SELECT DISTINCT category, revenue FROM top3 WHERE ranking = 1)""",
    views="item prod",
    ctes=[_TOP3],
)
def _(t: Retail):
    return trends.leader_ratio(_top3(t))


@query(
    "top_k_brand_concentration",
    f"""SELECT category, {_B("sum(n)")} AS n_products, count(*) AS n_brands, max(n) AS largest_brand_products,
               {_div("max(n)", "sum(n)", 2, 100)} AS largest_brand_pct
        FROM (SELECT category, brand, count(*) AS n FROM top3 GROUP BY ALL) GROUP BY category""",
    views="item prod",
    ctes=[_TOP3],
)
def _(t: Retail):
    return trends.top_k_brand_concentration(_top3(t))


_MONTHLY = (
    "monthly",
    """SELECT year(order_date)::INTEGER AS year, month(order_date)::INTEGER AS month, count(*) AS orders,
              sum(net_amount) AS revenue
       FROM ord WHERE order_status <> 'P' GROUP BY ALL""",
)


@query(
    "mom_growth",
    f"""SELECT year, month, {_D("revenue")} AS current_revenue, {_D("prev")} AS prev_month_revenue,
               {_div("(revenue - prev)", "prev", None, 100)} AS mom_growth_pct
        FROM (SELECT *, lag(revenue) OVER (ORDER BY year, month) AS prev FROM monthly)""",
    views="ord",
    ctes=[_MONTHLY],
)
def _(t: Retail):
    return trends.mom_growth(t.orders, excluded=EXCLUDED)


@query(
    "running_total",
    f"""SELECT sales_channel, year(order_date)::INTEGER AS year, month(order_date)::INTEGER AS month,
               count(*) AS orders, {_D("sum(net_amount)")} AS revenue,
               {_D("sum(sum(net_amount)) OVER (PARTITION BY sales_channel ORDER BY year(order_date), month(order_date))")}
                   AS running_total
        FROM ord WHERE order_status <> 'P' GROUP BY sales_channel, year(order_date), month(order_date)""",
    views="ord",
)
def _(t: Retail):
    monthly = trends.monthly_revenue(t.orders, ["sales_channel"], excluded=EXCLUDED)
    return trends.running_total(monthly, ["sales_channel"], ["year", "month"], "revenue")


@query(
    "funnel",
    f"""SELECT device, count(DISTINCT s.customer_id) AS stage1_had_session,
               count(DISTINCT t.customer_id) AS stage2_had_touchpoint,
               count(DISTINCT c.customer_id) AS stage3_placed_order,
               {_div("count(DISTINCT c.customer_id)", "count(DISTINCT s.customer_id)", 2, 100)} AS order_conversion_pct
        FROM sess s
        LEFT JOIN (SELECT DISTINCT customer_id FROM touch) t ON t.customer_id = s.customer_id
        LEFT JOIN (SELECT DISTINCT customer_id FROM conv) c ON c.customer_id = s.customer_id
        GROUP BY device""",
    views="sess touch conv",
)
def _(t: Retail):
    return trends.funnel(t.sessions, t.touchpoints, t.conversions)


@query(
    "funnel_by_segment",
    f"""SELECT device, count(DISTINCT customer_id) AS stage1_had_session,
               count(DISTINCT customer_id) FILTER (EXISTS (SELECT 1 FROM touch t WHERE t.customer_id = s.customer_id))
                   AS stage2_had_touchpoint,
               count(DISTINCT customer_id) FILTER (EXISTS (SELECT 1 FROM ord o WHERE o.customer_id = s.customer_id))
                   AS stage3_placed_order,
               {_div("count(DISTINCT customer_id) FILTER (EXISTS (SELECT 1 FROM ord o WHERE o.customer_id = s.customer_id))",
                     "count(DISTINCT customer_id)", 2, 100)} AS order_conversion_pct
        FROM (SELECT segment AS device, customer_id FROM cust) s GROUP BY device""",
    views="cust touch ord",
)
def _(t: Retail):
    # Every customer as a visitor: unlike the sessions, most have no touch.
    visitors = t.customers.select(F.col("segment").alias("device"), "customer_id")
    return trends.funnel(visitors, t.touchpoints, t.orders)


@query(
    "coverage",
    f"""SELECT count(*) AS n_customers,
               count(*) FILTER (NOT EXISTS (SELECT 1 FROM touch t WHERE t.customer_id = c.customer_id)) AS n_untouched,
               (SELECT count(*) FROM touch) AS n_touches,
               {_div("(SELECT count(*) FROM touch)", "count(*)", 2)} AS touches_per_customer
        FROM cust c""",
    views="cust touch",
)
def _(t: Retail):
    return trends.coverage(t.customers, t.touchpoints)


@query(
    "repeat_gap",
    f"""SELECT {_B("sum(gap)")} AS total_days, count(gap) AS n_gaps, {_div("sum(gap)", "count(gap)")} AS avg_gap_days,
               CAST(floor(avg(gap)) AS INTEGER) AS avg_repeat_purchase_gap_days
        FROM (SELECT order_date - lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date) AS gap FROM ord)""",
    views="ord",
)
def _(t: Retail):
    return trends.repeat_gap(t.orders)


@query(
    "winback_flag",
    f"""SELECT customer_id, {_S("max(order_date)")} AS last_order_date,
               CAST((SELECT max(order_date) FROM ord) - max(order_date) AS INTEGER) AS days_since_order,
               (SELECT max(order_date) FROM ord) - max(order_date) >= 90 AS needs_winback
        FROM ord GROUP BY customer_id""",
    views="ord",
)
def _(t: Retail):
    return trends.winback_flag(t.orders)


@query(
    "growth_ratio",
    f"""SELECT {_div("(SELECT orders FROM monthly ORDER BY year DESC, month DESC LIMIT 1)",
                     "(SELECT orders FROM monthly ORDER BY year, month LIMIT 1)", 2)} AS order_growth_ratio,
               {_div("(SELECT count(signup_date) FROM signup)",
                     "(SELECT count(*) FROM signup WHERE strftime(signup_date, '%Y%m') = "
                     "(SELECT min(strftime(signup_date, '%Y%m')) FROM signup))", 2)} AS customer_growth_ratio""",
    views="ord signup",
    ctes=[_MONTHLY],
)
def _(t: Retail):
    signups = (
        t.signups.where("signup_date IS NOT NULL")
        .groupBy(F.year("signup_date").alias("year"), F.month("signup_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return trends.growth_ratio(trends.monthly_revenue(t.orders, excluded=EXCLUDED), signups)


# -------------------------------------------------------- segments and cohorts

_RFM = (
    "rfm",
    """SELECT *, r_score + f_score + m_score AS rfm_total,
              CASE WHEN r_score + f_score + m_score >= 12 THEN 'Champions'
                   WHEN r_score + f_score + m_score >= 9 THEN 'Loyal Customers'
                   WHEN r_score + f_score + m_score >= 6 THEN 'At Risk' ELSE 'Lost' END AS customer_segment
       FROM (SELECT customer_id, gap, n, total,
                    CAST(ntile(5) OVER (ORDER BY gap DESC, slot, customer_id) AS INTEGER) AS r_score,
                    CAST(ntile(5) OVER (ORDER BY n, slot, customer_id) AS INTEGER) AS f_score,
                    CAST(ntile(5) OVER (ORDER BY total, slot, customer_id) AS INTEGER) AS m_score
             FROM (SELECT customer_id, substr(md5(CAST(customer_id AS VARCHAR)), 1, 4) AS slot,
                          CAST((SELECT max(order_date) FROM ord WHERE order_status <> 'P') - max(order_date)
                               AS INTEGER) AS gap,
                          count(*) AS n, sum(net_amount) AS total
                   FROM ord WHERE order_status <> 'P' GROUP BY customer_id))""",
)


@query(
    "rfm",
    f"""SELECT customer_id, gap AS gap_in_recent_order, n AS number_of_orders, {_D("total")} AS total_value,
               r_score, f_score, m_score, rfm_total, customer_segment
        FROM rfm""",
    views="ord",
    ctes=[_RFM],
)
def _(t: Retail):
    return segments.rfm(t.orders, excluded=EXCLUDED)


@query(
    "rfm_coverage",
    """SELECT (SELECT count(*) FROM rfm) AS n_segmented,
              count(DISTINCT customer_id) FILTER (order_status <> 'P') AS n_eligible,
              count(DISTINCT customer_id) - count(DISTINCT customer_id) FILTER (order_status <> 'P') AS n_only_excluded,
              (SELECT count(*) FROM rfm) = count(DISTINCT customer_id) FILTER (order_status <> 'P') AS complete
       FROM ord""",
    views="ord",
    ctes=[_RFM],
)
def _(t: Retail):
    return segments.rfm_coverage(segments.rfm(t.orders, excluded=EXCLUDED), t.orders, EXCLUDED)


@query(
    "segment_summary",
    f"""SELECT customer_segment, count(*) AS n_customers, {_B("sum(n)")} AS n_orders,
               {_D("sum(total)")} AS total_value, {_div("sum(total)", "count(*)", 2)} AS avg_customer_value
        FROM rfm GROUP BY customer_segment""",
    views="ord",
    ctes=[_RFM],
)
def _(t: Retail):
    return segments.segment_summary(segments.rfm(t.orders, excluded=EXCLUDED))


@query(
    "ntile_items",
    """SELECT order_id, product_id, line_no, CAST(ntile(7) OVER (ORDER BY quantity, slot, row_id) AS INTEGER) AS bucket
       FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_no, l_quantity AS quantity,
                    concat_ws('-', l_orderkey, l_partkey, l_linenumber, l_suppkey) AS row_id,
                    substr(md5(concat_ws('-', l_orderkey, l_partkey, l_linenumber, l_suppkey)), 1, 4) AS slot
             FROM lineitem)""",
)
def _(t: Retail):
    # Fifty quantities over all lines: every bucket edge falls inside a large tie.
    rows = t.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("quantity"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").alias("row_id"),
    )
    return exact_ntile(rows, "row_id", {"bucket": F.col("quantity")}, 7).select(
        "order_id", "product_id", "line_no", "bucket"
    )


def _diversity_sql(touches: str, orders: str) -> str:
    return f"""
        SELECT channel_count, count(*) AS total_customers, count(total) AS customers_who_ordered,
               {_div("sum(coalesce(total, 0))", "count(*)", 2)} AS avg_customer_value,
               {_div("count(total)", "count(*)", 1, 100)} AS conversion_rate_pct
        FROM (SELECT customer_id, count(DISTINCT channel) AS channel_count FROM {touches} GROUP BY customer_id)
        LEFT JOIN (SELECT customer_id, sum(net_amount) AS total FROM {orders} GROUP BY customer_id) USING (customer_id)
        GROUP BY channel_count"""


@query(
    "channel_diversity_value",
    _diversity_sql("(SELECT customer_id, campaign_id AS channel FROM touch)", "(FROM ord WHERE order_status <> 'P')"),
    views="touch ord",
)
def _(t: Retail):
    # Campaigns in the role of channels: every customer is reached by all seven channels.
    touches = t.touchpoints.select("customer_id", F.col("campaign_id").alias("channel"))
    return segments.channel_diversity_value(touches, t.orders, EXCLUDED)


_COHORT = (
    "cohort",
    f"""SELECT year(s.signup_date)::INTEGER AS cohort_year, month(s.signup_date)::INTEGER AS cohort_month,
               count(DISTINCT s.customer_id) AS cohort_size,
               {", ".join(
                   f'''CASE WHEN max(s.signup_date) + INTERVAL {n} MONTH <= DATE '2001-07-31' THEN {_div(
                       f"count(DISTINCT s.customer_id) FILTER (datediff('month', s.signup_date, o.order_date) = {n})",
                       "count(DISTINCT s.customer_id)", 1, 100)} END AS m{n}''' for n in (1, 2, 3))}
        FROM signup s LEFT JOIN ord o USING (customer_id) GROUP BY ALL HAVING count(o.order_id) > 0""",
)


def _retention(t: Retail) -> DataFrame:
    return cohorts.cohort_retention(t.signups, t.orders, date(2001, 7, 31))


@query(
    "cohort_retention",
    """SELECT cohort_year, cohort_month, cohort_size, m1 AS retention_month_1_pct, m2 AS retention_month_2_pct,
              m3 AS retention_month_3_pct FROM cohort""",
    views="signup ord",
    ctes=[_COHORT],
)
def _(t: Retail):
    return _retention(t)


def _label_sql(bound: str) -> str:
    return f"""
        SELECT matched, count(*) AS customer_count, {_div("count(*)", "sum(count(*)) OVER ()", 2, 100)} AS percentage
        FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM touch t WHERE t.customer_id = c.customer_id
                          AND t.channel = c.acquisition_channel {bound}) THEN 1 ELSE 0 END AS matched
              FROM cust c WHERE acquisition_channel NOT IN ('Organic', 'Direct'))
        GROUP BY matched"""


@query("label_match", _label_sql("AND CAST(t.ts AS DATE) <= c.acquisition_date"), views="touch cust")
def _(t: Retail):
    return cohorts.label_match(t.customers, t.touchpoints)


@query("label_match_any", _label_sql(""), views="touch cust")
def _(t: Retail):
    return cohorts.label_match(t.customers, t.touchpoints, bound=None)


# ------------------------------------------------------------------ attribution


def _days(t: Retail, touch_filter=None) -> DataFrame:
    return attribution.touch_days(t.conversions, t.touchpoints, EXCLUDED, touch_filter)


@query(
    "attribute",
    f"""SELECT order_id, customer_id, {_S("order_date")} AS order_date, {_D("net_amount")} AS net_amount,
               first_touch_channel, last_touch_channel FROM credit""",
    views="credit",
)
def _(t: Retail):
    return attribution.attribute(t.conversions, t.touchpoints)


@query(
    "attribute_engaged",
    f"""SELECT c.order_id, c.customer_id, {_S("c.order_date")} AS order_date, {_D("c.net_amount")} AS net_amount,
               arg_min(t.channel, (t.ts, t.touchpoint_id)) AS first_touch_channel,
               arg_max(t.channel, (t.ts, t.touchpoint_id)) AS last_touch_channel
        FROM conv c LEFT JOIN touch t
             ON t.customer_id = c.customer_id AND t.ts < c.order_date AND t.interaction_type = 'click'
        GROUP BY c.order_id, c.customer_id, c.order_date, c.net_amount""",
    views="conv touch",
)
def _(t: Retail):
    return attribution.attribute(
        t.conversions, t.touchpoints, touch_filter=F.col("interaction_type") == "click"
    )


def _roas_sql(model: str) -> str:
    return f"""
        SELECT channel, {_D("s.spend")} AS total_spend, {_D("r.revenue")} AS attributed_revenue,
               {_div("r.revenue", "s.spend", 2)} AS roas
        FROM chspend s JOIN (SELECT {model}_touch_channel AS channel, sum(net_amount) AS revenue FROM sold
                             WHERE {model}_touch_channel IS NOT NULL GROUP BY 1) r USING (channel)"""


@query("roas_first", _roas_sql("first"), views="sold chspend")
def _(t: Retail):
    return attribution.roas(t.conversions, t.touchpoints, t.spend, t.campaigns, "first", EXCLUDED)


@query("roas_last", _roas_sql("last"), views="sold chspend")
def _(t: Retail):
    return attribution.roas(t.conversions, t.touchpoints, t.spend, t.campaigns, "last", EXCLUDED)


@query(
    "unattributed",
    f"""SELECT count(*) AS n_orders, {_D("sum(net_amount)")} AS total_revenue,
               count(*) FILTER (first_touch_channel IS NULL) AS n_unattributed,
               {_D("coalesce(sum(net_amount) FILTER (first_touch_channel IS NULL), 0)")} AS unattributed_revenue
        FROM sold""",
    views="sold",
)
def _(t: Retail):
    return attribution.unattributed(_days(t))


def _comparison_cte(name: str, credit: str) -> tuple[str, str]:
    return (
        name,
        f"""SELECT channel, spend, f, l, {_I("rank() OVER (ORDER BY f DESC)")} AS rank_first,
               {_I("rank() OVER (ORDER BY l DESC)")} AS rank_last
        FROM (SELECT channel, spend,
                     {_div(f"coalesce((SELECT sum(net_amount) FROM {credit} WHERE first_touch_channel = channel), 0)", "spend")} AS f,
                     {_div(f"coalesce((SELECT sum(net_amount) FROM {credit} WHERE last_touch_channel = channel), 0)", "spend")} AS l
              FROM chspend)""",
    )


_COMPARISON = _comparison_cte("comparison", "sold")
_ENGAGED = (
    "engaged",
    """SELECT c.order_id, any_value(c.net_amount) AS net_amount, arg_min(t.channel, (t.ts, t.touchpoint_id)) AS first_touch_channel,
              arg_max(t.channel, (t.ts, t.touchpoint_id)) AS last_touch_channel
       FROM conv c LEFT JOIN touch t ON t.customer_id = c.customer_id AND t.ts < c.order_date AND t.interaction_type = 'click'
       WHERE c.order_status <> 'P' GROUP BY c.order_id""",
)


def _comparison(t: Retail, touch_filter=None) -> DataFrame:
    return attribution.model_comparison(
        attribution.attributed_revenue(_days(t, touch_filter)), kpi.spend_by_channel(t.spend, t.campaigns)
    )


@query(
    "model_comparison_engaged",
    f"""SELECT channel, {_D("spend")} AS total_spend, {_rnd("f", 2)} AS roas_first, {_rnd("l", 2)} AS roas_last,
               rank_first, rank_last, rank_first - rank_last AS places_gained
        FROM comparison_engaged""",
    views="conv touch chspend",
    ctes=[_ENGAGED, _comparison_cte("comparison_engaged", "engaged")],
)
def _(t: Retail):
    return _comparison(t, F.col("interaction_type") == "click")


@query(
    "model_comparison",
    f"""SELECT channel, {_D("spend")} AS total_spend, {_rnd("f", 2)} AS roas_first, {_rnd("l", 2)} AS roas_last,
               rank_first, rank_last, rank_first - rank_last AS places_gained
        FROM comparison""",
    views="sold chspend",
    ctes=[_COMPARISON],
)
def _(t: Retail):
    return _comparison(t)


@query(
    "spend_vs_roas",
    f"""SELECT channel, {_D("spend")} AS total_spend, {_rnd("f", 2)} AS roas_first, {_rnd("l", 2)} AS roas_last,
               CASE sign({_rnd("l", 2)} - {_rnd("f", 2)}) WHEN 1 THEN 'last' WHEN -1 THEN 'first' ELSE 'equal' END
                   AS stronger_model
        FROM comparison""",
    views="sold chspend",
    ctes=[_COMPARISON],
)
def _(t: Retail):
    return attribution.spend_vs_roas(_comparison(t))


# ------------------------------------------------------------------------ cubes



def _cr(x: str) -> str:
    return f"round(CAST({x} AS DECIMAL(26,4)) * CAST(0.0000001 AS DECIMAL(7,7)), 6)"


_CUBE_A = (
    "cube_a",
    f"""SELECT year(order_date)::INTEGER AS year, model, channel, {_cr("sum(net_amount)")} AS revenue_cr
        FROM (SELECT order_date, net_amount, 'first' AS model, first_touch_channel AS channel FROM sold
              UNION ALL SELECT order_date, net_amount, 'last', last_touch_channel FROM sold)
        WHERE channel IS NOT NULL GROUP BY ALL""",
)
_CUBE_S = (
    "cube_s",
    f"""SELECT year(day)::INTEGER AS year, channel, {_cr("sum(spend)")} AS spend_cr,
               {_B("sum(impressions)")} AS impressions, {_B("sum(clicks)")} AS clicks
        FROM spend JOIN camp USING (campaign_id) GROUP BY ALL""",
)
_CUBE_C = (
    "cube_c",
    f"""SELECT year(order_date)::INTEGER AS year, sales_channel, category,
               {_cr("sum(line_value) FILTER (order_status <> 'P')")} AS revenue_cr,
               {_cr("sum(cost * quantity) FILTER (order_status <> 'P')")} AS cost_cr,
               {_B("coalesce(sum(quantity) FILTER (order_status <> 'P'), 0)")} AS units,
               count(*) FILTER (l_returnflag = 'R') AS returns
        FROM item JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY ALL""",
)


@query(
    "cube_attribution",
    f"SELECT year, model, channel, {_D('revenue_cr')} AS revenue_cr FROM cube_a",
    views="sold",
    ctes=[_CUBE_A],
)
def _(t: Retail):
    return cubes.cube_attribution(_days(t))


@query(
    "cube_spend",
    f"SELECT year, channel, {_D('spend_cr')} AS spend_cr, impressions, clicks FROM cube_s",
    views="spend camp",
    ctes=[_CUBE_S],
)
def _(t: Retail):
    return cubes.cube_spend(t.spend, t.campaigns)


@query(
    "cube_monthly",
    f"""SELECT CAST((year(order_date) - (SELECT min(year(order_date)) FROM ord WHERE order_status <> 'P')) * 12
                    + month(order_date) - 1 AS INTEGER) AS month_idx,
               sales_channel, count(*) AS orders, {_D(_cr("sum(net_amount)"))} AS revenue_cr
        FROM ord WHERE order_status <> 'P' GROUP BY ALL""",
    views="ord",
)
def _(t: Retail):
    return cubes.cube_monthly(t.orders, EXCLUDED)


@query(
    "cube_category",
    f"""SELECT year, sales_channel, category, {_D("revenue_cr")} AS revenue_cr, {_D("cost_cr")} AS cost_cr,
               units, returns FROM cube_c""",
    views="item ord prod",
    ctes=[_CUBE_C],
)
def _(t: Retail):
    return cubes.cube_category(t.order_items, t.orders, t.products, t.returns, EXCLUDED, "line_value")


@query(
    "cube_cohort",
    f"""SELECT CAST(cohort_year * 12 + cohort_month - min(cohort_year * 12 + cohort_month) OVER () AS INTEGER) AS cohort_idx,
               cohort_size AS size, m1, m2, m3
        FROM cohort""",
    views="signup ord",
    ctes=[_COHORT],
)
def _(t: Retail):
    return cubes.cube_cohort(_retention(t))


@query(
    "cube_slices",
    f"""SELECT slice_id, year_slice, channel_slice, order_count, {_D("revenue")} AS total_revenue, {_D("spent")} AS total_spend,
               CASE WHEN slice_id IN (1, 3) THEN {_div("revenue", "spent", 2)} END AS blended_roas
        FROM (SELECT grouping(y, sales_channel) AS slice_id, CASE WHEN grouping(y) = 1 THEN 'All' ELSE CAST(y AS VARCHAR) END AS year_slice,
                     CASE WHEN grouping(sales_channel) = 1 THEN 'All' ELSE sales_channel END AS channel_slice,
                     count(*) AS order_count, sum(net_amount) AS revenue
              FROM (SELECT *, year(order_date) AS y FROM ord WHERE order_status <> 'P')
              GROUP BY CUBE (y, sales_channel))
        LEFT JOIN (SELECT CASE WHEN grouping(y) = 1 THEN 'All' ELSE CAST(y AS VARCHAR) END AS year_slice, sum(spend) AS spent
                   FROM (SELECT *, year(day) AS y FROM spend) GROUP BY ROLLUP (y)) USING (year_slice)""",
    views="ord spend",
)
def _(t: Retail):
    return cubes.cube_slices(t.orders, t.spend, EXCLUDED)


@query(
    "channel_metrics",
    f"""SELECT channel, {_D("sum(spend_cr)")} AS spend_cr, {_div("sum(clicks)", "sum(impressions)", 2, 100)} AS ctr_pct,
               {_div("sum(spend_cr)", "sum(clicks)", 2, 10_000_000)} AS cpc,
               {_div("coalesce((SELECT sum(revenue_cr) FROM cube_a a WHERE model = 'first' AND a.channel = s.channel), 0)",
                     "sum(spend_cr)", 2)} AS roas_first,
               {_div("coalesce((SELECT sum(revenue_cr) FROM cube_a a WHERE model = 'last' AND a.channel = s.channel), 0)",
                     "sum(spend_cr)", 2)} AS roas_last
        FROM cube_s s GROUP BY channel""",
    views="sold spend camp",
    ctes=[_CUBE_A, _CUBE_S],
)
def _(t: Retail):
    return cubes.channel_metrics(cubes.cube_spend(t.spend, t.campaigns), cubes.cube_attribution(_days(t)))


@query(
    "category_metrics",
    f"""SELECT category, {_D("sum(revenue_cr)")} AS revenue_cr,
               {_div("sum(revenue_cr)", "sum(sum(revenue_cr)) OVER ()", 2, 100)} AS share_pct,
               {_div("sum(revenue_cr - cost_cr)", "sum(revenue_cr)", 2, 100)} AS margin_pct,
               {_div("sum(returns)", "sum(units)", 2, 100)} AS return_rate_pct
        FROM cube_c GROUP BY category""",
    views="item ord prod",
    ctes=[_CUBE_C],
)
def _(t: Retail):
    return cubes.category_metrics(
        cubes.cube_category(t.order_items, t.orders, t.products, t.returns, EXCLUDED, "line_value")
    )


@query(
    "lowest_margins",
    f"""SELECT category, profit_margin_pct FROM ({_margin_sql("category")}) ORDER BY profit_margin_pct, category LIMIT 2""",
    views="item prod",
)
def _(t: Retail):
    return cubes.lowest(
        kpi.margin_by(t.order_items, t.products, revenue="line_value"), "profit_margin_pct", 2, "category"
    ).select("category", "profit_margin_pct")



_CUBE_M = (
    "cube_m",
    f"""SELECT year(order_date)::INTEGER AS year, month(order_date)::INTEGER AS month, sales_channel, count(*) AS orders,
               {_cr("sum(net_amount)")} AS revenue_cr
        FROM ord WHERE order_status <> 'P' GROUP BY ALL""",
)
_YEAR, _CHANNEL = 1996, "1-URGENT"


def _headline_sql(where: str, spend: str, sliced: bool) -> str:
    roas = "CAST(NULL AS DOUBLE)" if sliced else _div("sum(revenue_cr)", spend, 1)
    return f"""SELECT {_D("sum(revenue_cr)")} AS revenue_cr, {_B("sum(orders)")} AS orders, {_D(spend)} AS spend_cr,
                      {roas} AS blended_roas
               FROM cube_m WHERE {where}"""


def _headline(t: Retail, year=None, sales_channel=None) -> DataFrame:
    first = t.orders.where(~F.col("order_status").isin(*EXCLUDED)).agg(F.min(F.year("order_date"))).first()[0]
    return cubes.headline_metrics(
        cubes.cube_monthly(t.orders, EXCLUDED), cubes.cube_spend(t.spend, t.campaigns), first, year, sales_channel
    )


@query(
    "headline_metrics",
    _headline_sql("true", "(SELECT sum(spend_cr) FROM cube_s)", False),
    views="ord spend camp",
    ctes=[_CUBE_M, _CUBE_S],
)
def _(t: Retail):
    return _headline(t)


@query(
    "headline_metrics_sliced",
    _headline_sql(f"year = {_YEAR} AND sales_channel = '{_CHANNEL}'", f"(SELECT sum(spend_cr) FROM cube_s WHERE year = {_YEAR})", True),
    views="ord spend camp",
    ctes=[_CUBE_M, _CUBE_S],
)
def _(t: Retail):
    return _headline(t, _YEAR, _CHANNEL)


@query(
    "category_metrics_sliced",
    f"""SELECT category, {_D("sum(revenue_cr)")} AS revenue_cr,
               {_div("sum(revenue_cr)", "sum(sum(revenue_cr)) OVER ()", 2, 100)} AS share_pct,
               {_div("sum(revenue_cr - cost_cr)", "sum(revenue_cr)", 2, 100)} AS margin_pct,
               {_div("sum(returns)", "sum(units)", 2, 100)} AS return_rate_pct
        FROM cube_c WHERE year = {_YEAR} AND sales_channel = '{_CHANNEL}' GROUP BY category""",
    views="item ord prod",
    ctes=[_CUBE_C],
)
def _(t: Retail):
    cube = cubes.cube_category(t.order_items, t.orders, t.products, t.returns, EXCLUDED, "line_value")
    return cubes.category_metrics(cube, _YEAR, _CHANNEL)


@query(
    "highest_margins",
    f"""SELECT category, profit_margin_pct FROM ({_margin_sql("category")}) ORDER BY profit_margin_pct DESC, category LIMIT 2""",
    views="item prod",
)
def _(t: Retail):
    return cubes.highest(
        kpi.margin_by(t.order_items, t.products, revenue="line_value"), "profit_margin_pct", 2, "category"
    ).select("category", "profit_margin_pct")


# ------------------------------------------------------------- order and rows


def _ordered(name: str, result: str, keys: list[str]) -> None:
    """A query whose rows carry their place in the published order, against the same order in SQL."""
    QUERIES[name] = lambda spark, sf_dir: with_position(QUERIES[result](spark, sf_dir), keys)
    by = ", ".join(f"{k[1:]} DESC NULLS LAST" if k.startswith("-") else f"{k} NULLS FIRST" for k in keys)
    ORACLES[name] = f"SELECT *, row_number() OVER (ORDER BY {by}) AS position FROM ({ORACLES[result]})"


_ordered("ordered_budget_variance", "budget_variance", ORDER_BY["budget_variance"])
_ordered("ordered_top_products", "top_k_per_group", ORDER_BY["top_products"])
_ordered("ordered_running_total", "running_total", ORDER_BY["running_total"])
_ordered("ordered_attribution", "attribute", ORDER_BY["attribution"])
_ordered("ordered_roas", "roas_first", ORDER_BY["roas_first"])


@query(
    "running_order_revenue",
    f"""SELECT order_id, sales_channel, {_S("order_date")} AS order_date,
               {_D("sum(net_amount) OVER (PARTITION BY sales_channel ORDER BY order_date, order_id)")} AS running_total
        FROM ord WHERE order_status <> 'P'""",
    views="ord",
)
def _(t: Retail):
    orders = t.orders.where(~F.col("order_status").isin(*EXCLUDED)).select("order_id", "sales_channel", "order_date", "net_amount")
    return trends.running_total_rows(orders, ["sales_channel"], ["order_date", "order_id"], "net_amount").drop("net_amount")


@query(
    "running_line_revenue",
    f"""SELECT l_orderkey AS order_id, l_linenumber AS line, {_D("sum(CAST(l_extendedprice AS DECIMAL(12,2))) OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING)")} AS running_total
        FROM lineitem""",
)
def _(t: Retail):
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    return trends.running_total_rows(lines, [], ["order_id", "line", "price"], "price").drop("price")


@query(
    "units_by_product",
    f"""SELECT product_id, sum(quantity)::BIGINT AS units,
               {_I("rank() OVER (ORDER BY sum(quantity) DESC)")} AS units_rank
        FROM item JOIN prod USING (product_id) GROUP BY product_id""",
    views="item prod",
)
def _(t: Retail):
    return kpi.units_and_asp(t.order_items, t.products, "product_id", "list_value", "line_value", wide=True).select("product_id", "units", "units_rank")


# ------------------------------------------------------------ refreshed cubes


def _refreshed(t: Retail, name: str, facts: DataFrame, date_col: str, summed) -> DataFrame:
    """Sums written for all months but the last three, which are refreshed one after another, as when months arrive."""
    folder = new_folder(t.spark, name)
    last = facts.agg(F.max(date_col).cast("date")).first()[0]
    if last is None:
        state.refresh(folder, facts, date_col, summed)
        return state.state(t.spark, folder)
    months = [last.replace(day=1)]
    while len(months) < 3:
        months.insert(0, (months[0] - timedelta(days=1)).replace(day=1))
    state.refresh(folder, facts.where((F.col(date_col) < F.lit(months[0])) | F.col(date_col).isNull()), date_col, summed)
    for m in months:
        state.refresh(folder, facts, date_col, summed, m, m)
    return state.state(t.spark, folder)


def _order_state(t: Retail) -> DataFrame:
    return _refreshed(t, "orders", t.orders, "order_date", state.order_sums)


def _spend_state(t: Retail) -> DataFrame:
    return _refreshed(t, "spend", t.spend, "date", state.spend_sums)


_REFRESHED: dict[str, Callable[[Retail], DataFrame]] = {
    "cube_monthly": lambda t: cubes.cube_monthly(_order_state(t), EXCLUDED),
    "cube_slices": lambda t: cubes.cube_slices(_order_state(t), _spend_state(t), EXCLUDED),
    "cube_spend": lambda t: cubes.cube_spend(_spend_state(t), t.campaigns),
    "cube_category": lambda t: cubes.category_cube(
        _refreshed(t, "sold", t.orders, "order_date", lambda o: state.sold_sums(t.order_items, o, t.returns, EXCLUDED, "line_value")), t.products
    ),
    "revenue_by": lambda t: kpi.revenue_by(_order_state(t), excluded=EXCLUDED),
    "mom_growth": lambda t: trends.mom_growth(_order_state(t), excluded=EXCLUDED),
}
for _name, _cube in _REFRESHED.items():
    QUERIES[f"refreshed_{_name}"] = lambda spark, sf_dir, cube=_cube: _plain(cube(Retail(spark, sf_dir)))
    ORACLES[f"refreshed_{_name}"] = ORACLES[_name]
