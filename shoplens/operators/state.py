"""Monthly sums that stand in for facts, kept as tables that are refreshed month by month.

Sums and counts of months can be added up, so any cube over months is computed from them. The tables here have the columns of the facts they
replace: a date (the first of the month), the dimensions, summed measures, and ``_rows`` and ``_values`` for counts. Operators that only
sum and count (revenue, shifts of the average, growth, running totals, cubes) take them in place of the facts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import count_rows
from ..functions.rules import CANCELLED
from .cubes import line_sums


def _first(c: str):
    return F.to_date(F.trunc(c, "month")).alias(c)


def order_sums(orders: DataFrame, dims: Sequence[str] = ("sales_channel", "order_status"), order_date: str = "order_date", amount: str = "net_amount") -> DataFrame:
    """Orders per month and ``dims``: summed amount, ``_rows`` (orders) and ``_values`` (orders with an amount)."""
    return orders.groupBy(_first(order_date), *dims).agg(
        F.sum(amount).alias(amount), count_rows().alias("_rows"), F.count(amount).alias("_values")
    )


def spend_sums(spend: DataFrame) -> DataFrame:
    """Spend, impressions and clicks per month and campaign."""
    return spend.groupBy(_first("date"), "campaign_id").agg(*[F.sum(m).alias(m) for m in ("spend", "impressions", "clicks")])


def sold_sums(items: DataFrame, orders: DataFrame, returns: DataFrame, excluded: Sequence[str] | None = CANCELLED, revenue=None) -> DataFrame:
    """Revenue, units and returns per order month, sales channel and product, as :func:`cubes.cube_category` counts them."""
    return line_sums(items, orders, returns, _first("order_date"), excluded, revenue)


def _month_after(m: date) -> date:
    return date(m.year + m.month // 12, m.month % 12 + 1, 1)


def refresh(
    folder: str, dated: DataFrame, date_col: str, summed: Callable[[DataFrame], DataFrame], first: date | None = None, last: date | None = None
) -> None:
    """Compute the sums of the months from ``first`` to ``last`` (any day of them) and replace these months in ``folder``.

    ``summed`` turns the facts of those months, ``dated`` restricted to them, into sums dated ``date_col``. The date filter
    reaches the scan, and only the partitions of these months are written (dynamic overwrite); the others are not
    read or touched. A month that has no facts any more is replaced as well. Without both bounds all months are computed. Rows
    without a date go with the whole, never with a month.
    """
    if (first is None) != (last is None):
        raise ValueError("give both months or none")
    if first is None:
        rows = summed(dated).withColumn("_empty", F.lit(False))
        rows = rows.withColumn("month", F.coalesce(F.date_format(date_col, "yyyy-MM"), F.lit("none")))
        rows.write.mode("overwrite").partitionBy("month").parquet(folder)
        return
    start, end = first.replace(day=1), _month_after(last)
    rows = summed(dated.where((F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end)))).withColumn("_empty", F.lit(False))
    months = [start]
    while _month_after(months[-1]) < end:
        months.append(_month_after(months[-1]))
    # One empty row a month, so that a month without facts is overwritten too.
    marks = dated.sparkSession.createDataFrame([(m, True) for m in months], f"`{date_col}` date, _empty boolean")
    rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("month", F.date_format(date_col, "yyyy-MM"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(folder)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The sums kept in ``folder``."""
    return spark.read.parquet(folder).where("not _empty").drop("_empty", "month")
