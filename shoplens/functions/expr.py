"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Fixed-point money, wide enough for any sum; decimal sums do not depend on row order."""
    return as_col(c).cast("decimal(38,2)")


def ratio(num: Column | str, den: Column | str, digits: int | None = None, scale: int = 1) -> Column:
    """``num * scale / den`` as double, NULL for a zero denominator, optionally rounded half up."""
    q = F.try_divide(as_col(num).cast("double") * F.lit(float(scale)), as_col(den).cast("double"))
    return q if digits is None else F.round(q, digits)


def line_revenue(unit_price="unit_price", quantity="quantity", discount="discount_amount") -> Column:
    """What was charged for an order line: transaction price, not catalogue price."""
    return as_col(unit_price) * as_col(quantity) - as_col(discount)


def month_gap(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from start to end (31 Jan to 1 Feb is 1)."""
    s, e = as_col(start), as_col(end)
    return (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)


def padding_chars(c: Column | str) -> Column:
    """Number of leading and trailing blanks."""
    return F.length(as_col(c)) - F.length(F.trim(as_col(c)))


def count_rows() -> Column:
    return F.count(F.lit(1))


def rows_of(df: DataFrame) -> Column:
    """Number of rows; of monthly sums (see :mod:`operators.state`) the number of facts that they stand for."""
    return F.sum("_rows") if "_rows" in df.columns else count_rows()


def values_of(df: DataFrame, c: str) -> Column:
    """Number of rows with a value, or of facts with one where ``df`` holds monthly sums; NULL sums count none."""
    return F.sum("_values") if "_values" in df.columns else F.count(c)
