"""Business rules applied before measuring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses whose orders earn no revenue, and labels no paid touch can match.
CANCELLED = ("Cancelled",)
UNPAID_LABELS = ("Organic", "Direct")


def recognized(orders: DataFrame, excluded: Sequence[str] | None = CANCELLED, status: str = "order_status") -> DataFrame:
    """Orders whose revenue counts: recognised at placement, cancelled ones left out.

    ``excluded=None`` keeps every order. A NULL status never satisfies the rule.
    """
    if not excluded:
        return orders
    return orders.where(~F.col(status).isin(*excluded))
