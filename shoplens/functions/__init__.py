from .expr import line_revenue, money, month_gap, padding_chars, ratio
from .rules import recognized

__all__ = ["line_revenue", "money", "month_gap", "padding_chars", "ratio", "recognized"]
