from .asof import touch_by_order_day
from .joins import lookup_join
from .ntile import exact_ntile
from .order import in_order, sort_columns, with_position
from .running import running_rank, running_sum
from .stored import keep, new_folder, recompute, stored

__all__ = [
    "exact_ntile", "in_order", "keep", "lookup_join", "new_folder", "recompute", "running_rank", "running_sum", "sort_columns", "stored",
    "touch_by_order_day", "with_position",
]
