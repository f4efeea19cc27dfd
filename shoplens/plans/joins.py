"""Fact-to-lookup equi-join that survives hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join facts to a table holding at most one row per key, by ``inner`` or ``left``.

    One logical plan at every size. Whether the lookup is broadcast is left to the optimizer and to adaptive execution, which
    knows its exact size. If both sides are shuffled, adaptive execution cuts a partition that one hot key
    fills into pieces and reads the few lookup rows for each of them; ``build_session`` turns that on, also
    where it costs a further shuffle. Only the lookup side must not be hot, and it has one row per key.
    """
    return facts.join(lookup, list(on), how)
