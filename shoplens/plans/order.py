"""Results in a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sum


def sort_columns(keys: Sequence[str]) -> list[Column]:
    """Sort expressions of column names; a leading ``-`` sorts descending. NULL is the smallest value."""
    return [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_first(k) for k in keys]


def in_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` in ranges of the keys, sorted within each: written part files follow one another in order. No task sorts the whole table."""
    columns = sort_columns(keys)
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def with_position(df: DataFrame, keys: Sequence[str], out: str = "position") -> DataFrame:
    """Add each row's place, from 1, in the order of ``keys``; a distributed ROW_NUMBER. Rows with equal keys are ordered by a hash."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), [], sort_columns(keys), "_one", out).drop("_one")
