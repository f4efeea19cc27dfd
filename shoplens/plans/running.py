"""Running sums and ranks over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import count_rows
from .stored import keep


def running_sum(
    df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], measure: str, out: str, before: bool = False
) -> DataFrame:
    """Add ``out``, the sum of ``measure`` up to each row of its group, or over the rows ``before`` it only.

    Equal to a window with a ROWS frame; rows with equal ``order`` follow the hash of all their columns, so that only identical rows,
    which are interchangeable, are left unordered. NULL measures are skipped, and a group's sum is NULL until a measure is not.

    The rows are sorted into ranges of (group, order), which are written to the shared folder: all later steps must see the
    same ranges. A range's total moves to the following ranges of its group as one row that leads the range's
    own rows. So a window holds one range of one group, and the window over totals one row a range.
    The table is written when this is called.
    """
    tie = F.xxhash64(*[c for c in df.columns])
    rows = df.withColumn("_tie", tie).repartitionByRange(*partition, *order, "_tie")
    rows = keep(rows.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*partition, "_range").agg(F.sum(measure).alias("_total"))
    earlier = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition, "_range", F.sum("_total").over(earlier).alias("_value"), F.lit(False).alias("_own"))
    both = rows.withColumn("_value", F.col(measure)).withColumn("_own", F.lit(True)).unionByName(offsets, allowMissingColumns=True)
    upto = Window.partitionBy(*partition, "_range").orderBy("_own", *order, "_tie")
    frame = upto.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    kept = [c for c in df.columns if c != out]
    return both.withColumn("_sum", F.sum("_value").over(frame)).where("_own").select(*kept, F.col("_sum").alias(out))


def running_rank(
    df: DataFrame, by: str, out: str, partition: Sequence[str] = (), descending: bool = True, dense: bool = False
) -> DataFrame:
    """Add ``out``, RANK (or DENSE_RANK) of ``by`` in each group; NULL ranks last.

    Rows are first counted per value, so a value that many rows share is one row of the running sum. The ranks then meet
    the rows in a join with one row a value on its side, which adaptive execution splits where a value is hot.
    """
    on = [*partition, by]
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    values = df.groupBy(*on).agg((F.lit(1).cast("bigint") if dense else count_rows()).alias("_n"))
    values = running_sum(values, partition, [order], "_n", "_above", before=True)
    ranks = values.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(on)], (F.coalesce("_above", F.lit(0)) + 1).cast("int").alias(out))
    same = [df[c].eqNullSafe(ranks[f"_{i}"]) for i, c in enumerate(on)]
    kept = [df[c] for c in df.columns if c != out]
    return df.join(ranks, same).select(*kept, ranks[out])
