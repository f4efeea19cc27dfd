"""Reading the source tables and writing results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans.order import in_order
from .schemas import SCHEMAS


def load_csv(spark: SparkSession, directory: str, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables as DataFrames over ``<directory>/<table>.csv``.

    The header row is checked against the declared columns, empty fields are
    NULL, and a malformed row fails the job.
    """
    return {
        t: spark.read.schema(SCHEMAS[t]).csv(
            f"{directory}/{t}.csv", header=True, enforceSchema=False, mode="FAILFAST", dateFormat="yyyy-MM-dd"
        )
        for t in (tables or SCHEMAS)
    }


def load_parquet(spark: SparkSession, directory: str, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables as DataFrames over ``<directory>/<table>`` Parquet datasets, declared columns only."""
    out = {}
    for t in tables or SCHEMAS:
        df = spark.read.schema(SCHEMAS[t]).parquet(f"{directory}/{t}")
        out[t] = df.select(*[c.split()[0] for c in SCHEMAS[t].split(", ")])  # a partition column reads last
    return out


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Expose each table to ``spark.sql`` under its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_parquet(
    tables: Mapping[str, DataFrame],
    directory: str,
    mode: str = "errorifexists",
    partition_by: Mapping[str, str] | None = None,
) -> None:
    """Store each table as a Parquet dataset readable by :func:`load_parquet`.

    ``partition_by`` names a date column per table to partition on, so that date
    filters skip files. The rebalance hint merges small partitions and splits
    large ones before the write, whatever the spread of dates.
    """
    for name, df in tables.items():
        key = (partition_by or {}).get(name)
        if key:
            df.hint("rebalance", key).write.mode(mode).partitionBy(key).parquet(f"{directory}/{name}")
        else:
            df.write.mode(mode).parquet(f"{directory}/{name}")


def write_extract(
    frames: Mapping[str, DataFrame],
    directory: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    order: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Write result frames (such as the dashboard cubes) for a BI tool, as ``parquet``, ``json`` or ``csv``.

    ``order`` names sort keys per result, descending ones with a leading ``-``. Such a result is sorted in ranges:
    its part files, read by name, are in order.
    """
    for name, df in frames.items():
        options = {"header": "true"} if fmt == "csv" else {}
        keys = (order or {}).get(name)
        (in_order(df, keys) if keys else df).write.mode(mode).format(fmt).options(**options).save(f"{directory}/{name}")
