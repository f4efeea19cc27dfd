"""Keeping a shared intermediate result across jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Share = Callable[[DataFrame, str], DataFrame]


def recompute(df: DataFrame, name: str) -> DataFrame:
    """Share nothing: every result computes the intermediate itself."""
    return df


def stored(spark: SparkSession, fallback: str) -> Share:
    """Share through tables in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``, or ``fallback`` where
    that is unset. A written table outlives lost executors, unlike cached blocks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or fallback
    run = f"{base.rstrip('/')}/shoplens-{uuid.uuid4().hex}"

    def share(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{run}/{name}")
        return spark.read.schema(df.schema).parquet(f"{run}/{name}")

    return share


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder; without one, local mode uses a temporary folder."""
    return stored(df.sparkSession, _base(df.sparkSession))(df, name)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder, for a table that is written more than once."""
    return f"{_base(spark)}/shoplens-{uuid.uuid4().hex}/{name}"
