"""Shared storage for intermediate results: the checkpoint folder and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see.

    ``spark.checkpoint.dir`` if it names one, else the folder the context
    already has; a scratch folder of this machine only with a local master.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    scratch = tempfile.mkdtemp(prefix="tessera-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Every later reader sees the same rows and the planner sees the table's
    size, so that it broadcasts it only below the session's threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; without keys both sides have one row."""
    if not keys:
        return left.crossJoin(right)
    named = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])
