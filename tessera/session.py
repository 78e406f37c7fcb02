"""Spark session defaults used by the library, tests and bench.

Cluster deployments bring their own session; ``configure`` only fills in the
settings the operators rely on (UTC, AQE, codegen width) and never overrides a
value the cluster already set, most importantly ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tessera.storage import shared_folder

# Settings every operator assumes. Wide summaries (31 columns x 4 stats) lose
# whole-stage codegen at the default maxFields of 100, hence 500.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.maxFields": "500",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tessera") -> SparkSession:
    """Local session for tests and the bench (UI off, Arrow on)."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("TESSERA_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        # delete checkpoint files once their DataFrames are garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill in REQUIRED_CONF where the session hasn't set a value of its own."""
    own = spark.conf.getAll
    for k, v in REQUIRED_CONF.items():
        if k not in own and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make checkpoints go to the shared folder (see ``storage.shared_folder``); a folder already set stays."""
    folder = shared_folder(spark)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
