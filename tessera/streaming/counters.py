"""The per-window trace counters as a Structured Streaming query.

Differences from the batch feature table, by design of streaming state:
* windows are anchored at the epoch (``F.window``), not at a run's first
  line, because the first-line anchor needs per-run state before any window
  can be assigned;
* distinct destination IPs use ``approx_count_distinct`` (exact distinct
  counts are not supported in streaming aggregations);
* rows later than the watermark are dropped (the batch table drops none).

The same function runs on a static DataFrame, which is how the tests check
the stream against batch on the same rows.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.trace import in_set


def window_counters(parsed: DataFrame, keys: Sequence[str], window: str = "100 milliseconds",
                    watermark: str | None = "10 seconds",
                    sets: Mapping[str, Sequence[str]] = S.SYSCALL_SETS) -> DataFrame:
    """Epoch-anchored tumbling-window counters (A3-A20, A23, unscaled)."""
    sc, ret = F.col("syscall"), F.col("ret")
    df = parsed.withColumn("event_time", F.timestamp_seconds(F.col("ts_s")))
    if watermark:
        df = df.withWatermark("event_time", watermark)

    def cnt(cond):
        return F.count_if(cond).cast("bigint")

    def tot(cond, col):
        return F.coalesce(F.sum(F.when(cond, col)), F.lit(0)).cast("bigint")

    pos = ret > 0
    return df.groupBy(*keys, F.window("event_time", window).alias("window")).agg(
        F.count(F.lit(1)).alias("lines"),
        tot(in_set(sc, sets["read"]) & pos, ret).alias("bytes_read"),
        tot(in_set(sc, sets["write"]) & pos, ret).alias("bytes_written"),
        cnt(in_set(sc, sets["unlink"])).alias("file_deletions"),
        cnt(in_set(sc, sets["rename"])).alias("file_renames"),
        cnt(in_set(sc, sets["open"]) & F.col("target_ext")).alias("target_extensions"),
        cnt(in_set(sc, sets["lseek"])).alias("lseek_calls"),
        tot(in_set(sc, sets["read"]) & pos & F.col("is_random"), ret).alias("urandom_bytes"),
        tot(in_set(sc, sets["mmap"]), F.col("mmap_len")).alias("mmap_bytes"),
        cnt(in_set(sc, sets["mprotect"])).alias("mprotect_calls"),
        cnt(in_set(sc, sets["futex"]) & F.col("futex_wait")).alias("futex_waits"),
        cnt(in_set(sc, sets["net"]) & pos).alias("net_packets"),
        tot(in_set(sc, sets["net"]) & pos, ret).alias("net_bytes"),
        F.approx_count_distinct(F.when(in_set(sc, sets["connect"]), F.col("ip")))
        .alias("unique_ips_approx"),
        cnt(in_set(sc, sets["connect"]) & (F.col("port") == S.DNS_PORT)).alias("dns_queries"),
        cnt(in_set(sc, sets["connect"]) & (ret == -1)).alias("conn_failures"),
        cnt(in_set(sc, sets["spawn"])).alias("child_processes"),
        cnt(in_set(sc, sets["exec"])).alias("execve_calls"),
        cnt(in_set(sc, sets["dir"])).alias("dir_ops"),
    )


def stream_trace_dir(spark, path: str, keys_from_path: bool = True,
                     max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming text source over a directory of trace files (new files = new data)."""
    from tessera.functions.trace import parse_trace_lines
    raw = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
           .load(path))
    if keys_from_path:
        raw = raw.withColumn("sample", F.regexp_extract(F.col("_metadata.file_path"),
                                                        r"([^/]+)/[^/]+$", 1))
    return parse_trace_lines(raw.withColumnRenamed("value", "line"))
