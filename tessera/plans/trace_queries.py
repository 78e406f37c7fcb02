"""Registered trace queries over the driver tables (events rendered as traces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import round4
from tessera.functions.trace import parse_trace_lines
from tessera.operators import features as FT
from tessera.sources import tables as TB
from tessera.storage import materialize

KEYS = ["sample_id"]


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_trace_lines(TB.events_as_trace_lines(TB.table(spark, sf_dir, "events")))


def trace_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rendered line parsed back; continuation lines dropped."""
    p = parsed_events(spark, sf_dir)
    return p.select("sample_id", "line_order", "pid", "clock", "ts_s", "syscall", "ret",
                    "path", "ip", "port", "mmap_len", "is_random", "futex_wait", "target_ext")


def trace_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the full 31-column window table with as-of timeline lookups."""
    ev = TB.table(spark, sf_dir, "events")
    p = parse_trace_lines(TB.events_as_trace_lines(ev))
    return FT.trace_features(p, KEYS, window_s=TB.EVENTS_WINDOW_S, scale=1.0,
                             entropy_tl=TB.events_entropy_timeline(ev),
                             proc_tl=TB.events_proc_timeline(ev),
                             tolerance=TB.EVENTS_TOLERANCE_S)


def trace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-filled per-window counters (no side inputs)."""
    p = parsed_events(spark, sf_dir)
    full = FT.trace_features(p, KEYS, window_s=TB.EVENTS_WINDOW_S, scale=1.0)
    return full.select("sample_id", "window_idx", "bytes_read_per_sec", "bytes_written_per_sec",
                       "rw_volume_ratio", "file_deletion_rate", "file_rename_rate",
                       "target_extension_velocity", "seq_vs_random_disk_ratio",
                       "urandom_bytes_per_sec", "mmap_brk_rate", "mprotect_rate", "futex_rate",
                       "net_packet_rate", "net_byte_volume", "unique_dest_ip_rate",
                       "dns_query_rate", "connection_failure_rate", "child_spawn_rate",
                       "execve_rate", "dir_ops")


def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed lines and distinct windows per run."""
    p = parsed_events(spark, sf_dir)
    anchor = materialize(FT.run_anchor(p, KEYS), "run-anchor")
    return FT.parse_stats(p, anchor, KEYS, TB.EVENTS_WINDOW_S)


def run_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to first encryption and write slope per run."""
    p = parsed_events(spark, sf_dir)
    g = FT.run_globals(p, KEYS, TB.EVENTS_WINDOW_S)
    return g.select("sample_id", round4(F.col("first_ts")).alias("first_ts"), "max_wid",
                    round4(F.col("time_to_first_encryption_s")).alias("time_to_first_encryption_s"),
                    round4(F.col("encryption_slope")).alias("encryption_slope"))


def entropy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-minus-first timeline value per run (duplicate epochs: last wins)."""
    ev = TB.table(spark, sf_dir, "events")
    d = FT.entropy_delta(TB.events_entropy_timeline(ev), KEYS)
    return d.select("sample_id", round4(F.col("file_entropy_delta")).alias("file_entropy_delta"))
