"""The windowed trace feature table.

Plan shape (``keys`` = run key, e.g. ``[sample, run]``):

1. per-run globals: one partial+final aggregate over the parsed lines
   (first ts in line order, max ts, first encryption, write slope);
   joined back to the lines (J4) from a written table, which the planner
   broadcasts only below the session's size threshold;
2. counters: partial aggregate on (run, wid, syscall), then (run, wid);
   syscall counts per window stay a bounded list for the entropy (A21);
3. gap fill (J3) by exploding 0..max_wid per run and left-joining;
4. rolling std (W1) without a run-wide sort: each dense row is copied to the
   <=5 frames that contain it and grouped by (run, frame end), so a hot run
   spreads over many tasks;
5. optional as-of lookups into entropy / memory timelines (J1, J2).

Negative window ids (lines before the first line in file order) are
aggregated like the reference does but never emitted.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.scalar import round4, safe_ratio
from tessera.functions.trace import in_set
from tessera.operators.joins import asof_first_match_many, dedupe_timeline
from tessera.storage import materialize


def _scale_for(window_s: float, scale: float | None) -> float:
    return (1.0 / window_s) if scale is None else scale


def _scaled(c: Column, scale: float) -> Column:
    if float(scale).is_integer():
        return (c * F.lit(int(scale))).cast("bigint")
    return c.cast("double") * F.lit(float(scale))


def run_globals(parsed: DataFrame, keys: Sequence[str], window_s: float = S.WINDOW_SECONDS,
                sets: Mapping[str, Sequence[str]] = S.SYSCALL_SETS,
                max_windows: int | None = None) -> DataFrame:
    """Per-run scalars: first_ts (T3), max_wid, first encryption ts (T8), slope."""
    anchor = materialize(run_anchor(parsed, keys), "run-anchor")
    return run_scalars(run_partials(with_window_ids(parsed, anchor, keys, window_s), keys, sets), keys, max_windows)


def run_anchor(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass 1: the first line's timestamp per run in file order.

    Only ``ts_s`` and ``line_order`` are read, so Catalyst prunes every other
    parser expression from this scan: one regex per line.
    """
    return parsed.groupBy(*keys).agg(F.min_by("ts_s", "line_order").alias("first_ts"))


def _guard(max_wid: Column, max_windows: int | None) -> Column:
    """T21, opt-in: a run with more windows than ``max_windows`` ends the job instead of filling them."""
    if max_windows is None:
        return max_wid.cast("bigint")
    return F.when(max_wid > F.lit(max_windows),
                  F.raise_error(F.concat(F.lit("gap fill would emit more than "),
                                         F.lit(str(max_windows)),
                                         F.lit(" windows for one run (mixed clocks?)")))
                  ).otherwise(max_wid).cast("bigint")


def with_window_ids(parsed: DataFrame, anchor: DataFrame, keys: Sequence[str], window_s: float) -> DataFrame:
    """Tumbling window id anchored at the run's first line (truncation, T4)."""
    return (parsed.join(anchor, list(keys))
            .withColumn("wid", ((F.col("ts_s") - F.col("first_ts")) / F.lit(window_s)).cast("bigint")))


def window_partials(with_wid: DataFrame, keys: Sequence[str],
                    sets: Mapping[str, Sequence[str]] = S.SYSCALL_SETS) -> DataFrame:
    """Level 0: partial aggregates per (run, wid, syscall, ip), negative windows included.

    Besides the window counters it carries the pieces of the run-level
    scalars, so no second pass over the lines is needed: OLS sums of the
    positive writes (x = ts - first_ts) and the earliest encryption event.
    The connect IP is part of the key, so distinct IPs become a plain count
    at the next level; IP is null on every other line.
    """
    keys = list(keys)
    ret = F.col("ret")
    return with_wid.groupBy(*keys, "wid", "syscall", "ip").agg(
        F.max("first_ts").alias("first_ts"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(ret > 0, ret)).alias("pos_sum"),
        F.count_if(ret > 0).alias("pos_n"),
        F.sum(F.when((ret > 0) & F.col("is_random"), ret)).alias("rnd_sum"),
        F.count_if(F.col("target_ext")).alias("ext_n"),
        F.sum("mmap_len").alias("mmap_sum"),
        F.count_if(F.col("futex_wait")).alias("futex_n"),
        F.count_if(F.col("port") == S.DNS_PORT).alias("dns_n"),
        F.count_if(ret == -1).alias("fail_n"),
        *_scalar_parts(sets),
    )


def run_partials(with_wid: DataFrame, keys: Sequence[str], sets: Mapping[str, Sequence[str]] = S.SYSCALL_SETS) -> DataFrame:
    """The pieces of the run-level scalars alone, one row for each run."""
    return with_wid.groupBy(*keys).agg(F.max("first_ts").alias("first_ts"), F.max("wid").alias("wid"), *_scalar_parts(sets))


def _scalar_parts(sets: Mapping[str, Sequence[str]]) -> list[Column]:
    """OLS sums of the positive writes and the earliest encryption event."""
    sc, ret, order = F.col("syscall"), F.col("ret"), F.col("line_order")
    write_evt = in_set(sc, sets["write"]) & (ret > 0)
    enc_evt = (write_evt & F.col("target_ext")) | (in_set(sc, sets["open"]) & F.col("target_ext"))
    x = F.col("ts_s") - F.col("first_ts")
    y = ret.cast("double")
    return [
        F.count_if(write_evt).alias("w_n"),
        F.sum(F.when(write_evt, x)).alias("w_sx"),
        F.sum(F.when(write_evt, y)).alias("w_sy"),
        F.sum(F.when(write_evt, x * y)).alias("w_sxy"),
        F.sum(F.when(write_evt, x * x)).alias("w_sxx"),
        F.min(F.when(write_evt, x)).alias("w_minx"),
        F.max(F.when(write_evt, x)).alias("w_maxx"),
        F.min(F.when(enc_evt, order)).alias("e_ord"),
        F.min_by(F.col("ts_s"), F.when(enc_evt, order)).alias("e_ts"),
    ]


def run_scalars(lvl0: DataFrame, keys: Sequence[str],
                max_windows: int | None = None) -> DataFrame:
    """Per run from level 0: max window id (guarded, T21), time to first
    encryption (T8), OLS slope of write bytes on time (A30)."""
    g = lvl0.groupBy(*keys).agg(
        F.max("first_ts").alias("first_ts"), F.max("wid").alias("max_wid"),
        F.sum("w_n").alias("n"), F.sum("w_sx").alias("sx"), F.sum("w_sy").alias("sy"),
        F.sum("w_sxy").alias("sxy"), F.sum("w_sxx").alias("sxx"),
        F.min("w_minx").alias("minx"), F.max("w_maxx").alias("maxx"),
        F.min_by("e_ts", "e_ord").alias("first_enc_ts"))
    n = F.col("n").cast("double")
    den = n * F.col("sxx") - F.col("sx") * F.col("sx")
    # writes at one time have no slope; their sums would cancel to rounding noise
    slope = F.when((F.col("n") >= 2) & (F.col("minx") < F.col("maxx")) & (den != 0),
                   (n * F.col("sxy") - F.col("sx") * F.col("sy")) / den).otherwise(F.lit(0.0))
    fe = F.col("first_enc_ts")
    return g.select(
        *keys, "first_ts", _guard(F.col("max_wid"), max_windows).alias("max_wid"),
        F.when(fe.isNull() | (fe == 0.0), F.lit(0.0)).otherwise(fe - F.col("first_ts"))
        .alias("time_to_first_encryption_s"),
        slope.alias("encryption_slope"))


def window_ids(parsed: DataFrame, glob: DataFrame, keys: Sequence[str],
               window_s: float = S.WINDOW_SECONDS) -> DataFrame:
    """W2 from a table of run scalars (first_ts, max_wid)."""
    return with_window_ids(parsed, glob.select(*keys, "first_ts", "max_wid"), keys, window_s)


def window_counters(with_wid: DataFrame, keys: Sequence[str],
                    sets: Mapping[str, Sequence[str]] = S.SYSCALL_SETS,
                    lvl0: DataFrame | None = None) -> DataFrame:
    """A3-A21, A23 unscaled, one row per non-empty window (wid >= 0).

    Pass ``lvl0`` (from ``window_partials``) to reuse an existing level-0
    aggregate instead of grouping ``with_wid`` again.
    """
    keys = list(keys)
    ret = F.col("ret")
    if lvl0 is not None:
        return counters_from_level0(lvl0.filter(F.col("wid") >= 0), keys, sets)
    # level 0 adds the connect IP to the key, so distinct IPs become a plain
    # count at level 1 (no distinct-aggregate rewrite); every level is a
    # map-side-combined hash aggregate and IP is null on all other lines
    lvl0 = (with_wid.filter(F.col("wid") >= 0)
            .groupBy(*keys, "wid", "syscall", "ip").agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(F.when(ret > 0, ret)).alias("pos_sum"),
                F.count_if(ret > 0).alias("pos_n"),
                F.sum(F.when((ret > 0) & F.col("is_random"), ret)).alias("rnd_sum"),
                F.count_if(F.col("target_ext")).alias("ext_n"),
                F.sum("mmap_len").alias("mmap_sum"),
                F.count_if(F.col("futex_wait")).alias("futex_n"),
                F.count_if(F.col("port") == S.DNS_PORT).alias("dns_n"),
                F.count_if(ret == -1).alias("fail_n"),
            ))
    return counters_from_level0(lvl0, keys, sets)


def counters_from_level0(lvl0: DataFrame, keys: Sequence[str],
                        sets: Mapping[str, Sequence[str]]) -> DataFrame:
    summed = ["n", "pos_sum", "pos_n", "rnd_sum", "ext_n", "mmap_sum", "futex_n", "dns_n", "fail_n"]
    lvl1 = lvl0.groupBy(*keys, "wid", "syscall").agg(
        *[F.sum(c).alias(c) for c in summed], F.count("ip").alias("ip_n"))
    sc = F.col("syscall")

    def total(cond: Column, col: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("bigint")

    lvl2 = lvl1.groupBy(*keys, "wid").agg(
        total(in_set(sc, sets["read"]), "pos_sum").alias("bytes_read"),
        total(in_set(sc, sets["write"]), "pos_sum").alias("bytes_written"),
        total(in_set(sc, sets["unlink"]), "n").alias("file_deletions"),
        total(in_set(sc, sets["rename"]), "n").alias("file_renames"),
        total(in_set(sc, sets["open"]), "ext_n").alias("target_extensions"),
        total(in_set(sc, sets["lseek"]), "n").alias("lseek_calls"),
        total(in_set(sc, sets["read"]), "rnd_sum").alias("urandom_bytes"),
        total(in_set(sc, sets["mmap"]), "mmap_sum").alias("mmap_bytes"),
        total(in_set(sc, sets["mprotect"]), "n").alias("mprotect_calls"),
        total(in_set(sc, sets["futex"]), "futex_n").alias("futex_waits"),
        total(in_set(sc, sets["net"]), "pos_n").alias("net_packets"),
        total(in_set(sc, sets["net"]), "pos_sum").alias("net_bytes"),
        total(in_set(sc, sets["connect"]), "ip_n").alias("unique_ips"),
        total(in_set(sc, sets["connect"]), "dns_n").alias("dns_queries"),
        total(in_set(sc, sets["connect"]), "fail_n").alias("conn_failures"),
        total(in_set(sc, sets["spawn"]), "n").alias("child_processes"),
        total(in_set(sc, sets["exec"]), "n").alias("execve_calls"),
        total(in_set(sc, sets["dir"]), "n").alias("dir_ops"),
        F.sum("n").alias("_sc_n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_sc_nlogn"),
    )
    # H = log2(N) - sum(n log2 n) / N: two plain sums, no list of counts
    total_n = F.col("_sc_n").cast("double")
    return lvl2.withColumn("syscall_entropy", F.greatest(F.lit(0.0), F.log2(total_n) - F.col("_sc_nlogn") / total_n)).drop("_sc_n", "_sc_nlogn")


COUNTERS = ("bytes_read", "bytes_written", "file_deletions", "file_renames", "target_extensions",
            "lseek_calls", "urandom_bytes", "mmap_bytes", "mprotect_calls", "futex_waits",
            "net_packets", "net_bytes", "unique_ips", "dns_queries", "conn_failures",
            "child_processes", "execve_calls", "dir_ops")


GAP_FILL_CHUNK = 1 << 16  # window ids generated per task slice


def dense_window_ids(glob: DataFrame, keys: Sequence[str],
                     chunk: int = GAP_FILL_CHUNK) -> DataFrame:
    """0..max_wid per run, generated in slices of ``chunk`` ids.

    The slice starts are exploded first and hash-partitioned, so the ids of
    one very long run (a third of all data) are produced by many tasks
    rather than by the single task that holds the run's row.
    """
    keys = list(keys)
    starts = glob.select(*keys, "first_ts", "max_wid",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("max_wid"),
                                              F.lit(chunk).cast("bigint"))).alias("_c"))
    starts = starts.repartition(*[F.col(k) for k in keys], F.col("_c"))
    end = F.least(F.col("_c") + F.lit(chunk - 1), F.col("max_wid"))
    return starts.select(*keys, "first_ts", "max_wid",
                         F.explode(F.sequence(F.col("_c"), end)).alias("wid"))


def gap_fill(counters: DataFrame, glob: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per window id 0..max_wid per run, zeros for empty windows."""
    keys = list(keys)
    dense = dense_window_ids(glob, keys)
    filled = dense.join(counters, keys + ["wid"], "left")
    fills = {c: 0 for c in COUNTERS}
    fills["syscall_entropy"] = 0.0
    return filled.fillna(fills)


STD_SLICE = 1 << 12  # window ids of a slice of the rolling std


def rolling_pop_std(dense: DataFrame, keys: Sequence[str], value: str, frame: int = 5,
                    out: str = "rolling_std", width: int = STD_SLICE) -> DataFrame:
    """Population std over the last <= ``frame`` dense rows, including gaps.

    Runs are cut into slices of ``width`` window ids, so that no task holds a
    whole run. Only a slice's last ``frame - 1`` rows are copied, to the next
    slice, as the halo in front of its first rows; a frame by window id
    inside the slice does the rest. ``width`` is at least ``frame - 1``.
    """
    keys = list(keys)
    own, back = F.floor(F.col("wid") / width).cast("bigint"), frame - 1
    here = F.struct(own.alias("_slice"), F.lit(True).alias("_own"))
    ahead = F.struct((own + 1).alias("_slice"), F.lit(False).alias("_own"))
    at = F.when(F.col("wid") % width >= width - back, F.array(here, ahead)).otherwise(F.array(here))
    rows = dense.select(*keys, F.col("wid").cast("bigint").alias("wid"), F.col(value).cast("double").alias("_v"), F.explode(at).alias("_at"))
    rows = rows.select(*keys, "wid", "_v", "_at.*")
    last = Window.partitionBy(*keys, "_slice").orderBy("wid").rangeBetween(-back, 0)
    return rows.withColumn(out, F.stddev_pop("_v").over(last)).filter("_own").select(*keys, "wid", out)


def entropy_delta(entropy_tl: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last minus first mean entropy by epoch; needs >= 2 distinct epochs."""
    d = dedupe_timeline(entropy_tl, keys, "epoch", "row_order", ["mean_entropy"], "last")
    return (d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.max_by("mean_entropy", "epoch") - F.min_by("mean_entropy", "epoch")).alias("_d"))
        .select(*keys, F.when(F.col("_n") >= 2, F.col("_d")).otherwise(F.lit(0.0))
                .alias("file_entropy_delta")))


def timeline_lookups(dense: DataFrame, keys: Sequence[str], window_s: float, tolerance: float,
                     entropy_tl: DataFrame | None, proc_tl: DataFrame | None) -> DataFrame:
    """J1 (entropy, first by epoch) and J2 (memory, first by file position)."""
    keys = list(keys)
    out = dense
    probe = dense.select(*keys, "wid",
                         (F.col("first_ts") + F.col("wid") * F.lit(window_s)).alias("w_epoch"))
    lookups, defaults = [], {}
    if entropy_tl is not None:
        ent = dedupe_timeline(entropy_tl, keys, "epoch", "row_order", ["mean_entropy"], "last")
        lookups.append((ent, "epoch", "epoch", "mean_entropy"))
    else:
        defaults["mean_entropy"] = F.lit(None).cast("double")
    if proc_tl is not None:
        proc = dedupe_timeline(proc_tl, keys, "epoch", "row_order", ["vmrss_kb"], "first")
        lookups.append((proc, "epoch", "row_order", "vmrss_kb"))
    else:
        defaults["vmrss_kb"] = F.lit(None).cast("bigint")
    if lookups:
        m = asof_first_match_many(probe, lookups, keys, ["wid"], "w_epoch", tolerance)
        out = out.join(m, keys + ["wid"], "left")
    for c, v in defaults.items():
        out = out.withColumn(c, v)
    return out


def trace_features(parsed: DataFrame, keys: Sequence[str], window_s: float = S.WINDOW_SECONDS,
                   scale: float | None = None, entropy_tl: DataFrame | None = None,
                   proc_tl: DataFrame | None = None, tolerance: float = S.ASOF_TOLERANCE_S,
                   sets: Mapping[str, Sequence[str]] = S.SYSCALL_SETS,
                   max_windows: int | None = None,
                   checkpoint: bool = True) -> DataFrame:
    """The 31-column feature table, one row per dense window per run."""
    keys = list(keys)
    k = _scale_for(window_s, scale)
    parsed = parsed.select(*keys, "line_order", "ts_s", "syscall", "ret", "target_ext",
                           "is_random", "mmap_len", "futex_wait", "ip", "port")
    # pass 1: first line per run (one regex per line after pruning), written, so
    # that the planner knows its size and broadcasts it only below the threshold
    anchor = materialize(run_anchor(parsed, keys), "run-anchor")
    with_wid = with_window_ids(parsed, anchor, keys, window_s)
    # pass 2: one partial aggregate feeds the counters and the run scalars
    lvl0 = window_partials(with_wid, keys, sets)
    if checkpoint:
        # cut the lineage at the compact level-0 aggregate: the text scan and
        # the parser are not replayed by the many branches below (nor after a
        # lost executor), and the downstream plans stay small
        from tessera.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(lvl0.sparkSession)
        lvl0 = lvl0.checkpoint(eager=True)
    glob = run_scalars(lvl0, keys, max_windows)
    counters = window_counters(None, keys, sets, lvl0=lvl0)
    dense = gap_fill(counters, glob.select(*keys, "first_ts", "max_wid"), keys)
    burst = rolling_pop_std(dense, keys, "bytes_written", 5, "io_burstiness_std")
    dense = dense.join(burst, keys + ["wid"])
    dense = timeline_lookups(dense, keys, window_s, tolerance, entropy_tl, proc_tl)
    per_run = glob.select(*keys, "time_to_first_encryption_s", "encryption_slope")
    if entropy_tl is not None:
        per_run = per_run.join(entropy_delta(entropy_tl, keys), keys, "left")
    else:
        per_run = per_run.withColumn("file_entropy_delta", F.lit(0.0))
    dense = dense.join(per_run, keys)

    c = F.col
    zero = F.lit(0).cast("bigint")
    br, bw = _scaled(c("bytes_read"), k), _scaled(c("bytes_written"), k)
    cols = {
        "window_idx": c("wid"),
        "window_start_s": round4(c("wid") * F.lit(window_s)),
        "bytes_read_per_sec": br,
        "bytes_written_per_sec": bw,
        "rw_volume_ratio": round4(safe_ratio(br, bw)),
        "file_deletion_rate": _scaled(c("file_deletions"), k),
        "file_rename_rate": _scaled(c("file_renames"), k),
        "target_extension_velocity": _scaled(c("target_extensions"), k),
        "seq_vs_random_disk_ratio": _scaled(c("lseek_calls"), k),
        "urandom_bytes_per_sec": _scaled(c("urandom_bytes"), k),
        "mmap_brk_rate": c("mmap_bytes"),
        "mprotect_rate": _scaled(c("mprotect_calls"), k),
        "futex_rate": _scaled(c("futex_waits"), k),
        "net_packet_rate": _scaled(c("net_packets"), k),
        "net_byte_volume": c("net_bytes"),
        "unique_dest_ip_rate": c("unique_ips"),
        "dns_query_rate": _scaled(c("dns_queries"), k),
        "connection_failure_rate": _scaled(c("conn_failures"), k),
        "child_spawn_rate": _scaled(c("child_processes"), k),
        "execve_rate": _scaled(c("execve_calls"), k),
        "syscall_sequence_entropy": round4(c("syscall_entropy")),
        "io_burstiness_std": round4(c("io_burstiness_std")),
        "dir_ops": _scaled(c("dir_ops"), k),
        "drop_rate": zero,
        "ransom_note_hits": zero,
        "library_call_rate_openssl": zero,
        "vmrss_kb": F.coalesce(c("vmrss_kb"), zero),
        "mean_file_entropy": round4(F.coalesce(c("mean_entropy"), F.lit(0.0))),
        "time_to_first_encryption_s": round4(c("time_to_first_encryption_s")),
        "encryption_slope": round4(c("encryption_slope")),
        # runs without (enough) entropy samples get 0.0, as in the reference
        "file_entropy_delta": round4(F.coalesce(c("file_entropy_delta"), F.lit(0.0))),
    }
    return dense.select(*keys, *[cols[name].alias(name) for name in S.FEATURE_COLUMNS])


def parse_stats(parsed: DataFrame, glob: DataFrame, keys: Sequence[str],
                window_s: float = S.WINDOW_SECONDS) -> DataFrame:
    """Matched lines and distinct window ids (negative ones included) per run."""
    keys = list(keys)
    w = with_window_ids(parsed, glob.select(*keys, "first_ts"), keys, window_s)
    return w.groupBy(*keys).agg(F.count(F.lit(1)).alias("parsed_lines"),
                                F.count_distinct("wid").alias("n_windows"))
