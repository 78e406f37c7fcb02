"""DuckDB oracle SQL for the trace queries.

Written independently of the Spark code path: the same rendering rule and the
same regexes, expressed as plain SQL over the ``events`` view.
"""

from __future__ import annotations

from tessera import schemas as S
from tessera.sources import tables as TB

_EXT_PRED = " OR ".join(f"suffix(path, '{e}')" for e in S.TARGET_EXTENSIONS)


def _inlist(name: str) -> str:
    return "(" + ", ".join(f"'{s}'" for s in S.SYSCALL_SETS[name]) + ")"


EVENT_LINES = f"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS v,
         CAST(floor(value) AS BIGINT) AS r,
         epoch_us(ts) AS us
  FROM events
),
ev_parts AS (
  SELECT *,
    CASE
      WHEN event_type = 'view' AND v <= 1 THEN 'read'
      WHEN event_type = 'view' AND v = 2 THEN 'lseek'
      WHEN event_type = 'view' AND v = 3 THEN 'mmap'
      WHEN event_type = 'click' AND v <= 1 THEN 'openat'
      WHEN event_type = 'click' AND v = 2 THEN 'getdents64'
      WHEN event_type = 'click' AND v = 3 THEN 'futex'
      WHEN event_type = 'purchase' AND v <= 1 THEN 'write'
      WHEN event_type = 'purchase' AND v = 2 THEN 'sendto'
      WHEN event_type = 'purchase' AND v = 3 THEN 'recvfrom'
      WHEN event_type = 'error' AND v = 0 THEN 'unlink'
      WHEN event_type = 'error' AND v = 1 THEN 'rename'
      WHEN event_type = 'error' AND v = 2 THEN 'mprotect'
      WHEN event_type = 'error' AND v = 3 AND k % 8 = 3 THEN 'clone'
      WHEN event_type = 'error' AND v = 3 THEN 'execve'
      ELSE 'connect' END AS syscall_r,
    CASE
      WHEN event_type = 'view' AND v = 0 THEN printf('3, "/srv/data/blob_%d.bin", %s', k, CAST(r AS VARCHAR))
      WHEN event_type = 'view' AND v = 1 THEN printf('5, "/dev/urandom", %s', CAST(r AS VARCHAR))
      WHEN event_type = 'view' AND v = 2 THEN printf('3, %s, SEEK_SET', CAST(r AS VARCHAR))
      WHEN event_type = 'view' AND v = 3 THEN printf('NULL, %d, PROT_READ, MAP_PRIVATE, 3, 0', k * 4096)
      WHEN event_type = 'click' AND v = 0 THEN printf('AT_FDCWD, "/home/user/docs/file_%d.docx", O_RDONLY', k)
      WHEN event_type = 'click' AND v = 1 THEN printf('AT_FDCWD, "/etc/app_%d.conf", O_RDONLY', k)
      WHEN event_type = 'click' AND v = 2 THEN '3, 0x5555, 32768'
      WHEN event_type = 'click' AND v = 3 THEN '0x5598, FUTEX_WAIT_PRIVATE, 2, NULL'
      WHEN event_type = 'purchase' AND v = 0 THEN printf('4, "payload_%d", %s', k, CAST(r AS VARCHAR))
      WHEN event_type = 'purchase' AND v = 1 THEN printf('4, "/home/user/docs/file_%d.locked", %s', k, CAST(r AS VARCHAR))
      WHEN event_type = 'purchase' AND v >= 2 THEN printf('5, "data", %s, 0, NULL, 0', CAST(r AS VARCHAR))
      WHEN event_type = 'error' AND v = 0 THEN printf('"/home/user/docs/file_%d.docx"', k)
      WHEN event_type = 'error' AND v = 1 THEN printf('"/home/user/docs/file_%d.docx", "/home/user/docs/file_%d.docx.locked"', k, k)
      WHEN event_type = 'error' AND v = 2 THEN '0x7f00, 4096, PROT_READ'
      WHEN event_type = 'error' AND v = 3 AND k % 8 = 3 THEN 'child_stack=NULL, flags=SIGCHLD'
      WHEN event_type = 'error' AND v = 3 THEN printf('"/usr/bin/tool_%d", ["tool"], 0x7ffd', k)
      ELSE printf('3, {{sa_family=AF_INET, sin_port=htons(%d), sin_addr=inet_addr("10.0.%d.%d")}}, 16',
                  CASE WHEN v = 0 THEN 53 ELSE 443 END, k % 4, k % 16) END AS args,
    CASE
      WHEN event_type = 'view' AND v = 3 THEN printf('0x7f%d000', k)
      WHEN event_type = 'click' AND v <= 1 THEN '3'
      WHEN event_type = 'click' AND v = 2 THEN CAST(r AS VARCHAR)
      WHEN event_type = 'click' AND v = 3 THEN '0'
      WHEN event_type = 'purchase' THEN CAST(r AS VARCHAR)
      WHEN event_type = 'error' AND v = 3 AND k % 8 = 3 THEN CAST(k + 1000 AS VARCHAR)
      WHEN event_type = 'error' THEN '0'
      WHEN event_type = 'signup' AND v = 1 THEN '-1'
      WHEN event_type = 'signup' THEN '0'
      ELSE CAST(r AS VARCHAR) END AS ret_text,
    printf('%d.%06d', us // 1000000, us % 1000000) AS ts_text
  FROM ev
),
lines AS (
  SELECT user_id AS sample_id, event_id AS line_order,
    CASE WHEN event_type = 'signup' AND v = 3
         THEN printf('%d %s <... connect resumed>) = 0', user_id, ts_text)
         ELSE printf('%d %s %s(%s) = %s', user_id, ts_text, syscall_r, args, ret_text) END AS line
  FROM ev_parts
),
parsed0 AS (
  SELECT sample_id, line_order, line,
    regexp_extract(line, '{S.LINE_PATTERN}', 1) AS pid_s,
    regexp_extract(line, '{S.LINE_PATTERN}', 2) AS clock_s,
    regexp_extract(line, '{S.LINE_PATTERN}', 3) AS epoch_s,
    regexp_extract(line, '{S.LINE_PATTERN}', 4) AS syscall,
    regexp_extract(line, '{S.RET_PATTERN}', 1) AS ret_s,
    CASE WHEN regexp_matches(line, '{S.PATH_PATTERN}') THEN regexp_extract(line, '{S.PATH_PATTERN}', 1) END AS path,
    CASE WHEN regexp_extract(line, '{S.LINE_PATTERN}', 4) = 'connect'
         THEN NULLIF(regexp_extract(line, '{S.IP_PATTERN}', 1), '') END AS ip,
    CASE WHEN regexp_extract(line, '{S.LINE_PATTERN}', 4) = 'connect'
         THEN NULLIF(regexp_extract(line, '{S.PORT_PATTERN}', 1), '') END AS port,
    CASE WHEN regexp_extract(line, '{S.LINE_PATTERN}', 4) = 'mmap'
         THEN TRY_CAST(NULLIF(regexp_extract(line, '{S.MMAP_SIZE_PATTERN}', 1), '') AS BIGINT) END AS mmap_len
  FROM lines
  WHERE regexp_matches(line, '{S.LINE_PATTERN}')
),
parsed AS (
  SELECT sample_id, line_order,
    TRY_CAST(NULLIF(pid_s, '') AS BIGINT) AS pid,
    CASE WHEN clock_s <> '' THEN 'wall' ELSE 'epoch' END AS clock,
    CASE WHEN clock_s <> '' THEN
      (CAST(split_part(clock_s, ':', 1) AS BIGINT) * 3600 + CAST(split_part(clock_s, ':', 2) AS BIGINT) * 60)
      + CAST(split_part(clock_s, ':', 3) AS DOUBLE)
    ELSE CAST(epoch_s AS DOUBLE) END AS ts_s,
    syscall,
    COALESCE(TRY_CAST(NULLIF(ret_s, '') AS BIGINT), 0) AS ret,
    path, ip, port, mmap_len,
    contains(line, 'random') AS is_random,
    contains(line, 'FUTEX_WAIT') AS futex_wait,
    COALESCE({_EXT_PRED}, false) AS target_ext
  FROM parsed0
)
"""

TRACE_PARSE = f"""
WITH {EVENT_LINES}
SELECT sample_id, line_order, pid, clock, ts_s, syscall, ret, path, ip, port, mmap_len,
       is_random, futex_wait, target_ext
FROM parsed
"""


def _globals_cte(window_s: float) -> str:
    return f"""
runs0 AS (
  SELECT sample_id,
    arg_min(ts_s, line_order) AS first_ts,
    max(ts_s) AS max_ts,
    arg_min(ts_s, CASE WHEN (syscall IN {_inlist('write')} AND ret > 0 AND target_ext)
                         OR (syscall IN {_inlist('open')} AND target_ext)
                       THEN line_order END) AS first_enc_ts,
    count(CASE WHEN syscall IN {_inlist('write')} AND ret > 0 THEN 1 END) AS n_w,
    var_pop(CASE WHEN syscall IN {_inlist('write')} AND ret > 0 THEN ts_s END) AS vx,
    regr_slope(CASE WHEN syscall IN {_inlist('write')} AND ret > 0 THEN CAST(ret AS DOUBLE) END,
               CASE WHEN syscall IN {_inlist('write')} AND ret > 0 THEN ts_s END) AS slope_raw
  FROM parsed GROUP BY sample_id
),
runs AS (
  SELECT sample_id, first_ts,
    CAST(trunc((max_ts - first_ts) / CAST({window_s!r} AS DOUBLE)) AS BIGINT) AS max_wid,
    CASE WHEN first_enc_ts IS NULL OR first_enc_ts = 0.0 THEN 0.0 ELSE first_enc_ts - first_ts END
      AS time_to_first_encryption_s,
    CASE WHEN n_w < 2 OR vx = 0 OR slope_raw IS NULL OR isnan(slope_raw) THEN 0.0 ELSE slope_raw END
      AS encryption_slope
  FROM runs0
)"""


def _features_sql(window_s: float, tolerance: float, with_timelines: bool) -> str:
    sc = "syscall"

    def tot(setname: str, col: str) -> str:
        return f"COALESCE(SUM(CASE WHEN {sc} IN {_inlist(setname)} THEN {col} END), 0)"

    timelines = ""
    if with_timelines:
        timelines = f""",
ent_raw AS (
  SELECT user_id AS sample_id, epoch_us(ts) / 1e6 AS epoch, value / 64.0 AS mean_entropy,
         event_id AS row_order FROM events WHERE event_type = 'view'
),
ent AS (
  SELECT sample_id, epoch, arg_max(mean_entropy, row_order) AS mean_entropy
  FROM ent_raw GROUP BY sample_id, epoch
),
proc_raw AS (
  SELECT user_id AS sample_id, epoch_us(ts) / 1e6 AS epoch,
         CAST(floor(value * 1024) AS BIGINT) AS vmrss_kb, event_id AS row_order
  FROM events WHERE event_type = 'click'
),
proc AS (
  SELECT sample_id, epoch, arg_max(vmrss_kb, row_order) AS vmrss_kb, min(row_order) AS pos
  FROM proc_raw GROUP BY sample_id, epoch
),
ent_match AS (
  SELECT d.sample_id, d.wid, arg_min(e.mean_entropy, e.epoch) AS mean_entropy
  FROM dense d JOIN ent e ON e.sample_id = d.sample_id
   AND abs(e.epoch - (d.first_ts + d.wid * CAST({window_s!r} AS DOUBLE))) < CAST({tolerance!r} AS DOUBLE)
  GROUP BY d.sample_id, d.wid
),
proc_match AS (
  SELECT d.sample_id, d.wid, arg_min(p.vmrss_kb, p.pos) AS vmrss_kb
  FROM dense d JOIN proc p ON p.sample_id = d.sample_id
   AND abs(p.epoch - (d.first_ts + d.wid * CAST({window_s!r} AS DOUBLE))) < CAST({tolerance!r} AS DOUBLE)
  GROUP BY d.sample_id, d.wid
),
ent_delta AS (
  SELECT sample_id,
    CASE WHEN count(*) >= 2 THEN arg_max(mean_entropy, epoch) - arg_min(mean_entropy, epoch) ELSE 0.0 END
      AS file_entropy_delta
  FROM ent GROUP BY sample_id
)"""
    ent_join = ("LEFT JOIN ent_match em ON em.sample_id = d.sample_id AND em.wid = d.wid "
                "LEFT JOIN proc_match pm ON pm.sample_id = d.sample_id AND pm.wid = d.wid "
                "LEFT JOIN ent_delta ed ON ed.sample_id = d.sample_id"
                if with_timelines else "")
    ment = "COALESCE(em.mean_entropy, 0.0)" if with_timelines else "0.0"
    vm = "COALESCE(pm.vmrss_kb, 0)" if with_timelines else "0"
    fed = "COALESCE(ed.file_entropy_delta, 0.0)" if with_timelines else "0.0"
    return f"""
WITH {EVENT_LINES}, {_globals_cte(window_s)},
w AS (
  SELECT p.*, CAST(trunc((p.ts_s - g.first_ts) / CAST({window_s!r} AS DOUBLE)) AS BIGINT) AS wid
  FROM parsed p JOIN runs g USING (sample_id)
),
l1 AS (
  SELECT sample_id, wid, syscall, count(*) AS n,
    SUM(CASE WHEN ret > 0 THEN ret END) AS pos_sum,
    count(CASE WHEN ret > 0 THEN 1 END) AS pos_n,
    SUM(CASE WHEN ret > 0 AND is_random THEN ret END) AS rnd_sum,
    count(CASE WHEN target_ext THEN 1 END) AS ext_n,
    SUM(mmap_len) AS mmap_sum,
    count(CASE WHEN futex_wait THEN 1 END) AS futex_n,
    count(DISTINCT ip) AS ip_n,
    count(CASE WHEN port = '{S.DNS_PORT}' THEN 1 END) AS dns_n,
    count(CASE WHEN ret = -1 THEN 1 END) AS fail_n
  FROM w WHERE wid >= 0 GROUP BY sample_id, wid, syscall
),
l1p AS (
  SELECT *, n / SUM(n) OVER (PARTITION BY sample_id, wid) AS p FROM l1
),
l2 AS (
  SELECT sample_id, wid,
    {tot('read', 'pos_sum')} AS bytes_read,
    {tot('write', 'pos_sum')} AS bytes_written,
    {tot('unlink', 'n')} AS file_deletions,
    {tot('rename', 'n')} AS file_renames,
    {tot('open', 'ext_n')} AS target_extensions,
    {tot('lseek', 'n')} AS lseek_calls,
    {tot('read', 'rnd_sum')} AS urandom_bytes,
    {tot('mmap', 'mmap_sum')} AS mmap_bytes,
    {tot('mprotect', 'n')} AS mprotect_calls,
    {tot('futex', 'futex_n')} AS futex_waits,
    {tot('net', 'pos_n')} AS net_packets,
    {tot('net', 'pos_sum')} AS net_bytes,
    {tot('connect', 'ip_n')} AS unique_ips,
    {tot('connect', 'dns_n')} AS dns_queries,
    {tot('connect', 'fail_n')} AS conn_failures,
    {tot('spawn', 'n')} AS child_processes,
    {tot('exec', 'n')} AS execve_calls,
    {tot('dir', 'n')} AS dir_ops,
    0.0 - SUM(p * log2(p)) AS syscall_entropy
  FROM l1p GROUP BY sample_id, wid
),
dense AS (
  SELECT g.sample_id, g.first_ts, g.max_wid, CAST(s.wid AS BIGINT) AS wid
  FROM runs g, LATERAL (SELECT unnest(range(0, g.max_wid + 1)) AS wid) s
),
filled AS (
  SELECT d.sample_id, d.wid, d.first_ts,
    COALESCE(l2.bytes_read, 0) AS bytes_read, COALESCE(l2.bytes_written, 0) AS bytes_written,
    COALESCE(l2.file_deletions, 0) AS file_deletions, COALESCE(l2.file_renames, 0) AS file_renames,
    COALESCE(l2.target_extensions, 0) AS target_extensions, COALESCE(l2.lseek_calls, 0) AS lseek_calls,
    COALESCE(l2.urandom_bytes, 0) AS urandom_bytes, COALESCE(l2.mmap_bytes, 0) AS mmap_bytes,
    COALESCE(l2.mprotect_calls, 0) AS mprotect_calls, COALESCE(l2.futex_waits, 0) AS futex_waits,
    COALESCE(l2.net_packets, 0) AS net_packets, COALESCE(l2.net_bytes, 0) AS net_bytes,
    COALESCE(l2.unique_ips, 0) AS unique_ips, COALESCE(l2.dns_queries, 0) AS dns_queries,
    COALESCE(l2.conn_failures, 0) AS conn_failures, COALESCE(l2.child_processes, 0) AS child_processes,
    COALESCE(l2.execve_calls, 0) AS execve_calls, COALESCE(l2.dir_ops, 0) AS dir_ops,
    COALESCE(l2.syscall_entropy, 0.0) AS syscall_entropy,
    stddev_pop(CAST(COALESCE(l2.bytes_written, 0) AS DOUBLE)) OVER (
      PARTITION BY d.sample_id ORDER BY d.wid ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS io_std
  FROM dense d LEFT JOIN l2 ON l2.sample_id = d.sample_id AND l2.wid = d.wid
){timelines}
SELECT d.sample_id,
  d.wid AS window_idx,
  round_even(d.wid * CAST({window_s!r} AS DOUBLE), 4) + 0.0 AS window_start_s,
  CAST(d.bytes_read AS BIGINT) AS bytes_read_per_sec,
  CAST(d.bytes_written AS BIGINT) AS bytes_written_per_sec,
  round_even(CASE WHEN d.bytes_written > 0 THEN d.bytes_read / d.bytes_written ELSE 0.0 END, 4) + 0.0
    AS rw_volume_ratio,
  CAST(d.file_deletions AS BIGINT) AS file_deletion_rate,
  CAST(d.file_renames AS BIGINT) AS file_rename_rate,
  CAST(d.target_extensions AS BIGINT) AS target_extension_velocity,
  CAST(d.lseek_calls AS BIGINT) AS seq_vs_random_disk_ratio,
  CAST(d.urandom_bytes AS BIGINT) AS urandom_bytes_per_sec,
  CAST(d.mmap_bytes AS BIGINT) AS mmap_brk_rate,
  CAST(d.mprotect_calls AS BIGINT) AS mprotect_rate,
  CAST(d.futex_waits AS BIGINT) AS futex_rate,
  CAST(d.net_packets AS BIGINT) AS net_packet_rate,
  CAST(d.net_bytes AS BIGINT) AS net_byte_volume,
  CAST(d.unique_ips AS BIGINT) AS unique_dest_ip_rate,
  CAST(d.dns_queries AS BIGINT) AS dns_query_rate,
  CAST(d.conn_failures AS BIGINT) AS connection_failure_rate,
  CAST(d.child_processes AS BIGINT) AS child_spawn_rate,
  CAST(d.execve_calls AS BIGINT) AS execve_rate,
  round_even(d.syscall_entropy, 4) + 0.0 AS syscall_sequence_entropy,
  round_even(d.io_std, 4) + 0.0 AS io_burstiness_std,
  CAST(d.dir_ops AS BIGINT) AS dir_ops,
  CAST(0 AS BIGINT) AS drop_rate,
  CAST(0 AS BIGINT) AS ransom_note_hits,
  CAST(0 AS BIGINT) AS library_call_rate_openssl,
  CAST({vm} AS BIGINT) AS vmrss_kb,
  round_even({ment}, 4) + 0.0 AS mean_file_entropy,
  round_even(g.time_to_first_encryption_s, 4) + 0.0 AS time_to_first_encryption_s,
  round_even(g.encryption_slope, 4) + 0.0 AS encryption_slope,
  round_even({fed}, 4) + 0.0 AS file_entropy_delta
FROM filled d JOIN runs g USING (sample_id) {ent_join}
"""


TRACE_FEATURES = _features_sql(TB.EVENTS_WINDOW_S, TB.EVENTS_TOLERANCE_S, True)

_COUNTER_COLS = ("sample_id, window_idx, bytes_read_per_sec, bytes_written_per_sec, rw_volume_ratio, "
                 "file_deletion_rate, file_rename_rate, target_extension_velocity, "
                 "seq_vs_random_disk_ratio, urandom_bytes_per_sec, mmap_brk_rate, mprotect_rate, "
                 "futex_rate, net_packet_rate, net_byte_volume, unique_dest_ip_rate, dns_query_rate, "
                 "connection_failure_rate, child_spawn_rate, execve_rate, dir_ops")

TRACE_COUNTERS = (f"SELECT {_COUNTER_COLS} FROM ("
                  + _features_sql(TB.EVENTS_WINDOW_S, TB.EVENTS_TOLERANCE_S, False) + ") t")

PARSE_STATS = f"""
WITH {EVENT_LINES}, {_globals_cte(TB.EVENTS_WINDOW_S)}
SELECT p.sample_id, count(*) AS parsed_lines,
  count(DISTINCT CAST(trunc((p.ts_s - g.first_ts) / CAST({TB.EVENTS_WINDOW_S!r} AS DOUBLE)) AS BIGINT)) AS n_windows
FROM parsed p JOIN runs g USING (sample_id) GROUP BY p.sample_id
"""

RUN_GLOBALS = f"""
WITH {EVENT_LINES}, {_globals_cte(TB.EVENTS_WINDOW_S)}
SELECT sample_id, round_even(first_ts, 4) + 0.0 AS first_ts, max_wid,
  round_even(time_to_first_encryption_s, 4) + 0.0 AS time_to_first_encryption_s,
  round_even(encryption_slope, 4) + 0.0 AS encryption_slope
FROM runs
"""

ENTROPY_DELTA = """
WITH ent_raw AS (
  SELECT user_id AS sample_id, epoch_us(ts) / 1e6 AS epoch, value / 64.0 AS mean_entropy,
         event_id AS row_order FROM events WHERE event_type = 'view'
), ent AS (
  SELECT sample_id, epoch, arg_max(mean_entropy, row_order) AS mean_entropy
  FROM ent_raw GROUP BY sample_id, epoch
)
SELECT sample_id,
  round_even(CASE WHEN count(*) >= 2 THEN arg_max(mean_entropy, epoch) - arg_min(mean_entropy, epoch)
             ELSE 0.0 END, 4) + 0.0 AS file_entropy_delta
FROM ent GROUP BY sample_id
"""

ORACLE = {
    "trace_parse": TRACE_PARSE,
    "trace_features": TRACE_FEATURES,
    "trace_counters": TRACE_COUNTERS,
    "parse_stats": PARSE_STATS,
    "run_globals": RUN_GLOBALS,
    "entropy_delta": ENTROPY_DELTA,
}
