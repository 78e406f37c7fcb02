"""Fixed values and schemas.

The lists under "FIXED VALUES" must equal the trace feature definition for the
feature table to mean the same thing (syscall classes, target file suffixes,
emitted column names and order, default drop list). They are stated plainly in
their natural order and are parameters of the operators, not hard-wired.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the published feature definition)
# ---------------------------------------------------------------------------

WINDOW_SECONDS = 0.1          # tumbling window width of the trace feature table
ASOF_TOLERANCE_S = 0.5        # strict |delta| < tolerance for timeline lookups
TARGET_ROWS = 100             # rows per normalized run
SLIDE_SIZE = 10               # sliding-summary window (rows)
SLIDE_STRIDE = 5              # sliding-summary stride (rows)
VOTE_THRESHOLD = 0.40         # mean-probability vote: malicious if mean > 0.40

TARGET_EXTENSIONS = (
    ".txt", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mp4", ".zip", ".rar",
    ".kitty", ".locked", ".conti", ".wasted", ".encrypted", ".spooky",
)

SYSCALL_SETS = {
    "read": ("read", "pread", "readv"),
    "write": ("write", "pwrite", "writev"),
    "net": ("sendto", "sendmsg", "send", "recvfrom", "recvmsg", "recv"),
    "unlink": ("unlink", "unlinkat"),
    "rename": ("rename", "renameat"),
    "open": ("open", "openat"),
    "dir": ("getdents", "getdents64", "opendir"),
    "lseek": ("lseek",),
    "mmap": ("mmap",),
    "mprotect": ("mprotect",),
    "futex": ("futex",),
    "connect": ("connect",),
    "spawn": ("fork", "vfork", "clone", "clone3"),
    "exec": ("execve",),
}

# Trace line grammar: optional pid, wall-clock HH:MM:SS.f or epoch s.f,
# identifier followed by "(". Works unchanged in Java regex and RE2.
LINE_PATTERN = r"^\s*(?:(\d+)\s+)?(?:(\d{2}:\d{2}:\d{2}\.\d+)|(\d+\.\d+))\s+([a-zA-Z_]\w*)\("
RET_PATTERN = r"\)\s*=\s*(-?\d+)"
PATH_PATTERN = r'"([^"]*)"'
IP_PATTERN = r'inet_addr\("([^"]+)"\)'
PORT_PATTERN = r"sin_port=htons\((\d+)\)"
MMAP_SIZE_PATTERN = r"mmap\([^,]+,\s*(\d+),"
DNS_PORT = "53"

FEATURE_COLUMNS = (
    "window_idx", "window_start_s",
    "bytes_read_per_sec", "bytes_written_per_sec", "rw_volume_ratio",
    "file_deletion_rate", "file_rename_rate", "target_extension_velocity",
    "seq_vs_random_disk_ratio", "urandom_bytes_per_sec",
    "mmap_brk_rate", "mprotect_rate", "futex_rate",
    "net_packet_rate", "net_byte_volume", "unique_dest_ip_rate",
    "dns_query_rate", "connection_failure_rate",
    "child_spawn_rate", "execve_rate",
    "syscall_sequence_entropy", "io_burstiness_std",
    "dir_ops", "drop_rate", "ransom_note_hits", "library_call_rate_openssl",
    "vmrss_kb", "mean_file_entropy",
    "time_to_first_encryption_s", "encryption_slope", "file_entropy_delta",
)

FEATURES_TO_DROP = (
    "window_idx", "file_entropy_delta", "encryption_slope", "mean_file_entropy",
    "ransom_note_hits", "library_call_rate_openssl", "net_packet_rate",
    "net_byte_volume", "unique_dest_ip_rate", "dns_query_rate",
    "connection_failure_rate", "drop_rate", "vmrss_kb",
)

SUMMARY_STATS = ("mean", "std", "max", "min")
PROFILE_PERCENTILES = (0, 1, 5, 25, 50, 75, 95, 99, 100)
PROFILE_TOP_N = 10
NEAR_CONSTANT_MAX = 5
SPARSE_FRACTION = 0.9

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

ENTROPY_TIMELINE_SCHEMA = T.StructType([
    T.StructField("epoch", T.StringType()),
    T.StructField("mean_entropy", T.StringType()),
    T.StructField("file_count", T.StringType()),
    T.StructField("total_bytes", T.StringType()),
])

PROC_TIMELINE_SCHEMA = T.StructType([
    T.StructField("epoch", T.StringType()),
    T.StructField("vmrss_kb", T.StringType()),
    T.StructField("read_bytes", T.StringType()),
    T.StructField("write_bytes", T.StringType()),
])

META_SCHEMA = T.StructType([
    T.StructField("binary", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("binary_arch", T.StringType()),
    T.StructField("host_arch", T.StringType()),
    T.StructField("used_qemu", T.LongType()),
    T.StructField("qemu_bin", T.StringType()),
    T.StructField("tracer", T.StringType()),
    T.StructField("gui_simulated", T.BooleanType()),
    T.StructField("start_epoch", T.DoubleType()),
    T.StructField("end_epoch", T.DoubleType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("target_pid", T.StringType()),
    T.StructField("watch_dir", T.StringType()),
    T.StructField("bin_args", T.ArrayType(T.StringType())),
    T.StructField("timeout", T.DoubleType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# Columns that stay integral in a raw feature table (everything else double).
INTEGER_FEATURES = tuple(
    c for c in FEATURE_COLUMNS
    if c not in ("window_start_s", "rw_volume_ratio", "syscall_sequence_entropy",
                 "io_burstiness_std", "mean_file_entropy", "time_to_first_encryption_s",
                 "encryption_slope", "file_entropy_delta")
)

FEATURE_SCHEMA = T.StructType([
    T.StructField(c, T.LongType() if c in INTEGER_FEATURES else T.DoubleType())
    for c in FEATURE_COLUMNS
])
