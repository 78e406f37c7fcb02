"""Driver tables and the events -> trace adapter.

The driver tables hold no process traces, so ``events`` is rendered into
trace lines (one line per event, epoch clock) and parsed back by the real
parser. The mapping is a fixed 20-case rule on (event_type, k % 4) where k is
the integer in ``props``; it is a pure column expression, so the adapter is a
narrow, shuffle-free projection over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Adapter constants for ``events`` (one event ~ one syscall, one user ~ one run).
EVENTS_WINDOW_S = 86400.0       # users have tens of events over 30 days: daily windows
EVENTS_TOLERANCE_S = 21600.0    # as-of tolerance for the derived timelines (6 h)
EVENTS_TARGET_ROWS = 20         # normalized rows per user
EVENTS_SLIDE_SIZE = 4
EVENTS_SLIDE_STRIDE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object(F.col("props"), "$.k").cast("int")


# FIXED VALUES: rendering rule (event_type, k % 4, sub) -> full trace line.
# Positional arguments: 1=k, 2=floor(value), 3=k*4096, 4=k%4, 5=k%16,
# 6=k+1000, 7=user_id (pid), 8=epoch text. sub=1 only for error/3 with k%8=3.
EVENT_TEMPLATES = (
    ("view", 0, 0, '%7$d %8$s read(3, "/srv/data/blob_%1$d.bin", %2$s) = %2$s'),
    ("view", 1, 0, '%7$d %8$s read(5, "/dev/urandom", %2$s) = %2$s'),
    ("view", 2, 0, "%7$d %8$s lseek(3, %2$s, SEEK_SET) = %2$s"),
    ("view", 3, 0, "%7$d %8$s mmap(NULL, %3$d, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f%1$d000"),
    ("click", 0, 0, '%7$d %8$s openat(AT_FDCWD, "/home/user/docs/file_%1$d.docx", O_RDONLY) = 3'),
    ("click", 1, 0, '%7$d %8$s openat(AT_FDCWD, "/etc/app_%1$d.conf", O_RDONLY) = 3'),
    ("click", 2, 0, "%7$d %8$s getdents64(3, 0x5555, 32768) = %2$s"),
    ("click", 3, 0, "%7$d %8$s futex(0x5598, FUTEX_WAIT_PRIVATE, 2, NULL) = 0"),
    ("purchase", 0, 0, '%7$d %8$s write(4, "payload_%1$d", %2$s) = %2$s'),
    ("purchase", 1, 0, '%7$d %8$s write(4, "/home/user/docs/file_%1$d.locked", %2$s) = %2$s'),
    ("purchase", 2, 0, '%7$d %8$s sendto(5, "data", %2$s, 0, NULL, 0) = %2$s'),
    ("purchase", 3, 0, '%7$d %8$s recvfrom(5, "data", %2$s, 0, NULL, 0) = %2$s'),
    ("error", 0, 0, '%7$d %8$s unlink("/home/user/docs/file_%1$d.docx") = 0'),
    ("error", 1, 0, '%7$d %8$s rename("/home/user/docs/file_%1$d.docx", '
                    '"/home/user/docs/file_%1$d.docx.locked") = 0'),
    ("error", 2, 0, "%7$d %8$s mprotect(0x7f00, 4096, PROT_READ) = 0"),
    ("error", 3, 1, "%7$d %8$s clone(child_stack=NULL, flags=SIGCHLD) = %6$d"),
    ("error", 3, 0, '%7$d %8$s execve("/usr/bin/tool_%1$d", ["tool"], 0x7ffd) = 0'),
    ("signup", 0, 0, "%7$d %8$s connect(3, {sa_family=AF_INET, sin_port=htons(53), "
                     'sin_addr=inet_addr("10.0.%4$d.%5$d")}, 16) = 0'),
    ("signup", 1, 0, "%7$d %8$s connect(3, {sa_family=AF_INET, sin_port=htons(443), "
                     'sin_addr=inet_addr("10.0.%4$d.%5$d")}, 16) = -1'),
    ("signup", 2, 0, "%7$d %8$s connect(3, {sa_family=AF_INET, sin_port=htons(443), "
                     'sin_addr=inet_addr("10.0.%4$d.%5$d")}, 16) = 0'),
    ("signup", 3, 0, "%7$d %8$s <... connect resumed>) = 0"),
)


def event_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EVENT_TEMPLATES),
                                 "event_type string, v int, sub int, fmt string")


def events_as_trace_lines(events: DataFrame) -> DataFrame:
    """S1 stand-in: ``(sample_id, line_order, line)`` rendered from ``events``.

    One broadcast join against the 21-row template table (fixed size) and one
    positional ``format_string``; no rows are dropped. Signup events with
    k % 4 == 3 become ``<... connect resumed>`` lines the parser must drop.
    """
    k = _k()
    ev = (events.withColumn("k", k)
          .withColumn("v", F.col("k") % 4)
          .withColumn("sub", F.when((F.col("event_type") == "error") & (F.col("v") == 3)
                                    & (F.col("k") % 8 == 3), F.lit(1)).otherwise(F.lit(0)))
          .withColumn("_us", events_ts_micros()))
    tpl = F.broadcast(event_templates(events.sparkSession))
    ts_text = F.format_string("%d.%06d", F.expr("_us div 1000000"), F.expr("_us % 1000000"))
    line = F.expr("format_string(fmt, k, CAST(floor(value) AS BIGINT) || '', k * 4096, k % 4, "
                  "k % 16, k + 1000, user_id, ts_text)")
    return (ev.join(tpl, ["event_type", "v", "sub"], "left")
            .withColumn("ts_text", ts_text)
            .select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("line_order"),
                    line.alias("line")))


def events_ts_micros() -> Column:
    """Microseconds since the epoch of the zone-less ``ts`` (independent of the
    session time zone)."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def events_ts_seconds() -> Column:
    return events_ts_micros() / 1e6


def events_entropy_timeline(events: DataFrame) -> DataFrame:
    """S2 stand-in: view events as entropy samples (epoch, mean_entropy, order)."""
    return (events.filter(F.col("event_type") == "view")
            .select(F.col("user_id").alias("sample_id"),
                    events_ts_seconds().alias("epoch"),
                    (F.col("value") / 64.0).alias("mean_entropy"),
                    F.col("event_id").alias("row_order")))


def events_proc_timeline(events: DataFrame) -> DataFrame:
    """S3 stand-in: click events as memory samples (epoch, vmrss_kb, order)."""
    return (events.filter(F.col("event_type") == "click")
            .select(F.col("user_id").alias("sample_id"),
                    events_ts_seconds().alias("epoch"),
                    F.floor(F.col("value") * 1024).cast("bigint").alias("vmrss_kb"),
                    F.col("event_id").alias("row_order")))


def events_user_labels(events: DataFrame) -> DataFrame:
    """P12 stand-in labels per user: 'ransomware' when a user has more error
    (-> unlink/rename/exec) events than view (-> read) events, else 'goodware'.
    ``sample_name`` mirrors the per-sample label of the multiclass task."""
    g = events.groupBy(F.col("user_id").alias("sample_id")).agg(
        F.count_if(F.col("event_type") == "error").alias("_e"),
        F.count_if(F.col("event_type") == "view").alias("_v"))
    return g.select("sample_id",
                    F.when(F.col("_e") > F.col("_v"), F.lit("ransomware"))
                    .otherwise(F.lit("goodware")).alias("binary_label"),
                    F.format_string("user_%d", F.col("sample_id")).alias("sample_name"))
