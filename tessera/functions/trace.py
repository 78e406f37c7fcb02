"""Trace-line scalar functions (P1-P9, F1, F2, F3) as Catalyst expressions.

Everything here is a ``Column -> Column`` builder; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas as S


def _blank_to_null(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def clock_to_seconds(clock: Column) -> Column:
    """``HH:MM:SS.f`` -> seconds of day (double); int hours/minutes, float seconds."""
    parts = F.split(clock, ":")
    return (parts.getItem(0).try_cast("bigint") * 3600 + parts.getItem(1).try_cast("bigint") * 60) \
        + parts.getItem(2).try_cast("double")


def safe_int(text: Column) -> Column:
    """Digits -> bigint; no match, hex or overflow -> 0."""
    return F.coalesce(_blank_to_null(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    """Exact, case-sensitive suffix membership."""
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


def in_set(c: Column, values: Sequence[str]) -> Column:
    """Syscall-class membership on exact names."""
    return c.isin(list(values))


def parse_trace_lines(lines: DataFrame, line_col: str = "line",
                      target_extensions: Sequence[str] = S.TARGET_EXTENSIONS) -> DataFrame:
    """Parse raw trace lines, drop non-matching ones.

    Adds ``pid, clock, ts_s, syscall, ret, path, ip, port, mmap_len`` and the
    line-level predicates the feature aggregates need (``is_random``,
    ``futex_wait``, ``target_ext``); the raw line is not carried further.

    The line grammar is matched once (group 0 = the line head) and the head
    is split on any white space; IP/port are read only on ``connect`` lines
    and the mapping length only on ``mmap`` lines, where the features use
    them. A clock out of range gives a null timestamp, never an error.
    """
    line = F.col(line_col)
    head = F.regexp_extract(line, S.LINE_PATTERN, 0)
    toks = F.split(F.regexp_replace("_head", r"^\s+", ""), r"\s+")
    n = F.size(toks)
    pid_s = F.when(n == 3, toks.getItem(0))
    ts_tok = F.when(n == 3, toks.getItem(1)).otherwise(toks.getItem(0))
    name_tok = F.element_at(toks, -1)
    syscall = F.expr("substring(_name_tok, 1, length(_name_tok) - 1)")
    quoted = F.regexp_extract(line, S.PATH_PATTERN, 0)
    sc = F.col("syscall")
    out = (
        lines.withColumn("_head", head)
        .filter(F.col("_head") != "")
        .withColumn("_name_tok", name_tok)
        .withColumn("_ts_tok", ts_tok)
        .withColumn("pid", pid_s.try_cast("bigint"))
        .withColumn("clock", F.when(F.col("_ts_tok").contains(":"), F.lit("wall"))
                    .otherwise(F.lit("epoch")))
        .withColumn("ts_s", F.when(F.col("_ts_tok").contains(":"), clock_to_seconds(F.col("_ts_tok")))
                    .otherwise(F.col("_ts_tok").try_cast("double")))
        .withColumn("syscall", syscall)
        .withColumn("ret", safe_int(F.regexp_extract(line, S.RET_PATTERN, 1)))
        .withColumn("_q", quoted)
        .withColumn("path", F.when(F.col("_q") != "",
                                   F.expr("substring(_q, 2, length(_q) - 2)")))
        .withColumn("ip", F.when(sc == "connect",
                                 _blank_to_null(F.regexp_extract(line, S.IP_PATTERN, 1))))
        .withColumn("port", F.when(sc == "connect",
                                   _blank_to_null(F.regexp_extract(line, S.PORT_PATTERN, 1))))
        .withColumn("mmap_len", F.when(sc == "mmap", _blank_to_null(
            F.regexp_extract(line, S.MMAP_SIZE_PATTERN, 1)).try_cast("bigint")))
        .withColumn("is_random", line.contains("random"))
        .withColumn("futex_wait", line.contains("FUTEX_WAIT"))
        .withColumn("target_ext", F.coalesce(ends_with_any(F.col("path"), target_extensions),
                                             F.lit(False)))
        .drop("_head", "_name_tok", "_ts_tok", "_q")
    )
    return out
