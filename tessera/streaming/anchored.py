"""X1, anchored: streaming window counters anchored at each run's first line.

The batch table numbers windows from the run's first line in file order, so
a stream must remember that anchor: ``applyInPandasWithState`` keeps one
double per run (the anchor) and turns every micro-batch of a run into
level-0 partial aggregates keyed by (run, wid, syscall, ip), the same schema
the batch operator builds. The sink only appends partials; reading them back
merges partials of the same key and runs the batch counter levels, so the
counters -- distinct IPs included -- are exact, with state bounded by the
number of runs (no per-window sets, no watermark needed for correctness).

Anchor: streams carry no file position (``monotonically_increasing_id`` is
not allowed on streams), so the anchor is the first row of the run's first
micro-batch by ``order_col`` when the producer supplies a sequence number,
else the earliest timestamp of that micro-batch. That equals the batch anchor
(first line in file order, T3) when the run's lines arrive in order and its
first line is not preceded in time by a later line of the same micro-batch.
"""

from __future__ import annotations

from typing import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera import schemas as S

PARTIAL_COLS = ("n", "pos_sum", "pos_n", "rnd_sum", "ext_n", "mmap_sum", "futex_n", "dns_n",
                "fail_n")


def _partials(pdf: pd.DataFrame, anchor: float, window_s: float) -> pd.DataFrame:
    wid = np.trunc((pdf["ts_s"].to_numpy() - anchor) / window_s).astype("int64")
    ret = pdf["ret"].fillna(0).astype("int64")
    pos = ret > 0
    ip = pdf["ip"].where(pdf["syscall"] == "connect")
    frame = pd.DataFrame({
        "wid": wid, "syscall": pdf["syscall"], "ip": ip.fillna("\x00"),
        "n": 1,
        "pos_sum": np.where(pos, ret, 0),
        "pos_n": pos.astype("int64"),
        "rnd_sum": np.where(pos & pdf["is_random"].fillna(False), ret, 0),
        "ext_n": pdf["target_ext"].fillna(False).astype("int64"),
        "mmap_sum": pdf["mmap_len"].fillna(0).astype("int64"),
        "futex_n": pdf["futex_wait"].fillna(False).astype("int64"),
        "dns_n": (pdf["port"] == S.DNS_PORT).astype("int64"),
        "fail_n": (ret == -1).astype("int64"),
    })
    g = frame.groupby(["wid", "syscall", "ip"], as_index=False)[list(PARTIAL_COLS)].sum()
    g["ip"] = g["ip"].replace("\x00", None)
    return g


def anchored_partials(parsed: DataFrame, key: str, window_s: float = S.WINDOW_SECONDS,
                      order_col: str | None = None) -> DataFrame:
    """Streaming level-0 partials per micro-batch, windows anchored per run.

    ``parsed`` is a (streaming) parsed-trace DataFrame with a single run key
    column ``key``; ``order_col`` is an optional producer sequence number.
    """
    cols = [key, "ts_s", "syscall", "ret", "ip", "port", "mmap_len",
            "is_random", "futex_wait", "target_ext"]
    if order_col:
        parsed = parsed.withColumn("_order", F.col(order_col))
        cols.append("_order")
    out_schema = (f"{key} string, wid long, syscall string, ip string, "
                  + ", ".join(f"{c} long" for c in PARTIAL_COLS))

    def step(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True)
        if pdf.empty:
            return
        if state.exists:
            anchor = state.get[0]
        else:
            anchor = float(pdf.sort_values("_order", kind="stable")["ts_s"].iloc[0]
                           if "_order" in pdf.columns else pdf["ts_s"].min())
            state.update((anchor,))
        part = _partials(pdf, anchor, window_s)
        part.insert(0, key, str(k[0]))
        yield part[[key, "wid", "syscall", "ip", *PARTIAL_COLS]]

    return (parsed.select(*cols).withColumn(key, F.col(key).cast("string"))
            .groupBy(key)
            .applyInPandasWithState(step, out_schema, "anchor double", "append",
                                    GroupStateTimeout.NoTimeout))


def counters_from_partials(partials: DataFrame, keys: Sequence[str],
                           sets: Mapping[str, Sequence[str]] = S.SYSCALL_SETS) -> DataFrame:
    """Merge appended partials and finish the batch counter levels (wid >= 0)."""
    from tessera.operators.features import counters_from_level0
    keys = list(keys)
    merged = (partials.groupBy(*keys, "wid", "syscall", "ip")
              .agg(*[F.sum(c).alias(c) for c in PARTIAL_COLS]))
    return counters_from_level0(merged.filter(F.col("wid") >= 0), keys, sets)
