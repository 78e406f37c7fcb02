"""Feature table against a brute-force Python evaluation of the definitions."""

import math
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.trace import parse_trace_lines
from tessera.operators import features as FT

RUN = [
    '1 10.00 read(3, "a", 2) = 10',
    '1 10.05 write(4, "/d/f.locked", 5) = 5',
    '1 10.07 openat(AT_FDCWD, "/d/x.txt", O_RDONLY) = 3',
    '1 10.31 write(4, "x", 3) = 3',
    '1 10.33 connect(3, {sa_family=AF_INET, sin_port=htons(53), sin_addr=inet_addr("9.9.9.9")}, 16) = -1',
    '1 10.34 connect(3, {sa_family=AF_INET, sin_port=htons(80), sin_addr=inet_addr("9.9.9.9")}, 16) = 0',
    '1 10.35 connect(3, {sa_family=AF_INET, sin_port=htons(80), sin_addr=inet_addr("8.8.8.8")}, 16) = 0',
    '1 10.61 write(4, "y", 65536) = 65536',
    '1 9.95 close(3) = 0',
    '1 10.62 read(5, "/dev/urandom", 8) = 8',
]


def brute(lines, W=0.1):
    import re
    pat = re.compile(S.LINE_PATTERN)
    rows = []
    for ln in lines:
        m = pat.match(ln)
        if not m:
            continue
        ts = float(m.group(3))
        rm = re.search(S.RET_PATTERN, ln)
        rows.append((ts, m.group(4), int(rm.group(1)) if rm else 0, ln))
    first = rows[0][0]
    win = defaultdict(lambda: defaultdict(int))
    names = defaultdict(list)
    ips = defaultdict(set)
    for ts, sc, ret, ln in rows:
        w = int((ts - first) / W)
        names[w].append(sc)
        if sc == "write" and ret > 0:
            win[w]["bw"] += ret
        if sc == "read" and ret > 0:
            win[w]["br"] += ret
        if sc == "connect":
            ip = re.search(S.IP_PATTERN, ln)
            if ip:
                ips[w].add(ip.group(1))
    mx = max(win.keys() | names.keys())
    out, hist = {}, []
    for w in range(mx + 1):
        hist = (hist + [win[w]["bw"]])[-5:]
        std = float(np.std(hist)) if len(hist) > 1 else 0.0
        cnt = defaultdict(int)
        for n in names[w]:
            cnt[n] += 1
        tot = len(names[w])
        ent = -sum((c / tot) * math.log2(c / tot) for c in cnt.values()) if tot else 0.0
        out[w] = dict(bw=win[w]["bw"] * 10, br=win[w]["br"] * 10, std=round(std, 4),
                      ent=round(ent, 4), ips=len(ips[w]))
    return out


@pytest.fixture(scope="module")
def feats(spark):
    df = spark.createDataFrame([(1, i, ln) for i, ln in enumerate(RUN)],
                               "sample_id long, line_order long, line string")
    p = parse_trace_lines(df)
    return {r.window_idx: r for r in FT.trace_features(p, ["sample_id"]).collect()}


def test_dense_rows(feats):
    assert sorted(feats) == list(range(7))


def test_against_brute_force(feats):
    ref = brute(RUN)
    for w, e in ref.items():
        r = feats[w]
        assert r.bytes_written_per_sec == e["bw"]
        assert r.bytes_read_per_sec == e["br"]
        assert r.io_burstiness_std == pytest.approx(e["std"], abs=1e-9)
        assert r.syscall_sequence_entropy == pytest.approx(abs(e["ent"]), abs=1e-9)
        assert r.unique_dest_ip_rate == e["ips"]


def test_run_globals(feats):
    r = feats[0]
    # first line in file order is at 10.00; first encryption is the .locked write at 10.05
    assert r.time_to_first_encryption_s == pytest.approx(0.05, abs=1e-9)
    ts = np.array([10.05, 10.31, 10.61]); b = np.array([5, 3, 65536])
    slope = np.polyfit(ts - ts[0], b, 1)[0]
    assert r.encryption_slope == pytest.approx(round(slope, 4), abs=1e-3)
    assert r.window_start_s == 0.0 and feats[3].window_start_s == 0.3


def test_rolling_std_golden(spark):
    # golden rows: written bytes [1, 0] -> 0.5 ; [1, 0, 65536] -> 30893.731
    dense = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 0, 2), (1, 2, 65536, 2)],
                                  "sample_id long, wid long, bw long, max_wid long")
    r = {x.wid: x.s for x in FT.rolling_pop_std(dense, ["sample_id"], "bw", 5, "s").collect()}
    assert r[0] == 0.0 and r[1] == pytest.approx(0.5) and r[2] == pytest.approx(30893.731, abs=1e-3)


def test_gap_fill_guard(spark):
    df = spark.createDataFrame(
        [(1, 0, "1 07:00:00.0 read(3) = 1"), (1, 1, "1 1720000000.0 read(3) = 1")],
        "sample_id long, line_order long, line string")
    p = parse_trace_lines(df)
    with pytest.raises(Exception):
        FT.trace_features(p, ["sample_id"], max_windows=1000).collect()


def test_dense_ids_in_slices(spark):
    glob = spark.createDataFrame([(1, 0.0, 10), (2, 0.0, 0)], "sample_id long, first_ts double, max_wid long")
    ids = sorted((r.sample_id, r.wid) for r in FT.dense_window_ids(glob, ["sample_id"], chunk=3).collect())
    assert ids == [(1, w) for w in range(11)] + [(2, 0)]


def test_writes_at_one_time_have_no_slope(spark):
    rows = [(0, "a", 42927.782161, "open", 3), (1, "a", 42929.010612, "write", 44950), (2, "a", 42929.010612, "write", 3851), (3, "a", 42929.010612, "write", 67533)]
    p = spark.createDataFrame(rows, "line_order long, sample_id string, ts_s double, syscall string, ret long").selectExpr(
        "*", "false AS target_ext", "false AS is_random", "CAST(NULL AS BIGINT) AS mmap_len", "false AS futex_wait", "CAST(NULL AS STRING) AS ip", "CAST(NULL AS STRING) AS port")
    assert FT.run_globals(p, ["sample_id"]).first().encryption_slope == 0.0
    assert {r.encryption_slope for r in FT.trace_features(p, ["sample_id"]).collect()} == {0.0}
    plan = FT.window_partials(FT.with_window_ids(p.withColumn("line_order", F.col("line_order").cast("decimal(38,0)")), FT.run_anchor(p, ["sample_id"]), ["sample_id"], 0.1),
                              ["sample_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
