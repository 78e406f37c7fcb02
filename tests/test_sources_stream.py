"""S1-S8, S12 file round trips in a fresh scratch folder; X1 stream vs batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.trace import parse_trace_lines
from tessera.sources import files as FS
from tessera.streaming import counters as SC


def _run_dir(root, cat, sample, run, trace_name="strace.log", lines=None):
    d = os.path.join(root, cat, sample, run)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, trace_name), "w") as f:
        f.write("\n".join(lines or ['1 10.0 read(3, "a", 2) = 2', '1 10.2 write(4, "b", 3) = 3']) + "\n")
    return d


def test_trace_file_choice_and_order(spark, scratch):
    d = _run_dir(scratch, "goodware", "curl", "r1")
    with open(os.path.join(d, "ltrace.log"), "w") as f:
        f.write('1 10.0 SSL_write(3) = 1\n')
    _run_dir(scratch, "ransom", "x", "r1", "ltrace.log", ['1 5.0 open("a.txt") = 3'])
    df = FS.read_traces(spark, scratch)
    rows = df.orderBy("category", "line_order").collect()
    assert [(r.category, r.sample, r.run) for r in rows] == [
        ("goodware", "curl", "r1"), ("goodware", "curl", "r1"), ("ransom", "x", "r1")]
    assert "SSL_write" not in " ".join(r.line for r in rows)


def test_timelines_and_meta(spark, scratch):
    d = _run_dir(scratch, "goodware", "curl", "r1")
    with open(os.path.join(d, "entropy_timeline.csv"), "w") as f:
        f.write("epoch,mean_entropy,file_count,total_bytes\n1.0,7.5,3,100\nbad,row,x,y\n2.0,7.0,3,120\n")
    with open(os.path.join(d, "meta.json"), "w") as f:
        json.dump({"binary": "/bin/curl", "used_qemu": 0, "gui_simulated": False, "start_epoch": 1.5,
                   "end_epoch": 4.0, "target_pid": None, "bin_args": ["-s", "x"], "timeout": 60}, f, indent=1)
    ent = FS.read_entropy_timeline(spark, scratch).collect()
    assert [r.epoch for r in ent] == [1.0, 2.0]
    meta = FS.read_meta(spark, scratch).first()
    assert meta.bin_args == ["-s", "x"] and meta.target_pid is None and meta.sample == "curl"
    out = os.path.join(scratch, "catalog")
    FS.write_run_catalog(FS.read_meta(spark, scratch), out)
    rec = spark.read.json(out).first()
    assert rec.duration_sec == pytest.approx(2.5)


def test_corpus_strict_and_lenient(spark, scratch):
    header = ",".join(S.FEATURE_COLUMNS)
    for sample, runs in (("a", ["features", "features2"]), ("b", ["features"])):
        d = os.path.join(scratch, "goodware", sample)
        os.makedirs(d, exist_ok=True)
        for r in runs:
            with open(os.path.join(d, r + ".csv"), "w") as f:
                f.write(header + "\n" + ",".join(["0"] * len(S.FEATURE_COLUMNS)) + "\n")
    assert FS.read_corpus(spark, scratch, ["features2"]).count() == 1
    with pytest.raises(FileNotFoundError):
        FS.read_corpus(spark, scratch, ["features2"], strict=True)


def test_feature_sink_keeps_schema(spark, scratch):
    empty = spark.createDataFrame([], S.FEATURE_SCHEMA)
    out = os.path.join(scratch, "feat")
    FS.write_features(empty, out)
    assert spark.read.parquet(out).columns == list(S.FEATURE_COLUMNS)


def test_stream_matches_batch(spark, scratch):
    src = os.path.join(scratch, "in", "s1")
    os.makedirs(src)
    lines = ['1 100.01 read(3, "a", 2) = 2', '1 100.05 write(4, "b", 3) = 3',
             '1 100.15 unlink("/a.txt") = 0', '1 100.42 read(5, "/dev/urandom", 8) = 8']
    with open(os.path.join(src, "strace.log"), "w") as f:
        f.write("\n".join(lines) + "\n")
    stream = SC.stream_trace_dir(spark, os.path.join(scratch, "in") + "/*")
    q = (SC.window_counters(stream, ["sample"], watermark="1 hour").writeStream
         .outputMode("complete").format("memory").queryName("x1_counters")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.sample, r.window.start): (r.lines, r.bytes_read, r.bytes_written, r.file_deletions,
                                        r.urandom_bytes)
           for r in spark.sql("SELECT * FROM x1_counters").collect()}
    batch_src = spark.createDataFrame([("s1", ln) for ln in lines], "sample string, line string")
    batch = SC.window_counters(parse_trace_lines(batch_src), ["sample"], watermark=None)
    exp = {(r.sample, r.window.start): (r.lines, r.bytes_read, r.bytes_written, r.file_deletions,
                                        r.urandom_bytes) for r in batch.collect()}
    assert got == exp and len(got) == 3


def test_snapshot_scan_and_rollup(spark, scratch):
    from tessera.operators.content import read_snapshot_files, snapshot_rollup
    d = os.path.join(scratch, "snap", "sub")
    os.makedirs(d)
    open(os.path.join(d, "a.bin"), "wb").write(bytes(range(256)) * 4)
    open(os.path.join(scratch, "snap", "b.txt"), "wb").write(b"aaaa")
    files = {os.path.basename(r.path): r for r in read_snapshot_files(spark, os.path.join(scratch, "snap")).collect()}
    assert files["a.bin"].entropy == pytest.approx(8.0) and files["b.txt"].entropy == 0.0
    assert files["a.bin"].size == 1024
    roll = snapshot_rollup(read_snapshot_files(spark, os.path.join(scratch, "snap")).withColumn("snap", F.lit(1)),
                           ["snap"]).first()
    assert roll.file_count == 2 and roll.total_bytes == 1028 and roll.mean_entropy == pytest.approx(4.0)


def test_sample_subset_is_bounded(spark):
    from tessera.operators.ml import sample_subset
    df = spark.range(1000)
    s = sample_subset(df, 128).collect()
    assert len(s) == 128 and len({r.id for r in s}) == 128


def test_stream_drops_rows_behind_watermark(spark, scratch):
    src = os.path.join(scratch, "late", "s1")
    os.makedirs(src)
    q = None
    try:
        stream = SC.stream_trace_dir(spark, os.path.join(scratch, "late") + "/*", max_files_per_trigger=1)
        q = (SC.window_counters(stream, ["sample"], window="1 second", watermark="2 seconds")
             .writeStream.outputMode("append").format("memory").queryName("x1_late")
             .option("checkpointLocation", os.path.join(scratch, "ck2")).start())
        batches = [['1 100.5 read(3, "a", 2) = 2'],
                   ['1 200.5 read(3, "a", 4) = 4'],      # moves the watermark to 198.5
                   ['1 100.7 read(3, "a", 8) = 8'],      # late: window [100, 101) is closed
                   ['1 300.5 read(3, "a", 1) = 1']]      # closes [200, 201)
        for i, b in enumerate(batches):
            with open(os.path.join(src, f"part{i}.log"), "w") as f:
                f.write("\n".join(b) + "\n")
            q.processAllAvailable()
        got = {int(r.window.start.timestamp()): r.bytes_read
               for r in spark.sql("SELECT * FROM x1_late").collect()}
        assert got[100] == 2 and got[200] == 4  # the late 8 bytes were dropped
    finally:
        if q is not None:
            q.stop()


def test_anchored_stream_matches_batch(spark, scratch):
    from tessera.operators import features as FT
    from tessera.streaming import anchored as AN
    from tests.test_features import RUN
    src = os.path.join(scratch, "anch", "s1")
    os.makedirs(src)
    # the run arrives in three files, in order; positions continue across files
    chunks = [RUN[0:3], RUN[3:7], RUN[7:]]
    q = None
    try:
        raw = (spark.readStream.format("text").option("maxFilesPerTrigger", 1)
               .load(os.path.join(scratch, "anch") + "/*"))
        from tessera.functions.trace import parse_trace_lines
        lines = raw.select(F.lit("s1").alias("sample"), F.col("value").alias("line"))
        parsed = parse_trace_lines(lines)
        q = (AN.anchored_partials(parsed, "sample", window_s=0.1).writeStream
             .outputMode("append").format("memory").queryName("x1_anchor")
             .option("checkpointLocation", os.path.join(scratch, "ck3")).start())
        for i, ch in enumerate(chunks):
            with open(os.path.join(src, f"part{i}.log"), "w") as f:
                f.write("\n".join(ch) + "\n")
            q.processAllAvailable()
        got = {(r.wid): r for r in AN.counters_from_partials(spark.table("x1_anchor"), ["sample"]).collect()}
    finally:
        if q is not None:
            q.stop()
    batch_src = spark.createDataFrame([("s1", i, ln) for i, ln in enumerate(RUN)],
                                      "sample string, line_order long, line string")
    p = parse_trace_lines(batch_src)
    anchor = FT.run_anchor(p, ["sample"])
    ww = FT.window_ids(p, anchor.withColumn("max_wid", F.lit(0)), ["sample"], 0.1)
    exp = {r.wid: r for r in FT.window_counters(ww, ["sample"]).collect()}
    assert set(got) == set(exp)
    for w in exp:
        for c in FT.COUNTERS:
            assert got[w][c] == exp[w][c], (w, c)


def test_snapshot_heads_of_huge_empty_and_unreadable_files(spark, scratch):
    from tessera.operators.content import file_head, head_entropy, read_snapshot_heads, snapshot_rollup
    root = os.path.join(scratch, "heads")
    os.makedirs(os.path.join(root, "a b", "c%20d"))
    with open(os.path.join(root, "huge"), "wb") as f:  # sparse: 3 GB in size, a few blocks on disk
        f.write(bytes(range(256)) * 256)
        f.truncate(3 << 30)
    open(os.path.join(root, "empty"), "wb").close()
    with open(os.path.join(root, "a b", "c%20d", "é.bin"), "wb") as f:
        f.write(b"ab" * 10)
    got = {os.path.basename(r.path): (r["size"], r.entropy) for r in read_snapshot_heads(spark, root).collect()}
    assert got == {"huge": (3 << 30, 8.0), "empty": (0, 0.0), "é.bin": (20, 1.0)}
    assert file_head(os.path.join(root, "gone"), 10) is None and file_head(f"file://{root}/huge", 3) == b"\x00\x01\x02"
    gone = spark.createDataFrame([(1, "file:" + os.path.join(root, "gone"), 5), (1, os.path.join(root, "huge"), 7), (1, root, 0), (1, None, 0)],
                                 "snap int, path string, size long")
    seen = gone.withColumn("entropy", head_entropy(F.col("path"), 65536))
    assert [r.entropy for r in seen.orderBy("size", "path").collect()] == [None, None, None, 8.0]
    roll = snapshot_rollup(seen, ["snap"]).first()
    assert roll.file_count == 4 and roll.mean_entropy == 8.0
    os.symlink(root, os.path.join(root, "a b", "loop"))
    assert read_snapshot_heads(spark, root).count() == 3 and read_snapshot_heads(spark, os.path.join(root, "none")).count() == 0
