"""Content operators: byte entropy, snapshot rollup, fingerprints.

Byte entropy needs a 256-bin histogram of each blob. Exploding every byte
into a row would multiply the data by its size, so the histogram is built
inside the task with NumPy over Arrow batches (``pandas_udf``); the work is
per row, needs no shuffle, and Spark partitions it.
"""

from __future__ import annotations

import os
import re
from typing import Sequence
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import materialize


def _entropy_of(b) -> float:
    if b is None:
        return float("nan")
    arr = np.frombuffer(bytes(b), dtype=np.uint8)
    if arr.size == 0:
        return 0.0
    counts = np.bincount(arr, minlength=256)
    p = counts[counts > 0] / arr.size
    return float(-(p * np.log2(p)).sum())


@F.pandas_udf(T.DoubleType())
def _byte_entropy_udf(blobs: pd.Series) -> pd.Series:
    return blobs.map(_entropy_of)


def byte_entropy(content: Column, max_bytes: int | None = None) -> Column:
    """Shannon entropy (log2, 0..8) of the bytes of ``content``.

    ``content`` may be binary or string (UTF-8 bytes). ``max_bytes`` reads only
    a head of each blob, as a file sampler would; by default the whole blob
    is used. An empty blob gives 0.0, a null one null.
    """
    b = content if max_bytes is None else F.substring(content, 1, max_bytes)
    e = _byte_entropy_udf(b)
    return F.when(content.isNull(), F.lit(None).cast("double")).otherwise(e)


def _local(path: str) -> str | None:
    """The local form of a path, ``None`` if it is in another store."""
    return re.sub("^file:(//(?=/))?", "", path) if path.startswith("file:") or ":/" not in path else None


def file_head(path: str, limit: int) -> bytes | None:
    """The first ``limit`` bytes of a file, ``None`` if it can't be opened or read.

    Local paths and ``file:`` are opened directly, other stores by Arrow's
    file systems; a kind of store that Arrow doesn't know is an error.
    """
    local = _local(path)
    try:
        if local is not None:
            with open(local, "rb") as f:
                return f.read(limit)
        store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        with store.open_input_stream(inner) as f:
            return f.read(limit)
    except OSError:
        return None


def folder_entries(path: str) -> list[tuple[str, int | None, bool]]:
    """(path, size, is a folder) of what a folder holds: regular files and folders, links not followed; none if it can't be read."""
    local = _local(path)
    try:
        if local is not None:
            with os.scandir(local) as entries:
                kept = [e for e in entries if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
                return [(e.path, None, True) if e.is_dir(follow_symlinks=False) else (e.path, e.stat(follow_symlinks=False).st_size, False) for e in kept]
        store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        base = path.rstrip("/")
        return [(f"{base}/{i.base_name}", i.size, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(inner))]
    except OSError:
        return []


def head_entropy(path: Column, limit: int) -> Column:
    """A33 of the first ``limit`` bytes of the file at ``path``; null for unreadable files and null paths."""

    @F.pandas_udf(T.DoubleType())
    def of(paths: pd.Series) -> pd.Series:
        heads = paths.map(lambda p: None if p is None else file_head(p, limit))
        return heads.map(lambda b: None if b is None else _entropy_of(b)).astype("Float64")

    return of(path)


def as_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def snapshot_rollup(files: DataFrame, keys: Sequence[str], entropy_col: str = "entropy",
                    size_col: str = "size") -> DataFrame:
    """Per snapshot, mean entropy of readable files, file count, total bytes.

    Unreadable files (null entropy) count as files but not in the mean.
    """
    return files.groupBy(*keys).agg(
        F.coalesce(F.avg(entropy_col), F.lit(0.0)).alias("mean_entropy"),
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum(size_col), F.lit(0)).cast("bigint").alias("total_bytes"))


def fingerprint(content: Column) -> Column:
    """SHA-256 hex digest of the content bytes."""
    return F.sha2(content, 256)


def exact_duplicates(df: DataFrame, content_col: str, id_col: str,
                     keys: Sequence[str] = ()) -> DataFrame:
    """A35 + U4: groups of identical content: digest, copies, first id, ids' sources.

    One shuffle on the digest; each group keeps only counters and the
    smallest id, so a hot digest (a third of all rows) is a partial
    aggregate, not a list.
    """
    fp = df.withColumn("sha256", fingerprint(F.col(content_col)))
    aggs = [F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")]
    aggs += [F.count_distinct(k).alias(f"distinct_{k}") for k in keys]
    return fp.groupBy("sha256").agg(*aggs).filter(F.col("copies") > 1)


def read_snapshot_files(spark, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``path`` with size and whole content entropy; Spark's scan leaves empty files out (``read_snapshot_heads`` keeps them)."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return raw.select(F.col("path"), F.col("length").alias("size"),
                      byte_entropy(F.col("content"), max_bytes).alias("entropy"))


HEAD_BYTES = 64 * 1024  # what the file sampler read of each file


def walk(spark, path: str) -> DataFrame:
    """path and size of every regular file below ``path``, empty ones too; one round of tasks for each level of folders.

    A folder is listed by one task, and each level is written to the shared
    folder, so no list of files passes through the driver. Links are not
    followed; a folder that can't be read or isn't there gives no rows.
    """
    n, schema = int(spark.conf.get("spark.sql.shuffle.partitions")), "path string, size long, folder boolean"

    def entries(batches):
        for pdf in batches:
            for folder in pdf["path"]:
                found = folder_entries(folder)
                for at in range(0, len(found), 10000):
                    part = found[at:at + 10000]
                    yield pd.DataFrame({"path": [p for p, _, _ in part], "size": pd.array([z for _, z, _ in part], "Int64"), "folder": [f for _, _, f in part]})

    files, folders = None, spark.createDataFrame([(path,)], "path string")
    while True:
        level = materialize(folders.repartition(n, "path").mapInPandas(entries, schema), "snapshot-level")
        here = level.filter(~F.col("folder")).select("path", "size")
        files = here if files is None else files.unionByName(here)
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            return files


def read_snapshot_heads(spark, path: str, limit: int = HEAD_BYTES) -> DataFrame:
    """S11 as sampled: every regular file below ``path`` with its true size and the entropy of its first ``limit`` bytes.

    The walk gives names and sizes, dealt out by path, so a file of any size
    is one small row and a folder with most of the files is read by many
    tasks. A file that can't be opened or read keeps its row, with a null
    entropy; an empty one has 0.0; a folder without files gives no rows.
    """
    files = walk(spark, path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.select("path", "size", head_entropy(F.col("path"), limit).alias("entropy"))
