"""Helpers shared by the corpus operators: table access, shared folders, text splitting."""

from __future__ import annotations

import contextlib
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a task turns into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a tokenizer file: in ``folder`` if one is given, else where the package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    The folder the cluster names is used as it is. Where none is named the
    folder that the context already has is used; only a local master gets a
    scratch folder of its own, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tessera-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-llm/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files instead of repeating
    the work above, and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_shared(spark: SparkSession) -> None:
    """Delete what this application's operators wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What ``make`` gives, made once for each Python worker and kept across its tasks (``key`` names it)."""
    if key not in _HELD:
        for old in [k for k in _HELD if k[0] == key[0]]:
            del _HELD[old]  # one of a kind: bounded
        _HELD[key] = make()
    return _HELD[key]


@contextlib.contextmanager
def no_cycle_search():
    """Python's search for reference cycles off while a task fills large caches that hold none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so other columns can't clash; null text is empty."""
    return docs.select(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(text_col))


def map_text(df: DataFrame, text_col: str, schema: str, each: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """Replace the text column by the columns of ``schema``, one Python tuple for each row.

    ``each`` is called once for a task and returns the function on one text.
    Batches are handled in slices of ``SLICE_ROWS`` rows, so that a task holds
    few Python strings at a time.
    """
    keep = [f for f in df.schema.fields if f.name != text_col]
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), schema])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each()
        with no_cycle_search():
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    rows = [work(t) for t in part.column(text_col).to_pylist()]
                    cols = [part.column(n) for n in names]
                    cols += [pa.array(c, type=t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(cols, schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(spec))
    types = out.types[len(names):]
    return df.mapInArrow(run, spec)


class BoundedCache(dict):
    """A worker's cache in two generations: ``make`` fills misses, ``fixed`` entries stay.

    When the young generation holds ``limit`` entries it becomes the old one,
    whose entries come back when used. Only speed depends on the limit, never a
    result.
    """

    def __init__(self, make: Callable, limit: int, fixed: dict | None = None) -> None:
        super().__init__(fixed or {})
        self.make, self.fixed, self.old = make, fixed or {}, {}
        self.limit = limit + len(self.fixed)

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        self[key] = value
        return value


def space_chunks(text: str) -> list[str]:
    """Cut ``text`` before each space that stands between two characters other than white space.

    No match of the byte-level split pattern crosses such a place: a match has
    white space only at its start or is white space as a whole. Token ids of a
    text are therefore those of its chunks in turn.
    """
    out, parts = [], text.split(" ")
    cur = parts[0]
    for p in parts[1:]:
        if cur and p and not cur[-1].isspace() and not p[0].isspace():
            out.append(cur)
            cur = " " + p
        else:
            cur += " " + p
    out.append(cur)
    return out


def clean_edges(part: str) -> bool:
    """Whether cutting before and after this part (what stands between two spaces) is a cut of ``space_chunks``."""
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


class ChunkIds:
    """Token ids of whole texts from a cache of chunks (a word with the space before it).

    ``encode`` gives the ids of one chunk as packed unsigned 32-bit numbers.
    """

    def __init__(self, encode: Callable[[str], bytes], cache_size: int) -> None:
        self.pack = encode
        self.spaced = BoundedCache(lambda p: encode(" " + p) if clean_edges(p) else None, cache_size)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        first, *rest = text.split(" ")
        found = list(map(self.spaced.__getitem__, rest))
        if None in found or not first or first[-1].isspace():
            # white space beside a space: cut only where it is safe
            known = self.spaced
            found = [known[c[1:]] if c[:1] == " " and clean_edges(c[1:]) and " " not in c[1:] else self.pack(c) for c in space_chunks(text)]
        else:
            found.insert(0, self.pack(first))
        return np.frombuffer(b"".join(found), np.uint32)
