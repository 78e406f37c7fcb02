"""Token counts by a two-tier map-side lookup, without a shuffle of pre-tokens.

A pre-token is a word with the space before it. The sentence-piece vocabulary
has no piece with a space mark after another character, so no merge crosses
the place before a space mark and the count of a text is the sum over its
pre-tokens. Tier one is a compact table (words and one byte for each length)
of the corpus's frequent pre-tokens, broadcast; its size is bounded by
``table_size``. Tier two is a bounded cache in each Python worker that has the
library encode what tier one lacks.

The frequent pre-tokens come from Misra-Gries summaries of all documents, one
bounded summary for each task, merged in two levels; only summaries are
shuffled. Which words they hold decides speed alone, not a count.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BoundedCache, held, id_text, map_text, tokenizer_path

MARK = "▁"  # what the vocabulary writes for a space


def prune(counts: Counter, size: int) -> Counter:
    """Misra-Gries: take the (size+1)-th largest count off every count, keep what is positive."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({w: c - cut for w, c in counts.items() if c > cut})


def pack_counts(counts: Counter) -> bytes:
    words = "\0".join(counts).encode("utf-8", "surrogatepass")
    return struct.pack("<q", len(counts)) + struct.pack(f"<{len(counts)}q", *counts.values()) + words


def unpack_counts(blob: bytes) -> Counter:
    (n,) = struct.unpack_from("<q", blob)
    if not n:
        return Counter()
    return Counter(dict(zip(blob[8 + 8 * n:].decode("utf-8", "surrogatepass").split("\0"), struct.unpack_from(f"<{n}q", blob, 8))))


def frequent_words(docs: DataFrame, text_col: str, size: int, split=None, fan_in: int = 64) -> list[str]:
    """Up to ``size`` frequent words of all texts (mergeable Misra-Gries summaries, merged in two levels).

    Every word with more than n/(size+1) of the n occurrences is among them.
    Words with a zero character are left out. An empty table gives none.
    """
    split = split or _split_space

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    if text:
                        counts.update(split(text))
                if len(counts) > 16 * size:
                    counts = prune(counts, size)
        counts = Counter({w: c for w, c in counts.items() if w and "\0" not in w})
        context = TaskContext.get()
        yield pa.RecordBatch.from_arrays(
            [pa.array([context.partitionId() if context else 0], pa.int64()), pa.array([pack_counts(prune(counts, size))], pa.binary())],
            names=["part", "summary"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for blob in pdf["summary"]:
            counts.update(unpack_counts(blob))
            if len(counts) > 8 * size:
                counts = prune(counts, size)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "summary": [pack_counts(prune(counts, size))]})

    spec = "part long, summary binary"
    parts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(summarize, spec)
    merged = parts
    for r in range(1, 5):  # a group has at most ``fan_in`` summaries, up to fan_in ** 4 tasks
        merged = merged.groupBy(F.floor(F.col("part") / fan_in**r)).applyInPandas(merge, spec)
    total = merged.groupBy(F.col("part") * 0).applyInPandas(merge, spec).collect()
    if not total:
        return []
    found = unpack_counts(bytes(total[0]["summary"]))
    return [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))]


def _split_space(text: str) -> list[str]:
    return text.split(" ")


def chunk_keys(text: str) -> list[str]:
    """Pre-tokens without their first space: empty parts and parts that end in the mark join the next one."""
    out, held = [], None
    for p in text.split(" "):
        cur = p if held is None else held + " " + p
        if cur == "" or cur[-1] in (" ", MARK):
            held = cur
        else:
            out.append(cur)
            held = None
    if held is not None:
        out.append(held)
    return out


def processor(path: str):
    """The library's processor, loaded once for each Python worker."""
    import sentencepiece

    return held(("sentencepiece", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 table_size: int = 8192, cache_size: int = 1 << 18, folder: str | None = None) -> DataFrame:
    """Tokens of each text as the sentence-piece library counts them.

    Returns ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``),
    one row for each input row. Null and empty texts have 0 bytes and tokens;
    repeated rows are counted each; an empty table gives no rows; other
    columns are ignored. Special strings such as ``<s>`` are ordinary text, as
    in the library.
    """
    sp = processor(tokenizer_path("piece_bpe_32k.model", folder))
    words = [w for w in frequent_words(docs, text_col, table_size) if w[-1] != MARK]
    compact = ("\0".join(words), bytes(min(len(x), 255) for x in sp.encode(words, num_threads=1)) if words else b"")
    shared = docs.sparkSession.sparkContext.broadcast(compact)

    def each():
        library = processor(tokenizer_path("piece_bpe_32k.model", folder))
        joined, sizes = shared.value
        fixed = {w: n for w, n in zip(joined.split("\0"), sizes) if n < 255} if sizes else {}

        def encoded(key: str) -> int:
            # -1 for a part that has to be joined to the next one
            return -(1 << 40) if key == "" or key[-1] == MARK else len(library.encode(key))

        lengths = held(("lengths", joined, cache_size), lambda: BoundedCache(encoded, cache_size, fixed))
        get = lengths.__getitem__

        def count(text: str) -> tuple[int]:
            if not text:
                return (0,)
            total = sum(map(get, text.split(" ")))
            if total < 0:
                # an empty last part is one space mark, a piece of its own
                total = sum((len(library.encode(k)) or 1) if k == "" or k[-1] in (" ", MARK) else get(k) for k in chunk_keys(text))
            return (total,)

        return count

    df = id_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length(F.col(text_col)).cast("long"))
    out = map_text(df, text_col, "n_tokens long", each)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
