"""Packing of documents into fixed-length sequences: shortest-pack-first over the length histogram.

Three steps, none of which holds more than a bounded table outside Spark:

1. ``tokenize`` writes one row for each document: its length, the checksums of
   its whole pieces, the ids of its last piece (fewer than ``capacity``), the
   task it was in and its rank among that task's pieces of the same length.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to
   ``plan_packs``, which places lengths longest first, each into the open pack
   with the least filled, and keeps counts of packing patterns instead of
   packs. What room is left at the end is filled by cutting pieces of the
   emptiest patterns, and the one last pack is cut at powers of two.
3. The patterns' placements, ranges of ranks within a length, are joined back
   to the documents by rank. Ranks come from counts by (task, length), so no
   length's documents meet in one task.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ChunkIds, held, id_text, materialize, no_cycle_search, tokenizer_path

CAPACITY = 1024


# ---------------------------------------------------------------- ids

def byte_level_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def chunk_encoder(path: str):
    """Function from a chunk of text to its packed ids, as the tokenizers library gives them for this file.

    The file's vocabulary is a table of byte strings whose ids are in merge
    order, so a compiled rank merger gives the library's ids for each match of
    the split pattern (tests hold it against the library); chunks with an added
    token go to the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    from tessera.llm.bpe_monoid import MARKS, split_pattern

    whole = Tokenizer.from_file(path)
    added = {i: t.content for i, t in whole.get_added_tokens_decoder().items()}
    byte_of = {c: b for b, c in byte_level_chars().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in whole.get_vocab(with_added_tokens=False).items() if i not in added}
    pattern = split_pattern()
    merge = tiktoken.Encoding("byte-level", pat_str=pattern.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    find, marks = pattern.findall, tuple(added.values())

    def encode(chunk: str) -> bytes:
        for mark in marks:
            if mark in chunk:
                return array("I", whole.encode(chunk, add_special_tokens=False).ids).tobytes()
        # letters and then marks without an apostrophe are two matches; the pattern tells for all else
        word = chunk.rstrip(MARKS)
        if word[1:].isalpha() and word[0] == " ":
            ids = merge(word.encode())
            if len(word) < len(chunk):
                ids = ids + merge(chunk[len(word):].encode())
        else:
            ids = [i for piece in find(chunk) for i in merge(piece.encode())]
        return array("I", ids).tobytes()

    return encode


def tokenize(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = 0,
             cache_size: int = 3 << 16, folder: str | None = None) -> DataFrame:
    """One row for each document: doc_tokens, checksums of whole pieces, ids of the last piece, task and ranks."""
    dtype = dict(docs.dtypes)[id_col]
    spec = (f"`{id_col}` {dtype}, doc_tokens long, whole_crc array<long>, tail binary, task long, whole_rank long, tail_rank long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path("byte_bpe_50k.json", folder)
        coder = held(("byte-level ids", path, cache_size), lambda: ChunkIds(chunk_encoder(path), cache_size))
        context = TaskContext.get()
        task, ranks, wholes = context.partitionId() if context else 0, defaultdict(int), 0
        end = np.array([end_id], "<u4")
        with no_cycle_search():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    total, crcs, tails, first, rank = [], [], [], [], []
                    for text in part.column(1).to_pylist():
                        ids = np.concatenate([coder.ids(text).astype("<u4"), end])
                        n = len(ids) // capacity
                        total.append(len(ids))
                        crcs.append([zlib.crc32(ids[k * capacity:(k + 1) * capacity].tobytes()) for k in range(n)])
                        tail = ids[n * capacity:]
                        tails.append(tail.tobytes())
                        first.append(wholes)
                        rank.append(ranks[len(tail)])
                        wholes += n
                        ranks[len(tail)] += 1
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()),
                         pa.array([task] * len(total), pa.int64()), pa.array(first, pa.int64()), pa.array(rank, pa.int64())],
                        names=[id_col, "doc_tokens", "whole_crc", "tail", "task", "whole_rank", "tail_rank"])

    return id_text(docs, id_col, text_col).mapInArrow(run, spec)


# ---------------------------------------------------------------- patterns

def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY, slack: int | None = None, most: int = 1 << 16) -> list[tuple[int, ...]]:
    """Placements of the pieces of a length histogram: (length, low, high, cut, size, sequence, offset).

    The pieces of ``length`` with ranks low..high-1 put ``size`` of their ids,
    from the ``cut``-th on, at ``offset`` in sequence ``sequence`` + rank - low.
    All counts and no single packs: the work depends on the number of distinct
    lengths, not on the number of documents. Packs with more room than
    ``slack`` are filled by cutting pieces: all of them by default, or where
    that takes more than ``most`` patterns, those with more room than
    capacity / 64.
    """
    if slack is not None:
        return _plan(histogram, capacity, slack, None)
    plan = _plan(histogram, capacity, 0, most)
    return _plan(histogram, capacity, capacity // 64, None) if plan is None else plan


def _plan(histogram: dict[int, int], capacity: int, slack: int, most: int | None) -> list[tuple[int, ...]] | None:
    """The placements, or None if there are more than ``most`` patterns."""
    # An open pattern is [count, filled, slots]; a slot is (length, first rank, cut, size): the pattern's
    # k-th pack holds the piece of rank first + k. by_fill finds the pattern with the least filled.
    by_fill: dict[int, list] = defaultdict(list)
    fills: list[int] = []
    done: list[tuple[int, list]] = []

    full = capacity

    def put(count: int, filled: int, slots: list) -> None:
        if filled >= full:
            done.append((count, slots))
            return
        if not by_fill[filled]:
            bisect.insort(fills, filled)
        by_fill[filled].append((count, slots))

    def take(filled: int) -> tuple[int, list]:
        got = by_fill[filled].pop()
        if not by_fill[filled]:
            fills.remove(filled)
        return got

    def split(slots: list, by: int) -> list:
        return [(length, first + by, cut, size) for length, first, cut, size in slots]

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if fills and fills[0] + length <= capacity:
                filled = fills[0]
                count, slots = take(filled)
                used = min(count, left)
                if count > used:
                    put(count - used, filled, split(slots, used))
                put(used, filled + length, slots + [(length, rank, 0, length)])
            else:
                used = left
                put(used, length, [(length, rank, 0, length)])
            rank, left = rank + used, left - used

    full = capacity - slack
    for filled in [f for f in fills if f >= full]:
        fills.remove(filled)
        done.extend(by_fill.pop(filled))

    # Fill what room is left: cut the last piece of the emptiest pattern's packs to the room of the fullest.
    while fills:
        if most is not None and len(done) > most:
            return None
        if len(fills) == 1 and len(by_fill[fills[0]]) == 1 and by_fill[fills[0]][0][0] == 1:
            break
        low, high = fills[0], fills[-1]
        d_count, d_slots = take(low)
        if low == high and not by_fill[high]:
            # one pattern only: some of its packs give to the others
            r_count = d_count // 2
            r_slots, d_slots = d_slots, split(d_slots, r_count)
            d_count -= r_count
        else:
            r_count, r_slots = take(high)
        room = capacity - high
        length, first, cut, size = d_slots[-1]
        move = min(room, size)
        used = min(d_count, r_count)
        if d_count > used:
            put(d_count - used, low, split(d_slots, used))
        if r_count > used:
            put(r_count - used, high, split(r_slots, used))
        put(used, high + move, r_slots + [(length, first, cut + size - move, move)])
        rest = d_slots[:-1] + ([(length, first, cut, size - move)] if size > move else [])
        if rest:
            put(used, low - move, rest)

    # The last pack: sequences whose lengths are powers of two need no padding.
    for filled in list(fills):
        for count, slots in by_fill[filled]:
            sizes = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
            queue = list(slots)
            for room in sizes:
                own = []
                while room:
                    length, first, cut, size = queue.pop(0)
                    part = min(size, room)
                    own.append((length, first, cut, part))
                    room -= part
                    if size > part:
                        queue.insert(0, (length, first, cut + part, size - part))
                done.append((count, own))

    out, sequence = [], 0
    for count, slots in done:
        offset = 0
        for length, first, cut, size in slots:
            out.append((length, first, first + count, cut, size, sequence, offset))
            offset += size
        sequence += count
    return out


# ---------------------------------------------------------------- join back

def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0,
                   folder: str | None = None) -> DataFrame:
    """Pack the ids of all documents, each followed by ``end_id``, into sequences of ``capacity`` ids.

    Returns one row for each piece: ``id_col``, start (the document's ids
    before it), length, ids_crc32 (of little-endian 32-bit ids), doc_tokens,
    sequence_id, offset. Every id lies in exactly one piece and offsets in a
    sequence leave no gap. Null and empty texts have the end id alone; repeated
    rows are packed each; an empty table gives no rows; other columns are
    ignored. Documents longer than a sequence fill whole sequences first.
    """
    spark = docs.sparkSession
    rows = materialize(tokenize(docs, id_col, text_col, capacity, end_id, folder=folder), "packing-ids")
    tail_length = (F.octet_length("tail") / 4).cast("int")

    # How many pieces of each length every task has, and how many the tasks before it have.
    lengths = rows.select("task", F.explode(F.array(
        F.struct(F.lit(capacity).alias("length"), F.size("whole_crc").cast("long").alias("n")),
        F.struct(tail_length.alias("length"), F.lit(1).cast("long").alias("n")))).alias("p")).select("task", "p.length", "p.n")
    counts = lengths.filter("n > 0 and length > 0").groupBy("task", "length").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-offsets")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows

    # Whole pieces stand alone in the first sequences.
    whole = histogram.pop(capacity, 0)
    plan = [(n, low, high, cut, size, whole + seq, off) for n, low, high, cut, size, seq, off in plan_packs(histogram, capacity)]
    plan = np.array(sorted(plan), np.int64).reshape(-1, 7)
    table = spark.sparkContext.broadcast(plan)  # patterns by counts: bounded by the number of lengths, squared

    pieces = rows.select(id_col, "doc_tokens", "whole_crc", "tail", "task", "whole_rank", "tail_rank", tail_length.alias("length"))
    tail_base = offsets.select("task", "length", F.col("base").alias("tail_base"))
    whole_base = offsets.filter(F.col("length") == capacity).select("task", F.col("base").alias("whole_base"))
    joined = pieces.join(tail_base, ["task", "length"], "left").join(whole_base, "task", "left").select(
        id_col, "doc_tokens", "whole_crc", "tail", (F.coalesce("whole_base", F.lit(0)) + F.col("whole_rank")).alias("whole_rank"),
        (F.coalesce("tail_base", F.lit(0)) + F.col("tail_rank")).alias("tail_rank"))
    dtype = dict(docs.dtypes)[id_col]
    spec = (f"`{id_col}` {dtype}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = {int(rows[0, 0]): rows[:, 1:] for rows in np.split(table.value, np.flatnonzero(np.diff(table.value[:, 0])) + 1) if len(rows)}
        ends = {n: np.maximum.accumulate(rows[:, 1]) for n, rows in plans.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                source, out = [], []
                for k, (tokens, crcs, tail, first, rank) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 6)))):
                    for i, crc in enumerate(crcs):
                        out.append((i * capacity, capacity, crc, tokens, first + i, 0))
                    n, begin = len(tail) // 4, len(crcs) * capacity
                    if n:
                        own = plans[n]
                        at_plan = int(np.searchsorted(ends[n], rank, side="right"))
                        while at_plan < len(own) and own[at_plan][0] <= rank:
                            low, high, cut, size, seq, off = own[at_plan].tolist()
                            if rank < high:
                                out.append((begin + cut, size, zlib.crc32(tail[4 * cut:4 * (cut + size)]), tokens, seq + rank - low, off))
                            at_plan += 1
                    source += [k] * (len(out) - len(source))
                cols = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source, pa.int64())), *cols],
                                                 names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return joined.mapInArrow(place, spec)
