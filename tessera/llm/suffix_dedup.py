"""Exact removal of repeated byte strings by a sparse, bucketed suffix sort.

Every byte that a string of ``length`` bytes covers which also starts anywhere
else is removed. Sorting all suffixes would copy each one's first ``length``
bytes to its place, so suffixes are sorted at anchors only:

* of the ``gram``-byte grams in a window of ``length`` bytes the one with the
  least hash (the leftmost of equals) is the window's anchor. Equal windows
  have equal anchors at equal places. Consecutive windows with one anchor form
  a segment, about one for each quarter of a window;
* segments whose gram occurs once hold no repeated window. Where all segments
  of a gram are equal, or a segment occurs twice, its windows are repeated as a
  whole. Only counts are shuffled for these;
* what is left, segments that differ but share their gram, is sorted in
  buckets, one for each gram: the texts after and (reversed) before the anchor
  by deep-shallow sorting, a multikey quicksort on 8-byte characters to a
  shallow depth and blind tries for the groups that still agree there. Two
  windows at one distance from their anchors are equal if the common prefixes
  on both sides are long enough, which the sorted orders' adjacent prefixes
  tell for all windows of a bucket at once;
* a gram with more than ``BUCKET`` different segments isn't gathered: its
  windows are counted one by one by two hashes, with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import materialize

LENGTH = 400
GRAM = 200  # half of the length unless another is given
BUCKET = 4096
SHALLOW = 4  # 8-byte characters sorted by quicksort
BLOCK = 1 << 19  # bytes whose anchors are found at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# ---------------------------------------------------------------- anchors

_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        ones = np.ones(max(n, BLOCK + 2 * LENGTH), np.uint64)
        up, down = ones * _BASE, ones * _INVERSE
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def string_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each string of ``size`` bytes, by its start."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    out = (total[size:] - total[:n]) * down[:n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least (leftmost of equals), by block-wise prefix and suffix minima."""
    n = len(hashes)
    key = (hashes & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
    full = -(-n // width) * width
    grid = np.full(full, ~np.uint64(0))
    grid[:n] = key
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(back[:count], ahead[width - 1:width - 1 + count]) & np.uint64((1 << 21) - 1)).astype(np.int64)


def segments(raw: bytes, first: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of the documents that lie at ``first`` in ``raw``: (document, start, end, anchor) in ``raw``, and gram hashes."""
    data = np.frombuffer(raw, np.uint8)
    hashes = string_hashes(data, gram)
    width = length - gram + 1
    if len(hashes) < width:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    anchor = window_anchors(hashes, width)
    ends = first + sizes
    doc = np.searchsorted(first, np.arange(len(anchor)), side="right") - 1
    ok = np.arange(len(anchor)) + length <= ends[doc]
    at = np.flatnonzero(ok)
    if not len(at):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    new = np.append(True, (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]))
    begin = np.flatnonzero(new)
    start, last = at[begin], at[np.append(begin[1:], len(at)) - 1]
    return doc[start], start, last + length, anchor[start], hashes[anchor[start]]


ANCHORS = "k1 long, k2 long, place long, g long, c long"


def find_anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) to a row for each segment: place packs start, length and the anchor's distance; c hashes its bytes."""
    for batch in batches:
        keys = [batch.column(i).to_numpy() for i in (0, 1)]
        held: list[bytes] = []
        of: list[int] = []
        shift: list[int] = []

        def flush() -> pa.RecordBatch | None:
            raw = b"".join(held)
            sizes = np.array([len(h) for h in held], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            doc, start, end, anchor, found = segments(raw, first, sizes, length, gram)
            content = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
            row = np.array(of, np.int64)[doc]
            place = (start - first[doc] + np.array(shift, np.int64)[doc]) << 20 | (end - start) << 10 | (anchor - start)
            held.clear(), of.clear(), shift.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array(place), pa.array(found.view(np.int64)), pa.array(content.view(np.int64))],
                                              names=["k1", "k2", "place", "g", "c"])

        size = 0
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py()
            raw = text.encode("utf-8") if text else b""
            # a long text goes in blocks that overlap by all but one byte of a window
            for at in range(0, max(1, len(raw) - length + 1), BLOCK):
                part = raw[at:at + BLOCK + length - 1]
                if len(part) < length:
                    continue
                if size + len(part) > BLOCK and held:
                    yield flush()
                    size = 0
                held.append(part)
                of.append(i)
                shift.append(at)
                size += len(part)
        if held:
            yield flush()


# ---------------------------------------------------------------- deep-shallow sort

class BlindTrie:
    """Orders strings that share a long prefix: inner nodes keep the place of the first difference only."""

    def __init__(self) -> None:
        self.root: list | None = None  # [place, {byte: child}] or [-1, string, [members]]

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        """Length of the common prefix of two strings of one length."""
        differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        return len(a) if not differ else len(a) - 1 - (differ.bit_length() - 1) // 8

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = [-1, text, [member]]
            return
        node, path = self.root, []
        while node[0] >= 0:  # go down blindly, by the bytes at the nodes' places
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        shared = self.common(text, node[1])
        if shared == len(text):
            node[2].append(member)
            return
        leaf = [-1, text, [member]]
        above, below = None, self.root
        for place in path:
            if place[0] > shared:
                break
            if place[0] == shared:
                place[1][text[shared]] = leaf
                return
            above, below = place, place[1].get(text[place[0]])
        inner = [shared, {node[1][shared]: below, text[shared]: leaf}]
        if above is None:
            self.root = inner
        else:
            above[1][text[above[0]]] = inner

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(bucket: np.ndarray, grid: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by (bucket, bytes): their order, and each one's common prefix with the one before (-1 across buckets)."""
    n, width = grid.shape
    wide = -(-width // 8) * 8
    padded = np.zeros((n, wide), np.uint8)
    padded[:, :width] = grid
    chars = padded.view(">u8").astype(np.uint64)
    order = np.argsort(bucket, kind="stable")
    rank = np.cumsum(np.append(0, np.diff(bucket[order]) != 0)) if n else np.empty(0, np.int64)
    for depth in range(min(shallow, chars.shape[1])):
        # multikey quicksort: rows equal so far are parted by their next character
        by = np.lexsort((chars[order, depth], rank))
        order, rank = order[by], rank[by]
        char = chars[order, depth]
        rank = np.cumsum(np.append(0, (rank[1:] != rank[:-1]) | (char[1:] != char[:-1]))) if n else rank
    if n and chars.shape[1] > shallow:
        edges = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        for a, b in zip(edges.tolist(), np.append(edges[1:], n).tolist()):
            if b - a > 1:  # a group that agrees to the shallow depth
                trie = BlindTrie()
                for member in order[a:b].tolist():
                    trie.insert(padded[member].tobytes(), member)
                order[a:b] = trie.ordered()
    common = np.full(n, -1, np.int64)
    if n > 1:
        prev, cur = order[:-1], order[1:]
        same = bucket[prev] == bucket[cur]
        differ = chars[prev] ^ chars[cur]
        word = np.argmax(differ != 0, axis=1)
        first = differ[np.arange(n - 1), word]
        bits = np.frompyfunc(lambda v: v.bit_length(), 1, 1)(first.astype(object)).astype(np.int64)
        common[1:] = np.where(same, np.where(first == 0, wide, word * 8 + (64 - bits) // 8), -1)
    return order, common


def repeated_windows(bucket: np.ndarray, content: list[bytes], anchor: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Flags (segment, distance of the window's start before the anchor) of windows that another segment of the bucket has too.

    ``bucket`` is sorted; ``anchor`` is the anchor's place in each segment.
    """
    n, reach = len(content), length - gram
    size = np.array([len(c) for c in content], np.int64)
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    for i, (c, a) in enumerate(zip(content, anchor.tolist())):
        data = np.frombuffer(c, np.uint8)
        after = data[a:a + length]
        right[i, :len(after)] = after
        before = data[max(0, a - reach):a][::-1]
        left[i, :len(before)] = before
    # windows that the segment has: distances from the last window's to the first one's
    least, most = np.maximum(anchor - (size - length), 0), anchor
    # the gram itself is equal in a bucket but for chance, so sorting starts behind it and its equality is tested with the rest
    r_order, r_common = deep_shallow(bucket, np.concatenate([right[:, gram:], right[:, :gram]], axis=1))
    gram_ok = np.ones(n, bool)
    if n > 1:
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        lead = np.repeat(edges, np.diff(np.append(edges, n)))
        gram_ok = (right[:, :gram] == right[lead, :gram]).all(axis=1)
    l_order, l_common = deep_shallow(bucket, left)
    l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
    out = np.zeros((n, reach + 1), bool)
    for o in range(reach + 1):
        rows = np.flatnonzero((least <= o) & (o <= most) & gram_ok)
        if len(rows) < 2:
            continue
        l_class[l_order] = np.cumsum(l_common < o)
        r_class[r_order] = np.cumsum(r_common < length - gram - o)
        key = l_class[rows] * (n + 1) + r_class[rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.append(same, False) | np.append(False, same)
        out[rows[by[hit]], o] = True
    if not gram_ok.all():  # hashes of different grams met: compare these segments' windows one by one
        seen: dict[tuple, list] = {}
        for i in np.flatnonzero(np.isin(bucket, np.unique(bucket[~gram_ok]))).tolist():
            for o in range(int(least[i]), int(most[i]) + 1):
                a = int(anchor[i]) - o
                seen.setdefault((int(bucket[i]), o, content[i][a:a + length]), []).append(i)
        for (_, o, _), members in seen.items():
            if len(members) > 1:
                out[members, o] = True
    return out


SPANS = "k1 long, k2 long, lo long, hi long"


def sort_buckets(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, n, k1, k2, start, anchor, content) sorted by g to the repeated spans of segments that occur once."""
    held: pa.Table | None = None

    def resolve(rows: pa.Table) -> pa.RecordBatch:
        g = rows.column("g").to_numpy()
        bucket = np.cumsum(np.append(0, g[1:] != g[:-1]))
        anchor = rows.column("anchor").to_numpy()
        flags = repeated_windows(bucket, rows.column("content").to_pylist(), anchor, length, gram)
        flags[rows.column("n").to_numpy() > 1] = False  # known to be repeated as a whole
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, least = np.nonzero(edge == 1)
        most = np.nonzero(edge == -1)[1] - 1
        at = rows.column("start").to_numpy()[row] + anchor[row]
        return pa.RecordBatch.from_arrays([pa.array(rows.column("k1").to_numpy()[row]), pa.array(rows.column("k2").to_numpy()[row]), pa.array(at - most), pa.array(at - least + length)],
                                          names=["k1", "k2", "lo", "hi"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        g = held.column("g").to_numpy()
        whole = int(np.flatnonzero(g == g[-1])[0])  # the last bucket may go on
        if whole:
            yield resolve(held.slice(0, whole).combine_chunks())
            held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield resolve(held)


def count_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, n, k1, k2, start, content) of overfull buckets to one row for each window: its two hashes, weight and place."""
    for batch in batches:
        for g, n, k1, k2, start, content in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "k1", "k2", "start", "content"))):
            hashes = string_hashes(np.frombuffer(content, np.uint8), length)
            m = len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, v, np.int64)) for v in (g, n, k1, k2)] + [pa.array(hashes.view(np.int64)), pa.array(start + np.arange(m))],
                                             names=["g", "n", "k1", "k2", "w", "lo"])


# ---------------------------------------------------------------- the job

def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, the text (null: empty) and two hashes of both that name the row in shuffles; equal rows share them."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    name = F.coalesce(docs[id_col].cast("string"), F.lit("\0null"))
    return docs.select(docs[id_col].alias("__id"), text.alias("__text"), F.xxhash64(name, text).alias("k1"), F.xxhash64(text, F.lit(1), name).alias("k2"))


def repeated_spans(rows: DataFrame, by_row: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """k1, k2, lo, hi: byte spans whose windows are all repeated. ``by_row`` is ``rows`` dealt out by its two keys."""
    gram = gram or length // 2
    if not 0 < gram <= length or 2 * length - gram >= 1024:
        raise ValueError("a segment of 2 * length - gram bytes must be shorter than 1024, a gram at most the length")
    found = rows.select("k1", "k2", "__text").mapInArrow(lambda batches: find_anchors(batches, length, gram), ANCHORS)
    grams = found.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("n > 1")
    grams = materialize(grams.select("g", (F.col("c0") == F.col("c1")).alias("alike")), "suffix-grams")
    shared = materialize(found.join(grams, "g"), "suffix-segments")
    start, size, distance = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023), F.col("place").bitwiseAND(1023)
    span = ["k1", "k2", start.alias("lo"), (start + size).alias("hi")]

    mixed = shared.filter("not alike")
    classes = materialize(mixed.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("k1").alias("k1"), F.min_by("k2", "k1").alias("k2"),
                                                      F.min_by("place", "k1").alias("place")), "suffix-classes")
    often = classes.filter("n > 1").select("g", "c")
    spans = shared.filter("alike").select(*span).unionByName(mixed.join(often, ["g", "c"]).select(*span))

    # grams with a segment that occurs once: one representative of each of their different segments
    open_grams = materialize(classes.groupBy("g").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("least = 1 and classes > 1")
                             .select("g", "classes"), "suffix-open")
    wanted = classes.join(open_grams, "g").select("k1", "k2", F.struct("g", "n", "classes", start.alias("start"), size.alias("size"), distance.alias("anchor")).alias("s"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("s").alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for k1, k2, text, want in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "__text", "wanted"))):
                    raw = text.encode("utf-8")
                    out += [(w["g"], w["n"], w["classes"], k1, k2, w["start"], w["anchor"], raw[w["start"]:w["start"] + w["size"]]) for w in want]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)

    spec = "g long, n long, classes long, k1 long, k2 long, start long, anchor long, content binary"
    schema = to_arrow_schema(StructType.fromDDL(spec))
    types = schema.types
    cuts = by_row.select("k1", "k2", "__text").join(wanted, ["k1", "k2"]).mapInArrow(cut, spec)
    cuts = materialize(cuts, "suffix-contents")
    few = cuts.filter(F.col("classes") <= BUCKET).drop("classes").repartition("g").sortWithinPartitions("g")
    spans = spans.unionByName(few.mapInArrow(lambda batches: sort_buckets(batches, length, gram), SPANS))

    windows = cuts.filter(F.col("classes") > BUCKET).mapInArrow(lambda batches: count_windows(batches, length), "g long, n long, k1 long, k2 long, w long, lo long")
    again = materialize(windows.groupBy("g", "w").agg(F.sum("n").alias("n"), F.count("*").alias("m")).filter("n > 1").select("g", "w"), "suffix-windows")
    hits = windows.filter("n = 1").join(again, ["g", "w"]).select("k1", "k2", "lo", (F.col("lo") + length).alias("hi"))
    return spans.unionByName(hits)


def merged(spans) -> list[tuple[int, int]]:
    """Union of [lo, hi) spans; touching ones are one run."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """__id, __text and the row's spans (array of lo, hi; null if none)."""
    rows = keyed(docs, id_col, text_col)
    by_row = rows.repartition("k1", "k2")
    spans = repeated_spans(rows, by_row, length, gram)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return by_row.join(spans, ["k1", "k2"], "left").select("__id", "__text", "spans")


def without(raw: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    """The pieces that are left without the runs."""
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    return [*kept, raw[at:]]


def whole_characters(pieces: list[bytes]) -> str:
    """Text of the pieces; a character cut in two goes as a whole, so that bytes of two of them don't form a third."""
    return "".join(p.decode("utf-8", "ignore") for p in pieces)


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """What removal of repeated strings leaves of each text: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    The digest is of the bytes left, kept_text holds their whole characters.
    Null and empty texts have no bytes; texts shorter than a string keep all;
    a repeated row repeats its strings; a null id is a row like any other; an
    empty table gives no rows; other columns are ignored; texts are read whole.
    """
    dtype = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, runs = text.encode("utf-8"), merged((s["lo"], s["hi"]) for s in spans or ())
                kept = without(raw, runs)
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), whole_characters(kept) if runs else text))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))],
                                             names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    spec = f"`{id_col}` {dtype}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return with_spans(docs, id_col, text_col, length, gram).mapInArrow(digest, spec)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """The same rows and columns, each text without its repeated strings of ``length`` bytes.

    A character cut in two by a removed run goes as a whole. Null stays null;
    equal rows get equal texts.
    """
    name, text = F.coalesce(docs[id_col].cast("string"), F.lit("\0null")), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = keyed(docs, id_col, text_col)
    by_row = rows.repartition("k1", "k2")
    spans = repeated_spans(rows, by_row, length, gram).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))
    spans = spans.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__spans")
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None and own:
                text = whole_characters(without(text.encode("utf-8"), merged((s["lo"], s["hi"]) for s in own)))
            out.append(text)
        return pa.array(out, pa.string())

    named = docs.select(F.struct(*docs.columns).alias("__row"), F.xxhash64(name, text).alias("__k1"), F.xxhash64(text, F.lit(1), name).alias("__k2"))
    joined = named.join(spans, ["__k1", "__k2"], "left")
    own = {c: F.col("__row").getField(c) for c in docs.columns}
    own[text_col] = cut(own[text_col].cast("string"), F.col("__spans"))
    return joined.select(*(v.alias(c) for c, v in own.items()))
