"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles. Two of
them within ``max_bits`` differing bits are linked; components of the links are
the groups. Links are found on distinct fingerprints:

* the 64 bits are grouped into partitions, correlated bits together, from
  bit statistics of all fingerprints;
* partition i gets a threshold t_i (-1: not used) with sum(t_i + 1) = max_bits + 1.
  If two fingerprints differ in at most ``max_bits`` bits, some partition has at
  most t_i differing bits, for otherwise the sum of differences would exceed
  ``max_bits``. Number of partitions and thresholds come from a dynamic program
  over estimated signature and candidate counts;
* every fingerprint is filed under its value in each partition and, where t_i
  is positive, under each value within t_i bits. Members of a bucket are
  verified by their distance. A bucket yields a spanning forest of its links
  at most, never all pairs; buckets above ``CHUNK`` members are split into
  pairs of chunks that meet in tasks of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text, map_text, materialize

BITS = 64
CHUNK = 4096
SEED = 42
SIGNATURE_COST, CANDIDATE_COST = 100.0, 1.0  # relative cost of filing a fingerprint and of verifying a pair
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words: int = 4) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half the shingle hashes. No word: 0."""
    parts = text.encode("utf-8").translate(_LOWER).split()  # on the six ASCII spaces
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    ends = list(itertools.accumulate([len(p) + 1 for p in parts]))
    starts = [0, *ends[:n - 1]]
    hashes = np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[words - 1:])), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        votes += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id_col`` and fp (the fingerprint's bits as a signed long) of each row."""
    def each():
        def one(text: str) -> tuple[int]:
            value = fingerprint(text, words)
            return (value - (1 << 64) if value >> 63 else value,)

        return one

    return map_text(id_text(docs, id_col, text_col), text_col, "fp long", each)


# ---------------------------------------------------------------- partitions and thresholds

def bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have each pair of bits set, over all of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                bits = bit_matrix(batch.column(0).slice(at, 4096).to_numpy()).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), -1), pa.int32()), pa.array(np.append(j.ravel(), -1), pa.int32()),
                                          pa.array(np.append(total.ravel(), n), pa.int64())], names=["i", "j", "n"])

    rows = nodes.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 64 x 64 + 1
    together, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            together[r["i"], r["j"]] = r["n"]
    return n, together


def correlated_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into groups of near equal size, each grown by the bit most correlated with it."""
    share = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs((together / max(1, n) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for p in range(parts):
        size = -(-len(left) // (parts - p))
        first = max(left, key=lambda b: (corr[b, list(left)].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def within(group: list[int], n: int, together: np.ndarray, reach: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t bits of the group, for t = 0..reach."""
    share = np.diag(together) / max(1, n)
    dist = [1.0] + [0.0] * reach
    for b in group:
        differ = 2 * share[b] * (1 - share[b])
        dist = [dist[t] * (1 - differ) + (dist[t - 1] * differ if t else 0.0) for t in range(reach + 1)]
    return list(np.cumsum(dist))


def allocate(n: int, together: np.ndarray, max_bits: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds of least estimated cost: (bits, threshold), unused partitions left out."""
    best: tuple[float, list] = (math.inf, [])
    for parts in range(1, min(most_parts, max_bits + 1) + 1):
        groups = correlated_groups(n, together, parts)
        # state: sum of (t + 1) so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            chance = within(group, n, together, max_bits)
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in states.items():
                for t in range(-1, max_bits - used + 1):
                    more = cost
                    if t >= 0:
                        filed = sum(math.comb(len(group), k) for k in range(min(t, len(group)) + 1))
                        more += SIGNATURE_COST * n * filed + CANDIDATE_COST * n * n * chance[t] * filed / 2
                    if used + t + 1 <= max_bits + 1 and more < after.get(used + t + 1, (math.inf,))[0]:
                        after[used + t + 1] = (more, [*chosen, t])
            states = after
        cost, chosen = states.get(max_bits + 1, (math.inf, []))
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


# ---------------------------------------------------------------- links

def merge_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the sets of a[i] and b[i]; ``parent`` points at the least member found so far."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def bucket_forest(bucket: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the verified links inside buckets: arrays of members and of their sets' first members.

    ``bucket`` is sorted; members are compared at growing distances in their bucket.
    """
    n = len(fps)
    parent = np.arange(n)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, n))
    left = np.repeat(first + sizes, sizes)  # end of each row's bucket
    at = np.flatnonzero(left - np.arange(n) > 1)
    step = 1
    while len(at):
        a = at
        b = a + step
        near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        if near.any():
            merge_links(parent, a[near], b[near])
        step += 1
        at = at[left[at] - at > step]
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    child = np.flatnonzero(parent != np.arange(n))
    return fps[child], fps[parent[child]]


def find_links(nodes: DataFrame, plan: list[tuple[list[int], int]], max_bits: int) -> DataFrame:
    """Links between distinct fingerprints: fp, near (both long), a spanning forest for each bucket."""
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for p, (bits, t) in enumerate(plan):
                    value = part_values(fps, bits)
                    for k in range(t + 1):
                        for flips in itertools.combinations(range(len(bits)), k):
                            key = value ^ np.uint64(sum(1 << f for f in flips))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), p), pa.int32()), pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))],
                                                             names=["part", "key", "fp"])

    filed = nodes.select("fp").mapInArrow(file, "part int, key long, fp long")
    hot = materialize(filed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK), "simhash-hot")
    hot = hot.select("part", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    cut = filed.join(hot, ["part", "key"], "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    pair = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: F.least(d, F.col("chunk")) * F.col("chunks") + F.greatest(d, F.col("chunk"))))
    spread = cut.select("part", "key", F.explode(pair).alias("pair"), "fp")
    buckets = spread.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def forest(rows: pa.Table) -> pa.RecordBatch:
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("part", "key", "pair")])
            new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)) if rows.num_rows else np.empty(0, bool)
            a, b = bucket_forest(np.cumsum(new), rows.column("fp").to_numpy().view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["fp", "near"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            last = [held.column(c)[held.num_rows - 1].as_py() for c in ("part", "key", "pair")] if held.num_rows else None
            if last is None:
                continue
            same = np.ones(held.num_rows, bool)
            for c, v in zip(("part", "key", "pair"), last):
                same &= held.column(c).to_numpy() == v
            whole = int(np.flatnonzero(same)[0])  # the last bucket may go on
            if whole:
                yield forest(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield forest(held)

    return buckets.mapInArrow(verify, "fp long, near long")


# ---------------------------------------------------------------- components

def components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """node, root: every linked node with the least node of its component (alternating large and small stars).

    Each round's results are written to the shared folder. Minima are written
    before they are joined, so that a node with very many links is split among
    tasks by the skew join.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = materialize(edges, "component-edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-least")
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "component-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "component-low")
        joined = large.join(low, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "component-edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """Groups of documents whose fingerprints are linked: ``id_col``, fingerprint, component_id.

    fingerprint is 16 lower-case hexadecimal digits; component_id the smallest
    id reachable over links, the row's own included. A null, empty or blank
    text has fingerprint zero and links like any other. Repeated rows are each
    returned; a null id gets a component but never names one (null where a
    component has no other id); an empty table gives no rows; other columns are
    ignored.
    """
    rows = materialize(fingerprint_texts(docs, id_col, text_col, words), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    n, together = bit_statistics(nodes)
    if not n:
        return rows.select(id_col, F.lit("").alias("fingerprint"), F.col(id_col).alias("component_id"))
    roots = components(find_links(nodes, allocate(n, together, max_bits), max_bits), "fp", "near")
    rooted = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows, unchanged, one document of each group: the one with the smallest id.

    Rows are told apart by id and text, so rows that share an id are documents
    of their own, and a row with null id meets its copies like any other and is
    kept where its group has no id. Of equal rows (id and text) one stays. An
    empty table gives no rows.
    """
    from pyspark.sql import Window

    text, name = F.coalesce(docs[text_col].cast("string"), F.lit("")), F.coalesce(docs[id_col].cast("string"), F.lit("\0null"))
    k1, k2 = F.xxhash64(name, text), F.xxhash64(text, F.lit(1), name)
    key = F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), k1.alias("k1"), k2.alias("k2"))
    groups = near_duplicates(docs.select(key.alias("key"), text.alias("text")), "key", "text", words, max_bits)
    kept = groups.filter(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2")).distinct()
    kept = materialize(kept, "simhash-kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), k1.alias("k1"), k2.alias("k2")).join(kept, ["k1", "k2"], "left_semi")
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).filter("n = 1")
    return one.select("row.*")
