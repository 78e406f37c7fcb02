"""Exact top-k inner-product search on a bit-sliced index.

Components are quantised to integers. A block of rows is kept as bitmaps, one
for each bit slice of each component's upper bits. For a block of queries the
weighted slices are added with bitmap arithmetic (shift, and, exclusive or,
carry), which gives bit slices of every row's approximate score; the best k
rows are read from the most significant slice downward. The lower bits that
the slices leave out bound the error, so rows near the k-th place are scored
exactly and the result is exact, ties included.

Rows and queries meet in blocks: every row block is joined to every query
block by the pair of block numbers, both sides spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

ROW_BLOCK = 8192
QUERY_BLOCK = 256
SPAN = 32  # queries added at a time in a task: bounds its bitmaps


def padded(vectors: list, dims: int) -> np.ndarray:
    """Rows of a block as one matrix; a shorter vector has zeros after its last component."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Pack flags (rows last) to 64-bit words, little end first."""
    n = flags.shape[-1]
    width = -(-n // 64) * 64
    full = np.zeros((*flags.shape[:-1], width), np.uint8)
    full[..., :n] = flags
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


class SlicedBlock:
    """Bit slices of the upper bits of a block's components, as offsets from each component's least."""

    def __init__(self, rows: np.ndarray, keep_bits: int = 6) -> None:
        self.rows, self.n = rows, len(rows)
        self.low = rows.min(axis=0)
        offset = rows - self.low
        bits = max(1, int(offset.max(initial=0)).bit_length())
        self.drop = max(0, bits - keep_bits)
        self.high = offset >> self.drop
        self.bits = max(1, bits - self.drop)
        self.slices = [bitmaps(((self.high >> b) & 1).T.astype(np.uint8)) for b in range(self.bits)]  # each: components x words

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(weight x high) for non-negative weights after flipping: queries x words, least first.

        A component with a negative weight adds |weight| x (top - high): its
        bitmaps are inverted. Weights go in by Horner's rule from their highest bit.
        """
        size, flip = np.abs(weights), weights < 0
        total: list[np.ndarray] = []
        for bit in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):
            if total:
                total.insert(0, np.zeros_like(total[0]))
            for d in range(weights.shape[1]):
                on = ((size[:, d] >> bit) & 1).astype(bool)
                if not on.any():
                    continue
                mask = np.where(on, ~np.uint64(0), np.uint64(0))[:, None]
                turn = np.where(flip[:, d], ~np.uint64(0), np.uint64(0))[:, None]
                carry = None
                for b in range(max(self.bits, len(total))):
                    add = ((self.slices[b][d][None, :] ^ turn) & mask) if b < self.bits else None
                    if b >= len(total):
                        if add is None:
                            break
                        total.append(add if carry is None else add ^ carry)
                        carry = None if carry is None else add & carry
                        continue
                    if add is None and carry is None:
                        break
                    old = total[b]
                    if add is None or carry is None:
                        one = add if carry is None else carry
                        total[b], carry = old ^ one, old & one
                    else:
                        half = old ^ add
                        total[b], carry = half ^ carry, (old & add) | (half & carry)
                if carry is not None and carry.any():
                    total.append(carry)
        return total

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its candidates among the rows: (query, rows, exact scores), a superset of the best k.

        ``own``: the query's own row in this block, or -1.
        """
        words = self.slices[0].shape[1]
        valid = bitmaps(np.ones(self.n, np.uint8))
        for at in range(0, len(queries), SPAN):
            part = queries[at:at + SPAN]
            total = self.sums(part)
            # what the dropped bits can add to a score, in units of the sums
            slack = np.abs(part).sum(axis=1)
            for q in range(len(part)):
                ok = valid.copy()
                if own[at + q] >= 0:
                    ok[own[at + q] >> 6] &= ~(np.uint64(1) << np.uint64(own[at + q] & 63))
                sure, maybe, count, value = np.zeros(words, np.uint64), ok, 0, 0
                if int(np.bitwise_count(ok).sum()) > k:
                    for b in range(len(total) - 1, -1, -1):  # most significant slice first: find the k-th value
                        ones = maybe & total[b][q]
                        n = int(np.bitwise_count(ones).sum())
                        if count + n >= k:
                            maybe, value = ones, value | 1 << b
                        else:
                            sure, maybe, count = sure | ones, maybe & ~total[b][q], count + n
                    # rows whose sum is at least the k-th value less the slack may belong to the best k
                    maybe = self._at_least(total, q, value - int(slack[q]), ok) if self.drop else sure | maybe
                rows = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))
                yield at + q, rows, self.rows[rows] @ part[q]

    @staticmethod
    def _at_least(total: list[np.ndarray], q: int, bound: int, ok: np.ndarray) -> np.ndarray:
        """Bitmap of rows whose sum is ``bound`` or more."""
        if bound <= 0:
            return ok
        if bound.bit_length() > len(total):
            return np.zeros_like(ok)
        more, same = np.zeros_like(ok), ok.copy()
        for b in range(len(total) - 1, -1, -1):
            if bound >> b & 1:
                same &= total[b][q]
            else:
                more |= same & total[b][q]
                same &= ~total[b][q]
        return more | same


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024,
          row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row whose id is divisible by ``every``.

    Components become floor(scale * x). Returns query_id, rank, ``id_col``,
    score; ties go to the smaller id. A vector that is null or holds null or
    non-finite components, and a row with null id, take no part. A shorter
    vector counts as zero beyond its end. Rows that share an id are rows of
    their own: each is a query or candidate by itself, and a query's candidates
    are all rows but the one it is. An empty table gives no rows; other columns
    are ignored. Components so large that a score might not fit 62 bits are an
    error.
    """
    x = F.transform(vectors[vector_col], lambda v: v.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), x.alias("x")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    whole = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    most = F.array_max(F.transform("x", lambda v: F.abs(v) * float(scale)))
    rows = materialize(rows.select("id", whole.alias("v"), most.alias("most"), F.monotonically_increasing_id().alias("row")), "topk-rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.max(F.size("v")).alias("d"), F.max("most").alias("most")).first()
    dims = max(1, sizes["d"] or 1)
    if ((sizes["most"] or 0.0) + 1.0) ** 2 * dims >= 2.0**62:
        raise ValueError("components are too large for exact 64-bit scores")
    row_blocks, query_blocks = max(1, -(-sizes["n"] // row_block)), max(1, -(-sizes["q"] // query_block))

    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    both = rows.withColumn("is_query", F.col("id") % every == 0)
    data = both.select(spread(row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "row", "id", "v", F.lit(False).alias("is_query"))
    asked = both.filter("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), spread(query_blocks).alias("qb"), "row", "id", "v", "is_query")

    def search(table: pa.Table) -> pa.Table:
        ids, keys = table.column("id").to_numpy(), table.column("row").to_numpy()
        matrix = padded(table.column("v").to_pylist(), dims)
        is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        own_ids, queries, asked_ids, own_keys, asked_keys = ids[~is_query], matrix[is_query], ids[is_query], keys[~is_query], keys[is_query]
        found: list[tuple[np.ndarray, ...]] = []
        if len(own_ids) and len(asked_ids):
            block = SlicedBlock(matrix[~is_query])
            order = np.argsort(own_keys)
            at = np.minimum(np.searchsorted(own_keys[order], asked_keys), len(order) - 1)
            own = np.where(own_keys[order][at] == asked_keys, order[at], -1)
            for q, near, score in block.top(queries, own, k):
                best = np.lexsort((own_ids[near], -score))[:k]
                found.append((np.full(len(best), asked_keys[q]), np.full(len(best), asked_ids[q]), own_ids[near][best], score[best]))
        cols = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found) if found else ([],) * 4)]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("row", "query_id", "id", "score"), cols)})

    blocks = data.unionByName(asked).groupBy("rb", "qb")
    partial = blocks.applyInArrow(search, "row long, query_id long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
