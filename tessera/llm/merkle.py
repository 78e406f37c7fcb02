"""Merkle manifest of a dataset by time-forward processing.

Rows become leaves, ordered inside a group; every ``FAN`` consecutive nodes
become one until a group's subroot is left; the subroots, ordered by group,
become the root in the same way. A node's label is the place of its last leaf,
then its level, so that children have smaller labels than their parents:

* the forward sweep reads nodes by rising label and sends each digest as a
  message to the parent's label. A priority queue ordered by label holds the
  messages inside a block of ``FAN ** RISE`` leaves; what goes beyond the block is
  written, and the sorted shuffle of the next round is the queue's external
  part. A group of n leaves takes log(n) / log(block) rounds, its blocks spread
  over tasks;
* the reversed sweep reads the same nodes by falling label. Each node takes the
  proof suffix that its parent sent to its label, and sends every child that
  child's siblings in front of the suffix. Leaves end up with whole proofs and
  are folded back to the root.

Places of leaves come from counts by (written partition, group), so a group
with a third of all rows is sorted in many tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tessera.llm.common import materialize

BITS = 4
FAN = 1 << BITS
RISE = 3  # levels of a round: blocks of FAN ** RISE leaves
_LAST = (1 << 62)  # label of a block's incoming message: before all nodes in a reversed sweep


def levels(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of the columns in turn: ``-`` for null, else byte count, ``:`` and the value."""
    part = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*part), 256)


def group_key(group: Column) -> Column:
    """A string without nulls that orders like the group's text, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place ``idx`` in their group ``grp`` and the group's size ``n``."""
    placed = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, f"{name}-sorted").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("part", "grp").agg(F.min("at").alias("lo"), F.count("*").alias("size"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    runs = runs.select("part", "grp", "lo", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy("grp")).alias("n"))
    joined = placed.join(materialize(runs, f"{name}-runs"), ["part", "grp"])
    return joined.withColumn("idx", F.col("at") - F.col("lo") + F.col("base")).drop("at", "part", "lo", "base")


# ---------------------------------------------------------------- forward sweep

NODES = "grp string, block long, level int, idx long, last long, n long, children binary, digest binary"
_ARROW = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("last", pa.int64()), ("n", pa.int64()),
                    ("children", pa.binary()), ("digest", pa.binary())])


def sweep_up(batches: Iterator[pa.RecordBatch], rise: int) -> Iterator[pa.RecordBatch]:
    """Leaves (grp, idx, n, digest) by block and place to the inner nodes of their blocks."""
    queue: list[tuple[int, int, int, bytes]] = []  # label of the parent (last leaf, level), place of the child, digest
    out: list[tuple] = []
    grp, block, n, top = None, -1, 0, 0

    def send(level: int, idx: int, digest: bytes) -> None:
        """The digest goes to its parent, one level up."""
        up = level + 1
        last = min(((idx >> BITS) + 1 << BITS * up) - 1, n - 1)
        heapq.heappush(queue, (last, up, idx, digest))

    def run_until(place: int) -> None:
        """Nodes whose last leaf comes before ``place`` have all their messages."""
        while queue and queue[0][0] < place:
            last, level, child, digest = heapq.heappop(queue)
            got, idx = [digest.hex()], child >> BITS
            while queue and queue[0][0] == last and queue[0][1] == level:
                got.append(heapq.heappop(queue)[3].hex())
            text = "".join(got)
            own = hashlib.sha256(text.encode()).digest()
            out.append((grp, block, level, idx, last, n, bytes.fromhex(text), own))
            if level < top:
                send(level, idx, own)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * len(_ARROW)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    for batch in batches:
        for g, i, size, digest in zip(*(batch.column(c).to_pylist() for c in ("grp", "idx", "n", "digest"))):
            if g != grp or i >> BITS * rise != block:
                run_until(_LAST)
                grp, block, n, top = g, i >> BITS * rise, size, min(rise, levels(size))
            run_until(i)
            send(0, i, digest)
        if len(out) >= 4096:
            yield flush()
    run_until(_LAST)
    yield flush()


def _blocks(n: Column, rise: int) -> Column:
    """Blocks that ``n`` nodes make."""
    return F.shiftright(n + (FAN**rise - 1), BITS * rise)


def climb(leaves: DataFrame, name: str, rise: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Nodes of every round, every round's leaves (grp, idx, n, digest), and the groups' tops (grp, n, digest).

    ``n`` of a top is its group's number of leaves. The rounds are as many as
    the largest group needs; the driver learns that size only.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds, level0, tops = [], [leaves], leaves.filter("n = 1").select("grp", F.col("n").alias("size"), "digest")
    size = leaves.filter("idx = 0").select("grp", F.col("n").alias("size"))
    while most > 1:
        here = level0[-1].filter("n > 1").select("grp", "idx", "n", "digest", F.shiftright("idx", BITS * rise).alias("block"))
        spread = here.repartition("grp", "block").sortWithinPartitions("grp", "idx")
        nodes = materialize(spread.mapInArrow(lambda batches: sweep_up(batches, rise), NODES), f"{name}-nodes")
        rounds.append(nodes)
        most = -(-most // FAN**rise)
        # a block's top is its one node at the round's last level
        is_top = (F.col("level") == rise) | (F.col("n") <= F.pow(F.lit(float(FAN)), F.col("level")))
        up = nodes.filter(is_top).select("grp", F.col("block").alias("idx"), _blocks(F.col("n"), rise).alias("n"), "digest")
        tops = tops.unionByName(up.filter("n = 1").join(size, "grp").select("grp", "size", "digest"))
        level0.append(up)
    return rounds, level0, materialize(tops, f"{name}-tops")


# ---------------------------------------------------------------- reversed sweep

PATH = "places array<int>, siblings array<binary>"
_STREAM = ["grp", "block", "last", "level", "kind", "size", "children", "subroot", "root", "places", "siblings"]


def sweep_down(extra: list, leaf_row, rise: int) -> Callable:
    """Task function: messages, nodes and leaves of blocks by falling label; ``leaf_row`` makes a row of each leaf and its message."""
    schema = to_arrow_schema(StructType(extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple] = []  # falling label, then what the parent sent
        held: tuple = ()
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in _STREAM]
            rest = [batch.column(i).to_pylist() for i in range(len(_STREAM), batch.num_columns)]
            own = zip(*rest) if rest else iter([()] * batch.num_rows)
            for (grp, block, last, level, kind, n, children, subroot, root, places, siblings), payload in zip(zip(*cols), own):
                if kind == 0:  # to the block's top, whichever label that has
                    queue, held = [], (subroot.hex(), root.hex(), grp)
                    path = [(p, s.hex()) for p, s in zip(places, siblings)]
                    queue.append((-min((block + 1) * FAN**rise - 1, n - 1), -min(rise, levels(n)), path))
                    continue
                to_last, to_level, path = heapq.heappop(queue)
                if (-to_last, -to_level) != (last, level):
                    raise ValueError(f"no message for node {grp!r} {last} {level}")
                if kind == 2:
                    out.append(leaf_row(held, last, path, payload))
                    continue
                text, width = children.hex(), BITS * (level - 1)
                first = last >> BITS * level << BITS  # place of the first child among the nodes of its level
                for k in range(len(text) // 64):
                    end = min((first + k + 1 << width) - 1, n - 1)
                    heapq.heappush(queue, (-end, 1 - level, [(k, text[:64 * k] + text[64 * k + 64:]), *path]))
            cols = list(zip(*out)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


def _descend(messages: DataFrame, nodes: DataFrame | None, leaves: DataFrame, payload: list[str], out: StructType, leaf_row, rise: int) -> DataFrame:
    """One round of the reversed sweep."""
    empty = {"size": "long", "children": "binary", "subroot": "binary", "root": "binary", "places": "array<int>", "siblings": "array<binary>"}
    types = dict(leaves.dtypes)

    def stream(df: DataFrame, kind: int, **have) -> DataFrame:
        cols = [have[c].alias(c) if c in have else F.lit(kind).alias(c) if c == "kind" else F.lit(None).cast(empty[c]).alias(c) for c in _STREAM]
        return df.select(*cols, *(F.col(c) if kind == 2 else F.lit(None).cast(types[c]).alias(c) for c in payload))

    c = F.col
    rows = stream(messages, 0, grp=c("grp"), block=c("block"), last=F.lit(_LAST), level=F.lit(0), size=c("n"), subroot=c("subroot"), root=c("root"),
                  places=c("places"), siblings=c("siblings"))
    if nodes is not None:
        rows = rows.unionByName(stream(nodes, 1, grp=c("grp"), block=c("block"), last=c("last"), level=c("level"), size=c("n"), children=c("children")))
    rows = rows.unionByName(stream(leaves, 2, grp=c("grp"), block=F.shiftright(c("idx"), BITS * rise), last=c("idx"), level=F.lit(0)))
    rows = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("last"), F.desc("level"))
    return rows.mapInArrow(sweep_down(list(out), leaf_row, rise), out)


def deliver(sent: DataFrame, rounds: list[DataFrame], level0: list[DataFrame], leaves: DataFrame, payload: list[str], out: StructType, leaf_row, name: str,
            rise: int) -> DataFrame:
    """Run the reversed sweep of all groups. ``sent`` has a row for each group: its size, subroot, root and the path above."""
    first = F.when(F.col("size") <= FAN**rise, 0)  # the round in which a group's top was made
    for r in range(1, max(len(rounds), 1)):
        first = first.when(F.col("size") <= FAN ** (rise * (r + 1)), r)
    sent = sent.withColumn("first", first)
    passed = StructType.fromDDL(f"grp string, block long, size long, subroot binary, root binary, {PATH}")
    below = None

    def onward(held, idx, path, payload):
        return (held[2], idx, payload[0], bytes.fromhex(held[0]), bytes.fromhex(held[1]), [p for p, _ in path], [bytes.fromhex(s) for _, s in path])

    for r in range(max(len(rounds), 1) - 1, -1, -1):
        # nodes that a group has in round r: its leaves by blocks
        width = FAN ** (rise * r)
        messages = sent.filter(F.col("first") == r).withColumn("block", F.lit(0).cast("long")).drop("first")
        messages = messages.unionByName(below) if below is not None else messages
        messages = messages.withColumn("n", _blocks(F.col("size"), rise * r))
        nodes = rounds[r] if r < len(rounds) else None
        if r:
            sizes = sent.select("grp", "size")
            here = level0[r].join(sizes, "grp").filter(F.col("size") > width).select("grp", "idx", "size")
            here = here.withColumnRenamed("size", "whole")
            below = materialize(_descend(messages, nodes, here, ["whole"], passed, onward, rise), f"{name}-suffixes")
        else:
            return _descend(messages, nodes, leaves, payload, out, leaf_row, rise)
    raise AssertionError


def fold(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that follows from a leaf's digest and its proof."""
    for place, siblings in path:
        digest = hashlib.sha256((siblings[:64 * place] + digest + siblings[64 * place:]).encode()).hexdigest()
    return digest


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source",
             id_col: str = "doc_id", presented: dict[str, Column] | None = None, rise: int = RISE) -> DataFrame:
    """One row for each document: ``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``presented`` replaces columns by what a holder shows today; the proofs and
    roots are those of the table as it is, and ``folded_root`` is recomputed
    from the presented leaf, so ``verified`` tells whether the row is unchanged.

    Null is a value of its own in every column. Groups are ordered by their
    text, null first; leaves by id (null first), rows that share an id by their
    digest, and equal rows are leaves each. ``rise`` sets how many levels a
    round of the sweeps has, which changes no result. A single leaf is its group's
    subroot, a single subroot the root. An empty table gives no rows. Other
    columns are ignored; texts are read whole.
    """
    presented = presented or {}
    cols = [docs[c] for c in columns]
    shown = [presented.get(c, docs[c]) for c in columns]
    leaf, other = leaf_digest(cols), leaf_digest(shown)
    rows = docs.select(docs[id_col].alias("id"), group_key(docs[group_col]).alias("grp"), F.unhex(leaf).alias("digest"), F.unhex(other).alias("shown"))
    # the digest shown takes room only where it differs; "at" parts equal rows
    rows = rows.withColumn("shown", F.when(F.col("shown") != F.col("digest"), F.col("shown"))).withColumn("tie", F.monotonically_increasing_id())
    leaves = numbered(materialize(rows, "merkle-leaves"), ["id", "digest", "tie"], "merkle").drop("tie")
    leaves = materialize(leaves, "merkle-numbered")

    rounds, level0, subroots = climb(leaves, "merkle", rise)
    # the groups' tops are the leaves of one more tree
    tops = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "size", "digest")
    tops = materialize(numbered(tops, ["source"], "merkle-root"), "merkle-root-numbered")
    upper, upper0, root = climb(tops, "merkle-root", rise)

    start = root.select("grp", "size", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<int>").alias("places"),
                        F.array().cast("array<binary>").alias("siblings"))
    sent = StructType.fromDDL(f"grp string, size long, subroot binary, root binary, {PATH}")

    def to_group(held, idx, path, payload):
        source, size, digest = payload
        return (source, size, digest, bytes.fromhex(held[1]), [p for p, _ in path], [bytes.fromhex(s) for _, s in path])

    # the group's size under another name: the stream has a size of its own
    tops = tops.withColumnRenamed("size", "whole")
    groups = materialize(deliver(start, upper, upper0, tops, ["source", "whole", "digest"], sent, to_group, "merkle-root", rise), "merkle-groups")

    dtype = docs.schema[id_col].dataType
    out = StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = StructType([StructField(id_col, dtype, True), *out.fields])

    def proof(held, idx, path, payload):
        doc, digest, shown = payload
        subroot, root, _ = held
        leaf = digest.hex()
        folded = fold(shown.hex() if shown is not None else leaf, path)
        return (doc, leaf, subroot, root, hashlib.sha256("".join(s for _, s in path).encode()).hexdigest(), folded, folded == root)

    return deliver(groups, rounds, level0, leaves, ["id", "digest", "shown"], out, proof, "merkle", rise)


def tampered_text(id_col: Column, text: Column) -> Column:
    """The text as a careless copy shows it: A-Z lower-cased where 5 divides the CRC-32 of the decimal id."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.translate(text, upper, upper.lower())).otherwise(text)


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with lower-cased texts presented for a fifth of the ids."""
    return manifest(docs, presented={"text": tampered_text(docs["doc_id"], docs["text"])})


# ---------------------------------------------------------------- DuckDB SQL

def oracle(doc_levels: int = 6, root_levels: int = 4) -> str:
    """The same manifest level by level in SQL, for groups of up to 16 ** levels nodes."""

    def enc(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    upper = "".join(map(chr, range(65, 91)))
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = ("list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
           "lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))")
    sql = [f"""WITH t AS (SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN translate(text, '{upper}', '{upper.lower()}') ELSE text END AS shown FROM documents),
h AS (SELECT doc_id, source, sha256({head} || {enc('text')}) AS leaf, sha256({head} || {enc('shown')}) AS other FROM t),
d0 AS (SELECT doc_id, source AS g, leaf AS d, other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h)"""]

    def tree(p: str, deep: int) -> None:
        for k in range(1, deep + 1):
            sql.append(f"{p}{k} AS (SELECT g, i // 16 AS i, string_agg(d, '' ORDER BY i) AS run, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, "
                       f"(max(n) + 15) // 16 AS n, max(n) AS m FROM {p}{k - 1} GROUP BY g, i // 16)")

    def paths(p: str, deep: int, carried: str) -> None:
        sql.append(f"{p}p0 AS (SELECT {carried}, g, d, i, '' AS proof, d AS folded FROM {p}0)" if p == "r" else f"{p}p0 AS (SELECT {carried}, g, d, i, '' AS proof, other AS folded FROM {p}0)")
        for k in range(1, deep + 1):
            own = f"64 * (a.i // {16 ** (k - 1)} % 16)::INTEGER"
            left, right = f"substring(b.run, 1, {own})", f"substring(b.run, {own} + 65)"
            kept = ", ".join(f"a.{c.split(' AS ')[-1].strip()}" for c in carried.split(","))
            sql.append(f"{p}p{k} AS (SELECT {kept}, a.g, a.d, a.i, CASE WHEN b.m > 1 THEN a.proof || {left} || {right} ELSE a.proof END AS proof, "
                       f"CASE WHEN b.m > 1 THEN sha256({left} || a.folded || {right}) ELSE a.folded END AS folded "
                       f"FROM {p}p{k - 1} a JOIN {p}{k} b ON a.g IS NOT DISTINCT FROM b.g AND b.i = a.i // {16 ** k})")

    tree("d", doc_levels)
    sql.append(f"r0 AS (SELECT 0 AS g, g AS source, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM d{doc_levels})")
    tree("r", root_levels)
    paths("d", doc_levels, "doc_id")
    paths("r", root_levels, "source")
    # the document's own proof, then that of its subroot
    last, top = f"dp{doc_levels}", f"rp{root_levels}"
    sql.append(f"j0 AS (SELECT a.doc_id, a.d AS leaf, s.d AS subroot, t.d AS root, a.proof || s.proof AS proof, a.folded, s.i AS i FROM {last} a JOIN {top} s ON a.g IS NOT DISTINCT FROM s.source, r{root_levels} t)")
    for k in range(1, root_levels + 1):
        own = f"64 * (a.i // {16 ** (k - 1)} % 16)::INTEGER"
        left, right = f"substring(b.run, 1, {own})", f"substring(b.run, {own} + 65)"
        sql.append(f"j{k} AS (SELECT a.doc_id, a.leaf, a.subroot, a.root, a.proof, CASE WHEN b.m > 1 THEN sha256({left} || a.folded || {right}) ELSE a.folded END AS folded, a.i "
                   f"FROM j{k - 1} a JOIN r{k} b ON b.i = a.i // {16 ** k})")
    return ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM j{root_levels}"
