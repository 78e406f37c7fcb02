"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's words are hashed; a k-mer of ``K`` words is an anchor if the least
hash of its inner runs of ``S`` words is that of the first or the last run.
That depends on the k-mer alone, not on its surroundings, so texts that share
a passage share its anchors wherever it stands. A fingerprint holds every
anchor in text order, each with its distance in words from the one before, so
positions are kept; nothing is capped. The method guarantees an anchor among
any ``K - S`` adjacent k-mers, so a distance is at most ``K - S``.

Two anchors match if they are equal, stand equally far behind the anchor
before them, and those are equal too: matches agree in order and position.
Likeness is the Jaccard similarity of the two texts' anchors under this match,
repeated ones counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

K = 5  # words of an anchor
S = 2  # words of its inner runs
HASH = 0xFFFFFFFF  # bits of an anchor's hash; its distance stands above them
CELLS = 64  # quantiles of the id that place range boundaries
ROWS_PER_RANGE = 2048


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it uses it."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """Every anchor of a text in text order; array<bigint> of distance * 2^32 + hash.

    The first one's distance counts from before the first word, so that it is
    1 or more like all others. A text of some words without any anchor (fewer
    than ``2 * K - S - 1``) is one anchor as a whole; no word gives none.
    """
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:  # hashes of S adjacent words
        return F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

    def places(h: Column, r: Column) -> Column:
        last = K - S
        edge = lambda i: F.least(F.get(r, i), F.get(r, i + last)) <= F.least(*[F.get(r, i + j) for j in range(1, last)])
        return F.filter(F.sequence(F.lit(0), F.size(h) - K), edge)

    def placed(h: Column, r: Column, at: Column) -> Column:
        kmer = lambda i: F.xxhash64(F.get(r, i), F.get(r, i + S), F.get(h, i + K - 1)).bitwiseAND(F.lit(HASH))
        step = lambda i, j: F.shiftleft((i - F.coalesce(F.get(at, j - 1), F.lit(-1))).cast("long"), 32)
        return F.transform(at, lambda i, j: step(i, j).bitwiseOR(kmer(i)))

    def of(h: Column) -> Column:
        whole = F.aggregate(h, F.lit(42).cast("long"), lambda a, b: F.xxhash64(a, b)).bitwiseAND(F.lit(HASH))
        whole = F.when(F.size(h) > 0, F.array(F.lit(1 << 32).bitwiseOR(whole))).otherwise(F.array().cast("array<bigint>"))
        some = bind(runs(h), lambda r: bind(places(h, r), lambda at: F.when(F.size(at) > 0, placed(h, r, at)).otherwise(whole)))
        return F.when(F.size(h) >= K, some).otherwise(whole)

    return bind(hashes, of)


def shown(found: Column) -> Column:
    """Anchors as text: 9 hexadecimal digits each, first the distance, then the hash."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.hex(a)), ""))


def steps(found: Column) -> Column:
    """One number for each anchor: its hash, its distance and the hash of the anchor before it."""
    return F.transform(found, lambda a, j: F.xxhash64(F.coalesce(F.get(found, j - 1), F.lit(0).cast("long")).bitwiseAND(F.lit(HASH)), a))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' ``steps``; two empty ones are alike, an empty and another one aren't."""
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(share).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fingerprint (text) of each row; null and empty texts have an empty one.

    Repeated rows and null ids are kept as they are; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col], shown(anchors(text)).alias("fingerprint"))


def id_ranges(rows: DataFrame) -> tuple[Column, Column]:
    """Expressions that put ``__id`` into a cell and a range, both in id order; literals from quantiles of all ids.

    Quantiles follow the ids' distribution; within a cell ranges are equally
    wide. Null ids, which come before all others, have ranges of their own.
    """
    stats = rows.agg(F.count("__id").alias("n"), F.min("__id").alias("lo"), F.max("__id").alias("hi"),
                     F.percentile_approx("__id", [i / CELLS for i in range(1, CELLS)], 10000).alias("cuts")).first()
    if not stats["n"]:
        return F.lit(-1), F.lit(-1).cast("long")
    cuts = sorted({stats["lo"], *stats["cuts"]})
    ends = [*cuts[1:], stats["hi"] + 1]
    per_cell = max(1, -(-stats["n"] // (len(cuts) * ROWS_PER_RANGE)))
    held = lambda xs: F.array(*[F.lit(x).cast("decimal(38,0)") for x in xs])
    number = F.col("__id").cast("decimal(38,0)")
    cell = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("__id"))) - 1, F.lit(-1))
    cell = F.when(F.col("__id").isNull(), F.lit(-1)).otherwise(cell)
    at = F.col("__cell")
    share = (number - F.get(held(cuts), at)).cast("double") / (F.get(held(ends), at) - F.get(held(cuts), at)).cast("double")
    sub = F.least(F.floor(share * per_cell), F.lit(per_cell - 1))
    return cell, F.when(at < 0, F.lit(-1)).otherwise(at * per_cell + sub).cast("long")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, whose second half comes from the next document.

    The edited text replaces the last floor(n/2) code points by the first as
    many (or all) of the next document in descending id; after the smallest id
    comes the largest. Returns ``id_col``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts are empty. Null ids
    come after the smallest id; rows of one id follow each other in descending
    text. A single row is its own next one; an empty table gives no rows; other
    columns are ignored.

    Rows meet their neighbour in ranges of the id. The largest row of each
    range is sent to the range above as well, so a text is shuffled once and no
    window spans the table.
    """
    rows = docs.select(docs[id_col].cast("long").alias("__id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text"))
    cell, bucket = id_ranges(rows)
    rows = rows.withColumn("__cell", cell).withColumn("__range", bucket)

    # The largest id of each range, and the range it is a neighbour of: the next one in its cell or the first of a later cell.
    tops = rows.groupBy("__cell", "__range").agg(F.max("__id").alias("__top"))
    tops = materialize(tops.withColumn("__above", F.lead("__range").over(Window.partitionBy("__cell").orderBy("__range"))), "syncmer-ranges")
    firsts = [r["f"] for r in tops.groupBy("__cell").agg(F.min("__range").alias("f")).orderBy("__cell").collect()]  # at most CELLS + 1
    if not firsts:
        firsts = [0]
    later = F.array(*[F.lit(f).cast("long") for f in firsts])
    above = F.coalesce("__above", F.get(F.filter(later, lambda f: f > F.col("__range")), F.lit(0)), F.lit(firsts[0]).cast("long"))
    links = tops.select(F.col("__range"), F.col("__top"), above.alias("__above"))

    joined = rows.join(links, (rows["__range"] == links["__range"]) & rows["__id"].eqNullSafe(links["__top"]), "left").select(
        "__id", "__text", rows["__range"].alias("__own"), F.col("__above"))
    own = F.struct(F.col("__own").alias("__range"), F.lit(True).alias("__real"))
    ghost = F.struct(F.col("__above").alias("__range"), F.lit(False).alias("__real"))
    placed = joined.select("__id", "__text", F.explode(F.when(F.col("__above").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("__at"))
    placed = placed.select("__at.__range", "__at.__real", "__id", "__text").repartition("__range")
    found = placed.withColumn("__found", anchors(F.col("__text"))).withColumn("__steps", steps(F.col("__found")))
    # in ascending order the next document is the one before
    order = Window.partitionBy("__range").orderBy("__real", F.asc_nulls_first("__id"), "__text")
    near = found.select("*", F.lag("__text").over(order).alias("__next"), F.lag("__steps").over(order).alias("__next_steps")).filter("__real")
    n = F.char_length("__text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), n - half), F.substring("__next", F.lit(1), half))
    near = near.select("__id", n.cast("long").alias("n_chars"), edited.alias("__edited"), "__found", "__steps", "__next_steps")
    near = near.withColumn("__edited_found", anchors(F.col("__edited")))
    near = near.withColumn("__edited_steps", steps(F.col("__edited_found")))
    return near.select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
                       shown(F.col("__found")).alias("fingerprint"), shown(F.col("__edited_found")).alias("edited_fingerprint"),
                       likeness(F.col("__steps"), F.col("__edited_steps")).alias("near_edited"),
                       likeness(F.col("__steps"), F.col("__next_steps")).alias("near_next"))
