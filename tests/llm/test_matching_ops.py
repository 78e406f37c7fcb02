"""Suffix dedup, top-k search, SimHash groups and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bitslice_topk, simhash, suffix_dedup
from tests.conftest import SF_SMALL


def naive_removal(texts, size=400):
    raws = [t.encode() for t in texts]
    seen = Counter(r[i:i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        runs = suffix_dedup.merged((i, i + size) for i in range(len(r) - size + 1) if seen[r[i:i + size]] > 1)
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + r[at:a], b
        out.append((len(r), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept + r[at:]).hexdigest()))
    return out


def repetitive(seed, n=120):
    rnd = random.Random(seed)
    filler = lambda k: "".join(rnd.choice("abcdé 漢\x00") for _ in range(k))
    passages = [filler(k) for k in (399, 400, 401, 420, 700, 250, 150, 397)]
    texts = []
    for _ in range(n):
        t = filler(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 4)):
            t += rnd.choice(passages)[rnd.choice([0, 0, 1, 3]):] + filler(rnd.choice([0, 1, 2, 5, 50, 300]))
        texts.append(t)
    return texts + ["a" * 1000, "a" * 400, "a" * 399, "ab" * 700, "", None, "x" * 50, "abc" * 300] + texts[:20]


@pytest.mark.parametrize("bucket, block", [(4096, 1 << 19), (3, 1000)])
def test_repeats_are_cut(spark, monkeypatch, bucket, block):
    """Also with overfull buckets, counted window by window, and with texts cut into blocks."""
    texts = repetitive(7)
    rows = [(i if i % 40 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, g string, k1 int").repartition(5)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_digest(df).collect())
    assert got == Counter(naive_removal([t or "" for t in texts]))
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(texts) and cut.filter("text is null").count() == 1
    assert suffix_dedup.removal_digest(df.limit(0)).count() == 0


def test_blocks_find_the_same_anchors(monkeypatch):
    raw = np.frombuffer("".join(t or "" for t in repetitive(3, 20)).encode(), np.uint8)

    def windows(block):
        out = {}
        for at in range(0, len(raw) - 399, block):
            part = raw[at:at + block + 399].tobytes()
            for _, start, end, anchor, _ in zip(*suffix_dedup.segments(part, np.zeros(1, np.int64), np.array([len(part)]))):
                out.update({at + s: at + anchor for s in range(start, end - 399)})
        return out

    assert windows(len(raw)) == windows(777) and len(windows(777)) == len(raw) - 399


def test_deep_shallow_order():
    rnd = random.Random(2)
    rows = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.choice([3, 40]))).ljust(64, b"a") + bytes(rnd.choice(b"xy") for _ in range(6)) for _ in range(300)]
    grid = np.stack([np.frombuffer(r, np.uint8) for r in rows])
    bucket = np.sort(np.array([rnd.randint(0, 4) for _ in rows]))
    order, common = suffix_dedup.deep_shallow(bucket, grid, 2)
    assert [(bucket[i], rows[i]) for i in order] == sorted((bucket[i], rows[i]) for i in range(len(rows)))
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]], rows[order[k]]
        shared = next((i for i in range(70) if a[i] != b[i]), 72)
        assert common[k] == (-1 if bucket[order[k]] != bucket[order[k - 1]] else shared)


def test_documents_dedup(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.removal_digest(docs).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], naive_removal([r["text"] for r in rows])))


def naive_top(rows, every, k):
    """rows: (id, vector), ids may repeat; exact inner products, each row's own left out."""
    size = max((len(v) for _, v in rows), default=0)
    q = [(i, np.array([int(np.floor(1024 * float(x))) for x in v] + [0] * (size - len(v)), dtype=object)) for i, v in rows]
    out = Counter()
    for a, (i, x) in enumerate(q):
        if i % every == 0:
            best = sorted((-int((x * y).sum()), j) for b, (j, y) in enumerate(q) if a != b)[:k]
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    return out


@pytest.mark.parametrize("row_block, query_block", [(8192, 256), (7, 2)])
def test_top_k(spark, row_block, query_block):
    rnd = random.Random(1)
    vectors = {i: [rnd.choice([-1.0, 0.0, 0.5, 0.25, rnd.uniform(-1, 1)]) for _ in range(4)] for i in range(0, 60)}
    vectors |= {100: [1.0, 2.0], 101: [], 102: [0.5] * 4, 103: [0.5] * 4, 104: [0.5] * 4, -10: [3.0] * 5}
    rows = [(i, v, 1) for i, v in vectors.items()] + [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 4, 1), (210, [float("inf")], 1), (None, [1.0], 1), (7, vectors[7], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    wide = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] in vectors]  # as floats
    got = Counter(tuple(r) for r in bitslice_topk.top_k(df, every=10, k=6, row_block=row_block, query_block=query_block).collect())
    assert got == naive_top(wide, 10, 6)
    assert bitslice_topk.top_k(df.limit(0)).count() == 0
    few = bitslice_topk.top_k(df.filter("vec_id in (0, 3)"), every=10).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 3)]


def test_sliced_sums_are_exact():
    rnd = np.random.default_rng(3)
    rows, queries = rnd.integers(-600, 600, (150, 5)), rnd.integers(-600, 600, (9, 5))
    block = bitslice_topk.SlicedBlock(rows, keep_bits=4)
    total = block.sums(queries)
    for q in range(9):
        bits = sum(np.unpackbits(s[q].view(np.uint8), bitorder="little")[:150].astype(np.int64) << b for b, s in enumerate(total))
        want = np.where(queries[q] >= 0, block.high * queries[q], ((1 << block.bits) - 1 - block.high) * -queries[q]).sum(axis=1)
        assert (bits == want).all()


def naive_fingerprint(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(rows, max_bits=4):
    """rows of (id, fingerprint) to a multiset of (id, fingerprint, least reachable id)."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)


def test_simhash_groups(docs, odd, none):
    for df in (docs, odd):
        want = naive_groups([(r["doc_id"], naive_fingerprint(r["text"] or "")) for r in df.collect()])
        assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("plan", [None, [(list(range(20)), 1), (list(range(20, 40)), 1), (list(range(40, 64)), 0)], [(list(range(32)), 2), (list(range(32, 64)), 1)], [(list(range(13)), 4)]])
@pytest.mark.parametrize("chunk", [4096, 5])
def test_links_by_any_allocation(spark, monkeypatch, plan, chunk):
    """Thresholds that sum to the limit find the same components, with split buckets too."""
    rnd = random.Random(6)
    fps = set()
    for _ in range(25):
        at = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps.add(at)
            for _ in range(rnd.randint(1, 6)):
                at ^= 1 << rnd.randrange(64)
    if plan and len(plan) == 1:
        plan = [(list(range(64)), 1)]  # one partition finds what differs in one bit
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    n, together = simhash.bit_statistics(nodes)
    limit = 1 if plan and len(plan) == 1 else 4
    chosen = plan or simhash.allocate(n, together, limit)
    assert sum(t + 1 for _, t in chosen) == limit + 1
    got = {r["node"]: r["root"] for r in simhash.components(simhash.find_links(nodes, chosen, limit), "fp", "near").collect()}
    want = naive_groups([(f, f % (1 << 64)) for f in signed], limit)
    assert {(f, got.get(f, f)) for f in signed} == {(i, least) for i, _, least in want}


def test_one_of_each_group_stays(docs, odd):
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    rows = simhash.keep_one(odd)
    assert rows.columns == odd.columns
    ids = [r["doc_id"] for r in rows.collect()]
    assert ids.count(6) == 1 and ids.count(None) == 1 and ids.count(4) == 1 and ids.count(5) == 0


def test_rows_that_share_an_id(spark):
    """Ids tell no rows apart: unrelated texts stay, copies with and without an id meet."""
    a, b, c = ("one passage of text that tells of a mill by the river", "quite another story about trains that run late", "a third text, of bread and of salt and of long winters")
    rows = [(1, a, 1), (1, b, 2), (None, a, 3), (2, b, 4), (None, c, 5), (None, c, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect() if r["doc_id"] is not None)
    assert kept == [(1, a), (1, b)]
    assert [r["text"] for r in simhash.keep_one(df).collect() if r["doc_id"] is None] == [c]
    vectors = spark.createDataFrame([(5, [0.1, 0.2]), (5, [9.0, 9.0]), (100, [1.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice_topk.top_k(vectors).collect())
    scores = {"one": [(5, 18 * 1024 * 1024), (100, 1024 * 1024), (5, 1024 * (102 + 204))], "other": [(5, 9 * 1024 * 1024), (100, 1024 * 1024), (5, 102 * 1024)]}
    assert got == sorted((100, i + 1, v, s) for own in scores.values() for i, (v, s) in enumerate(own))
    with pytest.raises(ValueError):
        bitslice_topk.top_k(spark.createDataFrame([(100, [1e17]), (2, [1.0])], "vec_id long, embedding array<double>"))


def test_pipeline(spark, docs, odd):
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "secret_scan", "packing"]
    for given in (docs, odd):
        df = given
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.materialize(f(spark, df, SF_SMALL), f"test-{name}")
            assert out.columns == given.columns and out.schema == given.schema
            df = out
        assert df.filter("text is not null and n_chars <> char_length(text)").count() == 0 or given is odd
    assert stage["language_id"](spark, odd, SF_SMALL).filter("text is null").count() == 0
    told = stage["language_id"](spark, docs, SF_SMALL)
    assert told.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    final = corpus_pipeline.run(spark, SF_SMALL)
    assert final.select("doc_id").distinct().count() == simhash.keep_one(told).count()
