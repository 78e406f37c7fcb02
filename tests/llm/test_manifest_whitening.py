"""Merkle manifest, token automaton and whitening against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import bpe_automaton, merkle, whitening
from tessera.llm.common import tokenizer_path


# ---------------------------------------------------------------- manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def build(nodes):
    """All levels of a tree, leaves first."""
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof(tree, place):
    path = []
    for level in tree[:-1]:
        run = level[place // 16 * 16:place // 16 * 16 + 16]
        path.append((place % 16, run[:place % 16] + run[place % 16 + 1:]))
        place //= 16
    return path


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text), ids differ."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: build([d for _, d in sorted(((r[0] is not None, r[0] or 0), leaf_of(r)) for r in by_source[s])]) for s in sources}
    top = build([trees[s][-1][0] for s in sources])
    out = []
    for s in sources:
        order = sorted(by_source[s], key=lambda r: ((r[0] is not None, r[0] or 0), leaf_of(r)))
        for place, r in enumerate(order):
            path = proof(trees[s], place) + proof(top, sources.index(s))
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of((*r[:4], text))
            for at, run in path:
                folded = digest(*run[:at], folded, *run[at:])
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[s][-1][0], root, digest(*(d for _, run in path for d in run)), folded, folded == root))
    return out


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, last string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], COLUMNS).repartition(5)


@pytest.mark.parametrize("rise", [1, 3])
def test_manifest_brute_force(spark, rise):
    rng = random.Random(rise)
    rows = [(i * 7 % 601, rng.choice([None, "", "a", "é", "hot", "hot", "hot", "hot"]), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "Words É 日本", "AB" * 40]))
            for i in range(600)]
    rows += [(1000, "single", "en", 1, "Alone")] + [(2000 + i, f"s{i:02}", None, 0, "T") for i in range(40)]
    docs = frame(spark, rows)
    got = merkle.manifest(docs, presented={"text": merkle.tampered_text(docs["doc_id"], docs["text"])}, rise=rise)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert values(got) == sorted(brute_manifest(rows), key=str)


def test_manifest_edges(spark, none):
    # equal rows, null ids, one row in all, empty table
    rows = [(None, None, None, None, None)] * 3 + [(5, "a", "en", 2, "Xy")] * 20 + [(5, "a", "en", 2, "other")]
    assert values(merkle.dataset_manifest(frame(spark, rows))) == sorted(brute_manifest(rows), key=str)
    one = [(10, "s", "en", 1, "Q")]
    (row,) = merkle.dataset_manifest(frame(spark, one)).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("")
    assert merkle.dataset_manifest(frame(spark, one).limit(0)).count() == 0


def test_manifest_tells_any_change(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(100)]
    docs = frame(spark, rows)
    changed = {"n_chars": merkle.F.when(docs["doc_id"] == 41, 0).otherwise(docs["n_chars"])}
    got = merkle.manifest(docs, presented=changed).filter("NOT verified").collect()
    assert [r.doc_id for r in got] == [41]


def test_manifest_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.execute(merkle.oracle()).fetchall(), key=str)
    assert values(merkle.dataset_manifest(docs)) == want


# ---------------------------------------------------------------- token automaton

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.AutomatonTokenizer(tokenizer_path("byte_bpe_50k.json"))


def test_automaton_against_merging():
    """Small merge lists, repeated letters included, against merging by rank, leftmost first."""
    rng = random.Random(11)
    for _ in range(150):
        labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        while len(merges) < 12:
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] in labels.values():
                continue
            labels[len(labels)] = labels[u] + labels[v]
            merges.append((u, v, len(labels) - 1))
        own = bpe_automaton.TokenAutomaton(labels, merges)
        assert own.states <= len(merges) + 1
        for _ in range(40):
            word = bytes(rng.choice(b"aab" if rng.random() < 0.5 else b"abc") for _ in range(rng.randrange(0, 14)))
            ids = [b"abc".index(b) for b in word]
            for u, v, t in merges:
                at = 0
                while at + 1 < len(ids):
                    if ids[at] == u and ids[at + 1] == v:
                        ids[at:at + 2] = [t]
                    at += 1
            assert own.encode(word) == ids
            assert own.decode(ids) == word


def test_automaton_random_strings(library, automaton):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "🙂", "'s", "'", "12", "-", "=", "\x00", " ", "<|endoftext|>", "<|endof", "A", "zq"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text).tolist() == want, text
        assert automaton.decode(want) == library.decode(want, skip_special_tokens=False)
    # ids cut anywhere need not be whole characters
    ids = library.encode("日本🙂", add_special_tokens=False).ids
    for a in range(len(ids)):
        assert automaton.decode(ids[a:]) == library.decode(ids[a:], skip_special_tokens=False)


def test_automaton_long_words(library, automaton):
    for text in (" " * 30000 + "x", "a" * 30000, "-=" * 10000, "ab\n" * 5000, "é" * 9000):
        assert automaton.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_automaton_round_trip(spark, docs, odd, none, library):
    for df in (docs, odd):
        want = []
        for i, text in df.select("doc_id", "text").collect():
            ids = library.encode(text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert values(bpe_automaton.encode_round_trip(df)) == sorted(want, key=str)
    assert bpe_automaton.encode_round_trip(none).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe_automaton.encode_round_trip(none).count() == bpe_automaton.encode_texts(none).count() == 0


# ---------------------------------------------------------------- whitening

def test_inertia_counts():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 17):
        for _ in range(10):
            a = rng.normal(size=(d, d))
            a = a + a.T
            e = np.linalg.eigvalsh(a)
            for s in (*(e[:-1] + e[1:]) / 2, e[0] - 1, e[-1] + 1):
                assert whitening.eigenvalues_below(a, s) == int((e < s).sum())
    assert whitening.eigenvalues_below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.eigenvalues_below(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [5, 5, 5, 1, 1], [1, 1 - 1e-13, 1 - 2e-13, 0.5, 0], [3, 1e-9, 0, 0, 0], [1e6, 1, 1, 1, 1]])
def test_leading_pairs(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(5, 5)))
    v = q @ np.diag(np.array(spectrum, float)) @ q.T
    v = (v + v.T) / 2
    got = whitening.leading_pairs(v, 4)
    assert len(got) == sum(e > 1e-12 for e in spectrum[:4])
    vecs = np.stack([x for _, x in got], axis=1)
    assert np.abs(vecs.T @ vecs - np.eye(len(got))).max() < 1e-13
    for (e, x), want in zip(got, spectrum):
        assert abs(e - want) <= 1e-13 * spectrum[0]
        assert np.abs(v @ x - e * x).max() <= 1e-13 * spectrum[0]


def brute_whiten(rows, count=4):
    use = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in use}), float)
    n, total = len(fit), [sum(int(c) for c in col) for col in fit.T]
    mean = fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1][:count], vec[:, ::-1][:, :count]
    white = [(i, sum((n * a - s) ** 2 for a, s in zip(x, total)), (np.array(x) - mean) @ vec / np.sqrt(e)) for i, x in use]
    return n, white, e / np.trace(cov)


def test_whiten_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[9][1]), (3, rows[11][1])]
    bad = [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 6), (5003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (5004, []), (5005, [1.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows + bad], "vec_id long, embedding array<float>, n string, x int").repartition(6)
    got = whitening.whiten(df).collect()
    n, white, explained = brute_whiten(rows)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} == {300}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-10
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for i, d, _ in white)
    for c in range(4):
        own = {(str(r.vec_id), r.deviation): r.whitened for r in got if r.component == c + 1}
        pairs = [(own[str(i), d], w[c]) for i, d, w in white]
        sign = 1 if pairs[0][0] * pairs[0][1] > 0 else -1
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-9
        assert abs(next(r.explained for r in got if r.component == c + 1) / explained[c] - 1) < 1e-12


def test_whiten_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0  # no variance
    line = whitening.whiten(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 4.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.deviation) for r in sorted(line)] == [(0, 1, 327680), (1, 1, 327680)]
    assert sorted(round(r.whitened, 12) for r in line) == [-1.0, 1.0]
    # sums beyond 64 bits stay exact
    big = [(0, [2.0**52, 1.0]), (1, [2.0**52, 2.0]), (2, [2.0**52, 4.0])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(big, schema)).collect()}
    assert {i: r.deviation for i, r in got.items()} == {0: (3 * 256 - 1792) ** 2, 1: (3 * 512 - 1792) ** 2, 2: (3 * 1024 - 1792) ** 2}
