"""Token counts, tree BPE and packing against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe_monoid, packing, token_counts
from tessera.llm.common import BoundedCache, ChunkIds

SP = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
TK = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
with open(P.path("byte_bpe_50k.tiktoken"), "rb") as _f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _f)}
TT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = bpe_monoid.TreeBPE(RANKS, cache_size=64)  # small: caches turn over
CODER = bpe_monoid.TextCoder(TREE, 16)
IDS = ChunkIds(packing.chunk_encoder(P.path("byte_bpe_50k.json")), 16)

PARTS = ["a", "th", "the", " ", "  ", "   ", "\n", "\t", "▁", "é", "<s>", "<|endoftext|>", "1", "%%%", "漢字", "\xa0", " ", "\x00", "\x1c", "\x85", "'s", "🙂",
         "a" * 17, "-" * 16, "X" * 70]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_chunks_keep_ids(text):
    assert CODER.ids(text).tolist() == TT.encode_ordinary(text)
    assert CODER.decode(CODER.ids(text).tolist()) == text.encode()
    assert IDS.ids(text).tolist() == TK.encode(text, add_special_tokens=False).ids
    keys = token_counts.chunk_keys(text) if text else []
    assert sum(len(SP.encode(k)) or 1 for k in keys) == len(SP.encode(text))


@pytest.mark.parametrize("piece", ["a" * 5000, "-" * 3333, "ab" * 2000, "é" * 999, "abcdefgh" * 300])
def test_long_pieces_by_tree(piece):
    assert list(TREE.encode(piece.encode())) == TT.encode_ordinary(piece)


def test_product_is_associative():
    rnd = random.Random(1)
    for _ in range(200):
        a, b, c = ("".join(rnd.choice("aethn -") for _ in range(rnd.randint(0, 9))).encode() for _ in range(3))
        x, y, z = TREE.encode(a), TREE.encode(b), TREE.encode(c)
        assert TREE.join(TREE.join(x, y), z) == TREE.join(x, TREE.join(y, z)) == TREE._plain(a + b + c) if a + b + c else True


def test_every_token_encodes_to_itself():
    assert all(TREE._plain(b) == (r,) for b, r in RANKS.items())


def test_bounded_cache_keeps_results():
    cache = BoundedCache(lambda k: k * 2, 3, {7: 14})
    assert [cache[i % 9] for i in range(100)] == [i % 9 * 2 for i in range(100)] and len(cache) <= 5


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_counts(docs, odd, none):
    for df in (docs, odd):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(SP.encode(r["text"] or ""))) for r in rows(df.select("doc_id", "text")))
        got = rows(token_counts.count_tokens(df, table_size=50, limit=100))
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(none).count() == 0


def test_frequent_words_hold_heavy_hitters(docs):
    counts = Counter(w for r in docs.select("text").collect() for w in r["text"].split(" "))
    total = sum(counts.values())
    found = token_counts.frequent_words(docs, "text", 200)
    assert len(found) <= 200 and {w for w, c in counts.items() if w and c > total / 201} <= set(found)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_round_trip(docs, odd, none):
    for df in (docs, odd):
        want = Counter()
        for r in rows(df.select("doc_id", "text")):
            ids = TT.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))] += 1
        got = rows(bpe_monoid.encode_round_trip(df))
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe_monoid.encode_round_trip(none).count() == 0
    ids = bpe_monoid.encode_texts(docs)
    raw = {r["doc_id"]: bytes(r["raw"]).decode() for r in bpe_monoid.decode_ids(ids).collect()}
    assert raw == {r["doc_id"]: r["text"] for r in docs.collect()}


def check_plan(histogram, capacity):
    """Every id of every piece once, no gaps; returns the padding."""
    seqs, cover = defaultdict(list), defaultdict(list)
    for n, low, high, cut, size, seq, off in packing.plan_packs(histogram, capacity):
        for r in range(low, high):
            seqs[seq + r - low].append((off, size))
            cover[(n, r)].append((cut, size))
    assert set(cover) == {(n, r) for n, c in histogram.items() for r in range(c)}
    for (n, _), parts in cover.items():
        assert [c for c, _ in sorted(parts)] == list(np.cumsum([0, *[s for _, s in sorted(parts)]])[:-1]) and sum(s for _, s in parts) == n
    padding = 0
    for parts in seqs.values():
        ends = np.cumsum([0, *[s for _, s in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == list(ends[:-1]) and ends[-1] <= capacity
        padding += capacity - ends[-1] if ends[-1] & (ends[-1] - 1) else 0
    return padding


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 20), max_size=12))
def test_plans_are_whole(histogram):
    total = sum(n * c for n, c in histogram.items())
    assert check_plan(histogram, 64) <= total / 32 + 1


def test_one_length_is_cut_to_fit():
    assert check_plan({600: 500}, 1024) == 0


def check_packing(df, got):
    want = Counter()
    for r in rows(df.select("doc_id", "text")):
        want[(r["doc_id"], sha(np.array(TK.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()))] += 1
    texts = defaultdict(list)
    for r in rows(df.select("doc_id", "text")):
        texts[r["doc_id"]].append(np.array(TK.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for key, ids in texts.items():
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[key], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids[0])
                at += r["length"]
                assert zlib.crc32(ids[0][r["start"]:at].tobytes()) == r["ids_crc32"]
            assert at == len(ids[0])
        else:
            assert sum(r["length"] for r in pieces[key]) == sum(map(len, ids))
    for parts in seqs.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == list(ends[:-1]) and ends[-1] <= 1024


def test_packing(docs, odd, none):
    for df in (docs, odd):
        check_packing(df, rows(packing.pack_documents(df)))
    assert packing.pack_documents(none).count() == 0
