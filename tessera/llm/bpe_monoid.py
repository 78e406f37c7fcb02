"""Byte-level BPE by monoid tree reduction.

Encodings of byte strings form a monoid: the product of two encodings is the
encoding of the joined bytes. A pre-token is cut into halves recursively; two
neighbours are joined by re-encoding a window around the boundary that grows
until the tokens outside it provably stay. The proof used: a token sequence is
the encoding of its bytes exactly if every adjacent pair (a, b) is compatible,
that is, the bytes of a and b together encode to (a, b). All pairs inside the
left, the window and the right part are compatible as each is an encoding, so
only the pairs at the window's two ends are left to test.

Decoding concatenates token bytes up a tree in the same way.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import string
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BoundedCache, ChunkIds, held, id_text, map_text, tokenizer_path

#: Above this length a window is encoded with a heap instead of repeated scans.
SCAN_BYTES = 48
MARKS = "".join(c for c in string.punctuation if c != "'")


class TreeBPE:
    """Encoder and decoder for a table of ranks; all caches are bounded and change speed only."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 1 << 16) -> None:
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._window = BoundedCache(self._plain, cache_size)  # of boundary windows, which also tell compatible pairs
        self._half = BoundedCache(self._reduce, 2 * cache_size)

    @classmethod
    def load(cls, path: str, **kw) -> TreeBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, **kw)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        if not piece:
            return ()
        return self._half[piece] if len(piece) <= SCAN_BYTES else self._reduce(piece)

    def _reduce(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        mid = len(piece) // 2
        if len(piece) <= SCAN_BYTES:
            half = self._half
            return self.join(half[piece[:mid]], half[piece[mid:]])
        return self.join(self.encode(piece[:mid]), self.encode(piece[mid:]))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's product."""
        if not left or not right:
            return left or right
        bytes_of, known = self.bytes_of, self._window
        a, b = left[-1], right[0]
        window = known[bytes_of[a] + bytes_of[b]]
        if window == (a, b):  # a compatible pair: nothing changes
            return left + right
        i = j = 1
        while True:
            low = i == len(left) or self._compatible(left[-i - 1], window[0])
            high = j == len(right) or self._compatible(window[-1], right[j])
            if low and high:
                return left[:len(left) - i] + window + right[j:]
            i, j = min(i if low else 2 * i, len(left)), min(j if high else 2 * j, len(right))
            raw = b"".join(map(bytes_of.__getitem__, left[len(left) - i:] + right[:j]))
            window = known[raw] if len(raw) <= SCAN_BYTES else self._plain(raw)

    def _compatible(self, a: int, b: int) -> bool:
        return self._window[self.bytes_of[a] + self.bytes_of[b]] == (a, b)

    def _plain(self, raw: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of least rank, the leftmost first, until none is left."""
        ranks = self.ranks
        if len(raw) > SCAN_BYTES:
            return self._plain_heap(raw)
        if raw in ranks:
            return (ranks[raw],)
        get, none = ranks.get, 1 << 40
        parts = [raw[i:i + 1] for i in range(len(raw))]
        near = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while near:
            best = min(near)
            if best == none:
                break
            at = near.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at < len(near):
                near[at] = get(parts[at] + parts[at + 1], none)
            if at:
                near[at - 1] = get(parts[at - 1] + parts[at], none)
        return tuple([ranks[p] for p in parts])

    def _plain_heap(self, raw: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := ranks.get(raw[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i:end[i]]])
            i = end[i]
        return tuple(out)

    def decode(self, ids) -> bytes:
        """Concatenate token bytes up a balanced tree."""
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[k:k + 256]) for k in range(0, len(level), 256)]
        return level[0] if level else b""


def coder(path: str) -> TreeBPE:
    """One coder for each Python worker."""
    return held(("tree", path), lambda: TreeBPE.load(path))


def text_coder(folder: str | None, cache_size: int) -> TextCoder:
    path = tokenizer_path("byte_bpe_50k.tiktoken", folder)
    return held(("text", path, cache_size), lambda: TextCoder(coder(path), cache_size))


def split_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class TextCoder:
    """Ids of whole texts: split by the pattern, encode each match by the tree, concatenate."""

    def __init__(self, tree: TreeBPE, cache_size: int) -> None:
        find, encode = split_pattern().findall, tree.encode
        self.decode = tree.decode
        self.decimal = [str(i) for i in range(max(tree.bytes_of, default=0) + 1)]

        def chunk(text: str) -> bytes:
            # letters and then marks without an apostrophe are two matches; the pattern tells for all else
            word = text.rstrip(MARKS)
            if word[1:].isalpha() and word[0] == " ":
                ids = encode(word.encode())
                if len(word) < len(text):
                    ids += encode(text[len(word):].encode())
            else:
                ids = [i for piece in find(text) for i in encode(piece.encode())]
            return array("I", ids).tobytes()

        self.ids = ChunkIds(chunk, cache_size).ids

    def round_trip(self, text: str) -> tuple[int, str, str]:
        ids = self.ids(text).tolist()
        shown = " ".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 1 << 17,
                 folder: str | None = None) -> DataFrame:
    """Token ids of each text as an array: ``id_col``, ids array<int>. Null and empty texts have no ids."""
    def each():
        own = text_coder(folder, cache_size)
        return lambda text: (own.ids(text).tolist(),)

    return map_text(id_text(docs, id_col, text_col), text_col, "ids array<int>", each)


def decode_ids(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str | None = None) -> DataFrame:
    """The UTF-8 bytes of token ids: ``id_col``, raw binary. Null ids give no bytes."""
    def each():
        tree = coder(tokenizer_path("byte_bpe_50k.tiktoken", folder))
        return lambda ids: (tree.decode(ids or ()),)

    return map_text(tokens.select(id_col, ids_col), ids_col, "raw binary", each)


def encode_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 1 << 17,
                      folder: str | None = None) -> DataFrame:
    """Encode each text, decode its ids: ``id_col``, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over
    the decoded bytes. Null and empty texts have no ids and the digest of no
    bytes; repeated rows are coded each; an empty table gives no rows; other
    columns are ignored; texts of any length are coded whole. Special strings
    are ordinary text.
    """
    def each():
        return text_coder(folder, cache_size).round_trip

    return map_text(id_text(docs, id_col, text_col), text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", each)
