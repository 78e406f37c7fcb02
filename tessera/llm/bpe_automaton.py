"""Byte-level BPE as a deterministic automaton over tokens.

The automaton reads exactly the token sequences that the merges produce. It
starts as one state with a loop for every byte. Each merge (u, v) -> t adds a
gadget: the arcs of u go to a copy of their state that no longer reads v, and
wherever u could be read, t can be read too, to where v led. So a state is
named by the last token, and each merge makes at most one state.

States are kept as their gadgets made them: by the token whose arcs lead there
and the gadget, with the one token taken away. Arcs that a gadget left alone are
default arcs, followed by the token's left part or to the state that was copied;
a bounded cache keeps the transitions in use. A pre-split word is encoded by
table-driven transitions on its bytes: every prefix of a word has exactly one
path, so the tokens that may be under way, each with the token before it, make
one byte state, and the next byte leads to the next state and tells the last
token of the longer prefix. These transitions are made from the automaton when
they are first needed and kept in a bounded table. The tokens on the way back
from a word's end are its encoding. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.bpe_monoid import MARKS, split_pattern
from tessera.llm.common import BoundedCache, ChunkIds, held, id_text, map_text, tokenizer_path

#: In byte states a place is a node of the labels' table and, in the low 24 bits, the token before it.
_NONE = (1 << 24) - 1
_ALONE = (_NONE,)


class TokenAutomaton:
    """Automaton of a merge list. ``labels`` are the tokens' bytes by id; ``merges`` are (left, right, merged) ids by rank."""

    def __init__(self, labels: dict[int, bytes], merges: Sequence[tuple[int, int, int]], cache_size: int = 1 << 17) -> None:
        self.labels = labels
        size = max(labels, default=-1) + 1
        merged = {t for _, _, t in merges}
        # gadget that made a token (-1: a byte, None: no arc reads it) and its parts
        self.born: list[int | None] = [-1 if i in labels and i not in merged else None for i in range(size)]
        self.left, self.right = list(range(size)), list(range(size))
        # (u, v) -> gadget whose state, where the arcs of u lead from then on, has no arc for v
        self.taken: dict[int, int] = {}
        for rank, (u, v, t) in enumerate(merges):
            self._gadget(rank, u, v, t)
        self._step: dict[int, int] = {}
        self._token: list[int] = [-1]
        self._size = [0] * size
        for token, born in enumerate(self.born):
            if born is not None:
                self._spell(labels[token], token)
                self._size[token] = len(labels[token])
        self._whole = {label: token for token, label in labels.items() if self.born[token] is not None}
        self._inner = {key >> 8 for key in self._step}  # spelled so far, and some label goes on
        self._limit = 4 * cache_size
        self._begin()
        last = len(merges)
        self._reads = BoundedCache(lambda key: self._follow(key >> 32, last, key & 0xFFFFFFFF), cache_size)

    @property
    def states(self) -> int:
        """The start state and one for each gadget."""
        return 1 + len(self.taken)

    def _gadget(self, rank: int, u: int, v: int, t: int) -> None:
        if self.born[u] is None or self.born[v] is None or self.born[t] is not None or not self._follow(u, rank - 1, v):
            return  # u is never followed by v here, so the merge never applies
        self.taken[u << 32 | v] = rank
        self.born[t], self.left[t], self.right[t] = rank, u, v

    def _follow(self, after: int, rank: int, token: int) -> bool:
        """Whether the state that ``after`` leads to, as the gadgets up to ``rank`` made it, has an arc for ``token``.

        That state is one of a chain: a gadget for each merge with ``after`` on
        the left, from where the right part of ``after`` led when it was made.
        """
        born, left, right, taken = self.born, self.left, self.right, self.taken
        while True:
            gone = taken.get(after << 32 | token)
            if gone is not None and gone <= rank:
                return False
            age, fork = born[token], born[after]
            if age >= fork:  # the token came later: read where its left part could be read
                if age < 0:
                    return True
                token, rank = left[token], min(rank, age)
            else:
                after, rank = right[after], fork - 1

    def _spell(self, label: bytes, token: int) -> None:
        node = 0
        for byte in label:
            key = node << 8 | byte
            to = self._step.get(key)
            if to is None:
                to = self._step[key] = len(self._token)
                self._token.append(-1)
            node = to
        self._token[node] = token

    def _advance(self, state: int, byte: int) -> int:
        """Next byte state and the last token of the longer prefix, packed; kept in the transition table.

        A byte state holds, for each place where a token may have begun, the
        token before it and how far the labels are spelled. Of the tokens that
        end here the automaton reads exactly one.
        """
        if len(self._next) >= self._limit:  # the table starts anew; only speed depends on it
            held = self._places[state]
            self._begin()
            state = self._named(held)
        step, token_at, inner, reads, found, places = self._step, self._token, self._inner, self._reads, -1, []
        for place in self._places[state]:
            node = step.get(place >> 24 << 8 | byte)
            if node is None:
                continue
            token, before = token_at[node], place & _NONE
            if token >= 0 and found < 0 and (before == _NONE or reads[before << 32 | token]):
                found = token
            if node in inner:
                places.append(node << 24 | before)
        if found < 0:
            raise ValueError(f"byte {byte} has no token")
        places.append(found)  # a token may begin at the labels' root
        got = self._next[state << 8 | byte] = self._named(tuple(places)) << 24 | found
        return got

    def _begin(self) -> None:
        self._next: dict[int, int] = {}
        self._name: dict[tuple, int] = {}
        self._places: list[tuple] = []
        self._named(_ALONE)  # state 0

    def _named(self, places: tuple) -> int:
        state = self._name.get(places)
        if state is None:
            state = self._name[places] = len(self._places)
            self._places.append(places)
        return state

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: the last token of every prefix, then the way back from the end."""
        whole = self._whole.get(word)
        if whole is not None:  # the start state reads every token
            return [whole]
        state, last, follow = 0, [], self._next.get
        for byte in word:
            got = follow(state << 8 | byte)
            if got is None:
                got = self._advance(state, byte)
                follow = self._next.get
            last.append(got & _NONE)
            state = got >> 24
        out, n, size = [], len(word), self._size
        while n:
            token = last[n - 1]
            out.append(token)
            n -= size[token]
        return out[::-1]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The labels of the ids in turn."""
        return b"".join(map(self.labels.__getitem__, ids))


class AutomatonTokenizer:
    """Texts to ids and back as a tokenizer file of the byte-level kind says."""

    def __init__(self, path: str, cache_size: int = 1 << 17) -> None:
        from tessera.llm.packing import byte_level_chars

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, pre = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or told["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE file without normalizer, prefix space or whole-word lookup is needed")
        byte_of = {c: b for b, c in byte_level_chars().items()}

        def label(token: str) -> bytes:
            return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

        vocab = model["vocab"]
        labels = {i: label(t) for t, i in vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = TokenAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.added: dict[str, int] = {}
        for t in told["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.added[t["content"]] = t["id"]
            labels[t["id"]] = label(t["content"])
        self._marks = re.compile("(" + "|".join(re.escape(m) for m in sorted(self.added, key=len, reverse=True)) + ")")
        self._find = split_pattern().findall
        self._words = BoundedCache(self._word, cache_size // 4)
        self._chunks = ChunkIds(self._chunk, cache_size)

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a piece of text in which no match of the split pattern is cut."""
        # letters and then marks without an apostrophe are two matches; the pattern tells for all else
        word = chunk.rstrip(MARKS)
        if word[1:].isalpha() and word[0] == " " and not self._marked(chunk):
            if len(word) == len(chunk):
                return self._word(word)
            return self._chunks.spaced[word[1:]] + self._words[chunk[len(word):]]
        packed: list[bytes] = []
        for part in self._marks.split(chunk) if self._marked(chunk) else [chunk]:
            if part in self.added:
                packed.append(array("I", [self.added[part]]).tobytes())
            else:
                packed += map(self._words.__getitem__, self._find(part))
        return b"".join(packed)

    def _marked(self, chunk: str) -> bool:
        return any(m in chunk for m in self.added)

    def _word(self, word: str) -> bytes:
        return array("I", self.automaton.encode(word.encode())).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self._chunks.ids(text)

    def decode(self, ids: Sequence[int]) -> str:
        """Bytes that are no character become replacement characters, as a lossy decoder has it."""
        return self.automaton.decode(ids).decode("utf-8", "replace")


def tokenizer(path: str) -> AutomatonTokenizer:
    """The automaton of a file, compiled once for each Python worker."""
    return held(("token automaton", path), lambda: AutomatonTokenizer(path))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """``id_col`` and ids (array of int) of each whole text; null and empty texts have none, repeated rows stay, an empty table gives none."""

    def each():
        t = tokenizer(tokenizer_path(name, folder))
        return lambda text: (t.encode(text).tolist(),)

    return map_text(id_text(docs, id_col, text_col), text_col, "ids array<int>", each)


def encode_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Encode each whole text and decode the ids: ``id_col``, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256 (UTF-8).

    Strings of added tokens inside texts are those tokens. Null and empty
    texts have no tokens; repeated rows and null ids are rows like any other;
    an empty table gives no rows; other columns are ignored.
    """

    def each():
        t = tokenizer(tokenizer_path(name, folder))

        def row(text: str) -> tuple:
            ids = t.encode(text)
            decoded = t.decode(ids.tolist()).encode("utf-8")
            return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return row

    return map_text(id_text(docs, id_col, text_col), text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", each)
