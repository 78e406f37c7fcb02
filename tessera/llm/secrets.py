"""Secret scans: fixed patterns, plus strings that dictionary-primed compression finds new.

Base spans are the matches of three patterns. The method then takes every long
token near a sensitive word and measures its novelty: the bytes that zstandard
needs for the surrounding text with the token less those without it, primed
with a dictionary of identifiers and of the corpus's frequent words, none of
which can hold a key. Words and identifiers that the dictionary or the
surroundings know cost a few bytes; a
random key costs nearly its entropy. Tokens above ``min_novelty`` bytes a
character are reported as kind ``novel``. The lines of a key body are measured
one by one, to its END line or as far as adjacent lines hold a token.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import id_text, map_text, materialize

#: The base patterns, in the order in which kinds are listed, with the group and least length that count. Fixed values.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN = 12

#: Words that make a context sensitive. Fixed values.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private", "credential", "auth", "bearer", "signature", "session", "cookie", "client_id", "ssh-rsa", "salt", "cert")

#: Identifiers common in code and configuration, part of the compressor's dictionary. Fixed values.
IDENTIFIERS = (
    "access account address admin algorithm application args array async attribute auth authorization base64 bearer body boolean bucket buffer build "
    "callback certificate channel class client config connection const constructor container content context cookie count create credential data database "
    "debug decode default delete description document domain element email enable encode endpoint environment error event example exception export false "
    "field file filter function generate getElementById handler hash header host https identifier import include index initialize input instance integer "
    "interface invalid iterator javascript json key keyboard language length library license limit list localhost location login manager message method "
    "module namespace network node number object offset option output package parameter parse password path permission placeholder platform pointer port "
    "private process production project prototype provider public query queue random read region register release remote request require resource response "
    "result return role root schema script secret select self server service session signature source static status storage stream string struct system "
    "table target template test text thread time timeout timestamp token transaction true type undefined update upload user username utf-8 validate value "
    "variable vector version virtual void window write your_api_key xxxxxxxxxxxxxxxx 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
)

#: What may be a key: a long token with a letter and a digit.
MIN_CANDIDATE = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{MIN_CANDIDATE},}}")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)

#: What stands between two adjacent lines of a key: one line break, real or escaped, with quotes and indentation. Fixed values.
_BREAK = r"(?:\\r)?(?:\\n)?[ \t\"'`,;+]{0,64}(?:\r\n?|\n|(?:\\r)?\\)[ \t\"'`+>#*|]{0,64}"
GAP = re.compile(_BREAK)
TAIL = re.compile(_BREAK + r"([A-Za-z0-9+/_=]{1,19})(?![A-Za-z0-9+/_=.-])")
ENDS = re.compile(r"(?:\\r)?(?:\\n)?[\s\"'`,;+>#*|]{0,64}-----END")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)?")
_END = re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches, leftmost without overlap for each kind.

    The quantified forms of access and hex find the same spans as the open
    ones with a length test, as a match takes its run to the end.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed bytes of a token, given its surroundings and a dictionary."""

    def __init__(self, words: list[str], level: int = 3) -> None:
        import zstandard

        primed = (" ".join(words) + " " + IDENTIFIERS).encode("utf-8", "replace")
        data = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def bytes_of(self, before: str, token: str, after: str) -> int:
        around = (before + after).encode("utf-8")
        whole = (before + token + after).encode("utf-8")
        return len(self.compress(whole)) - len(self.compress(around))


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the bodies between a private key's BEGIN and END lines."""
    if "-----BEGIN" not in text:
        return []
    begins = [(m.end(), m.end(1)) for m in _BEGIN.finditer(text)]
    out, last = [], len(text)
    for start, named in reversed(begins):
        if named >= 0 and (m := _END.search(text, start, last)):
            out.append((start, m.start()))
        last = start  # no body runs on into the next block
    return out[::-1]


def sensitive_tokens(text: str, reach: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, body's number, measured) of the tokens in a sensitive context.

    That is within ``reach`` characters after a sensitive word, in a private
    key's block, or on the line after such a token. Tokens of adjacent lines
    are one body. Base spans aren't measured, but carry the context on.
    """
    out: list[tuple[int, int, int, bool]] = []
    marks = [m.end() for m in _SENSITIVE.finditer(text)]
    if not marks:
        return out
    blocks = key_blocks(text)
    taken = sorted((s, e) for s, _, e in base)
    at = t = b = body = 0
    carried = -1  # end of the token before, if its context holds
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(marks) and marks[at] < start - reach:
            at += 1
        while b < len(blocks) and blocks[b][1] <= start:
            b += 1
        if at == len(marks) and b == len(blocks) and carried < 0:
            break
        blocked = b < len(blocks) and blocks[b][0] <= start
        follows = carried >= 0 and GAP.fullmatch(text, carried, start) is not None
        if not (blocked or follows or (at < len(marks) and marks[at] <= end)):
            carried = -1
            continue
        token = m.group()
        if not blocked and (not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token)):
            carried = -1
            continue
        while t < len(taken) and taken[t][1] <= start:
            t += 1
        body += not follows
        out.append((start, end, -1 - b if blocked else body, not (t < len(taken) and taken[t][0] < end)))
        carried = end
    return out


def without(text: str, start: int, end: int, masks: list[tuple[int, int]]) -> str:
    """text[start:end] without the masked places, which are in order."""
    out = []
    for s, e in masks:
        if e > start and s < end:
            out.append(text[start:max(start, s)])
            start = max(start, e)
    return "".join(out) + text[start:end]


def copies_of(core: str, text: str, left: int, start: int, end: int, right: int) -> list[tuple[int, int]]:
    """Where ``core`` stands in text[left:right] besides text[start:end]."""
    out, at = [], text.find(core, left, right) if core else -1
    while at >= 0:
        if at + len(core) <= start or at >= end:
            out.append((at, at + len(core)))
        at = text.find(core, at + len(core), right)
    return out


def novel_spans(text: str, novelty: Novelty, base: list[tuple[int, int, int]], reach: int, window: int, min_novelty: float) -> list[tuple[int, int, int]]:
    """Spans of incompressible tokens in a sensitive context that aren't base spans.

    A token's surroundings are taken without other copies of it, and without the
    other lines of its body, as random lines share enough characters to make
    each other look known. Outside a private key's block a line must be half as
    new beside its body's lines too, so lists of similar names stay. The short
    last line of a body goes with the line before it.
    """
    found = []
    tokens = sensitive_tokens(text, reach, base)
    low = 0
    for i, (start, end, body, measured) in enumerate(tokens):
        if not measured:
            continue
        token = text[start:end]
        core = token.strip("+/_=.-")
        left, right = max(0, start - window), end + window
        while tokens[low][1] <= left:
            low += 1
        copies, lines = copies_of(core, text, left, start, end, right), []
        for k in range(low, len(tokens)):
            s, e, other, _ = tokens[k]
            if s >= right:
                break
            if k == i:
                continue
            if text[s:e].strip("+/_=.-") in token:
                copies.append((s, e))
            elif other == body:
                lines.append((s, e))

        def share(masks: list[tuple[int, int]]) -> float:
            masks = sorted(masks)
            return novelty.bytes_of(without(text, left, start, masks), token, without(text, end, right, masks)) / len(token)

        if share(copies + lines) >= min_novelty and (body < 0 or not lines or 2 * share(copies) >= min_novelty):
            found.append((start, 3, end))
    return found + tails(text, tokens, base, found)


def tails(text: str, tokens: list[tuple[int, int, int, bool]], base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Last lines shorter than a candidate: before an END line, or padded after two lines of one width."""
    out = []
    reported = {e for _, _, e in base} | {e for _, _, e in found}
    held = {s for s, _, _ in base}
    for i, (start, end, body, _) in enumerate(tokens):
        if end in reported and (m := TAIL.match(text, end)) and m.start(1) not in held:
            before = tokens[i - 1] if i else (0, 0, 0, False)
            if ENDS.match(text, m.end()) or (m[1].endswith("=") and before[2] == body and before[1] - before[0] == end - start):
                out.append((m.start(1), 3, m.end(1)))
    return out


def scan_text(text: str, novelty: Novelty, reach: int = 40, window: int = 256, min_novelty: float = 0.8) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind: (start, kind's number, end)."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, novelty, base, reach, window, min_novelty))


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def corpus_words(docs: DataFrame, text_col: str = "text", size: int = 4096) -> list[str]:
    """The ``size`` most frequent words that can't hold a key, by exact counts: the learned part of the dictionary.

    A word with a digit or of a candidate's length is left out, however often it
    occurs: a key that many documents share must stay new. Equal counts are
    ordered by word, so the list depends on the rows alone.
    """
    word = F.col("word")
    words = docs.select(F.explode(F.split(docs[text_col].cast("string"), r"[ \t\n\x0B\f\r]+")).alias("word"))
    words = words.filter((word != "") & (F.char_length(word) < MIN_CANDIDATE) & ~word.rlike("[0-9]"))
    counts = materialize(words.groupBy("word").count(), "secret-words")
    # Classes of counts, a sixteenth of a doubling wide: only the classes that reach the top are sorted.
    step = F.floor(F.log2("count") * 16)
    least, held = 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 16 * 63 rows
        least, held = r["step"], held + r["n"]
        if held >= size:
            break
    return [r["word"] for r in counts.filter(step >= least).orderBy(F.desc("count"), "word").limit(size).collect()]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None,
                 reach: int = 40, window: int = 256, min_novelty: float = 0.8) -> DataFrame:
    """All secret spans of each text: ``id_col``, spans array<struct<kind, start, end>> (code points, end exclusive).

    ``words`` is the learned dictionary (default: ``corpus_words`` of ``docs``).
    Null and empty texts have no spans; repeated rows are scanned each; an empty
    table gives no rows; other columns are ignored; texts are scanned whole.
    """
    known = docs.sparkSession.sparkContext.broadcast(words if words is not None else corpus_words(docs, text_col))

    def each():
        novelty = Novelty(known.value)
        return lambda text: ([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan_text(text, novelty, reach, window, min_novelty)],)

    return map_text(id_text(docs, id_col, text_col), text_col, "spans array<struct<kind:string,start:int,end:int>>", each)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """One row for each document: counts of the base kinds, digest of the base spans, all spans as text.

    The cases of ``find_secrets`` hold; a text without spans has the digest of
    no bytes and empty ``spans``.
    """
    known = docs.sparkSession.sparkContext.broadcast(words if words is not None else corpus_words(docs, text_col))

    def each():
        novelty = Novelty(known.value)

        def digest(text: str) -> tuple:
            spans = scan_text(text, novelty)
            base = [x for x in spans if x[1] < 3]
            kinds = [x[1] for x in base]
            return (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans))

        return digest

    return map_text(id_text(docs, id_col, text_col), text_col,
                    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", each)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", words: list[str] | None = None) -> DataFrame:
    """The same rows and columns, each span of the text replaced by ``mark``; null stays null."""
    known = docs.sparkSession.sparkContext.broadcast(words if words is not None else corpus_words(docs, text_col))

    held: list = []

    def cut(text: str | None) -> str | None:
        if text is None:
            return None
        if not held:
            held.append(Novelty(known.value))
        out, at = [], 0
        for start, _, end in scan_text(text, held[0]):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:]

    @arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([cut(t) for t in texts.to_pylist()], type=pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
