"""Language ID, extraction, secrets, fingerprints."""

import functools
import hashlib
import itertools
import random
import re
import string
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import html_lines, lang_id, queries, secrets, syncmers
from tests.conftest import SF_SMALL


def test_languages_held_out(spark, docs):
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_languages_on_odd_rows(spark, odd, none):
    got = lang_id.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 7, 9))
    assert by[4]["lang_pred"] in ("en", "fr", "de")
    assert lang_id.identify(none).count() == 0
    alone = lang_id.identify(odd.withColumn("lang", F.lit("xx"))).collect()
    assert {r["lang_pred"] for r in alone} == {"xx", "und"}
    unlabelled = lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_long_text_scores_do_not_depend_on_blocks(monkeypatch):
    model = lang_id.Model([["de"], ["fr"]], ["family 0", "family 1"], __import__("numpy").random.default_rng(0).normal(size=(lang_id.DIM, 2)), __import__("numpy").zeros(2))
    texts = ["", "ein Wort", "é" * 50, "the quick brown fox " * 30]
    whole = model.scores(texts)
    monkeypatch.setattr(lang_id, "BLOCK", 37)
    assert abs(model.scores(texts) - whole).max() < 1e-6
    assert abs(model.scores(texts[1:2]) - whole[1:2]).max() < 1e-6


def test_extraction_keeps_the_article():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h2>Site</h2></header>"
            "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies</p></div><article><h1>Head &amp; line</h1>"
            "<p>First  <b>bo</b>ld\n text<br>next<p>Last &lt;3</p><div class=\"ad\"><p>Buy</p></div><form><p>Name</p><input></form></article>"
            "<aside>Side</aside><section id='comments'><p>Nice post</p></section><footer>&copy; x</footer></body></html>")
    assert html_lines.page_text(page) == "Head & line First bold text next Last <3"


def test_extraction_without_an_article():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5))
    page = f"<body><div id=menu><a href=a>Home</a><a href=b>About</a></div><p><a href=c>one link</a></p><div>{body}</div><div class='comments'><p>{'nice ' * 50}</p></div></body>"
    text = html_lines.page_text(page)
    assert "word 0" in text and "word 4" in text and "nice" not in text and "Home" not in text


def test_extraction_of_broken_pages_is_linear():
    for evil in ("<" * 50000, '<a "' * 20000, "<!--" * 20000, "<script>" * 20000, '<div class="' * 20000, "<p>" * 50000, "&" * 50000):
        html_lines.page_text(evil)


def test_extraction_query(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")

    def plain(h):
        body = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        return " ".join(b for b in blocks if b)

    got = {r["page_id"]: r for r in queries.op2_extract_main_text(spark, SF_SMALL).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == plain(r["html"]) and got[r["page_id"]]["n_chars"] == len(plain(r["html"])) and got[r["page_id"]]["url"] == r["url"]
    odd = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "", "b"), (2, "u", "no markup", "c"), (3, "u", "<nav>only menu</nav>", "d")],
                                "page_id long, url string, html string, text string")
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_lines.extract_pages(odd).collect()) == Counter(
        [(1, "", 0), (1, "", 0), (None, "", 0), (2, "no markup", 9), (3, "", 0)])
    assert html_lines.extract_pages(odd.limit(0)).count() == 0


def naive_base(text):
    """The contract's patterns as given, then the length tests."""
    kinds = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12), (r"AKIA[A-Z0-9]+", 0, 0, 18), (r"[0-9a-f]+", 0, 0, 16)]
    out = []
    for k, (pattern, flags, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(out)


def test_secret_base_spans(docs, odd):
    rnd = random.Random(4)
    parts = ["password", "Api_Key", "apikey", "token", " = ", ":", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeef", "0123456789abcdef0", "x", " ", "é", "a/b+c=d.e_f-g12"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    texts += [r["text"] or "" for r in docs.select("text").unionByName(odd.select("text")).collect()]
    assert all(sorted(secrets.base_spans(t)) == naive_base(t) for t in texts)


def test_novel_strings_near_sensitive_words():
    novelty = secrets.Novelty(["ordinary", "words"])
    rnd = random.Random(5)
    key = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(40))
    text = f"the bearer credential is {key} and ok"
    at = text.index(key)
    assert (at, 3, at + 40) in secrets.scan_text(text, novelty)
    assert not secrets.novel_spans("the session credential getElementById1.getElementById2.documentation", novelty, [], 40, 256, 0.8)
    assert not secrets.scan_text(f"plain words {key} and more", novelty)
    # written twice: no reason to pass over the one beside the sensitive word
    twice = f"{key} the bearer credential is {key} and ok"
    assert (twice.rindex(key), 3, twice.rindex(key) + 40) in secrets.scan_text(twice, novelty)


def test_secret_query(docs, odd, none):
    for df in (docs, odd):
        got = secrets.secret_digest(df).collect()
        want = Counter()
        for r in df.collect():
            base = naive_base(r["text"] or "")
            shown = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
            want[(r["doc_id"], *(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(shown.encode()).hexdigest())] += 1
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert secrets.secret_digest(none).count() == 0 and secrets.find_secrets(none).count() == 0
    cut = {r["doc_id"]: r["text"] for r in secrets.redact(odd).collect()}
    assert cut[11] == "[SECRET] [SECRET]" or cut[11].startswith("[SECRET]\"") and "AKIA" not in cut[11]
    assert cut[1] is None and cut[6] == "one two three" and secrets.redact(odd).columns == odd.columns


def naive_edits(rows):
    """(id, text) in descending order with nulls last, each edited by the next."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        out[(i, len(t), hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest())] += 1
    return out


def test_fingerprints(spark, docs, odd, none, monkeypatch):
    for size in (2048, 3):
        monkeypatch.setattr(syncmers, "ROWS_PER_RANGE", size)
        for df in (docs, odd, odd.filter("doc_id = 3"), docs.withColumn("doc_id", F.col("doc_id") * F.col("doc_id") * 1000003 - 5)):
            got = syncmers.compare_edited(df).collect()
            assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == naive_edits([(r["doc_id"], r["text"] or "") for r in df.collect()])
            assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert syncmers.compare_edited(none).count() == 0


def test_fingerprint_likeness(docs):
    joined = syncmers.compare_edited(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for _, same in itertools.groupby(sorted(joined, key=lambda r: r["text"]), key=lambda r: r["text"]):
        assert len({r["fingerprint"] for r in same}) == 1
    long = [r for r in joined if r["n_chars"] > 1000]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.25 > 0.05 > sum(r["near_next"] for r in long) / len(long)


def test_fingerprint_plan_is_native(docs):
    plan = syncmers.compare_edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def naive_anchors(text):
    """(position, 32-bit hash) of each anchor, by the definition."""
    def number(x):  # a long's hash reads its eight bytes
        return x.to_bytes(8, "little")

    def chain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(number(v), seed=seed)
        return seed

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    out = []
    for i in range(len(h) - syncmers.K + 1):
        inner = [chain(h[j:j + syncmers.S]) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        least = min(map(signed, inner))
        if least in (signed(inner[0]), signed(inner[-1])):
            out.append((i, chain([inner[0], chain(h[i + syncmers.S:i + 2 * syncmers.S]), h[i + syncmers.K - 1]]) & syncmers.HASH))
    if not out and h:
        out.append((0, functools.reduce(lambda a, b: chain([a, b]), h, 42) & syncmers.HASH))
    return out


def naive_likeness(a, b):
    """Share of anchors that match with the same anchor as far before them; repeated ones once."""
    linked = [{(h, i - j, g) for (i, h), (j, g) in zip(t, [(-1, 0), *t])} for t in (a, b)]
    either = linked[0] | linked[1]
    return len(linked[0] & linked[1]) / len(either) if either else 1.0


def test_fingerprints_by_definition(docs, odd):
    for df in (docs, odd):
        rows = {(r["doc_id"], r["text"] or "") for r in df.collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        after = {t: n[1] for t, n in zip(order, order[1:] + order[:1])}
        got = {(r["doc_id"], r["edited_sha256"]): r for r in syncmers.compare_edited(df.dropDuplicates(["doc_id", "text"])).collect()}
        for i, t in order:
            n, half = after[i, t], len(t) // 2
            edited = t[:len(t) - half] + n[:half]
            r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
            own, changed, following = map(naive_anchors, (t, edited, n))
            for shown, want in ((r["fingerprint"], own), (r["edited_fingerprint"], changed)):
                parts = [(int(shown[k], 16), int(shown[k + 1:k + 9], 16)) for k in range(0, len(shown), 9)]
                ends = itertools.accumulate(d for d, _ in parts)
                assert [(p - 1, x) for p, (_, x) in zip(ends, parts)] == want
            assert r["near_edited"] == pytest.approx(naive_likeness(own, changed), abs=1e-12)
            assert r["near_next"] == pytest.approx(naive_likeness(own, following), abs=1e-12)


def test_fingerprints_keep_place_and_passages(spark):
    rnd = random.Random(11)
    passage = " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(100))
    filler = [" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(20000)) for _ in range(2)]
    inside = {h for _, h in naive_anchors(passage)}
    df = spark.createDataFrame([(1, filler[0] + " " + passage), (2, passage + " " + filler[1])], "doc_id long, text string")
    shown = [r["fingerprint"] for r in syncmers.fingerprints(df).collect()]
    found = [{int(s[k + 1:k + 9], 16) for k in range(0, len(s), 9)} for s in shown]
    assert inside and inside <= found[0] and inside <= found[1]  # a passage shared by long texts is never lost
    words = passage.split()
    moved = " ".join(words[50:] + words[:50])
    pair = spark.createDataFrame([(1, passage), (2, moved)], "doc_id long, text string")
    a, b = (r["fingerprint"] for r in syncmers.fingerprints(pair).orderBy("doc_id").collect())
    assert a != b  # same anchors nearly, another order
