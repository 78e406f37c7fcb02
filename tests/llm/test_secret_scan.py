"""Secret scan: what the dictionary may know, keys of many lines."""

import random
import string

from tessera.llm import secrets

RND = random.Random(8)


def random_key(n, chars=string.ascii_letters + string.digits):
    return "".join(RND.choice(chars) for _ in range(n))


def test_shared_key_stays_new(spark):
    key = random_key(40)
    rows = [(i, f"the bearer credential is {key} and ok") for i in range(50)] + [(100 + i, f"plain words of document {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    words = secrets.corpus_words(docs)
    assert key not in words and "credential" in words and not any(any(c.isdigit() for c in w) or len(w) >= 20 for w in words)
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert all(found[i] == [("novel", 25, 65)] for i in range(50)) and not any(found[100 + i] for i in range(50))
    assert not any(key in r["text"] for r in secrets.redact(docs).collect())


def test_learned_words_depend_on_the_rows_alone(spark, none):
    names = ["".join(c) for c in zip(*[iter("abcdefghijklmnopqrstuvwxyz" * 6)] * 3)]
    rows = [(i, " ".join(RND.choices(names, k=30)) + " once" + "\n" + "both  both") for i in range(40)] + [(99, None), (98, "")]
    counts = {}
    for _, t in rows:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
    want = sorted(counts, key=lambda w: (-counts[w], w))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (3, 10, 4096):
        assert secrets.corpus_words(docs.repartition(1), size=size) == secrets.corpus_words(docs.repartition(13), size=size) == want[:size]
    assert secrets.corpus_words(none) == []


NOVELTY = secrets.Novelty(["ordinary", "words"])
BASE64 = string.ascii_letters + string.digits + "+/"


def spans(text):
    return [(s, e) for s, k, e in secrets.scan_text(text, NOVELTY)]


def places(text, parts):
    return [(text.index(p), text.index(p) + len(p)) for p in parts]


def test_private_key_is_found_to_its_end():
    for width, count in ((64, 25), (76, 20), (64, 2)):
        lines = [random_key(width, BASE64) for _ in range(count)] + [random_key(10, BASE64) + "=="]
        for join in ("\n", "\r\n", "\n    ", "\n> "):
            for head in ("", "Proc-Type: 4,ENCRYPTED" + join + "DEK-Info: none" + join + join):
                text = f"see\n-----BEGIN RSA PRIVATE KEY-----{join}{head}{join.join(lines)}{join}-----END RSA PRIVATE KEY-----\nplain text after it\n"
                assert spans(text) == places(text, lines)
        escaped = '{"private_key": "-----BEGIN PRIVATE KEY-----\\n' + "\\n".join(lines) + '\\n-----END PRIVATE KEY-----\\n", "next": 1}'
        assert all(any(s <= a and b <= e for s, e in spans(escaped)) for a, b in places(escaped, lines))


def test_body_without_a_block():
    lines = [random_key(60, BASE64) for _ in range(12)] + ["Qk3x9A=="]
    text = "credential: |\n  " + "\n  ".join(lines) + "\nother: value\n"
    assert spans(text) == places(text, lines)
    apart = "credential:\n" + lines[0] + "\n\n" + "plain words stand here\n" * 4 + lines[1] + "\n"
    assert spans(apart) == places(apart, lines[:1])
    names = [f"storage-node-{i:02}.example.internal.company.org" for i in range(30)]
    text = "cert hosts:\n" + "\n".join(names)
    assert len(spans(text)) <= 1  # at most the first name is new


def test_redaction_leaves_nothing_of_a_private_key(spark):
    lines = [random_key(64, BASE64) for _ in range(20)] + [random_key(30, BASE64)]
    docs = spark.createDataFrame([(1, "a\n-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END PRIVATE KEY-----\nb")], "doc_id long, text string")
    assert secrets.redact(docs).first()["text"] == "a\n-----BEGIN PRIVATE KEY-----\n" + "[SECRET]\n" * 21 + "-----END PRIVATE KEY-----\nb"


def test_key_written_twice_is_not_its_own_surroundings():
    key = random_key(40)
    for text in (f"the bearer credential is {key} and the session cookie is {key}. ok", f"token = {key}\nplain text\nthe bearer is {key}"):
        got = spans(text)
        assert len(got) == 2 and text.count(key) == 2 and all(key in text[s:e] for s, e in got)
    text = f"{key} the bearer credential is {key} and ok"
    assert spans(text) == [(text.rindex(key), text.rindex(key) + 40)]
    # known from the dictionary, from its surroundings: not new
    for name in ("abcdefghijklmnopqrstuvwxyz0123456789abcd", "getElementById1.getElementById2.documentation"):
        assert not any(k == 3 for _, k, _ in secrets.scan_text(f"the bearer credential is {name} and", NOVELTY))
    other = key[:15] + "x" + key[16:]
    assert not any(text[s:e] == other for text in [f"{key} the bearer credential is {other} and ok"] for s, e in spans(text))


def test_scan_of_broken_keys_is_linear():
    for evil in ("-----BEGIN PRIVATE KEY" * 20000, "-----BEGIN PRIVATE KEY-----\n" * 20000 + "-----END PRIVATE KEY", "private " * 50000, "private \\r\\n" * 30000, "token\n" + "a1" * 9 + "\n" * 90000):
        secrets.scan_text(evil, NOVELTY)
