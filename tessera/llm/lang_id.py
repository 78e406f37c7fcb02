"""Hierarchical language identification.

A text is a bag of hashed byte n-grams of its lower-case letters, as relative
frequencies. A multinomial model predicts the language family; within the
family one linear support vector machine for each pair of languages votes.
All models are linear in the frequencies, so a text's score is the mean of the
weights of its n-grams and costs one pass, whatever its length.

Models are fitted by Spark ML on at most about ``rows_per_language`` labelled
rows of each language (the documented bound), chosen by a hash of the id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Language families by code. Languages that aren't listed are families of their own. Fixed values.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "baltic": ("lt", "lv"),
    "sinitic": ("yue", "zh"),
}
BITS = 15
DIM = 1 << BITS
ORDERS = (2, 3, 4)
SCALE = 100.0
GAP = b"    "  # between texts, longer than an n-gram reaches
BLOCK = 1 << 18  # positions scored at a time
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


def letters(text: str) -> bytes:
    """Lower-case letters as bytes, everything else in ASCII as spaces."""
    return text.lower().encode("utf-8").translate(_KEEP)


def grams(raw: np.ndarray, begin: int, end: int) -> Iterator[np.ndarray]:
    """Hashed n-grams that start at begin..end-1, one array for each order; ``DIM`` where there is white space only."""
    n = end - begin
    part = raw[begin:end + len(GAP)]
    blank = (part[:n] == 32) & (part[1:n + 1] == 32)
    wide = part.astype(np.uint32)
    total = wide[:n] * _MULT[0]
    for k in range(1, max(ORDERS)):
        total = total + wide[k:k + n] * _MULT[k]
        if k + 1 in ORDERS:
            mixed = total * np.uint32(2 * k + 1)
            mixed ^= mixed >> np.uint32(15)
            out = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int64)
            out[blank] = DIM
            yield out


def frequencies(text: str) -> SparseVector:
    raw = np.frombuffer(letters(text) + GAP, np.uint8)
    n, counts = len(raw) - len(GAP), np.zeros(DIM + 1)
    for begin in range(0, n, BLOCK):
        for h in grams(raw, begin, min(n, begin + BLOCK)):
            counts += np.bincount(h, minlength=DIM + 1)
    counts[DIM] = 0
    at = np.flatnonzero(counts)
    return SparseVector(DIM, at.tolist(), (counts[at] * (SCALE / max(1.0, counts.sum()))).tolist())


class Model:
    """Families with their languages, and one weight column for each linear model."""

    def __init__(self, families: list[list[str]], names: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.families, self.names, self.bias = families, names, bias
        # a last row of zeros for n-grams that don't count, a last column that counts the others
        self.weights = np.zeros((DIM + 1, len(names) + 1), np.float32)
        self.weights[:DIM, :-1] = weights
        self.weights[:DIM, -1] = 1

    def scores(self, texts: list[str]) -> np.ndarray:
        """Each model's value on each text."""
        parts = [letters(t) for t in texts]
        raw = np.frombuffer(GAP.join(parts) + GAP, np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + len(GAP))[:-1]]).astype(np.int64)
        # places in gaps belong to no text
        between = np.repeat(np.tile([False, True], len(parts)), np.stack([sizes, np.full(len(parts), len(GAP))], axis=1).ravel())
        n, total = len(raw) - len(GAP), np.zeros((len(texts), self.weights.shape[1]))
        for begin in range(0, n, BLOCK):
            end = min(n, begin + BLOCK)
            lo, hi = np.searchsorted(first, begin, "right") - 1, np.searchsorted(first, end, "left")
            cuts = np.maximum(first[lo:hi], begin) - begin
            for h in grams(raw, begin, end):
                h[between[begin:end]] = DIM
                total[lo:hi] += np.add.reduceat(self.weights[h], cuts, axis=0, dtype=np.float64)
        return total[:, :-1] * (SCALE / np.maximum(1, total[:, -1:])) + self.bias

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and confidence: the family's probability times the winner's share of the pairwise votes."""
        if not self.families:
            return [("und", 0.0)] * len(texts)
        values = self.scores(texts)
        k = len(self.families) if len(self.families) > 1 else 0
        if k:
            exp = np.exp(values[:, :k] - values[:, :k].max(axis=1, keepdims=True))
            prob = exp / exp.sum(axis=1, keepdims=True)
        else:
            prob = np.ones((len(texts), 1))
        column = {name: i for i, name in enumerate(self.names)}
        out = []
        for row, p in zip(values, prob):
            f = int(p.argmax())
            langs, best = self.families[f], float(p[f])
            if len(langs) > 1:
                votes, trust = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
                for a, b in itertools.combinations(langs, 2):
                    margin = float(row[column[f"{a}\0{b}"]])
                    votes[a if margin > 0 else b] += 1
                    share = 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))
                    trust[a] += share / (len(langs) - 1)
                    trust[b] += (1 - share) / (len(langs) - 1)
                lang = max(langs, key=lambda x: (votes[x], trust[x]))
                best *= trust[lang]
            else:
                lang = langs[0]
            out.append((lang, min(1.0, max(0.0, float(best)))))
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1000,
        max_iter: int = 30, reg: float = 1e-3) -> Model:
    """Fit on at most about ``rows_per_language`` rows of each language; rows with null language or text or without letters are left out.

    An empty table gives a model that predicts ``und``.
    """
    spark = labelled.sparkSession
    rows = labelled.select(labelled[id_col].cast("string").alias("id"), labelled[text_col].cast("string").alias("text"),
                           labelled[lang_col].cast("string").alias("lang")).filter("lang is not null and text is not null")
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return Model([], [], np.zeros((DIM, 0)), np.zeros(0))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, rows_per_language / n))) for k, n in sorted(seen.items())))
    chosen = rows.filter((F.xxhash64(F.coalesce("id", F.lit(""))) % 1000003 + 1000003) % 1000003 < share[F.col("lang")] * 1000003).filter(F.col("text").rlike(r"\p{L}"))
    features = F.udf(lambda text: frequencies(text), VectorUDT())
    groups: dict[str, list[str]] = {}
    for lang in sorted(seen):
        groups.setdefault(family_of(lang), []).append(lang)
    families = [groups[k] for k in sorted(groups)]
    index = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(float(i))) for i, langs in enumerate(families) for x in langs))
    train = materialize(chosen.select("lang", index[F.col("lang")].alias("family"), features("text").alias("features")), "lang-sample").coalesce(
        spark.sparkContext.defaultParallelism).persist()
    names, columns, bias = [], [], []
    present = {r["lang"] for r in train.select("lang").distinct().collect()}
    families = [[x for x in langs if x in present] for langs in families]
    try:
        if len([f for f in families if f]) > 1:
            fitted = LogisticRegression(labelCol="family", family="multinomial", maxIter=max_iter, regParam=reg / 10, standardization=False).fit(train)
            dense = fitted.coefficientMatrix.toArray()
            for i in range(len(families)):
                names.append(f"family {i}")
                columns.append(dense[i] if i < len(dense) else np.zeros(DIM))
                bias.append(float(fitted.interceptVector[i]) if i < len(dense) else -1e9)
        for langs in families:
            for a, b in itertools.combinations(langs, 2):
                pair = train.filter(F.col("lang").isin(a, b)).withColumn("label", (F.col("lang") == a).cast("double"))
                fitted = LinearSVC(maxIter=max_iter, regParam=reg, standardization=False).fit(pair)
                names.append(f"{a}\0{b}")
                columns.append(fitted.coefficients.toArray())
                bias.append(float(fitted.intercept))
    finally:
        train.unpersist()
    if len([f for f in families if f]) <= 1:
        families = [f for f in families if f]
    return Model(families, names, np.stack(columns, axis=1) if columns else np.zeros((DIM, 0)), np.array(bias))


def predictor(docs: DataFrame, model: Model):
    """An Arrow UDF from a text column to struct<lang_pred, score>; ``und`` and 0 for null texts and texts without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), 128):
            part = texts.slice(at, 128).to_pylist()
            told = [t if t and any(c.isalpha() for c in t) else None for t in part]
            found = iter(shared.value.predict([t for t in told if t]) if any(told) else [])
            for t in told:
                lang, score = next(found) if t else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1000) -> DataFrame:
    """Learn from the rows that aren't held out and predict every row: ``id_col``, held_out, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0; a row with
    null id isn't held out. Repeated rows get the same prediction; an empty
    table gives no rows; other columns are ignored; texts are read whole.
    """
    rows = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"), docs[lang_col].cast("string").alias("__lang"),
                       held_out(docs[id_col]).alias("__held_out"))
    model = fit(rows.filter(~F.col("__held_out")), id_col, "__text", "__lang", rows_per_language)
    out = rows.withColumn("__p", predictor(docs, model)(F.col("__text")))
    return out.select(id_col, F.col("__held_out").alias("held_out"), F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1000,
                    min_score: float = 0.0) -> DataFrame:
    """The rows, unchanged, whose language is told: not ``und`` and with a score of at least ``min_score``."""
    held = docs.select(docs[id_col], docs[text_col], docs[lang_col]).filter(~held_out(docs[id_col]))
    predict = predictor(docs, fit(held, id_col, text_col, lang_col, rows_per_language))
    told = predict(docs[text_col].cast("string"))
    return docs.withColumn("__told", told).filter((F.col("__told.lang_pred") != "und") & (F.col("__told.score") >= min_score)).drop("__told")
