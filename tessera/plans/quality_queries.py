"""Registered content and evaluation queries.

Predictions for the evaluation queries come from a fixed rule on the
documents table (long, non-toxic documents are predicted "quality"), scored
against the ``labels`` table; samples are document sources and folds are
languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.scalar import stable_round
from tessera.operators import content as CT
from tessera.operators import evaluate as EV
from tessera.sources import tables as TB

RULE_MIN_CHARS = 500        # rule: predicted quality = long and not toxic
PROB_FULL_CHARS = 2000.0    # score = min(n_chars / 2000, 1)


def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte entropy of every whole document (UTF-8 bytes)."""
    d = TB.table(spark, sf_dir, "documents")
    b = CT.as_bytes(F.col("text"))
    return d.select("doc_id", "source", F.octet_length(b).cast("bigint").alias("n_bytes"),
                    stable_round(CT.byte_entropy(b)).alias("entropy"))


def snapshot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: mean byte entropy, document count, total bytes."""
    d = TB.table(spark, sf_dir, "documents")
    b = CT.as_bytes(F.col("text"))
    files = d.select("source", CT.byte_entropy(b).alias("entropy"),
                     F.octet_length(b).alias("size"))
    r = CT.snapshot_rollup(files, ["source"])
    return r.select("source", stable_round(F.col("mean_entropy")).alias("mean_entropy"),
                    F.col("file_count").cast("bigint").alias("file_count"), "total_bytes")


def fingerprint_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-identical documents by SHA-256."""
    d = TB.table(spark, sf_dir, "documents")
    return CT.exact_duplicates(d, "text", "doc_id", ["source"]).select(
        "sha256", F.col("copies").cast("bigint").alias("copies"), "first_id",
        F.col("distinct_source").cast("bigint").alias("distinct_source"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = TB.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = TB.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    pred = ((F.col("n_chars") >= RULE_MIN_CHARS) & (F.col("toxic") == 0)).cast("int")
    prob = F.least(F.col("n_chars") / F.lit(PROB_FULL_CHARS), F.lit(1.0))
    return j.select("doc_id", "source", "lang", F.col("quality").alias("y"),
                    pred.alias("p"), prob.alias("prob"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 (+U2): confusion counts over the union of true and predicted labels."""
    return EV.confusion(predictions(spark, sf_dir), "y", "p")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision / recall / F1 / support."""
    r = EV.class_report(predictions(spark, sf_dir), "y", "p")
    return r.select("label", *[stable_round(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


def report_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E3 (+E7 pooled): accuracy, macro and weighted averages."""
    av = EV.averages(EV.class_report(predictions(spark, sf_dir), "y", "p"))
    return av.select(*[stable_round(F.col(c)).alias(c) for c in av.columns if c != "support"], "support")


def sample_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A36 + E5 (+U3): per source majority true label, voted label, agreement."""
    v = EV.sample_verdicts(predictions(spark, sf_dir), "source", "y", "p")
    return v.select("source", "true_label", "voted_label", F.col("windows").cast("bigint"),
                    stable_round(F.col("window_accuracy")).alias("window_accuracy"), "correct")


def mean_prob_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score per source, positive when mean > 0.40."""
    v = EV.mean_probability_vote(predictions(spark, sf_dir), "source", "prob", S.VOTE_THRESHOLD)
    return v.select("source", stable_round(F.col("mean_probability")).alias("mean_probability"),
                    "positive")


def label_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents carry more than one true label."""
    return EV.label_purity(predictions(spark, sf_dir), "source", "y") \
        .select("source", F.col("n_labels").cast("bigint"))


def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 per fold (language) and E6 mean / population std across folds."""
    pr = predictions(spark, sf_dir)
    per = EV.accuracy(pr, "y", "p", ["lang"])
    s = EV.fold_summary(per)
    return s.select(stable_round(F.col("mean")).alias("mean"),
                    stable_round(F.col("std")).alias("std"), F.col("folds").cast("bigint"))
