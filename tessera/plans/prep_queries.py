"""Registered feature-preparation queries.

Train/test split for the scalers is by ship date (train before 1998), so the
fit runs on one part and the transform on the whole table, unclipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import round4, stable_round
from tessera.operators import labels as LB
from tessera.operators.joins import asof_first_match_many, dedupe_timeline
from tessera.sources import tables as TB

SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TRAIN_BEFORE = "1998-01-01"
ASOF_TOLERANCE_S = 3600.0


def _lineitem_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = TB.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *SCALE_COLS,
                     (F.col("l_shipdate") < F.lit(TRAIN_BEFORE).cast("timestamp_ntz"))
                     .alias("is_train"))


def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: min-max scaling fit on the train rows, applied to all rows."""
    df = _lineitem_split(spark, sf_dir)
    model = LB.fit_minmax(df.filter("is_train"), SCALE_COLS)
    out = LB.transform_minmax(df, SCALE_COLS, model)
    return out.select("l_orderkey", "l_linenumber", "is_train",
                      *[round4(F.col(c)).alias(c) for c in SCALE_COLS])


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: z-scores with population std, fit on the train rows."""
    df = _lineitem_split(spark, sf_dir)
    model = LB.fit_standard(df.filter("is_train"), SCALE_COLS)
    out = LB.transform_standard(df, SCALE_COLS, model)
    return out.select("l_orderkey", "l_linenumber", "is_train",
                      *[stable_round(F.col(c)).alias(c) for c in SCALE_COLS])


def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: exact-median imputation of label columns missing after a left join."""
    d = TB.table(spark, sf_dir, "documents").select("doc_id")
    lab = TB.table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    model = LB.fit_median(j, ["quality", "toxic"])
    return LB.transform_impute(j, ["quality", "toxic"], model).select(
        "doc_id", F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A39 + A40: balanced and inverse-frequency weights of the quality label."""
    lab = TB.table(spark, sf_dir, "labels")
    w = LB.class_weights(lab, "quality")
    return w.select("quality", "count", stable_round(F.col("weight_balanced")).alias("weight_balanced"),
                    stable_round(F.col("weight_inverse")).alias("weight_inverse"))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M5: alphabetical index of the language, +-1 target for English."""
    d = TB.table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = LB.label_index(d, "lang", "lang_index")
    return out.select("doc_id", "lang", "lang_index", LB.pm_one(F.col("lang"), "en").alias("en_pm1"))


def gamma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma 'scale' and 'auto' over every embedding cell."""
    e = TB.table(spark, sf_dir, "embeddings")
    g = LB.gamma_rules(e, "embedding")
    return g.select("d", "cells", stable_round(F.col("var"), 6).alias("var"),
                    stable_round(F.col("gamma_scale"), 6).alias("gamma_scale"),
                    stable_round(F.col("gamma_auto"), 6).alias("gamma_auto"))


def centroid_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 + M15: RBF similarity of each embedding to its class centroid."""
    e = TB.table(spark, sf_dir, "embeddings")
    k = LB.centroid_kernel(e, "vec_id", "embedding", "label")
    return k.select("vec_id", "label", stable_round(F.col("sq_dist")).alias("sq_dist"),
                    F.col("d").cast("bigint").alias("d"), stable_round(F.col("rbf")).alias("rbf"))


def asof_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2: for every purchase, the view of the same user within one hour
    that comes first by time (J1) and first by event order (J2); 0.0 if none."""
    ev = TB.table(spark, sf_dir, "events").withColumn("ts_s", TB.events_ts_seconds())
    keys = ["user_id"]
    purchases = ev.filter(F.col("event_type") == "purchase").select("user_id", "event_id", "ts_s")
    views = ev.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts_s").alias("epoch"), F.col("value"), F.col("event_id").alias("row_order"))
    by_time = dedupe_timeline(views, keys, "epoch", "row_order", ["value"], "last")
    by_pos = dedupe_timeline(views, keys, "epoch", "row_order", ["value"], "first")
    by_time = by_time.withColumnRenamed("value", "first_by_time")
    by_pos = by_pos.withColumnRenamed("value", "first_by_order")
    m = asof_first_match_many(purchases, [(by_time, "epoch", "epoch", "first_by_time"),
                                          (by_pos, "epoch", "row_order", "first_by_order")],
                              keys, ["event_id"], "ts_s", ASOF_TOLERANCE_S)
    out = purchases.join(m, keys + ["event_id"], "left")
    return out.select("user_id", "event_id",
                      F.coalesce("first_by_time", F.lit(0.0)).alias("first_by_time"),
                      F.coalesce("first_by_order", F.lit(0.0)).alias("first_by_order"))
