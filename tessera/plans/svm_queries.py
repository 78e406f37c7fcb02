"""Registered SVM and calibration queries (M9-M12, M14, A37, E5, E6, K6) on landmark features, and SQL for the sigmoid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.scalar import stable_round
from tessera.operators import evaluate as EV
from tessera.operators import extra_trees as ET
from tessera.operators import landmark_svm as LS
from tessera.operators import ml as ML
from tessera.sources import tables as TB

SEED, N_FOLDS = 42, 5
CS, GAMMAS = (0.1, 1.0, 10.0, 100.0), ("scale", "auto", 0.001, 0.01, 0.1)


def _summaries(spark: SparkSession, sf_dir: str):
    from tessera.plans.model_queries import _training

    df, feats, _ = _training(spark, sf_dir)
    return df, feats


def svm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 + M9 + K6: the published 20 points of C and gamma, three stratified folds of samples, all 60 fits in one chain of passes."""
    df, feats = _summaries(spark, sf_dir)
    samples = df.groupBy("sample_name").agg(F.max("label_idx").alias("_label"))
    folds = ML.stratified_folds(samples, "sample_name", "_label", 3).select("sample_name", "fold")
    table = ET.training_table(df.drop("fold").join(folds, "sample_name"), feats, "label_idx", "fold")
    rows = LS.svm_grid(table, len(feats), 2, CS, GAMMAS, range(3), seed=SEED)
    return spark.createDataFrame(rows, "params string, cv_accuracy double, best boolean")


def rff_svm_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M9 + M10 + M14 + E6: RBF SVM, leave-one-fold-out accuracy, fold mean and population std; scaling and landmarks of each fold's training rows."""
    df, feats = _summaries(spark, sf_dir)
    table = ET.training_table(df, feats, "label_idx", "fold")
    problems = [LS.Problem(1.0, "auto", f) for f in range(N_FOLDS)]
    model = LS.LandmarkSVM(len(feats), 2, problems, LS.fit_sides(table, len(feats), 2, range(N_FOLDS), seed=SEED)).fit(table)
    per = model.held_out_hits(table).select(F.col("point").alias("fold"), (F.col("hits") / F.col("n")).alias("accuracy"), "n")
    return _with_summary(per)


def _with_summary(per: DataFrame) -> DataFrame:
    summ = EV.fold_summary(per)
    return per.select(F.col("fold").cast("bigint"), stable_round(F.col("accuracy")).alias("accuracy"), F.col("n").cast("bigint")) \
        .unionByName(summ.select(F.lit(-1).cast("bigint").alias("fold"), stable_round(F.col("mean")).alias("accuracy"), F.col("folds").cast("bigint").alias("n")))


def svm_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 multiclass + E2: one-against-one RBF SVMs over the labelled embeddings, out-of-fold report per class."""
    e = TB.table(spark, sf_dir, "embeddings").filter("label is not null and embedding is not null and vec_id is not null")
    names = [r["label"] for r in e.select("label").distinct().orderBy("label").collect()]  # one row for each class
    d = e.select(F.max(F.size("embedding")).alias("d")).first()["d"] or 1
    index = F.array_position(F.array(*map(F.lit, names)), F.col("label")).cast("int") - 1
    cols = [f"x{i}" for i in range(d)]
    rows = e.select("vec_id", index.alias("y"), *(F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(c) for i, c in enumerate(cols)))
    rows = ML.hash_folds(rows, 3, "vec_id", SEED)
    table = ET.training_table(rows, cols, "y", "fold")
    problems = [LS.Problem(10.0, "scale", f) for f in range(3)]
    model = LS.LandmarkSVM(d, len(names), problems, LS.fit_sides(table, d, len(names), range(3), seed=SEED)).fit(table)
    pred = model.predict(rows, cols, {f: f for f in range(3)}, "fold").select(F.col("y").cast("double").alias("y"), "prediction")
    r = EV.class_report(pred, "y", "prediction")
    return r.select(F.get(F.array(*map(F.lit, names)), F.col("label").cast("int")).cast("bigint").alias("label"),
                    *[stable_round(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def calibrated_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + M11 + M13 + A37 + E5: sigmoid on out-of-fold scores of the training samples, base refitted on all of them,
    mean-probability vote (> 0.40) of each unseen sample. All six fits share one chain of passes."""
    df, feats = _summaries(spark, sf_dir)
    split = ML.split_samples(df, "sample_name", 0.3, SEED)
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    table = ET.training_table(train, feats, "label_idx", "fold")
    problems = [LS.Problem(10.0, "scale", f) for f in (*range(N_FOLDS), None)]
    model = LS.LandmarkSVM(len(feats), 2, problems, LS.fit_sides(table, len(feats), 2, [*range(N_FOLDS), None], seed=SEED)).fit(table)
    scored = ML.materialize(model.predict(train, feats, {f: f for f in range(N_FOLDS)}, "fold").select("score", "label_idx"))
    sigmoid = LS.fit_sigmoid(scored, "score", "label_idx")
    cal = LS.calibrated(model.predict(test, feats, N_FOLDS), "score", sigmoid).select("sample_name", "calibrated", "label_idx")
    votes = EV.mean_probability_vote(cal, "sample_name", "calibrated", S.VOTE_THRESHOLD)
    truth = cal.groupBy("sample_name").agg(F.max("label_idx").alias("true_idx"))
    return votes.join(truth, "sample_name").select(
        "sample_name", stable_round(F.col("mean_probability")).alias("mean_probability"),
        "positive", (F.col("positive") == (F.col("true_idx") == 1)).alias("correct"))


def sigmoid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sigmoid that tells the quality label from a document's length, and its mean probability per label."""
    d = TB.table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.coalesce(F.col("n_chars"), F.lit(0)).cast("double")).alias("s"))
    scored = d.join(TB.table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", F.col("quality").alias("y")), "doc_id")
    a, b = LS.fit_sigmoid(scored, "s", "y")
    p = LS.calibrated(scored, "s", (a, b), "p")
    return p.groupBy(F.col("y").cast("bigint").alias("quality")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_probability")) \
        .select("quality", "n", "mean_probability", F.round(F.lit(a), 5).alias("a"), F.round(F.lit(b), 5).alias("b"))


def _sql_sigmoid(steps: int = LS.SIGMOID_STEPS) -> str:
    sql = ["""WITH r AS (SELECT ln(1 + coalesce(n_chars, 0)::DOUBLE) AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
n AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q FROM r),
t AS (SELECT s, y, CASE WHEN y = 1 THEN (p + 1.0::DOUBLE) / (p + 2) ELSE 1.0::DOUBLE / (q + 2) END AS t FROM r, n),
w0 AS (SELECT 0.0::DOUBLE AS a, ln((q + 1.0::DOUBLE) / (p + 1)) AS b FROM n)"""]
    for k in range(steps):
        sql.append(f"""g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((t - p) * s) AS ga, sum(t - p) AS gb, sum(p * (1 - p) * s * s) + 1e-12 AS haa, sum(p * (1 - p) * s) AS hab,
    sum(p * (1 - p)) + 1e-12 AS hbb FROM (SELECT *, 1 / (1 + exp(a * s + b)) AS p FROM t, w{k})),
w{k + 1} AS (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})""")
    return ",\n".join(sql) + f"""
SELECT y::BIGINT AS quality, count(*) AS n, round(avg(1 / (1 + exp(a * s + b))), 6) AS mean_probability, round(any_value(a), 5) AS a, round(any_value(b), 5) AS b
FROM t, w{steps} GROUP BY y"""


ORACLE = {"sigmoid_fit": _sql_sigmoid()}
