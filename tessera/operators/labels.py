"""Labels, encodings, class weights and feature scaling.

Scalers follow the fit/transform split of MLlib: ``fit`` is one aggregate
whose single row (a few numbers per column) comes back to the driver, and
``transform`` applies them as literals, so no join against the data is
needed. Constant columns scale to 0 (range or std replaced by 1), and test
data is not clipped.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- labels


def binary_label(category: Column, benign: str = "goodware",
                 positive: str = "ransomware") -> Column:
    """Binary task: the benign category keeps its name, everything else is positive."""
    return F.when(category == benign, F.lit(benign)).otherwise(F.lit(positive))


def collapsed_label(category: Column, sample: Column, benign: str = "goodware") -> Column:
    """Multiclass with all benign samples collapsed into one class."""
    return F.when(category == benign, F.lit(benign)).otherwise(sample)


def per_sample_label(sample: Column) -> Column:
    """Cross-run multiclass: every sample is its own class."""
    return sample


def pm_one(label: Column, positive) -> Column:
    """M5: +1.0 for the positive class, -1.0 otherwise."""
    return F.when(label == F.lit(positive), F.lit(1.0)).otherwise(F.lit(-1.0))


def label_index(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """M4: 0-based index of the label in sorted (ascending) order of distinct labels.

    The distinct-label table is small (one row per class); the join has no
    hint, so AQE broadcasts it when its materialized size allows.
    """
    classes = df.select(label).distinct()
    w = Window.orderBy(F.col(label).asc_nulls_last())  # one row per class
    idx = classes.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    return df.join(idx, label, "left")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """A39 + A40: per class, ``balanced`` n/(k*n_c) and inverse frequency
    1/(n_c+1e-6) renormalized to sum to k."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # k rows, one per class
    n = F.sum("count").over(w)
    k = F.count(F.lit(1)).over(w)
    inv = F.lit(1.0) / (F.col("count") + F.lit(1e-6))
    return (counts.withColumn("_inv", inv)
            .select(label, F.col("count").cast("bigint").alias("count"),
                    (n / (k * F.col("count"))).alias("weight_balanced"),
                    (F.col("_inv") / F.sum("_inv").over(w) * k).alias("weight_inverse")))


# ---------------------------------------------------------------- scalers (M1-M3)


def _one_row(df: DataFrame, aggs: list[Column]) -> dict:
    return df.agg(*aggs).first().asDict()


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict:
    """M2 fit: per-column min and max (one aggregate)."""
    return _one_row(df, [f(c).alias(f"{c}|{f.__name__}") for c in cols for f in (F.min, F.max)])


def transform_minmax(df: DataFrame, cols: Sequence[str], model: dict,
                     suffix: str = "") -> DataFrame:
    out = df
    for c in cols:
        lo, hi = model[f"{c}|min"], model[f"{c}|max"]
        rng = (hi - lo) if (hi is not None and lo is not None and hi != lo) else 1.0
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(float(lo or 0.0)))
                             / F.lit(float(rng)))
    return out


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict:
    """M3 fit: mean and *population* std per column."""
    return _one_row(df, [e for c in cols for e in (F.avg(c).alias(f"{c}|mean"),
                                                   F.stddev_pop(c).alias(f"{c}|std"))])


def transform_standard(df: DataFrame, cols: Sequence[str], model: dict,
                       suffix: str = "") -> DataFrame:
    out = df
    for c in cols:
        mu, sd = model[f"{c}|mean"], model[f"{c}|std"]
        sd = sd if sd else 1.0
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(float(mu or 0.0)))
                             / F.lit(float(sd)))
    return out


def fit_median(df: DataFrame, cols: Sequence[str]) -> dict:
    """M1 fit: exact median (linear interpolation) of the non-null values; null for a column without any.

    Ranks come from range-partitioned value counts, so no task holds a column.
    """
    from tessera.operators.profile import exact_percentiles, value_counts

    found = exact_percentiles(value_counts(df, [], cols), ["column_name"], [50]).collect()  # one row per column
    return {c: None for c in cols} | {r["column_name"]: r["value"] for r in found}


def transform_impute(df: DataFrame, cols: Sequence[str], model: dict,
                     suffix: str = "") -> DataFrame:
    out = df
    for c in cols:
        fill = model[c]
        out = out.withColumn(c + suffix, F.coalesce(F.col(c).cast("double"),
                                                    F.lit(fill).cast("double")))
    return out


# ---------------------------------------------------------------- kernel helpers


def gamma_rules(df: DataFrame, vec: str) -> DataFrame:
    """Gamma 'scale' = 1/(d * Var(all cells)), 'auto' = 1/d (population variance)."""
    cells = df.select(F.explode(vec).alias("x"), F.size(vec).alias("d"))
    return cells.agg(F.max("d").cast("bigint").alias("d"),
                     F.count(F.lit(1)).alias("cells"),
                     F.var_pop(F.col("x").cast("double")).alias("var")) \
        .select("d", "cells", "var",
                (F.lit(1.0) / (F.col("d") * F.col("var"))).alias("gamma_scale"),
                (F.lit(1.0) / F.col("d")).alias("gamma_auto"))


def sq_distance(a: Column, b: Column) -> Column:
    """F8: sum of squared differences of two equal-length arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, v: acc + v)


def rbf(sq_dist: Column, gamma: Column) -> Column:
    """F8: exp(-gamma * d^2)."""
    return F.exp(-gamma * sq_dist)


def centroid_kernel(df: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """M15 re-aimed: RBF kernel of every vector to its own class centroid.

    The pairwise n x n kernel is not built (it grows with n^2); landmarks are
    the class centroids, one array for each class from a (class, dimension)
    aggregate, joined to the rows by class. gamma is 'auto' (1/d).
    """
    means = df.select(label, F.posexplode(vec).alias("i", "x")).groupBy(label, "i").agg(
        F.avg(F.col("x").cast("double")).alias("c"))
    cent = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("_c"))
    j = df.select(id_col, label, F.transform(vec, lambda v: v.cast("double")).alias("_x")).join(cent, label)
    per = j.select(id_col, label, sq_distance(F.col("_x"), F.slice("_c", F.lit(1), F.size("_x"))).alias("sq_dist"),
                   F.size("_x").cast("bigint").alias("d"))
    return per.select(id_col, label, "sq_dist", "d",
                      rbf(F.col("sq_dist"), F.lit(1.0) / F.col("d")).alias("rbf"))
