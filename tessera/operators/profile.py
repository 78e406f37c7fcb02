"""Data profiling per group.

Everything is long format: one row per (group, column) or per (group,
column, value) for top-k lists, so reports for many samples are one union
(D10) instead of a loop over files.

Plan for the numeric profile:
* moments (count, mean, sample std, skewness, kurtosis) in one wide
  aggregate per group: partial aggregation, no per-group state beyond a few
  doubles per column;
* a value-count table ``(group, column, value) -> n`` built by unpivoting and
  grouping (map-side combined), from which nulls, zeros, negatives, distinct
  counts and the exact linear percentiles are read. ``approx=True`` swaps the
  exact percentile for ``percentile_approx`` when a column's cardinality is
  too large for one task.

Skewness/kurtosis follow the reference: population central moments over the
*sample* standard deviation (T11); NaN when n < 3 (n < 4) or s == 0.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas as S
from tessera.functions.scalar import safe_pct, stable_round
from tessera.storage import join_null_safe, materialize

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def split_columns(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric vs categorical columns by schema type."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        (num if isinstance(f.dataType, NUMERIC_TYPES) else cat).append(f.name)
    return num, cat


def _group_cols(group: Sequence[str]) -> list[str]:
    return list(group)


def _melt(df: DataFrame, group: Sequence[str], cols: Sequence[str], cast: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {cast})" for c in cols)
    return df.select(*group, F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, value)"))


def value_counts(df: DataFrame, group: Sequence[str], cols: Sequence[str],
                 cast: str = "double") -> DataFrame:
    """(group, column_name, value) -> n, nulls included as a value."""
    return _melt(df, group, cols, cast).groupBy(*group, "column_name", "value") \
        .agg(F.count(F.lit(1)).alias("n"))


def exact_percentiles(vc: DataFrame, keys: Sequence[str], percentiles: Sequence[int],
                      partitions: int | None = None) -> DataFrame:
    """Exact linear percentiles (numpy 'linear') from a value-count table
    ``(keys, value, n)`` without holding a whole column in one task.

    1. range-partition by (keys, value) and write the slices: each partition
       holds a contiguous, sorted slice of every column, and both branches
       below read the same ones;
    2. running count inside each (partition, keys) slice -- bounded by the
       partition size;
    3. per-slice totals (#partitions x #columns rows) give each slice's rank
       offset;
    4. the rows whose rank span covers floor(h) or ceil(h), h = (N-1)*p, are
       found by an equi-join on ``keys`` with the few target ranks.
    Returns ``keys, p, value`` (null when a column has no values).
    """
    keys = list(keys)
    spark = vc.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = vc.filter(F.col("value").isNotNull())
    ranged = materialize(v.repartitionByRange(parts, *keys, "value")
                         .withColumn("_pid", F.spark_partition_id()), "value-slices")
    wl = Window.partitionBy("_pid", *keys).orderBy("value") \
        .rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_cum", F.sum("n").over(wl))
    tot = local.groupBy("_pid", *keys).agg(F.sum("n").alias("_t"))
    wo = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.withColumn("_off", F.coalesce(F.sum("_t").over(wo), F.lit(0))) \
        .withColumn("_N", F.sum("_t").over(Window.partitionBy(*keys)))
    ranked = join_null_safe(local, offs, ["_pid", *keys]).withColumn("_end", F.col("_off") + F.col("_cum"))
    ranked = ranked.withColumn("_start", F.col("_end") - F.col("n"))  # ranks [_start, _end)
    tgt = (offs.select(*keys, "_N").distinct()
           .withColumn("p", F.explode(F.array(*[F.lit(float(q)) for q in percentiles])))
           .withColumn("_h", (F.col("_N") - 1).cast("double") * (F.col("p") / F.lit(100.0)))
           .withColumn("_lo", F.floor("_h").cast("bigint"))
           .withColumn("_hi", F.ceil("_h").cast("bigint")))
    hit = join_null_safe(ranked.select(*keys, "value", "_start", "_end"), tgt, keys) \
        .filter(((F.col("_start") <= F.col("_lo")) & (F.col("_lo") < F.col("_end")))
                | ((F.col("_start") <= F.col("_hi")) & (F.col("_hi") < F.col("_end"))))
    res = hit.groupBy(*keys, "p", "_h", "_lo").agg(
        F.max_by("value", F.when((F.col("_start") <= F.col("_lo")) & (F.col("_lo") < F.col("_end")),
                                 F.lit(1))).alias("_vlo"),
        F.max_by("value", F.when((F.col("_start") <= F.col("_hi")) & (F.col("_hi") < F.col("_end")),
                                 F.lit(1))).alias("_vhi"))
    frac = F.col("_h") - F.col("_lo").cast("double")
    return res.select(*keys, "p", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias("value"))


def profile_numeric(df: DataFrame, group: Sequence[str], cols: Sequence[str] | None = None,
                    percentiles: Sequence[int] = S.PROFILE_PERCENTILES, approx: bool = False,
                    digits: int = 4) -> DataFrame:
    """D3, D4, D5, D6, D7, D8 for every numeric column, per group."""
    group = _group_cols(group)
    if cols is None:
        cols, _ = split_columns(df, group)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std"),
                 F.skewness(x).alias(f"{c}|skew"), F.kurtosis(x).alias(f"{c}|kurt")]
    wide = df.groupBy(*group).agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}|mean`, `{c}|std`, `{c}|skew`, `{c}|kurt`" for c in cols)
    moments = wide.select(*group, "_rows", F.expr(
        f"stack({len(cols)}, {pairs}) AS (column_name, mean, std, skew_pop, kurt_pop)"))

    vc = value_counts(df, group, cols)
    fr = [p / 100.0 for p in percentiles]
    nn = F.col("value").isNotNull()
    aggs_pct = []
    if approx:
        aggs_pct = [F.percentile_approx(F.when(nn, F.col("value")), fr, 100000).alias("_pct")]
    counts = vc.groupBy(*group, "column_name").agg(
        F.sum(F.when(nn, F.col("n"))).alias("non_null"),
        F.sum(F.when(~nn, F.col("n"))).alias("nulls"),
        F.sum(F.when(F.col("value") == 0, F.col("n"))).alias("zeros"),
        F.sum(F.when(F.col("value") < 0, F.col("n"))).alias("negatives"),
        F.count_if(nn).alias("distinct_values"),
        *aggs_pct,
        F.min(F.when(nn, F.col("value"))).alias("_any"),
    )
    if not approx:
        pc = exact_percentiles(vc, group + ["column_name"], percentiles)
        pw = pc.groupBy(*group, "column_name").agg(
            F.array(*[F.max(F.when(F.col("p") == float(q), F.col("value"))) for q in percentiles])
            .alias("_pct"))
        counts = join_null_safe(counts, pw, group + ["column_name"], "left")
    out = join_null_safe(moments, counts, group + ["column_name"])
    n = F.coalesce(F.col("non_null"), F.lit(0)).cast("double")
    ratio = (n - 1) / n
    skew = F.when((n >= 3) & (F.col("std") > 0), F.col("skew_pop") * F.pow(ratio, 1.5))
    kurt = F.when((n >= 4) & (F.col("std") > 0),
                  (F.col("kurt_pop") + 3) * F.pow(ratio, 2) - 3)
    rows = F.col("_rows")
    cols_out = [
        *group, "column_name", rows.alias("rows"),
        F.coalesce(F.col("non_null"), F.lit(0)).cast("bigint").alias("non_null"),
        F.coalesce(F.col("nulls"), F.lit(0)).cast("bigint").alias("nulls"),
        F.coalesce(F.col("zeros"), F.lit(0)).cast("bigint").alias("zeros"),
        F.coalesce(F.col("negatives"), F.lit(0)).cast("bigint").alias("negatives"),
        safe_pct(F.coalesce(F.col("zeros"), F.lit(0)), rows).alias("zero_pct"),
        (F.coalesce(F.col("zeros"), F.lit(0)) / rows > F.lit(S.SPARSE_FRACTION)).alias("highly_sparse"),
        stable_round(F.col("mean"), digits).alias("mean"),
        stable_round(F.col("std"), digits).alias("std"),
        stable_round(skew, digits).alias("skewness"),
        stable_round(kurt, digits).alias("kurtosis"),
    ]
    for k, p in enumerate(percentiles):
        cols_out.append(stable_round(F.col("_pct")[k], digits).alias(f"p{p}"))
    cols_out += [
        F.col("distinct_values").cast("bigint").alias("distinct_values"),
        _constancy(F.col("distinct_values")).alias("constancy"),
        F.when(F.col("distinct_values") == 1, F.col("_any")).alias("constant_value"),
    ]
    # K3: sparsity ranking within the group (bounded by the number of columns)
    w = Window.partitionBy(*group).orderBy(F.desc("zeros"), F.asc("column_name")) if group \
        else Window.orderBy(F.desc("zeros"), F.asc("column_name"))
    return out.select(*cols_out).withColumn("sparsity_rank", F.row_number().over(w).cast("bigint"))


def _constancy(distinct: Column) -> Column:
    """CONSTANT (<= 1 distinct non-null), near-constant (<= 5), else null."""
    return (F.when(distinct <= 1, F.lit("CONSTANT"))
            .when(distinct <= S.NEAR_CONSTANT_MAX, F.lit("near-constant")))


def profile_categorical(df: DataFrame, group: Sequence[str], cols: Sequence[str] | None = None,
                        top_n: int = S.PROFILE_TOP_N) -> DataFrame:
    """D9 + K2: cardinality and the top-n values (count desc, value asc) with %.

    One row per (group, column, rank); columns with no values keep one row
    with a null rank.
    """
    group = _group_cols(group)
    if cols is None:
        _, cols = split_columns(df, group)
    vc = value_counts(df, group, cols, cast="string")
    nn = F.col("value").isNotNull()
    # every column's value counts add up to the group's row count: no join needed
    per_col = vc.groupBy(*group, "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(nn, F.col("n"))).alias("non_null"),
        F.sum(F.when(~nn, F.col("n"))).alias("nulls"),
        F.count_if(nn).alias("cardinality"))
    top = top_values(vc.filter(nn), group + ["column_name"], top_n)
    out = join_null_safe(per_col, top, group + ["column_name"], "left")
    return out.select(
        *group, "column_name", "rows",
        F.coalesce(F.col("non_null"), F.lit(0)).cast("bigint").alias("non_null"),
        F.coalesce(F.col("nulls"), F.lit(0)).cast("bigint").alias("nulls"),
        F.col("cardinality").cast("bigint").alias("cardinality"),
        _constancy(F.col("cardinality")).alias("constancy"),
        F.col("rank").cast("bigint").alias("rank"), "value", F.col("count").cast("bigint").alias("count"),
        safe_pct(F.col("count"), F.col("rows")).alias("pct"))


def top_values(vc: DataFrame, keys: Sequence[str], top_n: int, buckets: int = 64) -> DataFrame:
    """K2: exact top-n ``value`` by count desc, value asc, per ``keys``.

    Two levels so that no task ranks a whole high-cardinality column: the
    top-n inside each of ``buckets`` hash buckets of the value, then the top-n
    of those <= buckets*top_n survivors. Any global top-n row is in its
    bucket's top-n, so the result is exact.
    """
    keys = list(keys)
    order = [F.desc("n"), F.asc("value")]
    b = vc.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    w1 = Window.partitionBy(*keys, "_b").orderBy(*order)
    cand = b.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= top_n)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= top_n)
            .select(*keys, "rank", "value", F.col("n").alias("count")))


def profile_overview(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """D1 + U4: rows, columns, duplicate rows (all columns, nulls equal), cells,
    nulls, numeric and categorical column counts per group."""
    group = _group_cols(group)
    num, cat = split_columns(df, group)
    all_num, all_cat = split_columns(df)
    cols = num + cat
    null_total = sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    base = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"),
                                  F.sum(null_total).alias("total_nulls"))
    # rows are compared through a SHA-256 digest of their JSON form (nulls are
    # omitted by name, so null patterns stay distinct): the shuffle carries 32
    # bytes per row instead of whole rows (long texts), and a hot duplicate
    # group is a partial count, not a list
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256)
    dup = (df.groupBy(*group, digest.alias("_d")).agg(F.count(F.lit(1)).alias("_k"))
           .groupBy(*group).agg(F.sum(F.col("_k") - 1).alias("duplicate_rows")))
    out = join_null_safe(base, dup, group)
    ncols = len(cols) + len(group)
    return out.select(
        *group, "rows", F.lit(ncols).cast("bigint").alias("columns"),
        F.col("duplicate_rows").cast("bigint").alias("duplicate_rows"),
        safe_pct(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"),
        (F.col("rows") * ncols).cast("bigint").alias("cells"),
        F.col("total_nulls").cast("bigint").alias("total_nulls"),
        F.lit(len(all_num)).cast("bigint").alias("numeric_columns"),
        F.lit(len(all_cat)).cast("bigint").alias("categorical_columns"))


def nullity(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """D2 + K3: columns with any null, with count and %, ranked by count desc."""
    group = _group_cols(group)
    cols = [c for c in df.columns if c not in group]
    pairs = ", ".join(f"'{c}', CAST(`{c}` IS NULL AS BIGINT)" for c in cols)
    m = df.select(*group, F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, is_null)"))
    g = m.groupBy(*group, "column_name").agg(F.count(F.lit(1)).alias("rows"),
                                             F.sum("is_null").alias("null_count"))
    g = g.filter(F.col("null_count") > 0)
    w = Window.partitionBy(*group).orderBy(F.desc("null_count"), F.asc("column_name"))
    return g.select(*group, "column_name", F.col("null_count").cast("bigint").alias("null_count"),
                    safe_pct(F.col("null_count"), F.col("rows")).alias("null_pct"),
                    F.row_number().over(w).cast("bigint").alias("rank"))
