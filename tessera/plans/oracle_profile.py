"""DuckDB oracle SQL for the profiling queries."""

from __future__ import annotations

from tessera import schemas as S
from tessera.plans.profile_queries import LEVEL_KEYS, LEVEL_NUMERIC, LINEITEM_NUMERIC


def _sr4(e: str) -> str:
    return f"round_even(round_even({e}, 9), 4) + 0.0"


def _pct(num: str, den: str) -> str:
    return f"round_even(CAST({num} AS DOUBLE) * 100.0 / {den}, 2) + 0.0"


def _numeric() -> str:
    cols = LINEITEM_NUMERIC
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    ps = ", ".join(repr(p / 100.0) for p in S.PROFILE_PERCENTILES)
    pcols = ",\n  ".join(f"{_sr4(f'pc.q[{k + 1}]')} AS p{p}"
                         for k, p in enumerate(S.PROFILE_PERCENTILES))
    return f"""
WITH src AS (SELECT l_returnflag, {casts} FROM lineitem),
u AS (SELECT * FROM src UNPIVOT INCLUDE NULLS (value FOR column_name IN ({', '.join(cols)}))),
nrows AS (SELECT l_returnflag, count(*) AS nr FROM lineitem GROUP BY l_returnflag),
mom AS (SELECT l_returnflag, column_name, avg(value) AS mean, stddev_samp(value) AS std,
               count(value) AS n FROM u GROUP BY l_returnflag, column_name),
cm AS (SELECT u.l_returnflag, u.column_name, avg(power(u.value - m.mean, 3)) AS m3,
              avg(power(u.value - m.mean, 4)) AS m4
       FROM u JOIN mom m ON m.l_returnflag = u.l_returnflag AND m.column_name = u.column_name
       WHERE u.value IS NOT NULL GROUP BY u.l_returnflag, u.column_name),
pc AS (SELECT l_returnflag, column_name, count(value) AS non_null, count(*) - count(value) AS nulls,
              count(CASE WHEN value = 0 THEN 1 END) AS zeros,
              count(CASE WHEN value < 0 THEN 1 END) AS negatives,
              count(DISTINCT value) AS distinct_values,
              quantile_cont(value, [{ps}]) AS q, min(value) AS anyv
       FROM u GROUP BY l_returnflag, column_name),
res AS (
SELECT pc.l_returnflag, pc.column_name, nr.nr AS rows, pc.non_null, pc.nulls, pc.zeros, pc.negatives,
  {_pct('pc.zeros', 'nr.nr')} AS zero_pct,
  CAST(pc.zeros AS DOUBLE) / nr.nr > {S.SPARSE_FRACTION} AS highly_sparse,
  {_sr4('m.mean')} AS mean, {_sr4('m.std')} AS std,
  {_sr4('CASE WHEN m.n >= 3 AND m.std > 0 THEN cm.m3 / power(m.std, 3) END')} AS skewness,
  {_sr4('CASE WHEN m.n >= 4 AND m.std > 0 THEN cm.m4 / power(m.std, 4) - 3 END')} AS kurtosis,
  {pcols},
  pc.distinct_values,
  CASE WHEN pc.distinct_values <= 1 THEN 'CONSTANT'
       WHEN pc.distinct_values <= {S.NEAR_CONSTANT_MAX} THEN 'near-constant' END AS constancy,
  CASE WHEN pc.distinct_values = 1 THEN pc.anyv END AS constant_value
FROM pc JOIN mom m USING (l_returnflag, column_name) JOIN cm USING (l_returnflag, column_name)
JOIN nrows nr USING (l_returnflag))
SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY zeros DESC, column_name ASC) AS sparsity_rank
FROM res
"""


def _categorical(table: str, cols: list[str]) -> str:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    return f"""
WITH src AS (SELECT {casts} FROM {table}),
u AS (SELECT * FROM src UNPIVOT INCLUDE NULLS (value FOR column_name IN ({', '.join(cols)}))),
vc AS (SELECT column_name, value, count(*) AS n FROM u GROUP BY column_name, value),
pc AS (SELECT column_name, sum(CASE WHEN value IS NOT NULL THEN n END) AS non_null,
              sum(CASE WHEN value IS NULL THEN n END) AS nulls, count(value) AS cardinality
       FROM vc GROUP BY column_name),
top AS (SELECT column_name, value, n,
               row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS rank
        FROM vc WHERE value IS NOT NULL QUALIFY rank <= {S.PROFILE_TOP_N}),
nr AS (SELECT count(*) AS rows FROM {table})
SELECT pc.column_name, nr.rows, CAST(COALESCE(pc.non_null, 0) AS BIGINT) AS non_null,
  CAST(COALESCE(pc.nulls, 0) AS BIGINT) AS nulls, pc.cardinality,
  CASE WHEN pc.cardinality <= 1 THEN 'CONSTANT'
       WHEN pc.cardinality <= {S.NEAR_CONSTANT_MAX} THEN 'near-constant' END AS constancy,
  top.rank, top.value, top.n AS count, {_pct('top.n', 'nr.rows')} AS pct
FROM pc CROSS JOIN nr LEFT JOIN top USING (column_name)
"""


def _overview(cols: list[str], numeric: int) -> str:
    """Overview of documents by source over ``cols`` (source among them), ``numeric`` of them numbers."""
    rest = [c for c in cols if c != "source"]
    nulls = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in rest)
    n = len(cols)
    return f"""
WITH d AS (SELECT {', '.join(cols)} FROM documents),
base AS (SELECT source, count(*) AS rows, sum({nulls}) AS total_nulls FROM d GROUP BY source),
dup AS (SELECT source, sum(k - 1) AS duplicate_rows
        FROM (SELECT source, {', '.join(rest)}, count(*) AS k FROM d GROUP BY source, {', '.join(rest)}) t
        GROUP BY source)
SELECT source, rows, CAST({n} AS BIGINT) AS columns, CAST(duplicate_rows AS BIGINT) AS duplicate_rows,
  {_pct('duplicate_rows', 'rows')} AS duplicate_pct, rows * {n} AS cells,
  CAST(total_nulls AS BIGINT) AS total_nulls, CAST({numeric} AS BIGINT) AS numeric_columns,
  CAST({n - numeric} AS BIGINT) AS categorical_columns
FROM base JOIN dup USING (source)
"""


def _levels() -> str:
    """Every level from the rows themselves, without any merge."""
    keys, cols = LEVEL_KEYS, LEVEL_NUMERIC
    k = ", ".join(keys)
    same = " AND ".join(f"m.{c} IS NOT DISTINCT FROM r.{c}" for c in keys)
    rolled = "\nUNION ALL ".join(
        f"SELECT {d} AS level, {', '.join(c if i < d else f'NULL AS {c}' for i, c in enumerate(keys))}, column_name, value FROM u" for d in range(len(keys), -1, -1))
    return f"""
WITH src AS (SELECT {k}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM lineitem),
u AS (SELECT * FROM src UNPIVOT INCLUDE NULLS (value FOR column_name IN ({', '.join(cols)}))),
r AS ({rolled}),
m AS (SELECT level, {k}, column_name, count(*) AS rows, count(value) AS non_null, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value < 0) AS negatives,
             min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS std FROM r GROUP BY ALL),
c AS (SELECT r.level, {', '.join(f'r.{c}' for c in keys)}, r.column_name, avg(power(value - mean, 3)) AS m3, avg(power(value - mean, 4)) AS m4
      FROM r JOIN m ON m.level = r.level AND m.column_name = r.column_name AND {same} GROUP BY ALL)
SELECT m.level, {', '.join(f'm.{c}' for c in keys)}, m.column_name, rows, non_null, rows - non_null AS nulls, zeros, negatives, {_pct('zeros', 'rows')} AS zero_pct,
  CAST(zeros AS DOUBLE) / rows > {S.SPARSE_FRACTION} AS highly_sparse, lo AS min, hi AS max, {_sr4('mean')} AS mean, {_sr4('std')} AS std,
  CASE WHEN non_null >= 3 AND lo < hi THEN {_sr4('m3 / power(std, 3)')} END AS skewness, CASE WHEN non_null >= 4 AND lo < hi THEN {_sr4('m4 / power(std, 4) - 3')} END AS kurtosis
FROM m JOIN c r ON m.level = r.level AND m.column_name = r.column_name AND {same}
"""


NULLITY = f"""
WITH j AS (SELECT d.source, d.lang, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
m AS (SELECT source, 'lang' AS column_name, CAST(lang IS NULL AS BIGINT) AS isn FROM j
      UNION ALL SELECT source, 'quality', CAST(quality IS NULL AS BIGINT) FROM j
      UNION ALL SELECT source, 'toxic', CAST(toxic IS NULL AS BIGINT) FROM j),
g AS (SELECT source, column_name, count(*) AS rows, sum(isn) AS null_count FROM m
      GROUP BY source, column_name HAVING sum(isn) > 0)
SELECT source, column_name, CAST(null_count AS BIGINT) AS null_count,
  {_pct('null_count', 'rows')} AS null_pct,
  row_number() OVER (PARTITION BY source ORDER BY null_count DESC, column_name ASC) AS rank
FROM g
"""

ORACLE = {
    "profile_numeric": _numeric(),
    "profile_categorical": _categorical("orders", ["o_orderstatus", "o_orderpriority"]),
    "profile_categorical_all": _categorical("orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"]),
    "profile_overview": _overview(["source", "text", "lang"], 0),
    "profile_overview_all": _overview(["source", "doc_id", "text", "lang", "n_chars"], 2),
    "nullity": NULLITY,
    "profile_levels": _levels(),
}
