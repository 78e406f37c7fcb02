"""DuckDB oracle SQL for the preparation queries."""

from __future__ import annotations

from tessera.plans.prep_queries import ASOF_TOLERANCE_S, SCALE_COLS, TRAIN_BEFORE


def _sr(e: str, d: int = 4) -> str:
    return f"round_even(round_even({e}, 9), {d}) + 0.0"


def _r4(e: str) -> str:
    return f"round_even({e}, 4) + 0.0"


SPLIT = f"""
li AS (SELECT l_orderkey, l_linenumber, {', '.join(SCALE_COLS)},
              l_shipdate < TIMESTAMP '{TRAIN_BEFORE}' AS is_train FROM lineitem)"""

MINMAX = f"""
WITH {SPLIT},
st AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in SCALE_COLS)}
       FROM li WHERE is_train)
SELECT l_orderkey, l_linenumber, is_train,
  {', '.join(_r4(f'(CAST({c} AS DOUBLE) - st.{c}_lo) / (CASE WHEN st.{c}_hi <> st.{c}_lo THEN st.{c}_hi - st.{c}_lo ELSE 1.0 END)') + f' AS {c}' for c in SCALE_COLS)}
FROM li CROSS JOIN st
"""

STANDARD = f"""
WITH {SPLIT},
st AS (SELECT {', '.join(f'avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd' for c in SCALE_COLS)}
       FROM li WHERE is_train)
SELECT l_orderkey, l_linenumber, is_train,
  {', '.join(_sr(f'(CAST({c} AS DOUBLE) - st.{c}_mu) / (CASE WHEN st.{c}_sd <> 0 THEN st.{c}_sd ELSE 1.0 END)') + f' AS {c}' for c in SCALE_COLS)}
FROM li CROSS JOIN st
"""

MEDIAN = """
WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) AS mq, quantile_cont(CAST(toxic AS DOUBLE), 0.5) AS mt FROM j)
SELECT doc_id, COALESCE(CAST(quality AS DOUBLE), m.mq) AS quality,
       COALESCE(CAST(toxic AS DOUBLE), m.mt) AS toxic
FROM j CROSS JOIN m
"""

WEIGHTS = f"""
WITH c AS (SELECT quality, count(*) AS count FROM labels GROUP BY quality),
t AS (SELECT sum(count) AS n, count(*) AS k, sum(1.0 / (count + CAST(1e-6 AS DOUBLE))) AS s FROM c)
SELECT quality, count,
  {_sr('t.n / (t.k * c.count)')} AS weight_balanced,
  {_sr('(1.0 / (c.count + CAST(1e-6 AS DOUBLE))) / t.s * t.k')} AS weight_inverse
FROM c CROSS JOIN t
"""

ENCODE = """
WITH cls AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS lang_index
             FROM (SELECT DISTINCT lang FROM documents) t)
SELECT d.doc_id, d.lang, cls.lang_index, CAST(CASE WHEN d.lang = 'en' THEN 1.0 ELSE -1.0 END AS DOUBLE) AS en_pm1
FROM documents d LEFT JOIN cls USING (lang)
"""

GAMMA = f"""
WITH c AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS d FROM embeddings)
SELECT max(d) AS d, count(*) AS cells, {_sr('var_pop(x)', 6)} AS var,
  {_sr('1.0 / (max(d) * var_pop(x))', 6)} AS gamma_scale, {_sr('1.0 / max(d)', 6)} AS gamma_auto
FROM c
"""

CENTROID = f"""
WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS c FROM l GROUP BY label, i),
p AS (SELECT l.vec_id, l.label, sum((l.x - c.c) * (l.x - c.c)) AS sq, count(*) AS d
      FROM l JOIN c USING (label, i) GROUP BY l.vec_id, l.label)
SELECT vec_id, label, {_sr('sq')} AS sq_dist, d, {_sr('exp(-(1.0 / d) * sq)')} AS rbf FROM p
"""

ASOF = f"""
WITH ev AS (SELECT *, epoch_us(ts) / 1e6 AS ts_s FROM events),
pu AS (SELECT user_id, event_id, ts_s FROM ev WHERE event_type = 'purchase'),
vw AS (SELECT user_id, ts_s AS epoch, value, event_id FROM ev WHERE event_type = 'view'),
bt AS (SELECT user_id, epoch, arg_max(value, event_id) AS value FROM vw GROUP BY user_id, epoch),
bp AS (SELECT user_id, epoch, arg_max(value, event_id) AS value, min(event_id) AS pos
       FROM vw GROUP BY user_id, epoch),
m1 AS (SELECT p.user_id, p.event_id, arg_min(b.value, b.epoch) AS v FROM pu p JOIN bt b
       ON b.user_id = p.user_id AND abs(b.epoch - p.ts_s) < CAST({ASOF_TOLERANCE_S!r} AS DOUBLE)
       GROUP BY p.user_id, p.event_id),
m2 AS (SELECT p.user_id, p.event_id, arg_min(b.value, b.pos) AS v FROM pu p JOIN bp b
       ON b.user_id = p.user_id AND abs(b.epoch - p.ts_s) < CAST({ASOF_TOLERANCE_S!r} AS DOUBLE)
       GROUP BY p.user_id, p.event_id)
SELECT p.user_id, p.event_id, COALESCE(m1.v, 0.0) AS first_by_time, COALESCE(m2.v, 0.0) AS first_by_order
FROM pu p LEFT JOIN m1 USING (user_id, event_id) LEFT JOIN m2 USING (user_id, event_id)
"""

STRATIFIED = """
WITH r AS (
    SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM labels
)
SELECT fold::INTEGER AS fold, quality, count(*) AS n, min(doc_id) AS first_id, sum(doc_id)::BIGINT AS id_sum
FROM r GROUP BY 1, 2
"""

ORACLE = {
    "stratified_folds": STRATIFIED,
    "minmax": MINMAX,
    "standardize": STANDARD,
    "median_impute": MEDIAN,
    "class_weights": WEIGHTS,
    "label_encode": ENCODE,
    "gamma_rules": GAMMA,
    "centroid_kernel": CENTROID,
    "asof_views": ASOF,
}
