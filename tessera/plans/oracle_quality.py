"""DuckDB oracle SQL for the content and evaluation queries."""

from __future__ import annotations

from tessera import schemas as S
from tessera.plans.quality_queries import PROB_FULL_CHARS, RULE_MIN_CHARS


def _sr4(e: str) -> str:
    return f"round_even(round_even({e}, 9), 4) + 0.0"


BYTES = """
bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
bc AS (SELECT doc_id, b, count(*) AS n FROM bytes GROUP BY doc_id, b),
bt AS (SELECT doc_id, sum(n) AS tot FROM bc GROUP BY doc_id),
ent AS (SELECT bc.doc_id, 0.0 - sum((bc.n / bt.tot) * log2(bc.n / bt.tot)) AS e
        FROM bc JOIN bt USING (doc_id) GROUP BY bc.doc_id),
files AS (SELECT d.doc_id, d.source, CAST(octet_length(encode(d.text)) AS BIGINT) AS size,
                 CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(ent.e, 0.0) END AS entropy
          FROM documents d LEFT JOIN ent USING (doc_id))"""

BYTE_ENTROPY = f"""
WITH {BYTES}
SELECT doc_id, source, size AS n_bytes, {_sr4('entropy')} AS entropy FROM files
"""

SNAPSHOT = f"""
WITH {BYTES}
SELECT source, {_sr4('COALESCE(avg(entropy), 0.0)')} AS mean_entropy,
  count(*) AS file_count, CAST(COALESCE(sum(size), 0) AS BIGINT) AS total_bytes
FROM files GROUP BY source
"""

FINGERPRINT = """
SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id,
  count(DISTINCT source) AS distinct_source
FROM documents GROUP BY sha256(text) HAVING count(*) > 1
"""

PRED = f"""
pr AS (
  SELECT d.doc_id, d.source, d.lang, l.quality AS y,
    CAST(d.n_chars >= {RULE_MIN_CHARS} AND l.toxic = 0 AS INTEGER) AS p,
    least(d.n_chars / CAST({PROB_FULL_CHARS!r} AS DOUBLE), CAST(1.0 AS DOUBLE)) AS prob
  FROM documents d JOIN labels l USING (doc_id)
),
cls AS (SELECT DISTINCT c FROM (SELECT y AS c FROM pr UNION ALL SELECT p FROM pr) t),
cnt AS (SELECT y AS true_label, p AS pred_label, count(*) AS n FROM pr GROUP BY y, p),
cm AS (SELECT a.c AS true_label, b.c AS pred_label, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS count
       FROM cls a CROSS JOIN cls b
       LEFT JOIN cnt ON cnt.true_label = a.c AND cnt.pred_label = b.c),
rep AS (
  SELECT c.c AS label,
    sum(CASE WHEN cm.true_label = c.c AND cm.pred_label = c.c THEN cm.count END) AS tp,
    sum(CASE WHEN cm.true_label = c.c THEN cm.count END) AS support,
    sum(CASE WHEN cm.pred_label = c.c THEN cm.count END) AS predicted
  FROM cls c CROSS JOIN cm GROUP BY c.c
),
rep2 AS (
  SELECT label, support,
    CASE WHEN predicted <> 0 THEN tp / predicted ELSE 0.0 END AS precision,
    CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS recall
  FROM rep
),
rep3 AS (
  SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1 FROM rep2
)"""

CONFUSION = f"WITH {PRED} SELECT true_label, pred_label, count FROM cm"

CLASS_REPORT = f"""
WITH {PRED}
SELECT label, {_sr4('precision')} AS precision, {_sr4('recall')} AS recall, {_sr4('f1')} AS f1,
  CAST(support AS BIGINT) AS support FROM rep3
"""

AVERAGES = f"""
WITH {PRED}
SELECT {_sr4('avg(precision)')} AS macro_precision, {_sr4('avg(recall)')} AS macro_recall,
  {_sr4('avg(f1)')} AS macro_f1,
  {_sr4('sum(precision * support) / sum(support)')} AS weighted_precision,
  {_sr4('sum(recall * support) / sum(support)')} AS weighted_recall,
  {_sr4('sum(f1 * support) / sum(support)')} AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS support,
  (SELECT {_sr4('avg(CAST(y = p AS DOUBLE))')} FROM pr) AS accuracy
FROM rep3
"""

SAMPLE_VOTES = f"""
WITH {PRED},
yv AS (SELECT source, y, count(*) AS c FROM pr GROUP BY source, y),
ym AS (SELECT source, y AS true_label FROM yv
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, y ASC) = 1),
pv AS (SELECT source, p, count(*) AS c FROM pr GROUP BY source, p),
pm AS (SELECT source, p AS voted_label FROM pv
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, p ASC) = 1),
n AS (SELECT source, count(*) AS windows, avg(CAST(y = p AS DOUBLE)) AS acc FROM pr GROUP BY source)
SELECT source, true_label, voted_label, windows, {_sr4('acc')} AS window_accuracy,
  true_label = voted_label AS correct
FROM ym JOIN pm USING (source) JOIN n USING (source)
"""

MEAN_PROB = f"""
WITH {PRED}
SELECT source, {_sr4('avg(prob)')} AS mean_probability, avg(prob) > {S.VOTE_THRESHOLD} AS positive
FROM pr GROUP BY source
"""

PURITY = f"""
WITH {PRED}
SELECT source, count(DISTINCT y) AS n_labels FROM pr GROUP BY source HAVING count(DISTINCT y) > 1
"""

FOLDS = f"""
WITH {PRED},
f AS (SELECT lang, avg(CAST(y = p AS DOUBLE)) AS accuracy FROM pr GROUP BY lang)
SELECT {_sr4('avg(accuracy)')} AS mean, {_sr4('stddev_pop(accuracy)')} AS std, count(*) AS folds FROM f
"""

ORACLE = {
    "byte_entropy": BYTE_ENTROPY,
    "snapshot_rollup": SNAPSHOT,
    "fingerprint_dupes": FINGERPRINT,
    "confusion": CONFUSION,
    "class_report": CLASS_REPORT,
    "report_averages": AVERAGES,
    "sample_votes": SAMPLE_VOTES,
    "mean_prob_vote": MEAN_PROB,
    "label_purity": PURITY,
    "fold_stats": FOLDS,
}
