"""DuckDB oracle SQL for the resampling and sliding-summary queries."""

from __future__ import annotations

from tessera import schemas as S
from tessera.operators.sliding import summary_names
from tessera.plans import oracle_trace as OT
from tessera.sources import tables as TB

FEAT = f"feat AS ({OT.TRACE_FEATURES})"
ALL_COLS = list(S.FEATURE_COLUMNS)
NO_INDEX = [c for c in ALL_COLS if c != "window_idx"]

LABELS = """
labels_u AS (
  SELECT user_id AS sample_id,
    CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END)
              > count(CASE WHEN event_type = 'view' THEN 1 END)
         THEN 'ransomware' ELSE 'goodware' END AS binary_label,
    printf('user_%d', user_id) AS sample_name
  FROM events GROUP BY user_id
)"""


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _targets(N: int, grid: str, other_rule: str | None = None) -> str:
    pos = (f"CASE WHEN i = {N - 1} THEN CAST(n - 1 AS DOUBLE) "
           f"ELSE CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / {_d(float(N - 1))}) END")
    down = f"CASE WHEN i = {N - 1} THEN n - 1 ELSE CAST(trunc(pos) AS BIGINT) END"

    def ux(j: str) -> str:
        return (f"(CASE WHEN {j} >= n - 1 THEN CAST(1.0 AS DOUBLE) "
                f"ELSE CAST({j} AS DOUBLE) * (CAST(1.0 AS DOUBLE) / CAST(n - 1 AS DOUBLE)) END)")

    if grid == "index":
        x = "pos"
        j = "least(CAST(floor(pos) AS BIGINT), n - 1)"
    else:
        x = f"(CASE WHEN i = {N - 1} THEN CAST(1.0 AS DOUBLE) ELSE CAST(i AS DOUBLE) * {_d(1.0 / (N - 1))} END)"
        j0 = f"CAST(floor({x} * CAST(n - 1 AS DOUBLE)) AS BIGINT)"
        j = (f"greatest(least(CASE WHEN {ux(j0)} > {x} THEN {j0} - 1 "
             f"WHEN {j0} + 1 <= n - 1 AND {ux(f'({j0} + 1)')} <= {x} THEN {j0} + 1 ELSE {j0} END, n - 1), 0)")
    near = ""
    if other_rule == "nearest":
        near = f", CASE WHEN n < {N} THEN CAST(round_even(pos, 0) AS BIGINT) ELSE lo END AS near"
    elif other_rule == "fill":
        near = f", CASE WHEN n < {N} THEN least(i, n - 1) ELSE lo END AS near"
    xlo = "CAST(lo AS DOUBLE)" if grid == "index" else ux("lo")
    xhi = "CAST(hi AS DOUBLE)" if grid == "index" else ux("hi")
    return f"""
cnt AS (SELECT sample_id, count(*) AS n FROM feat GROUP BY sample_id),
tg AS (SELECT c.sample_id, c.n, CAST(r.i AS BIGINT) AS i FROM cnt c CROSS JOIN range(0, {N}) AS r(i)),
tp AS (SELECT *, {pos} AS pos FROM tg),
tq AS (SELECT *, {x} AS x,
  CASE WHEN n = {N} THEN i WHEN n > {N} THEN {down} ELSE {j} END AS lo,
  CASE WHEN n < {N} THEN least({j} + 1, n - 1) END AS hi FROM tp),
tr AS (SELECT *, {xlo} AS xlo, {xhi} AS xhi{near} FROM tq)"""


def _lerp(c: str) -> str:
    a, b = f"CAST(a.{c} AS DOUBLE)", f"CAST(b.{c} AS DOUBLE)"
    return (f"CASE WHEN t.hi IS NULL OR t.hi = t.lo OR t.x = t.xlo THEN {a} "
            f"ELSE (({b} - {a}) / (t.xhi - t.xlo)) * (t.x - t.xlo) + {a} END")


def _r4(e: str) -> str:
    return f"round_even({e}, 4) + 0.0"


def _sr4(e: str) -> str:
    return f"round_even(round_even({e}, 9), 4) + 0.0"


def normalize_sql(rounded: bool = True) -> str:
    N = TB.EVENTS_TARGET_ROWS
    cols = ",\n  ".join((_r4(_lerp(c)) if rounded else _lerp(c)) + f" AS {c}" for c in NO_INDEX)
    return f"""
WITH {FEAT}, {_targets(N, 'index')}
SELECT t.sample_id, t.i AS row_idx, CAST(t.i AS DOUBLE) AS window_idx,
  {cols}
FROM tr t JOIN feat a ON a.sample_id = t.sample_id AND a.window_idx = t.lo
LEFT JOIN feat b ON b.sample_id = t.sample_id AND b.window_idx = t.hi
"""


def interpolate_sql() -> str:
    N = 40
    cols = ",\n  ".join(_r4(_lerp(c)) + f" AS {c}" for c in ALL_COLS)
    return f"""
WITH {FEAT}, {_targets(N, 'unit')}
SELECT t.sample_id, t.i AS row_idx,
  {cols}
FROM tr t JOIN feat a ON a.sample_id = t.sample_id AND a.window_idx = t.lo
LEFT JOIN feat b ON b.sample_id = t.sample_id AND b.window_idx = t.hi
"""


def _other_sql(grid: str, rule: str) -> str:
    N = 40
    phase = ("CASE WHEN bytes_written_per_sec > 0 THEN 'write' WHEN bytes_read_per_sec > 0 "
             "THEN 'read' ELSE 'idle' END")
    return f"""
WITH {FEAT}, {_targets(N, grid, rule)}
SELECT t.sample_id, t.i AS row_idx,
  {_r4(_lerp('bytes_written_per_sec'))} AS bytes_written_per_sec,
  (SELECT {phase} FROM feat c WHERE c.sample_id = t.sample_id AND c.window_idx = t.near) AS phase
FROM tr t JOIN feat a ON a.sample_id = t.sample_id AND a.window_idx = t.lo
LEFT JOIN feat b ON b.sample_id = t.sample_id AND b.window_idx = t.hi
"""


def sliding_sql(drop=S.FEATURES_TO_DROP) -> str:
    N, size, stride = TB.EVENTS_TARGET_ROWS, TB.EVENTS_SLIDE_SIZE, TB.EVENTS_SLIDE_STRIDE
    fn = {"mean": "avg", "std": "stddev_pop", "max": "max", "min": "min"}
    stats = ",\n  ".join(f"{_sr4(f'{fn[st]}(CAST(nz.{c} AS DOUBLE))')} AS {name}"
                         for c, st, name in summary_names(ALL_COLS, S.SUMMARY_STATS, drop))
    return f"""
WITH norm AS ({normalize_sql(rounded=False)}), {LABELS},
starts AS (SELECT CAST(s AS BIGINT) AS s FROM range(0, {N - size + 1}, {stride}) AS r(s))
SELECT nz.sample_id, st.s AS window_start,
  {stats},
  any_value(l.binary_label) AS binary_label, any_value(l.sample_name) AS sample_name
FROM norm nz JOIN starts st ON nz.row_idx BETWEEN st.s AND st.s + {size - 1}
JOIN labels_u l ON l.sample_id = nz.sample_id
GROUP BY nz.sample_id, st.s
"""


ORACLE = {
    "normalize": normalize_sql(),
    "interpolate": interpolate_sql(),
    "nearest": _other_sql("unit", "nearest"),
    "fill": _other_sql("index", "fill"),
    "sliding_summary": sliding_sql(),
}
