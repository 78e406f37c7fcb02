"""The tolerance as-of join."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_TOLERANCES = 2  # width of a time slice in tolerances


def _slice_of(time: Column, tolerance: float) -> Column:
    return F.floor(time / F.lit(SLICE_TOLERANCES * tolerance)).cast("bigint")


def _sliced_matches(left: DataFrame, cands: DataFrame, keys: list, left_id: list, left_time: str, tolerance: float) -> DataFrame:
    """Pairs of a left row and a candidate (time ``_rt``) less than ``tolerance`` apart, by an equi-join on (keys, ``_slice``).

    A left row stays in its one time slice. A candidate goes to the slices
    that its reach ``_rt -+ tolerance`` touches: its own and, near an edge,
    the next one. Adding, dividing and ``floor`` keep the order of doubles,
    so no left row inside the reach is in another slice.
    """
    lt, rt, tol = F.col(left_time).cast("double"), F.col("_rt"), F.lit(tolerance)
    probes = left.select(*keys, *left_id, lt.alias("_lt"), _slice_of(lt, tolerance).alias("_slice"))
    known = cands.filter(rt.isNotNull())  # an unknown time matches nothing
    spread = known.withColumn("_slice", F.explode(F.sequence(_slice_of(rt - tol, tolerance), _slice_of(rt + tol, tolerance))))
    return probes.join(spread, [*keys, "_slice"]).filter(F.abs(rt - F.col("_lt")) < tol)


def asof_first_match(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     left_id: Sequence[str], left_time: str, right_time: str,
                     values: Sequence[str], order: str, tolerance: float) -> DataFrame:
    """For every left row, the right row with |t_r - t_l| < tolerance that
    comes first by ``order`` (not the closest one).

    An equi-join on time slices in which only the timeline's rows near an edge
    are copied; the dense left side is shuffled once, as it is. Work per slice
    is bounded by the timeline's sampling rate, not by run size, so a hot run
    spreads over its slices. ``left_id`` is unique within ``keys``; ``order`` is
    unique within a timeline (dedupe first). Returns ``keys + left_id +
    values`` for left rows that matched; callers left-join it back and apply
    their default.
    """
    keys, left_id = list(keys), list(left_id)
    cands = right.select(*keys, F.col(right_time).cast("double").alias("_rt"), F.col(order).alias("_ord"), *values)
    matched = _sliced_matches(left, cands, keys, left_id, left_time, float(tolerance))
    # grouped by the slice too, so the join's partitioning serves the aggregate;
    # one scalar min_by per value keeps it hash-based (fixed-width buffers)
    first = matched.groupBy(*keys, "_slice", *left_id).agg(*[F.min_by(F.col(v), F.col("_ord")).alias(v) for v in values])
    return first.drop("_slice")


def asof_first_match_many(left: DataFrame, timelines: Sequence[tuple], keys: Sequence[str],
                          left_id: Sequence[str], left_time: str, tolerance: float) -> DataFrame:
    """J1 + J2 in one pass: several timelines looked up with one slice join.

    ``timelines`` holds ``(df, time_col, order_col, value_col)``; each value
    comes from its own timeline's first match by its own order. The
    candidates are unioned with the other timelines' columns null, so each
    ``min_by`` only sees its own rows (null orderings are skipped) and every
    order keeps its own type: one
    shuffle of the left side, one aggregate, instead of one of each per timeline.
    """
    keys, left_id = list(keys), list(left_id)
    parts = []
    for i, (df, tcol, ocol, vcol) in enumerate(timelines):
        cols = [*[F.col(k) for k in keys], F.col(tcol).cast("double").alias("_rt")]
        for j, (_, _, _, v2) in enumerate(timelines):
            o2, own = timelines[j][2], timelines[j][0].schema
            cols.append((F.col(ocol) if i == j else F.lit(None).cast(own[o2].dataType)).alias(f"_o{j}"))
            cols.append((F.col(v2) if i == j else F.lit(None).cast(own[v2].dataType)).alias(f"_v{j}"))
        parts.append(df.select(*cols))
    cands = parts[0]
    for p in parts[1:]:
        cands = cands.unionByName(p, allowMissingColumns=False)
    matched = _sliced_matches(left, cands, keys, left_id, left_time, float(tolerance))
    first = matched.groupBy(*keys, "_slice", *left_id).agg(
        *[F.min_by(F.col(f"_v{j}"), F.col(f"_o{j}")).alias(v)
          for j, (_, _, _, v) in enumerate(timelines)])
    return first.drop("_slice")


def dedupe_timeline(tl: DataFrame, keys: Sequence[str], epoch: str, order: str,
                    values: Sequence[str], position: str = "last") -> DataFrame:
    """S2/S3 duplicate-epoch rule: the last row's values win.

    ``position='first'`` keeps the first file position of the epoch as its
    order (dict insertion order), ``'epoch'`` orders by the epoch itself.
    """
    keys = list(keys)
    agg = [F.max_by(F.col(v), F.col(order)).alias(v) for v in values]
    agg.append((F.min(order) if position == "first" else F.max(order)).alias(order))
    return tl.groupBy(*keys, epoch).agg(*agg).select(*keys, epoch, order, *values)
