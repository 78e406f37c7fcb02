"""D5-D8 against pandas/numpy formulas; J1/J2 edge cases (FIXTURES 4)."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import profile as PR
from tessera.operators.joins import asof_first_match, dedupe_timeline


def test_numeric_profile_matches_pandas(spark):
    vals = [1.0, 2.0, 2.0, 0.0, -3.0, 10.0, None, 4.5]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, x double")
    r = PR.profile_numeric(df, ["g"], ["x"]).first()
    s = pd.Series(vals, dtype="float64").dropna()
    m, sd = s.mean(), s.std()
    assert r.rows == 8 and r.nulls == 1 and r.zeros == 1 and r.negatives == 1
    assert r.mean == pytest.approx(round(m, 4)) and r.std == pytest.approx(round(sd, 4))
    assert r.skewness == pytest.approx(round(((s - m) ** 3).mean() / sd ** 3, 4))
    assert r.kurtosis == pytest.approx(round(((s - m) ** 4).mean() / sd ** 4 - 3, 4))
    for p in (0, 1, 5, 25, 50, 75, 95, 99, 100):
        assert r[f"p{p}"] == pytest.approx(round(float(np.percentile(s, p)), 4))
    assert r.distinct_values == 6 and r.constancy is None


def test_constant_column(spark):
    df = spark.createDataFrame([("g", 0.0)] * 5, "g string, x double")
    r = PR.profile_numeric(df, ["g"], ["x"]).first()
    assert r.constancy == "CONSTANT" and r.skewness is None and r.highly_sparse


def test_categorical_top(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    rows = PR.profile_categorical(df, [], ["c"]).orderBy("rank").collect()
    assert rows[0].value == "a" and rows[0]["count"] == 2 and rows[0].pct == 50.0
    assert rows[0].cardinality == 2 and rows[0].nulls == 1


def test_duplicates(spark):
    df = spark.createDataFrame([("g", 1, None), ("g", 1, None), ("g", 2, "x")], "g string, a int, b string")
    r = PR.profile_overview(df, ["g"]).first()
    assert r.duplicate_rows == 1 and r.total_nulls == 2


def test_asof_first_match_rules(spark):
    left = spark.createDataFrame([(1, 0, 100.0), (1, 1, 200.0)], "run long, wid long, t double")
    right = spark.createDataFrame(
        [(1, 99.8, 5.0, 0), (1, 100.3, 6.0, 1), (1, 100.3, 7.0, 2),   # dup epoch: last wins
         (1, 200.5, 9.0, 3)],                                          # exactly 0.5 away: no match
        "run long, epoch double, v double, row_order long")
    tl = dedupe_timeline(right, ["run"], "epoch", "row_order", ["v"], "last")
    m = {r.wid: r.v for r in asof_first_match(left, tl, ["run"], ["wid"], "t", "epoch", ["v"],
                                               "epoch", 0.5).collect()}
    assert m == {0: 5.0}  # earliest epoch wins even though 100.3 is closer


def test_top_values_two_level_exact(spark):
    import random
    rng = random.Random(1)
    vals = [f"v{rng.randint(0, 400)}" for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [(r.value, r["count"]) for r in PR.profile_categorical(df, [], ["c"]).orderBy("rank").collect()]
    from collections import Counter
    exp = sorted(Counter(vals).items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    assert got == exp


def test_exact_percentiles_distributed_with_hot_value(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([np.full(3000, 7.0), rng.normal(0, 10, 6000).round(2)])
    rows = [("a" if i % 2 else "b", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, x double")
    vc = PR.value_counts(df, ["g"], ["x"])
    got = {(r.g, r.p): r.value for r in PR.exact_percentiles(vc, ["g", "column_name"],
                                                             [0, 1, 25, 50, 99, 100], 16).collect()}
    for g in ("a", "b"):
        xs = np.array([v for k, v in rows if k == g])
        for p in (0, 1, 25, 50, 99, 100):
            assert got[(g, float(p))] == pytest.approx(float(np.percentile(xs, p)), abs=1e-9)


def test_asof_many_keeps_each_timeline_order(spark):
    from tessera.operators.joins import asof_first_match_many
    left = spark.createDataFrame([(1, 0, 100.0), (1, 1, 300.0)], "run long, wid long, t double")
    ent = spark.createDataFrame([(1, 100.4, 1.0), (1, 99.9, 2.0)], "run long, epoch double, e double")
    proc = spark.createDataFrame([(1, 99.7, 10, 5), (1, 100.1, 20, 3)],
                                 "run long, epoch double, m long, pos long")
    rows = {r.wid: r for r in asof_first_match_many(
        left, [(ent, "epoch", "epoch", "e"), (proc, "epoch", "pos", "m")],
        ["run"], ["wid"], "t", 0.5).collect()}
    assert set(rows) == {0}                       # wid 1 has no sample within 0.5 s
    assert rows[0].e == 2.0 and rows[0].m == 20   # earliest epoch vs. earliest position


def test_percentiles_do_not_depend_on_exchange_reuse(spark):
    df = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE 'g' END AS g", "CAST(id * 7919 % 30011 AS DOUBLE) AS x")
    kept = spark.conf.get("spark.sql.exchange.reuse")
    try:
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            rows = {r.g: r for r in PR.profile_numeric(df, ["g"], ["x"]).collect()}
            for g, pick in ((None, 0), ("g", 1)):
                xs = [float(i * 7919 % 30011) for i in range(30000) if (i % 3 == 0) == (pick == 0)]
                assert rows[g].rows == len(xs)
                for p in (0, 1, 5, 25, 50, 75, 95, 99, 100):
                    assert rows[g][f"p{p}"] == pytest.approx(round(float(np.percentile(xs, p)), 4), abs=2e-4)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", kept)


def test_profiles_keep_null_groups_and_need_no_group(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), ("g", 2, None)], "g string, a int, b string")
    ov = {r.g: r for r in PR.profile_overview(df, ["g"]).collect()}
    assert ov[None].rows == 2 and ov[None].duplicate_rows == 1 and ov["g"].total_nulls == 1
    whole = PR.profile_overview(df, []).collect()
    assert len(whole) == 1 and whole[0].rows == 3 and whole[0].duplicate_rows == 1
    top = {(r.g, r["rank"]): r.value for r in PR.profile_categorical(df, ["g"], ["b"]).collect()}
    assert top[(None, 1)] == "x"
    assert PR.profile_numeric(df, [], ["a"]).first().p50 == 1.0


def test_asof_copies_no_left_row_and_loses_none_at_slice_edges(spark):
    from tessera.operators.joins import asof_first_match_many
    rng = np.random.default_rng(3)
    tol = 0.5
    left_t = np.concatenate([np.arange(0, 40, 0.25), rng.uniform(-20, 20, 200), [None]])
    right_t = np.concatenate([np.arange(-3, 30, 1.0), rng.uniform(-20, 20, 60)])
    order = rng.permutation(len(right_t))
    left = spark.createDataFrame([("r", i, None if t is None else float(t)) for i, t in enumerate(left_t)], "run string, wid long, t double")
    rows = [("r", float(t), int(o), float(i)) for i, (t, o) in enumerate(zip(right_t, order))]
    right = spark.createDataFrame([*rows, ("r", None, -1, -1.0), ("other", 0.0, -2, -2.0)], "run string, epoch double, pos long, v double")
    want = {}
    for i, t in enumerate(left_t):
        near = [r for r in rows if t is not None and abs(r[1] - t) < tol]
        if near:
            want[i] = (min(near, key=lambda r: r[2])[3],)
    got = asof_first_match(left, right, ["run"], ["wid"], "t", "epoch", ["v"], "pos", tol)
    assert {r.wid: (r.v,) for r in got.collect()} == want
    many = asof_first_match_many(left, [(right, "epoch", "pos", "v")], ["run"], ["wid"], "t", tol)
    assert {r.wid: (r.v,) for r in many.collect()} == want and many.count() == len(want)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the timeline's rows only


def test_rolling_std_across_slices(spark):
    from tessera.operators import features as FT
    rng = np.random.default_rng(4)
    vals = {("a", w): float(v) for w, v in enumerate(rng.integers(0, 1000, 50))} | {("b", 0): 3.0} | {("c", w): 7.0 for w in range(9)}
    df = spark.createDataFrame([(k, w, v, 0) for (k, w), v in vals.items()], "run string, wid long, x double, max_wid long")
    for width in (4, 7, 8, 4096):
        got = {(r.run, r.wid): r.s for r in FT.rolling_pop_std(df, ["run"], "x", 5, "s", width).collect()}
        assert got.keys() == vals.keys()
        for (k, w), s in got.items():
            assert s == pytest.approx(np.std([vals[k, v] for v in range(max(0, w - 4), w + 1)]), abs=1e-9)
    assert FT.rolling_pop_std(df.limit(0), ["run"], "x").count() == 0
