"""Mergeable profiles against pandas on the rows themselves, at every level."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators import profile_states as PS

KEYS = ["a", "b"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 6000
    a = np.where(rng.random(n) < 0.4, "hot", rng.choice(["x", "y", "z"], n))  # one key holds much of the rows
    x = np.round(rng.gamma(2.0, 30.0, n), 3) + 1e6
    x[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"a": a, "b": rng.integers(0, 5, n), "x": x, "c": np.full(n, 4.0), "none": [None] * n, "t": rng.choice(list("pqrstu"), n, p=[.4, .2, .15, .12, .08, .05])})


@pytest.fixture(scope="module")
def df(spark, rows):
    out = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) and i % 2 else v for v in r) for i, r in enumerate(rows.itertuples(index=False))],
                                "a string, b int, x double, c double, none double, t string")
    return out.repartition(5)


def groups(rows):
    yield (0, None, None), rows
    for a, g in rows.groupby("a"):
        yield (1, a, None), g
        for b, h in g.groupby("b"):
            yield (2, a, int(b)), h


def test_numeric_levels(df, rows):
    got = {(r.level, r.a, r.b, r.column_name): r for r in PS.numeric_report(PS.all_levels(PS.numeric_states(df, KEYS), KEYS, PS.merge_numeric), ["level", *KEYS]).collect()}
    want = list(groups(rows))
    assert len(got) == 3 * len(want)
    for key, g in want:
        r, v = got[(*key, "x")], g.x.dropna().to_numpy()
        assert (r.rows, r.non_null, r.nulls, r.zeros, r.negatives) == (len(g), len(v), len(g) - len(v), 0, 0)
        m, s = v.mean(), v.std(ddof=1)
        assert (r.min, r.max) == (v.min(), v.max()) and r.mean == pytest.approx(m, abs=1e-3) and r.std == pytest.approx(s, abs=1e-3)
        assert r.skewness == pytest.approx(((v - m) ** 3).mean() / s ** 3, abs=1e-3) and r.kurtosis == pytest.approx(((v - m) ** 4).mean() / s ** 4 - 3, abs=1e-3)
        assert abs(r.distinct_values / len(np.unique(v)) - 1) < 0.08
        for p in S.PROFILE_PERCENTILES:  # the rank that the sketch's value has among the values
            at = getattr(r, f"p{p}")
            low, high = (v < at - 1e-4).sum() / len(v), (v <= at + 1e-4).sum() / len(v)
            assert low - 0.02 <= p / 100 <= high + 0.02, (key, p)
        r = got[(*key, "c")]
        assert (r.constancy, r.constant_value, r.std, r.skewness) == ("CONSTANT", 4.0, 0.0, None)
        r = got[(*key, "none")]
        assert (r.non_null, r.nulls, r.mean, r.std, r.min, r.p50, r.distinct_values, r.constancy, r.constant_value) == (0, len(g), None, None, None, None, 0, "CONSTANT", None)


def test_text_levels(df, rows):
    got = {(r.level, r.a, r.b): r for r in PS.text_report(PS.all_levels(PS.text_states(df, KEYS, ["t"]), KEYS, PS.merge_text), ["level", *KEYS], 3).collect()}
    for key, g in groups(rows):
        counts = g.t.value_counts()
        r = got[key]
        assert r.distinct_values == len(counts) and sorted((e["count"] for e in r.top_values), reverse=True) == sorted(counts, reverse=True)[:3]
        assert all(counts[e["value"]] == e["count"] for e in r.top_values)
        assert [(-e["count"], e["value"]) for e in r.top_values] == sorted((-e["count"], e["value"]) for e in r.top_values)


def test_merge_order_does_not_matter(df):
    cols = ["x", "c", "none"]
    fine = PS.numeric_states(df, KEYS, cols)
    once = {r.column_name: r for r in PS.numeric_moments(PS.merge_numeric(fine, []), []).collect()}
    other = {r.column_name: r for r in PS.numeric_moments(PS.merge_numeric(PS.merge_numeric(fine, ["b"]), []), []).collect()}
    direct = {r.column_name: r for r in PS.numeric_moments(PS.numeric_states(df, [], cols), []).collect()}
    assert once == other == direct


def test_empty_null_keys_and_no_columns(spark, df):
    empty = df.limit(0)
    assert PS.all_levels(PS.numeric_states(empty, KEYS), KEYS, PS.merge_numeric).filter("level > 0").count() == 0
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("k", 5.0)], "a string, x double")
    got = {(r.level, r.a): (r.rows, r.mean) for r in PS.numeric_moments(PS.all_levels(PS.numeric_states(nulls, ["a"]), ["a"], PS.merge_numeric), ["level", "a"]).collect()}
    assert got == {(1, None): (2, 2.0), (1, "k"): (1, 5.0), (0, None): (3, 3.0)}
    with pytest.raises(ValueError, match="no numeric"):
        PS.numeric_states(df, KEYS, [])


def test_corpus_report(spark, scratch):
    from tessera.plans import corpus as CP
    rng = np.random.default_rng(5)
    frames = {}
    for cat, sample, run in [("goodware", "curl", "features"), ("goodware", "tar", "features"), ("ransomwares", "abc", "features"), ("ransomwares", "abc", "features2")]:
        d = os.path.join(scratch, cat, sample)
        os.makedirs(d, exist_ok=True)
        f = pd.DataFrame({c: rng.integers(0, 50, 60).astype(float) for c in S.FEATURE_COLUMNS})
        f["note"] = rng.choice(["u", "v"], 60)
        f.to_csv(os.path.join(d, run + ".csv"), index=False)
        frames[(cat, sample, run)] = f
    rows = CP.corpus_report(spark, scratch).collect()
    by = {(r.level, r.category, r.sample, r.run, r.column_name): r for r in rows}
    assert len(by) == len(rows) == (1 + 2 + 3 + 4) * (len(S.FEATURE_COLUMNS) + 1)
    whole = pd.concat(frames.values())
    assert by[(0, None, None, None, "bytes_read_per_sec")].mean == pytest.approx(whole.bytes_read_per_sec.mean(), abs=1e-4)
    good = pd.concat(f for k, f in frames.items() if k[0] == "goodware")
    r = by[(1, "goodware", None, None, "bytes_read_per_sec")]
    assert r.std == pytest.approx(good.bytes_read_per_sec.std(), abs=1e-4) and r.samples == 2
    assert by[(1, "ransomwares", None, None, "note")].samples == 1 and by[(2, "ransomwares", "abc", None, "note")].samples is None
    assert {e["value"]: e["count"] for e in by[(0, None, None, None, "note")].top_values} == whole.note.value_counts().to_dict()
    assert [(r.category or "", r.sample or "", r.run or "", r.column_name) for r in rows] == sorted((r.category or "", r.sample or "", r.run or "", r.column_name) for r in rows)
