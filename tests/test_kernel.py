"""M16 alignment via random features against the exact n x n computation
(small fixture only: the exact version is quadratic)."""

import numpy as np
import pytest

from tessera.operators.kernel import alignment_rff, gamma_search


def test_alignment_close_to_exact(spark):
    rng = np.random.default_rng(0)
    n, d, gamma = 300, 4, 0.5
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, d)) + y[:, None] * 1.5
    df = spark.createDataFrame([(int(c), [float(v) for v in row]) for c, row in zip(y, x)],
                               "label int, vec array<double>")
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    K = np.exp(-gamma * d2)
    T = (y[:, None] == y[None, :]).astype(float)
    exact = (K * T).sum() / (np.linalg.norm(K) * np.linalg.norm(T) + 1e-8)
    approx = alignment_rff(df, "vec", "label", d, gamma, n_components=2048)["alignment"]
    assert approx == pytest.approx(exact, abs=0.05)


def test_search_reads_once_and_equals_single_gammas(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 7 == 0 else int(i % 3), [float(v) for v in rng.normal(0, 1, 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "label int, vec array<double>").repartition(5)
    gammas = [0.1, 0.5, 2.0]
    got = {r.gamma: r for r in gamma_search(spark, df, "vec", "label", 3, gammas, 64).collect()}
    for g in gammas:
        one = alignment_rff(df, "vec", "label", 3, g, 64)
        assert got[g].alignment == pytest.approx(one["alignment"], abs=1e-12)
        counts = [29, *[sum(r[0] == c for r in rows) for c in range(3)]]
        assert one["t_norm"] == pytest.approx(np.sqrt(sum(c * c for c in counts)))
    assert sum(r.best for r in got.values()) == 1


def test_alignment_of_no_rows(spark):
    df = spark.createDataFrame([], "label int, vec array<double>")
    assert alignment_rff(df, "vec", "label", 3, 0.5, 16)["alignment"] == 0.0
