"""Landmark SVMs and calibration against direct solutions."""

import math

import numpy as np
import pytest

from tessera.operators import extra_trees as ET
from tessera.operators import landmark_svm as LS


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(360, 3))
    y = np.digitize((x[:, :2] ** 2).sum(1), [0.9, 2.4])  # rings: no linear classifier tells them
    fold = np.arange(360) % 3
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([(*map(float, r), int(c), int(f)) for r, c, f in zip(x, y, fold)], "a double, b double, c double, y int, fold int").repartition(4)
    return ET.training_table(df, cols, "y", "fold"), df, cols, x, y, fold


def minimise(z, y, weight, steps=200):
    """The squared-hinge minimum by plain Newton steps on one table."""
    w, ridge = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 1e-6)
    for _ in range(steps):
        short = 1 - y * (z @ w)
        on = short > 0
        grad = -2 * (weight[on] * short[on] * y[on]) @ z[on] + ridge * w
        hess = 2 * (z[on] * weight[on][:, None]).T @ z[on] + np.diag(ridge)
        w = w - 0.7 * np.linalg.solve(hess, grad)
    return w


def test_grid_is_single_fits(data):
    table, _, _, x, y, fold = data
    problems = [LS.Problem(c, g, h) for c in (0.1, 10.0) for g in ("scale", "auto", 0.5) for h in (0, 2, None)]
    sides = LS.fit_sides(table, 3, 3, [0, 2, None], m=24)
    assert all(len(s.landmarks) == 24 and len(np.unique(s.landmarks, axis=0)) == 24 for s in sides.values())
    model = LS.LandmarkSVM(3, 3, problems, sides).fit(table, 25)
    hits = {r["point"]: (r["n"], r["hits"]) for r in model.held_out_hits(table).collect()}
    for i, p in enumerate(problems):
        use = np.ones(len(y), bool) if p.held_out is None else fold != p.held_out
        side = sides[p.held_out]
        low, high = x[use].min(0), x[use].max(0)
        scaled = (x[use] - low) / (high - low)
        gamma = {"auto": 1 / 3, "scale": 1 / (3 * scaled.var())}.get(p.gamma, p.gamma)
        assert abs(LS.gamma_value(p.gamma, side, 3) / gamma - 1) < 1e-9
        assert {tuple(v) for v in side.landmarks.round(9)} <= {tuple(v) for v in scaled.round(9)}  # of the training rows only
        z = LS.kernel_features(x, side, gamma, LS.whitening(side.landmarks, gamma))
        counts = np.bincount(y[use], minlength=3)
        for j, (a, b) in enumerate([(0, 1), (0, 2), (1, 2)]):
            pair = use & ((y == a) | (y == b))
            want = minimise(z[pair], np.where(y[pair] == b, 1.0, -1.0), p.c * (counts.sum() / (3 * counts))[y[pair]])
            assert np.abs(z @ model.weights[i][j] - z @ want).max() < 1e-4
        if p.held_out is not None:
            assert hits[i] == ((~use).sum(), (model.classes_of(model.scores(x[~use], i)) == y[~use]).sum())
    best = max(h / n for n, h in hits.values())
    assert best > 0.85 > np.bincount(y).max() / len(y) + 0.2


def test_kernel_error_falls_with_landmarks(data):
    table, _, _, x, _, _ = data
    errors = []
    for m in (4, 64, 360):
        side = LS.fit_sides(table, 3, 3, [None], m=m)[None]
        z = LS.kernel_features(x, side, 2.0, LS.whitening(side.landmarks, 2.0))[:, :-1]
        exact = np.exp(-2.0 * LS._square_distance(side.scaled(x), side.scaled(x)))
        errors.append(np.abs(z @ z.T - exact).max())
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.02 and errors[2] < 1e-4


def test_predict_and_best(data):
    table, df, cols, x, y, _ = data
    rows = LS.svm_grid(table, 3, 3, [0.1, 100.0], ["auto", 4.0], [0, 1, 2], m=32)
    assert len(rows) == 4 and sum(r[2] for r in rows) == 1 and max(r[1] for r in rows) == next(r[1] for r in rows if r[2])
    model = LS.LandmarkSVM(3, 3, [LS.Problem(100.0, 4.0, f) for f in (0, 1, 2)], LS.fit_sides(table, 3, 3, [0, 1, 2], 32)).fit(table)
    got = model.predict(df, cols, {0: 0, 1: 1, 2: 2}, "fold").collect()
    assert sum(r.prediction == r.y for r in got) / len(got) == pytest.approx(next(r[1] for r in rows if r[0] == "C=100.0, gamma=4.0"), abs=1e-12)


def test_few_rows(spark):
    same = spark.createDataFrame([(1.0, i % 2, 0) for i in range(6)], "a double, y int, fold int")  # one vector, so one landmark
    table = ET.training_table(same, ["a"], "y", "fold")
    side = LS.fit_sides(table, 1, 2, [None], 8)[None]
    assert len(side.landmarks) == 1
    model = LS.LandmarkSVM(1, 2, [LS.Problem(1.0, "auto")], {None: side}).fit(table)
    assert model.predict(same, ["a"]).count() == 6


def test_sigmoid(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=500) * 3
    y = (rng.random(500) < 1 / (1 + np.exp(-1.3 * s + 0.4))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    a, b = LS.fit_sigmoid(df, "s", "y", 15)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(a * s + b))
    assert abs(((t - p) * s).sum()) < 1e-6 and abs((t - p).sum()) < 1e-6  # the minimum
    got = LS.calibrated(df, "s", (a, b)).collect()
    assert max(abs(r.calibrated - 1 / (1 + math.exp(a * r.s + b))) for r in got) < 1e-12
    # far scores: full steps would run away
    far = spark.createDataFrame([(50.0 * (1 if i % 2 else -1), i % 2) for i in range(40)] + [(60.0, 0)], "s double, y int")
    a, b = LS.fit_sigmoid(far, "s", "y", 40)
    assert math.isfinite(a) and math.isfinite(b) and a < 0
    assert LS.fit_sigmoid(far.filter("y = 1"), "s", "y") == (0.0, math.log(1 / 21))


def test_race_takes_each_vector_once_without_sorting_rows(monkeypatch):
    from tessera.operators import landmark_svm as LS
    key = np.array([0.5, 0.1, 0.1, np.inf, 0.3, 0.2])
    rows = np.array([[5.0, 0], [1, 0], [1, -0.0], [9, 9], [3, 0], [2, 0]])
    assert LS._first_distinct(key, rows, 3) == [1, 5, 4]
    assert LS._first_distinct(key, rows, 9) == [1, 5, 4, 0]


def test_columns_that_have_settled_are_not_summed_again(spark):
    """Newton passes add up only columns that still move, and distances are made once for all gammas of a side."""
    from tessera.operators import extra_trees as ET
    from tessera.operators import landmark_svm as LS
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, v), int(v[0] + 0.3 * v[1] > 0), int(i % 3)) for i, v in enumerate(x)], "a double, b double, c double, y int, fold int")
    tab = ET.training_table(df, ["a", "b", "c"], "y", "fold")
    problems = [LS.Problem(c, g, f) for c in (0.01, 100.0) for g in ("scale", 0.1) for f in range(3)]
    sizes, added = [], LS._added
    LS._added = lambda *a: (lambda got: sizes.append(len(got)) or got)(added(*a))
    try:
        model = LS.LandmarkSVM(3, 2, problems, LS.fit_sides(tab, 3, 2, range(3), 16)).fit(tab, 40)
    finally:
        LS._added = added
    assert sizes[1] == len(problems) and sizes[-1] < len(problems)
    # the gradient of every column is zero
    rows = tab.toArrow()
    z0 = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, 3)
    y, fold = rows.column("label").to_numpy(), rows.column("fold").to_numpy()
    for i, p in enumerate(problems):
        use = fold != p.held_out
        gamma = LS.gamma_value(p.gamma, model.sides[p.held_out], 3)
        z = LS.kernel_features(z0[use], model.sides[p.held_out], gamma, model.white[p.held_out, gamma])
        w, sign = model.weights[i][0], np.where(y[use] == 1, 1.0, -1.0)
        short = np.maximum(1 - sign * (z @ w), 0) * model._class_weight(i)[y[use]] * p.c
        grad = -2 * (short * sign) @ z + np.append(np.ones(len(w) - 1), 1e-6) * w
        assert np.abs(grad).max() < 1e-5 * (1 + p.c * 300)
