"""Extremely randomized trees against a plain recursive builder, both ways of growing, and the grid against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import extra_trees as ET


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n, d = 400, 7
    x = rng.normal(size=(n, d)).round(2)
    x[:, 3] = 1.0  # constant
    x[:, 5] = (rng.random(n) < 0.05) * 1.0  # constant in most nodes
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(int) + (x[:, 6] > 1.2)).astype(int)
    return x, y, rng.integers(0, 3, n)


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, fold = data
    cols = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), int(c), int(f)) for r, c, f in zip(x, y, fold)], ", ".join(f"{c} double" for c in cols) + ", y int, fold int")
    return ET.training_table(df.repartition(4), cols, "y", "fold"), df, cols


def plain_tree(x, y, classes, weights, k, seed, number, min_split=2, max_depth=None):
    """Node by node, as the definition says: path -> (feature, cut, counts)."""
    d, out = x.shape[1], {}

    def impurity(counts):
        w = np.array(counts) * weights
        return w.sum() - (w * w).sum() / w.sum() if w.sum() else 0.0

    def visit(rows, path, k1, k2):
        counts = [int((y[rows] == c).sum()) for c in range(classes)]
        out[path] = (-1, None, counts)
        if len(rows) < min_split or sum(c > 0 for c in counts) < 2 or (max_depth is not None and len(path) >= max_depth):
            return
        order = sorted(range(d), key=lambda f: (int(ET.draw(k1, k2, 2 * f)), f))
        varies = [f for f in order if x[rows, f].min() < x[rows, f].max()]
        tried = [f for f in order[:k] if f in varies] or varies[:1]
        best = None
        for f in sorted(tried):
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = low + int(ET.draw(k1, k2, 2 * f + 1)) / ET.PRIME * (high - low)
            cut = low if cut >= high else cut
            left = rows[x[rows, f] <= cut]
            right = rows[x[rows, f] > cut]
            total = sum(impurity([(y[part] == c).sum() for c in range(classes)]) for part in (left, right))
            if best is None or total < best[0] - 1e-9:
                best = (total, f, cut, left, right)
        if best:
            out[path] = (best[1], best[2], counts)
            for side, part in enumerate(best[3:]):
                visit(part, path + str(side), *(int(v) for v in ET.child_keys(k1, k2, side)))

    visit(np.arange(len(y)), "", *ET.root_keys(seed, number))
    return out


def by_path(nodes, forest, tree):
    return {r.path: (r.feature, None if r.feature < 0 else r.cut, list(r.counts)) for r in nodes if r.forest == forest and r.tree == tree}


def close(a, b):
    assert a.keys() == b.keys()
    for p in a:
        assert a[p][0] == b[p][0] and a[p][2] == b[p][2], p
        assert a[p][1] is None or abs(a[p][1] - b[p][1]) < 1e-12


@pytest.mark.parametrize("k", [2, 7])
def test_trees_by_definition(table, data, k):
    tab, _, _ = table
    x, y, fold = data
    forests = [ET.Forest(3, k, None, 5), ET.Forest(2, k, 1, 9), ET.Forest(2, k, None, 5, min_split=20, max_depth=4)]
    whole = ET.grow(tab, 7, 3, forests).collect()
    levels = ET.grow(tab, 7, 3, forests, limit=0).collect()
    assert {(r.forest, r.tree, r.node) for r in whole} == {(r.forest, r.tree, r.node) for r in levels}
    key = lambda r: (r.forest, r.tree, r.node)
    for a, b in zip(sorted(whole, key=key), sorted(levels, key=key)):
        assert (a.feature, a.left_node, a.right_node, list(a.counts), a.path, a.depth) == (b.feature, b.left_node, b.right_node, list(b.counts), b.path, b.depth)
        assert a.feature < 0 or (abs(a.cut - b.cut) < 1e-12 and abs(a.gain - b.gain) < 1e-9)
    # collected rows come in the table's order, so the plain builder takes the same rows in any order
    for i, f in enumerate(forests):
        use = np.ones(len(y), bool) if f.held_out is None else fold != f.held_out
        counts = np.bincount(y[use], minlength=3)
        for t in range(f.trees):
            want = plain_tree(x[use], y[use], 3, np.array(ET.balanced(counts)), k, f.seed, t, f.min_split, f.max_depth)
            close(by_path(whole, i, t), want)


def test_importance_and_prediction(table, data):
    tab, df, cols = table
    x, y, _ = data
    nodes = ET.grow(tab, 7, 3, [ET.Forest(30, 2)])
    imp = {r.feature: r.importance for r in ET.importances(nodes, cols).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["f3"] == 0 and min(imp.values()) >= 0
    assert set(sorted(imp, key=imp.get)[-4:]) >= {"f0", "f6"}
    weights = ET.balanced(np.bincount(y, minlength=3))
    pred = ET.predict(df, nodes, cols, weights, tree_block=7).collect()
    assert all(r.prediction == r.y for r in pred)  # grown until pure
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in pred)


def test_grid_is_single_fits(table, data):
    tab, _, cols = table
    x, y, fold = data
    points = [ET.Point(t, depth, s, k) for t in (2, 5) for depth in (None, 3) for s in (2, 25) for k in (2, 7)]
    got = {(r.point, r.fold): (r.n, r.hits) for r in ET.grid_accuracy(tab, 7, 3, points, [0, 1, 2]).collect()}
    by_fits = {(r.point, r.fold): (r.n, r.hits) for r in ET._grid_by_fits(tab, 7, 3, [points[0], points[-1]], [1], 42).collect()}
    assert by_fits == {(0, 1): got[0, 1], (1, 1): got[len(points) - 1, 1]}
    order = tab.select("row", "x", "label", "fold").orderBy("row").collect()
    x, y, fold = np.array([r.x for r in order]), np.array([r.label for r in order]), np.array([r.fold for r in order])
    for i, p in enumerate(points):
        for f in (0, 1, 2):
            train, test = fold != f, fold == f
            w = np.array(ET.balanced(np.bincount(y[train], minlength=3)))
            votes = np.zeros((test.sum(), 3))
            for t in range(p.trees):
                own = ET.Forest(p.trees, p.k, None, 42, p.min_split, p.max_depth)
                votes += ET._votes(ET._arrays(ET.grow_tree(x[train], y[train], 3, w, own, t)), w, x[test], 2, None)
            assert got[i, f] == (test.sum(), (votes.round(9).argmax(axis=1) == y[test]).sum())


def test_draws_are_even():
    k1, k2 = ET.root_keys(42, np.arange(4000))
    first = ET.candidates(k1, k2, 20, 0, 1).ravel()
    assert np.abs(np.bincount(first, minlength=20) / 200 - 1).max() < 0.3
    share = ET.draw(k1, k2, 7) / ET.PRIME
    assert abs(share.mean() - 0.5) < 0.02 and abs(share.var() - 1 / 12) < 0.01
    a, b = (ET.draw(*ET.child_keys(k1, k2, s), 7) / ET.PRIME for s in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.06 and abs(np.corrcoef(a, share)[0, 1]) < 0.06


def test_edges(spark):
    one = spark.createDataFrame([(1.0, 2.0, 0)], "a double, b double, y int")
    tab = ET.training_table(one, ["a", "b"], "y")
    for limit in (ET.TABLE_BYTES, 0):
        (root,) = ET.grow(tab, 2, 1, [ET.Forest(1, 1)], limit).collect()
        assert root.feature == -1 and list(root.counts) == [1]
    same = spark.createDataFrame([(1.0, i % 2) for i in range(6)], "a double, y int")  # nothing varies
    (root,) = ET.grow(ET.training_table(same, ["a"], "y"), 1, 2, [ET.Forest(1, 1)]).collect()
    assert root.feature == -1 and list(root.counts) == [3, 3]


def _wide_rows(spark, n=600, d=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)).round(2)
    y = rng.integers(0, 3, n)
    cols = [f"f{i}" for i in range(d)]
    return spark.createDataFrame([(*map(float, v), int(c), int(i % 3)) for i, (v, c) in enumerate(zip(x, y))], ", ".join(f"{c} double" for c in cols) + ", y int, fold int"), cols


def test_nodes_handed_over_give_the_same_trees_and_stay_off_the_driver(spark):
    df, cols = _wide_rows(spark)
    tab = ET.training_table(df, cols, "y", "fold")
    forests = [ET.Forest(3, 2), ET.Forest(2, 5, held_out=1, max_depth=11, min_split=4)]
    counts = ET.class_counts(tab, 3, forests)
    weights = [ET.balanced(c) for c in counts]
    above, made = [], ET._node_batch
    ET._node_batch = lambda rows: above.append(len(rows["node"])) or made(rows)
    try:
        levels = ET.materialize(ET.grow_levels(tab, 5, 3, forests, weights, counts, block_bytes=60 * 7 * 8), "test-levels")
    finally:
        ET._node_batch = made
    key = lambda r: (r.forest, r.tree, r.path)
    whole = {key(r): r for r in ET.grow(tab, 5, 3, forests).collect()}
    rows = levels.collect()
    assert sum(above) < len(rows) / 4
    assert {key(r) for r in rows} == set(whole) and len(rows) == len(whole)
    place = {(r.forest, r.tree, r.node): r.path for r in rows}
    for r in rows:
        w = whole[key(r)]
        assert (r.feature, r.cut if r.feature >= 0 else None, r.depth, r.counts, r.gain) == (w.feature, w.cut if w.feature >= 0 else None, w.depth, w.counts, w.gain)
        if r.feature >= 0:
            assert place[r.forest, r.tree, r.left_node] == r.path + "0" and place[r.forest, r.tree, r.right_node] == r.path + "1"
    for i in range(2):
        for t in range(forests[i].trees):
            own = sorted(n for f, u, n in place if (f, u) == (i, t))
            assert own == list(range(len(own))) and place[i, t, 0] == ""


def test_votes_of_large_forests_are_shuffled(spark):
    df, cols = _wide_rows(spark)
    tab = ET.training_table(df, cols, "y")
    forest = [ET.Forest(5, 2)]
    weights = ET.balanced(ET.class_counts(tab, 3, forest)[0])
    nodes = ET.grow(tab, 5, 3, forest)
    odd = df.unionAll(df.limit(7)).withColumn("y", F.lit(None).cast("int"))
    a = ET.predict(odd, nodes, cols, weights)
    b = ET.predict(odd, nodes, cols, weights, node_bytes=0)
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() == 607


def test_draws_are_the_plain_remainders():
    rng = np.random.default_rng(8)
    for k1, k2 in rng.integers(1, ET.PRIME, (200, 2)).tolist() + [[ET.PRIME - 1, ET.PRIME - 1], [0, 1]]:
        for j in (0, 143, ET.CHILD + 3):
            x = (k1 + (j + 1) * k2) % ET.PRIME
            for _ in range(3):
                x = (x * 48271 + 11) % ET.PRIME
                x = (x * x + k1) % ET.PRIME
            assert ET.draw(k1, k2, j) == x == ET.draw(np.array([k1]), np.array([k2]), j)[0]


@pytest.mark.parametrize("k", [2, 7])
def test_trees_grown_together_are_the_same_trees(data, k):
    x, y, fold = data
    x = x.copy()
    x[::9, 4] = np.nan  # a node with such a value isn't split by this feature
    train = fold != 2
    places = ET.Places.of(x)
    assert places.at.itemsize == 2
    weights = np.array(ET.balanced(np.bincount(y[train], minlength=3)))
    forest = ET.Forest(5, k, seed=9)
    learn, asked = (ET.Places(places.at[use], places.values) for use in (train, ~train))
    numbers = np.arange(3, 8)
    trees = ET._grow(learn, y[train], 3, weights, forest, *ET.root_keys(9, numbers))
    leaf = ET._leaves(asked, trees, len(numbers)).reshape(len(numbers), -1)
    shares = ET._shares(trees["counts"], weights)
    for i, number in enumerate(numbers.tolist()):
        nodes = ET.grow_tree(x[train], y[train], 3, weights, forest, number)
        own = {path: (int(f), None if f < 0 else c, list(n)) for path, f, c, n in zip(nodes["path"], nodes["feature"], nodes["cut"], nodes["counts"])}
        close(own, plain_tree(x[train], y[train], 3, weights, k, 9, number))
        for read in ((2, None), (2, 3), (25, None), (25, 3), (2, 0)):
            want = ET._votes(ET._arrays(nodes), weights, x[~train], *read)
            assert np.array_equal(shares[ET._read_to(trees, *read)[leaf[i]]], want), read


def test_places_of_many_values():
    rng = np.random.default_rng(2)
    x = np.stack([rng.permutation(70_000) / 7, np.repeat([-np.inf, -0.0, 0.0, np.inf], 17_500)], axis=1)
    p = ET.Places.of(x)
    assert p.at.dtype == np.uint32 and [len(v) for v in p.values] == [70_000, 3]
    feature, cut = np.array([[0], [1]]), np.array([[-1.0, 5.0, np.nan], [-np.inf, 0.0, 3.5]])
    want = [[(np.unique(x[:, f]) <= c).sum() for c in cut[f]] for f in (0, 1)]
    assert p.below(feature, cut).tolist() == want == p.below(np.repeat(feature, 3, axis=1), cut).tolist()


def test_grid_shuffles_one_row_for_each_task_and_held_out_row(spark, table, monkeypatch):
    tab, _, _ = table
    points = [ET.Point(t, depth, s, 2) for t in (2, 5) for depth in (None, 3) for s in (2, 25)]
    seen, plain = [], type(tab).mapInArrow
    monkeypatch.setattr(type(tab), "mapInArrow", lambda df, *a, **b: seen.append(plain(df, *a, **b)) or seen[-1])
    got = ET.grid_accuracy(tab, 7, 3, points, [0, 1])
    rows = {r.fold: r["count"] for r in tab.groupBy("fold").count().collect()}
    assert {(r.point, r.fold): r.n for r in got.collect()} == {(i, f): rows[f] for i in range(len(points)) for f in (0, 1)}
    most = max(1, -(-4 * spark.sparkContext.defaultParallelism // 2))
    assert seen[0].count() <= most * (rows[0] + rows[1])
