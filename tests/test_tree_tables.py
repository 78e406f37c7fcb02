"""Growing over larger tables: places in place of vectors, nodes of many rows, blocks handed over; the same trees each time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import extra_trees as ET
from tests.test_extra_trees import by_path, close, plain_tree


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 6)).round(2) + 0.0  # zeros have no sign
    x[:, 2] = 3.0  # constant
    x[::50, 4] = np.nan
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int) + (rng.random(700) < 0.2)
    cols = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))], ", ".join(f"{c} double" for c in cols) + ", y int, fold int")
    return ET.training_table(df.repartition(3), cols, "y", "fold")


def paths(nodes):
    return {(r.forest, r.tree, r.path): (r.feature, r.cut if r.feature >= 0 else None, list(r.counts), r.depth, round(r.gain, 9)) for r in nodes.collect()}


FORESTS = [ET.Forest(3, 2), ET.Forest(2, 6, held_out=1, min_split=4)]


def test_blocks_hold_the_table(table, monkeypatch):
    want = {r.row: (r.fold, r.label, r.x) for r in table.collect()}
    for most, size in ((1 << 20, 2), (0, 8)):
        monkeypatch.setattr(ET, "VALUES_BYTES", most)
        blocks = ET.pack(table, 6)
        assert blocks.rows == 700 and (blocks.values is None) == (size == 8)
        got = []
        for b in blocks.df.collect():
            fold, y, x = np.frombuffer(b.fold, np.int32), np.frombuffer(b.y, np.int32), np.frombuffer(b.x, f"{'u' if size == 2 else 'f'}{size}").reshape(6, -1)
            assert (np.diff(y) >= 0).all()
            x = np.stack([blocks.values[f][line] for f, line in enumerate(x)]) if size == 2 else x
            got += [(f, c, str(v)) for f, c, v in zip(fold.tolist(), y.tolist(), x.T.tolist())]
        assert sorted(got) == sorted((f, c, str(v)) for f, c, v in want.values())


def test_tables_over_the_bound_of_vectors_are_held_as_places(table, monkeypatch):
    points = [ET.Point(t, depth, 2, k) for t in (2, 4) for depth in (None, 3) for k in (2, 6)]
    rows = lambda: sorted(map(tuple, ET.grid_accuracy(table, 6, 3, points, [0, 1, 2]).collect()))
    want, trees = rows(), paths(ET.grow(table, 6, 3, FORESTS))
    monkeypatch.setattr(ET, "TABLE_BYTES", 1)
    monkeypatch.setattr(ET, "_grid_by_fits", None)
    monkeypatch.setattr(ET, "grow_levels", None)
    assert rows() == want and paths(ET.grow(table, 6, 3, FORESTS)) == trees
    monkeypatch.setattr(ET, "PLACES_BYTES", 1)
    with pytest.raises(TypeError):
        rows()


@pytest.mark.parametrize("values", [1 << 20, 0])
def test_blocks_handed_over_give_the_same_trees(table, monkeypatch, values):
    want = paths(ET.grow(table, 6, 3, FORESTS))
    monkeypatch.setattr(ET, "VALUES_BYTES", values)
    counts = ET.class_counts(table, 3, FORESTS)
    sent, plain = [], type(table).repartition
    monkeypatch.setattr(type(table), "repartition", lambda df, *a: sent.append(df) or plain(df, *a))
    blocks = ET.pack(table, 6)
    sent.clear()
    levels = ET.grow_levels(table, 6, 3, FORESTS, [ET.balanced(c) for c in counts], counts, block_bytes=90 * blocks.row_bytes(), blocks=blocks)
    assert paths(levels) == want
    # a row handed over is 6 places of 2 bytes
    size = sum(df.agg(F.sum(F.length("x")) / F.sum(F.length("y") / 4)).first()[0] for df in sent) / len(sent)
    assert size == (12 if values else 48)


@pytest.mark.parametrize("k", [1, 3, 6])
@pytest.mark.parametrize("kind", [ET.Places.of, ET.Values])
def test_nodes_of_many_rows_are_split_alike(monkeypatch, k, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6)).round(1)
    x[:, 1], x[:, 4] = 2.0, rng.random(500) < 0.02
    y = rng.integers(0, 3, 500)
    use = np.flatnonzero(rng.random(500) < 0.8)
    weights = np.array(ET.balanced(np.bincount(y[use], minlength=3)))
    wants = [ET.grow_tree(kind(x), y, 3, weights, ET.Forest(1, k), t, use=use) for t in range(4)]
    for name, value in (("LARGE", 8), ("GATHERED", 40), ("ROW_BLOCK", 16), ("HELD_BLOCKS", 3), ("SPARSE", 2)):
        monkeypatch.setattr(ET, name, value)
    for t, want in enumerate(wants):
        got = ET.grow_tree(kind(x), y, 3, weights, ET.Forest(1, k), t, use=use)
        assert got["path"] == want["path"] and all(np.array_equal(got[c], want[c], equal_nan=True) for c in want if c != "path")


def test_rows_of_a_tree_by_definition(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 5)).round(2), rng.integers(0, 2, 300)
    weights = np.array(ET.balanced(np.bincount(y, minlength=2)))
    monkeypatch.setattr(ET, "LARGE", 10)
    monkeypatch.setattr(ET, "GATHERED", 30)
    for k in (1, 2, 5):
        tree = ET.grow_tree(x, y, 2, weights, ET.Forest(1, k), 7)
        close({p: (int(f), None if f < 0 else c, list(n)) for p, f, c, n in zip(tree["path"], tree["feature"], tree["cut"], tree["counts"])}, plain_tree(x, y, 2, weights, k, 42, 7))
