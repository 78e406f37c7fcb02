"""Kernel SVMs on landmarks (M9, M15), whole grids in one chain of passes (M12), and sigmoid calibration.

An RBF kernel over a table isn't built: rows are compared with ``m`` landmarks
of their fold's training rows, and the landmarks' own kernel is whitened, so
that z(x) = K(x, L) K(L, L)^(-1/2) has products close to the kernel (Nystroem).
Landmarks come in rounds, each taking rows with a probability that grows with
the squared distance from those before, by hashes of the row, so the choice
depends on the rows alone.

Every (C, gamma, fold, pair of classes) is one column of a weight matrix. The
squared-hinge loss of all columns is minimised by Newton steps; a step is one
Arrow pass in which tasks add each column's gradient and Hessian, m + 1 wide,
and one aggregate over the tasks. What the driver holds are weights and sums,
never rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANDMARKS, ROUNDS, STEPS = 64, 4, 12


@dataclass(frozen=True)
class Problem:
    """An SVM to fit on all folds but ``held_out`` (None: all rows); gamma is a number, 'scale' or 'auto'."""

    c: float
    gamma: float | str
    held_out: int | None = None


@dataclass
class _Side:
    """What a fold's training rows tell: scaling, landmarks, class counts."""

    low: np.ndarray
    width: np.ndarray
    counts: np.ndarray
    variance: float
    landmarks: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) / self.width


def _batches(batches: Iterator[pa.RecordBatch], d: int, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield (part, np.asarray(part.column("x").flatten(), np.float64).reshape(-1, d), part.column("fold").to_numpy(zero_copy_only=False),
                   part.column("label").to_numpy(zero_copy_only=False).astype(np.int64))


def _square_distance(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * x @ z.T, 0.0)


def _added(df: DataFrame, spec: str, run) -> dict[int, np.ndarray]:
    """Sums by key of the arrays that tasks emit as (key, values); two rounds, so that no group holds an array of every task."""

    def add(table: pa.Table) -> pa.Table:
        values = table.column("values").combine_chunks()
        total = np.asarray(values.flatten(), np.float64).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"key": table.column("key")[:1], "part": table.column("part")[:1], "values": pa.array([total], pa.list_(pa.float64()))})

    out = "key int, part int, values array<double>"
    sums = df.mapInArrow(run, "key int, values array<double>").withColumn("part", F.spark_partition_id())
    # the order of addition within a group follows the task number
    sums = sums.groupBy("key", F.floor(F.col("part") / 64).alias("g")).applyInArrow(lambda t: add(t.sort_by("part")), out)
    sums = sums.groupBy("key").applyInArrow(lambda t: add(t.sort_by("part")), out)
    return {r["key"]: np.asarray(r["values"]) for r in sums.select("key", "values").toArrow().to_pylist()}


def _emit(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.ravel() for v in sums.values()], pa.list_(pa.float64()))], names=["key", "values"])


def fit_sides(table: DataFrame, d: int, classes: int, held_out: Sequence[int | None], m: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 42,
              scale: bool = True) -> dict[int | None, _Side]:
    """Scaling (M2), class counts and landmarks of the training rows of each held-out fold; ``table`` as ``extra_trees.training_table`` makes it."""
    cells = table.groupBy("fold", "label").count().collect()
    ranges = table.select("fold", F.posexplode("x").alias("i", "v")).groupBy("fold", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    sides: dict[int | None, _Side] = {}
    for h in held_out:
        low, high = np.full(d, np.inf), np.full(d, -np.inf)
        for r in ranges:  # folds x dimensions
            if r["fold"] != h:
                low[r["i"]], high[r["i"]] = min(low[r["i"]], r["lo"]), max(high[r["i"]], r["hi"])
        width = np.where(high > low, high - low, 1.0)
        counts = np.array([sum(r["count"] for r in cells if r["label"] == c and r["fold"] != h) for c in range(classes)], np.int64)
        if not scale or not np.isfinite(low).all():
            low, width = np.zeros(d), np.ones(d)
        sides[h] = _Side(low, width, counts, 1.0, np.empty((0, d)))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(3) for i in range(len(order))}
        for _, x, fold, _ in _batches(batches, d):
            for i, h in enumerate(order):
                own = sides[h].scaled(x[fold != h] if h is not None else x)
                total[i] += [own.size, own.sum(), (own * own).sum()]
        yield _emit(total)

    order = list(sides)
    for i, (n, s, q) in _added(table, "", moments).items():
        sides[order[i]].variance = max(q / n - (s / n) ** 2, 1e-300) if n else 1.0

    per_round = -(-m // rounds)
    for r in range(rounds):
        found = {i: [] for i in range(len(order))}
        near = [s.landmarks for s in sides.values()]

        def race(batches: Iterator[pa.RecordBatch], near=near, r=r) -> Iterator[pa.RecordBatch]:
            """Rows with the smallest keys -log(u) / distance: drawn by weight, without replacement; a task sends its smallest."""
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for part, x, fold, _ in _batches(batches, d):
                u = part.column("u").to_numpy()
                for i, h in enumerate(order):
                    use = np.ones(len(x), bool) if h is None else fold != h
                    own = sides[h].scaled(x[use])
                    weight = _square_distance(own, near[i]).min(axis=1) if len(near[i]) else np.ones(len(own))
                    with np.errstate(divide="ignore"):
                        key = np.where(weight > 1e-12, -np.log(u[use]) / weight, np.inf)
                    if i in best:
                        key, own = np.append(best[i][0], key), np.concatenate([best[i][1], own])
                    first = _first_distinct(key, own, per_round)
                    best[i] = key[first], own[first]
            rows = [(i, k, v.tolist()) for i, (keys, vecs) in best.items() for k, v in zip(keys.tolist(), vecs)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.float64()),
                                              pa.array([x[2] for x in rows], pa.list_(pa.float64()))], names=["side", "k", "v"])

        # the hash of the row's vector, so that equal rows draw alike
        u = (F.pmod(F.xxhash64("x", F.lit(seed * 1000 + r)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        from pyspark.sql import Window

        drawn = table.select("x", "fold", "label", u.alias("u")).mapInArrow(race, "side int, k double, v array<double>").distinct()
        rank = F.row_number().over(Window.partitionBy("side").orderBy("k", "v"))
        for row in drawn.withColumn("n", rank).filter(F.col("n") <= per_round).orderBy("side", "n").collect():  # rounds x landmarks
            found[row["side"]].append(row["v"])
        for i, h in enumerate(order):
            if found[i]:
                sides[h].landmarks = np.concatenate([sides[h].landmarks, np.array(found[i])])[:m]
    return sides


def _first_distinct(key: np.ndarray, rows: np.ndarray, n: int) -> list[int]:
    """The ``n`` rows with the smallest finite keys; equal vectors are one landmark."""
    seen, first = set(), []
    for i in np.argsort(key, kind="stable").tolist():
        if len(first) == n or not np.isfinite(key[i]):
            break
        vector = (rows[i] + 0.0).tobytes()  # -0.0 is 0.0
        if vector not in seen:
            seen.add(vector)
            first.append(i)
    return first


def gamma_value(gamma: float | str, side: _Side, d: int) -> float:
    """A number, 1 / d ('auto') or 1 / (d Var) of the scaled training rows ('scale')."""
    return 1.0 / d if gamma == "auto" else 1.0 / (d * side.variance) if gamma == "scale" else float(gamma)


def whitening(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """K(L, L)^(-1/2), directions without weight left out."""
    e, v = np.linalg.eigh(np.exp(-gamma * _square_distance(landmarks, landmarks)))
    return v * np.where(e > 1e-10 * max(e.max(initial=0), 1e-300), 1 / np.sqrt(np.maximum(e, 1e-300)), 0.0)


def kernel_features(x: np.ndarray, side: _Side, gamma: float, white: np.ndarray) -> np.ndarray:
    """z(x) and a constant for the bias."""
    return _features_at(_square_distance(side.scaled(x), side.landmarks), gamma, white)


def _features_at(distance: np.ndarray, gamma: float, white: np.ndarray) -> np.ndarray:
    z = np.empty((len(distance), white.shape[1] + 1))
    np.matmul(np.exp(-gamma * distance), white, out=z[:, :-1])
    z[:, -1] = 1.0
    return z


class LandmarkSVM:
    """Fitted problems: for each one a weight vector for each pair of classes (one-against-one)."""

    def __init__(self, d: int, classes: int, problems: Sequence[Problem], sides: dict[int | None, _Side]) -> None:
        self.d, self.classes, self.problems, self.sides = d, classes, list(problems), sides
        self.pairs = list(itertools.combinations(range(classes), 2))
        # problems that share landmarks and gamma share the features
        self.kernels: dict[tuple, list[int]] = {}
        for i, p in enumerate(self.problems):
            self.kernels.setdefault((p.held_out, gamma_value(p.gamma, sides[p.held_out], d)), []).append(i)
        self.white = {k: whitening(sides[k[0]].landmarks, k[1]) for k in self.kernels}
        self.weights = {i: np.zeros((len(self.pairs), len(sides[p.held_out].landmarks) + 1)) for i, p in enumerate(self.problems)}

    def _class_weight(self, i: int) -> np.ndarray:
        counts = self.sides[self.problems[i].held_out].counts
        with np.errstate(divide="ignore"):
            return np.where(counts > 0, counts.sum() / ((counts > 0).sum() * np.maximum(counts, 1)), 0.0)

    def fit(self, table: DataFrame, steps: int = STEPS) -> LandmarkSVM:
        """Newton steps over all columns that still move, halved where the loss rose."""
        spark, key = table.sparkSession, {}
        for i in self.weights:
            for j in range(len(self.pairs)):
                key[len(key)] = (i, j)
        name = {v: k for k, v in key.items()}
        best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, weights, step
        live = set(key)
        for _ in range(steps):
            held = spark.sparkContext.broadcast((self, {i: [j for j in range(len(self.pairs)) if name[i, j] in live] for i in self.weights}))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                (model, moving), sums = held.value, {}
                for _, x, fold, y in _batches(batches, model.d):
                    distance = {}  # of a side's rows to its landmarks, for all its gammas
                    for (h, gamma), own in model.kernels.items():
                        use = slice(None) if h is None else fold != h
                        label = y[use]
                        if not len(label) or not any(moving[i] for i in own):
                            continue
                        if h not in distance:
                            distance[h] = _square_distance(model.sides[h].scaled(x[use]), model.sides[h].landmarks)
                        z = _features_at(distance[h], gamma, model.white[h, gamma])
                        for i in own:
                            weight = model._class_weight(i) * model.problems[i].c
                            for j in moving[i]:
                                a, b = model.pairs[j]
                                pair = (label == a) | (label == b)
                                whole = bool(pair.all())
                                zp, lp = (z, label) if whole else (z[pair], label[pair])
                                sign = np.where(lp == b, 1.0, -1.0)
                                short = 1.0 - sign * (zp @ model.weights[i][j])
                                on = short > 0
                                w, za = weight[lp[on]], zp[on]
                                loss, grad = (w * short[on] ** 2).sum(), -2 * (w * short[on] * sign[on]) @ za
                                za *= np.sqrt(2 * w)[:, None]
                                hess = za.T @ za  # one matrix twice: half the products
                                part = np.concatenate([[loss], grad, hess[np.triu_indices(len(grad))]])
                                k = name[i, j]
                                sums[k] = sums[k] + part if k in sums else part
                yield _emit(sums)

            got = _added(table, "", run)
            live &= set(got)  # columns without rows stay at zero
            for k, part in got.items():
                i, j = key[k]
                w = self.weights[i][j]
                n = len(w)
                ridge = np.append(np.ones(n - 1), 1e-6)  # the bias is all but free
                loss, grad = part[0] + 0.5 * (ridge * w * w).sum(), part[1:n + 1] + ridge * w
                if k in best and loss > best[k][0] * (1 + 1e-12):
                    _, start, step = best[k]
                    step = step / 2
                    best[k] = (best[k][0], start, step)
                    self.weights[i][j] = start + step
                    if np.abs(step).max() < 1e-8:
                        live.discard(k)
                    continue
                hess = np.zeros((n, n))
                hess[np.triu_indices(n)] = part[n + 1:]
                hess = hess + np.triu(hess, 1).T + np.diag(ridge)
                step = -np.linalg.solve(hess, grad)
                best[k] = (loss, w.copy(), step)
                self.weights[i][j] = w + step
                if np.abs(step).max() / (1.0 + np.abs(w).max()) < 1e-8:
                    live.discard(k)
            held.unpersist()
            if not live:
                break
        return self

    def scores(self, x: np.ndarray, i: int) -> np.ndarray:
        """Decision value of each pair of classes, positive for the second."""
        p = self.problems[i]
        gamma = gamma_value(p.gamma, self.sides[p.held_out], self.d)
        return kernel_features(x, self.sides[p.held_out], gamma, self.white[p.held_out, gamma]) @ self.weights[i].T

    def classes_of(self, scores: np.ndarray) -> np.ndarray:
        """One-against-one vote; equal votes by the sum of decision values, then the lower class."""
        votes = np.zeros((len(scores), self.classes))
        for j, (a, b) in enumerate(self.pairs):
            votes[:, b] += scores[:, j] > 0
            votes[:, a] += scores[:, j] <= 0
            edge = scores[:, j] / (3.0 * len(self.pairs) * (1.0 + np.abs(scores[:, j])))
            votes[:, b] += edge
            votes[:, a] -= edge
        return votes.argmax(axis=1) if self.classes > 1 else np.zeros(len(scores), np.int64)

    def held_out_hits(self, table: DataFrame) -> DataFrame:
        """point (number of the problem), n, hits over the rows of each problem's held-out fold, in one pass."""
        held = table.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, got = held.value, {}
            for _, x, fold, y in _batches(batches, model.d):
                for i, p in enumerate(model.problems):
                    out = fold == p.held_out
                    if p.held_out is not None and out.any():
                        hit = int((model.classes_of(model.scores(x[out], i)) == y[out]).sum())
                        n, hits = got.get(i, (0, 0))
                        got[i] = (n + int(out.sum()), hits + hit)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([g[0] for g in got.values()], pa.int64()), pa.array([g[1] for g in got.values()], pa.int64())],
                                             names=["point", "n", "hits"])

        return table.mapInArrow(run, "point int, n long, hits long").groupBy("point").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))

    def predict(self, df: DataFrame, features: Sequence[str], problem: int | dict[int, int] = 0, fold: str | None = None, out: str = "prediction", score: str = "score") -> DataFrame:
        """``df`` with the class and, for two classes, the decision value, by one problem or by the one that ``fold`` maps to."""
        held = df.sparkSession.sparkContext.broadcast(self)
        x = F.array(*(F.col(c).cast("double") for c in features))

        @F.arrow_udf("struct<c: double, s: double>")
        def told(x: pa.Array, at: pa.Array) -> pa.Array:
            model = held.value
            c, s = np.zeros(len(x)), np.zeros(len(x))
            if len(x):
                rows, which = np.asarray(x.flatten(), np.float64).reshape(len(x), -1), at.to_numpy(zero_copy_only=False)
                for i in np.unique(which):
                    scores = model.scores(rows[which == i], int(i))
                    c[which == i] = model.classes_of(scores)
                    s[which == i] = scores[:, 0] if scores.shape[1] else 0.0
            return pa.StructArray.from_arrays([pa.array(c), pa.array(s)], names=["c", "s"])

        if isinstance(problem, dict):
            at = F.lit(None).cast("int")
            for f, i in problem.items():
                at = F.when(F.col(fold) == f, F.lit(i)).otherwise(at)
        else:
            at = F.lit(problem)
        res = df.withColumn("_told", told(x, at))
        return res.withColumn(out, F.col("_told.c")).withColumn(score, F.col("_told.s")).drop("_told")


def svm_grid(table: DataFrame, d: int, classes: int, cs: Sequence[float], gammas: Sequence[float | str], folds: Sequence[int], m: int = LANDMARKS, steps: int = STEPS,
             seed: int = 42) -> list[tuple[str, float, bool]]:
    """M12 + K6: every (C, gamma) with its mean held-out accuracy and a flag at the best, all fits in one chain of passes."""
    problems = [Problem(c, g, f) for c in cs for g in gammas for f in folds]
    model = LandmarkSVM(d, classes, problems, fit_sides(table, d, classes, list(folds), m, seed=seed)).fit(table, steps)
    share = {r["point"]: r["hits"] / r["n"] for r in model.held_out_hits(table).collect()}
    rows = []
    for c in cs:
        for g in gammas:
            own = [share[i] for i, p in enumerate(problems) if (p.c, p.gamma) == (c, g) and i in share]
            rows.append((f"C={c}, gamma={g}", math.fsum(own) / max(1, len(own))))
    best = min(rows, key=lambda r: (-round(r[1], 12), r[0]))[0]
    return [(*r, r[0] == best) for r in rows]


# ---------------------------------------------------------------- calibration

SIGMOID_STEPS = 10


def fit_sigmoid(scored: DataFrame, score: str, label: str, steps: int = SIGMOID_STEPS) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(a s + b)) by Newton steps on smoothed targets (n+1)/(n+2) and 1/(n+2).

    Each step is one aggregate of six sums; a step that raises the loss is
    halved. Without rows of both classes the sigmoid is constant.
    """
    y = F.col(label) == 1
    n = scored.agg(F.count(F.when(y, 1)).alias("p"), F.count(F.when(~y, 1)).alias("q")).first()
    high, low = (n["p"] + 1.0) / (n["p"] + 2.0), 1.0 / (n["q"] + 2.0)
    a, b = 0.0, math.log((n["q"] + 1.0) / (n["p"] + 1.0))
    if not n["p"] or not n["q"]:
        return a, b
    s, t = F.col(score).cast("double"), F.when(y, high).otherwise(low)
    last, start, step = math.inf, (a, b), (0.0, 0.0)
    for _ in range(steps):
        f = F.lit(a) * s + F.lit(b)
        p = 1.0 / (1.0 + F.exp(f))
        # cross entropy, from the smaller exponential
        loss = F.greatest(f, F.lit(0.0)) + F.log1p(F.exp(-F.abs(f))) - (1.0 - t) * f
        r = scored.agg(F.sum(loss).alias("loss"), F.sum((t - p) * s).alias("ga"), F.sum(t - p).alias("gb"), F.sum(p * (1 - p) * s * s).alias("haa"),
                       F.sum(p * (1 - p) * s).alias("hab"), F.sum(p * (1 - p)).alias("hbb")).first()
        if r["loss"] > last * (1 + 1e-12) + 1e-12:
            step = (step[0] / 2, step[1] / 2)
        else:
            haa, hab, hbb = r["haa"] + 1e-12, r["hab"], r["hbb"] + 1e-12
            det = haa * hbb - hab * hab
            last, start = r["loss"], (a, b)
            step = (-(hbb * r["ga"] - hab * r["gb"]) / det, -(haa * r["gb"] - hab * r["ga"]) / det)
        a, b = start[0] + step[0], start[1] + step[1]
    return a, b


def calibrated(df: DataFrame, score: str, sigmoid: tuple[float, float], out: str = "calibrated") -> DataFrame:
    a, b = sigmoid
    return df.withColumn(out, 1.0 / (1.0 + F.exp(F.lit(a) * F.col(score) + F.lit(b))))
