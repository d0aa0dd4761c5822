"""Multi-output radial-basis regression: centres, activations, ridge, scoring, grid search.

The model is a few small arrays. K-means runs all its starts, and all numbers of centres that a grid
search tries, side by side: each pass over the rows moves every start one step. One more
pass sums the Gram matrices. A pass leaves one small array a partition, and these are added up on the
executors in groups until few are left. Scoring maps Arrow batches with the model broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, the first in the order of a hash of their values, that starting centres are drawn from.
START_ROWS = 20_000
#: Partitions' arrays that are added up in one group, and the bytes of them that may go to the driver.
GROUP, DRIVER_BYTES = 64, 16 << 20


@dataclass
class RbfModel:
    """Centres (K, d), width, weights (K, outputs), and the scaler its inputs went through."""

    centers: np.ndarray
    gamma: float
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    features: tuple[str, ...]
    outputs: tuple[str, ...]

    def activations(self, x: np.ndarray) -> np.ndarray:
        return activations(x, self.centers, self.gamma)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Raw features in, outputs out."""
        return self.activations((x - self.mean) / self.scale) @ self.weights

    def frame(self, spark: SparkSession) -> DataFrame:
        row = (
            self.centers.ravel().tolist(), self.weights.ravel().tolist(), float(self.gamma), len(self.centers), self.centers.shape[1],
            self.mean.tolist(), self.scale.tolist(), list(self.features), list(self.outputs),
        )
        return spark.createDataFrame([row], "centers array<double>, weights array<double>, gamma double, k int, d int, mean array<double>, scale array<double>, features array<string>, outputs array<string>")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RbfModel:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(f"no model at {path}; fit one first")
        r = spark.read.parquet(path).first()
        outputs = tuple(r.outputs)
        return cls(
            np.array(r.centers).reshape(r.k, r.d), r.gamma, np.array(r.weights).reshape(r.k, len(outputs)), np.array(r["mean"]), np.array(r.scale), tuple(r.features), outputs,
        )


def activations(x: np.ndarray, centers: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - c|^2) for every row and centre."""
    square = (x**2).sum(1)[:, None] - 2.0 * x @ centers.T + (centers**2).sum(1)[None, :]
    return np.exp(-gamma * np.maximum(square, 0.0))


def width_of(centers: np.ndarray) -> float:
    """1 / (2 m^2 + 1e-8) with m the mean distance of all pairs of centres, each with itself included."""
    distance = np.sqrt(((centers[:, None, :] - centers[None, :, :]) ** 2).sum(-1))
    return float(1.0 / (2.0 * distance.mean() ** 2 + 1e-8))


def rbf_expression(vector: str, center: str, gamma: float | str) -> Column:
    """The activation of two arrays as a SQL expression."""
    return F.expr(f"exp(-({gamma}) * aggregate(zip_with({vector}, {center}, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v))")


def starting_centers(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """K-means++ starts: each centre is drawn with a chance in proportion to its squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    near = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        at = rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[at])
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def fit_centers(rows: DataFrame, features: tuple[str, ...], k: int, seeds: int = 10, seed: int = 42) -> np.ndarray:
    """K-means centres: the run with the lowest cost of ``seeds`` runs."""
    return fit_many_centers(rows, features, (k,), seeds, seed)[k]


def _drawn_starts(wanted: DataFrame, features: tuple[str, ...], ks: tuple[int, ...], seeds: int, seed: int) -> list[tuple[int, np.ndarray]]:
    drawn = wanted.orderBy(F.xxhash64(*features), *features).limit(START_ROWS).toArrow()
    if not len(drawn):
        raise ValueError("no rows to find centres in")
    sample = np.column_stack([c.to_numpy() for c in drawn.columns])
    return [(k, starting_centers(sample, k, seed + s)) for k in ks for s in range(seeds)]


def fit_many_centers(rows: DataFrame, features: tuple[str, ...], ks: tuple[int, ...], seeds: int = 10, seed: int = 42, steps: int = 20, tolerance: float = 1e-4, starts: dict[int, list[np.ndarray]] | None = None) -> dict[int, np.ndarray]:
    """The centres of ``fit_centers`` for each k, all runs in the same passes over the rows.

    Starts come from a sample of ``START_ROWS`` rows, steps see all rows. A run stops when no centre
    moves by more than ``tolerance``, all after ``steps``; centres without rows stay. ``starts`` gives the runs of
    each k instead. No rows, an error.
    """
    d = len(features)
    wanted = rows.select(*(F.col(c).cast("double") for c in features))
    runs = [(k, c) for k in starts for c in starts[k]] if starts else _drawn_starts(wanted, features, ks, seeds, seed)
    centers, moving = [c for _, c in runs], list(range(len(runs)))
    cost = np.full(len(runs), np.inf)
    for step in range(steps + 1):
        held = [centers[i] for i in moving]
        sizes = [len(c) * (d + 1) + 1 for c in held]

        def add(total: np.ndarray, x: np.ndarray, held=held, sizes=sizes) -> None:
            square = (x**2).sum(1)
            ones = np.column_stack([x, np.ones(len(x))])
            for c, part in zip(held, np.split(total, np.cumsum(sizes)[:-1])):
                far = square[:, None] - 2.0 * x @ c.T + (c**2).sum(1)[None, :]
                at = far.argmin(1)
                hot = np.zeros((len(x), len(c)))
                hot[np.arange(len(x)), at] = 1.0
                part[:-1] += (hot.T @ ones).ravel()
                part[-1] += np.maximum(far[np.arange(len(x)), at], 0.0).sum()

        sums = np.split(sum_arrays(wanted, sum(sizes), add), np.cumsum(sizes)[:-1])
        still = []
        for i, found in zip(moving, sums):
            cost[i] = found[-1]
            cells = found[:-1].reshape(-1, d + 1)
            n = cells[:, d:]
            after = np.where(n > 0, cells[:, :d] / np.maximum(n, 1.0), centers[i])
            moved = np.sqrt(((after - centers[i]) ** 2).sum(1)).max()
            if step < steps and moved > tolerance:
                centers[i] = after
                still.append(i)
        moving = still
        if not moving:
            break
    best = {}
    for i, (k, _) in enumerate(runs):
        if k not in best or cost[i] < cost[best[k]]:
            best[k] = i
    return {k: centers[i] for k, i in best.items()}


def sum_arrays(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of an array of ``size`` numbers.

    ``add(total, x)`` adds the rows of the matrix x to the array. Partitions' arrays are added in
    groups, in the order of the partitions, until what is left is small enough for the driver.
    """
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("sums", T.BinaryType())])
    target = pa.schema([("part", pa.int64()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(total, np.column_stack([x.to_numpy(zero_copy_only=False) for x in batch.columns]))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]}, schema=target)

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        raw = table.column("sums").to_pylist()
        total = np.zeros(size)
        for i in order:
            total += np.frombuffer(raw[i])
        return pa.table({"part": [table.column("part")[int(order[0])].as_py() // GROUP], "sums": [total.tobytes()]}, schema=target)

    parts = rows.mapInArrow(run, schema)
    left = rows.rdd.getNumPartitions()
    while left * size * 8 > DRIVER_BYTES and left > GROUP:
        parts = parts.groupBy(F.floor(F.col("part") / GROUP)).applyInArrow(merge, schema)
        left = -(-left // GROUP)
    total = np.zeros(size)
    for r in sorted(parts.collect()):
        total += np.frombuffer(r.sums)
    return total


def gram(rows: DataFrame, features: tuple[str, ...], outputs: tuple[str, ...], centers: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A'A, A'Y and Y'Y over all rows."""
    d, o, k = len(features), len(outputs), len(centers)

    def add(total: np.ndarray, m: np.ndarray) -> None:
        z = np.column_stack([activations(m[:, :d], centers, gamma), m[:, d:]])
        total += (z.T @ z).ravel()

    wanted = rows.select(*(F.col(c).cast("double") for c in (*features, *outputs)))
    full = sum_arrays(wanted, (k + o) ** 2, add).reshape(k + o, k + o)
    return full[:k, :k], full[:k, k:], full[k:, k:]


def ridge(ata: np.ndarray, aty: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """(A'A + penalty I)^-1 A'Y; the penalty is not scaled by the rows, and there is no intercept."""
    return np.linalg.solve(ata + penalty * np.eye(len(ata)), aty)


def fit(rows: DataFrame, features: tuple[str, ...], outputs: tuple[str, ...], stats: dict[str, tuple[float, float]], k: int = 50, penalty: float = 1e-3, gamma: float | None = None, seeds: int = 10) -> RbfModel:
    """Centres, width and ridge weights from standardized rows."""
    centers = fit_centers(rows, features, k, seeds)
    gamma = width_of(centers) if gamma is None else gamma
    ata, aty, _ = gram(rows, features, outputs, centers, gamma)
    mean, scale = (np.array([stats[f][i] for f in features]) for i in (0, 1))
    return RbfModel(centers, gamma, ridge(ata, aty, penalty), mean, scale, features, outputs)


def predict(rows: DataFrame, model: RbfModel, keep: tuple[str, ...], suffix: str = "") -> DataFrame:
    """The columns ``keep`` and a prediction per output. NaN features give NaN; infinite ones are an error."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"{o}{suffix}" for o in model.outputs]
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in names)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n:]])
            if np.isinf(x).any():
                raise ValueError("a feature is infinite")
            y = held.predict(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(y[:, i]) for i in range(y.shape[1]))], names=[*keep, *names])

    return rows.select(*keep, *(F.col(f).cast("double").alias(f"__{f}") for f in model.features)).mapInArrow(run, schema)


def grid_search(train: DataFrame, valid: DataFrame, features: tuple[str, ...], outputs: tuple[str, ...], ks: tuple[int, ...] = (30, 50, 100), penalties: tuple[float, ...] = (1e-4, 1e-3, 1e-2), seeds: int = 10, centers: dict[int, np.ndarray] | None = None, gamma: float | None = None) -> tuple[dict, list[tuple]]:
    """The best (k, penalty) by overall error on ``valid``, and all trials (trial, k, penalty, rmse).

    Centres and Gram matrices are made once per k, centres of all k together, and every penalty is solved and scored
    from them: the squared error is Y'Y - 2 W'A'Y + W'A'A W. Ties go to the earlier trial; with no number
    among the errors the best is empty. ``centers`` and ``gamma`` are found unless given.
    """
    trials = []
    n = valid.count() * len(outputs)
    fitted = centers or fit_many_centers(train, features, tuple(ks), seeds)
    for k in ks:
        width = width_of(fitted[k]) if gamma is None else gamma
        ata, aty, _ = gram(train, features, outputs, fitted[k], width)
        vta, vty, yty = gram(valid, features, outputs, fitted[k], width)
        for p in penalties:
            w = ridge(ata, aty, p)
            square = np.trace(yty) - 2.0 * (w * vty).sum() + (w * (vta @ w)).sum()
            trials.append((len(trials), k, p, float(np.sqrt(max(square, 0.0) / n)) if n else float("nan")))
    scored = [t for t in trials if not np.isnan(t[3])]
    best = min(scored, key=lambda t: (t[3], t[0]), default=None)
    return ({"num_centers": best[1], "lambda_reg": best[2], "rmse": best[3]} if best else {}), trials
