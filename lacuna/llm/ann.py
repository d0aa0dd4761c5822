"""Approximate nearest neighbours over learned partitions.

A bounded sample's neighbour graph is cut into balanced partitions with few cut edges; a
small classifier learns from a vector to say in which partitions its neighbours lie.
Every row is indexed in its most probable partition, and each query is routed to its
several most probable ones, as many as reach the wanted recall on held-out vectors of the
sample. Blocks of queries with neighbouring homes each see the rows of the partitions that they ask
stream past in several lanes. There inner products are computed exactly and each query's best so far are kept, so a
lane gives a query's best once, however many partitions it asks; the lanes' are merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import arrow_map, materialize

#: Vectors, the first in the order of a hash of their ids, that the partitions and the router are fitted on, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 12_000, 64 << 20
#: Rows of a partition on average, and the fewest and most partitions; more than the last would need a larger sample.
PART_ROWS, FEWEST, MOST = 1_024, 8, 256
#: Recall that the number of partitions asked must reach on the sample's held-out queries.
RECALL = 0.96
#: Rows that a block of queries meets at once, queries in a block, bytes of their vectors at most, and queries in one product.
ROWS, QUERIES, QUERY_BYTES, AT_ONCE = 2_048, 8_192, 16 << 20, 1_024
#: Lanes that a block's rows are dealt over, and rows that a lane may have before there are more lanes; tasks at most.
LANES, LANE_ROWS, TASKS = 8, 2 << 20, 4_096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each vector the k others with the largest inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, give: float = 0.05) -> np.ndarray:
    """Labels of a balanced cut of the graph.

    Starts from halving along principal directions; then vertices move, those that gain most
    first, to the partition that holds most of their neighbours while it has room.
    """
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            centred = x[g] - x[g].mean(0)
            axis = np.linalg.svd(centred[:2048], full_matrices=False)[2][0]
            order = g[np.argsort(centred @ axis, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    for i, g in enumerate(groups):
        label[g] = i
    n, room = len(groups), int(np.ceil(len(x) / len(groups) * (1 + give)))
    least = int(len(x) / n * (1 - give))
    size = np.bincount(label, minlength=n)
    rows = np.repeat(np.arange(len(x)), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(x), n))
        np.add.at(votes, (rows, label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), label[rows]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room and size[label[i]] > least:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer from a vector to the partitions' probabilities."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Unnormalised log probabilities; their order is that of the probabilities."""
        return np.tanh(x * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 25, seed: int = 7) -> Router:
    """Adam on the cross-entropy with the share of each vector's neighbours per partition."""
    rng = np.random.default_rng(seed)
    scale = 1.0 / max(float(np.sqrt((x**2).sum(1).mean() / x.shape[1])), 1e-12)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            xs = x[rows] * scale
            h = np.tanh(xs @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[rows]) / len(rows)
            dh = d @ weights[2].T * (1 - h**2)
            t += 1
            for i, g in enumerate((xs.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - 0.004 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*weights, scale)


@dataclass
class Index:
    router: Router
    parts: int
    probes: int


def fit_index(sample: np.ndarray, k: int, parts: int = 32, recall: float = RECALL) -> Index:
    """Partitions, router and number of partitions to ask, from distinct sample vectors.

    A sample of fewer than 40 vectors a partition gets fewer partitions, down to one.
    """
    x = np.unique(np.asarray(sample, float), axis=0)
    x = x[np.random.default_rng(11).permutation(len(x))]
    while parts > 1 and len(x) < 40 * parts:
        parts //= 2
    if parts == 1:
        dim = x.shape[1] if x.ndim == 2 else 1
        return Index(Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0), 1, 1)
    held = len(x) // 8
    train, queries = x[held:], x[:held]
    graph = neighbour_graph(train, 16)
    label = balanced_partition(train, graph, parts)
    target = np.zeros((len(train), parts))
    np.add.at(target, (np.repeat(np.arange(len(train)), graph.shape[1]), label[graph].ravel()), 1 / graph.shape[1])
    router = train_router(train, target)
    home = router.scores(train).argmax(1)
    best = np.argpartition(-(queries @ train.T), k - 1, axis=1)[:, :k]
    place = np.empty((len(queries), parts), np.int64)
    order = np.argsort(-router.scores(queries), axis=1, kind="stable")
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, home[best], axis=1)
    reached = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    return Index(router, parts, int(np.argmax(reached >= recall)) + 1)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows whose vector is neither null nor zero and holds finite numbers only; rows without id are left out."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine")).where("fine AND vec_id IS NOT NULL").drop("fine")


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(-1, dim)


def best_in_tile(
    ids: np.ndarray, own: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int, asked: np.ndarray, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest rows of those that it ``asked`` for, without the query's own row: (place of the query, id, score).

    Rows surely below ``least``, the query's k-th best so far, may be left out.
    A fast product picks all rows near the k-th best, ties included; their scores are then
    summed the same way for every pair, so equal vectors have equal scores.
    """
    s = q @ x.T
    s[~asked | (query_rows[:, None] == own[None, :])] = -np.inf
    n = min(k, x.shape[0])
    edge = np.maximum(np.partition(s, x.shape[0] - n, axis=1)[:, x.shape[0] - n], least)
    slack = 1e-9 * np.maximum(1.0, np.abs(edge))
    edge = np.where(np.isfinite(edge), edge - slack, -np.finfo(float).max)
    rows, cols = np.nonzero(s >= edge[:, None])
    score = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 18):
        score[at : at + (1 << 18)] = np.einsum("ij,ij->i", q[rows[at : at + (1 << 18)]], x[cols[at : at + (1 << 18)]])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[cols[keep]], score[keep]


class Best:
    """The k nearest rows of each query of a block among the rows seen so far, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, asks: np.ndarray, k: int):
        self.ids, self.rows, self.q, self.asks, self.k = ids, rows, q, asks, k  # asks: whether a query asks a partition
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, own: np.ndarray, x: np.ndarray, parts: np.ndarray) -> None:
        asking = np.flatnonzero(self.asks[:, np.unique(parts)].any(1))
        for start in range(0, len(asking), AT_ONCE):
            some = asking[start : start + AT_ONCE]
            at, found, score = best_in_tile(ids, own, x, self.rows[some], self.q[some], self.k, self.asks[some][:, parts], self.score[some, -1])
            changed, at = np.unique(at, return_inverse=True)
            if not changed.size:
                continue
            some = some[changed]
            at = np.r_[np.repeat(np.arange(len(some)), self.k), at]
            found, score = np.r_[self.found[some].ravel(), found], np.r_[self.score[some].ravel(), score]
            order = np.lexsort((found, -score, at))
            first = np.searchsorted(at[order], np.arange(len(some)))
            best = order[first[:, None] + np.arange(self.k)]
            self.found[some], self.score[some] = found[best], score[best]

    def rows_found(self) -> dict:
        at, rank = np.nonzero(self.score > -np.inf)
        return {"query_id": self.ids[at], "query_row": self.rows[at], "vec_id": self.found[at, rank], "score": self.score[at, rank]}


def stream_past(batches, dim: int, parts: int, k: int, rows: int):
    """The best of each query of each group, from batches (group, is_row, part, vec_id, row, v, homes) sorted by the first three.

    A group's queries come first and stay; its rows are held ``rows`` at a time.
    """
    group, queries, held, count, best = None, [], [], 0, None

    def meet() -> Best:
        seen = best
        if seen is None:
            asks = np.zeros((sum(len(b) for b in queries), parts), bool)
            homes = np.concatenate([_matrix(b.column(6), b.column(6).value_lengths()[0].as_py()) for b in queries]).astype(np.int64)
            np.put_along_axis(asks, homes, True, axis=1)
            ids, own = (np.concatenate([b.column(c).to_numpy() for b in queries]) for c in (3, 4))
            seen = Best(ids, own, np.concatenate([_matrix(b.column(5), dim) for b in queries]), asks, k)
        if held:
            at, ids, own = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (2, 3, 4))
            x = np.concatenate([_matrix(b.column(5), dim) for b in held])
            for start in range(0, len(x), rows):
                now = slice(start, start + rows)
                seen.see(ids[now], own[now], x[now], at[now])
        return seen

    for batch in batches:
        groups, is_row = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        edges = np.flatnonzero((groups[1:] != groups[:-1]) | (is_row[1:] != is_row[:-1])) + 1
        for start, end in zip(np.r_[0, edges].tolist(), np.r_[edges, len(groups)].tolist()):
            if start == end:
                continue
            if groups[start] != group:
                if queries:
                    yield meet().rows_found()
                group, queries, held, count, best = groups[start], [], [], 0, None
            part = batch.slice(start, end - start)
            if not is_row[start]:
                queries.append(part)
            elif queries:
                held.append(part)
                count += len(part)
                if count >= rows:
                    best, held, count = meet(), [], 0
    if queries:
        yield meet().rows_found()


def search(df: DataFrame, is_query, k: int = 20, parts: int | None = None, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k nearest rows found.

    Queries are the rows that ``is_query`` (a function of the id column) picks;
    candidates are all rows but the query's own, so rows may repeat: each row of a repeated
    query id gets its own k results, and other rows of its id are candidates. Nearness is the inner product in double
    precision; ties go to the smaller id. There are about as many partitions as thousands of rows, within bounds. Vectors that are null or zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors of each length
    are searched on their own, among those of the same length. Fewer candidates give fewer rows; an empty table
    gives none. The number of partitions asked is chosen so that ``recall`` is reached
    on held-out vectors of the sample.
    """
    spark = df.sparkSession
    vectors = valid_vectors(df, id_col, vector_col)
    dims = sorted(r.dim for r in vectors.select(F.size("v").alias("dim")).distinct().collect())
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = reduce(DataFrame.unionByName, [_near(vectors.where(F.size("v") == dim), dim, is_query, k, parts, recall) for dim in dims])
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(vectors: DataFrame, dim: int, is_query, k: int, parts: int | None, recall: float) -> DataFrame:
    """(query_id, query_row, vec_id, score) of the nearest in each lane, for vectors of one length."""
    spark = vectors.sparkSession
    rows_all = vectors.count()
    if parts is None:
        parts = FEWEST
        while parts < MOST and parts * PART_ROWS < rows_all:
            parts *= 2
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    index = fit_index(_matrix(chosen.column("v"), dim), k, parts, recall)
    shared = spark.sparkContext.broadcast(index)

    placed_type = T.StructType([*vectors.schema.fields, T.StructField("homes", T.ArrayType(T.IntegerType()))])

    def place(batches):
        held = shared.value
        for batch in batches:
            scores = held.router.scores(_matrix(batch.column(1), dim))
            order = np.argsort(-scores, axis=1, kind="stable")[:, : held.probes].astype(np.int32)
            yield {"vec_id": batch.column(0), "v": batch.column(1), "homes": [*order]}

    placed = arrow_map(vectors, place, placed_type).withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "placed-vectors")
    home = F.col("homes")[0]
    queries = placed.where(is_query(F.col("vec_id")))
    size = dict.fromkeys(range(index.parts), 0) | {r.part: r["count"] for r in queries.groupBy(home.alias("part")).count().collect()}  # a number per partition
    at_most = max(1, min(QUERIES, QUERY_BYTES // (8 * dim)))
    before = np.cumsum([0, *(size[p] for p in range(index.parts))]).tolist()
    blocks, lanes = -(-before[-1] // at_most), max(LANES, -(-rows_all // LANE_ROWS))

    def of_home(numbers):
        return F.element_at(F.array(*[F.lit(n).cast("long") for n in numbers]), home + 1)

    place_in_line = of_home(before[:-1]) + F.pmod(F.xxhash64("row"), of_home(size[p] for p in range(index.parts)))
    queries = queries.withColumn("block", F.floor(place_in_line / at_most))
    asked = queries.select("block", F.explode("homes").alias("part")).groupBy("part").agg(F.collect_set("block").alias("blocks"))
    asked = F.broadcast(asked)  # a row per partition at most

    def grouped(df, block, lane, is_row, homes):
        return df.select((block * lanes + lane).alias("group"), F.lit(is_row).alias("is_row"), home.alias("part"), "vec_id", "row", "v", homes.alias("homes"))

    left = grouped(queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))), F.col("block"), F.col("lane"), False, F.col("homes"))
    right = placed.join(asked, home == F.col("part")).withColumn("block", F.explode("blocks"))
    right = grouped(right, F.col("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(lanes)), True, F.lit(None).cast("array<int>"))
    tasks = max(1, min(TASKS, blocks * lanes))
    met = left.unionByName(right).repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group", "is_row", "part")
    rows, parts = ROWS, index.parts
    return arrow_map(met, lambda batches: stream_past(batches, dim, parts, k, rows), FOUND)
