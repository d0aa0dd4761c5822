import numpy as np
import pytest

from lacuna.llm import ann, queries


def brute(ids, x, query, k):
    s = np.einsum("ij,j->i", x, x[query])
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[query]]
    return [(int(ids[i]), s[i]) for i in order[:k]]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], "x") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, part string")


def recall(found, ids, x, k):
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        got = sorted(by[ids[q]])
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        for _, i, s in got:
            assert s == pytest.approx(float(x[np.flatnonzero(ids == i)[0]] @ x[q]), abs=1e-12)
        want = {i for i, _ in brute(ids, x, q, k)}
        hit += len(want & {g[1] for g in got})
        total += len(want)
    return hit / total


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))).astype(np.float32).astype(float)
    ids = rng.permutation(4000)
    found = ann.search(frame(spark, ids, x), lambda i: i % 20 == 0).collect()
    assert len(found) == 200 * 20 and recall(found, ids, x, 20) >= 0.9


def test_router_asks_few_partitions_where_there_is_structure():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(32, 24)) * 3
    x = centres[rng.integers(0, 32, 6000)] + 0.5 * rng.normal(size=(6000, 24))
    index = ann.fit_index(x, 20)
    assert index.parts == 32 and index.probes <= 16


def test_balanced_partition():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    label = ann.balanced_partition(x, ann.neighbour_graph(x, 8), 16)
    size = np.bincount(label, minlength=16)
    assert size.max() <= 2000 / 16 * 1.06 and size.min() >= 2000 / 16 * 0.9


def test_ties_nulls_and_broken_vectors(spark):
    good = [(i, [1.0, 2.0, 2.0]) for i in range(0, 60)]
    rows = good + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 1.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(df, lambda i: i % 20 == 0).collect()
    assert {r.query_id for r in found} == {0, 20, 40} and {r.score for r in found} == {9.0}
    for q in (0, 20, 40):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(22) if i != q][:20]


def test_fewer_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(df, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(0, 1, 0.5), (0, 2, -1.0)]
    assert ann.search(df.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0
    assert ann.search(df.where("false"), lambda i: i % 20 == 0).count() == 0


def test_tiles_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype(np.float32).astype(float)
    ids = np.arange(300)
    whole = sorted(map(tuple, ann.search(frame(spark, ids, x), lambda i: i % 20 == 0).collect()))
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 4)
    assert sorted(map(tuple, ann.search(frame(spark, ids, x), lambda i: i % 20 == 0).collect())) == whole


def test_each_length_is_searched(spark):
    odd = [(20 * i, [1.0, float(i + 1)]) for i in range(30)] + [(601, [1.0])]
    rows = odd + [(1000 + i, [1.0, 2.0, float(i)]) for i in range(40)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0, k=5).collect()
    assert {r.query_id for r in found} == {20 * i for i in range(30)} | {1000, 1020} and len(found) == 32 * 5
    assert all((r.query_id < 1000) == (r.vec_id < 1000) for r in found)
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 1020] == [1039, 1038, 1037, 1036, 1035]


def test_repeated_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 4)).astype(np.float32).astype(float)
    ids = np.r_[np.arange(40), [0, 0, 20, 7, 7, 7, 41, 42, 43, 44]]
    x[40] = x[0]
    rows = [ann.search(frame(spark, ids, x).repartition(3), lambda i: i % 20 == 0, k=10).collect()][0]
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    for query in (0, 20):
        want = []
        for q in np.flatnonzero(ids == query):
            s = x @ x[q]
            order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
            want += [(n + 1, int(ids[i]), round(float(s[i]), 9)) for n, i in enumerate(order)]
        assert sorted(got[query]) == sorted(want)


def test_rows_made_do_not_follow_the_partitions(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32)).astype(np.float32).astype(float)
    ids = np.arange(4000)
    vectors = ann.valid_vectors(frame(spark, ids, x).repartition(3), "vec_id", "embedding")
    made = [ann._near(vectors, 32, lambda i: i % 20 == 0, 20, parts, 0.96).count() for parts in (16, 64)]
    assert max(made) <= 200 * 20 * 8


def test_best_rows_of_a_stream():
    rng = np.random.default_rng(13)
    x = rng.integers(-2, 3, (500, 4)).astype(float)
    ids, own, parts = rng.permutation(500) // 2, np.arange(500), np.sort(rng.integers(0, 5, 500))
    asks = rng.random((30, 5)) < 0.6
    best = ann.Best(ids[:30], own[:30], x[:30], asks, 7)
    for at in range(0, 500, 33):
        now = slice(at, at + 33)
        best.see(ids[now], own[now], x[now], parts[now])
    for q in range(30):
        s = x @ x[q]
        want = [i for i in np.lexsort((ids, -s)) if i != q and asks[q, parts[i]]][:7]
        got = best.found[q][best.score[q] > -np.inf]
        assert got.tolist() == ids[want].tolist() and best.score[q][: len(want)].tolist() == s[want].tolist()


def test_query_reaches_its_recall(spark, small):
    for folder in (small, small.replace("sf0.001", "sf0.1")):
        table = spark.read.parquet(f"{folder}/embeddings.parquet").toArrow()
        ids = table.column("vec_id").to_numpy()
        x = np.array(table.column("embedding").to_pylist(), float)
        found = queries.op8_nearest_neighbours(spark, folder).collect()
        assert len(found) == 20 * (ids % 20 == 0).sum() and recall(found, ids, x, 20) >= 0.9
