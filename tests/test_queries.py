from pathlib import Path

import numpy as np
import pytest
from sqlcheck import same_as_sql

from lacuna import queries as own
from lacuna.operators import features, model

ROOT = Path(__file__).resolve().parent.parent
SQL = own.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, small, name):
    assert same_as_sql(own.queries()[name](spark, small), duck, SQL[name])


def test_every_query_without_sql_is_a_fit():
    assert set(own.queries()) - set(SQL) == {"kmeans_fit", "ridge_fit", "grid_search", "fill_gaps"}


def test_entry_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys


    shutil.copytree(ROOT / "lacuna", tmp_path / "lacuna", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'coverage_counts' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_model_queries_run_the_whole_search(spark, small, monkeypatch):
    asked = []

    def centers(rows, features, ks, seeds=10, seed=42):
        asked.extend((k, seeds) for k in ks)
        return {k: np.random.default_rng(k).normal(size=(k, len(features))) for k in ks}

    monkeypatch.setattr(model, "fit_many_centers", centers)
    found = own.queries()
    assert found["kmeans_fit"](spark, small).count() == 50
    trials = found["grid_search"](spark, small).collect()
    assert [(t.num_centers, t.lambda_reg) for t in sorted(trials)] == [(k, p) for k in (30, 50, 100) for p in (1e-4, 1e-3, 1e-2)]
    found["ridge_fit"](spark, small)
    found["fill_gaps"](spark, small)
    assert asked == [(50, 10), (30, 10), (50, 10), (100, 10), (50, 10), (50, 10)]


def test_kmeans_is_lloyds(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 2)) + c for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame(x.tolist(), "a double, b double").repartition(3)
    start = x[[0, 1, 2, 3]]
    want = start
    for _ in range(5):
        at = ((x[:, None] - want) ** 2).sum(-1).argmin(1)
        want = np.array([x[at == i].mean(0) if (at == i).any() else want[i] for i in range(4)])
    assert np.allclose(model.fit_many_centers(df, ("a", "b"), (4,), steps=5, tolerance=0.0, starts={4: [start]})[4], want)
    found = model.fit_centers(df, ("a", "b"), 3)
    cost = ((x[:, None] - found) ** 2).sum(-1).min(1).sum()
    assert cost == pytest.approx(sum(((g - g.mean(0)) ** 2).sum() for g in np.split(x, 3)), rel=0.02)


def test_arrays_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(model, "GROUP", 2)
    monkeypatch.setattr(model, "DRIVER_BYTES", 0)
    df = spark.range(100).selectExpr("cast(id AS double) AS v").repartition(7)

    def add(total, x):
        total += [len(x), x.sum()]

    assert model.sum_arrays(df, 2, add).tolist() == [100.0, 4950.0]


def test_split_narrows_the_month_down(spark, monkeypatch):
    monkeypatch.setattr(features, "RANKED", 20)
    monkeypatch.setattr(features, "BOUNDS", 4)
    rows = [(2000 + i % 2, 1 + i % 3, f"k{i % 7}" if i % 11 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "year int, month int, a string, b long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3]))
    for ratio in (0.0, 0.22, 0.5, 0.87, 1.0):
        train = {tuple(r)[:4] for r in features.temporal_split(df, ["a", "b"], ratio).where("is_train").collect()}
        assert train == set(order[: int(900 * (1.0 - ratio))])
