"""Hand-checkable values of the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import expressions as X
from lacuna.functions import metrics
from lacuna.operators import coverage, features, grid, model
from lacuna.plans import gapfill


def value(spark, column, **cells):
    kinds = {int: "bigint", float: "double", str: "string", type(None): "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


def test_indices(spark):
    cube = spark.createDataFrame([(0.1, 0.0, 0.05, 0.5, 0.3, 0.0, 0.9)], ", ".join(f"{b} double" for b in X.BANDS))
    r = gapfill.spectral_indices(cube).first()
    assert (r.ndvi, r.bsi, r.vhi) == pytest.approx((0.6666655556, -0.1578945706, 0.3833327778), abs=1e-9)


def test_zero_divisor_is_nan(spark):
    assert math.isnan(value(spark, X.guarded_ratio(F.col("a"), F.col("b")), a=0.0, b=0.0))


def test_scaling(spark):
    assert value(spark, X.optical(F.col("a")), a=10000.0) == pytest.approx(0.075)
    assert value(spark, X.thermal(F.col("a")), a=40000.0) == pytest.approx(285.7208)


def test_time_features(spark):
    rows = features.time_features(spark.createDataFrame([(1,), (3,), (12,)], "month int")).collect()
    assert [r.month_sin for r in rows] == pytest.approx([0.5, 1, 0], abs=1e-9)
    assert [r.month_cos for r in rows] == pytest.approx([0.8660254038, 0, 1], abs=1e-9)


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-0.2, 0.4, 285.7, float("nan"), None])], "i int, v double")
    got = [r.v for r in features.clip_bands(df, "v").orderBy("i").collect()]
    assert got[:3] == [0, 0.4, 1] and math.isnan(got[3]) and got[4] is None


def test_finite_filter(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, float("nan"), float("inf"), -float("inf"), None]], "v double")
    assert [r.v for r in features.drop_invalid(df, "v").collect()] == [1.0]


def test_coordinates(spark):
    r = grid.pixel_coords(grid.grid(spark, 2, 3), 2, 3).where("row = 1 AND col = 1").first()
    assert (r.x, r.y) == (0.5, 1.0)
    r = grid.pixel_coords(grid.grid(spark, 1, 1), 1, 1).first()
    assert (r.x, r.y) == (0.0, 0.0)


def test_windows(spark):
    cells = grid.grid(spark, 3, 3).withColumn("value", (F.col("row") * 3 + F.col("col") + 1).cast("double"))
    got = {(r.row, r.col): r.window for r in grid.windows(cells, 3, 3, 3).collect()}
    assert got[0, 0] == [5, 4, 5, 2, 1, 2, 5, 4, 5] and got[1, 2] == [2, 3, 2, 5, 6, 5, 8, 9, 8]
    assert len(grid.windows(cells, 3, 3, 2).first().window) == 9
    with pytest.raises(ValueError):
        grid.windows(cells, 3, 3, 7)


def test_bilinear(spark):
    cells = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "row int, col int, value double")
    got = [r.value for r in grid.resample(cells, 1, 2, 1, 4).orderBy("col").collect()]
    assert got == [0, 0.25, 0.75, 1]


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "a double, b double")
    got = features.standardize(df, features.stats_of(df, "a", "b")).collect()
    assert [r.a for r in got] == pytest.approx([-1.2247449, 0, 1.2247449], abs=1e-6) and [r.b for r in got] == [0, 0, 0]
    with pytest.raises(ValueError):
        features.standardize(df, {})


@pytest.mark.parametrize(("n", "train"), [(1, 0), (4, 3), (10, 7), (50, 39), (100, 78), (101, 78)])
def test_holdout(spark, n, train):
    df = spark.range(n).select(F.col("id"), F.lit(2000).alias("year"), (F.col("id") % 3 + 1).cast("int").alias("month"))
    got = features.temporal_split(df, ["id"])
    assert got.where("is_train").count() == train and got.count() == n
    order = sorted(got.collect(), key=lambda r: (r.year, r.month, r.id))
    assert [r.is_train for r in order] == [i < train for i in range(n)]


def test_cap(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("g"))
    got = features.cap_per_group(df, 7, ["g"], ["id"])
    assert got.groupBy("g").count().where("count = 7").count() == 2
    assert sorted(got.collect()) == sorted(features.cap_per_group(df.repartition(5), 7, ["g"], ["id"]).collect())


def test_width_and_activation(spark):
    centers = np.array([[0.0, 0.0], [3.0, 4.0]])
    gamma = model.width_of(centers)
    assert gamma == pytest.approx(0.079999999936, abs=1e-12)
    assert model.activations(np.zeros((1, 2)), centers, gamma)[0] == pytest.approx([1, 0.1353352839], abs=1e-8)


def test_ridge():
    a, y = np.array([[1.0, 0], [1, 1], [0, 1]]), np.array([[1.0], [3], [2]])
    assert model.ridge(a.T @ a, a.T @ y, 0.5)[:, 0] == pytest.approx([0.9523809524, 1.6190476190], abs=1e-9)


def test_metrics(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 5.0), ("b", 10.0, 12.0), ("b", 20.0, 18.0), ("b", 30.0, 30.0)]
    df = spark.createDataFrame(rows, "band string, y double, p double")
    by = lambda d, c: {r.band: r[c] for r in d.collect()}
    assert by(metrics.rmse_by(df, "band"), "rmse") == pytest.approx({"a": 1.1547005384, "b": 1.6329931619}, abs=1e-9)
    assert by(metrics.mae_by(df, "band"), "mae") == pytest.approx({"a": 2 / 3, "b": 4 / 3})
    assert by(metrics.r2_by(df, "band"), "r2") == pytest.approx({"a": -0.99999999, "b": 0.96}, abs=1e-7)
    assert metrics.rmse_overall(df).first().rmse == pytest.approx(1.4142135624, abs=1e-9)


def test_quality_bits(spark):
    got = {q: value(spark, X.clear(F.col("q")), q=q) for q in (0, 8, 16, 24, 7, 33)}
    assert got == {0: True, 8: False, 16: False, 24: False, 7: True, 33: True}


def test_mission_priority(spark):
    table = coverage.priority_table(spark)
    get = lambda y: [r.mission for r in table.where(f"first <= {y} AND last >= {y}").orderBy("rank").collect()]
    assert [get(y) for y in (1998, 2012, 2013, 2021, 2022)] == [["l5", "l7"], ["l7", "l5"], ["l8", "l7"], ["l8", "l7"], ["l9", "l8", "l7"]]


def test_gap_literal(spark):
    gaps = spark.createDataFrame([(1995, 9), (1995, 6)], "year int, month int")
    assert coverage.gap_literal(gaps).first()[0] == "  {y: 1995, m: 6},\n  {y: 1995, m: 9}"


def test_pivot_refuses_duplicates(spark):
    twice = spark.createDataFrame([(2000, 1, 5), (2000, 1, 6)], "year int, month int, v int")
    with pytest.raises(Exception, match="twice"):
        coverage.month_pivot(twice, "v").collect()


def test_gap_and_covered_make_the_calendar(spark):
    months = coverage.calendar(spark, 2000, 2001)
    seen = spark.createDataFrame([(2000, 3), (2001, 12)], "year int, month int")
    assert coverage.covered(months, seen).count() + coverage.uncovered(months, seen).count() == 24
