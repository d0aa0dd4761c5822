"""Grids of pixels as rows: coordinates, flattening, resampling, neighbourhoods, stacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.expressions import along, reflected, unit_coordinate


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(row, col) of every cell."""
    cells = spark.range(height * width)
    return cells.select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def pixel_coords(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Adds x and y in [0, 1]."""
    return cells.withColumns({"x": unit_coordinate(F.col("col"), F.lit(width)), "y": unit_coordinate(F.col("row"), F.lit(height))})


def bounds_coords(cells: DataFrame, height: int, width: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Adds x and y between (min_x, min_y, max_x, max_y), ends included; y rises with the row."""
    low_x, low_y, high_x, high_y = bounds
    return cells.withColumns({"x": along(F.col("col"), F.lit(width), low_x, high_x), "y": along(F.col("row"), F.lit(height), low_y, high_y)})


def flatten(cells: DataFrame, width: int) -> DataFrame:
    """(row, col) as pixel_id, row by row."""
    return cells.withColumn("pixel_id", F.col("row").cast("long") * width + F.col("col")).drop("row", "col")


def unflatten(pixels: DataFrame, width: int) -> DataFrame:
    return pixels.withColumns({"row": F.floor(F.col("pixel_id") / width).cast("int"), "col": (F.col("pixel_id") % width).cast("int")}).drop("pixel_id")


def from_arrays(df: DataFrame, vector: str, width: int, *keys: str) -> DataFrame:
    """A raster held as one array per row, as pixels (keys, row, col, value)."""
    at = df.select(*keys, F.posexplode(vector).alias("pixel_id", "value"))
    return unflatten(at, width).withColumn("value", F.col("value").cast("double"))


def stack_bands(long: DataFrame, bands: tuple[str, ...], *keys: str) -> DataFrame:
    """Long pixels (keys, band, value) as one column per band, for keys that have every band; one pre-aggregated shuffle."""
    at = lambda b: F.col("band") == b
    seen = [F.max(at(b)).alias(f"has {b}") for b in bands]
    wide = long.where(F.col("band").isin(*bands)).groupBy(*keys).agg(*(F.first(F.when(at(b), F.col("value")), ignorenulls=True).alias(b) for b in bands), *seen)
    every = F.lit(True)
    for b in bands:
        every = every & F.col(f"has {b}")
    return wide.where(every).select(*keys, *bands)


def resample(pixels: DataFrame, height: int, width: int, out_height: int, out_width: int, *keys: str) -> DataFrame:
    """Bilinear values (keys, row, col, value) on another grid, cell centres aligned, edges clamped.

    Each target cell's up to four sources come from a table of weights, whose size is
    that of the target grid; NULL and NaN sources drop out and the weights are renormalised.
    """

    def axis(n: int, out: int, name: str) -> DataFrame:
        spark = pixels.sparkSession
        s = (F.col("id") + F.lit(0.5)) * F.lit(n / out) - F.lit(0.5)
        s = F.greatest(F.least(s, F.lit(float(n - 1))), F.lit(0.0))
        low = F.floor(s).cast("int")
        both = F.array(
            F.struct(low.alias("source"), (F.lit(1.0) - (s - low)).alias("weight")),
            F.struct(F.least(low + 1, F.lit(n - 1)).alias("source"), (s - low).alias("weight")),
        )
        rows = spark.range(out).select(F.col("id").cast("int").alias(f"out_{name}"), F.explode(both).alias("e"))
        return rows.select(f"out_{name}", F.col("e.source").alias(name), F.col("e.weight").alias(f"w_{name}")).where(F.col(f"w_{name}") > 0)

    joined = pixels.join(F.broadcast(axis(height, out_height, "row")), "row").join(F.broadcast(axis(width, out_width, "col")), "col")
    weight = F.when(~F.isnan("value"), F.col("w_row") * F.col("w_col"))
    value = F.sum(weight * F.when(~F.isnan("value"), F.col("value"))) / F.sum(weight)
    return joined.groupBy(*keys, F.col("out_row").alias("row"), F.col("out_col").alias("col")).agg(value.alias("value"))


def windows(pixels: DataFrame, height: int, width: int, size: int, *keys: str) -> DataFrame:
    """Each pixel's neighbourhood as an array, row by row, mirrored at the edges; an even size is the next odd one.

    Pixels are gathered into whole rows of the grid, which travel as arrays to the rows
    whose windows they lie in; windows are cut from these arrays. The grid must be
    complete, which is checked, and wider than half a window.
    """
    half = size // 2
    if half > height - 1 or half > width - 1:
        raise ValueError("the window is larger than the mirrored grid")
    reach = F.sequence(F.lit(-half), F.lit(half))
    line = F.array_sort(F.collect_list(F.struct(F.col("col"), F.col("value"))))
    lines = pixels.groupBy(*keys, "row").agg(line.alias("line"))
    whole = F.when(F.size("line") == width, F.col("line.value")).otherwise(F.raise_error(F.lit("a row of the grid lacks pixels or repeats some")))
    lines = lines.select(*keys, "row", whole.alias("line"))
    # Row s stands at distance d from row r = s - d, and from rows near the edge that it is mirrored to.
    targets = F.array_distinct(F.array(F.col("row") - F.col("d"), -F.col("row") - F.col("d"), 2 * (height - 1) - F.col("row") - F.col("d")))
    sent = lines.withColumn("d", F.explode(reach)).withColumn("out", F.explode(targets))
    sent = sent.where((F.col("out") >= 0) & (F.col("out") < height) & (reflected(F.col("out") + F.col("d"), F.lit(height)) == F.col("row")))
    rows = sent.groupBy(*keys, F.col("out").alias("row")).agg(F.array_sort(F.collect_list(F.struct("d", "line"))).alias("near"))
    place = lambda c: F.transform(reach, lambda d: reflected(c + d, F.lit(width)) + 1)
    window = F.flatten(F.transform("near", lambda n: F.transform(place(F.col("col")), lambda i: F.element_at(n["line"], i))))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return cells.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), window.alias("window"))


def concat_features(df: DataFrame, *arrays: str, out: str = "features") -> DataFrame:
    """Per sample: the given arrays, nested ones flattened first, one after the other."""
    flat = [F.flatten(a) if df.schema[a].dataType.typeName() == "array" and df.schema[a].dataType.elementType.typeName() == "array" else F.col(a) for a in arrays]
    return df.withColumn(out, F.concat(*flat))


def stack_climate(precip: DataFrame, temp: DataFrame, *keys: str) -> DataFrame:
    """(keys, precip, temp) where both are there; a month or pixel that lacks either is left out."""
    one = lambda df, name: df.select(*keys, F.col("value").alias(name))
    return one(precip, "precip").join(one(temp, "temp"), list(keys))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
