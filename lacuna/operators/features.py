"""Feature rows: assembly, cleaning, clipping, capping, splitting, standardizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.expressions import FEATURES, clip01, finite, month_cos, month_sin


def time_features(months: DataFrame) -> DataFrame:
    """Adds month_sin and month_cos; meant for the month table, not for pixels."""
    return months.withColumns({"month_sin": month_sin(F.col("month")), "month_cos": month_cos(F.col("month"))})


def feature_matrix(pixels: DataFrame, static: DataFrame, months: DataFrame, climate: DataFrame) -> DataFrame:
    """Pixels with terrain and coordinates, time features and climate: the predictors in fixed order, then the rest.

    The static layer (row, col, dem, x, y) and the month table are dimensions that Spark
    broadcasts while they are small and shuffles otherwise; climate joins on the pixel's key.
    """
    joined = pixels.join(climate, ["year", "month", "row", "col"]).join(static, ["row", "col"]).join(time_features(months), ["year", "month"])
    front = [c for c in FEATURES if c != "year"]
    return joined.select("month", "row", "col", *(F.col(c).cast("double") if c in front else F.col(c) for c in FEATURES), *(c for c in joined.columns if c not in {*FEATURES, "month", "row", "col"}))


def drop_invalid(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that are finite in all the columns."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & finite(F.col(c))
    return df.where(fine)


def clip_bands(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: clip01(F.col(c)) for c in columns})


def cap_per_group(df: DataFrame, n: int, group: list[str], key: list[str], seed: int = 42) -> DataFrame:
    """At most n rows of each group, chosen by a digest of the key, the same on every engine and run.

    ``key`` must tell rows apart. The rank stops at n in every map task before the
    shuffle (window group limit), so a large group doesn't travel.
    """
    digest = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed))))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(digest, *key))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


#: Rows of the boundary month that are put in order at once.
RANKED = 100_000
#: Bounds that a month is cut by, in each round of the search for the boundary.
BOUNDS = 64


def temporal_split(df: DataFrame, key: list[str], ratio: float = 0.22) -> DataFrame:
    """Adds is_train: the first floor(N (1 - ratio)) rows in (year, month, key) order.

    Month counts say in which month the boundary falls; there, counts between sampled keys narrow
    it down until few rows are left to be put in order. The split itself is then a comparison with
    the last training row's place: no join, no shuffle, no month in one task. ``key`` must tell a month's rows apart.
    """
    counts = df.groupBy("year", "month").agg(F.count("*").alias("n")).orderBy("year", "month").collect()  # a row a month
    k = int(sum(r.n for r in counts) * (1.0 - ratio))
    before = 0
    for year, month, n in counts:
        if before + n > k:
            break
        before += n
    if k <= 0 or k >= sum(r.n for r in counts):
        return df.withColumn("is_train", F.lit(bool(counts) and k > 0))
    at = F.struct("year", "month")
    edge = F.struct(F.lit(year).cast(df.schema["year"].dataType), F.lit(month).cast(df.schema["month"].dataType))
    if k == before:
        return df.withColumn("is_train", at < edge)
    last = _key_at(df.where((F.col("year") == year) & (F.col("month") == month)).select(*key), k - before, n)
    return df.withColumn("is_train", (at < edge) | ((at == edge) & (F.struct(*key) <= _literal(df, key, last))))


def _literal(df: DataFrame, key: list[str], row) -> Column:
    return F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(key, row)))


def _key_at(keys: DataFrame, place: int, n: int):
    """The key at a place, from 1, among n keys in order."""
    key = keys.columns
    while n > RANKED:
        sample = sorted({tuple(r) for r in keys.orderBy(F.xxhash64(*key), *key).limit(BOUNDS * 4).collect()}, key=_in_order)
        bounds = sample[2::4]
        cell = F.lit(0)
        for b in bounds:
            cell = cell + (F.struct(*key) > _literal(keys, key, b)).cast("int")
        sizes = dict(keys.groupBy(cell.alias("cell")).count().collect())
        chosen = 0
        while place > sizes.get(chosen, 0):
            place -= sizes.get(chosen, 0)
            chosen += 1
        n, keys = sizes[chosen], keys.where(cell == chosen)
    return keys.orderBy(*key).limit(place).agg(F.max(F.struct(*key)).alias("last")).first()["last"]


def _in_order(row: tuple) -> tuple:
    """Null first, text by its bytes, as the engine orders."""
    return tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in row)


def scaler_stats(df: DataFrame, *columns: str) -> DataFrame:
    """One row per column: mean, population deviation, and the scale, which is 1 where that is 0."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in columns)
    long = one.select(F.expr(f"stack({len(columns)}, {pairs}) AS (feature, mean, std)"))
    return long.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns less their mean over their scale; ``stats`` maps a column to both."""
    if not stats:
        raise ValueError("the scaler is not fitted")
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def stats_of(df: DataFrame, *columns: str) -> dict[str, tuple[float, float]]:
    """The statistics as numbers for ``standardize``; as many rows as columns reach the driver."""
    return {r.feature: (float(r["mean"]), float(r["scale"])) for r in scaler_stats(df, *columns).collect()}


def row_counters(df: DataFrame, *columns: str, cap: int | None = None) -> DataFrame:
    """Per month: rows seen, rows finite in all columns, rows kept under the cap, and the finite share in per cent."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & finite(F.col(c))
    out = df.groupBy("year", "month").agg(F.count("*").alias("seen"), F.count_if(fine).alias("clean"))
    kept = F.least(F.col("clean"), F.lit(cap)) if cap else F.col("clean")
    percent = F.lit(100.0) * F.col("clean") / F.greatest(F.col("seen"), F.lit(1))
    return out.withColumns({"kept": kept, "valid_percent": percent, "fully_masked": (F.col("clean") == 0).cast("long")})


def require_rows(df: DataFrame, what: str = "no usable months") -> DataFrame:
    if df.isEmpty():
        raise ValueError(what)
    return df
