"""Fitting on observed months and filling the missing ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import metrics
from lacuna.functions.expressions import BANDS, FEATURES, bsi, finite, ndvi, vhi
from lacuna.operators import coverage, features, model


def spectral_indices(cube: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ndvi, bsi and vhi from the bands' columns."""
    c = {b: F.col(f"{prefix}{b}") for b in ("red", "blue", "nir", "swir1", "thermal")}
    out = cube.withColumns({"ndvi": ndvi(c["red"], c["nir"]), "bsi": bsi(c["swir1"], c["red"], c["nir"], c["blue"])})
    return out.withColumn("vhi", vhi(F.col("ndvi"), c["thermal"]))


def training_rows(matrix: DataFrame, key: list[str], cap: int | None, seed: int = 42, clip: tuple[str, ...] = BANDS) -> DataFrame:
    """Finite rows, capped per month, with clipped targets."""
    rows = features.drop_invalid(matrix, *FEATURES, *BANDS)
    if cap:
        rows = features.cap_per_group(rows, cap, ["year", "month"], key, seed)
    return features.clip_bands(rows, *clip)


def fit_pipeline(matrix: DataFrame, cfg: dict, key: list[str] = ("row", "col"), fit_scope: str = "all", seeds: int = 10) -> tuple[model.RbfModel, DataFrame]:
    """The fitted model, and its errors on the held-out rows (band, rmse; the band 'overall' over all of them).

    ``fit_scope`` says whether the scaler sees all rows, as is the custom here, or the
    training rows only.
    """
    key = list(key)
    rows = training_rows(matrix, key, cfg.get("max_pixels_per_month"), cfg.get("seed", 42)).persist()
    try:
        split = features.temporal_split(features.require_rows(rows), key, cfg["val_ratio"])
        scope = split if fit_scope == "all" else split.where("is_train")
        stats = features.stats_of(scope, *FEATURES)
        scaled = features.standardize(split, stats)
        train = scaled.where("is_train")
        fitted = model.fit(train, FEATURES, BANDS, stats, cfg["num_centers"], cfg["lambda_reg"], cfg.get("gamma"), seeds=seeds)
        scored = model.predict(split.where("NOT is_train"), fitted, BANDS, suffix="_pred")
        pairs = ", ".join(f"'{b}', `{b}`, `{b}_pred`" for b in BANDS)
        long = scored.select(F.expr(f"stack({len(BANDS)}, {pairs}) AS (band, y, p)"))
        errors = metrics.rmse_by(long, "band").unionByName(metrics.rmse_overall(long).select(F.lit("overall").alias("band"), "rmse"))
        found = errors.collect()  # a row per band
        return fitted, errors.sparkSession.createDataFrame(found, errors.schema)
    finally:
        rows.unpersist()


def fill_gaps(fitted: model.RbfModel, calendar: DataFrame, observed: DataFrame, climate: DataFrame, static: DataFrame) -> DataFrame:
    """Predicted bands and indices of every pixel of the months that lack observations and have climate."""
    months = coverage.uncovered(calendar, observed, climate.select("year", "month").distinct())
    pixels = climate.select("year", "month", "row", "col").join(F.broadcast(months), ["year", "month"], "left_semi")
    matrix = features.feature_matrix(pixels, static, months, climate)
    predicted = model.predict(matrix, fitted, ("year", "month", "row", "col"))
    return spectral_indices(predicted).withColumn("source", F.lit("interpolated"))


def reference_compare(filled: DataFrame, reference: DataFrame, value: str = "ndvi") -> DataFrame:
    """Per month the mean of the filled and of the reference values and their difference; NaN is left out, an absent reference is NULL."""

    def mean(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("year", "month").agg(F.avg(F.when(finite(F.col(value)), F.col(value))).alias(name))

    joined = mean(filled, "predicted").join(mean(reference, "reference"), ["year", "month"], "left")
    return joined.withColumn("difference", F.abs(F.col("predicted") - F.col("reference")))
