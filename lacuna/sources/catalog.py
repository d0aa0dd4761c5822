"""A catalog of monthly files, parsed from their names.

Presence and completeness are decided on names alone; no pixel is read to learn that a month exists.
"""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.expressions import BANDS

# How each kind of file is named.
PATTERNS = {
    "landsat": r"^([a-z0-9]+)_(\d{4})_(\d{2})_(.+)\.tif$",
    "era5": r"^era5_(precip|temp)_(\d{4})_(\d{2})\.tif$",
    "avhrr": r"^avhrr_(ndvi)_(\d{4})_(\d{2})\.tif$",
}
DEFAULTS = {
    "bands": list(BANDS),
    "train_years": [2000, 2025],
    "gap_years": [1995, 1999],
    "num_centers": 50,
    "lambda_reg": 1e-3,
    "val_ratio": 0.22,
    "max_pixels_per_month": 50_000,
    "seed": 42,
}


# Where nested configuration files keep these settings.
NESTED = {
    ("landsat", "bands"): "bands",
    ("landsat", "training_years"): "train_years",
    ("landsat", "gap_years"): "gap_years",
    ("model", "rbfn", "num_centers"): "num_centers",
    ("model", "rbfn", "gamma"): "gamma",
    ("model", "rbfn", "regularization_lambda"): "lambda_reg",
    ("model", "rbfn", "validation_holdout_ratio"): "val_ratio",
    ("model", "rbfn", "pixels_per_month"): "max_pixels_per_month",
}


def load_config(path: str | None = None) -> dict:
    """The defaults, overlaid with a YAML file's top-level values and those of nested sections.

    Band names come in lower case. Nested settings beyond the known ones are kept under ``sections``.
    """
    found = yaml.safe_load(Path(path).read_text()) or {} if path else {}
    if not isinstance(found, dict):
        raise ValueError("the configuration must be a mapping")
    settings = DEFAULTS | {k: v for k, v in found.items() if not isinstance(v, dict)}
    for place, name in NESTED.items():
        value = found
        for step in place:
            value = value.get(step) if isinstance(value, dict) else None
        if value is not None:
            settings[name] = value
    settings["bands"] = [str(b).lower() for b in settings["bands"]]
    return settings | {"sections": {k: v for k, v in found.items() if isinstance(v, dict)}}


def parse(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, kind, band, year, month, mission) of the paths whose file name fits a pattern.

    The more special names come first, so that a climate file isn't taken for a band's.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    kind = F.coalesce(*(F.when(name.rlike(PATTERNS[k]), F.lit(k)) for k in ("era5", "avhrr", "landsat")))

    def part(i: int):
        out = None
        for k, p in PATTERNS.items():
            groups = 4 if k == "landsat" else 3
            value = F.regexp_extract(name, p, i) if i <= groups else F.lit(None).cast("string")
            out = F.when(F.col("kind") == k, value) if out is None else out.when(F.col("kind") == k, value)
        return out

    rows = paths.select(F.col(path).alias("path")).withColumn("kind", kind).where("kind IS NOT NULL")
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return rows.select("path", "kind", part(1).alias("band"), part(2).cast("int").alias("year"), part(3).cast("int").alias("month"), part(4).alias("mission"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of all files below a folder; lists names, reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(root)
    return parse(files.select("path"))


def first_file(catalog: DataFrame) -> DataFrame:
    """Per kind, band and month the first path in lexicographic order, with its mission."""
    return catalog.groupBy("kind", F.lower("band").alias("band"), "year", "month").agg(F.min("path").alias("path"), F.min_by("mission", "path").alias("mission"))


def find(catalog: DataFrame, kind: str, band: str, year: int, month: int) -> str | None:
    """The path of one band and month, or None."""
    wanted = catalog.where((F.col("kind") == kind) & (F.col("band") == band.lower()) & (F.col("year") == year) & (F.col("month") == month))
    return wanted.agg(F.min("path")).first()[0]


def complete_months(catalog: DataFrame, kind: str, names: tuple[str, ...]) -> DataFrame:
    """Months that have a file of each name."""
    some = catalog.where((F.col("kind") == kind) & F.col("band").isin(*names))
    return some.groupBy("year", "month").agg(F.count_distinct("band").alias("n")).where(F.col("n") == len(names)).select("year", "month")
