"""Plain tables: count tables as CSV, partitioned Parquet of pixels, text literals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.coverage import MISSIONS, gap_literal, gap_script

COUNT_COLUMNS = ["year", "month", "date_label", *(f"{m}_L2" for m in MISSIONS), "total_L2", *(f"{m}_L1" for m in MISSIONS), "total_L1", "l1_minus_l2"]
COUNT_SCHEMA = ", ".join(f"{c} {'string' if c == 'date_label' else 'int' if c in ('year', 'month') else 'long'}" for c in COUNT_COLUMNS)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a temporary one only for a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lacuna-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_counts(counts: DataFrame, path: str) -> None:
    """The monthly count table as CSV with a header, columns in fixed order."""
    counts.select(*COUNT_COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The same, with a declared schema."""
    return spark.read.csv(path, header=True, schema=COUNT_SCHEMA)


def write_pixels(pixels: DataFrame, path: str, source: str, *values: str) -> None:
    """Pixels as Parquet by month, values as floats, marked as observed or interpolated.

    Rows are spread by month and a hash of the row index, so a month is a few files and no
    task holds more than a part of one.
    """
    out = pixels.withColumns({c: F.col(c).cast("float") for c in values}).withColumn("source", F.lit(source))
    spread = F.pmod(F.xxhash64("row"), F.lit(16))
    out.repartition("year", "month", spread).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_gap_literal(gaps: DataFrame, path: str) -> None:
    gap_literal(gaps).coalesce(1).write.mode("overwrite").text(path)


def write_gap_script(gaps: DataFrame, path: str) -> None:
    """The whole statement, list and all."""
    gap_script(gaps).coalesce(1).write.mode("overwrite").text(path)
