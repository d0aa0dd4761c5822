"""Scene tables: missions, quality masks, rescaling and band names in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.expressions import BAND_MAP, FAMILY, clear, masked, rescaled


def mission_scenes(scenes: DataFrame, mission: str, level: str = "L2") -> DataFrame:
    """The scenes of a mission; an unknown name stands for the newest one."""
    known = mission if mission in FAMILY else "l9"
    return scenes.where((F.col("mission") == known) & (F.col("level") == level))


def mask_quality(scenes: DataFrame, *values: str, qa: str = "qa", saturation: str | None = None) -> DataFrame:
    """Values under a cloud bit, or saturated, become NULL; rows stay."""
    keep = clear(F.col(qa), F.col(saturation) if saturation else None)
    return scenes.withColumns({v: masked(F.col(v), keep) for v in values})


def band_table(spark: SparkSession) -> DataFrame:
    """(mission, src, band): the common name of each mission's bands."""
    rows = [(m, src, band) for m, family in FAMILY.items() for src, band in BAND_MAP[family].items()]
    return spark.createDataFrame(rows, "mission string, src string, band string")


def rename_bands(long: DataFrame) -> DataFrame:
    """Long pixels (mission, src, value) with the common band name; bands without one drop out."""
    return long.join(F.broadcast(band_table(long.sparkSession)), ["mission", "src"])


def scale_bands(long: DataFrame) -> DataFrame:
    return long.withColumn("value", rescaled(F.col("src"), F.col("value")))


def prepare(long: DataFrame, qa: str = "qa") -> DataFrame:
    """Mask, then rescale, then rename."""
    return rename_bands(scale_bands(mask_quality(long, "value", qa=qa)))


# The gap months of 1995 to 2024.
GAP_MONTHS = {
    1995: (6, 9, 10, 11, 12), 1996: (1, 2, 3, 4, 5, 6, 7, 9, 11), 1997: (1, 2, 3, 4, 6, 8, 9, 11, 12),
    1998: (1, 2, 3, 4, 5, 7, 8, 10, 11, 12), 1999: (1, 2, 3, 6, 7, 11, 12), 2000: (11,), 2001: (1, 11, 12), 2003: (6, 9, 11),
    2005: (4,), 2006: (3, 12), 2007: (6, 11), 2008: (7,), 2009: (5,), 2010: (6, 11), 2011: (5, 6, 11), 2012: (8,), 2016: (4,), 2019: (12,), 2024: (7,),
}


def known_gaps() -> list[tuple[int, int]]:
    return [(y, m) for y, months in GAP_MONTHS.items() for m in months]


def constant_months(spark: SparkSession, months: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(months, "year int, month int")
