"""Month calendars, scene counts, gaps and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.expressions import date_label, gap_entry, presence_status

MISSIONS = ("l5", "l7", "l8", "l9")
LEVELS = ("L2", "L1")
MONTHS = list(range(1, 13))
# Mission priority by era (first year, last year, missions from best to last).
PRIORITY = (
    (0, 1998, ("l5", "l7")),
    (1999, 2012, ("l7", "l5")),
    (2013, 2021, ("l8", "l7")),
    (2022, 9999, ("l9", "l8", "l7")),
)


def calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(year, month) for all months of an inclusive range of years."""
    months = spark.range(max(0, last - first + 1) * 12)
    return months.select((F.lit(first) + F.floor(F.col("id") / 12)).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))


def between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows with start <= ts < end; a range on the raw column, which reaches the scan."""
    return df.where((F.col(ts) >= F.to_timestamp_ntz(F.lit(start))) & (F.col(ts) < F.to_timestamp_ntz(F.lit(end))))


def with_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def below_cloud(df: DataFrame, limit: float = 20.0, cover: str = "cloud_cover") -> DataFrame:
    return df.where(F.col(cover) < F.lit(limit))


def scene_counts(scenes: DataFrame, months: DataFrame) -> DataFrame:
    """Scenes per mission and level for every month of the calendar, with totals, label and level difference.

    ``scenes`` has (mission, level, year, month); one pre-aggregated pass counts all cells.
    Months without scenes have zeros.
    """
    cells = {f"{m}_{lv}": F.count_if((F.col("mission") == m) & (F.col("level") == lv)) for lv in LEVELS for m in MISSIONS}
    counted = scenes.groupBy("year", "month").agg(*(c.alias(k) for k, c in cells.items()))
    filled = months.join(counted, ["year", "month"], "left").fillna(0, list(cells))
    totals = {f"total_{lv}": sum((F.col(f"{m}_{lv}") for m in MISSIONS[1:]), F.col(f"{MISSIONS[0]}_{lv}")) for lv in LEVELS}
    filled = filled.withColumns(totals)
    return filled.withColumns({"date_label": date_label(F.col("year"), F.col("month")), "l1_minus_l2": F.col("total_L1") - F.col("total_L2")})


def gap_months(counts: DataFrame, total: str = "total_L2") -> DataFrame:
    """Months without a scene, in order."""
    return counts.where(F.col(total) == 0).select("year", "month").orderBy("year", "month")


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count("*").alias("gaps"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def flags(counts: DataFrame) -> DataFrame:
    """Adds has_images, l1_only_gap and status."""
    return counts.withColumns(
        {
            "has_images": (F.col("total_L2") > 0).cast("long"),
            "l1_only_gap": ((F.col("total_L1") > 0) & (F.col("total_L2") == 0)).cast("long"),
            "status": presence_status(F.col("total_L2")),
        }
    )


def month_pivot(counts: DataFrame, value: str | Column, prefix: str = "m") -> DataFrame:
    """One row per year, one column per month; two rows for a cell are an error, absent cells are NULL."""
    value = F.col(value) if isinstance(value, str) else value
    cell = counts.groupBy("year", "month").agg(F.first(value).alias("v"), F.count("*").alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.lit("a month occurs twice"))).otherwise(F.col("v"))
    wide = cell.withColumn("v", checked).groupBy("year").pivot("month", MONTHS).agg(F.first("v"))
    return wide.select("year", *(F.col(str(m)).alias(f"{prefix}{m:02d}") for m in MONTHS))


def status_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("status").count().orderBy(F.desc("count"), "status")


def gap_literal(gaps: DataFrame) -> DataFrame:
    """All gaps as the text of a script's list, in order; one row (the calendar bounds its size)."""
    entries = F.array_sort(F.collect_list(F.struct("year", "month")))
    lines = F.transform(entries, lambda g: gap_entry(g["year"], g["month"]))
    return gaps.agg(F.array_join(lines, ",\n").alias("literal"))


def gap_script(gaps: DataFrame, name: str = "gapMonths") -> DataFrame:
    """All gaps as the script's whole statement, ready to be pasted; one row."""
    head, tail = F.lit(f"var {name} = [\n"), F.lit("\n];")
    return gap_literal(gaps).select(F.concat(head, "literal", tail).alias("script"))


def priority_table(spark: SparkSession) -> DataFrame:
    """(first, last, mission, rank): which missions serve an era, best first."""
    rows = [(lo, hi, m, r) for lo, hi, ms in PRIORITY for r, m in enumerate(ms)]
    return spark.createDataFrame(rows, "first int, last int, mission string, rank int")


def mission_counts(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("year", "month", "mission").agg(F.count("*").alias("scenes"))


def best_mission(months: DataFrame, counts: DataFrame) -> DataFrame:
    """Per month the first mission of its era's priority list that has scenes; months without are left out."""
    listed = months.join(F.broadcast(priority_table(months.sparkSession)), (F.col("year") >= F.col("first")) & (F.col("year") <= F.col("last")))
    found = listed.join(counts.where("scenes > 0"), ["year", "month", "mission"])
    return found.groupBy("year", "month").agg(F.min_by("mission", "rank").alias("mission"), F.min_by("scenes", "rank").alias("scenes"))


def covered(months: DataFrame, *tables: DataFrame) -> DataFrame:
    """Months that all tables have."""
    for t in tables:
        months = months.join(t.select("year", "month"), ["year", "month"], "left_semi")
    return months


def uncovered(months: DataFrame, observed: DataFrame, *needed: DataFrame) -> DataFrame:
    """Months that ``observed`` lacks and all of ``needed`` have."""
    return covered(months.join(observed.select("year", "month"), ["year", "month"], "left_anti"), *needed)


def first_in_month(df: DataFrame, value: str, order: list[str], keys: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """The value of the earliest row of each month; ``order`` must tell rows apart."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def median_composite(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The exact median of the unmasked values per key; NaN counts as masked."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.median(F.when(~F.isnan(v), v)).alias(value))


def in_area(df: DataFrame, area: DataFrame, key: str) -> DataFrame:
    """Rows whose key the area has."""
    return df.join(area.select(key), key, "left_semi")
