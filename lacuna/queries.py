"""The registered queries of the gap-filling engine over the stand-in tables, and their SQL.

A scene is a line item: shipping date, mission by supplier, level by line status, cloud
cover by discount, quality bits by quantity, raw value by price. A raster is an embedding of
64 values, 8 by 8. Climate is orders, by month and a cell made of two keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import expressions as X
from lacuna.functions import metrics
from lacuna.operators import coverage, features, grid, model
from lacuna.plans import gapfill
from lacuna.sources import catalog as files
from lacuna.sources import scenes as sc
from lacuna.sources import raster, tables
from lacuna.sources.tables import COUNT_COLUMNS, read

FIRST, LAST = 1995, 2002
SIDE = 8
GAPS = [(1996, 3), (1996, 4), (1998, 12)]
Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, longs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a function under its own name, with its SQL; ``longs`` are columns the SQL has as narrower integers."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, folder: _plain(f(spark, folder))
        if sql:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in longs)
            _sql[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if longs else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as longs and floats as doubles, as the SQL has them."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.withColumns({c: F.col(c).cast(kinds[t]) for c, t in df.dtypes if t in kinds}) if any(t in kinds for _, t in df.dtypes) else df


def _r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without the sign of zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "lineitem")
    mission = F.element_at(F.array(*map(F.lit, coverage.MISSIONS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return coverage.with_month(t, "l_shipdate").withColumns(
        {
            "acq_ts": F.col("l_shipdate"),
            "mission": mission,
            "level": F.when(F.col("l_linestatus") == "O", "L2").otherwise("L1"),
            "cloud_cover": F.col("l_discount") * 400,
            "qa": F.col("l_quantity").cast("bigint"),
            "value": F.col("l_extendedprice"),
            "src": F.when(F.col("l_linenumber") == 7, "ST_B10").when(F.col("l_linenumber") == 6, "ST_B6").otherwise(F.concat(F.lit("SR_B"), F.col("l_linenumber").cast("string"))),
            "band": F.element_at(F.array(*map(F.lit, X.BANDS)), F.col("l_linenumber")),
        }
    )


BANDS_SQL = "[" + ", ".join(f"'{b}'" for b in X.BANDS) + "]"
SCENES = f"""scenes AS (
  SELECT *, year(l_shipdate) AS year, month(l_shipdate) AS month, l_shipdate AS acq_ts,
    ['l5', 'l7', 'l8', 'l9'][l_suppkey % 4 + 1] AS mission, CASE WHEN l_linestatus = 'O' THEN 'L2' ELSE 'L1' END AS level,
    l_discount * 400 AS cloud_cover, CAST(l_quantity AS BIGINT) AS qa, l_extendedprice AS value,
    CASE l_linenumber WHEN 7 THEN 'ST_B10' WHEN 6 THEN 'ST_B6' ELSE 'SR_B' || l_linenumber END AS src,
    {BANDS_SQL}[l_linenumber] AS band
  FROM lineitem
)"""
CALENDAR = f"calendar AS (SELECT y AS year, m AS month FROM range({FIRST}, {LAST + 1}) a(y), range(1, 13) b(m))"
_cells = ", ".join(f"count(*) FILTER (mission = '{m}' AND level = '{lv}') AS {m}_{lv}" for lv in coverage.LEVELS for m in coverage.MISSIONS)
_filled = ", ".join(f"coalesce({m}_{lv}, 0) AS {m}_{lv}" for lv in coverage.LEVELS for m in coverage.MISSIONS)
COUNTS = f"""{SCENES}, {CALENDAR}, cells AS (SELECT year, month, {_cells} FROM scenes WHERE cloud_cover < 20 GROUP BY 1, 2),
filled AS (SELECT c.year, c.month, {_filled} FROM calendar c LEFT JOIN cells s ON c.year = s.year AND c.month = s.month),
counts AS (
  SELECT *, l5_L2 + l7_L2 + l8_L2 + l9_L2 AS total_L2, l5_L1 + l7_L1 + l8_L1 + l9_L1 AS total_L1, printf('%d-%02d', year, month) AS date_label,
    l5_L1 + l7_L1 + l8_L1 + l9_L1 - (l5_L2 + l7_L2 + l8_L2 + l9_L2) AS l1_minus_l2 FROM filled
)"""


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    some = coverage.between(scenes(spark, folder), "l_shipdate", f"{FIRST}-01-01", f"{LAST + 1}-01-01")
    return coverage.scene_counts(coverage.below_cloud(some), coverage.calendar(spark, FIRST, LAST))


@query(f"WITH {COUNTS} SELECT {', '.join(COUNT_COLUMNS)} FROM counts")
def coverage_counts(spark, folder):
    return _counts(spark, folder).select(*COUNT_COLUMNS)


@query(f"WITH {COUNTS} SELECT year, month FROM counts WHERE total_L2 = 0")
def gap_months(spark, folder):
    return coverage.gap_months(_counts(spark, folder))


@query(f"WITH {COUNTS} SELECT count(*) AS gaps, min(year) AS first_year, max(year) AS last_year FROM counts WHERE total_L2 = 0")
def gap_summary(spark, folder):
    return coverage.gap_summary(coverage.gap_months(_counts(spark, folder)))


def _pivot_sql(value: str) -> str:
    months = ", ".join(f"CAST(max(CASE WHEN month = {m} THEN {value} END) AS BIGINT) AS m{m:02d}" for m in coverage.MONTHS)
    return f"WITH {COUNTS} SELECT year, {months} FROM counts GROUP BY year"


@query(_pivot_sql("CASE WHEN total_L2 > 0 THEN 1 ELSE 0 END"))
def presence_pivot(spark, folder):
    return coverage.month_pivot(coverage.flags(_counts(spark, folder)), "has_images")


@query(_pivot_sql("nullif(total_L2, 0)"))
def counts_pivot(spark, folder):
    return coverage.month_pivot(_counts(spark, folder), F.nullif(F.col("total_L2"), F.lit(0)))


@query(_pivot_sql("CASE WHEN total_L1 > 0 AND total_L2 = 0 THEN 1 ELSE 0 END"))
def l1_only_pivot(spark, folder):
    return coverage.month_pivot(coverage.flags(_counts(spark, folder)), "l1_only_gap")


@query(f"WITH {COUNTS} SELECT CASE WHEN total_L2 > 0 THEN 'With Images' ELSE 'No Images' END AS status, count(*) AS count FROM counts GROUP BY 1")
def status_counts(spark, folder):
    return coverage.status_counts(coverage.flags(_counts(spark, folder)))


@query(f"WITH {COUNTS} SELECT coalesce(string_agg('  {{y: ' || year || ', m: ' || month || '}}', ',' || chr(10) ORDER BY year, month), '') AS literal FROM counts WHERE total_L2 = 0")
def gap_literal(spark, folder):
    return coverage.gap_literal(coverage.gap_months(_counts(spark, folder)))


@query(f"WITH {COUNTS} SELECT 'var gapMonths = [' || chr(10) || coalesce(string_agg('  {{y: ' || year || ', m: ' || month || '}}', ',' || chr(10) ORDER BY year, month), '') || chr(10) || '];' AS script FROM counts WHERE total_L2 = 0")
def gap_script(spark, folder):
    return coverage.gap_script(coverage.gap_months(_counts(spark, folder)))


@query(f"WITH {COUNTS} SELECT {', '.join(COUNT_COLUMNS)} FROM counts")
def counts_csv(spark, folder):
    path = tables.scratch(spark, "counts")
    tables.write_counts(_counts(spark, folder), path)
    return tables.read_counts(spark, path)


@query(f"WITH {SCENES} SELECT year, month, count(*) AS n, round(sum(value), 2) AS value FROM scenes GROUP BY 1, 2")
def pixels_parquet(spark, folder):
    """Scenes written as Parquet by month, values as floats, and read back; prices have two digits, so floats hold them to a cent."""
    path = tables.scratch(spark, "pixels")
    rows = scenes(spark, folder).select("year", "month", F.col("l_orderkey").alias("row"), "value")
    tables.write_pixels(rows, path, "observed", "value")
    back = tables.read_pixels(spark, path).where("source = 'observed'")
    return back.groupBy("year", "month").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value").cast("double"), 2)), 2).alias("value"))


_known = ", ".join(f"({y}, {m})" for y, m in sc.known_gaps())


@query(f"WITH {SCENES}, gaps(year, month) AS (VALUES {_known}) SELECT g.year, g.month, count(s.l_orderkey) AS scenes FROM gaps g LEFT JOIN scenes s ON g.year = s.year AND g.month = s.month GROUP BY 1, 2")
def known_gap_scenes(spark, folder):
    counted = scenes(spark, folder).groupBy("year", "month").agg(F.count("*").alias("scenes"))
    return sc.constant_months(spark, sc.known_gaps()).join(counted, ["year", "month"], "left").fillna(0, ["scenes"])


@query(f"SELECT y AS year, coalesce(min_by(mission, rank), '') AS mission FROM range(1980, 2030) a(y) JOIN (VALUES {', '.join(f'({lo}, {hi}, {chr(39)}{m}{chr(39)}, {r})' for lo, hi, ms in coverage.PRIORITY for r, m in enumerate(ms))}) e(first, last, mission, rank) ON y BETWEEN first AND last WHERE mission <> 'l5' GROUP BY 1")
def eras(spark, folder):
    """The best mission of every era when all but one have scenes."""
    months = coverage.calendar(spark, 1980, 2029).where("month = 1")
    some = months.crossJoin(F.broadcast(coverage.priority_table(spark).select("mission").distinct())).where("mission <> 'l5'").withColumn("scenes", F.lit(1))
    return coverage.best_mission(months, some).select("year", "mission")


@query(f"WITH {SCENES} SELECT l_orderkey, l_linenumber, CASE WHEN (qa & 24) = 0 AND l_partkey % 3 = 0 THEN value END AS value FROM scenes", longs=("l_linenumber",))
def saturation_mask(spark, folder):
    rows = scenes(spark, folder).withColumn("radsat", F.col("l_partkey") % 3)
    return sc.mask_quality(rows, "value", saturation="radsat").select("l_orderkey", "l_linenumber", "value")


# Catalog and month joins

NAMES = f"{SCENES}, names AS (SELECT DISTINCT 'data/landsat/' || band || '_' || year || '_' || lpad(CAST(month AS VARCHAR), 2, '0') || '_' || mission || '.tif' AS path, band, year, month, mission FROM scenes WHERE cloud_cover < 4)"


def _paths(spark, folder) -> DataFrame:
    named = coverage.below_cloud(scenes(spark, folder), 4.0).select("band", "year", "month", "mission").distinct()
    stem = X.file_stem(F.upper("band"), F.col("year"), X.padded_month(F.col("month")), F.col("mission"))
    return named.select(F.concat(F.lit("data/landsat/"), stem, F.lit(".tif")).alias("path"))


@query(f"WITH {NAMES} SELECT path FROM names")
def file_names(spark, folder):
    return _paths(spark, folder)


@query(f"WITH {NAMES} SELECT 'landsat' AS kind, band, year, month, min(path) AS path, min_by(mission, path) AS mission FROM names GROUP BY band, year, month")
def catalog_first_file(spark, folder):
    return files.first_file(files.parse(_paths(spark, folder)))


COMPLETE = f"{NAMES}, complete AS (SELECT year, month FROM names GROUP BY 1, 2 HAVING count(DISTINCT band) = 7)"


@query(f"WITH {COMPLETE} SELECT year, month FROM complete")
def complete_months(spark, folder):
    return files.complete_months(files.parse(_paths(spark, folder)), "landsat", X.BANDS)


@query("SELECT 'era5' AS kind, 'precip' AS band, year(o_orderdate) AS year, month(o_orderdate) AS month, 'data/era5/precip/era5_precip_' || strftime(min(o_orderdate), '%Y_%m') || '.tif' AS path FROM orders WHERE o_orderstatus = 'F' GROUP BY 3, 4 UNION ALL SELECT 'avhrr', 'ndvi', year(o_orderdate), month(o_orderdate), 'data/avhrr/avhrr_ndvi_' || strftime(min(o_orderdate), '%Y_%m') || '.tif' FROM orders WHERE o_orderstatus = 'O' GROUP BY 3, 4")
def climate_files(spark, folder):
    """Exact names of climate and reference files, parsed; others are passed over."""
    def names(status: str, *start: str) -> DataFrame:
        months = _climate_months(spark, folder, status)
        stem = X.file_stem(F.lit(start[1]), F.col("year"), X.padded_month(F.col("month")))
        return months.select(F.concat(F.lit(start[0]), stem, F.lit(".tif")).alias("path"))

    paths = names("F", "data/era5/precip/", "era5_precip").unionByName(names("O", "data/avhrr/", "avhrr_ndvi"))
    odd = spark.createDataFrame([("data/era5/precip/era5_snow_1995_01.tif.aux",), ("notes.txt",)], "path string")
    return files.first_file(files.parse(paths.unionByName(odd))).drop("mission")


def _climate_months(spark, folder, status: str) -> DataFrame:
    t = read(spark, folder, "orders").where(F.col("o_orderstatus") == status)
    return coverage.with_month(t, "o_orderdate").select("year", "month").distinct()


CLIMATE_MONTHS = "SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders WHERE o_orderstatus = 'F'"


@query(f"WITH {COMPLETE}, {CALENDAR} SELECT year, month FROM calendar SEMI JOIN complete USING (year, month) SEMI JOIN ({CLIMATE_MONTHS}) USING (year, month)")
def train_months(spark, folder):
    return coverage.covered(coverage.calendar(spark, FIRST, LAST), complete_months(spark, folder), _climate_months(spark, folder, "F"))


@query(f"WITH {COMPLETE}, {CALENDAR} SELECT year, month FROM calendar ANTI JOIN complete USING (year, month) SEMI JOIN ({CLIMATE_MONTHS}) USING (year, month)")
def fill_months(spark, folder):
    return coverage.uncovered(coverage.calendar(spark, FIRST, LAST), complete_months(spark, folder), _climate_months(spark, folder, "F"))


@query(
    f"WITH {CALENDAR}, cells AS (SELECT c_custkey, year, month FROM customer, calendar WHERE year <= 2001) SELECT * FROM cells ANTI JOIN (SELECT o_custkey AS c_custkey, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders) o USING (c_custkey, year, month)"
)
def customer_gap_cells(spark, folder):
    cells = read(spark, folder, "customer").select("c_custkey").crossJoin(F.broadcast(coverage.calendar(spark, FIRST, 2001)))
    seen = coverage.with_month(read(spark, folder, "orders"), "o_orderdate").select(F.col("o_custkey").alias("c_custkey"), "year", "month")
    return cells.join(seen, ["c_custkey", "year", "month"], "left_anti")


# Scene preparation


@query(f"WITH {SCENES} SELECT l_orderkey, l_linenumber, mission, CASE WHEN (qa & 24) = 0 THEN value END AS value FROM scenes", longs=("l_linenumber",))
def qa_mask(spark, folder):
    return sc.mask_quality(scenes(spark, folder), "value").select("l_orderkey", "l_linenumber", "mission", "value")


SCALED = "CASE WHEN src LIKE 'SR_B%' THEN value * 0.0000275::DOUBLE + -0.2::DOUBLE WHEN src LIKE 'ST_B%' THEN value * 0.00341802::DOUBLE + 149.0::DOUBLE ELSE value END"


@query(f"WITH {SCENES} SELECT l_orderkey, l_linenumber, src, round({SCALED}, 9) + 0.0 AS value FROM scenes", longs=("l_linenumber",))
def scale_bands(spark, folder):
    return sc.scale_bands(scenes(spark, folder)).select("l_orderkey", "l_linenumber", "src", _r("value", 9).alias("value"))


_band_rows = ", ".join(f"('{m}', '{s}', '{b}')" for m, f in X.FAMILY.items() for s, b in X.BAND_MAP[f].items())
BAND_TABLE = f"band_table(mission, src, name) AS (VALUES {_band_rows})"


@query(f"WITH {SCENES}, {BAND_TABLE} SELECT s.mission, s.src, b.name AS band, count(*) AS n FROM scenes s JOIN band_table b ON s.mission = b.mission AND s.src = b.src GROUP BY 1, 2, 3")
def band_rename(spark, folder):
    return sc.rename_bands(scenes(spark, folder).drop("band")).groupBy("mission", "src", "band").agg(F.count("*").alias("n"))


@query(
    f"WITH {SCENES}, {BAND_TABLE} SELECT s.mission, b.name AS band, s.year, count(*) AS n, count(CASE WHEN (qa & 24) = 0 THEN 1 END) AS clear, round(avg(CASE WHEN (qa & 24) = 0 THEN {SCALED.replace('src', 's.src')} END), 6) + 0.0 AS value FROM scenes s JOIN band_table b ON s.mission = b.mission AND s.src = b.src GROUP BY 1, 2, 3"
)
def prepared_scenes(spark, folder):
    done = sc.prepare(scenes(spark, folder).drop("band"))
    return done.groupBy("mission", "band", "year").agg(F.count("*").alias("n"), F.count("value").alias("clear"), _r(F.avg("value")).alias("value"))


USABLE = f"{SCENES}, found AS (SELECT year, month, mission, count(*) AS scenes FROM scenes WHERE cloud_cover < 4 AND level = 'L2' GROUP BY 1, 2, 3)"


def _mission_counts(spark, folder) -> DataFrame:
    return coverage.mission_counts(coverage.below_cloud(scenes(spark, folder), 4.0).where("level = 'L2'"))


@query(f"WITH {USABLE} SELECT * FROM found")
def mission_counts(spark, folder):
    return _mission_counts(spark, folder)


_priority = ", ".join(f"({lo}, {hi}, '{m}', {r})" for lo, hi, ms in coverage.PRIORITY for r, m in enumerate(ms))


@query(
    f"WITH {USABLE}, {CALENDAR}, era(first, last, mission, rank) AS (VALUES {_priority}) SELECT c.year, c.month, min_by(f.mission, rank) AS mission, min_by(f.scenes, rank) AS scenes FROM calendar c JOIN era ON c.year BETWEEN first AND last JOIN found f ON f.year = c.year AND f.month = c.month AND f.mission = era.mission GROUP BY 1, 2"
)
def mission_priority(spark, folder):
    return coverage.best_mission(coverage.calendar(spark, FIRST, LAST), _mission_counts(spark, folder))


@query(f"WITH {SCENES} SELECT count(*) AS n, round(sum(value), 2) AS value FROM scenes WHERE level = 'L2' AND mission = 'l9'")
def mission_dispatch(spark, folder):
    return sc.mission_scenes(scenes(spark, folder), "landsat-next").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(f"WITH {SCENES} SELECT year, month, src, round(median(CASE WHEN (qa & 24) = 0 THEN value END), 6) + 0.0 AS value FROM scenes GROUP BY 1, 2, 3")
def median_composite(spark, folder):
    done = coverage.median_composite(sc.mask_quality(scenes(spark, folder), "value"), "value", "year", "month", "src")
    return done.withColumn("value", _r("value"))


@query(f"WITH {SCENES} SELECT year, month, min_by(value, (acq_ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS value FROM scenes GROUP BY 1, 2")
def first_of_month(spark, folder):
    return coverage.first_in_month(scenes(spark, folder), "value", ["acq_ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(
    f"WITH {SCENES} SELECT mission, month, count(*) AS n FROM scenes WHERE cloud_cover < 20 AND acq_ts >= TIMESTAMP '1997-01-01' AND acq_ts < TIMESTAMP '1998-01-01' AND l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY 1, 2"
)
def aoi_filter(spark, folder):
    region = read(spark, folder, "region").where("r_name = 'ASIA'")
    nations = read(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    area = read(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"))
    inside = coverage.in_area(coverage.between(coverage.below_cloud(scenes(spark, folder)), "acq_ts", "1997-01-01", "1998-01-01"), area, "l_suppkey")
    return inside.groupBy("mission", "month").agg(F.count("*").alias("n"))


CLIMATE = """climate AS (
  SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, CAST(o_custkey % 8 AS INT) AS row, CAST(o_orderkey // 4 % 8 AS INT) AS col,
    avg(o_totalprice / 1000000) * 1000 AS precip, avg(o_totalprice / 1000) - 273.15 AS temp
  FROM orders GROUP BY 1, 2, 3, 4
)"""


def climate(spark, folder) -> DataFrame:
    t = coverage.with_month(read(spark, folder, "orders"), "o_orderdate").withColumns({"row": (F.col("o_custkey") % SIDE).cast("int"), "col": (F.floor(F.col("o_orderkey") / 4) % SIDE).cast("int")})
    cell = t.groupBy("year", "month", "row", "col").agg(F.avg(F.col("o_totalprice") / 1000000).alias("p"), F.avg(F.col("o_totalprice") / 1000).alias("t"))
    return cell.select("year", "month", "row", "col", X.precipitation(F.col("p")).alias("precip"), X.celsius(F.col("t")).alias("temp"))


@query(f"WITH {CLIMATE} SELECT year, month, row, col, round(precip, 9) + 0.0 AS precip, round(temp, 9) + 0.0 AS temp FROM climate", longs=("row", "col"))
def climate_units(spark, folder):
    return climate(spark, folder).withColumns({"precip": _r("precip", 9), "temp": _r("temp", 9)})


_gap_rows = ", ".join(f"({y}, {m})" for y, m in GAPS)


@query(f"WITH {SCENES}, gaps(year, month) AS (VALUES {_gap_rows}) SELECT year, month, round(median(value) * 0.0001, 8) + 0.0 AS ndvi FROM scenes SEMI JOIN gaps USING (year, month) GROUP BY 1, 2")
def gap_reference_composite(spark, folder):
    months = sc.constant_months(spark, GAPS)
    some = scenes(spark, folder).join(F.broadcast(months), ["year", "month"], "left_semi")
    return coverage.median_composite(some, "value", "year", "month").select("year", "month", _r(F.col("value") * X.AVHRR_FACTOR, 8).alias("ndvi"))


# Features


@query(f"WITH {CALENDAR} SELECT year, month, round(sin(2 * pi() * month / 12.0), 9) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12.0), 9) + 0.0 AS month_cos FROM calendar")
def time_features(spark, folder):
    done = features.time_features(coverage.calendar(spark, FIRST, LAST))
    return done.withColumns({"month_sin": _r("month_sin", 9), "month_cos": _r("month_cos", 9)})


GRID = f"grid AS (SELECT r AS row, c AS col FROM range({SIDE}) a(r), range({SIDE}) b(c))"


@query(f"WITH {GRID} SELECT row, col, round(col / 7.0, 9) AS x, round(row / 7.0, 9) AS y FROM grid")
def pixel_coords(spark, folder):
    done = grid.pixel_coords(grid.grid(spark, SIDE, SIDE), SIDE, SIDE)
    return done.withColumns({"x": _r("x", 9), "y": _r("y", 9)})


@query(f"WITH {GRID} SELECT row, col, round(-10 + col * 30.0 / 7, 9) + 0.0 AS x, round(2 + row * 3.0 / 7, 9) + 0.0 AS y FROM grid")
def bounds_coords(spark, folder):
    done = grid.bounds_coords(grid.grid(spark, SIDE, SIDE), SIDE, SIDE, (-10.0, 2.0, 20.0, 5.0))
    return done.withColumns({"x": _r("x", 9), "y": _r("y", 9)})


def _long(spark, folder) -> DataFrame:
    return scenes(spark, folder).groupBy("l_orderkey", "band").agg(F.max("value").alias("value"))


_stack = ", ".join(f"max(value) FILTER (band = '{b}') AS {b}" for b in X.BANDS)


@query(f"WITH {SCENES} SELECT l_orderkey, {_stack} FROM scenes GROUP BY 1 HAVING count(DISTINCT band) = 7")
def band_stack(spark, folder):
    return grid.stack_bands(_long(spark, folder), X.BANDS, "l_orderkey")


@query(
    "WITH p AS (SELECT o_custkey, max(o_totalprice) AS precip FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), t AS (SELECT o_custkey, max(o_totalprice) AS temp FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT o_custkey, precip, temp FROM p JOIN t USING (o_custkey)"
)
def climate_stack(spark, folder):
    t = read(spark, folder, "orders")
    one = lambda s: t.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_totalprice").alias("value"))
    return grid.stack_climate(one("F"), one("O"), "o_custkey")


def static_layer(spark, folder) -> DataFrame:
    dem = grid.from_arrays(read(spark, folder, "embeddings").where("vec_id = 0"), "embedding", SIDE)
    return grid.pixel_coords(dem.withColumnRenamed("value", "dem"), SIDE, SIDE)


def pixels(spark, folder) -> DataFrame:
    """Mean bands per month and cell: the observed cube."""
    t = scenes(spark, folder).withColumns({"row": (F.col("l_suppkey") % SIDE).cast("int"), "col": (F.col("l_partkey") % SIDE).cast("int")})
    raw = {"red": F.col("l_discount") * 2, "green": F.col("l_tax"), "blue": F.col("l_tax") / 2, "nir": F.col("l_quantity") / 50, "swir1": F.col("l_discount") + F.col("l_tax"), "swir2": F.col("l_discount"), "thermal": F.col("l_extendedprice") / 100000}
    return t.groupBy("year", "month", "row", "col").agg(*(F.avg(v).alias(k) for k, v in raw.items()))


PIXELS = f"""{SCENES}, pixels AS (
  SELECT year, month, CAST(l_suppkey % 8 AS INT) AS row, CAST(l_partkey % 8 AS INT) AS col, avg(l_discount * 2) AS red, avg(l_tax) AS green, avg(l_tax / 2) AS blue,
    avg(l_quantity / 50) AS nir, avg(l_discount + l_tax) AS swir1, avg(l_discount) AS swir2, avg(l_extendedprice / 100000) AS thermal
  FROM scenes GROUP BY 1, 2, 3, 4
)"""
STATIC = "dem AS (SELECT (i - 1) // 8 AS row, (i - 1) % 8 AS col, CAST(embedding[i] AS DOUBLE) AS dem, ((i - 1) % 8) / 7.0 AS x, ((i - 1) // 8) / 7.0 AS y FROM embeddings, range(1, 65) t(i) WHERE vec_id = 0)"
MATRIX = f"""{PIXELS}, {CLIMATE}, {STATIC}, matrix AS (
  SELECT p.month, p.row, p.col, d.dem, d.x, d.y, sin(2 * pi() * p.month / 12.0) AS month_sin, cos(2 * pi() * p.month / 12.0) AS month_cos, p.year, c.precip, c.temp,
    red, green, blue, nir, swir1, swir2, thermal
  FROM pixels p JOIN climate c ON p.year = c.year AND p.month = c.month AND p.row = c.row AND p.col = c.col JOIN dem d ON d.row = p.row AND d.col = p.col
)"""
_doubles = [*(f for f in X.FEATURES if f != "year"), *X.BANDS]


def matrix(spark, folder) -> DataFrame:
    return features.feature_matrix(pixels(spark, folder), static_layer(spark, folder), coverage.calendar(spark, FIRST, LAST), climate(spark, folder))


@query(f"WITH {MATRIX} SELECT month, row, col, year, {', '.join(f'round({c}, {12 if c in X.BANDS else 9}) + 0.0 AS {c}' for c in _doubles)} FROM matrix", longs=("row", "col"))
def feature_matrix(spark, folder):
    return matrix(spark, folder).withColumns({c: _r(c, 12 if c in X.BANDS else 9) for c in _doubles})


def _spoilt(spark, folder) -> DataFrame:
    n = F.col("l_linenumber")
    v = F.when(n == 1, F.lit(None).cast("double")).when(n == 2, F.lit(float("nan"))).when(n == 3, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / 50000 - 0.2)
    return scenes(spark, folder).withColumn("v", v)


SPOILT = f"{SCENES}, spoilt AS (SELECT *, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 'infinity'::DOUBLE ELSE l_extendedprice / 50000 - 0.2 END AS v FROM scenes)"


@query(f"WITH {SPOILT} SELECT year, month, count(*) AS n, round(sum(v), 4) AS v FROM spoilt WHERE isfinite(v) GROUP BY 1, 2")
def finite_filter(spark, folder):
    return features.drop_invalid(_spoilt(spark, folder), "v", "l_quantity").groupBy("year", "month").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("v"))


@query(f"WITH {SPOILT} SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL OR isnan(v) THEN 'none' ELSE 'some' END AS kind, CASE WHEN v IS NULL OR isnan(v) THEN NULL ELSE round(least(greatest(v, 0), 1), 6) END AS v FROM spoilt", longs=("l_linenumber",))
def clip_reflectance(spark, folder):
    done = features.clip_bands(_spoilt(spark, folder), "v")
    bad = F.col("v").isNull() | F.isnan("v")
    return done.select("l_orderkey", "l_linenumber", F.when(bad, "none").otherwise("some").alias("kind"), F.when(~bad, _r("v")).alias("v"))


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_day"]
DAY = "strftime(l_shipdate, '%Y-%m-%d') AS ship_day"
_key_text = " || '|' || ".join(KEY)


def _keyed(spark, folder) -> DataFrame:
    return scenes(spark, folder).withColumn("ship_day", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query(
    f"WITH {SCENES}, keyed AS (SELECT *, {DAY} FROM scenes) SELECT {', '.join(KEY)} FROM keyed QUALIFY row_number() OVER (PARTITION BY year, month ORDER BY md5({_key_text} || '|42'), {', '.join(KEY)}) <= 50",
    longs=("l_linenumber",),
)
def cap_per_month(spark, folder):
    return features.cap_per_group(_keyed(spark, folder), 50, ["year", "month"], KEY).select(*KEY)


@query(
    f"WITH {SCENES}, keyed AS (SELECT *, {DAY}, row_number() OVER (ORDER BY year(l_shipdate), month(l_shipdate), {', '.join(k if k != 'ship_day' else 'l_shipdate' for k in KEY)}) AS rn, count(*) OVER () AS n FROM scenes) SELECT {', '.join(KEY)}, rn <= floor(n * (1.0::DOUBLE - 0.22::DOUBLE)) AS is_train FROM keyed",
    longs=("l_linenumber",),
)
def temporal_split(spark, folder):
    return features.temporal_split(_keyed(spark, folder), KEY).select(*KEY, "is_train")


@query("SELECT year, month, n, n - lag(n) OVER (ORDER BY year, month) AS step FROM (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2)")
def union_months(spark, folder):
    from pyspark.sql import Window

    t = coverage.with_month(read(spark, folder, "orders"), "o_orderdate")
    whole = grid.union_all(t.where("year <= 1997"), t.where("year > 1997"))
    n = whole.groupBy("year", "month").agg(F.count("*").alias("n"))
    return n.withColumn("step", F.col("n") - F.lag("n").over(Window.orderBy("year", "month")))


SCALED_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_constant")


@query("SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS scale FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM (SELECT *, 5.0::DOUBLE AS l_constant FROM lineitem)" for c in SCALED_COLUMNS) + ")")
def scaler_stats(spark, folder):
    t = read(spark, folder, "lineitem").withColumn("l_constant", F.lit(5.0))
    return features.scaler_stats(t, *SCALED_COLUMNS).select("feature", *(_r(c).alias(c) for c in ("mean", "std", "scale")))


_z = lambda c: f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) + 0.0 AS {c}"


@query(f"SELECT l_orderkey, l_linenumber, {_z('l_quantity')}, {_z('l_discount')} FROM lineitem", longs=("l_linenumber",))
def standardize(spark, folder):
    t = read(spark, folder, "lineitem")
    done = features.standardize(t, features.stats_of(t, "l_quantity", "l_discount"))
    return done.select("l_orderkey", "l_linenumber", _r("l_quantity").alias("l_quantity"), _r("l_discount").alias("l_discount"))


@query(
    f"WITH {SPOILT} SELECT year, month, count(*) AS seen, count(*) FILTER (isfinite(v)) AS clean, least(count(*) FILTER (isfinite(v)), 50) AS kept, round(100.0 * count(*) FILTER (isfinite(v)) / greatest(count(*), 1), 6) AS valid_percent, CASE WHEN count(*) FILTER (isfinite(v)) = 0 THEN 1 ELSE 0 END::BIGINT AS fully_masked FROM spoilt GROUP BY 1, 2"
)
def row_counters(spark, folder):
    done = features.row_counters(_spoilt(spark, folder), "v", cap=50)
    return done.withColumn("valid_percent", _r("valid_percent"))


@query("SELECT vec_id, i - 1 AS position, round(CAST(list_concat(list_concat(embedding[1:3], embedding[5:6]), embedding[9:9])[i] AS DOUBLE), 6) + 0.0 AS value FROM embeddings, range(1, 7) t(i)")
def legacy_concat(spark, folder):
    t = read(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("a"), F.array(F.slice("embedding", 5, 2)).alias("b"), F.slice("embedding", 9, 1).alias("c"))
    done = grid.concat_features(t, "a", "b", "c")
    return done.select("vec_id", F.posexplode("features").alias("position", "value")).withColumn("value", _r(F.col("value").cast("double")))


# Grids

RASTERS = "rasters AS (SELECT vec_id, (i - 1) // 8 AS row, (i - 1) % 8 AS col, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i))"


def rasters(spark, folder) -> DataFrame:
    return grid.from_arrays(read(spark, folder, "embeddings"), "embedding", SIDE, "vec_id")


@query(f"WITH {RASTERS} SELECT vec_id, row * 8 + col AS pixel_id, round(value, 6) + 0.0 AS value FROM rasters")
def flatten_grid(spark, folder):
    return grid.flatten(rasters(spark, folder), SIDE).withColumn("value", _r("value"))


@query(f"WITH {RASTERS} SELECT 'r' || vec_id AS path, 8 AS height, 8 AS width, row, col, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM rasters")
def raster_files(spark, folder):
    """Rasters encoded as files, written, read and decoded."""
    path = tables.scratch(spark, "rasters")
    named = rasters(spark, folder).withColumn("name", F.concat(F.lit("r"), F.col("vec_id").cast("string")))
    raster.write_rasters(named, SIDE, SIDE).write.parquet(path)
    back = raster.decode_rasters(spark.read.parquet(path).withColumnRenamed("name", "path"))
    return back.withColumn("value", _r("value"))


@query("SELECT 'dem' AS path, 8 AS height, 8 AS width, 30.0::DOUBLE AS pixel_x, 30.0::DOUBLE AS pixel_y, 450000.0::DOUBLE AS origin_x, 9990000.0::DOUBLE AS origin_y, 21097 AS epsg")
def raster_header(spark, folder):
    """Shape and georeferencing of the static layer's file, as the filled months' files get them."""
    like = raster.Header(SIDE, SIDE, (30.0, 30.0), (450000.0, 9990000.0), 21097)
    named = static_layer(spark, folder).withColumn("name", F.lit("dem"))
    encoded = raster.write_rasters(named, SIDE, SIDE, value="dem", like=like)
    return raster.read_headers(encoded.withColumnRenamed("name", "path"))


_axis = "SELECT o, CAST(floor(s) AS INT) AS a, least(CAST(floor(s) AS INT) + 1, 7) AS b, s - floor(s) AS w FROM (SELECT o, greatest(least((o + 0.5) * 0.5 - 0.5, 7.0), 0.0) AS s FROM range(16) t(o))"


@query(
    f"WITH {RASTERS}, axis AS ({_axis}), sides AS (SELECT o, a AS i, 1 - w AS w FROM axis UNION ALL SELECT o, b, w FROM axis WHERE w > 0) SELECT vec_id, y.o AS row, x.o AS col, round(sum(value * y.w * x.w) / sum(y.w * x.w), 6) + 0.0 AS value FROM rasters r JOIN sides y ON y.i = r.row JOIN sides x ON x.i = r.col GROUP BY 1, 2, 3"
)
def bilinear_2x(spark, folder):
    return grid.resample(rasters(spark, folder), SIDE, SIDE, 2 * SIDE, 2 * SIDE, "vec_id").withColumn("value", _r("value"))


_mirror = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END"
_window = ", ".join(f"round(CAST(e.embedding[({_mirror(f'g.row + {dr}')}) * 8 + ({_mirror(f'g.col + {dc}')}) + 1] AS DOUBLE), 6) + 0.0 AS w{(dr + 1) * 3 + dc + 1}" for dr in (-1, 0, 1) for dc in (-1, 0, 1))


@query(f"WITH {GRID} SELECT vec_id, row, col, {_window} FROM embeddings e, grid g")
def spatial_windows(spark, folder):
    done = grid.windows(rasters(spark, folder), SIDE, SIDE, 3, "vec_id")
    return done.select("vec_id", "row", "col", *(_r(F.col("window")[i]).alias(f"w{i}") for i in range(9)))


# Model, with the labels' mean embeddings as centres

CENTERS = """long AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)),
center_cells AS (SELECT label AS c, i, avg(v) AS m FROM long GROUP BY 1, 2)"""
GAMMA = 2.0
ACTS = f"""{CENTERS}, acts AS (SELECT l.vec_id, c.c, exp(-{GAMMA} * sum((l.v - c.m) * (l.v - c.m))) AS a FROM long l JOIN center_cells c ON l.i = c.i GROUP BY 1, 2)"""


def centers(spark, folder) -> DataFrame:
    cells = read(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    at = F.array_sort(F.collect_list(F.struct("i", "m")))
    return cells.groupBy("label").agg(F.transform(at, lambda s: s["m"]).alias("center"))


def acts(spark, folder) -> DataFrame:
    """Every vector against the ten centres, which are broadcast."""
    t = read(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return t.crossJoin(F.broadcast(centers(spark, folder))).select("vec_id", "y", F.col("label").alias("c"), model.rbf_expression("x", "center", f"{GAMMA}D").alias("a"))


@query(f"WITH {ACTS} SELECT vec_id, c, round(a, 6) AS a FROM acts", longs=("c",))
def rbf_activation(spark, folder):
    return acts(spark, folder).select("vec_id", "c", _r("a").alias("a"))


@query(f"WITH {CENTERS} SELECT round(1 / (2 * avg(d) * avg(d) + 1e-8), 6) AS gamma FROM (SELECT a.c, b.c, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM center_cells a JOIN center_cells b ON a.i = b.i GROUP BY 1, 2)")
def gamma(spark, folder):
    c = np.array([r.center for r in centers(spark, folder).collect()])
    return spark.createDataFrame([(round(model.width_of(c), 6),)], "gamma double")


def _center_matrix(spark, folder, n: int | None = None) -> np.ndarray:
    return np.array([r.center for r in centers(spark, folder).orderBy("label").collect()][:n])


def _wide(spark, folder) -> tuple[DataFrame, tuple[str, ...]]:
    names = tuple(f"x{i}" for i in range(64))
    t = read(spark, folder, "embeddings")
    return t.select("vec_id", F.col("label").cast("double").alias("y"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names))), names


@query(f"WITH {ACTS} SELECT x.c AS i, y.c AS j, round(sum(x.a * y.a), 6) AS v FROM acts x JOIN acts y ON x.vec_id = y.vec_id GROUP BY 1, 2", longs=("i", "j"))
def gram(spark, folder):
    rows, names = _wide(spark, folder)
    ata, _, _ = model.gram(rows, names, ("y",), _center_matrix(spark, folder), GAMMA)
    return spark.createDataFrame([(i, j, round(float(v), 6)) for (i, j), v in np.ndenumerate(ata)], "i long, j long, v double")


@query(f"WITH {ACTS} SELECT vec_id, round(sum(a * (c + 1) * 0.1), 6) AS p FROM acts GROUP BY 1")
def rbf_forward(spark, folder):
    rows, names = _wide(spark, folder)
    c = _center_matrix(spark, folder)
    held = model.RbfModel(c, GAMMA, (np.arange(len(c))[:, None] + 1) * 0.1, np.zeros(64), np.ones(64), names, ("p",))
    return model.predict(rows, held, ("vec_id",)).withColumn("p", _r("p"))


@query(f"WITH {ACTS} SELECT vec_id, round(sum(a * (c + 1) * 0.1), 6) AS p FROM acts GROUP BY 1")
def saved_model(spark, folder):
    """The same predictions by a model that was saved and loaded."""
    rows, names = _wide(spark, folder)
    c = _center_matrix(spark, folder)
    path = tables.scratch(spark, "model")
    model.RbfModel(c, GAMMA, (np.arange(len(c))[:, None] + 1) * 0.1, np.zeros(64), np.ones(64), names, ("p",)).save(spark, path)
    return model.predict(rows, model.RbfModel.load(spark, path), ("vec_id",)).withColumn("p", _r("p"))


@query(
    f"WITH {CENTERS}, far AS (SELECT l.vec_id, c.c, sum((l.v - c.m) * (l.v - c.m)) AS d FROM long l JOIN center_cells c ON l.i = c.i GROUP BY 1, 2), home AS (SELECT vec_id, min_by(c, d) AS c FROM far GROUP BY 1) SELECT h.c AS center, l.i - 1 AS position, round(avg(l.v), 6) + 0.0 AS value FROM home h JOIN long l ON h.vec_id = l.vec_id GROUP BY 1, 2"
)
def kmeans_step(spark, folder):
    """One step of k-means from the labels' means: each centre moves to the mean of the vectors nearest to it."""
    rows, names = _wide(spark, folder)
    moved = model.fit_many_centers(rows, names, (10,), steps=1, starts={10: [_center_matrix(spark, folder)]})[10]
    cells = [(i, j, float(v)) for (i, j), v in np.ndenumerate(moved)]
    return spark.createDataFrame(cells, "center long, position long, value double").withColumn("value", _r("value"))


_trial = "SELECT {t} AS trial, 2 AS num_centers, {p}::DOUBLE AS lambda_reg, (u * r - v * q) / (p * r - q * q) AS a, (v * p - u * q) / (p * r - q * q) AS b FROM (SELECT sum(a * a) + {p}::DOUBLE AS p, sum(a * b) AS q, sum(b * b) + {p}::DOUBLE AS r, sum(a * label) AS u, sum(b * label) AS v FROM w WHERE vec_id % 4 <> 0)"
_trials = " UNION ALL ".join(_trial.format(t=t, p=p) for t, p in enumerate((0.01, 0.5, 5.0)))


@query(
    f"WITH {ACTS}, w AS (SELECT vec_id, any_value(label) AS label, max(a) FILTER (c = 0) AS a, max(a) FILTER (c = 1) AS b FROM acts JOIN embeddings USING (vec_id) GROUP BY 1), weights AS ({_trials}), scored AS (SELECT trial, num_centers, lambda_reg, sqrt(avg((w.label - w.a * weights.a - w.b * weights.b) ** 2)) AS rmse FROM w, weights WHERE vec_id % 4 = 0 GROUP BY 1, 2, 3) SELECT trial, num_centers, lambda_reg, round(rmse, 5) AS rmse, rmse = (SELECT min(rmse) FROM scored) AS is_best FROM scored"
)
def grid_trials(spark, folder):
    """The grid search's trials over given centres."""
    rows, names = _wide(spark, folder)
    fit, held = rows.where("vec_id % 4 <> 0"), rows.where("vec_id % 4 = 0")
    best, trials = model.grid_search(fit, held, names, ("y",), (2,), (0.01, 0.5, 5.0), centers={2: _center_matrix(spark, folder, 2)}, gamma=GAMMA)
    found = [(t, k, p, round(e, 5), p == best["lambda_reg"]) for t, k, p, e in trials]
    return spark.createDataFrame(found, "trial long, num_centers long, lambda_reg double, rmse double, is_best boolean")


@query(
    f"WITH {ACTS}, w AS (SELECT vec_id, max(a) FILTER (c = 0) AS a, max(a) FILTER (c = 1) AS b FROM acts GROUP BY 1), s AS (SELECT sum(a * a) + 0.5 AS p, sum(a * b) AS q, sum(b * b) + 0.5 AS r, sum(a * label) AS u, sum(b * label) AS v FROM w JOIN embeddings USING (vec_id)) SELECT 0 AS center, round((u * r - v * q) / (p * r - q * q), 5) AS weight FROM s UNION ALL SELECT 1, round((v * p - u * q) / (p * r - q * q), 5) FROM s",
    longs=("center",),
)
def ridge_two(spark, folder):
    rows, names = _wide(spark, folder)
    ata, aty, _ = model.gram(rows, names, ("y",), _center_matrix(spark, folder, 2), GAMMA)
    w = model.ridge(ata, aty, 0.5)
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(w[:, 0])], "center long, weight double")


@query()
def kmeans_fit(spark, folder):
    rows, names = _wide(spark, folder)
    found = model.fit_centers(rows, names, files.load_config()["num_centers"])
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "center long, position array<double>")


def _training(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Standardized rows with is_train, and the kept table they come from."""
    rows = gapfill.training_rows(matrix(spark, folder), ["row", "col"], None).persist()
    split = features.temporal_split(rows, ["row", "col"])
    return features.standardize(split, features.stats_of(split, *X.FEATURES)), rows


@query()
def ridge_fit(spark, folder):
    fitted, errors = gapfill.fit_pipeline(matrix(spark, folder), files.load_config())
    return errors.withColumn("gamma", F.lit(fitted.gamma))


@query()
def grid_search(spark, folder):
    rows, kept = _training(spark, folder)
    best, trials = model.grid_search(rows.where("is_train"), rows.where("NOT is_train"), X.FEATURES, X.BANDS)
    kept.unpersist()
    return spark.createDataFrame(trials, "trial long, num_centers long, lambda_reg double, rmse double").withColumn("is_best", (F.col("num_centers") == best.get("num_centers", -1)) & (F.col("lambda_reg") == best.get("lambda_reg", -1.0)))


_NDVI = "(nir - red) / (nir + red + 1e-6::DOUBLE)"
_BSI = "((swir1 + red) - (nir + blue)) / ((swir1 + red) + (nir + blue) + 1e-6::DOUBLE)"
FILL_WEIGHTS = [[0.1 * (i + 1) * (j + 1) for j in range(7)] for i in range(2)]


def _filled(spark, folder, fitted: model.RbfModel) -> DataFrame:
    observed = pixels(spark, folder).select("year", "month").distinct().where("month <> 7")
    return gapfill.fill_gaps(fitted, coverage.calendar(spark, FIRST, LAST), observed, climate(spark, folder), static_layer(spark, folder))


_act = lambda c: f"exp(-0.001 * ({' + '.join(f'(m.{f} - {c}) * (m.{f} - {c})' for f in X.FEATURES)}))"
_fill = {b: f"0.1 * {j + 1} * a + 0.2 * {j + 1} * b" for j, b in enumerate(X.BANDS)}


@query(
    f"WITH {CLIMATE}, {STATIC}, m AS (SELECT c.month, c.row, c.col, d.dem, d.x, d.y, sin(2 * pi() * c.month / 12.0) AS month_sin, cos(2 * pi() * c.month / 12.0) AS month_cos, (c.year - 1998) / 4.0 AS year, (c.precip - 150) / 100 AS precip, c.temp / 300 AS temp, c.year AS y0 FROM climate c JOIN dem d ON d.row = c.row AND d.col = c.col WHERE c.year BETWEEN {FIRST} AND {LAST} AND c.month = 7), acts AS (SELECT y0 AS year, month, row, col, {_act(0)} AS a, {_act(1)} AS b FROM m), cube AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _fill.items())} FROM acts) SELECT year, month, row, col, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in X.BANDS)}, round({_NDVI}, 6) + 0.0 AS ndvi, round({_BSI}, 6) + 0.0 AS bsi, round(({_NDVI} + (1 - thermal)) / 2, 6) + 0.0 AS vhi, 'interpolated' AS source FROM cube",
    longs=("row", "col"),
)
def fill_known_model(spark, folder):
    """The filled months of a model with given centres and weights."""
    middle = {"year": (1998.0, 4.0), "precip": (150.0, 100.0), "temp": (0.0, 300.0)}
    mean, scale = (np.array([middle.get(f, (0.0, 1.0))[i] for f in X.FEATURES]) for i in (0, 1))
    centers = np.array([[0.0] * len(X.FEATURES), [1.0] * len(X.FEATURES)])
    done = _filled(spark, folder, model.RbfModel(centers, 0.001, np.array(FILL_WEIGHTS), mean, scale, X.FEATURES, X.BANDS))
    return done.withColumns({c: _r(c) for c in (*X.BANDS, "ndvi", "bsi", "vhi")})


@query()
def fill_gaps(spark, folder):
    known = matrix(spark, folder).where("month <> 7")
    fitted, _ = gapfill.fit_pipeline(known, files.load_config())
    return _filled(spark, folder, fitted)


# Evaluation

PAIRS = f"{SCENES}, pairs AS (SELECT *, l_quantity / 50 AS y, l_discount * 10 AS p FROM scenes)"


def pairs(spark, folder) -> DataFrame:
    return scenes(spark, folder).withColumns({"y": F.col("l_quantity") / 50, "p": F.col("l_discount") * 10})


@query(f"WITH {PAIRS} SELECT band, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM pairs GROUP BY 1")
def rmse_band(spark, folder):
    return metrics.rmse_by(pairs(spark, folder), "band").withColumn("rmse", _r("rmse"))


@query(f"WITH {PAIRS} SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM pairs")
def rmse_overall(spark, folder):
    return metrics.rmse_overall(pairs(spark, folder)).withColumn("rmse", _r("rmse"))


@query(f"WITH {PAIRS} SELECT band, round(avg(abs(y - p)), 6) AS mae FROM pairs GROUP BY 1")
def mae_band(spark, folder):
    return metrics.mae_by(pairs(spark, folder), "band").withColumn("mae", _r("mae"))


@query(f"WITH {PAIRS}, m AS (SELECT band, avg(y) AS m FROM pairs GROUP BY 1) SELECT band, round(1 - sum((y - p) * (y - p)) / (sum((y - m) * (y - m)) + 1e-8), 6) AS r2 FROM pairs JOIN m USING (band) GROUP BY 1")
def r2_band(spark, folder):
    return metrics.r2_by(pairs(spark, folder), "band").withColumn("r2", _r("r2"))


@query(f"WITH {PAIRS} SELECT band, round(sqrt(avg((y - p) * (y - p))), 6) AS value FROM pairs GROUP BY 1")
def band_metric_names(spark, folder):
    t = pairs(spark, folder)
    wide = t.agg(*(metrics.rmse(F.when(F.col("band") == b, F.col("y")), F.col("p")).alias(b) for b in X.BANDS))
    return metrics.named_bands(wide, X.BANDS).withColumn("value", _r("value"))


@query(f"WITH {PIXELS} SELECT year, month, row, col, round({_NDVI}, 6) + 0.0 AS ndvi, round({_BSI}, 6) + 0.0 AS bsi, round(({_NDVI} + (1 - thermal)) / 2, 6) + 0.0 AS vhi FROM pixels", longs=("row", "col"))
def spectral_indices(spark, folder):
    done = gapfill.spectral_indices(pixels(spark, folder))
    return done.select("year", "month", "row", "col", *(_r(c).alias(c) for c in ("ndvi", "bsi", "vhi")))


@query(
    f"WITH {PIXELS}, a AS (SELECT year, month, avg({_NDVI}) AS predicted FROM pixels GROUP BY 1, 2), b AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, avg(o_totalprice / 1000000) AS reference FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2) SELECT a.year, a.month, round(predicted, 6) + 0.0 AS predicted, round(reference, 6) + 0.0 AS reference, round(abs(predicted - reference), 6) + 0.0 AS difference FROM a LEFT JOIN b USING (year, month)"
)
def reference_compare(spark, folder):
    ndvi = gapfill.spectral_indices(pixels(spark, folder)).select("year", "month", "ndvi")
    orders = coverage.with_month(read(spark, folder, "orders").where("o_orderpriority <> '5-LOW'"), "o_orderdate")
    reference = orders.select("year", "month", (F.col("o_totalprice") / 1000000).alias("ndvi"))
    done = gapfill.reference_compare(ndvi, reference)
    return done.withColumns({c: _r(c) for c in ("predicted", "reference", "difference")})
