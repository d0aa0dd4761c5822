import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import queries as own
from lacuna.functions.expressions import BANDS, FEATURES
from lacuna.operators import coverage, model
from lacuna.plans import gapfill
from lacuna.sources import catalog, raster, tables
from lacuna.streaming import arrivals


def test_catalog(spark):
    paths = ["d/red_2000_01_l7.tif", "d/red_2000_01_l5.tif", "d/era5/era5_precip_2000_01.tif", "d/avhrr_ndvi_1999_12.tif", "d/notes.txt", "d/red_2000_1_l7.tif"]
    parsed = catalog.parse(spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {(r.kind, r.band, r.year, r.month, r.mission) for r in parsed.collect()}
    assert got == {("landsat", "red", 2000, 1, "l7"), ("landsat", "red", 2000, 1, "l5"), ("era5", "precip", 2000, 1, None), ("avhrr", "ndvi", 1999, 12, None)}
    assert catalog.find(parsed, "landsat", "RED", 2000, 1) == "d/red_2000_01_l5.tif"
    assert catalog.find(parsed, "landsat", "red", 2000, 2) is None


def test_config(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("num_centers: 7\n")
    assert catalog.load_config(str(file))["num_centers"] == 7 and catalog.load_config()["lambda_reg"] == 1e-3


def test_rasters_round_trip(spark, tmp_path):
    values = np.arange(12, dtype=np.float32).reshape(3, 4)
    values[1, 2] = np.nan
    cells = [("red_2000_01_x.tif", r, c, float(values[r, c])) for r in range(3) for c in range(4)]
    made = raster.write_rasters(spark.createDataFrame(cells, "name string, row int, col int, value double"), 3, 4).collect()
    (tmp_path / made[0].name).write_bytes(made[0].content)
    back = raster.read_rasters(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [(r.height, r.width) for r in back[:1]] == [(3, 4)]
    assert np.array_equal(np.array([r.value for r in back]).reshape(3, 4), values, equal_nan=True)
    assert catalog.scan(spark, str(tmp_path)).first().band == "red"
    assert raster.read_rasters(spark, str(tmp_path), nodata=5.0).where("value IS NULL").count() == 1


@pytest.mark.parametrize("order", ["<", ">"])
def test_strips_predictor_and_byte_order(order):
    import struct

    grid = np.array([[1, 2, 3], [10, 20, 40]], dtype=f"{order}u2")
    delta = grid.copy()
    delta[:, 1:] -= grid[:, :-1]
    body = [zlib.compress(row.tobytes()) for row in delta]
    entries = [(256, 3, [3]), (257, 3, [2]), (258, 3, [16]), (259, 3, [8]), (278, 3, [1]), (317, 3, [2]), (339, 3, [1])]
    start = 8 + sum(map(len, body))
    places = struct.pack(order + "IIII", 8, 8 + len(body[0]), len(body[0]), len(body[1]))
    entries += [(273, 4, start), (279, 4, start + 8)]
    table = b""
    for tag, kind, v in sorted(entries):
        table += struct.pack(order + "HHI", tag, kind, 2 if isinstance(v, int) else 1) + (struct.pack(order + "I", v) if isinstance(v, int) else struct.pack(order + "HH", v[0], 0))
    head = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, start + 16)
    raw = head + b"".join(body) + places + struct.pack(order + "H", len(entries)) + table + bytes(4)
    assert raster.decode(raw).tolist() == grid.tolist()


def test_counts_csv(spark, small, tmp_path):
    counts = own._counts(spark, small)
    tables.write_counts(counts, str(tmp_path / "c"))
    assert sorted(tables.read_counts(spark, str(tmp_path / "c")).collect()) == sorted(counts.select(*tables.COUNT_COLUMNS).collect())


def test_pixels_by_month(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 2 + 2000).cast("int").alias("year"), F.lit(1).alias("month"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit(0.1).alias("red"))
    tables.write_pixels(df, str(tmp_path / "p"), "interpolated", "red")
    back = tables.read_pixels(spark, str(tmp_path / "p"))
    assert back.where("year = 2000").count() == 10 and dict(back.dtypes)["red"] == "float" and back.first().source == "interpolated"


def test_gap_literal_file(spark, tmp_path):
    tables.write_gap_literal(spark.createDataFrame([(1995, 6)], "year int, month int"), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).first()[0] == "  {y: 1995, m: 6}"


def test_new_files_are_taken_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(3).write.parquet(source)
    for n in (3, 5):
        arrivals.take_new(arrivals.stream_table(spark, source, "id long"), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == n
        spark.range(2).write.mode("append").parquet(source)


@pytest.fixture(scope="module")
def fitted(spark, small):
    cfg = catalog.load_config() | {"num_centers": 8, "max_pixels_per_month": 20}
    return gapfill.fit_pipeline(own.matrix(spark, small), cfg, seeds=1)


def test_model_survives_saving(spark, small, tmp_path, fitted):
    held, _ = fitted
    held.save(spark, str(tmp_path / "m"))
    again = model.RbfModel.load(spark, str(tmp_path / "m"))
    x = np.random.default_rng(0).normal(size=(5, len(FEATURES)))
    assert np.array_equal(held.predict(x), again.predict(x)) and again.gamma == held.gamma
    with pytest.raises(FileNotFoundError):
        model.RbfModel.load(spark, str(tmp_path / "none"))


def test_fit_matches_numpy(spark, small, fitted):
    held, errors = fitted
    rows = gapfill.training_rows(own.matrix(spark, small), ["row", "col"], 20)
    from lacuna.operators import features

    split = features.temporal_split(rows, ["row", "col"]).collect()
    x = np.array([[r[f] for f in FEATURES] for r in split], float)
    y = np.array([[r[b] for b in BANDS] for r in split], float)
    train = np.array([r.is_train for r in split])
    scale = np.where(x.std(0) == 0, 1, x.std(0))
    z = (x - x.mean(0)) / scale
    a = model.activations(z[train], held.centers, held.gamma)
    w = np.linalg.solve(a.T @ a + 1e-3 * np.eye(len(held.centers)), a.T @ y[train])
    assert np.allclose(w, held.weights, atol=1e-6)
    rmse = np.sqrt(((model.activations(z[~train], held.centers, held.gamma) @ w - y[~train]) ** 2).mean())
    assert {r.band: r.rmse for r in errors.collect()}["overall"] == pytest.approx(rmse, abs=1e-6)


def test_nan_stays_and_infinity_is_refused(spark, fitted):
    held, _ = fitted
    row = [0.5] * len(FEATURES)
    frame = lambda v: spark.createDataFrame([(1, v, *row[1:])], "k int, " + ", ".join(f"{f} double" for f in FEATURES))
    assert math.isnan(model.predict(frame(float("nan")), held, ("k",)).first().red)
    with pytest.raises(Exception, match="infinite"):
        model.predict(frame(float("inf")), held, ("k",)).collect()


def test_no_rows_is_an_error(spark, small):
    with pytest.raises(ValueError, match="no usable months"):
        gapfill.fit_pipeline(own.matrix(spark, small).where("false"), catalog.load_config(), seeds=1)


def test_calendar_is_inclusive(spark):
    assert coverage.calendar(spark, 1995, 1999).count() == 60


def test_nested_configuration(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("landsat: {bands: [Red, NIR], training_years: [2001, 2002]}\nmodel: {rbfn: {num_centers: 9, gamma: null, regularization_lambda: 0.5, validation_holdout_ratio: 0.1, pixels_per_month: 5}}\nseed: 1\n")
    cfg = catalog.load_config(str(file))
    assert (cfg["bands"], cfg["train_years"], cfg["num_centers"], cfg["lambda_reg"], cfg["val_ratio"], cfg["max_pixels_per_month"], cfg["seed"]) == (["red", "nir"], [2001, 2002], 9, 0.5, 0.1, 5, 1)


def test_georeferencing_goes_out_and_in():
    like = raster.Header(3, 4, (30.0, 20.0), (500.5, 900.25), 21097)
    raw = raster.encode(np.arange(12.0).reshape(3, 4), like)
    assert raster.header(raw) == like and np.array_equal(raster.decode(raw), np.arange(12.0).reshape(3, 4))
    assert raster.header(raster.encode(np.zeros((2, 5)))) == raster.Header(2, 5)


def pack_lzw(data):
    out, bits, n, table = bytearray(), 0, 0, {}

    def put(code):
        nonlocal bits, n
        width = max(9, min(12, (len(table) + 258 + 0).bit_length())) if table or code != 256 else 9
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if len(word + c) == 1 or word + c in table:
            word += c
            continue
        put(word[0] if len(word) == 1 else table[word])
        table[word + c] = 258 + len(table)
        word = c
    put(word[0] if len(word) == 1 else table[word])
    table[b"end"] = 0
    put(257)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


def test_codecs():
    rng = np.random.default_rng(0)
    for data in (bytes(range(256)) * 2, b"ab" * 400, bytes(rng.integers(0, 4, 1500, dtype=np.uint8))):
        assert raster.unpack_lzw(pack_lzw(data)) == data
    assert raster.unpack_bits(bytes([254, 170, 2, 128, 0, 42, 253, 170, 128])) == bytes([170, 170, 170, 128, 0, 42, 170, 170, 170, 170])
    cells = rng.normal(size=(3, 5)).astype("<f4")
    planes = cells.astype(">f4").view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20)
    body = zlib.compress(np.diff(planes, axis=1, prepend=0).astype(np.uint8).tobytes())
    tags = [(256, 5), (257, 3), (258, 32), (259, 8), (273, 8), (277, 1), (278, 3), (279, len(body)), (317, 3), (339, 3)]
    body += bytes(len(body) % 2)
    raw = struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
    assert np.array_equal(raster.decode(raw), cells)


def test_gap_script_file(spark, tmp_path):
    tables.write_gap_script(spark.createDataFrame([(1995, 9), (1995, 6)], "year int, month int"), str(tmp_path / "g"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert lines == ["var gapMonths = [", "  {y: 1995, m: 6},", "  {y: 1995, m: 9}", "];"]
