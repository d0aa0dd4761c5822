"""Single-band rasters as GeoTIFF files: a reader and a writer of the plain baseline form.

Reads the first band of little- or big-endian TIFF files in strips or tiles, stored plainly, deflated, as LZW or PackBits,
with or without the predictors for integers and floats, with integer or floating samples; other codecs are refused by name.
Pixel size, origin and projection code are read and written along. Nodata is not masked unless asked for. Files are read with Spark's own binary source
and decoded in the executors, a file at a time.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# TIFF field types' codes and sizes, and the tags used.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735
#: Keys of the projection's code among the geographic keys: projected, geographic.
PROJECTED, GEOGRAPHIC = 3072, 2048
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        code = order + TYPES[kind] * n
        place = at + 10 + 12 * i
        if struct.calcsize(code) > 4:
            place = struct.unpack_from(order + "I", raw, place)[0]
        tags[tag] = struct.unpack_from(code, raw, place)
    return order, tags


@dataclass(frozen=True)
class Header:
    """Size, pixel size and the origin's coordinates (None where the file has none), and the projection's EPSG code."""

    height: int
    width: int
    pixel: tuple[float, float] | None = None
    origin: tuple[float, float] | None = None
    epsg: int | None = None


def header(raw: bytes) -> Header:
    """What a file says of its grid, without its pixels."""
    _, t = _tags(raw)
    keys = t.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    scale, tie = t.get(PIXEL_SCALE), t.get(TIE_POINT)
    origin = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]) if scale and tie else None
    return Header(t[HEIGHT][0], t[WIDTH][0], tuple(scale[:2]) if scale else None, origin, codes.get(PROJECTED, codes.get(GEOGRAPHIC)))


def unpack_lzw(raw: bytes) -> bytes:
    """Variable-length codes, highest bit first, from 9 to 12 bits; 256 clears the table, 257 ends."""
    out, table, width = bytearray(), [], 9
    bits = held = 0
    last = b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data must start with a clear code")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def unpack_bits(raw: bytes) -> bytes:
    """Runs and copies, each behind a signed count."""
    out, p = bytearray(), 0
    while p < len(raw):
        n = raw[p]
        if n < 128:
            out += raw[p + 1 : p + 2 + n]
            p += 2 + n
        elif n > 128:
            out += raw[p + 1 : p + 2] * (257 - n)
            p += 2
        else:
            p += 1
    return bytes(out)


UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


def decode(raw: bytes) -> np.ndarray:
    """The first band as (height, width)."""
    order, t = _tags(raw)
    width, height = t[WIDTH][0], t[HEIGHT][0]
    samples, bits = t.get(SAMPLES, (1,))[0], t.get(BITS, (1,))[0]
    planar, codec, predictor = (t.get(k, (1,))[0] for k in (PLANAR, COMPRESSION, PREDICTOR))
    kind = {1: "u", 2: "i", 3: "f"}[t.get(FORMAT, (1,))[0]]
    if codec not in UNPACK or bits % 8 or predictor not in (1, 2, 3) or (predictor == 2 and kind == "f") or (predictor == 3 and kind != "f"):
        raise ValueError(f"compression {codec}, predictor {predictor} or {bits} bits aren't supported")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    tiled = TILES in t
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(ROWS, (height,))[0], height))
    across = -(-width // bw)
    depth = samples if planar == 1 else 1
    out = np.zeros((height, width), dtype)
    places, sizes = (t[TILES], t[TILE_COUNTS]) if tiled else (t[STRIPS], t[COUNTS])
    for i in range(across * -(-height // bh)):
        block = UNPACK[codec](raw[places[i] : places[i] + sizes[i]])
        row, col = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, height - row)
        if predictor == 3:  # bytes of a row's values, the highest of all first, as differences
            size = dtype.itemsize
            flat = np.frombuffer(block, np.uint8, rows * bw * depth * size).reshape(rows, bw * size, depth)
            planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, bw * depth)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes()
        own = dtype.newbyteorder(">") if predictor == 3 else dtype
        cells = np.frombuffer(block, own, rows * bw * depth).reshape(rows, bw, depth)
        if predictor == 2:
            cells = np.cumsum(cells, axis=1, dtype=dtype)
        part = cells[: height - row, : width - col, 0]
        out[row : row + part.shape[0], col : col + part.shape[1]] = part
    return out


def encode(values: np.ndarray, grid: Header | None = None) -> bytes:
    """A float32 single-band file in one deflated strip, with the pixel size, origin and projection of ``grid``."""
    cells = np.ascontiguousarray(values, "<f4")
    height, width = cells.shape
    body = zlib.compress(cells.tobytes())
    body += bytes(len(body) % 2)
    tags = [(WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (32,)), (COMPRESSION, "H", (8,)), (PHOTOMETRIC, "H", (1,)), (STRIPS, "I", (8,)), (SAMPLES, "H", (1,)), (ROWS, "I", (height,)), (COUNTS, "I", (len(body),)), (PLANAR, "H", (1,)), (FORMAT, "H", (3,))]
    if grid and grid.pixel and grid.origin:
        tags += [(PIXEL_SCALE, "d", (*grid.pixel, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, *grid.origin, 0.0))]
    if grid and grid.epsg:
        tags.append((GEO_KEYS, "H", (1, 1, 0, 2, 1024, 0, 1, 1, PROJECTED, 0, 1, grid.epsg)))
    codes = {code: kind for kind, code in TYPES.items() if len(code) == 1}
    extra = 8 + len(body)
    entries = b""
    for tag, code, items in sorted(tags):
        packed = struct.pack("<" + code * len(items), *items)
        if len(packed) > 4:
            body += packed + bytes(len(packed) % 2)
            packed = struct.pack("<I", extra)
            extra = 8 + len(body)
        entries += struct.pack("<HHI", tag, codes[code], len(items)) + packed.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, extra) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


PIXELS = T.StructType([T.StructField("path", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())])


def read_rasters(spark: SparkSession, root: str, nodata: float | None = None, glob: str = "*.tif") -> DataFrame:
    """All files below a folder as pixels (path, height, width, row, col, value), a block of rows per batch."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return decode_rasters(files, nodata)


def read_headers(files: DataFrame) -> DataFrame:
    """(path, height, width, pixel_x, pixel_y, origin_x, origin_y, epsg) of rows (path, content)."""
    schema = "path string, height int, width int, pixel_x double, pixel_y double, origin_x double, origin_y double, epsg int"

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = header(raw)
                rows.append((path, h.height, h.width, *(h.pixel or (None, None)), *(h.origin or (None, None)), h.epsg))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int32()]
            columns = [list(c) for c in zip(*rows)] or [[]] * 8
            names = ["path", "height", "width", "pixel_x", "pixel_y", "origin_x", "origin_y", "epsg"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def decode_rasters(files: DataFrame, nodata: float | None = None) -> DataFrame:
    """Rows (path, content) as pixels, a block of rows per batch."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grid = decode(raw)
                height, width = grid.shape
                step = max(1, 200_000 // max(1, width))
                for top in range(0, height, step):
                    part = grid[top : top + step].astype(float)
                    n = part.size
                    value = part.ravel()
                    mask = value == nodata if nodata is not None else None
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * n),
                            pa.array(np.full(n, height, np.int32)),
                            pa.array(np.full(n, width, np.int32)),
                            pa.array(np.repeat(np.arange(top, top + len(part), dtype=np.int32), width)),
                            pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))),
                            pa.array(value, mask=mask),
                        ],
                        names=PIXELS.names,
                    )

    return files.select("path", "content").mapInArrow(run, PIXELS)


def write_rasters(pixels: DataFrame, height: int, width: int, name: str = "name", value: str = "value", like: Header | None = None) -> DataFrame:
    """(name, content): one encoded file for each name, georeferenced as ``like``; a raster must fit a task. Cells without a pixel are NaN."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])
    target = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def run(key, table):
        grid = np.full((height, width), np.nan, np.float32)
        grid[table.column("row").to_numpy(), table.column("col").to_numpy()] = table.column("value").to_numpy()
        return pa.table({"name": [key[0].as_py()], "content": [encode(grid, like)]}, schema=target)

    rows = pixels.select(F.col(name).alias("name"), "row", "col", F.col(value).cast("double").alias("value"))
    return rows.groupBy("name").applyInArrow(run, schema)
