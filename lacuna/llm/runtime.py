"""Shared scratch tables and Arrow plumbing for the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Sides up to this many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 48 << 20

#: Tables up to this many bytes are dealt over all cores before costly maps.
SMALL_BYTES = 16 << 20

#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 2_000

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (local tests) a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _forget() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _written:
        try:
            drop_table(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_forget)


def drop_table(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Deletes scratch tables that ``materialize`` made and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path in _written:
            drop_table(table.sparkSession, path)
            _written.remove(path)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs only the reading tasks.
    """
    spark = df.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _written.append(path)
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that a column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: str = "rows") -> DataFrame:
    """Inner join on ``on`` in which no key's rows pile up in one task.

    ``right`` has one row a key; its column ``rows``, which doesn't come along, says how
    many rows of ``left`` the key has. While it is small, all of it is broadcast. Beyond that only keys
    with more than a 4,096th of all rows are, of which there are fewer than 4,096; the others are shuffled.
    """
    n, total = right.agg(F.count("*"), F.coalesce(F.sum(rows), F.lit(0))).first()
    if n * 96 <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop(rows)), on)
    limit = max(64, total // 4096)
    heavy = right.where(F.col(rows) > limit)
    hot = left.join(F.broadcast(heavy.drop(rows)), on)
    rest = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col(rows) <= limit).drop(rows), on)
    return hot.unionByName(rest)


def _bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to a few megabytes of ordinary texts, so that two workers and the JVM fit an executor."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """A table of few bytes dealt over all cores; it may lie in a single row group, which one task would read."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of column lists."""
    target = to_arrow_schema(schema)
    _bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            arrays = [
                x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, type=f.type)
                for f in target
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of ``text`` or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            yield batch
            continue
        start = size = 0
        for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
