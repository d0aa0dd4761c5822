"""Sharding by fixed virtual slots under a versioned slot-to-shard map.

Every record hashes into one of a fixed number of virtual slots, for good. Bytes and
rows are summed per slot, and a map says which shard holds which slot. The map is a
small versioned table: rebalancing, also onto more shards, edits a few of its entries
as the next version and moves only the rows of those slots. What the driver sees is
bounded by the number of slots, whatever the input.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialize, shared_dir

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version, shard of each slot, and the bytes and rows each slot had when it was made."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.size):
            out[s] += b
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per slot; ``first`` counts the rows of earlier slots in the same shard."""
        seen, first = [0] * self.n_shards, []
        for s, n in zip(self.shard, self.rows):
            first.append(seen[s])
            seen[s] += n
        rows = zip([self.version] * len(self.shard), [self.n_shards] * len(self.shard), range(len(self.shard)), self.shard, self.size, self.rows, first)
        return spark.createDataFrame([*rows], "version int, n_shards int, virtual_slot int, shard int, size long, rows long, first long")


def rebalance(old: SlotMap, size: list[int], rows: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version for new slot sizes or more shards: moves slots off the fullest shards only.

    A move takes, from the fullest shard, the slot nearest to half the difference that still
    lowers the larger of both loads, to the emptiest; with more shards than before, only to the new ones. It
    ends when all are within ``tolerance`` of the mean or no move helps, that is when the
    fullest and the emptiest shard differ by less than the smallest slot of the fullest.
    """
    n = n_shards or old.n_shards
    if n < old.n_shards:
        raise ValueError("shards are only added")
    shard, load = list(old.shard), [0] * n
    held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for slot, s in enumerate(shard):
        load[s] += size[slot]
        held[s].append((size[slot], slot))
    mean = sum(load) / n
    takers = range(old.n_shards, n) if n > old.n_shards else range(n)
    for _ in range(4 * len(shard)):
        top, low = max(range(n), key=load.__getitem__), min(takers, key=load.__getitem__)
        if load[top] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        room = load[top] - load[low]
        fits = [x for x in held[top] if 0 < x[0] < room]
        if not fits:
            break
        best = min(fits, key=lambda x: (abs(2 * x[0] - room), x[1]))
        held[top].remove(best)
        held[low].append(best)
        shard[best[1]] = low
        load[top] -= best[0]
        load[low] += best[0]
    return replace(old, version=old.version + 1, n_shards=n, shard=tuple(shard), size=tuple(size), rows=tuple(rows))


def save(map_: SlotMap, spark: SparkSession, path: str) -> None:
    """Adds the version to the map table; earlier versions stay readable."""
    map_.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map table, by default the latest."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows), tuple(r["size"] for r in rows), tuple(r.rows for r in rows))


def into_slots(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_group (equal for equal texts), place and virtual_slot of every row.

    The slot hashes id and text together, so neither a null or repeated id nor a text
    with many copies fills a slot by itself. ``place`` tells equal rows apart.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_group"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def split_repeated(slotted: DataFrame, slots: int) -> DataFrame:
    """The written slots, with rows that repeat more often than a slot holds on average dealt over all slots by their place.

    There are fewer such rows than slots, so they are broadcast; all other rows keep the slot
    that id, checksum and size give them.
    """
    key = ["doc_id", "text_crc32", "size"]
    sums = slotted.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    total, most = sums.agg(F.sum("n"), F.max("n")).first()
    limit = max(16, (total or 0) // slots)
    if (most or 0) <= 2 * limit:
        return slotted
    full = sums.where(F.col("n") > 2 * limit).select("virtual_slot")
    often = slotted.join(F.broadcast(full), "virtual_slot", "left_semi").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    often = F.broadcast(often.select(*(F.col(c).alias(f"often_{c}") for c in key)))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"often_{c}"))
    spread = F.pmod(F.xxhash64(*key, "place"), F.lit(slots)).cast("int")
    joined = slotted.join(often, same, "left").withColumn("virtual_slot", F.when(F.col("often_size").isNotNull(), spread).otherwise(F.col("virtual_slot")))
    return materialize(joined.select(*slotted.columns), "split-slots")


def slot_sums(slotted: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; never more than ``slots`` rows reach the driver."""
    size, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return size, rows


def place(slotted: DataFrame, map_: SlotMap) -> DataFrame:
    """Adds shard and slot, the row's place in its shard, gapless from 0.

    A row's place is the number of rows in earlier virtual slots of its shard (from the
    map, a table of fixed size that is broadcast) plus its rank in its own slot, so no
    task ever sorts a whole shard.
    """
    spark = slotted.sparkSession
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "place"))
    table = map_.frame(spark).select("virtual_slot", "shard", "first", F.col("version").alias("map_version"))
    return (
        slotted.withColumn("rank", rank)
        .join(F.broadcast(table), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "virtual_slot", "map_version", "text_group")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, slots: int = SLOTS, map_path: str | None = None, **cols) -> DataFrame:
    """Puts every row into a shard; shards are near equal in bytes (text bytes plus 1 a row).

    The map is kept at ``map_path``, by default a new folder in the shared one. Where it has no
    version, slots are dealt in turn as the first; then its latest version is edited to the present
    sizes and shard count, saved as the next one, and rows are placed by what was saved. Null texts count 1
    byte; rows that repeat often are spread over the slots; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slotted = split_repeated(materialize(into_slots(docs, slots, **cols), "slots"), slots)
    size, rows = slot_sums(slotted, slots)
    map_path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(map_path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        dealt = tuple(slot % n_shards for slot in range(slots))
        save(SlotMap(1, n_shards, dealt, (0,) * slots, (0,) * slots), spark, map_path)
    edited = rebalance(load(spark, map_path), size, rows, n_shards, tolerance=0.0)
    save(edited, spark, map_path)
    return place(slotted, load(spark, map_path, edited.version))
