"""Line dedup over sharded cuckoo filters backed by exact reference-count tables.

Every document's line keys go into an exact reference table (key, doc_id, sign):
an insertion appends +1 rows, a deletion of documents appends -1 rows, so each step can be
taken back. Counts per key follow from it. A key is marked when enough documents hold it.
Marked keys are dealt over shards by hash, more shards the more keys, so that each is of bounded
size; each keeps its keys in a cuckoo filter, which is edited, not rebuilt, as
keys gain or lose the mark. Applying the index tests references against the filters
first, at any size: all filters are broadcast while they are small, beyond that
references meet their shard's filter. Only hits are joined with the exact table, which has the last word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from .cuckoo import CuckooFilter
from .runtime import arrow_map, chunks, join_counted, materialize, spread, unused

MIN_CHARS = 40
MIN_DOCS = 5
#: Shards of an index at least, and marked keys of a shard at most, on average.
SHARDS, SHARD_KEYS = 16, 32_768
#: References that meet a copy of their shard's filter in one group.
GROUP_REFS = 250_000
#: Stripped at both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"

REFS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("sign", T.IntegerType())])
FILTERS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("filter", T.BinaryType())])


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte key of a line, or None for a line too short to count.

    Lines are stripped and A-Z lower-cased; length is in code points.
    """
    line = line.strip(BLANK).lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and not line.isascii() and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def references(docs: DataFrame, sign: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct long line key of each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches, "text"):
            out: dict = {"key": [], "doc_id": []}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or len(text) < min_chars:
                    continue
                keys = {k for x in text.encode().split(b"\n") if len(x) >= min_chars and (k := line_key(x, min_chars))}
                out["key"] += keys
                out["doc_id"] += [doc] * len(keys)
            yield out | {"sign": [sign] * len(out["key"])}

    return arrow_map(spread(rows), run, REFS)


def shard_of(key, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


class LineIndex:
    """References, counts and filters of the documents inserted and not deleted so far.

    Documents are told apart by id: rows with equal ids are one document, rows with a null
    id are one document that sorts before all others.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, shards: int = SHARDS, min_chars: int = MIN_CHARS):
        self.spark, self.min_docs, self.shards, self.min_chars = spark, min_docs, shards, min_chars
        self.refs = spark.createDataFrame([], REFS)
        self.marked = spark.createDataFrame([], "key binary, n_docs long, keeper long")
        self.filters = spark.createDataFrame([], FILTERS)
        self._empty = True

    def insert(self, docs: DataFrame, **cols) -> LineIndex:
        return self._update(docs, 1, **cols)

    def delete(self, docs: DataFrame, **cols) -> LineIndex:
        """Takes documents back; they must be the rows that were inserted."""
        return self._update(docs, -1, **cols)

    def _update(self, docs: DataFrame, sign: int, **cols) -> LineIndex:
        new = LineIndex(self.spark, self.min_docs, self.shards, self.min_chars)
        added = materialize(references(docs, sign, self.min_chars, **cols), "line-refs")
        new.refs = added if self._empty else self.refs.unionByName(added)
        new._empty = False
        live = new.refs.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")
        counted = live.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        new.marked = materialize(counted.where(F.col("n_docs") >= self.min_docs), "line-counts")
        n = new.marked.count()
        while n > new.shards * SHARD_KEYS:
            new.shards *= 2
        new.filters = materialize(self._edit_filters(new), "line-filters")
        return new

    def _edit_filters(self, new: LineIndex) -> DataFrame:
        """Per shard of ``new``: deletes keys that lost the mark and inserts keys that gained it.

        A full filter is made anew, and so are all when there are more shards than before.
        """
        same = new.shards == self.shards
        before = (self.marked if same else self.marked.where("false")).select("key", F.lit(1).alias("old"))
        both = before.join(new.marked.select("key", F.lit(1).alias("new")), "key", "full").fillna(0, ["old", "new"])
        both = both.withColumn("shard", shard_of("key", new.shards))
        filters = self.filters if same else self.filters.where("false")

        def edit(key, filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            gained, lost, now = (_matrix(keys["key"][x]) for x in (keys["new"] > keys["old"], keys["new"] < keys["old"], keys["new"] == 1))
            if len(filters):
                made = CuckooFilter.from_bytes(filters["filter"].iloc[0])
                made.delete(lost)
                if not made.insert(gained):
                    made = CuckooFilter.of(now)
            else:
                made = CuckooFilter.of(now)
            return pd.DataFrame({"shard": pd.Series([key[0]], dtype="int32"), "filter": [made.to_bytes()]})

        return filters.groupBy("shard").cogroup(both.groupBy("shard")).applyInPandas(edit, FILTERS)

    def hits(self) -> DataFrame:
        """Live references (key, doc_id) whose key the shard's filter holds."""
        refs = self.refs.withColumn("shard", shard_of("key", self.shards))
        size = self.filters.agg(F.sum(F.octet_length("filter") + 64)).first()[0] or 0
        held = self._asked_at_once(refs) if size <= runtime.BROADCAST_BYTES else self._asked_by_shard(refs)
        return held.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def _asked_at_once(self, refs: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})

        def run(batches):
            filters = {k: CuckooFilter.from_bytes(v) for k, v in shared.value.items()}
            for batch in batches:
                shard, keys = batch.column(3).to_numpy(), _matrix(batch.column(0).to_pylist())
                keep = np.zeros(len(shard), bool)
                for s, at in _groups(shard):
                    if s in filters:
                        keep[at] = filters[s].contains(keys[at])
                kept = batch.filter(pa.array(keep))
                yield {f.name: kept.column(i) for i, f in enumerate(REFS)}

        return arrow_map(refs, run, REFS)

    def _asked_by_shard(self, refs: DataFrame) -> DataFrame:
        """Groups of a bounded number of references, each with a copy of its shard's filter."""
        groups = max(1, int((refs.count() / self.shards) / GROUP_REFS) + 1)
        part = (F.col("shard").cast("long") * groups + F.pmod(F.xxhash64("key", "doc_id", "sign"), F.lit(groups))).alias("part")
        copies = self.filters.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("at"), "shard", "filter")
        copies = copies.select((F.col("shard").cast("long") * groups + F.col("at")).alias("part"), "filter")
        target = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("sign", pa.int32())])

        def ask(own: pa.Table, filters: pa.Table) -> pa.Table:
            if not len(own) or not len(filters):
                return target.empty_table()
            made = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
            keep = made.contains(_matrix(own.column("key").to_pylist()))
            return own.select(target.names).filter(pa.array(keep)).cast(target)

        return refs.select(part, "key", "doc_id", "sign").groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(ask, REFS)

    def drops(self) -> DataFrame:
        """doc_id and the keys whose lines it loses: marked keys of which it isn't the keeper."""
        exact = self.marked.select("key", "keeper", F.col("n_docs").alias("rows"))
        found = join_counted(self.hits(), exact, ["key"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return found.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, ...] = ("n_lines", "n_dropped")) -> DataFrame:
        """``docs`` with the lines its documents lose taken out, and the numbers of lines before and dropped in columns named ``counts``, or neither.

        Lines split at line feeds; a null or empty text is one empty line and stays as it
        is. A text without losses is unchanged. ``docs`` must not hold columns named as ``counts``; other names are free.
        """
        own_id, own_keys = unused(docs, "id", "keys")
        drops = materialize(self.drops().select(F.col("doc_id").alias(own_id), F.col("keys").alias(own_keys)), "line-drops")
        size = drops.agg(F.sum(F.size(own_keys) * 32 + 96)).first()[0] or 0
        if size <= runtime.BROADCAST_BYTES:
            drops = F.broadcast(drops)
        joined = docs.join(drops, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)), "left").select(*docs.columns, own_keys)
        own = docs.schema.fields
        fields = own + [T.StructField(x, T.LongType()) for x in counts]
        at, min_chars = docs.columns.index(text_col), self.min_chars

        def run(batches):
            for batch in chunks(batches, text_col):
                texts, lines, dropped = [], [], []
                for text, keys in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist()):
                    n = 1 + text.count("\n") if text else 1
                    gone = 0
                    if keys and text:
                        keys = set(keys)
                        kept = [x for x in text.encode().split(b"\n") if len(x) < min_chars or line_key(x, min_chars) not in keys]
                        gone, text = n - len(kept), b"\n".join(kept).decode()
                    texts.append(text)
                    lines.append(n)
                    dropped.append(gone)
                kept = {f.name: batch.column(i) for i, f in enumerate(own)} | {own[at].name: texts}
                yield kept | dict(zip(counts, (lines, dropped)))

        return arrow_map(joined, run, T.StructType(fields))


def _matrix(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


def _groups(values: np.ndarray):
    """(value, positions) of equal values."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    starts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    return [(int(values[at[0]]), at) for at in np.split(order, starts) if at.size]


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, ...] = ("n_lines", "n_dropped")) -> DataFrame:
    """Inserts all of ``docs`` into a new index and applies it to them.

    Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents stay only in the document with the largest id. Rows with one id are one document;
    rows without an id are one that sorts before all others. Null and empty texts stay as they are; an empty table gives no rows.
    """
    index = LineIndex(docs.sparkSession, min_docs, SHARDS, min_chars).insert(docs, id_col=id_col, text_col=text_col)
    return index.apply(docs, id_col, text_col, counts)
