"""Packing token ids into fixed-size sequences along cutting-stock patterns.

Each task encodes its documents once. A document longer than a sequence gives full
sequences and a rest; rests gather in a bounded buffer. From the histogram of a full
buffer's lengths column generation finds patterns that fill sequences and rounds them, and the
buffer's documents, ranked in their length class, take the patterns' places. What no
pattern takes is laid end to end, in one line through all tasks, and cut where a sequence
ends. Tasks number their own sequences and positions; a table of a few numbers per task
turns these into the whole table's. So ids are written once and never shuffled, and no
step holds more than a buffer.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .cutting import plan
from .runtime import BROADCAST_BYTES, arrow_map, chunks, materialize, spread

SEQUENCE = 1024
#: Ids a pattern may leave empty at the end of a sequence.
SLACK = 4
#: Ids that a task gathers before it packs them.
BUFFER = 4 << 20
#: Ids in a batch of results.
BATCH = 1 << 19

PLACED = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class Packer:
    """Places of one task's documents: (doc, start, ids, tokens, sequence, offset) of each piece.

    Sequences count from 0. Pieces to be laid end to end have no sequence; their offset is
    their position in the task's line.
    """

    def __init__(self, sequence: int, slack: int, buffer: int):
        self.sequence, self.slack, self.buffer = sequence, slack, buffer
        self.used = self.line = self.held = 0
        self.rests: dict[int, deque] = defaultdict(deque)

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Takes a document in; gives its full sequences, and the buffer's places once that is full."""
        n = len(ids)
        whole = n // self.sequence * self.sequence
        for start in range(0, whole, self.sequence):
            yield doc, start, ids[start : start + self.sequence], n, self.used, 0
            self.used += 1
        if whole < n:
            self.rests[n - whole].append((doc, whole, ids[whole:].copy() if whole else ids, n))
            self.held += n - whole
        if self.held >= self.buffer:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """Places of all rests in the buffer."""
        for pattern, times in plan({k: len(v) for k, v in self.rests.items()}, self.sequence, self.slack):
            lengths = [k for k, n in sorted(pattern.items(), reverse=True) for _ in range(n)]
            offsets = np.cumsum([0, *lengths]).tolist()
            for _ in range(times):
                for length, offset in zip(lengths, offsets):
                    yield *self.rests[length].popleft(), self.used, offset
                self.used += 1
        for length in sorted(self.rests, reverse=True):
            for rest in self.rests[length]:
                yield *rest, None, self.line
                self.line += length
        self.rests.clear()
        self.held = 0


def place_documents(docs: DataFrame, tokenizer: str, sequence: int, slack: int, end_id: int, id_col: str, text_col: str, buffer: int) -> DataFrame:
    """Rows of ``PLACED``: every piece with its place in its task."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pieces(batches) -> Iterator[tuple]:
        encoder, packer = bytebpe.load(shared.value), Packer(sequence, slack, buffer)
        for batch in chunks(batches, "text", 2 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.encode_array(text), end_id) if text else np.array([end_id])
                yield from packer.add(doc, ids.astype("<u4"))
        yield from packer.flush()

    def run(batches):
        part, size = TaskContext.get().partitionId(), 0
        out: dict = {f.name: [] for f in PLACED}
        for doc, start, ids, n, at, offset in pieces(batches):
            for name, value in zip(out, (part, doc, start, len(ids), ids.tobytes(), n, at, offset)):
                out[name].append(value)
            size += len(ids) + 16
            if size >= BATCH:
                yield out
                out, size = {f.name: [] for f in PLACED}, 0
        yield out

    return arrow_map(spread(rows), run, PLACED)


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, slack: int = SLACK, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", buffer: int = BUFFER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    Sequences hold ``sequence`` ids; patterns leave at most ``slack`` of them empty, cut
    rests none but in the table's last sequence. A null text is empty and gives ``end_id`` alone; a text
    of any length is cut into full sequences and a rest. Every row is a document of its
    own, also with a null or repeated id; ties in a class go by place in the task. Other
    columns are not read. An empty table gives no rows.
    """
    placed = materialize(place_documents(docs, tokenizer, sequence, slack, end_id, id_col, text_col, buffer), "placed")
    tasks = placed.groupBy("part").agg(
        F.coalesce(F.max("sequence") + 1, F.lit(0)).alias("used"), F.sum(F.when(F.col("sequence").isNull(), F.col("length")).otherwise(0)).alias("line")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("used", "line")]
    tasks = materialize(tasks.select("part", *before, F.sum("used").over(Window.partitionBy()).alias("all_used")), "task-places")
    if tasks.count() * 64 <= BROADCAST_BYTES:
        tasks = F.broadcast(tasks)

    size = F.lit(sequence)
    position = F.col("line_before") + F.col("offset")
    line = F.col("all_used") + F.floor(position / size)
    head = F.least(F.col("length"), size - F.pmod(position, size))

    def piece(skip, length, at, offset):
        ids = F.substring(F.col("ids"), (skip * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct((F.col("start") + skip).alias("start"), length.alias("length"), ids.alias("ids"), at.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    nothing = F.lit(0).cast("long")
    own = F.array(piece(nothing, F.col("length"), F.col("used_before") + F.col("sequence"), F.col("offset")))
    first = piece(nothing, head, line, F.pmod(position, size))
    second = piece(head, F.col("length") - head, line + 1, nothing)
    cut = F.when(F.col("sequence").isNotNull(), own).when(head < F.col("length"), F.array(first, second)).otherwise(F.array(first))
    out = placed.join(tasks, "part").select("doc_id", "doc_tokens", F.explode(cut).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
