"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens and their lengths in tokens, of
a fixed number of entries: the most frequent ones of a bounded sample of the texts, then
entries of the vocabulary that are whole pre-tokens. It is broadcast as two buffers.
Tier two is a cache in each Python worker for all other pre-tokens, filled by the encoder
and emptied when it is full. No pre-token is ever shuffled: the plan is one scan and one
map. The sample decides only which lengths are at hand, never a count.
"""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .runtime import arrow_map, chunks, spread

#: Texts in the sample that tier one is filled from, and the longest of them, in characters.
SAMPLE_TEXTS, SAMPLE_CHARS = 1_000, 8_000
#: Entries of tier one.
FREQUENT = 65_536
#: Entries of both tiers in a worker before tier two is emptied (about 120 bytes each).
WORKER_ENTRIES = 600_000


class TwoTier(dict):
    """Pre-token to token count; a miss is encoded and kept while there is room."""

    def __init__(self, encoder: bytebpe.ByteBpe, frequent: dict[str, int], entries: int = WORKER_ENTRIES):
        super().__init__(frequent)
        self.encoder, self.frequent, self.entries = encoder, frequent, entries

    def __missing__(self, pretoken: str) -> int:
        n = self.encoder.piece_length(pretoken)
        if len(self) >= self.entries:
            self.clear()
            self.update(self.frequent)
        if len(pretoken) <= 256:
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        special = self.encoder.special
        if special is None or not special.search(text):
            return sum(map(self.__getitem__, self.encoder.pretokens(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.encoder.pretokens(p))) for p in parts)


def sample_texts(docs: DataFrame, text_col: str) -> list[str]:
    """A bounded number of whole texts of bounded length; ``take`` reads only as many tasks' input as it needs."""
    some = docs.select(F.col(text_col).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    return [r.text for r in some.take(SAMPLE_TEXTS)]


def frequent_table(encoder: bytebpe.ByteBpe, sample: list[str], entries: int = FREQUENT) -> tuple[bytes, bytes]:
    """The compact form: pre-tokens, most frequent first, joined behind a byte that UTF-8 never holds, and their lengths."""
    seen = Counter(word for text in sample for word in encoder.pretokens(text) if len(word) <= 256)
    chosen = [word for word, _ in seen.most_common(entries)]
    for piece in encoder.ranks:
        if len(chosen) >= entries:
            break
        try:
            word = piece.decode()
        except UnicodeDecodeError:
            continue
        if word not in seen and [*encoder.pretokens(word)] == [word]:
            chosen.append(word)
    lengths = [encoder.piece_length(word) for word in chosen]
    return b"\xff".join(w.encode() for w in chosen), np.array(lengths, "<u2").tobytes()


_tables: dict[int, TwoTier] = {}


def _worker_table(shared) -> TwoTier:
    """One table for a worker process, reused by its later tasks."""
    if shared.key not in _tables:
        source, words, lengths = shared.broadcast.value
        frequent = dict(zip((w.decode() for w in words.split(b"\xff")), np.frombuffer(lengths, "<u2").tolist()))
        _tables.clear()
        _tables[shared.key] = TwoTier(bytebpe.load(source), frequent)
    return _tables[shared.key]


class _Shared:
    def __init__(self, key, broadcast):
        self.key, self.broadcast = key, broadcast


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8) and n_tokens of the whole text.

    ``tokenizer`` names a byte-level BPE in JSON form or a SentencePiece model; counts
    are those of the file's own library without begin, end or other added tokens.
    Tier one comes from ``SAMPLE_TEXTS`` texts at most; every text is counted in full by
    either tier. A null text counts as empty: 0 bytes and 0 tokens. A null id stays null, repeated
    rows stay repeated, other columns are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source = Path(tokenizer).read_bytes()
    if tokenizer.endswith(".model"):
        counter = _model_counter(spark.sparkContext.broadcast(source))
    else:
        try:
            encoder = bytebpe.load(source)
        except ValueError:
            counter = _library_counter(spark.sparkContext.broadcast(source))
        else:
            words, lengths = frequent_table(encoder, sample_texts(docs, text_col))
            value = spark.sparkContext.broadcast((source, words, lengths))
            shared = _Shared(hash((source, words)), value)
            counter = lambda: _worker_table(shared).count

    def run(batches):
        count = counter()
        for batch in chunks(batches, "text"):
            texts = batch.column(1).to_pylist()
            yield {
                "doc_id": batch.column(0),
                "n_bytes": [len(x.encode()) if x else 0 for x in texts],
                "n_tokens": [count(x) if x else 0 for x in texts],
            }

    return arrow_map(spread(rows), run, SCHEMA)


def _model_counter(shared):
    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        return lambda text: len(model.encode(text))

    return make


def _library_counter(shared):
    def make():
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(shared.value.decode())
        model.no_truncation()
        model.no_padding()
        return lambda text: len(model.encode(text, add_special_tokens=False).ids)

    return make
