"""From raw documents to packed sequences: toxicity, line dedup, near duplicates, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's docs. All but the last return the columns of the documents they got,
which may have any names. Every stage takes null, empty and very long texts, null ids, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import jaccard, linededup, packing, toxicity
from lacuna.llm.queries import BYTE_BPE, training_labels
from lacuna.llm.runtime import materialize, unused

#: A fitted classifier and token ids decide: not for SQL. Tests compare each stage with a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels outside the held-out fold, does not call toxic.

    Null and empty texts have no passages and stay; repeated rows go or stay together; an empty table gives no rows.
    """
    model = toxicity.fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.clean_documents(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars`` follows where a text has changed.

    A document all of whose lines go stays, with an empty text; a null text stays null. Rows with one id are one
    document, and so are rows without an id, which sorts first. An empty table gives no rows.
    """
    lines, dropped = unused(docs, "lines", "dropped")
    kept = linededup.dedup_lines(docs, counts=(lines, dropped))
    if "n_chars" in docs.columns:
        size = F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    It is the one with the smallest id or, where ids repeat or lack, the first row. Texts without words all stay;
    of repeated rows with words one stays; an empty table gives no rows.
    """
    return jaccard.one_of_each(docs, n=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of 1024: one row per piece, with its ids' checksum.

    Every row is a document of its own; a null or empty text gives the end id alone; an empty table gives no rows.
    """
    pieces = packing.pack(docs, public_tokenizers.path(BYTE_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
