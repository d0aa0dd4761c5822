import public_tokenizers
import pytest

#: Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves.
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix strange potions near old stone towers".split()
EXTRA = ", label int, node string, key string, part int, rank int, shard int, n_lines long, n_tokens long, cluster long, media binary"


@pytest.fixture(scope="session")
def bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def sp_model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def odd_rows():
    shared = "This line is shared by many documents and is long enough to count."
    rows = [
        (1, f"{shared}\nOne of its own."),
        (2, f"  {shared.upper()}\t\nTwo <|endoftext|> here"),
        (3, f"{shared}\n{shared}\n"),
        (4, shared),
        (5, f"x\n{shared}\r\ny"),
        (6, None),
        (7, ""),
        (8, "é中文🙂 " * 50 + "\x00\n \t"),
        (9, "word " * 30_000),
        (10, "z" * 60_000),
        (11, shared),
        (11, shared),
        (None, "a row without an id"),
        (None, None),
        (-5, "  "),
        (12, "a run of blanks" + " " * 1_200_000 + "x" + "\t\n" * 60_000),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    schema = "doc_id long, text string" + EXTRA
    return spark.createDataFrame([(*r, *[None] * 10) for r in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string" + EXTRA)


@pytest.fixture(scope="session")
def some_texts(small):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()
