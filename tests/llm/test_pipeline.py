"""Each stage against a plain version of itself, on its own input."""

import pytest
from test_jaccard import brute as near
from test_linededup import brute as lines
from test_packing import check, library

import corpus_pipeline
from lacuna.llm import toxicity
from lacuna.llm.queries import training_labels
from lacuna.llm.runtime import materialize


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "packing"]
    assert all(df.columns == steps[0].columns and df.dtypes == steps[0].dtypes for df in steps[1:-1])


def test_toxic_documents_go(spark, small, steps):
    model = toxicity.fit(steps[0], training_labels(spark.read.parquet(f"{small}/labels.parquet")))
    kept = [r for r in rows(steps[0]) if model.judge(r[1])[0] < 0.5]
    assert sorted(rows(steps[1])) == sorted(kept)


def test_shared_lines_go(steps):
    want = [(i, t) for i, _, _, t in lines(rows(steps[1]))]
    assert sorted((i, t or "") for i, t in rows(steps[2])) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_group_stays(steps):
    want = {i for i, _, c in near(rows(steps[2]), 5, 80) if i == c}
    assert sorted(r[0] for r in rows(steps[3])) == sorted(want)


def test_all_that_is_kept_is_packed(steps, bpe):
    from pyspark.sql import functions as F

    from lacuna.llm import packing

    pieces = packing.pack(steps[3], bpe)
    check(pieces.collect(), rows(steps[3]), library(bpe), 1024, packing.SLACK)
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).select(*steps[4].columns)
    assert sorted(map(tuple, digest.select("doc_id", "start", "length", "doc_tokens").collect())) == sorted(map(tuple, steps[4].select("doc_id", "start", "length", "doc_tokens").collect()))


def test_odd_rows_pass(spark, odd, small, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, small).columns == odd.columns
        assert stage(spark, none, small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, small).count() == 0
    assert corpus_pipeline.run(spark, small).count() > 0
