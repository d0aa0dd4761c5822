import random

import numpy as np
import pytest

from lacuna.llm import jaccard, queries, toxicity


def brute_segments(w):
    """Maximal scoring segments by their definition: the best segment, then the same left and right of it."""
    if len(w) == 0:
        return []
    best, found = 0.0, None
    for i in range(len(w)):
        total = 0.0
        for j in range(i, len(w)):
            total += w[j]
            if total > best + 1e-12:
                best, found = total, (i, j + 1)
    if found is None:
        return []
    i, j = found
    left = [(a, b, s) for a, b, s in brute_segments(w[:i])]
    right = [(a + j, b + j, s) for a, b, s in brute_segments(w[j:])]
    return left + [(i, j, best)] + right


def test_maximal_segments_are_those_of_the_definition():
    rng = random.Random(0)
    for _ in range(400):
        w = np.array([rng.choice([-3.1, -1.0, -0.55, 1.3, 2.7, 0.45]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 25))])
        got = toxicity.maximal_segments(w)
        want = brute_segments(w.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_linear_time():
    import time

    w = np.where(np.arange(300_000) % 2 == 0, 1.0, -0.9)
    began = time.time()
    toxicity.maximal_segments(w)
    assert time.time() - began < 20


def corpus(n, seed=0):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(300)]
    bad = ["nasty", "vilest", "brutal"]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(common, k=rng.randint(5, 300))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(2 + len(text) // 30):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1200)
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab.where(queries.fold(lab.doc_id) != 0))
    scored = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [r.doc_id for r in lab.where(queries.fold(lab.doc_id) == 0).collect()]
    assert 150 < len(held) < 350
    assert np.mean([scored[i].predicted == (i % 8 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    kept = {r.doc_id for r in toxicity.clean_documents(df, model).collect()}
    assert kept == {i for i, r in scored.items() if not r.predicted}


def test_real_tables(spark, small):
    bigger = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{bigger}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in queries.op9_toxicity(spark, bigger).collect()}
    assert len(found) == docs.count()
    held = [(r.toxic, found[r.doc_id].predicted) for r in labels.collect() if r.doc_id in found and found[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_odd_texts(spark, odd, odd_rows, none):
    docs, labels = corpus(200)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None for r in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.clean_documents(odd, model).columns == odd.columns


def test_one_kind_of_label_or_none(spark):
    df = spark.createDataFrame([(i, "some text", "x") for i in range(5)], "doc_id long, text string, label string")
    for rows in ([], [(i, 0) for i in range(5)], [(i, None) for i in range(5)]):
        model = toxicity.fit(df, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(df, model).collect()} == {0}
    model = toxicity.fit(df, spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(df, model).collect()} == {1}


def test_only_near_copies_count_once(spark):
    # All texts hold one three-word passage, whose hash is the smallest of theirs, and have nothing else in common.
    least = lambda t: jaccard.shingles(t, 3, jaccard.WordHashes())[0]
    common = min((f"a{i} b{i} c{i}" for i in range(3000)), key=least)
    texts = [t for i in range(40) if least(t := f"{common} " + " ".join(f"w{i}x{k}" for k in range(8))) == least(common)][:12]
    assert len(texts) == 12
    long = " ".join(f"v{k}" for k in range(60))
    copies = [long, long, long + " more"]
    rows = [(i, i % 2, t) for i, t in enumerate(texts)] + [(100 + i, 0, t) for i, t in enumerate(copies)] + [(200, 1, long)]
    kept = toxicity._families(spark.createDataFrame(rows, "__id long, label int, text string")).collect()
    assert sorted(r["__id"] for r in kept if r["__id"] < 100) == list(range(12))
    assert sorted(r.label for r in kept if r["__id"] >= 100) == [0, 1]


def test_weights_that_are_not_broadcast_judge_the_same(spark, monkeypatch):
    from lacuna.llm import runtime

    docs, labels = corpus(300)
    rows = [*docs, (5, None, "x"), (5, "", "x"), (None, docs[0][1], "x"), (None, docs[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, weights string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    at_once = toxicity.fit(df, lab)
    want = sorted((repr(r.doc_id), round(r.score, 9), r.predicted) for r in toxicity.score(df, at_once).collect())
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    joined = toxicity.fit(df, lab)
    assert joined.path and not joined.weights and at_once.weights
    assert sorted((repr(r.doc_id), round(r.score, 9), r.predicted) for r in toxicity.score(df, joined).collect()) == want
    kept = toxicity.clean_documents(df, joined)
    assert kept.columns == df.columns and kept.count() == sum(not p for *_, p in want)


def test_ids_with_both_labels_are_toxic(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    both = lab.unionByName(lab.withColumn("toxic", lab.toxic * 0)).unionByName(spark.createDataFrame([(None, 1), (3, None), (3, 7)], lab.schema))
    assert toxicity.fit(df, both).weights == toxicity.fit(df, lab).weights


def test_words_of_every_script():
    assert toxicity.words("Ab, c-D") == [b"ab", b"c", b"d"]
    assert toxicity.words("x很坏的y") == [b"x", *(w.encode() for w in ("很坏", "坏的")), b"y"]
    long = "z" * 100
    assert toxicity.features(long.encode())[0] != toxicity.features((long + "z").encode())[0] and len(toxicity.features(long.encode())[0]) == 17
