import random

import numpy as np
import pytest
from sqlcheck import same_as_sql

from lacuna.llm import jaccard, queries
from lacuna.llm.graph import components


def test_query_matches_sql(spark, duck, small):
    assert same_as_sql(queries.op6_ngram_jaccard(spark, small), duck, queries.OP6_SQL)


def sets_of(rows, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in rows:
        w = (t or "").translate(low).encode().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def families(seed, n_families, copies, edit):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_families):
        base = rng.choices(words, k=rng.choice([3, 8, 30, 90, 250]))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // edit))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_against_brute_force(spark, odd_rows, n, percent):
    rows = families(n, 60, 6, 25) + [(None if i is None else i + 100_000, t) for i, t in odd_rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cluster string").repartition(4)
    assert found(jaccard.jaccard_classes(df, n, percent)) == brute(rows, n, percent)


def test_large_clusters_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(text)))
    # Documents that share a long passage but aren't near copies, and chains that only link through neighbours.
    rows += [(200 + i, " ".join(base[:80] + [f"y{i}_{k}" for k in range(40)])) for i in range(30)]
    chain = [f"c{i}" for i in range(400)]
    rows += [(400 + i, " ".join(chain[4 * i : 4 * i + 200])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.jaccard_classes(df, 4, 85)) == brute(rows, 4, 85)


def test_empty_table(none):
    assert jaccard.jaccard_classes(none).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        bands = jaccard.Bands(percent)
        for _ in range(300):
            n = int(rng.integers(5, 400))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = int(rng.integers(0, max(1, n * (100 - percent) // 100 + 1)))
            more = int(rng.integers(0, max(1, n // 10)))
            b = np.unique(np.r_[rng.choice(a, len(a) - gone, replace=False), rng.integers(0, 2**64, more, dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
                assert np.intersect1d(bands.keys(a), bands.keys(b)).size


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (2, text + " more"), (2, text + " more"), (None, text), (5, ""), (6, None), (7, "other words entirely here now")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row long")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sum(1 for r in kept.collect() if r.text and "w1" in r.text) == 1
    assert {r.doc_id for r in kept.collect()} >= {5, 6, 7}


def test_without_broadcasts(spark, monkeypatch):
    from lacuna.llm import runtime

    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", -1)
    rows = families(9, 40, 6, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard.jaccard_classes(df, 4, 85)) == brute(rows, 4, 85)


def test_rows_without_ids_and_with_one_id(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        text = list(base)
        text[rng.randrange(60)] = f"x{i % 200}"
        rows.append((None if i % 2 else 7, " ".join(text)))
    rows.append((3, "of its own " * 20))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard.jaccard_classes(df, 4, 85)) == brute(rows, 4, 85)


def test_large_stars(spark):
    edges = [(1_000_000 + i, i % 3) for i in range(3000)] + [(2_000_000 + i, 1_000_000 + i) for i in range(500)] + [(0, 1)]
    want = {n: 0 if c < 2 else 2 for n, c in [(x, i % 3) for i in range(3000) for x in ((1_000_000 + i), i % 3)]}
    want |= {2_000_000 + i: want[1_000_000 + i] for i in range(500)}
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_components_without_broadcasts(spark, monkeypatch):
    from lacuna.llm import runtime

    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    test_large_stars(spark)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 4), (3, 1), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 30 for i in range(30, 36)}


def test_number_of_links(spark, monkeypatch, odd_rows):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = families(3, 20, 6, 25) + [(None if i is None else i + 100_000, t) for i, t in odd_rows]
    for i in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((5000 + i, " ".join(text)))
    sets = sets_of(rows, 4)
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    n_links = [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_links(df, 4, 85)
    want = sorted(((doc, len(s), m) for (doc, _), s, m in zip(rows, sets, n_links)), key=repr)
    assert found(got.select("doc_id", "n_shingles", "n_links")) == want
    assert found(got.select("doc_id", "n_shingles", "component_id")) == brute(rows, 4, 85)


def test_keys_move_once_however_many_are_shared(spark, monkeypatch):
    from lacuna.llm import runtime

    rng = random.Random(8)
    rows = []
    for i in range(400):
        base = [f"w{rng.randrange(10_000)}" for _ in range(80)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join([*base[:40], "x", *base[41:]]))] if i % 4 else [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base))]
    rows += [(10_000 + i, " ".join(f"v{rng.randrange(10_000)}" for _ in range(80))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = runtime.materialize(jaccard.shingle_sets(df, 4, 85, "doc_id", "text"), "shingle-sets")
    nodes = {}
    for r in sets.collect():
        for key in r["keys"] or []:
            nodes.setdefault(key, set()).add(r.node)
    want = {(k, n) for k, found in nodes.items() if len(found) > 1 for n in found}
    assert len(want) > 2000
    # The second has too little room for its keys and the third none, as where they are past any broadcast.
    for room, most in ((1 << 20, 0.05), (2400, 0.5), (-1, 1)):
        monkeypatch.setattr(jaccard, "BROADCAST_BYTES", room)
        met = {tuple(r) for r in jaccard.meetings(sets).collect()}
        assert want <= met and len(met - want) <= most * sum(map(len, nodes.values()))
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 1 << 20)
    sides = []
    monkeypatch.setattr(jaccard, "join_counted", lambda left, *rest: sides.append(left.count()) or runtime.join_counted(left, *rest))
    assert jaccard.candidate_clusters(sets, 85).count() >= 600
    assert max(sides) < 0.5 * sum(map(len, nodes.values()))


def test_scratch_tables_go_when_rows_are_chosen(spark):
    from lacuna.llm import runtime

    before = set(runtime._written)
    df = spark.createDataFrame([(i, " ".join(f"w{i % 7}_{k}" for k in range(30))) for i in range(40)], "doc_id long, text string")
    assert jaccard.one_of_each(df).count() == 7
    assert not [x for x in runtime._written if x not in before and "shingle-sets" in x]
