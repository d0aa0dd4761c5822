import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lacuna.llm import cutting, packing, queries


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def check(pieces, rows, encode, sequence, slack):
    docs = defaultdict(list)
    sequences = defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        docs[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in rows:
        ids = encode(t or "") + [0]
        want[i, len(ids)].append(ids)
    assert docs.keys() == want.keys()
    for k, parts in docs.items():
        if len(want[k]) == 1:
            whole = [x for _, ids in sorted(parts) for x in ids]
            assert whole == want[k][0] and [s for s, _ in sorted(parts)] == np.cumsum([0, *(len(i) for _, i in sorted(parts))])[:-1].tolist()
        else:
            assert sorted(x for _, ids in parts for x in ids) == sorted(x for ids in want[k] for x in ids)
    fill = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
        fill.append(at)
    assert sum(f < sequence - slack for f in fill) <= 1


def test_every_id_lies_in_one_piece(spark, odd, odd_rows, bpe):
    check(packing.pack(odd, bpe).collect(), odd_rows, library(bpe), 1024, packing.SLACK)


@pytest.mark.parametrize("sequence, buffer", [(16, 1 << 20), (256, 5_000), (1024, 1 << 22)])
def test_little_padding(spark, some_texts, bpe, sequence, buffer):
    df = spark.createDataFrame(some_texts, "doc_id long, text string").repartition(5)
    check(packing.pack(df, bpe, sequence=sequence, buffer=buffer).collect(), some_texts, library(bpe), sequence, packing.SLACK)


def test_without_broadcast(spark, some_texts, bpe, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame(some_texts, "doc_id long, text string").repartition(3)
    check(packing.pack(df, bpe).collect(), some_texts, library(bpe), 1024, packing.SLACK)


def test_query(spark, small, some_texts, bpe):
    encode = library(bpe)
    got = sorted(queries.op7_packing(spark, small).collect(), key=lambda r: (r.doc_id, r.start))
    assert got[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = {i: [*encode(t or ""), 0] for i, t in some_texts}
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in ids.items()}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert sorted(used) == list(range(len(used))) and sum(n < 1024 - packing.SLACK for n in used.values()) <= 1


def test_empty_table(none, bpe):
    assert packing.pack(none, bpe).count() == 0


def test_knapsack_is_optimal():
    rng = random.Random(0)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 20), 4)))
        prices = np.array([rng.random() for _ in lengths])
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - n] + p for n, p in zip(lengths, prices) if n <= c)])
        value, items = cutting.knapsack(lengths, prices, 30)
        assert value == pytest.approx(best[30]) == pytest.approx(prices[items].sum()) and lengths[items].sum() <= 30


def test_columns_cover_the_demand_in_no_more_bins_than_greedily():
    rng = random.Random(1)
    demand = {n: rng.randint(1, 200) for n in rng.sample(range(1, 100), 40)}
    columns = cutting.generate_columns(demand, 100)
    for n, d in demand.items():
        assert sum(p.get(n, 0) * u for p, u in columns) == pytest.approx(d)
    assert all(sum(k * n for k, n in p.items()) <= 100 for p, _ in columns)
    greedy = sum(t for _, t, _ in cutting.falling_patterns(demand, 100, whole=False))
    assert sum(n * d for n, d in demand.items()) / 100 - 1e-6 <= sum(u for _, u in columns) <= greedy + 1e-6


def test_known_optimum():
    # Six-unit bins: 4+2 and 3+3 fit exactly.
    columns = cutting.generate_columns({4: 10, 3: 8, 2: 10}, 6)
    assert sum(u for _, u in columns) == pytest.approx(14)
    used = cutting.plan({4: 10, 3: 8, 2: 10}, 6, 0)
    assert sum(t for _, t in used) == 14


def test_plan_never_exceeds_the_demand():
    rng = random.Random(2)
    for _ in range(50):
        demand = {n: rng.randint(1, 5) for n in rng.sample(range(1, 64), rng.randint(1, 20))}
        for slack in (0, 4):
            used = cutting.plan(demand, 64, slack)
            for n, d in demand.items():
                assert sum(p.get(n, 0) * t for p, t in used) <= d
            assert all(64 - slack <= sum(k * n for k, n in p.items()) <= 64 for p, _ in used)
