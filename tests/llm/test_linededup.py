import hashlib
from collections import defaultdict

import numpy as np
import pytest

from lacuna.llm import linededup, queries, runtime
from lacuna.llm.cuckoo import CuckooFilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, apply_to=None, min_docs=5, min_chars=40):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    keeper = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in apply_to or rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def test_against_brute_force(odd, odd_rows):
    got = linededup.dedup_lines(odd, counts=("found_lines", "found_dropped"))
    rows = sorted(((r.doc_id, r.found_lines, r.found_dropped, r.text or "") for r in got.collect()), key=repr)
    assert rows == brute(odd_rows) and any(r[2] for r in rows)
    assert got.columns[: len(odd.columns)] == odd.columns


def test_empty_table(none):
    assert linededup.dedup_lines(none, counts=()).count() == 0


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, "\n".join(f"{'common' if k % 3 else 'other'} line number {k % (3 + i % 7)} with some more words to be long" for k in range(i % 9))) for i in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_deletion_takes_an_insertion_back(spark, lines):
    rows, docs = lines
    first, second = docs.where("doc_id < 40"), docs.where("doc_id >= 40")
    index = linededup.LineIndex(spark, shards=4).insert(first)
    before = found(index.apply(first))
    index = index.insert(second)
    assert found(index.apply(docs)) == brute(rows)
    index = index.delete(second)
    assert found(index.apply(first)) == before == brute(rows[:40])


def test_filters_are_asked_at_any_size(spark, lines, monkeypatch):
    rows, docs = lines
    index = linededup.LineIndex(spark, shards=4).insert(docs)
    at_once = sorted((bytes(r.key), r.doc_id) for r in index.hits().collect())
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(linededup, "GROUP_REFS", 10)
    assert sorted((bytes(r.key), r.doc_id) for r in index.hits().collect()) == at_once and len(at_once) < index.refs.count()
    assert found(index.apply(docs)) == brute(rows)
    index.filters = index.filters.where("false")
    assert index.hits().count() == 0


def test_shards_follow_the_marked_keys(spark, lines, monkeypatch):
    rows, docs = lines
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    first = linededup.LineIndex(spark, shards=1).insert(docs.where("doc_id < 20"))
    index = first.insert(docs.where("doc_id >= 20"))
    assert index.shards > first.shards and index.marked.count() <= index.shards * 3
    assert found(index.apply(docs)) == brute(rows)


def test_any_column_names(spark, lines):
    rows, docs = lines
    odd = docs.withColumns({c: docs.doc_id for c in ("id", "keys", "__id", "__keys", "id_", "key", "shard")})
    kept = linededup.dedup_lines(odd, counts=("before", "gone"))
    assert kept.columns == [*odd.columns, "before", "gone"]
    assert sorted(((r.doc_id, r.before, r.gone, r.text or "") for r in kept.collect()), key=repr) == brute(rows)


def test_query(spark, small, some_texts):
    got = sorted(map(tuple, queries.op3_line_dedup(spark, small).collect()))
    assert got == sorted((i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in brute(some_texts))


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 256, (20_000, 16), dtype=np.uint8)
    made = CuckooFilter.of(keys[:10_000])
    assert made.contains(keys[:10_000]).all() and made.contains(keys[10_000:]).mean() < 0.01
    made.delete(keys[:5_000])
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert again.contains(keys[5_000:10_000]).all() and again.contains(keys[:5_000]).mean() < 0.01
    assert not CuckooFilter(4).insert(keys[:1000])
