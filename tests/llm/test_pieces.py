import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

from lacuna.llm import pieces, queries


@pytest.fixture(scope="module")
def codec(sp_model):
    return pieces.Codec(open(sp_model, "rb").read())


@pytest.fixture(scope="module")
def library(sp_model):
    return sentencepiece.SentencePieceProcessor(model_file=sp_model)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), codec.dtype).tolist()


def test_ids_are_the_librarys(spark, odd, odd_rows, sp_model, library):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_ids, bytes(r.ids)) for r in pieces.encode_pieces(odd, sp_model).collect())
    want = sorted((i or 0, len((t or "").encode()), len(e := library.encode(t or "")), np.array(e, "<u2").tobytes()) for i, t in odd_rows)
    assert got == want


def test_round_trip(odd, odd_rows, sp_model):
    back = pieces.decode_pieces(pieces.encode_pieces(odd, sp_model), sp_model, keep=("n_ids",))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in odd_rows)


def test_empty_table(none, sp_model):
    assert pieces.decode_pieces(pieces.encode_pieces(none, sp_model), sp_model).count() == 0


def test_odd_strings(codec, library):
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "梦", "①", "\t", "ing", "▁", "0", "🙂", " " * 19, "\0", "ll", "wor", "ld"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert ids(codec, text) == library.encode(text), text
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text))


def test_stream_gives_the_same_and_keeps_a_bounded_window(sp_model, library, some_texts):
    streaming = pieces.Codec(open(sp_model, "rb").read())
    streaming.units = None
    for _, text in some_texts[:25]:
        assert ids(streaming, text[:4000]) == library.encode(text[:4000])
    long = "abcdefghij" * 3000
    assert ids(streaming, long) == library.encode(long)
    assert streaming.widest <= 4 * streaming.longest
    # The first ids come long before the text has been gone through.
    streaming.widest = 0
    next(streaming.stream(long))
    assert streaming.widest <= 2 * streaming.longest


def test_pairs_are_what_merging_leaves(codec):
    rng = random.Random(2)
    known = list(codec.ids)
    for _ in range(3000):
        left, right = rng.choice(known), rng.choice(known)
        whole = codec.merged(left) == [left] and codec.merged(right) == [right]
        assert codec._side_by_side(left, right) == (whole and codec.merged(left + right) == [left, right]), (left, right)


def proto(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_paths_have_the_best_sum():
    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "aba": -4.0, "ba": -3.0, "▁a": -2.9}
    raw = proto(1, proto(1, b"<unk>") + proto(3, 2)) + b"".join(proto(1, proto(1, p.encode()) + proto(2, s)) for p, s in vocabulary.items())
    codec = pieces.Codec(raw + proto(2, proto(3, 1)) + proto(3, proto(4, 0)))
    rng = random.Random(1)

    def best(text):
        table = [(0.0, [])]
        for n in range(1, len(text) + 1):
            options = [(table[n - k][0] + vocabulary[text[n - k : n]], [*table[n - k][1], text[n - k : n]]) for k in range(1, min(3, n) + 1) if text[n - k : n] in vocabulary]
            table.append(max(options, key=lambda x: x[0]))
        return table[-1][0]

    for _ in range(200):
        text = "▁" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        found = list(codec.stream(text))
        assert "".join(found) == text and sum(vocabulary[p] for p in found) == pytest.approx(best(text))
    assert codec.widest < 60


def test_runs_of_unknown_characters_are_one_id():
    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.5}
    raw = proto(1, proto(1, b"<unk>") + proto(3, 2)) + b"".join(proto(1, proto(1, p.encode()) + proto(2, s)) for p, s in vocabulary.items())
    codec = pieces.Codec(raw + proto(2, proto(3, 1)) + proto(3, proto(4, 0)))
    got = np.frombuffer(codec.encode("aXYZ bQ"), codec.dtype).tolist()
    assert got == [1, 2, 0, 1, 3, 0]


def test_query(spark, small, some_texts, library):
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, small).collect()}
    for i, text in some_texts:
        want = library.encode(text or "")
        assert got[i].n_ids == len(want) and got[i].ids_crc32 == zlib.crc32(np.array(want, "<u2").tobytes())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
