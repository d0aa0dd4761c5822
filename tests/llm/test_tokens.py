import json
import random
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import bytebpe, queries, tokens


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, odd, odd_rows, bpe):
    encode = library(bpe)
    got = tokens.count_tokens(odd, bpe).collect()
    want = [(i, len((t or "").encode()), len(encode(t or ""))) for i, t in odd_rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_sentencepiece_model(spark, odd, odd_rows, sp_model):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp_model)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tokens.count_tokens(odd, sp_model).collect())
    assert got == sorted((i or 0, len(model.encode(t or ""))) for i, t in odd_rows)


def test_empty_table(none, bpe):
    assert tokens.count_tokens(none, bpe).count() == 0


def test_ids_and_counts_on_odd_strings(bpe):
    encode, rng = library(bpe), random.Random(5)
    own = bytebpe.load(open(bpe, "rb").read())
    table = tokens.TwoTier(own, {}, entries=50)
    parts = ["a", "I'll", "'s", "  ", "\n", "\t", "é", "中", "🙂", "12", "३", "<|endoftext|>", "<|end", "!", " ", "　", "\x1c", "ß"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        want = encode(text)
        assert own.encode_array(text).tolist() == want and table.count(text) == len(want), text


def test_frequent_table_holds_lengths_by_frequency(bpe, some_texts):
    own = bytebpe.load(open(bpe, "rb").read())
    texts = [t for _, t in some_texts if t]
    words, lengths = tokens.frequent_table(own, texts, 60_000)
    words, lengths = words.decode(errors="surrogateescape").split("\udcff"), np.frombuffer(lengths, "<u2")
    assert len(words) == len(set(words)) == len(lengths) <= 60_000 and (lengths >= 2).any()
    assert all(own.piece_length(w) == n for w, n in zip(words[::97], lengths[::97]))
    seen = Counter(w for t in texts for w in own.pretokens(t) if len(w) <= 256)
    assert [seen[w] for w in words[: len(seen)]] == sorted(seen.values(), reverse=True)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\u3000"])
def test_long_blank_runs(bpe, blank):
    encode, own = library(bpe), bytebpe.load(open(bpe, "rb").read())
    table = tokens.TwoTier(own, {})
    for text in ("a" + blank * 2_000_000 + "b", blank * 60_000 + "<|endoftext|>" + blank * 60_000, "x" + blank * 50_000 + "é" + blank * 50_001):
        want = encode(text)
        assert own.encode_array(text).tolist() == want and table.count(text) == len(want)


def test_vocabularies_that_need_the_library(bpe, tmp_path, spark):
    spec = json.loads(open(bpe).read())
    spec["model"]["ignore_merges"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bytebpe.ByteBpe(path.read_bytes())
    encode = library(str(path))
    texts = ["the quick brown fox", "unusually", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert [r.n_tokens for r in tokens.count_tokens(df, str(path)).orderBy("doc_id").collect()] == [len(encode(t or "")) for t in texts]


def test_query(spark, small, some_texts, bpe):
    encode = library(bpe)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, small).collect()}
    want = {i: (len((t or "").encode()), len(encode(t or ""))) for i, t in some_texts}
    assert got == {i: (b, n, n > 512) for i, (b, n) in want.items()}
