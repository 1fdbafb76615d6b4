"""Encoding, decoding and counting against the library."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from habitscope.llm import chunk_bpe, token_counts, tokenizer

PATHS = tokenizer.default_paths()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATHS[0])


@pytest.fixture(scope="module")
def tokens():
    return tokenizer.load(PATHS)


def test_every_code_point(library, tokens):
    texts = []
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            texts.append(f"a{c}b 1{c}2 .{c}, {c}{c}x  {c} '{c}s {c}{c}\n{c}")
    for i in range(0, len(texts), 50000):
        part = texts[i : i + 50000]
        for text, want in zip(part, library.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert tokens.encode(text) == want.ids


def test_very_long_runs(library, tokens):
    for text in ("ab" * 70000, " " * 70000 + "x", "é" * 70000):
        assert tokens.encode(text) == library.encode(text, add_special_tokens=False).ids


PIECES = st.sampled_from(["the ", "of", " ", "  ", "\n", "'s", "'ll ", "x", "1", "23", "é", "東京", "🙂", ".", "?! ", " ", "token=", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=60), st.randoms(use_true_random=False), st.integers(0, 100))
def test_joins_are_exact(parts, chance, share):
    """Any cuts between characters, any of the chunks encoded alone."""
    text = "".join(p for p in parts if p != "<|endoftext|>")
    if not text:
        return
    tokens = tokenizer.load(PATHS)
    view = text.encode()
    bounds = [i for i in range(1, len(view)) if (view[i] & 0xC0) != 0x80]
    cuts = [0, *sorted(chance.sample(bounds, min(len(bounds), chance.randint(0, 8)))), len(view)]
    ready = {
        i: np.array(tokens.encode_plain(view[a:b].decode()), np.int64)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if chance.randint(0, 99) < share
    }
    assert chunk_bpe.joined(view, cuts, ready, tokens).tolist() == tokens.encode_plain(text)


def texts():
    chance = random.Random(4)
    word = lambda: "".join(chance.choice("abcdefgéß") for _ in range(chance.randint(1, 9)))
    passage = " ".join(word() for _ in range(900))
    out = []
    for i in range(40):
        own = " ".join(word() for _ in range(chance.randint(0, 300)))
        out.append(own + ["", passage, " <|endoftext|> " + passage[50:], passage + "<|endoftext|>"][i % 4] + own[:100])
    return [*out, out[5], out[5]]


def test_encode_and_decode(spark, library):
    data = list(enumerate(texts()))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in chunk_bpe.decode(chunk_bpe.encode(docs, bits=6)).collect()}
    for number, text in data:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[number].ids, "<u4").tolist() == ids
        assert got[number].decoded == library.decode(ids, skip_special_tokens=False) == text


def test_shared_chunks_are_encoded_once(spark):
    """The owners' table has one row for each chunk that occurs more than once."""
    passage = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(i, passage + f" own{i}") for i in range(12)], "doc_id long, text string")
    tokens = tokenizer.load(PATHS)
    pieces = [chunk_bpe.Pieces((passage + f" own{i}").encode(), tokens, 6) for i in range(12)]
    chunks = [p.view[a:b] for p in pieces for a, b in p.chunks()]
    assert len(set(chunks)) < len(chunks) / 8
    assert chunk_bpe.encode(docs, bits=6).count() == 12


def test_counts_come_from_the_cache(spark, library, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "x <|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.token_counts(first, cache).collect()}
    assert (got[1].n_tokens, got[3].n_tokens, got[3].n_bytes) == (2, 0, 0)
    assert got[4].n_tokens == len(library.encode("x <|endoftext|>", add_special_tokens=False).ids)
    assert spark.read.parquet(cache).count() == 3
    second = spark.createDataFrame([(1, "a b"), (5, "new one")], "doc_id long, text string")
    token_counts.token_counts(second, cache).collect()
    assert spark.read.parquet(cache).count() == 4
    # A stored count is believed, so a changed one shows that nothing was encoded again.
    spark.read.parquet(cache).selectExpr("content", "version", "n_tokens + 100 as n_tokens").write.parquet(cache + "2")
    changed = {r.doc_id: r.n_tokens for r in token_counts.token_counts(second, cache + "2").collect()}
    assert changed == {1: 102, 5: 102}
    limit = token_counts.token_counts(second, cache, limit=1).where("over_limit").count()
    assert limit == 2
