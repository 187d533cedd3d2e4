from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import bpe as B

CONTENT = open(B.VOCABULARY, "rb").read()
ENCODER = B.encoder(CONTENT)


def ids(text):
    return np.frombuffer(ENCODER.encode(text), "<i4").tolist()


def reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


ODD = "aA 0'\n\t\x1c\x85　é漢😀tsrevmld.,;_﻿​<|>="


@given(st.text(max_size=80) | st.text(alphabet=ODD, max_size=80))
@settings(max_examples=400, deadline=None)
def test_equals_a_public_encoder(text):
    assert ids(text) == reference().encode_ordinary(text)


@given(st.binary(min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_prefixes_equal_merging_by_rank(raw):
    assert ENCODER.prefixes(raw) == ENCODER.merge(raw)


def test_compatible_pairs():
    r = random.Random(0)
    for _ in range(5000):
        n = r.choice([300, 2000, 50256])
        pair = r.randrange(n), r.randrange(n)
        assert ENCODER._compatible(pair) == (ENCODER.merge(ENCODER.token[pair[0]] + ENCODER.token[pair[1]]) == list(pair))


def test_long_texts_and_special_strings():
    for text in ("a" * 30_000, " " * 5000 + "x", "=" * 3000, "ab" * 20_000, "<|endoftext|>", "word " * 20_000):
        assert ids(text) == reference().encode_ordinary(text)


def test_forgetting_keeps_results(monkeypatch):
    small = B.Encoder(ENCODER.ranks)
    small.words.limit = small.piece.limit = small.compatible.limit = small.halves.limit = 3
    text = "The quick brown fox; jumps_over 123 lazy dogs. " * 3 + "Ünïcödé 漢字"
    assert small.encode(text) == ENCODER.encode(text) and len(small.words) <= 3


def test_round_trip_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = B.encode(docs).select("text", "ids").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert b"".join(ENCODER.token[i] for i in r.ids).decode() == (r.text or "")


def test_columns_nulls_and_empty(spark):
    rows = [(1, None, "x", 1), (2, "", None, 2), (3, "  ", "z", 3), (3, "  ", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, tokens int")
    out = B.encode(df)
    assert out.columns == ["doc_id", "text", "tokens", "ids"]
    found = sorted((r.doc_id, r.ids) for r in out.collect())
    assert found == [(1, []), (2, []), (3, ids("  ")), (3, ids("  "))]
    assert {r.doc_id: r.tokens for r in B.count_tokens(df).collect()} == {1: 0, 2: 0, 3: len(ids("  "))}
    assert B.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        B.encode(df, ids="text")


def test_a_vocabulary_without_a_byte_is_refused():
    ranks = {k: v for k, v in ENCODER.ranks.items() if k != b"q"}
    with pytest.raises(ValueError, match="113"):
        B.Encoder(ranks)
