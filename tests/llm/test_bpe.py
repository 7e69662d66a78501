import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tastegrid.llm import bpe

from .helpers import docs, prose


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.RANKS_NAME), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def spec():
    return bpe.default_spec()


def texts():
    rnd = random.Random(3)
    odd = ["", None, " ", "  a", "<|endoftext|> x", "naïve café\n\n日本語 😀👍🏽", "a" * 30_000, "\x00\x01 ﻿", "it's we'll 12 ½"]
    return odd + [prose(rnd, n) for n in (1, 5, 4_000)] + ["".join(chr(rnd.choice([32, 10, 97, 233, 0x3042, 0x1F600, 39, 115]))
                                                                  for _ in range(40)) for _ in range(200)]


def test_encode_equals_tiktoken_and_decodes(spark, spec, reference):
    rows = list(enumerate(texts()))
    df = docs(spark, rows)
    got = bpe.decode(bpe.encode(df, *spec, offsets=True), spec[0]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]][1] or ""
        ids = reference.encode_ordinary(text)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == text.encode() and r["decoded_text"] == text
        assert len(r["starts"]) == len(r["ends"]) == len(ids)
        for i, a, b in zip(ids, r["starts"], r["ends"]):
            # a token's bytes lie within the characters it is said to touch
            assert reference.decode_single_token_bytes(i) in text[a:b].encode()


def test_query_digests(spark, reference):
    rows = list(enumerate(texts()))
    for r in bpe.round_trip(docs(spark, rows)).collect():
        text = rows[r["doc_id"]][1] or ""
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["same_text"]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_split_characters_lose_nothing(spark, spec, reference):
    # cutting the ids inside a character leaves bytes that are no character
    text = "😀"
    ids = np.array(reference.encode_ordinary(text), "<u4")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids[:1].tobytes()), (2, ids.tobytes()), (3, None)], "k int, ids binary")
    got = {r["k"]: r for r in bpe.decode(df, spec[0]).collect()}
    assert "�" in got[1]["decoded_text"] and got[2]["decoded_text"] == text and bytes(got[3]["decoded"]) == b""


def test_empty_table_repeats_and_clashing_names(spark, spec):
    assert bpe.encode(docs(spark, []), *spec).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 5), (1, "a b", "x", 5), (None, None, "y", 6)],
                               "doc_id bigint, text string, ids string, n_tokens int")
    got = bpe.encode(df, *spec)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens"] and dict(got.dtypes)["ids"] == "binary"
    assert sorted(r["n_tokens"] for r in got.collect()) == [0, 2, 2]
