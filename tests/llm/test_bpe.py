import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starmill.llm import bpe

FOLDER = os.path.dirname(bpe.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabularies here")


@pytest.fixture(scope="module")
def mine():
    enc = bpe.encoder(bpe.read_vocabulary())
    return lambda text: [out := [], enc.encode(text, out)][0]


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_defined_cases(mine, known):
    for text in ["", " ", "\n", "a\n\n\tb ", "<|endoftext|>", "é漢🎉‍", "\x1c\x1f x", "don't we'll '", "a" * 50_000, " " * 3000 + "x", "ab" * 20_000, "﻿\r\n", "123456789" * 99]:
        assert mine(text) == known(text)
    assert mine(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(mine, known, text):
    assert mine(text) == known(text)


def test_random_pieces(mine, known):
    r = random.Random(0)
    for _ in range(3000):
        text = "".join(r.choice("etaoin shrdlu\n.,-_'0123EXé ") for _ in range(r.randrange(1, 70)))
        assert mine(text) == known(text)


def test_other_vocabulary():
    import base64

    import tiktoken

    data = bpe.read_vocabulary(f"{FOLDER}/byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    ref = tiktoken.Encoding("own", pat_str=bpe.PIECE, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.encoder(data)
    for text in ["Überlauf im plan-Schritt", "découpage, señal", "проверено трижды", "x += foo(bar[9])"]:
        out = []
        enc.encode(text, out)
        assert out == ref.encode_ordinary(text)


def test_column(spark):
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, None), (3, "", "k"), (3, "hello world", "k")], "doc_id bigint, text string, ids string")
    got = bpe.encode_column(df, ["doc_id"], "text").collect()
    assert [len(r.ids) for r in got] == [2, 0, 0, 2] and got[0].ids == got[3].ids
    assert bpe.encode_column(df.where("false"), ["doc_id"], "text").collect() == []


def test_full_memo_is_emptied(mine, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    enc = bpe.Encoder(bpe.read_vocabulary())
    out = []
    enc.encode("one two three four five six seven eight nine ten xyzzy plugh", out)
    assert out == mine("one two three four five six seven eight nine ten xyzzy plugh") and len(enc.memo) <= 5


def test_round_trip(spark):
    texts = ["hello world", None, "", "Überlauf \u200b 🎉\r\n\t<|endoftext|>", "a" * 100_000, "проверено\x00\x1c x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in bpe.decode_column(bpe.encode_column(df, ["doc_id"], "text"), ["doc_id"]).collect()}
    assert got == {k: t or "" for k, t in enumerate(texts)}
