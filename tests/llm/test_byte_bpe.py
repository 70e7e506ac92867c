"""The encoder against the published library of the same vocabulary, and exact round trips."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tickloom.llm import byte_bpe  # noqa: E402

VOCABULARY = byte_bpe.VOCABULARY
ODD = [
    "",
    "\n\n",
    "a  b\n\n c\r\n\r\nd ",
    "  \t x 　y",
    "1\n00:00:01,000 --> 00:00:02,500\r\nHi there's <|endoftext|>!",
    " 00:00:01,0000 00:00:01.999x",
    "\0a \0",
    "日本語のテキスト。" * 40,
    "😀👍🏽 ’s ''s don't DON'T",
    "x" * 5000,
    " " * 3000,
    "aA1_-" * 700,
    "é̈" * 50,
]


@pytest.fixture(scope="module")
def published():
    tokenizer = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return byte_bpe.Encoder(f.read())


def test_odd_texts(encoder, published):
    assert [list(encoder.encode(t)) for t in ODD] == published(ODD)
    assert [list(encoder.encode(t)) for t in ODD] == published(ODD)  # from what was kept
    assert all(encoder.decode(encoder.encode(t)) == t for t in ODD)


def test_random_texts(encoder, published):
    rng = random.Random(4)
    letters = "ab 's\n\r\t:,.0123456789é日Я->  "
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    assert [list(encoder.encode(t)) for t in texts] == published(texts)


def test_full_tables_of_kept_words(published, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 5)
    with open(VOCABULARY, "rb") as f:
        small = byte_bpe.Encoder(f.read())
    small.words.most = 5
    text = "the quick brown fox jumps over the lazy dog and the quick cat"
    assert [list(small.encode(text)) for _ in range(3)] == published([text] * 3)


def test_whole_table(spark, published):
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()}
    documents = spark.read.parquet(path)
    ids = byte_bpe.encoded(documents)
    assert dict(ids.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    made = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert made == dict(zip(texts, published(list(texts.values())), strict=True))
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decoded(ids).collect()} == texts
    assert {r["doc_id"]: r["n_tokens"] for r in byte_bpe.counted(documents, ["doc_id"]).collect()} == {k: len(v) for k, v in made.items()}


def test_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (1, ""), (1, "a"), (None, "a")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in byte_bpe.encoded(rows).collect()) == [(0, [64]), (1, []), (1, []), (1, [64])]
    assert byte_bpe.encoded(rows.limit(0)).collect() == []
