"""Problem 6: encoding of a whole corpus with a public byte-level BPE tokenizer, and decoding.

A word's symbols form a doubly linked list. A priority queue holds the ranks of its possible merges, leftmost first among
equals; an entry whose left symbol has gone, or whose pair has changed since, is stale and skipped. Words repeat, so each Python
worker keeps a bounded table of the words it has encoded. Documents are encoded one by one in Arrow batches without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickloom.llm.workers import kept

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts a text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and pieces of text, of which a Python worker keeps the encoding; beyond that it starts afresh.
KEPT_WORDS = 200_000
#: Longest piece that is kept, in characters.
KEPT_LENGTH = 40
#: A time such as a subtitle's, after white space.
_CLOCK = re.compile(r"\s*[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}")


def read_ranks(text: bytes) -> dict[bytes, int]:
    """Symbol to rank (and id) from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    symbol = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(ranks[word[i : i + 2]], i, 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(queue)
    while queue:
        _, i, size = heappop(queue)
        j = after[i]
        if symbol[i] is None or j >= n or len(symbol[i]) + len(symbol[j]) != size:
            continue  # stale
        symbol[i], symbol[j] = symbol[i] + symbol[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pair = symbol[i] + symbol[k]
            if pair in ranks:
                heappush(queue, (ranks[pair], i, len(pair)))
        h = before[i]
        if h >= 0:
            pair = symbol[h] + symbol[i]
            if pair in ranks:
                heappush(queue, (ranks[pair], h, len(pair)))
    out, i = [], 0
    while i < n:
        out.append(ranks[symbol[i]])
        i = after[i]
    return out


class Words(dict):
    """Word to ids, filled on demand and emptied when full."""

    def __init__(self, ranks: dict[bytes, int], most: int = KEPT_WORDS):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, word: str) -> array:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = array("i", merge(word.encode("utf-8", "surrogatepass"), self.ranks))
        return ids


class Encoder:
    def __init__(self, vocabulary: bytes):
        self.ranks = read_ranks(vocabulary)
        self.words = Words(self.ranks)
        self.find = regex.compile(PATTERN).findall
        self.symbols = {i: s for s, i in self.ranks.items()}
        self.pieces: dict[str, array] = {}

    def _piece(self, piece: str) -> array:
        ids, words = array("i"), self.words
        for word in self.find(piece):
            ids.extend(words[word])
        if len(piece) <= KEPT_LENGTH and not piece[-1].isspace():
            if len(self.pieces) >= KEPT_WORDS:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        """Ids without special tokens; their strings in a text are ordinary text.

        No word reaches from another character over a blank or line feed that follows it, so a text is cut there and pieces are
        looked up whole; a piece that ends in white space is joined with the next one."""
        out, known, rest, clock = array("i"), self.pieces.get, "", _CLOCK.fullmatch
        extend = out.extend
        if "\0" in text:
            pieces = [text]
        else:
            marked = text.replace("\n", "\0\n").replace(" ", "\0 ")
            pieces = (marked.replace("\r", "\0\r") if "\r" in marked else marked).split("\0")
        for piece in pieces:
            if rest:
                piece, rest = rest + piece, ""
            ids = known(piece)
            if ids is None:
                if not piece or piece[-1].isspace():
                    rest = piece
                    continue
                if clock(piece):  # a digit and a mark never share a word, so the parts are looked up
                    at = len(piece)
                    for part in (piece[: at - 10], piece[at - 10 : at - 7], piece[at - 7 : at - 4], piece[at - 4 :]):
                        extend(known(part) or self._piece(part))
                    continue
                ids = self._piece(piece)
            extend(ids)
        if rest:
            extend(self._piece(rest))
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in a row; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.symbols.__getitem__, ids)).decode("utf-8", "replace")


def _shared(df: DataFrame, vocabulary: str):
    """A function that gives a worker's encoder. The vocabulary file, under a megabyte, goes to the executors as a broadcast."""
    content = Path(vocabulary).read_bytes()
    key = ("byte_bpe", hashlib.sha256(content).hexdigest())
    sent = df.sparkSession.sparkContext.broadcast(content)
    return lambda: kept(key, lambda: Encoder(sent.value))


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, ids array<int>) of every row of ``df``, in whole texts; ``[]`` for empty and null texts. Repeated keys stay rows."""
    encoder = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(encode(t))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def counted(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (bigint), 0 for empty and null texts."""
    encoder = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder().count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    types = dict(df.dtypes)
    return df.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens bigint"]))


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, text) of every row; null ids give a null text."""
    encoder = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder().decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
