"""Encoding of text with a public byte-level BPE, exact and in linear time.

The vocabulary's byte strings are read as Latin-1 and put, reversed, into an Aho-Corasick automaton; one pass over
a reversed piece gives the longest token that starts at each byte.  The encoder takes the longest token that is
compatible with the one before it, where two tokens are compatible if merging by rank would leave them side by
side; if none is, it steps back.  A place where a step back happened is never tried again, so the work is linear.
Compatibility of pairs is memoised, and so are the ids of words.

The tables are built once a Python worker from the vocabulary file's bytes, which the driver reads and
broadcasts (under 1 MB).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's publisher cuts a text into pieces.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the memo of words and of pieces; a full memo is emptied.
MEMO = 400_000


class Encoder:
    """Encodes text by a vocabulary of byte strings with ranks, as given in a .tiktoken file."""

    def __init__(self, vocabulary: bytes, piece: str = PIECE):
        self.ids = {base64.b64decode(word).decode("latin-1"): int(rank) for word, rank in map(bytes.split, vocabulary.splitlines()) if word}
        self.words = {i: w for w, i in self.ids.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        automaton = ahocorasick.Automaton()
        for word, i in self.ids.items():
            automaton.add_word(word[::-1], i)
            if len(word) > 1 and (halves := self._halves(word, i)):
                self.split[i] = halves
                self.merged[halves] = i
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = {i: self._prefix(word) for word, i in self.ids.items()}
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile(piece).findall
        self.segments = re.compile(r"\s*\S+|\s+").findall
        self.odd_space = re.compile("[\x1c-\x1f]").search

    def _halves(self, word: str, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``word``: merge its bytes by all smaller ranks."""
        ids, parts = self.ids, list(word)
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = ids.get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ids[parts[0]], ids[parts[1]]

    def _prefix(self, word: str) -> int | None:
        for n in range(len(word) - 1, 0, -1):
            if (i := self.ids.get(word[:n])) is not None:
                return i
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side.

        Merges are undone one at a time, the latest of the two sides first.  A pair across the border that
        merges by a rank before the merge last undone would have been merged first.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        limit, fits = 1 << 60, True
        a, b = left, right
        while True:
            together = self.merged.get((a, b))
            if together is not None and together < limit:
                fits = False
                break
            cut_a, cut_b = self.split.get(a), self.split.get(b)
            if cut_a is None and cut_b is None:
                break
            # of equal merges the left one comes first, so the right one is undone first
            if cut_b is None or (cut_a is not None and a > b):
                limit, a = a, cut_a[1]
            else:
                limit, b = b + 1, cut_b[0]
        if len(self.fits) >= MEMO:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece."""
        word = piece.encode().decode("latin-1") if not piece.isascii() else piece
        if (whole := self.ids.get(word)) is not None:
            return (whole,)
        n = len(word)
        longest: list[int | None] = [None] * n
        for end, i in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if longest[at] is None or len(self.words[i]) > len(self.words[longest[at]]):
                longest[at] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else None
            while token is not None:
                end = at + len(self.words[token])
                if not dead[end] and (before is None or self.compatible(before, token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            elif before is None:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.words[token])
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.cut(word):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(p) < 64:
                    if len(self.pieces) >= MEMO:
                        self.pieces.clear()
                    self.pieces[p] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str | None, out: list[int]) -> None:
        """Append the ids of ``text``; null and empty texts have none.

        No piece begins with a non-space and goes on over a space, so a text can be cut before each run of
        white space, and the cuts be looked up.
        """
        if not text:
            return
        if self.odd_space(text):  # these are spaces to Python's re, but not to the pieces
            out += self._word(text)
            return
        memo, word = self.memo, self._word
        for w in self.segments(text):
            ids = memo.get(w)
            if ids is None:
                ids = word(w)
                if len(w) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = ids
            out += ids


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_column(df: DataFrame, keys: list[str], text: str, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(keys..., ids array<int>): the ids of ``text`` without special tokens.

    What looks like a special token is ordinary text.  Null and empty texts give an empty list.  One pass in
    Arrow batches; no shuffle.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(len(keys)):
                enc.encode(t.as_py(), flat)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], names=[*keys, ids])

    return df.select(*keys, text).mapInArrow(run, schema)


def decode_column(df: DataFrame, keys: list[str], ids: str = "ids", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(keys..., text): the texts of lists of ids; a null or empty list gives an empty text.

    Bytes that are no UTF-8, as parts of a list may be, become replacement characters.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary.value).words
        for batch in batches:
            texts = ["".join(map(words.__getitem__, x or ())).encode("latin-1").decode("utf-8", "replace") for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string())], names=[*keys, text])

    return df.select(*keys, ids).mapInArrow(run, schema)
