"""Evaluation texts leaking into training text, by a distributed positional inverted index.

``build_index`` makes the index, of training text alone: every word of every document is posted, so that any test set
can be asked of it.  It is cut into segments of whole documents, about SEGMENT_WORDS words each.  In a segment all
documents stand in one line of positions, GAP apart; a row of the index is a term with its positions in a segment
(ascending, as differences), rows are sorted by term, and one row more names the segment's documents and where each
begins.  No task holds more than a segment.

``search`` asks the index.  The rows of the test set's terms come together by segment, the only shuffle; there each
window of ``need`` words of an item starts from the list of its rarest term, shifted by the term's offset, and is
intersected with the other lists from rare to common; what is left are the places of the item in the segment.
``search_near`` does so with lists of positions near the rarest term's, for words in any order and with others between.

The test set goes to the tasks in blocks of at most BLOCK_WORDS words, so what is sent is bounded whatever its size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.session import scratch_path

#: Words after which a segment is closed; a longer document is a segment of its own.
SEGMENT_WORDS = 1_000_000
#: Positions between two documents of a segment: no match spans them.
GAP = 64
#: Most words of test items that are sent to the tasks at once.
BLOCK_WORDS = 1_000_000
#: Zero-width characters, byte-order mark and soft hyphen.
_DROPPED = re.compile("[­᠎​-‏⁠-⁤﻿]")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")

Items = list[tuple[object, list[str]]]
Match = tuple[int, int, int]


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits after dropping zero-width characters, NFKC and case folding."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", _DROPPED.sub("", text)).casefold())


# ---------------------------------------------------------------- the index


def index_schema(key: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    return T.StructType([T.StructField("segment", T.StringType()), T.StructField("term", T.StringType()), T.StructField("positions", ints), T.StructField("docs", T.ArrayType(key)), T.StructField("starts", ints)])


def _segment(name: str, docs: list, texts: list[list[str]], doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of one segment."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    starts = first + GAP * np.arange(len(texts))
    coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy()
    at = (np.arange(len(codes)) + np.repeat(starts - first, lengths))[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    steps = np.diff(at, prepend=0)
    heads = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    steps[heads] = at[heads]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(steps, pa.int32()))
    ranks = pa.compute.sort_indices(coded.dictionary)
    terms, lists = coded.dictionary.take(ranks), lists.take(ranks)
    names = ["segment", "term", "positions", "docs", "starts"]
    ints, keys = pa.list_(pa.int32()), pa.list_(doc_type)
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, ints), pa.array([docs], keys), pa.array([starts.tolist()], ints)], names=names)
    for k in range(0, len(terms), 8192):
        part = terms[k : k + 8192]
        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(part)), part, lists[k : k + 8192], pa.nulls(len(part), keys), pa.nulls(len(part), ints)], names=names)


def index_rows(df: DataFrame, key: str, text: str, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The rows of the index, see above; documents without a word are in no segment."""
    schema = index_schema(df.schema[key].dataType)
    doc_type = pa.string() if isinstance(df.schema[key].dataType, T.StringType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        docs, texts, held, done = [], [], 0, 0
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := words_of(t.as_py()):
                    docs.append(doc)
                    texts.append(words)
                    held += len(words)
                if held >= segment_words:
                    yield from _segment(f"{TaskContext.get().partitionId()}-{done}", docs, texts, doc_type)
                    docs, texts, held, done = [], [], 0, done + 1
        if docs:
            yield from _segment(f"{TaskContext.get().partitionId()}-{done}", docs, texts, doc_type)

    return df.select(key, text).mapInArrow(run, schema)


def build_index(df: DataFrame, key: str, text: str, path: str | None = None, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Write the index of ``df`` to ``path`` (a fresh one in the shared folder by default) and read it."""
    path = path or scratch_path(df.sparkSession, "index")
    rows = index_rows(df, key, text, segment_words)
    rows.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


class Postings:
    """The lists of one segment: positions by term, and the document at a position."""

    def __init__(self, table: pa.Table):
        terms = table["term"].combine_chunks()
        lists = table["positions"].combine_chunks()
        self.flat, self.ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        self.rows = {t: k for k, t in enumerate(terms.to_pylist()) if t is not None}
        head = terms.is_null().to_numpy(zero_copy_only=False).nonzero()[0]
        self.docs = table["docs"][int(head[0])].values if len(head) else pa.array([], pa.int64())
        self.starts = table["starts"][int(head[0])].values.to_numpy() if len(head) else np.empty(0, np.int32)
        self.known: dict[str, np.ndarray] = {}

    def size(self, term: str) -> int:
        k = self.rows.get(term)
        return 0 if k is None else int(self.ends[k + 1] - self.ends[k])

    def of(self, term: str) -> np.ndarray:
        if term not in self.known:
            k = self.rows[term]
            self.known[term] = np.cumsum(self.flat[self.ends[k] : self.ends[k + 1]], dtype=np.int64)
        return self.known[term]

    def doc_at(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in an ascending list."""
    k = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return held[k] == values


def _whole_windows(sizes: np.ndarray, need: int) -> np.ndarray:
    """Starts of the windows all of whose terms are in the segment."""
    if len(sizes) < need:
        return np.empty(0, np.int64)
    gaps = np.concatenate([[0], np.cumsum(sizes == 0)])
    return np.flatnonzero(gaps[need:] == gaps[:-need])


def phrase_matches(held: Postings, items: Items, need: int) -> Iterator[Match]:
    """(document number, item number, words): where ``need`` or more consecutive words of an item stand."""
    for number, (_, words) in enumerate(items):
        sizes = np.array([held.size(w) for w in words], dtype=np.int64)
        starts = _whole_windows(sizes, need)
        if not len(starts):
            continue
        rarest = np.array([w + int(np.argmin(sizes[w : w + need])) for w in starts.tolist()])
        places, k = [], 0
        while k < len(starts):
            # windows in a row with one rarest term are asked at once by the words they share, at least half of each
            z = k + 1
            while z < len(starts) and rarest[z] == rarest[k] and starts[z] == starts[z - 1] + 1 and z - k < max(1, need // 2):
                z += 1
            core = np.arange(starts[z - 1], starts[k] + need)
            anchor = int(rarest[k])
            at = held.of(words[anchor]) - anchor
            for off in core[np.argsort(sizes[core], kind="stable")].tolist():
                if not len(at):
                    break
                if off != anchor:
                    at = at[_among(at + off, held.of(words[off]))]
            places.append(at)
            k = z
        at = np.unique(np.concatenate(places))
        now = best = np.zeros(len(at), dtype=np.int64)
        middle = np.zeros(len(at), dtype=np.int64)
        for off, word in enumerate(words if len(at) else ()):
            hit = _among(at + off, held.of(word)) if sizes[off] else np.zeros(len(at), dtype=bool)
            now = np.where(hit, now + 1, 0)
            middle = np.where(now > best, at + off, middle)
            best = np.maximum(best, now)
        good = best >= need
        for doc, n in zip(held.doc_at(middle[good]).tolist(), best[good].tolist(), strict=True):
            yield doc, number, n


def near_matches(held: Postings, items: Items, need: int, reach: int) -> Iterator[Match]:
    """(document number, item number, words): the shortest stretch of at most ``reach`` words that holds all terms of a
    window of ``need`` consecutive words of an item, in any order, each as often as the window has it."""
    for number, (_, words) in enumerate(items):
        sizes = np.array([held.size(w) for w in words], dtype=np.int64)
        for w in _whole_windows(sizes, need).tolist():
            wanted = Counter(words[w : w + need])
            terms = sorted(wanted, key=held.size)
            at = held.of(terms[0])
            for term in terms[1:]:
                if not len(at):
                    break
                other = held.of(term)
                k = np.searchsorted(other, at - (reach - 1))
                at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= at + (reach - 1))]
            for p in at.tolist():
                if (n := _shortest(held, wanted, p, reach)) is not None:
                    yield int(held.doc_at(np.array([p]))[0]), number, n


def _shortest(held: Postings, wanted: Counter, p: int, reach: int) -> int | None:
    """Length of the shortest stretch round position ``p`` with all terms wanted; None if it is longer than ``reach``."""
    seen = []
    for term in wanted:
        every = held.of(term)
        a, z = np.searchsorted(every, [p - reach + 1, p + reach])
        seen += [(int(x), term) for x in every[a:z]]
    seen.sort()
    left, lacking, first, best = dict(wanted), sum(wanted.values()), 0, None
    for x, term in seen:
        lacking -= left[term] > 0
        left[term] -= 1
        while not lacking:
            y, drop = seen[first]
            if y <= p <= x and x - y < reach:
                best = x - y + 1 if best is None else min(best, x - y + 1)
            left[drop] += 1
            lacking += left[drop] > 0
            first += 1
    return best


# ---------------------------------------------------------------- asking it


def item_blocks(items: DataFrame, key: str, text: str, need: int, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items of at least ``need`` words in blocks of at most ``block_words`` words (or one item)."""
    block, held = [], 0
    for item, t in items.select(key, text).toLocalIterator():
        words = words_of(t)
        if len(words) < need:
            continue
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    if block:
        yield block


def _asked_of_segment(shared: Broadcast, match: Callable[[Postings, Items], Iterator[Match]], kinds: list[pa.DataType]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        held, items = Postings(table), shared.value
        found = list(match(held, items))
        docs = held.docs.take(pa.array([d for d, _, _ in found], pa.int64()))
        return pa.table([docs.cast(kinds[0]), pa.array([items[i][0] for _, i, _ in found], kinds[1]), pa.array([n for *_, n in found], pa.int32())], names=["doc", "item", "n_words"])

    return run


def _ask(index: DataFrame, items: DataFrame, item_key: str, item_text: str, need: int, match: Callable[[Postings, Items], Iterator[Match]], best: Callable, block_words: int) -> DataFrame:
    spark = index.sparkSession
    doc_type, item_type = index.schema["docs"].dataType.elementType, items.schema[item_key].dataType
    schema = T.StructType([T.StructField("doc", doc_type), T.StructField("item", item_type), T.StructField("n_words", T.IntegerType())])
    kinds = [pa.string() if isinstance(t, T.StringType) else pa.int64() for t in (doc_type, item_type)]
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, item_key, item_text, need, block_words):
        shared = spark.sparkContext.broadcast(block)
        asked = spark.createDataFrame([(w,) for w in sorted({w for _, words in block for w in words})], "term string")

        rows = index.where("term IS NOT NULL").join(asked, "term", "left_semi").select(*index.columns).unionByName(index.where("term IS NULL"))
        out = out.unionByName(rows.groupBy("segment").applyInArrow(_asked_of_segment(shared, match, kinds), schema))
    return out.groupBy("doc", "item").agg(best("n_words").alias("n_words"))


def search(index: DataFrame, items: DataFrame, item_key: str, item_text: str, need: int = 12, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, n_words): documents that hold ``need`` or more consecutive words of an item, and the most they hold.

    Null and empty texts hold nothing; items of fewer than ``need`` words are never found.  Words repeated in an
    item or a document are told apart by position.  Of repeated documents or items of one key the most counts.
    """
    return _ask(index, items, item_key, item_text, need, lambda held, block: phrase_matches(held, block, need), F.max, block_words)


def search_near(index: DataFrame, items: DataFrame, item_key: str, item_text: str, need: int = 12, reach: int = 18, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, n_words): documents with a stretch of at most ``reach`` words that holds ``need`` consecutive words of
    an item in any order, and the shortest such stretch.  reach is at most GAP."""
    if reach > GAP:
        raise ValueError(f"reach is at most {GAP}")
    return _ask(index, items, item_key, item_text, need, lambda held, block: near_matches(held, block, need, reach), F.min, block_words)


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, need: int = 12) -> DataFrame:
    """``search`` in an index built for it."""
    return search(build_index(docs, doc_key, doc_text), items, item_key, item_text, need)
