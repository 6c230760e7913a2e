"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Items are few against the corpus, so they are indexed and documents are the
queries: each document is read as overlapping passages, and block-max WAND
gives every item whose BM25 score is a high enough share of the score that
the item gives itself: the least share that an item with 0.8 of its shingles
can have. A retrieved item counts once its five-word shingles
stand in the passage: at least 0.8 of them, and half of its question's and of
its answer's each.

The index is built for items of ``max_bytes`` of text at a time; postings,
block maxima and texts grow with these bytes alone. Each such block is a
broadcast of bounded size and one pass over the documents; document
frequencies cover all items whatever their block. No document is shuffled.

Defined results: null or empty texts match nothing; an item of fewer than five
words has no shingle and matches a document that has its words and no others;
items with equal text are each reported; items of no word match nothing; a null item_id or doc_id stays null; with no items every document
is clean; repeated rows are judged each.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import as_bytes, table

SHINGLE = 5
#: words of documents that are looked up at a time
BLOCK_WORDS = 60_000
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")
MATCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("item_overlap", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()),
])


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    k1: float = 1.2
    b: float = 0.75
    min_overlap: float = 0.8
    min_part: float = 0.5
    band: float = 1.25
    block: int = 2
    max_blocks: int = 64
    max_bytes: int = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORDS).split()


def shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence; in an item of one sentence, its last third."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1 and len(sentences[-1]) >= SHINGLE:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = [w for s in sentences for w in s]
    cut = len(words) - max(SHINGLE, len(words) // 3)
    return words[:cut], words[cut:]


class Index:
    """Inverted index of the items of one length band; impacts are scores as shares of the item's own.

    Items are numbered in order and cut into at most ``max_blocks`` ranges;
    for each term the ranges that have it are listed with its greatest impact
    there. ``least`` is the score that an item with ``min_overlap`` of its
    shingles has at least: each missing term costs a shingle, so at most that
    many of its greatest impacts can be missing. Terms in most items are
    common as long as no item reaches ``least`` by them alone; so a passage
    that has none of the others, the rare ones, holds no item.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], df: dict[bytes, int], n: int, average: float, s: Settings, row: dict[bytes, int]):
        self.row, self.s, self.ids, self.texts = row, s, [], []
        self.lists: dict[bytes, tuple[array, array]] = {}
        self.longest, self.least = 0, 1.0
        for item_id, text in items:
            words = words_of(text)
            idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in set(words)}
            norm = s.k1 * (1 - s.b + s.b * len(words) / average)
            impact = {w: idf[w] * c * (s.k1 + 1) / (c + norm) for w, c in Counter(words).items()}
            own, k = sum(impact.values()), len(self.ids)
            for w, v in impact.items():
                to, shares = self.lists.setdefault(w, (array("i"), array("d")))
                to.append(k)
                shares.append(v / own)
            self.ids.append(item_id)
            self.texts.append(text)
            self.longest = max(self.longest, len(words))
            missing = int((1 - s.min_overlap) * len(shingles(words)) + 1e-9)
            self.least = min(self.least, 1 - sum(sorted(impact.values(), reverse=True)[:missing]) / own)
        self.least = max(self.least - 1e-6, 1e-3)
        self.block = max(s.block, -(-len(self.ids) // s.max_blocks))
        self._maxima()
        self._rare()

    def _maxima(self) -> None:
        self.ranges = -(-len(self.ids) // self.block)
        sizes, found = np.zeros(len(self.row) + 2, np.int64), []
        for w in sorted(self.lists, key=self.row.__getitem__):
            items, shares = self.lists[w]
            blocks = np.array(items) // self.block
            first = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            found.append((blocks[first], np.maximum.reduceat(np.array(shares), first)))
            sizes[self.row[w] + 1] = len(first)
        self.starts = np.cumsum(sizes).astype(np.int32)  # of each word's ranges, by its number
        self.in_range, self.greatest = np.concatenate([x for x, _ in found]).astype(np.int32), np.concatenate([x for _, x in found])
        self.top = np.zeros(len(self.row) + 1)  # each word's greatest impact
        np.maximum.at(self.top, np.repeat(np.arange(len(self.row) + 1), sizes[1:]), self.greatest)

    def _rare(self) -> None:
        reached = np.zeros(len(self.ids))
        self.is_rare = np.zeros(len(self.row) + 1, bool)
        self.is_rare[[self.row[w] for w in self.lists]] = True
        self.is_here = self.is_rare.copy()
        for w in sorted(self.lists, key=lambda w: (-len(self.lists[w][0]), w)):
            items, shares = self.lists[w]
            reached[items] += shares
            if reached[items].max() >= self.least:
                break
            self.is_rare[self.row[w]] = False

    def entries(self, rows: np.ndarray) -> np.ndarray:
        """Places of the ranges of each of ``rows``, one after the other."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        return np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def search(self, terms: list[bytes]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score reaches ``least``."""
        rows = np.fromiter(map(self.row.__getitem__, terms), np.int64, len(terms))
        entry = self.entries(rows)
        open_blocks, found = np.bincount(self.in_range[entry], self.greatest[entry], self.ranges) >= self.least, []
        live = [[0, *self.lists[t], top] for t, top in zip(terms, self.top[rows].tolist(), strict=True)] if open_blocks.any() else []
        while live:
            live.sort(key=lambda c: c[1][c[0]])
            reach, pivot = 0.0, -1
            for k, c in enumerate(live):
                reach += c[3]
                if reach >= self.least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = live[pivot][1][live[pivot][0]]
            if not open_blocks[item // self.block]:  # no item of this range can reach it
                to = (item // self.block + 1) * self.block
                for c in live:
                    c[0] = bisect_left(c[1], to, c[0])
            elif live[0][1][live[0][0]] == item:
                score = 0.0
                for c in live:
                    if c[1][c[0]] != item:
                        break
                    score += c[2][c[0]]
                    c[0] += 1
                if score >= self.least:
                    found.append((item, score))
            else:
                for c in live[:pivot]:
                    c[0] = bisect_left(c[1], item, c[0])
            live = [c for c in live if c[0] < len(c[1])]
        return found

    @property
    def stride(self) -> int:
        return self.longest + self.longest // 8 + 2

    def reachable(self, rows: np.ndarray, place: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and starts of the passages with a rare term in which some range of items can reach ``least`` by its block maxima.

        ``rows`` are the known words of several documents of ``lengths`` words,
        each with its place and document. A passage is two strides long and a
        stride is longer than any item, so every item stands whole in a passage.
        """
        strides = -(-lengths // self.stride) + 1  # one of each document stays empty
        first = np.cumsum(strides) - strides
        own = np.flatnonzero(self.is_here[rows])
        rows, cell = rows[own], first[doc[own]] + place[own] // self.stride
        rare = np.zeros(strides.sum() + 1, bool)
        rare[cell[self.is_rare[rows]]] = True
        of = np.flatnonzero(rare[:-1] | rare[1:])
        document = first.searchsorted(of, "right") - 1
        begin = (of - first[document]) * self.stride
        fits = begin < np.maximum(1, lengths[document] - self.stride)
        of, document, begin = of[fits], document[fits], begin[fits]
        near = np.zeros(len(rare) + 1, bool)
        near[of] = near[of + 1] = True
        own = np.flatnonzero(near[cell])
        rows, cell = rows[own], (np.cumsum(near) - 1)[cell[own]]
        entry = self.entries(rows)
        sums = np.bincount(np.repeat(cell * self.ranges, self.starts[rows + 1] - self.starts[rows]) + self.in_range[entry], self.greatest[entry], near.sum() * self.ranges).reshape(-1, self.ranges)
        k = (np.cumsum(near) - 1)[of]
        enough = (sums[k] + sums[k + 1]).max(axis=1) >= self.least - 1e-9 if len(k) else np.zeros(0, bool)
        return document[enough], begin[enough]

    def best(self, words: list[bytes], begins: list[int]) -> dict[int, tuple[float, float, float, float]]:
        """Items that the document's passages at ``begins`` hold, with score and overlaps (the best of all passages)."""
        best: dict[int, tuple[float, float, float, float]] = {}
        for begin in begins:
            passage = words[begin : begin + 2 * self.stride]
            near = None
            for item, score in self.search(sorted({w for w in passage if w in self.lists})):
                near = shingles(passage) if near is None else near
                question, answer = question_and_answer(self.texts[item])
                share = [len(p & near) / len(p) if p else 1.0 for p in map(shingles, (words_of(self.texts[item]), question, answer))]
                if share[0] >= self.s.min_overlap and min(share[1:]) >= self.s.min_part:
                    best[item] = max(best.get(item, (0.0,)), (score, *share))
        return best


class Searcher:
    """The indexes of all length bands over one vocabulary; bands keep passages close to their items' length."""

    def __init__(self, items: list[tuple[int | None, bytes]], df: dict[bytes, int], n: int, average: float, s: Settings):
        by: dict[int, list[tuple[int | None, bytes]]] = {}
        self.short: dict[tuple[bytes, ...], list[int | None]] = {}
        for x in items:
            words = words_of(x[1])
            if len(words) >= SHINGLE:
                by.setdefault(int(math.log(len(words)) / math.log(s.band)), []).append(x)
            elif words:
                self.short.setdefault(tuple(words), []).append(x[0])
        self.row = {w: k + 1 for k, w in enumerate(sorted({w for own in by.values() for _, t in own for w in words_of(t)}))}
        self.bands = [Index(by[k], df, n, average, s, self.row) for k in sorted(by)]

    def matches(self, text: bytes) -> list[tuple[int | None, float, float, float, float]]:
        """``(item_id, score, overlaps)`` of every item that the text holds."""
        return next(self.matches_of([text]))

    def matches_of(self, texts: Iterable[bytes]) -> Iterator[list[tuple[int | None, float, float, float, float]]]:
        """``matches`` of each text; texts of about ``BLOCK_WORDS`` words share the look at block maxima."""
        block, n = [], 0
        for text in texts:
            block.append(words_of(text))
            n += len(block[-1])
            if n >= BLOCK_WORDS or len(block) >= BLOCK_WORDS:
                yield from self._matches(block)
                block, n = [], 0
        yield from self._matches(block)

    def _matches(self, block: list[list[bytes]]) -> Iterator[list[tuple[int | None, float, float, float, float]]]:
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        rows = np.fromiter(map(self.row.get, chain.from_iterable(block), repeat(0)), np.int64, lengths.sum())
        known = np.flatnonzero(rows)
        doc = np.repeat(np.arange(len(block)), lengths)[known]
        rows, place = rows[known], known - (np.cumsum(lengths) - lengths)[doc]
        begins: list[dict[int, list[int]]] = []
        for band in self.bands:
            begins.append({})
            for k, begin in zip(*map(np.ndarray.tolist, band.reachable(rows, place, doc, lengths)), strict=True):
                begins[-1].setdefault(k, []).append(begin)
        for k, words in enumerate(block):
            if len(words) < SHINGLE:
                yield [(x, 1.0, 1.0, 1.0, 1.0) for x in self.short.get(tuple(words), ())]
            else:
                yield [(band.ids[x], *v) for band, own in zip(self.bands, begins, strict=True) if k in own for x, v in sorted(band.best(words, own[k]).items())]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _distinct_words(text: pa.Array) -> pa.Array:
    return pa.array([sorted({w.decode("utf-8", "replace") for w in words_of(x)}) for x in as_bytes(text)], pa.list_(pa.string()))


@F.arrow_udf(T.LongType())
def _count_words(text: pa.Array) -> pa.Array:
    return pa.array([len(words_of(x)) for x in as_bytes(text)], pa.int64())


def indexes(benchmark: DataFrame, s: Settings = Settings()) -> Iterator[Searcher]:
    """The index of each block of items with about ``max_bytes`` of text; one block for a usual benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.avg(_count_words("text")).alias("average"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size.n:
        return
    blocks = max(1, -(-size.bytes // s.max_bytes))
    terms = items.select("item_id", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"), "text")
    words = terms.select("block", F.explode(_distinct_words("text")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    for k in range(blocks):
        own = terms.where(F.col("block") == k).select("item_id", "text").orderBy("item_id", "text").toArrow()
        df = counts.join(words.where(F.col("block") == k).select("word").distinct(), "word").toArrow()
        frequency = dict(zip(as_bytes(df["word"]), df["df"].to_pylist(), strict=True))
        yield Searcher(list(zip(own["item_id"].to_pylist(), as_bytes(own["text"]), strict=True)), frequency, size.n, size.average or 1.0, s)


def _searcher(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64()] * 2 + [pa.float64()] * 4

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), shared.value.matches_of(as_bytes(batch.column("text"))), strict=True):
                rows += [(doc_id, *x) for x in own]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=MATCH.names)

    return search


def _holder(shared: Broadcast):
    @F.arrow_udf(T.BooleanType())
    def holds(text: pa.Array) -> pa.Array:
        return pa.array([bool(x) for x in shared.value.matches_of(as_bytes(text))], pa.bool_())

    return holds


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document and item that it holds, with score and overlaps."""
    spark = docs.sparkSession
    found = [docs.select("doc_id", "text").mapInArrow(_searcher(spark.sparkContext.broadcast(index)), MATCH) for index in indexes(benchmark, s)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MATCH)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that hold a test item; a filter, nothing moves."""
    for index in indexes(benchmark, s):
        holds = _holder(docs.sparkSession.sparkContext.broadcast(index))
        docs = docs.where(~holds(F.col("text")))
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
