"""Substring dedup: repeated phrases of 13 words, located by Aho-Corasick automata.

A phrase counts as repeated for a document if its 13 words also start in a
document with a smaller id; every word that such a phrase covers is removed.

1. Anchors. The smallest hash of the five-word sequences in a window is its
   anchor; equal windows have equal anchors. Anchors of at least two different
   texts are found over all chunks.
2. Phrases. Only windows with such an anchor can recur. Their 128-bit keys
   confirm, over all chunks, which of them stand in a smaller document; a chunk
   is told a place of each such phrase in its own texts and the smallest id.
3. Automata. The chunk reads the confirmed phrases' words at those places and
   compiles five words of each, its pivot, into automata of at most
   ``MAX_PIVOTS``, four letters a word. All its documents are streamed through
   each; the words around every hit are compared with the phrases, and those
   under a phrase go. Nothing else is looked at, so what no automaton hits stays.

Exact copies of a whole text are not compared phrase by phrase: all but the
one with the smallest id lose every word, if there are 13.

Defined results: a null or empty text has no words and keeps the empty text;
fewer than 13 words are kept; rows that repeat an id do not remove each
other's words and are judged each by its own text; a null id is never smaller,
so such a row keeps its words and removes none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import chunks
from corvid.llm.common import as_bytes, table
from corvid.plans.scratch import discard, materialise, release

PHRASE = 13
GRAM = 5
MAX_PIVOTS = 25_000
#: a word of an automaton is spelled in so many letters of an alphabet of that size, since a node looks through its children
LETTERS, ALPHABET = 4, 32
FLUSH = 1_500_000
#: bytes of anchors and of phrases in a task, by bytes of text
SHARES = (0.8, 2.0)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NO_ID = np.int64(2**63 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(ids: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    n = max(0, len(ids) - size + 1)
    key = ids[:n].copy()
    for k in range(1, size):
        key = key * by + ids[k : k + n]
    return _mixed(key)


def text_key(text: bytes) -> int:
    """Spark's xxhash64 of the text."""
    return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))


def windows(block: chunks.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the block's windows, where each one's anchor is, and all gram hashes."""
    n = len(block.ids) - PHRASE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(block.doc[:n] == block.doc[PHRASE - 1 :])
    grams = _rolled(block.ids, GRAM, _A)
    at = sliding_window_view(grams, PHRASE - GRAM + 1)[:n].argmin(axis=1)[starts] + starts
    return starts, at, grams


def _lowest(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (possibly two-part) keys in order with the least ``low`` and greatest ``high``; also a place of each."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, low, high, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), order[first]


def _sent(chunk: int, slots: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Columns, sorted by the hashes in the first, one row per slot."""
    cuts = chunks.cut(next(iter(columns.values())), slots)
    full = np.flatnonzero(np.diff(cuts)).tolist()
    data = [pa.array([chunks.pack(v[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([chunk] * len(full), pa.int64()), *data], names=["slot", "chunk", *columns])


def _anchors(block: chunks.Block) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a block, and which document each stands in."""
    _, at, grams = windows(block)
    at = at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])] if len(at) else at
    return grams[at], block.doc[at]


def chunk_anchors(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Per chunk: distinct anchors with the least and greatest hash of a text that has them."""
    for chunk, group in chunks.runs(batches, "chunk"):
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for block in chunks.blocks(group):
            anchors, doc = _anchors(block)
            found.append((anchors, np.fromiter((xxhash.xxh64_intdigest(t) for t in block.texts), np.uint64, len(block.texts))[doc]))
        anchors, texts = (np.concatenate(x) for x in zip(*found, strict=True))
        (anchors,), low, high, _ = _lowest([anchors], texts, texts)
        yield _sent(chunk, slots, {"anchors": anchors, "low": low, "high": high})


def recurring_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slot: which of each chunk's anchors stand in two texts or more, in the chunk's order."""
    for slot, group in chunks.runs(batches, "slot"):
        sent = [(r["chunk"], *(chunks.unpack(r[c], "<u8") for c in ("anchors", "low", "high"))) for b in group for r in b.to_pylist()]
        _, anchors, low, high = zip(*sent, strict=True)
        distinct, least, most, _ = _lowest([np.concatenate(anchors)], np.concatenate(low), np.concatenate(high))
        again = (least != most).astype(np.uint8)
        answers = [chunks.pack(again[chunks.place(distinct[0], own)]) for own in anchors]
        yield pa.RecordBatch.from_arrays([pa.array([slot] * len(sent), pa.int64()), pa.array([r[0] for r in sent], pa.int64()), pa.array(answers, pa.binary())], names=["slot", "chunk", "again"])


def chunk_phrases(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Per chunk: windows with a recurring anchor, by key, with the least and greatest id and a place in the chunk."""

    def emit(chunk: int, found: list) -> pa.RecordBatch:
        a, b, doc, text, at = (np.concatenate(x) for x in zip(*found, strict=True))
        (a, b), low, high, first = _lowest([a, b], doc, doc)
        return _sent(chunk, slots, {"a": a, "b": b, "low": low, "high": high, "text": text[first], "at": at[first]})

    for chunk, group in chunks.runs(batches, "chunk"):
        answers: list[dict] = []
        docs = list(chunks.split_parts(group, answers))  # the chunk's texts as they came; words are read twice
        again = np.concatenate([np.zeros(0, np.uint8), *(chunks.unpack(r["again"], "u1") for r in answers)]) > 0
        distinct = chunks.distinct(np.concatenate([np.zeros(0, np.uint64), *(_anchors(block)[0] for block in chunks.blocks(iter(docs)))]))
        recurring = distinct[again]
        found, held = [], 0
        for block in chunks.blocks(iter(docs)) if len(recurring) else ():
            starts, at, grams = windows(block)
            anchor = grams[at]
            starts = starts[recurring[np.minimum(recurring.searchsorted(anchor), len(recurring) - 1)] == anchor]
            ids = np.array([_NO_ID if d is None else d for d in block.doc_ids], np.int64)[block.doc[starts]]
            known = ids != _NO_ID
            starts, ids = starts[known], ids[known]
            doc = block.doc[starts]
            text = np.fromiter(map(text_key, block.texts), np.int64, len(block.texts))[doc]
            found.append((_rolled(block.ids, PHRASE, _A)[starts], _rolled(block.ids, PHRASE, _B)[starts], ids, text, (starts - block.starts[doc]).astype(np.int32)))
            held += len(starts)
            if held >= FLUSH:
                yield emit(chunk, found)
                found, held = [], 0
        if held:
            yield emit(chunk, found)


def confirmed_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slot: phrases that some chunk has in a document above the first, told to that chunk as a place and the first id."""
    for slot, group in chunks.runs(batches, "slot"):
        sent = [r for b in group for r in b.to_pylist()]
        a, b = (np.concatenate([chunks.unpack(r[c], "<u8") for r in sent]) for c in ("a", "b"))
        low, high, text = (np.concatenate([chunks.unpack(r[c], "<i8") for r in sent]) for c in ("low", "high", "text"))
        at = np.concatenate([chunks.unpack(r["at"], "<i4") for r in sent])
        row = np.repeat(np.arange(len(sent)), [len(r["at"]) // 4 for r in sent])
        order = np.lexsort([b, a])
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        begin = np.flatnonzero(new)
        first = np.empty_like(low)
        first[order] = np.repeat(np.minimum.reduceat(low[order], begin), np.diff(np.r_[begin, len(a)]))
        out = []
        for k, r in enumerate(sent):
            mine = np.arange(*row.searchsorted([k, k + 1]))
            mine = mine[high[mine] > first[mine]]
            mine = mine[np.lexsort([at[mine], text[mine]])]
            if len(mine):
                out.append((slot, r["chunk"], *(chunks.pack(x[mine]) for x in (text, at, first))))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["slot", "chunk", "texts", "at", "first"])


class Phrases:
    """A chunk's confirmed phrases, read from its own texts at the places told: words as numbers, and the first id of each."""

    def __init__(self, answers: list[dict], docs: list[pa.RecordBatch]):
        self.numbers: dict[bytes, int] = {}
        text, first = (np.concatenate([np.zeros(0, np.int64), *(chunks.unpack(r[c], "<i8") for r in answers)]) for c in ("texts", "first"))
        at = np.concatenate([np.zeros(0, np.int32), *(chunks.unpack(r["at"], "<i4") for r in answers)])
        order = np.argsort(text, kind="stable")
        text, first, at = text[order], first[order], at[order]
        wanted, words, ids = set(chunks.distinct(text).tolist()), [np.zeros((0, PHRASE), np.int32)], [np.zeros(0, np.int64)]
        for batch in docs if wanted else ():
            for data in as_bytes(batch.column("text")):
                if (key := text_key(data)) in wanted:
                    wanted.remove(key)
                    own = slice(*text.searchsorted([key, key + 1])) if key < _NO_ID else slice(text.searchsorted(key), None)
                    words.append(sliding_window_view(self.numbered(data.split(), grow=True), PHRASE)[at[own]])
                    ids.append(first[own])
        self.words, self.first = np.concatenate(words), np.concatenate(ids)

    def numbered(self, words: list[bytes], grow: bool = False) -> np.ndarray:
        """Numbers of words; 0 for one that is in no phrase's text."""
        if grow:
            return np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int32)
        get = self.numbers.get
        return np.array([get(w, 0) for w in words], np.int32)

    def pivots(self) -> np.ndarray:
        """Distinct pivots: of each phrase, the five words with the smallest hash."""
        if not len(self.words):
            return np.zeros((0, GRAM), np.int32)
        numbers = self.words.astype(np.uint64)
        grams = sum(numbers[:, k : k + PHRASE - GRAM + 1] * _A ** np.uint64(k) for k in range(GRAM))
        at = _mixed(grams + _B).argmin(axis=1)
        found = {x.tobytes() for x in self.words[np.arange(len(at))[:, None], at[:, None] + np.arange(GRAM)]}
        return np.frombuffer(b"".join(sorted(found)), np.int32).reshape(-1, GRAM)

    def shards(self, size: int) -> Iterator[tuple[ahocorasick.Automaton, np.ndarray]]:
        """Automata of at most ``size`` pivots, each with the spelling of every word number."""
        pivots = self.pivots()
        for at in range(0, len(pivots), size):
            part = pivots[at : at + size]
            used = chunks.distinct(part.ravel())
            spelling = np.full((len(self.numbers) + 1, LETTERS), ord("~"), np.uint8)  # all words in no pivot of this shard
            spelling[used] = (np.arange(len(used))[:, None] // ALPHABET ** np.arange(LETTERS)) % ALPHABET + ord("0")
            spelled, wide = spelling[part].tobytes().decode("ascii"), GRAM * LETTERS
            shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for k in range(len(part)):
                shard.add_word(spelled[k * wide : (k + 1) * wide])
            shard.make_automaton()
            yield shard, spelling


def occurrences(phrases: Phrases, words: np.ndarray, size: int = MAX_PIVOTS, step: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where a phrase stands in a stream of word numbers, and its first id: around the pivots that the automata hit, words are compared."""
    if not len(phrases.words):
        return
    wide = PHRASE * 4
    known = dict(zip(map(bytes, np.ascontiguousarray(phrases.words).view(np.uint8).reshape(-1, wide)), phrases.first.tolist(), strict=True))
    window = sliding_window_view(words, PHRASE) if len(words) >= PHRASE else np.zeros((0, PHRASE), np.int32)
    near = np.zeros(len(words), bool)  # starts of phrases that may have a pivot which was hit
    for shard, spelling in phrases.shards(size):
        ends = np.fromiter((end for end, _ in shard.iter(spelling[words].tobytes().decode("ascii"))), np.int64)
        pivot = (ends[(ends + 1) % LETTERS == 0] + 1) // LETTERS - GRAM  # words begin at every fourth letter
        for back in range(PHRASE - GRAM + 1):
            near[np.maximum(pivot - back, 0)] = True
    starts = np.flatnonzero(near[: len(window)])
    for k in range(0, len(starts), step):
        part = starts[k : k + step]
        data = np.ascontiguousarray(window[part]).tobytes()
        first = np.array([known.get(data[n * wide : (n + 1) * wide], _NO_ID) for n in range(len(part))], np.int64)
        hit = first != _NO_ID
        yield part[hit], first[hit]


def remove_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: compile automata of its confirmed phrases, stream all its documents through, remove what they hit."""
    for _, group in chunks.runs(batches, "chunk"):
        answers: list[dict] = []
        docs = list(chunks.split_parts(group, answers))
        phrases = Phrases(answers, docs)
        answers.clear()
        texts = [t for batch in docs for t in as_bytes(batch.column("text"))]
        doc_ids = [d for batch in docs for d in batch.column("doc_id").to_pylist()]
        numbers = [phrases.numbered(t.split()) for t in texts]
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        starts, stream = np.cumsum(lengths) - lengths, np.concatenate([np.zeros(0, np.int32), *numbers])
        del numbers
        doc, ids = np.repeat(np.arange(len(lengths)), lengths), np.array([-_NO_ID if d is None else d for d in doc_ids], np.int64)
        edge = np.zeros(len(stream) + 1, np.int32)
        for at, first in occurrences(phrases, stream):
            at = at[(doc[at] == doc[at + PHRASE - 1]) & (first < ids[doc[at]])]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + PHRASE, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for k in range(0, len(texts), 1000):
            yield _kept(doc_ids[k : k + 1000], texts[k : k + 1000], starts[k : k + 1000].tolist(), gone)


_KEPT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _kept(doc_ids: list[int | None], texts: list[bytes], starts: list[int], gone: np.ndarray) -> pa.RecordBatch:
    rows = []
    for doc_id, text, start in zip(doc_ids, texts, starts, strict=True):
        words = text.split()
        own = gone[start : start + len(words)]
        kept = [w for w, g in zip(words, own.tolist(), strict=True) if not g] if own.any() else words
        joined = b" ".join(kept)
        rows.append((doc_id, text_key(text), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEPT, strict=True)], schema=_KEPT)


def dedup_phrases(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)``, one row per document; kept is the words left, UTF-8."""
    source, volume = chunks.chunked(docs)
    few, many = (volume.slots(x) for x in SHARES)
    anchors = source.mapInArrow(partial(chunk_anchors, slots=few), "slot long, chunk long, anchors binary, low binary, high binary")
    recurring = materialise(chunks.by_slot(anchors, few).mapInArrow(recurring_anchors, "slot long, chunk long, again binary"), "anchors")
    release(docs.sparkSession)
    phrases = chunks.meet(source, recurring, volume).mapInArrow(partial(chunk_phrases, slots=many), "slot long, chunk long, a binary, b binary, low binary, high binary, text binary, at binary")
    confirmed = materialise(chunks.by_slot(phrases, many).mapInArrow(confirmed_phrases, "slot long, chunk long, texts binary, at binary, first binary"), "phrases")
    discard(recurring)
    release(docs.sparkSession)
    kept = chunks.meet(source, confirmed, volume).mapInArrow(remove_phrases, "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return kept.join(whole_copies(docs), ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.when(_gone(), F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(_gone(), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(_gone(), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def _gone():
    return F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= PHRASE)


def whole_copies(docs: DataFrame) -> DataFrame:
    """Rows, by id and text, whose text a smaller id has too, with ``copy`` true."""
    ids = materialise(docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.sha2("text", 256).alias("text_sha")), "texts")
    first = materialise(ids.groupBy("text_sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("text_sha", "first"), "copies")
    return materialise(ids.join(first, "text_sha").where("doc_id > first").select("doc_id", "text_key").distinct(), "copies").withColumn("copy", F.lit(True))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_phrases(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, w[i:i + 12] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS f FROM wins GROUP BY k),
gone AS (SELECT DISTINCT wins.doc_id, i + o AS p FROM wins JOIN firsts USING (k), range(0, 13) t(o) WHERE f < wins.doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
