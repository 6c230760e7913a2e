"""Corpus statistics by chunks of documents.

A chunk is what one file split holds, cut further where that is more than
``CHUNK_BYTES`` of text. Each task reduces a chunk to distinct keys before
anything is shuffled, so a key that stands in a third of all documents costs
one entry per chunk. Keys are 64-bit hashes and the range of hashes is cut
into slots; entries travel as packed arrays, one row per chunk and slot. What
a chunk has to know about its keys comes back the same way and meets the
chunk's documents again.

Chunks and slots are counted from the bytes of text, so a task holds the same
amount at every size of the corpus. Their sizes are parameters: larger ones
need more memory and make fewer of the (chunks times slots) rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import SPACES, as_bytes
from corvid.plans.scratch import materialise

CHUNK_BYTES = 12 << 20
SLOT_BYTES = 16 << 20


@dataclass(frozen=True)
class Volume:
    """Bytes of text and how many chunks they make."""

    bytes: int
    chunks: int

    def slots(self, share: float = 1.0) -> int:
        """Slots of about ``SLOT_BYTES`` for entries of ``share`` times the text's bytes."""
        return max(1, -int(-self.bytes * share // SLOT_BYTES))


def chunked(docs: DataFrame) -> tuple[DataFrame, Volume]:
    """``(chunk, doc_id, text)``, chunks one after the other in each task; rows that do not all come straight from files are written first."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    split = [F.input_file_name().alias("file"), F.input_file_block_start().alias("start")]

    def measured(rows: DataFrame):
        each = rows.select(*split, F.octet_length("text").alias("size")).groupBy("file", "start").agg(F.sum("size").alias("size"))
        return each.agg(F.count("*").alias("splits"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count_if(F.col("file") == "").alias("other")).first()

    size = measured(slim) if slim.inputFiles() else None
    if size is None or size.other:
        slim = materialise(slim, "documents")
        size = measured(slim)
    parts = max(1, -(-size.largest // CHUNK_BYTES))
    chunk = F.xxhash64(F.input_file_name(), F.input_file_block_start(), *([F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))] if parts > 1 else []))
    rows = slim.select(chunk.alias("chunk"), "doc_id", "text")
    return rows.sortWithinPartitions("chunk") if parts > 1 else rows, Volume(size.bytes, max(1, size.splits * parts))


def by_slot(rows: DataFrame, slots: int, *then: str) -> DataFrame:
    """A task for each slot."""
    return rows.repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("slot", *then)


def meet(docs: DataFrame, answers: DataFrame, volume: Volume) -> DataFrame:
    """The chunk's answers (packed arrays), then its documents, in one task and in that order.

    ``docs(chunk, doc_id, text)`` and ``answers(chunk, ...)`` become one table
    with the columns of both; ``part`` is 0 for answers and 1 for documents.
    """
    extra = [c for c in answers.columns if c != "chunk"]
    a = answers.select("chunk", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), *extra)
    d = docs.select("chunk", F.lit(1).alias("part"), "doc_id", "text", *(F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in extra))
    return a.unionByName(d).repartition(2 * volume.chunks, "chunk").sortWithinPartitions("chunk", "part", *(["slot"] if "slot" in extra else []))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Slices of sorted batches by key; each group must be read before the next."""
    state: dict = {"batch": None, "batches": batches}

    def advance() -> bool:
        while state["batch"] is None or not state["batch"].num_rows:
            state["batch"] = next(state["batches"], None)
            if state["batch"] is None:
                return False
        return True

    def group(value: int) -> Iterator[pa.RecordBatch]:
        while advance():
            batch = state["batch"]
            column = batch.column(key).to_numpy(zero_copy_only=False)
            n = int((column == value).argmin()) if not (column == value).all() else len(column)
            if n == 0:
                return
            state["batch"] = batch.slice(n)
            yield batch.slice(0, n)
            if n < len(column):
                return

    while advance():
        value = state["batch"].column(key)[0].as_py()
        yield value, group(value)


def split_parts(group: Iterator[pa.RecordBatch], seen: list[dict]) -> Iterator[pa.RecordBatch]:
    """Puts a chunk's answers into ``seen`` and yields its documents."""
    for batch in group:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        n = int(part.searchsorted(1))
        if n:
            seen += batch.slice(0, n).to_pylist()
        if n < len(part):
            yield batch.slice(n)


def pack(values: np.ndarray) -> bytes:
    """Bytes by significance: of sorted keys, small counts and like numbers most then compress well."""
    if values.itemsize == 1 or not len(values):
        return values.tobytes()
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel() if data else np.zeros(0, dtype)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts, nearly all of them small: a byte each, deflated, and the others after them."""
    small = np.minimum(values, 255).astype(np.uint8)
    return len(values).to_bytes(8, "little") + zlib.compress(small.tobytes() + pack(values[small == 255].astype(np.int64)), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n, rest = int.from_bytes(data[:8], "little"), zlib.decompress(data[8:])
    out = np.frombuffer(rest, np.uint8, n).astype(np.int64)
    out[out == 255] = unpack(rest[n:], "<i8")
    return out


def pack_sums(values: np.ndarray) -> bytes:
    """Numbers of which many are equal: the distinct ones, and for each its number among them."""
    own, codes = np.unique(values, return_inverse=True)
    if len(own) > 65535:
        return bytes(8) + pack(values)
    return len(own).to_bytes(8, "little") + own.tobytes() + zlib.compress(pack(codes.astype(np.uint16)), 1)


def unpack_sums(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return unpack(data[8:], "<f8")
    return np.frombuffer(data, "<f8", n, 8)[unpack(zlib.decompress(data[8 + 8 * n :]), "<u2")]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each stands there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def distinct(keys: np.ndarray) -> np.ndarray:
    return counted(keys)[0]


def cut(keys: np.ndarray, slots: int) -> np.ndarray:
    """Where the range of each slot begins in sorted keys, and the end."""
    return np.r_[keys.searchsorted(np.array([-(-(k << 64) // slots) for k in range(slots)], np.uint64)), len(keys)]


def place(keys: np.ndarray, wanted: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Where each wanted key stands in ``keys`` (sorted, distinct hashes, all wanted ones among them).

    Hashes are even, so within their range the upper bits nearly give the place.
    """
    out = np.empty(len(wanted), np.int32)
    if not len(wanted):
        return out
    low, span = keys[0], int(keys[-1] - keys[0])
    bits = np.uint64(max(0, span.bit_length() - len(keys).bit_length()))
    first = (keys - low).searchsorted(np.arange((span >> int(bits)) + 1, dtype=np.uint64) << bits).astype(np.int32)
    for k in range(0, len(wanted), step):
        part = wanted[k : k + step]
        at = first[(part - low) >> bits]
        behind = np.flatnonzero(keys[at] < part)
        while len(behind):
            at[behind] += 1
            behind = behind[keys[at[behind]] < part[behind]]
        out[k : k + step] = at
    return out


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_ids`` of the words that ``bytes.split`` finds in all texts, and how many each has; XXH64 of all words at once."""
    data = np.frombuffer(b" ".join([*texts, bytes(8)]), np.uint8)  # a lane of eight bytes fits behind every word
    cuts = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    space = _IS_SPACE[data]
    space[len(data) - 8 :] = True
    turns = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = turns[::2], turns[1::2]
    size = ends - starts
    lanes = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    lane = lambda at: lanes[at].view("<u8").ravel()
    h = size.astype(np.uint64) + _P5
    for k in range(3):
        w = np.flatnonzero(size >= 8 * k + 8)
        h[w] = _turned(h[w] ^ (_turned(lane(starts[w] + 8 * k) * _P2, 31) * _P1), 27) * _P1 + _P4
    at, left = starts + (size & ~7), size & 7
    w = np.flatnonzero(left >= 4)
    h[w] = _turned(h[w] ^ ((lane(at[w]) & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at, left = at + (left & 4), left & 3
    for k in range(3):
        w = np.flatnonzero(left > k)
        h[w] = _turned(h[w] ^ (data[at[w] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for w in np.flatnonzero(size >= 32).tolist():  # these have another form
        h[w] = xxhash.xxh64_intdigest(data[starts[w] : ends[w]].tobytes())
    return h, np.diff(starts.searchsorted(cuts), prepend=0)


class Block:
    """The words of several documents one after the other."""

    def __init__(self, doc_ids: list[int | None], texts: list[bytes], words: list[list[bytes]]):
        self.doc_ids, self.texts, self.words = doc_ids, texts, words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = word_ids([w for x in words for w in x])
        self.doc = np.repeat(np.arange(len(words)), self.lengths)


def blocks(batches: Iterator[pa.RecordBatch], words_of: Callable[[bytes], list[bytes]] = bytes.split, limit: int = 150_000) -> Iterator[Block]:
    """Documents in blocks of about ``limit`` words; a longer document is a block of its own."""
    doc_ids, texts, words, n = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            own = words_of(text)
            doc_ids.append(doc_id)
            texts.append(text)
            words.append(own)
            n += len(own)
            if n >= limit or len(words) >= 5000:
                yield Block(doc_ids, texts, words)
                doc_ids, texts, words, n = [], [], [], 0
    if words:
        yield Block(doc_ids, texts, words)
