"""Hierarchical multi-length packing of tokenised documents.

Each document becomes its byte-level BPE ids and an end id. Whole windows of
the longest context are cut off long documents; what is left goes to the
shortest tier that holds it. A tier is packed when its pool has enough for
several windows: largest pieces first, a gap takes the largest piece that
fits from its own tier, then from the shorter tiers, and at last a cut one,
so every window is exactly as long as its tier. What a partition has left at
the end is cut to powers of two. Windows go to step groups of equal token
counts whose attention costs are balanced.

The work is one narrow pass: a task packs the documents that it reads, so no
text or id is shuffled, a lost executor repeats only its own tasks, and a
source with a third of all rows is spread as its files are.

Defined results: a null or empty text is the end id alone; a null doc_id is
kept null; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corvid.llm.common import table

END_ID = 1
TIERS = (256, 512, 1024, 2048)
POOL_WINDOWS = 16
STEP_GROUPS = 8
STEP_WINDOWS = 64
VOCABULARY = "byte_bpe_50k.json"
PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("context", T.LongType()), T.StructField("step_group", T.LongType()),
])


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell the 256 bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(vocabulary_path: str) -> tiktoken.Encoding:
    """The tokenizer file's own vocabulary in the faster of the two BPE libraries.

    A byte-level vocabulary is ranked by id, so both give the same ids; the
    tests hold one against the other. The file's added tokens are known to the
    encoding; whether their strings in a text become their ids is the call's choice.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take white space or need whole words are not supported")
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@dataclass(order=True)
class Piece:
    size: int
    order: int
    doc_id: int | None = field(compare=False)
    start: int = field(compare=False)
    ids: np.ndarray = field(compare=False)
    doc_tokens: int = field(compare=False)

    def cut(self, size: int, order: int) -> tuple[Piece, Piece]:
        return (
            Piece(size, self.order, self.doc_id, self.start, self.ids[:size], self.doc_tokens),
            Piece(self.size - size, order, self.doc_id, self.start + size, self.ids[size:], self.doc_tokens),
        )


class Packer:
    """The pools of one task. Holds at most a few windows' worth of ids per tier."""

    def __init__(self, tiers: tuple[int, ...], task: int):
        self.tiers, self.pools = sorted(tiers), {t: [] for t in tiers}
        self.totals = dict.fromkeys(tiers, 0)
        self.task, self.sequences, self.steps, self.order = task, 0, 0, 0
        self.windows: dict[int, list[list[Piece]]] = {}
        self.rows: list[tuple] = []

    def _next(self) -> int:
        self.order += 1
        return self.order

    def _put(self, piece: Piece) -> None:
        tier = next(t for t in self.tiers if piece.size <= t)
        insort(self.pools[tier], piece)
        self.totals[tier] += piece.size

    def _take(self, tier: int, at: int) -> Piece:
        piece = self.pools[tier].pop(at)
        self.totals[tier] -= piece.size
        return piece

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, n, at = self.tiers[-1], len(ids), 0
        while n - at >= top:
            self._window(top, [Piece(top, self._next(), doc_id, at, ids[at : at + top], n)])
            at += top
        if at < n:
            rest = Piece(n - at, self._next(), doc_id, at, ids[at:].copy() if at else ids, n)
            self._put(rest)
            tier = next(t for t in self.tiers if rest.size <= t)
            if self.totals[tier] >= POOL_WINDOWS * tier:
                while self.totals[tier] >= 2 * tier:
                    self._fill(tier)

    def _fitting(self, tier: int, gap: int) -> Piece | None:
        for t in reversed(self.tiers[: self.tiers.index(tier) + 1]):  # own tier, then shorter ones
            at = bisect_right(self.pools[t], gap, key=lambda p: p.size)
            if at:
                return self._take(t, at - 1)
        return None

    def _fill(self, tier: int) -> None:
        window, gap = [], tier
        while gap:
            piece = self._fitting(tier, gap)
            if piece is None:  # every waiting piece is longer than the gap: cut the shortest
                at = next(t for t in self.tiers if self.pools[t])
                piece, rest = self._take(at, 0).cut(gap, self._next())
                self._put(rest)
            window.append(piece)
            gap -= piece.size
        self._window(tier, window)

    def _window(self, length: int, pieces: list[Piece]) -> None:
        ready = self.windows.setdefault(length, [])
        ready.append(pieces)
        if len(ready) >= STEP_WINDOWS:
            self._step(length)

    def _step(self, length: int) -> None:
        """Deal the ready windows of one length to step groups: as many to each, costs balanced."""
        ready = self.windows.pop(length, [])
        cost = lambda w: sum(p.size * p.size for p in w)
        share = -(-len(ready) // STEP_GROUPS)
        groups = [[0, 0, g] for g in range(STEP_GROUPS)]
        for window in sorted(ready, key=lambda w: (-cost(w), w[0].order)):
            group = min((g for g in groups if g[1] < share), key=lambda g: (g[0], g[1], g[2]))
            group[0] += cost(window)
            group[1] += 1
            self._emit(length, window, (self.task << 32) + self.steps * STEP_GROUPS + group[2])
        self.steps += 1

    def _emit(self, length: int, window: list[Piece], group: int) -> None:
        sequence, offset = (self.task << 32) + self.sequences, 0
        self.sequences += 1
        for p in window:
            crc = zlib.crc32(np.ascontiguousarray(p.ids, dtype="<u4").tobytes())
            self.rows.append((p.doc_id, p.start, p.size, crc, p.doc_tokens, sequence, offset, length, group))
            offset += p.size

    def finish(self) -> None:
        """Everything left, longest windows first; the last ids in ever shorter powers of two."""
        while (left := sum(self.totals.values())) > 0:
            for t in self.tiers[:-1]:  # the longest window may take from every pool
                while self.pools[t] and left >= self.tiers[-1]:
                    piece = self._take(t, 0)
                    insort(self.pools[self.tiers[-1]], piece)
                    self.totals[self.tiers[-1]] += piece.size
            if left >= self.tiers[-1]:
                self._fill(self.tiers[-1])
                continue
            size, window = 1 << (left.bit_length() - 1), []
            gap = size
            while gap:
                at = max(t for t in self.tiers if self.pools[t])
                piece = self._take(at, len(self.pools[at]) - 1)
                if piece.size > gap:
                    piece, rest = piece.cut(gap, self._next())
                    self._put(rest)
                window.append(piece)
                gap -= piece.size
            self._window(size, window)
        for length in sorted(self.windows):
            self._step(length)

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE.names)


def pack_batches(batches: Iterator[pa.RecordBatch], vocabulary_path: str, tiers: tuple[int, ...], added_tokens: bool) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    packer, encode = Packer(tiers, context.partitionId() if context else 0), encoder(vocabulary_path)
    allowed = encode.special_tokens_set if added_tokens else set()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = encode.encode_to_numpy(text.as_py() or "", allowed_special=allowed, disallowed_special=())
            packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
            if len(packer.rows) >= 8192:
                yield packer.drain()
    packer.finish()
    if packer.rows:
        yield packer.drain()


def pack(docs: DataFrame, vocabulary_path: str | None = None, tiers: tuple[int, ...] = TIERS, added_tokens: bool = False) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``; tiers are powers of two, the last the longest context.

    With ``added_tokens`` the vocabulary's added tokens get their ids where
    their strings stand in a text, as the tokenizer file's own library does by
    default; else these strings are text.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    return docs.select("doc_id", "text").mapInArrow(partial(pack_batches, vocabulary_path=path, tiers=tuple(tiers), added_tokens=added_tokens), PIECE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added_tokens=True)
