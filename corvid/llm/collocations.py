"""Phrase collocations: frequent phrases whose parts seldom meet otherwise.

Three steps over the corpus, all by chunks (some thousand rows of one file in
one language; a chunk does not depend on how Spark splits the file):

1. Each chunk adds its phrases of one to five words to a sketch, an array of
   cells that grows with the corpus. The cells are summed by ranges; a cell's
   sum is an upper bound of each of its phrases' frequencies.
2. A chunk's candidates are its phrases whose cells, and those of all their
   parts, reach the threshold. They compile into Aho-Corasick automata of
   phrases guarded by a space on both sides, and the chunk's pieces stream
   through; the automata count every match, overlapping ones too. Sums over
   chunks are exact frequencies of all phrases that reach the threshold.
3. Scores, containment and ranks are joins and windows over those phrases.

Sketch collisions only add candidates, never lose one, and words are compared
in full by the automata, so hashes decide nothing.

Defined results: null texts are empty; a null language is ``und``, together
with rows that say so; repeated rows count each; a text of any length is one
document (it may make its chunk larger); an empty table, or one without
frequent phrases, gives no rows. Only ``lang`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.llm import chunks
from corvid.llm.common import as_bytes, table
from corvid.plans.scratch import discard, materialise

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: text of a chunk, by the rows' average
CHUNK_BYTES = 8 << 20
#: cells of a range of the sketch, and bytes of text for each cell
SLOT_CELLS = 1 << 22
CELL_BYTES = 8
#: phrases of one automaton
MAX_PHRASES = 200_000

GUARD, END = b" ", b"\n"
_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text, A-Z lower-cased."""
    return filter(None, map(bytes.split, _CUT.split(text.lower())))


def _mixed(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(30))) * _B
    key = (key ^ (key >> np.uint64(27))) * _C
    return key ^ (key >> np.uint64(31))


class Stream:
    """The pieces of several texts one after the other, each closed by ``END``, which no piece has as a word."""

    def __init__(self, texts: list[bytes], lang: str):
        self.words: list[bytes] = []
        for text in texts:
            for piece in pieces(text):
                self.words += piece
                self.words.append(END)
        numbers = {w: k for k, w in enumerate(dict.fromkeys([END, *self.words]))}
        self.distinct = list(numbers)
        self.numbers = np.fromiter(map(numbers.__getitem__, self.words), np.int64, len(self.words))
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        self.hashes = chunks.word_ids(self.distinct) + self.seed

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one to five words: places where so many stand in one piece, and the keys of these phrases."""
        inside = self.numbers != 0
        at, key = np.flatnonzero(inside), np.zeros(0, np.uint64)
        for k in range(LONGEST):
            if k:
                longer = np.flatnonzero(inside[np.minimum(at + k, len(inside) - 1)] & (at + k < len(inside)))
                at, key = at[longer], key[longer] * _A + self.hashes[self.numbers[at[longer] + k]]
            else:
                key = self.hashes[self.numbers[at]].copy()
            yield at, _mixed(key + np.uint64(k))


def cells_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """Cell of each key: the range in the upper bits, the cell within it in the lower ones."""
    slot = ((keys >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    return slot * np.uint64(SLOT_CELLS) + (keys & np.uint64(SLOT_CELLS - 1))


def _gaps(cells: np.ndarray) -> bytes:
    return chunks.pack(np.diff(cells, prepend=np.uint32(0)).astype(np.uint32))


def _ungapped(data: bytes) -> np.ndarray:
    return np.cumsum(chunks.unpack(data, "<u4"), dtype=np.uint32)


_SKETCH = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])


def sketch(batches: Iterator[pa.RecordBatch], slots: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``(slot, chunk, cells, counts)`` of the phrases of each chunk; a chunk may come in parts."""
    held: dict[tuple[int, str], list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (chunk, lang), texts in held.items():
            found = np.concatenate([cells_of(key, slots) for _, key in Stream(texts, lang).grams()])
            cells, counts = chunks.counted(found)
            edges = cells.searchsorted(np.arange(slots + 1, dtype=np.uint64) * np.uint64(SLOT_CELLS))
            rows = [
                (slot, chunk, _gaps((cells[a:b] - np.uint64(slot * SLOT_CELLS)).astype(np.uint32)), chunks.pack_counts(counts[a:b]))
                for slot, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SKETCH, strict=True)], schema=_SKETCH)
        held.clear()

    for batch in batches:
        for chunk, lang, text in zip(batch.column("chunk").to_pylist(), batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            held.setdefault((chunk, lang), []).append(text)
            size += len(text)
            if size >= limit:
                yield from flush()
                size = 0
    yield from flush()


_HEAVY = pa.schema([("chunk", pa.int64()), ("slot", pa.int64()), ("cells", pa.binary())])


def heavy_cells(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk's cells in a range, those whose sum over all chunks reaches the threshold."""
    for slot, group in chunks.runs(batches, "slot"):
        total, held = np.zeros(SLOT_CELLS, np.int64), []
        for batch in group:
            for chunk, cells, counts in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[_ungapped(cells)] += chunks.unpack_counts(counts)
                held.append((chunk, cells))
        heavy = total >= at_least
        for chunk, cells in held:
            own = _ungapped(cells)
            own = own[heavy[own]]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((chunk, slot, _gaps(own)), _HEAVY, strict=True)], schema=_HEAVY)


class Heavy:
    """A chunk's heavy cells; a table over the lower bits answers most questions before the search."""

    def __init__(self, answers: list[dict]):
        own = [_ungapped(r["cells"]).astype(np.uint64) + np.uint64(r["slot"] * SLOT_CELLS) for r in answers]
        self.cells = chunks.distinct(np.concatenate([np.zeros(0, np.uint64), *own]))
        self.low = np.zeros(SLOT_CELLS, bool)
        self.low[self.cells & np.uint64(SLOT_CELLS - 1)] = True

    def has(self, cells: np.ndarray) -> np.ndarray:
        out = self.low[cells & np.uint64(SLOT_CELLS - 1)]
        maybe = np.flatnonzero(out)
        found = self.cells.searchsorted(cells[maybe])
        out[maybe] = self.cells[np.minimum(found, len(self.cells) - 1)] == cells[maybe] if len(self.cells) else False
        return out


def candidates(stream: Stream, heavy: Heavy, slots: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Numbers of the words that may be frequent, and for each length one place of every candidate phrase."""
    n = len(stream.numbers)
    words, places = np.zeros(0, np.int64), []
    number = np.full(n + 1, -1, np.int64)  # of the candidate of the length before that starts here
    for k, (at, key) in enumerate(stream.grams(), 1):
        if k > 1:
            may = (number[at] >= 0) & (number[at + 1] >= 0)
            at, key = at[may], key[may]
        at = at[heavy.has(cells_of(key, slots))]
        own = stream.numbers[at] if k == 1 else number[at] << 32 | stream.numbers[at + k - 1]  # equal for equal words only
        distinct, first, which = np.unique(own, return_index=True, return_inverse=True)
        number = np.full(n + 1, -1, np.int64)
        number[at] = which
        if k == 1:
            words = distinct
        else:
            places.append((k, at[first]))
    return words, places


def automata(phrases: list[bytes], size: int) -> Iterator[ahocorasick.Automaton]:
    """Automata of at most ``size`` phrases; a phrase has a guard on both sides, so it matches whole words only."""
    for k in range(0, len(phrases), size):
        shard = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases[k : k + size], k):
            shard.add_word((GUARD + phrase + GUARD).decode("latin-1"), i)
        shard.make_automaton()
        yield shard


def guarded(words: list[bytes], step: int = 100_000) -> Iterator[str]:
    """Texts of about ``step`` words, cut between pieces, every word with a guard on both sides."""
    start = 0
    while start < len(words):
        end = words.index(END, min(start + step, len(words)) - 1) + 1
        yield (GUARD + GUARD.join(words[start:end]) + GUARD).decode("latin-1")
        start = end


def count_matches(phrases: list[bytes], words: list[bytes], size: int) -> Counter[int]:
    """How often each phrase stands in the pieces, overlapping matches included."""
    found: Counter[int] = Counter()
    for shard in automata(phrases, size):
        for text in guarded(words):
            found.update(map(itemgetter(1), shard.iter(text)))
    return found


_FOUND = pa.schema([("slot", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])


def scan(batches: Iterator[pa.RecordBatch], slots: int, size: int = MAX_PHRASES) -> Iterator[pa.RecordBatch]:
    """``(slot, lang, phrases, counts)`` of each chunk: words that may be frequent, candidates, and all its words as the empty phrase.

    Phrases leave in packed lists by ranges of their hash: nearly every chunk
    has the most frequent ones, and a row for each would be most of the work.
    """
    for _, group in chunks.runs(batches, "chunk"):
        answers: list[dict] = []
        by_lang: dict[str, list[bytes]] = {}  # one, unless two chunks' ids collide
        for batch in chunks.split_parts(group, answers):
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                by_lang.setdefault(lang, []).append(text)
        heavy = Heavy(answers)
        for lang, texts in by_lang.items():
            counts = _counts(Stream(texts, lang), heavy, slots, size)
            parts: dict[int, list[bytes]] = {}
            for phrase in counts:
                parts.setdefault(xxhash.xxh64_intdigest(phrase) % slots, []).append(phrase)
            rows = [(slot, lang, END.join(own), chunks.pack_counts(np.array([counts[p] for p in own], np.int64))) for slot, own in parts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _counts(stream: Stream, heavy: Heavy, slots: int, size: int) -> dict[bytes, int]:
    words, places = candidates(stream, heavy, slots)
    counts = np.bincount(stream.numbers, minlength=1)
    out = {b"": int(counts[1:].sum())} | {stream.distinct[w]: int(counts[w]) for w in words}
    phrases = [GUARD.join(stream.words[i : i + k]) for k, at in places for i in at.tolist()]
    found = count_matches(phrases, stream.words, size)
    return out | {phrase: found[i] for i, phrase in enumerate(phrases)}


_SUMS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])


def sum_counts(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """``(lang, size, phrase, f)`` of a range of phrases, those that reach the threshold and the empty one."""
    for _, group in chunks.runs(batches, "slot"):
        total: dict[str, Counter[bytes]] = {}
        for batch in group:
            for lang, phrases, counts in zip(batch.column("lang").to_pylist(), batch.column("phrases").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = total.setdefault(lang, Counter())
                for phrase, n in zip(phrases.split(END), chunks.unpack_counts(counts).tolist(), strict=True):
                    own[phrase] += n
        rows = [(lang, phrase.count(GUARD) + 1 if phrase else 0, phrase, n) for lang, own in total.items() for phrase, n in own.items() if n >= at_least or not phrase]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMS, strict=True)], schema=_SUMS)


def chunked(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int, int]:
    """``(chunk, lang, text)``, bytes of text and the number of chunks.

    A chunk is a run of rows of one file, in one language. Rows that do not
    come from files are written first.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    try:
        slim = docs.select(lang, "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        slim = materialise(docs.select(lang, "text"), "texts").select("lang", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    size = slim.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    step = max(1, chunk_bytes * size.rows // max(1, size.bytes))
    rows = slim.select(F.xxhash64("file", F.floor(F.col("row") / step), "lang").alias("chunk"), "lang", "text")
    return rows, size.bytes, max(1, -(-size.bytes // chunk_bytes))


def frequencies(docs: DataFrame, at_least: int = MIN_COUNT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(lang, size, phrase, f)``: exact frequencies of all words and phrases that reach ``at_least``, and all words as size 0."""
    rows, volume, n = chunked(docs, chunk_bytes)
    slots = max(1, -(-volume // (CELL_BYTES * SLOT_CELLS)))
    cells = rows.mapInArrow(partial(sketch, slots=slots, limit=chunk_bytes), "slot long, chunk long, cells binary, counts binary")
    heavy = materialise(chunks.by_slot(cells, slots).mapInArrow(partial(heavy_cells, at_least=at_least), "chunk long, slot long, cells binary"), "heavy")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    answers = heavy.select("chunk", F.lit(0).alias("part"), "slot", "cells", none("lang", "string"), none("text", "string"))
    texts = rows.select("chunk", F.lit(1).alias("part"), none("slot", "long"), none("cells", "binary"), "lang", "text")
    met = answers.unionByName(texts).repartition(2 * n, "chunk").sortWithinPartitions("chunk", "part")
    found = met.mapInArrow(partial(scan, slots=slots), "slot long, lang string, phrases binary, counts binary")
    sums = chunks.by_slot(found, slots).mapInArrow(partial(sum_counts, at_least=at_least), "lang string, size int, phrase binary, f long")
    out = materialise(sums.withColumn("phrase", F.col("phrase").cast("string")), "frequencies")
    discard(heavy)
    return out


def joined(words: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """``(lang, size, phrase, a, k, l, r, n, score)`` of each phrase by the cut with the lowest score, exactly."""
    phrases = frequent.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "size", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    both = F.array(
        F.struct(F.lit(True).alias("head"), joined("w", F.lit(1), F.col("k")).alias("part"), F.col("k").alias("words")),
        F.struct(F.lit(False).alias("head"), joined("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("part"), (F.col("size") - F.col("k")).alias("words")),
    )
    sides = cuts.select("lang", "size", "phrase", "a", "k", F.inline(both))
    parts = frequent.where("size > 0").select("lang", F.col("size").alias("words"), F.col("phrase").alias("part"), "f")
    known = materialise(sides.join(parts, ["lang", "words", "part"]), "parts")
    pairs = known.groupBy("lang", "size", "phrase", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    totals = materialise(frequent.where("size = 0").select("lang", F.col("f").alias("n")), "totals")
    whole = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    each = pairs.join(totals, "lang").withColumn("score", F.expr(f"CAST(1000 * {whole('a')} * {whole('n')} DIV ({whole('l')} * {whole('r')}) AS BIGINT)"))
    best = each.groupBy("lang", "size", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "size", "phrase", "a", "cut.k", "cut.l", "cut.r", "n", "cut.score")


def not_contained(phrases: DataFrame) -> DataFrame:
    """Phrases that stand in no longer one of at least their frequency, ``phrases(lang, size, phrase, a, ...)``."""
    longer = phrases.where("size > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "size")
    sizes = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("words"))
    starts = sizes.select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("words") + 1)).alias("at"))
    inner = starts.groupBy("lang", joined("w", F.col("at"), F.col("words")).alias("phrase")).agg(F.max("a").alias("longest"))
    met = phrases.join(inner, ["lang", "phrase"], "left")
    return met.where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * 100)).drop("longest")


def collocations(docs: DataFrame, at_least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language."""
    phrases = materialise(scored(frequencies(docs, at_least)), "phrases")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = not_contained(phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM t, range(1, {LONGEST + 1}) s(size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, n, k, l.f AS l, r.f AS r, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, w, a, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM c))
  GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= {TOP}
"""
