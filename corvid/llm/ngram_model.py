"""Katz backoff language model of order three over the corpus, and the score of every text under it.

Words are lower-cased (A-Z); a document ends with an end token and follows two
begin tokens. With c the training counts and d the Good-Turing discounts:

* order one: P(w) = d1(c) c / N for seen words; what the discounts free is the
  probability of the one unknown word, so P sums to one;
* order two and three: P(w | h) = d(r) r / size(h) for every n-gram seen, once
  or more (r = c(h, w)), else alpha(h) P(w | h without its first word).
  size(h) is c(h), and one more for a history seen over five times, since
  counts above five are not discounted and would leave nothing. alpha(h) is
  what the seen words of h leave, over what they leave one order below, so
  P( . | h) sums to one exactly. A history never seen has alpha one.

Discounts are Good-Turing up to five, in Katz's form; where the counts of
counts give no value in (0, 1), the absolute discount n1 / (n1 + 2 n2), or one
half without singles, is used.

1. Each chunk sends its distinct n-grams of each order once, with training
   counts. Slots of the key range add them up into stored tables and give the
   totals back, in the order in which the chunk sent its keys.
2. Each chunk, now knowing its counts, adds up what the n-grams of a history
   take at their order and below it; every distinct n-gram is counted by one
   chunk. The sums of all chunks, stored by slot, make the weights (alpha).
3. Each chunk evaluates its documents, per token from order three down.

``fit`` keeps both tables whole as a ``NgramModel`` and ``score`` applies one
to other documents. ``score_documents`` stores the counts and sums as each
chunk needs them, and no second time by key; a weight can only be read in a
text outside the training rows, so there those histories are added up that
such texts have.

Defined results: a null or empty text is the end token alone; a null doc_id
is hashed as the empty string; without training documents every word is
unknown and has probability one; repeated rows count each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import chunks
from corvid.llm.common import as_bytes, table
from corvid.plans.scratch import materialise, release

END, BEGIN = xxhash.xxh64_intdigest(b"\nend"), xxhash.xxh64_intdigest(b"\nbegin")
ORDER = 3
KATZ = 5
FOLDS = 5
HELD_OUT = 1
#: entries of each order in bytes of memory, by bytes of text; they set the number of slots
SHARES = (0.3, 0.9, 1.2)
#: orders that are counted at a time; their shuffles do not lie on disk together
ROUNDS = ((0, 1), (2,))
#: what a slot returns to a chunk about a key
OWN, NEEDED = 1, 2
#: tokens that are worked on at a time
STEP = 1 << 18
_A = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class Block:
    """The tokens of several documents as keys, the end of each after its words."""

    def __init__(self, doc_ids: list[int | None], texts: list[bytes]):
        words, n = chunks.hashed_words([x.lower() for x in texts])
        self.doc_ids, self.lengths = doc_ids, n + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.insert(words, np.cumsum(n), END)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[Block]:
    """Documents in blocks of about ``limit`` bytes; a longer document is a block of its own."""
    doc_ids, texts, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            doc_ids.append(doc_id)
            texts.append(text)
            n += len(text)
            if n >= limit or len(texts) >= 5000:
                yield Block(doc_ids, texts)
                doc_ids, texts, n = [], [], 0
    if texts:
        yield Block(doc_ids, texts)


def joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a history's key and a further word."""
    x = history * _A + word
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BEGINS = [np.array([BEGIN], np.uint64)]
for _ in range(ORDER - 2):
    _BEGINS.append(joined(_BEGINS[-1], _BEGINS[0]))


@dataclass(frozen=True)
class Layout:
    """How many slots the key range of each order has; slots are numbered through."""

    slots: tuple[int, ...]

    def first(self, order: int) -> int:
        return sum(self.slots[:order])

    def order_of(self, slot: int) -> int:
        return next(k for k in range(len(self.slots)) if slot < self.first(k + 1))

    def rows(self, order: int, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Slots of sorted ``keys`` and their parts."""
        cuts = chunks.cut(keys, self.slots[order])
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield self.first(order) + k, slice(int(cuts[k]), int(cuts[k + 1]))


class Chunk:
    """A chunk's tokens as n-gram keys; per order its sorted distinct keys, begin histories included."""

    def __init__(self, groups: Iterator[Block], trains: Callable[[int | None], bool]):
        keys: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
        self.doc_ids: list[int | None] = []
        lengths = [np.zeros(0, np.int64)]
        for block in groups:
            below = block.ids
            keys[0].append(below)
            for k in range(1, ORDER):
                history = np.empty_like(below)
                history[1:] = below[:-1]
                history[block.starts] = _BEGINS[k - 1][0]
                below = joined(history, block.ids)
                keys[k].append(below)
            self.doc_ids += block.doc_ids
            lengths.append(block.lengths)
        self.lengths = np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.array([trains(d) for d in self.doc_ids], bool)
        self.token_trains = np.repeat(self.train, self.lengths)
        self.tokens = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in keys]

    def begins(self, order: int, train: bool) -> np.ndarray:
        n = int((self.train == train).sum())
        return np.repeat(_BEGINS[order], n) if order < ORDER - 1 else np.zeros(0, np.uint64)

    def distinct(self, order: int) -> np.ndarray:
        begin = _BEGINS[order] if order < ORDER - 1 else np.zeros(0, np.uint64)
        return chunks.distinct(np.concatenate([self.tokens[order], begin]))

    def counts(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, their training counts, and whether a document outside training has them."""
        of = lambda train: np.concatenate([self.tokens[order][self.token_trains == train], self.begins(order, train)])
        trained, n = chunks.counted(of(True))
        other = chunks.distinct(of(False))
        keys = chunks.distinct(np.concatenate([trained, other]))
        count, outside = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)
        count[keys.searchsorted(trained)] = n
        outside[keys.searchsorted(other)] = 1
        return keys, count, outside


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_SENT = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("outside", pa.binary())])
SENT = "slot long, chunk long, keys binary, n binary, outside binary"


def chunk_counts(batches: Iterator[pa.RecordBatch], layout: Layout, trains: Callable[[int | None], bool], orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its distinct n-grams of ``orders`` with their training counts."""
    for chunk, group in chunks.runs(batches, "chunk"):
        own = Chunk(blocks(group), trains)
        for order in orders:
            keys, n, outside = own.counts(order)
            yield _rows(_SENT, [(slot, chunk, chunks.pack(keys[at]), chunks.pack_counts(n[at]), chunks.pack_counts(outside[at])) for slot, at in layout.rows(order, keys)])


MODEL, ANSWERS, STATISTICS = range(3)
_TOTALS = pa.schema([("kind", pa.int32()), ("ngram", pa.int32()), ("slot", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("flags", pa.binary()), ("stats", pa.list_(pa.int64()))])
TOTALS = "kind int, ngram int, slot long, chunk long, keys binary, n binary, flags binary, stats array<long>"


def totals(batches: Iterator[pa.RecordBatch], layout: Layout, keep: bool) -> Iterator[pa.RecordBatch]:
    """Per slot: all counts added up (a row without a chunk is a stored model's), and each chunk's totals in its own order."""
    for slot, group in chunks.runs(batches, "slot"):
        sent = [r for b in group for r in b.to_pylist()]
        order = layout.order_of(slot)
        keys = chunks.distinct(np.concatenate([chunks.unpack(r["keys"], "<u8") for r in sent]))
        total, owner, needed = np.zeros(len(keys), np.int64), np.full(len(keys), -1), np.zeros(len(keys), bool)
        places = []
        for k, r in enumerate(sent):
            at = keys.searchsorted(chunks.unpack(r["keys"], "<u8")).astype(np.int32)
            n = chunks.unpack_counts(r["n"])
            total[at] += n
            if r["chunk"] is not None:
                free = at[n > 0]
                owner[free[owner[free] < 0]] = k
                needed[at[chunks.unpack_counts(r["outside"]) > 0]] = True
            places.append(at)
        yield _rows(_TOTALS, [
            (ANSWERS, order + 1, slot, r["chunk"], None, chunks.pack_counts(total[at]), chunks.pack_counts(np.where(owner[at] == k, OWN, 0) | np.where(needed[at], NEEDED, 0)), None)
            for k, (r, at) in enumerate(zip(sent, places, strict=True)) if r["chunk"] is not None
        ])
        seen = total > 0
        real = seen & (keys != _BEGINS[order][0]) if order < ORDER - 1 else seen
        few = np.bincount(np.minimum(total[real], KATZ + 2), minlength=KATZ + 3)[1:]
        if keep:
            yield _rows(_TOTALS, [(MODEL, order + 1, slot, None, chunks.pack(keys[seen]), chunks.pack_counts(total[seen]), None, None)])
        yield _rows(_TOTALS, [(STATISTICS, order + 1, slot, None, None, None, None, [*few.tolist(), int(real.sum()), int(total[real].sum())])])


@dataclass(frozen=True)
class Discounts:
    """What is fixed in size about a model: discounts by order and count, N, V."""

    by_order: tuple[np.ndarray, ...]
    n: int
    v: int
    unknown: float  # what the discounts of order one free

    def mass(self, order: int, count: np.ndarray) -> np.ndarray:
        return count * self.by_order[order][np.minimum(count, KATZ + 1)]

    def word(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.mass(0, count) / max(1, self.n), self.unknown)


def size_of(count: np.ndarray) -> np.ndarray:
    return count + (count > KATZ)


def good_turing(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0 to KATZ and, last, all above; ``counts[k]`` types were seen k + 1 times."""
    out, n = np.ones(KATZ + 2), counts.astype(float)
    absolute = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    absolute = absolute if absolute < 1 else n[0] / (n[0] + 1)
    a = (KATZ + 1) * n[KATZ] / n[0] if n[0] else 1.0
    for r in range(1, KATZ + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) if n[r - 1] and a != 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - absolute / r
    return out


def discounts(counted: DataFrame) -> Discounts:
    """Sums of the slots' counts of counts: one short row for each order."""
    width = KATZ + 4
    rows = counted.where(F.col("kind") == STATISTICS).groupBy("ngram").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(width))).collect()
    s = {r["ngram"]: np.array(r[1:], np.int64) for r in rows}
    by = [good_turing(s[k + 1][: KATZ + 2]) if k + 1 in s else np.ones(KATZ + 2) for k in range(ORDER)]
    n, v = (int(s[1][-1]), int(s[1][-2])) if 1 in s else (0, 0)
    freed = sum(float(s[1][r - 1]) * r * (1 - by[0][r]) for r in range(1, KATZ + 1)) if n else 0.0
    if n and freed <= 0:  # nothing seen five times or less: leave the unknown word the share of one token
        by[0], freed = by[0] * n / (n + 1), n / (n + 1)
    return Discounts(tuple(by), n, v, freed / n if n else 1.0)


class Known:
    """A chunk with the total counts of its n-grams: per order, distinct keys, counts, flags and each token's place."""

    def __init__(self, own: Chunk, answers: list[dict], layout: Layout):
        self.own, self.keys, self.counts, self.flags, self.at, self.history = own, [], [], [], [], []
        for order in range(ORDER):
            mine = sorted((r for r in answers if r["n"] is not None and r["ngram"] == order + 1), key=lambda r: r["slot"])
            keys = own.distinct(order)
            self.keys.append(keys)
            self.counts.append(np.concatenate([np.zeros(0, np.int64), *(chunks.unpack_counts(r["n"]) for r in mine)]))
            self.flags.append(np.concatenate([np.zeros(0, np.uint8), *(chunks.unpack_counts(r["flags"]).astype(np.uint8) for r in mine)]))
            self.at.append(chunks.place(keys, own.tokens[order]))
            own.tokens[order] = own.tokens[order][:0]
        for order in range(ORDER - 1):  # the place of each token's history of that order
            h = np.empty_like(self.at[order])
            h[1:] = self.at[order][:-1]
            h[own.starts] = self.keys[order].searchsorted(_BEGINS[order][0])
            self.history.append(h)

    def suffix(self, order: int) -> np.ndarray:
        """For each history of an order above one, the place of what it is without its first word."""
        out = np.zeros(len(self.keys[order]), np.int32)
        out[self.at[order]] = self.at[order - 1]
        out[self.keys[order].searchsorted(_BEGINS[order][0])] = self.keys[order - 1].searchsorted(_BEGINS[order - 1][0])
        return out

    def alpha(self, order: int, answers: list[dict], d: Discounts) -> np.ndarray:
        """Weight of each history; one where none was asked for."""
        out, at = np.ones(len(self.keys[order])), np.flatnonzero(self.asked(order))
        mine = sorted((r for r in answers if r["taken"] is not None and r["ngram"] == order + 1), key=lambda r: r["slot"])
        taken, below = (np.concatenate([np.zeros(0), *(chunks.unpack_sums(r[c]) for r in mine)]) for c in ("taken", "below"))
        lower = size_of(self.counts[order - 1][self.suffix(order)[at]]) if order else max(1, d.n)
        out[at] = (1 - taken / size_of(self.counts[order][at])) / (1 - below / lower)
        return out

    def asked(self, order: int) -> np.ndarray:
        """Histories of that order whose weight the chunk may need."""
        out = np.zeros(len(self.keys[order]), bool)
        out[self.history[order][~self.own.token_trains]] = True
        return out & (self.counts[order] > 0)

    def seen(self, order: int, at: np.ndarray, d: Discounts) -> np.ndarray:
        """Probability of the seen n-grams of an order (0 for words) at tokens ``at``."""
        c = self.counts[order][self.at[order][at]]
        if not order:
            return d.word(c)
        return d.mass(order, c) / np.maximum(1, size_of(self.counts[order - 1][self.history[order - 1][at]]))


_PARTS = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("taken", pa.binary()), ("below", pa.binary()), ("asked", pa.binary())])
PARTS = "slot long, chunk long, keys binary, taken binary, below binary, asked binary"


def history_parts(batches: Iterator[pa.RecordBatch], d: Discounts, layout: Layout, trains: Callable, every_history: bool) -> Iterator[pa.RecordBatch]:
    """Per chunk: discounted counts that the n-grams which it counts have after their histories, at their order and below, and what it asks for."""
    for chunk, group in chunks.runs(batches, "chunk"):
        answers: list[dict] = []
        own = Chunk(blocks(chunks.split_parts(group, answers)), trains)
        known = Known(own, answers, layout)
        for order in range(1, ORDER):
            token = np.empty(len(known.keys[order]), np.int64)
            token[known.at[order]] = np.arange(len(known.at[order]))  # one place of each n-gram
            mine = (known.flags[order] & OWN) > 0
            if order < ORDER - 1:  # a begin history is no n-gram
                mine[known.keys[order].searchsorted(_BEGINS[order])] = False
            token = token[mine]
            taken, below = np.zeros(len(known.keys[order - 1])), np.zeros(len(known.keys[order - 1]))
            for k in range(0, len(token), STEP):
                part = token[k : k + STEP]
                at = known.history[order - 1][part]
                for sums, n in ((taken, order), (below, order - 1)):
                    np.add.at(sums, at, d.mass(n, known.counts[n][known.at[n][part]]))
            asked = known.asked(order - 1)
            send = asked | ((taken > 0) & (every_history | ((known.flags[order - 1] & NEEDED) > 0)))
            keys, taken, below, asked = known.keys[order - 1][send], taken[send], below[send], asked[send].astype(np.uint8)
            yield _rows(_PARTS, [(slot, chunk, chunks.pack(keys[at]), chunks.pack_sums(taken[at]), chunks.pack_sums(below[at]), chunks.pack_counts(asked[at])) for slot, at in layout.rows(order - 1, keys)])


WEIGHTS, ANSWERED = range(2)
_WEIGHED = pa.schema([("kind", pa.int32()), ("ngram", pa.int32()), ("slot", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("taken", pa.binary()), ("below", pa.binary())])
WEIGHED = "kind int, ngram int, slot long, chunk long, keys binary, taken binary, below binary"


def weights(batches: Iterator[pa.RecordBatch], layout: Layout, keep: bool) -> Iterator[pa.RecordBatch]:
    """Per slot: the sums of every history (stored ones come without a chunk), and those that each chunk asks for."""
    for slot, group in chunks.runs(batches, "slot"):
        sent = [r for b in group for r in b.to_pylist()]
        keys = chunks.distinct(np.concatenate([chunks.unpack(r["keys"], "<u8") for r in sent]))
        taken, below = np.zeros(len(keys)), np.zeros(len(keys))
        places = [keys.searchsorted(chunks.unpack(r["keys"], "<u8")) for r in sent]
        for r, at in zip(sent, places, strict=True):
            taken[at] += chunks.unpack_sums(r["taken"])
            below[at] += chunks.unpack_sums(r["below"])
        order, out = layout.order_of(slot) + 1, []
        for r, at in zip(sent, places, strict=True):
            if r["chunk"] is not None:
                at = at[chunks.unpack_counts(r["asked"]) > 0]
                out.append((ANSWERED, order, slot, r["chunk"], None, chunks.pack_sums(taken[at]), chunks.pack_sums(below[at])))
        yield _rows(_WEIGHED, [*out, *([(WEIGHTS, order, slot, None, chunks.pack(keys), chunks.pack_sums(taken), chunks.pack_sums(below))] if keep else [])])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(batches: Iterator[pa.RecordBatch], d: Discounts, layout: Layout, trains: Callable) -> Iterator[pa.RecordBatch]:
    """Per chunk: every token's probability, from order three down by recursion, added up by document."""
    for _, group in chunks.runs(batches, "chunk"):
        answers: list[dict] = []
        own = Chunk(blocks(chunks.split_parts(group, answers)), trains)
        if not own.doc_ids:
            continue
        known = Known(own, answers, layout)
        alphas = [known.alpha(order, answers, d) for order in range(ORDER - 1)]

        def probability(order: int, at: slice, known: Known = known, alphas: list = alphas) -> np.ndarray:
            if not order:
                return known.seen(0, at, d)
            count = known.counts[order][known.at[order][at]]
            return np.where(count > 0, known.seen(order, at, d), alphas[order - 1][known.history[order - 1][at]] * probability(order - 1, at))

        n = len(known.at[0])
        base, scores, seen = np.empty(n), np.empty(n), np.empty(n, np.int64)
        for k in range(0, n, STEP):
            part = slice(k, k + STEP)
            c = known.counts[0][known.at[0][part]]
            base[part], scores[part], seen[part] = np.log10((c + 0.5) / (d.n + 0.5 * (d.v + 1))), np.log10(probability(ORDER - 1, part)), c > 0
        by_doc = lambda x: np.add.reduceat(x, own.starts)  # noqa: B023, E731  every document has its end token
        columns = [
            pa.array(own.doc_ids, pa.int64()), pa.array([held_out(x) for x in own.doc_ids], pa.bool_()), pa.array(own.lengths), pa.array(by_doc(seen)),
            pa.array(np.full(len(own.doc_ids), d.n, np.int64)), pa.array(by_doc(base)), pa.array(by_doc(scores)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


@dataclass(frozen=True)
class NgramModel:
    """Tables by order and slot: counts of n-grams and, for weights, what is taken of histories; discounts beside them."""

    counts: DataFrame
    weights: DataFrame
    discounts: Discounts
    layout: Layout


def _in_training(doc_id: int | None) -> bool:
    return not held_out(doc_id)


def _nowhere(doc_id: int | None) -> bool:
    return False


def _evaluated(docs: DataFrame, trains: Callable, stored: NgramModel | None, every_history: bool) -> tuple[DataFrame, NgramModel]:
    source, volume = chunks.chunked(docs)
    spark, layout = docs.sparkSession, stored.layout if stored else Layout(tuple(volume.slots(x) for x in SHARES))
    tables = []
    for orders in ROUNDS:
        sent = source.mapInArrow(partial(chunk_counts, layout=layout, trains=trains, orders=orders), SENT)
        if stored:
            kept = stored.counts.where(F.col("ngram").isin([k + 1 for k in orders]))
            sent = sent.unionByName(kept.select("slot", F.lit(None).cast("long").alias("chunk"), "keys", "n", F.lit(b"").alias("outside")))
        added = chunks.by_slot(sent, sum(layout.slots[k] for k in orders)).mapInArrow(partial(totals, layout=layout, keep=every_history), TOTALS)
        tables.append(materialise(added, "ngrams", "kind"))
        release(spark)
    counted = reduce(DataFrame.unionByName, tables)
    d = stored.discounts if stored else discounts(counted)
    answers = counted.where(F.col("kind") == ANSWERS).select("chunk", "ngram", "slot", "n", "flags")
    parts = chunks.meet(source, answers, volume).mapInArrow(partial(history_parts, d=d, layout=layout, trains=trains, every_history=every_history), PARTS)
    if stored:
        parts = parts.unionByName(stored.weights.select("slot", F.lit(None).cast("long").alias("chunk"), "keys", "taken", "below", F.lit(b"").alias("asked")))
    weighed = materialise(chunks.by_slot(parts, sum(layout.slots[:-1])).mapInArrow(partial(weights, layout=layout, keep=every_history), WEIGHED), "weights", "kind")
    release(spark)
    none = F.lit(None).cast("binary")
    answered = weighed.where(F.col("kind") == ANSWERED).select("chunk", "ngram", "slot", none.alias("n"), none.alias("flags"), "taken", "below")
    replies = answers.withColumns({"taken": none, "below": none}).unionByName(answered)
    scores = chunks.meet(source, replies, volume).mapInArrow(partial(score_texts, d=d, layout=layout, trains=trains), _SCORES)
    model = NgramModel(counted.where(F.col("kind") == MODEL).select("ngram", "slot", "keys", "n"), weighed.where(F.col("kind") == WEIGHTS).select("ngram", "slot", "keys", "taken", "below"), d, layout)
    return scores, model


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: fold, token counts, base score and the log10 probability under the model of the training fold."""
    return _evaluated(docs, _in_training, None, False)[0]


def fit(docs: DataFrame) -> NgramModel:
    """The stored model of the training fold of ``docs``, with the weights of all its histories."""
    return _evaluated(docs, _in_training, None, True)[1]


def score(docs: DataFrame, model: NgramModel) -> DataFrame:
    """Other documents under a stored model, none of them training rows."""
    return _evaluated(docs, _nowhere, model, False)[0]


def op10_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
