"""Groups of texts whose shingle sets have a Jaccard similarity of 0.8 or more, exactly.

A 64-bit SimHash alone cannot decide this: at 0.8 two fingerprints differ in
about ten bits and often in more, and a distance that holds all such pairs
leaves no segment long enough for a join key. So close fingerprints only give
the first candidates, and prefixes of the sets themselves the others: in any
fixed order of all shingles, two sets this similar share one among the first
n - ceil(0.8 n) + 1 of each. Shingles that are frequent in a bounded sample
are ordered last, most frequent at the end, so passages that many documents
quote are seldom in a prefix; the order decides the work only, never the
result. Whole sets decide on every candidate.

Equal sets are one node. First, each node is held against close fingerprints
and the leader (smallest node) of every prefix shingle it shares. In a dense
group the members need not be like that one leader, so nodes that are still in
different groups are held against a few other leaders of each shingle: both
rounds grow with the shingles, not with a group's pairs. Then pairs that share
a prefix shingle and are still in different groups follow. Beside what most of
a shingle's nodes already are, only the others look for partners.

Three bounds come before whole sets: what the prefixes have in common (first
round), and, for the others, a shingle's place in its prefix once shingles
that fewer prefixes have come first, counted exactly, and the least difference
of two sets by parities of their hashes.

Words are lower-cased (A-Z). Fewer words than a shingle are one shingle, also
none at all; a row without an id takes part in no group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm import chunks
from corvid.llm.common import as_bytes, cells_of, in_cells
from corvid.operators.graph import connected_components
from corvid.plans.scratch import discard, materialise, release

SHINGLE = 5
#: least similarity as a fraction, so that it is compared without rounding
PART, WHOLE = 4, 5
#: documents whose shingles give the order, and frequent shingles kept of them
SAMPLE, FREQUENT, MET = 20_000, 100_000, 4
#: 64-bit words of a set's parities, and leaders of a shingle in the second round
WORDS, LEADERS = 8, 4


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = [0, *(ends[: n - 1] + 1).tolist()], ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return chunks.distinct(np.fromiter((digest(joined[a:b]) for a, b in zip(first, last, strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """SimHash of distinct shingles: bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit per residue of the hashes, one where an odd number fall: two sets differ in at least as many shingles as bits."""
    odd = (np.bincount((hashes % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    cuts = np.cumsum([0, *map(len, found)])
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view("<i8"), pa.int64()))


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingles(text: pa.Array) -> pa.Array:
    return _lists([shingle_set(x) for x in as_bytes(text)])


def sets_similar(a: str, b: str) -> Column:
    """Whether two sets have the similarity; Spark compares them row by row, so no batch holds the sets of many pairs."""
    both = F.size(F.array_intersect(a, b))
    return both * WHOLE >= (F.size(a) + F.size(b) - both) * PART


def prefix_of(own: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before ``frequent`` (sorted, each seen ``times``)."""
    size = len(own) - (PART * len(own) + WHOLE - 1) // WHOLE + 1
    if not len(frequent):
        return own[:size]
    at = np.minimum(frequent.searchsorted(own), len(frequent) - 1)
    return own[np.lexsort((own, np.where(frequent[at] == own, times[at], 0)))[:size]]


def place_of(s: np.uint64, frequent: np.ndarray, times: np.ndarray) -> tuple[int, int]:
    """A shingle's place in that order, as two signed numbers."""
    at = int(frequent.searchsorted(s))
    return int(times[at]) if at < len(frequent) and frequent[at] == s else 0, int(s) - (1 << 63)


def prefixes(docs: DataFrame) -> Column:
    """A function of a text: its set's key, size and parities, its prefix in an order taken from a sample of ``docs``, and where that ends."""
    spark, key = docs.sparkSession, F.xxhash64("text")
    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(key, F.lit(step)) == 0).groupBy(key.alias("key")).agg(F.first("text").alias("text"))
    seen = some.select(F.explode(shingles(F.col("text"))).alias("s")).groupBy("s").count().where(F.col("count") >= MET)
    met = seen.orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    hashes, times = np.array([r["s"] for r in met], np.int64).view(np.uint64), np.array([r["count"] for r in met], np.int64)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], times[order]))

    @F.arrow_udf("struct<node:bigint,size:int,fp:bigint,bits:array<bigint>,times:bigint,last:bigint,prefix:array<bigint>>")
    def of(text: pa.Array) -> pa.Array:
        nodes, sizes, prints, odd, ends, heads = [], [], [], [], [], []
        for x in as_bytes(text):
            own = shingle_set(x)
            nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
            sizes.append(len(own))
            prints.append(majority(own))
            odd.append(parities(own))
            heads.append(prefix_of(own, *shared.value))
            ends.append(place_of(heads[-1][-1], *shared.value))
        times, last = np.array(ends, np.int64).reshape(-1, 2).T
        return pa.StructArray.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.int64)), _lists(odd), pa.array(times), pa.array(last), _lists(heads)], ["node", "size", "fp", "bits", "times", "last", "prefix"])

    return of(F.col("text"))


def _fitting(a: str, b: str) -> Column:
    return (F.col(a) * PART <= F.col(b) * WHOLE) & (F.col(b) * PART <= F.col(a) * WHOLE)


def _allowed(shared: Column) -> Column:
    """Whether sets of ``n_a`` and ``n_b`` shingles may be similar, whose prefixes have ``shared`` in common."""
    # all that both have up to the earlier end of the two prefixes is in both; beyond it, that set has no more than its rest
    rest = lambda n: F.ceil(F.col(n) * PART / WHOLE) - 1
    return (shared + F.greatest(rest("n_a"), rest("n_b"))) * (PART + WHOLE) >= (F.col("n_a") + F.col("n_b")) * PART


def allowed_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that may be similar by their prefixes in ``found(node, size, prefix)``, a fifth of the whole sets."""
    left, right = (found.select(F.col("node").alias(c), F.col("size").alias(f"n_{c}"), F.col("prefix").alias(f"prefix_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(_allowed(F.size(F.array_intersect("prefix_a", "prefix_b")))).select("a", "b")


def leader_pairs(keyed: DataFrame) -> DataFrame:
    """Each node of ``keyed(s, node, size)`` with the smallest node of each prefix shingle that it shares: no group's pairs."""
    leaders = keyed.groupBy("s").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("lead")).where("n > 1").select("s", F.col("lead.node").alias("a"), F.col("lead.size").alias("n_a"))
    met = keyed.join(leaders, "s").where((F.col("node") != F.col("a")) & _fitting("size", "n_a"))
    return met.select("a", F.col("node").alias("b")).distinct()


def placed(exploded: DataFrame) -> DataFrame:
    """``(s, node, size, at)`` of the shingles of ``exploded(node, size, s)`` that several prefixes have.

    ``at`` is the shingle's place in its prefix if shingles come first that
    fewer prefixes have; those that no other has are in front of all.
    """
    shared = exploded.groupBy("s").agg(F.count("*").alias("met")).where("met > 1")
    own = exploded.join(shared, "s").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("met", "s"))).alias("own"))
    alone = F.col("size") - F.ceil(F.col("size") * PART / WHOLE) + 1 - F.size("own")
    return own.select("node", "size", alone.alias("alone"), F.posexplode("own").alias("pos", "x")).select("x.s", "node", "size", (F.col("alone") + F.col("pos")).cast("int").alias("at"))


def _may_be_similar(a: str, b: str) -> Column:
    """Whether two rows of ``split_keys`` may be of similar sets, if their shingle is the first in ``at`` that both prefixes have."""
    col = lambda x, c: F.col(f"{x}.{c}")
    # what the prefix that ends first has before that shingle is in it alone: the other prefix would have it too
    room = lambda x, y: col(x, "at") * (PART + WHOLE) + col(y, "size") * PART <= col(x, "size") * WHOLE
    place = lambda x: F.struct(col(x, "times"), col(x, "last"))
    differ = sum((F.bit_count(col(a, "bits")[i].bitwiseXOR(col(b, "bits")[i])) for i in range(WORDS)), F.lit(0))
    first = F.when(place(a) <= place(b), room(a, b)).otherwise(room(b, a))
    return _fitting(f"{a}.size", f"{b}.size") & first & (differ * (PART + WHOLE) <= (col(a, "size") + col(b, "size")) * (WHOLE - PART))


def split_keys(keyed: DataFrame, known: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of ``keyed(s, node, size, at)`` whose shingle has nodes of several groups; ``main`` is the group that most of them are in."""
    grouped = materialise(keyed.select("s", "node", "size", "at").join(known, "node", "left").select("s", "node", "size", "at", F.coalesce("component", "node").alias("of")), "keyed")
    split = grouped.groupBy("s", "of").count().groupBy("s").agg(F.max(F.struct("count", "of")).alias("most"), F.count("*").alias("groups")).where("groups > 1").select("s", F.col("most.of").alias("main"))
    met = materialise(grouped.join(split, "s").select("*", (F.col("of") == F.col("main")).alias("in_main")).drop("main").join(marks, "node"), "split")
    discard(grouped)
    return met


def other_leaders(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``split_keys``: each node with a few nodes of each of its shingles, another choice for every shingle, that are in other groups."""
    own = F.struct("node", "of", "size", "at", "times", "last", "bits")
    leaders = met.groupBy("s").agg(F.array_distinct(F.array(*(F.min_by(own, F.xxhash64("s", "node", F.lit(i))) for i in range(LEADERS)))).alias("x"))
    a, b = leaders.select("s", F.explode("x").alias("x")).select("s", "x.*").alias("a"), met.alias("b")
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.of") != F.col("b.of")) & _may_be_similar("a", "b"))
    return _ordered(pairs)


def open_pairs(met: DataFrame) -> DataFrame:
    """All pairs (a, b) of ``split_keys`` that are not yet in one group and may be similar."""
    a, b = met.where("not in_main").alias("a"), met.alias("b")
    once = F.col("b.in_main") | (F.col("a.node") < F.col("b.node"))
    return _ordered(a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.of") != F.col("b.of")) & once & _may_be_similar("a", "b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def similar(pairs: DataFrame, nodes: DataFrame, slim: DataFrame) -> DataFrame:
    """Links (src, dst) of the pairs whose whole sets are similar; sets are made again from one text of each node."""
    members = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(nodes.join(members, "node", "left_semi").select("node", "rep.*"), "wanted")
    some = cells_of(wanted, "text_key")
    texts = slim.withColumn("text_key", F.xxhash64("text")).where(in_cells(F.col("text_key"), some)).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["node"])
    sets = materialise(texts.select("node", shingles(F.col("text")).alias("own")), "sets")
    release(slim.sparkSession)
    left, right = (sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in ("a", "b"))
    links = materialise(pairs.join(left, "a").join(right, "b").where(sets_similar("own_a", "own_b")).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    discard(sets)
    discard(wanted)
    release(slim.sparkSession)
    return links


def near_copy_groups(docs: DataFrame, simhash_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(doc_id, text_key, first_id)`` per row with an id: the smallest id of the group of its text.

    ``simhash_pairs`` gives pairs (a, b) of ``(node, fp)`` with close fingerprints.
    """
    slim = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = materialise(slim.select("doc_id", F.xxhash64("text").alias("text_key"), prefixes(slim).alias("x")).select("doc_id", "text_key", "x.*"), "prefixes")
    rows = materialise(made.select("doc_id", "text_key", "node"), "rows")
    one = [F.first(c).alias(c) for c in ("size", "fp", "bits", "times", "last", "prefix")]
    found = materialise(made.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), *one), "nodes")
    nodes = materialise(found.select("node", "rep"), "nodes")
    marks = materialise(found.select("node", "times", "last", "bits"), "marks")
    discard(made)
    keyed = materialise(placed(found.select("node", "size", F.explode("prefix").alias("s"))), "keyed")
    release(docs.sparkSession)
    close = simhash_pairs(found.select("node", "fp")).select("a", "b")
    tried = materialise(allowed_pairs(leader_pairs(keyed).unionByName(close).distinct(), found), "pairs")
    discard(found)
    links = similar(tried, nodes, slim)
    known = connected_components(links)
    for candidates in (other_leaders, open_pairs):
        met = split_keys(keyed, known, marks)
        discard(keyed)
        keyed = met
        pairs = materialise(candidates(met).join(tried, ["a", "b"], "left_anti"), "pairs")
        release(docs.sparkSession)
        more = similar(pairs, nodes, slim)
        tried = tried.unionByName(pairs)
        if more.limit(1).count():
            links = links.unionByName(more)
            known = connected_components(links)
    discard(keyed)
    labelled = nodes.join(known, "node", "left").select("node", F.col("rep.doc_id").alias("low"), F.coalesce("component", "node").alias("component"))
    lows = labelled.groupBy("component").agg(F.min("low").alias("first_id"))
    groups = materialise(labelled.join(lows, "component").select("node", "first_id"), "groups")
    return rows.join(groups, "node").select("doc_id", "text_key", "first_id")
