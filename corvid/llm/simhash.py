"""SimHash near-duplicate groups with pigeonring candidate filtering.

A fingerprint has 64 bits on a ring of ``2 * max_distance + 1`` segments. If
two fingerprints differ in at most ``max_distance`` bits, some segment starts
a chain whose first l segments differ in at most ``l * max_distance / m`` bits
for every l up to m. The longest prefix with a budget below one bit must be
equal and serves as the join key; the longer prefixes are checked on each
candidate before the full Hamming distance.

Only distinct fingerprints take part, each under the smallest doc_id that has
it, so copies never form pairs. A key with more than ``max_bucket`` distinct
fingerprints is not paired at all: its fingerprints send their 64 one-bit
neighbours instead, and two fingerprints within two bits share one of at most
65 members of such a neighbour, which links them exactly and linearly.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; fewer words than a shingle are one shingle; repeated rows each get
a row; a null doc_id takes its group's smallest id, null if there is none; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import as_bytes, table
from corvid.llm.near_copies import near_copy_groups
from corvid.operators.graph import connected_components
from corvid.plans.scratch import fresh, materialise

BITS = 64
SHINGLE = 3
SEED = 42
CHUNK = 1 << 15


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little")
    return int(ones.view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(x) for x in as_bytes(text)], pa.int64())


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segments(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each of ``parts`` nearly equal segments of 64 bits."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(parts: list[tuple[int, int]], start: int, length: int) -> int:
    m = 0
    for k in range(length):
        shift, width = parts[(start + k) % len(parts)]
        m |= ((1 << width) - 1) << shift
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def near_pairs(distinct: DataFrame, max_distance: int = 2, max_bucket: int = 64) -> DataFrame:
    """Edges (src, dst) of rep ids that connect ``distinct(fp, rep)`` as Hamming links do.

    Every edge is a true link; each true link is either an edge or, for
    crowded keys, implied by edges that share a one-bit neighbour.
    """
    if max_distance != 2:
        raise ValueError("crowded keys are linked through one-bit neighbours, which prove a distance of two")
    m = 2 * max_distance + 1
    parts = segments(m)
    free = max(k for k in range(1, m) if k * max_distance < m)  # prefix that must be equal
    chains = F.array(*(F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(parts, i, free))).alias("key")) for i in range(m)))
    keyed = distinct.select("fp", "rep", F.explode(chains).alias("chain")).select("fp", "rep", "chain.*")
    counts = materialise(keyed.groupBy("start", "key").count().where("count > 1"), "buckets")
    crowded = counts.where(F.col("count") > max_bucket)
    shared = materialise(keyed.join(counts.where(F.col("count") <= max_bucket), ["start", "key"]).select("start", "key", "fp", "rep"), "chains")
    a, b = shared.alias("a"), shared.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    within = F.col("a.fp") < F.col("b.fp")
    for length in range(free + 1, m):  # the chain's longer prefixes, before the whole distance
        budget = length * max_distance // m
        prefix = F.element_at(F.array(*(F.lit(_mask(parts, i, length)) for i in range(m))), F.col("a.start") + 1)
        within = within & (F.bit_count(differ.bitwiseAND(prefix)) <= budget)
    within = within & (F.bit_count(differ) <= max_distance)
    pairs = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & within)
    edges = pairs.select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"))
    # Crowded keys: one-bit neighbours. A neighbour has 65 members at most.
    members = keyed.join(crowded.select("start", "key"), ["start", "key"], "left_semi").select("fp", "rep").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)))
    hubs = members.select("rep", F.explode(flips).alias("hub")).groupBy("hub").agg(F.min("rep").alias("src"), F.collect_list("rep").alias("reps"))
    spokes = hubs.where(F.size("reps") > 1).select("src", F.explode("reps").alias("dst")).where("src <> dst")
    return edges.unionByName(spokes)


def near_duplicate_groups(fingerprints: DataFrame, max_bucket: int = 64) -> DataFrame:
    """``(fp, component_id)`` for every distinct fingerprint of ``(doc_id, fp)``; fingerprints link whether or not they have an id."""
    distinct = materialise(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    groups = connected_components(near_pairs(distinct.select("fp", F.col("fp").alias("rep")), max_bucket=max_bucket))
    joined = materialise(distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component")), "components")
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    return materialise(joined.join(lows, "component").select("fp", "component_id"), "components")


def with_components(fingerprints: DataFrame, max_bucket: int = 64) -> DataFrame:
    """``fingerprints`` plus component_id; the join's keys may be split by Spark."""
    groups = near_duplicate_groups(fingerprints, max_bucket)
    return fingerprints.join(groups, "fp", "left")


def close_nodes(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``prints(node, fp)``: nodes of one fingerprint with its smallest node, and these of close fingerprints."""
    reps = materialise(prints.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    same = prints.join(reps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return same.unionByName(near_pairs(reps).select(F.col("src").alias("a"), F.col("dst").alias("b")))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    Near copies are texts with 0.8 of their five-word shingles in common. Close
    fingerprints are candidates; what they miss at 0.8, ``near_copies`` adds,
    and whole shingle sets decide. Documents without an id are kept; of equal
    rows, all are; rows that repeat an id are judged each.
    """
    names = {c: fresh(c, docs.columns) for c in ("gone_id", "gone_key")}
    drop = near_copy_groups(docs.select("doc_id", "text"), close_nodes).where("doc_id <> first_id").select(F.col("doc_id").alias(names["gone_id"]), F.col("text_key").alias(names["gone_key"])).distinct()
    gone = materialise(drop, "gone")
    same = (docs["doc_id"] == gone[names["gone_id"]]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[names["gone_key"]])
    return docs.join(gone, same, "left_anti")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = materialise(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "hashes")
    return with_components(ids).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
