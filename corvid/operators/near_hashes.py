"""Pairs of hashes within a Hamming distance, by multi-index hashing.

Hashes are cut into bands. If ``m`` bands have radii with a sum of (radius + 1)
above the distance, two hashes within the distance differ in some band by that
band's radius at most. One side takes each band's value, the other all values
within the radius, and they meet at equal values; a pair counts at the first
band that is close enough, so it comes once. Few wide bands mean many
neighbours to list, many narrow ones mean crowded values; ``plan_bands`` takes
the cheaper number for the rows that a row's block holds on average.

Rows with equal hashes (and digests) are one class here: classes meet, and
members only come in for the pairs that are the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.graph import connected_components
from corvid.plans.scratch import materialise

WORD = 64
#: values that one hash is listed under, over all bands
MAX_LISTED = 4000


@dataclass(frozen=True)
class Band:
    """Some bits of one 64-bit column, and how many of them may differ."""

    column: int
    shift: int
    width: int
    radius: int

    @property
    def listed(self) -> int:
        return sum(math.comb(self.width, k) for k in range(self.radius + 1))

    def masks(self) -> list[int]:
        return [sum(1 << b for b in bits) for k in range(self.radius + 1) for bits in combinations(range(self.width), k)]

    def of(self, word: Column) -> Column:
        return F.shiftrightunsigned(word, self.shift).bitwiseAND(F.lit((1 << self.width) - 1)) if self.width < WORD else word


def bands_of(columns: int, count: int, distance: int) -> list[Band]:
    """``count`` bands over all columns, the widest ones with the larger radius, those that need none left out."""
    cuts = []
    for column in range(columns):
        own = count // columns + (column < count % columns)
        edges = [WORD * k // own for k in range(own + 1)]
        cuts += [(column, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    low = distance // count
    larger = distance - count * low + 1
    order = sorted(cuts, key=lambda c: (-c[2], c))
    return [Band(*c, radius) for k, c in enumerate(order) if (radius := low if k < larger else low - 1) >= 0]


def plan_bands(columns: int, distance: int, partners: float) -> list[Band]:
    """The cheapest bands where a hash has so many others in its block: listed values plus those it meets."""
    best = None
    for count in range(columns, columns * WORD + 1):
        bands = bands_of(columns, count, distance)
        listed = sum(b.listed for b in bands)
        if listed <= MAX_LISTED:
            cost = listed + partners * sum(b.listed / 2**b.width for b in bands)
            best = min(best or (cost, bands), (cost, bands), key=lambda x: x[0])
        if count > distance + columns:  # only narrower bands would follow
            break
    if best is None:
        raise ValueError(f"a distance of {distance} is too large for {columns * WORD} bits")
    return best[1]


def _distance(a: DataFrame, b: DataFrame, hashes: Sequence[str]) -> Column:
    return sum((F.bit_count(a[f"a_{h}"].bitwiseXOR(b[f"b_{h}"])) for h in hashes), F.lit(0))


def near_classes(classes: DataFrame, block: str, hashes: Sequence[str], distance: int, bands: list[Band], digest: str | None) -> DataFrame:
    """``(a_class, b_class, distance)`` of different ``classes(class, block, *hashes, digest)`` within the distance."""
    spark = classes.sparkSession
    values = F.array(*(F.struct(F.lit(k).alias("band"), b.of(F.col(hashes[b.column])).alias("value")) for k, b in enumerate(bands)))
    each = classes.select("*", F.inline(values))
    side = lambda name: each.select(*(F.col(c).alias(f"{name}_{c}") for c in each.columns))
    a, b = side("a"), side("b")
    if any(x.radius for x in bands):  # at most MAX_LISTED rows
        masks = spark.createDataFrame([(k, m) for k, x in enumerate(bands) for m in x.masks()], "band int, mask long")
        a = a.join(F.broadcast(masks), F.col("a_band") == F.col("band")).withColumn("a_value", F.col("a_value").bitwiseXOR(F.col("mask"))).drop("band", "mask")
    apart = [F.bit_count(x.of(a[f"a_{hashes[x.column]}"].bitwiseXOR(b[f"b_{hashes[x.column]}"]))) <= x.radius for x in bands]
    first = F.coalesce(*(F.when(close, F.lit(k)) for k, close in enumerate(apart)))
    match = (a[f"a_{block}"] == b[f"b_{block}"]) & (a["a_band"] == b["b_band"]) & (a["a_value"] == b["b_value"]) & (a["a_class"] < b["b_class"])
    match = match & (_distance(a, b, hashes) <= distance) & (first == a["a_band"])
    if digest:
        match = match & ~a[f"a_{digest}"].eqNullSafe(b[f"b_{digest}"])
    return a.join(b, match).select("a_class", "b_class", _distance(a, b, hashes).alias("distance"))


def _members_and_near(df: DataFrame, key: str, block: str, hashes: Sequence[str], max_distance: int, digest: str | None) -> tuple[DataFrame, DataFrame]:
    """``(class, block, member)`` of all rows with a hash, and the pairs of classes within the distance."""
    if max_distance < 0:
        raise ValueError("a distance is 0 or more")
    own = [c for c in dict.fromkeys([block, *hashes, *([digest] if digest else [])])]
    rows = materialise(df.where(" and ".join(f"`{c}` is not null" for c in (key, block, *hashes))).select(key, *(c for c in own if c != key)).distinct(), "hashes")
    classes = materialise(rows.groupBy(*own).agg(F.min(key).alias("class")), "classes")
    sizes = classes.groupBy(block).agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).first()
    bands = plan_bands(len(hashes), max_distance, sizes["pairs"] / sizes["n"]) if sizes["n"] else bands_of(len(hashes), len(hashes), 0)
    near = materialise(near_classes(classes, block, hashes, max_distance, bands, digest), "near-classes")
    equal = [rows[c].eqNullSafe(classes[c]) for c in own]
    return materialise(rows.join(classes, equal).select(classes["class"], rows[block].alias("block"), rows[key].alias("member")), "members"), near


def near_pairs(df: DataFrame, key: str, block: str, hashes: Sequence[str], max_distance: int, digest: str | None = None) -> DataFrame:
    """``(block, left, right, distance)``: pairs of one block whose hashes differ in at most ``max_distance`` bits.

    ``hashes`` are long columns of 64 bits each, ``key`` tells rows apart and
    ``left < right`` by it. With ``digest``, rows of equal digests (or without
    any) are exact copies and no pair. Rows with a null hash, block or key
    have none. No block meets itself whole, and copies meet as one.
    """
    members, near = _members_and_near(df, key, block, hashes, max_distance, digest)
    x, y = (members.select(F.col("class").alias(f"{s}_class"), F.col("block").alias(f"{s}_block"), F.col("member").alias(f"{s}_member")) for s in "ab")
    pairs = near.join(x, "a_class").join(y, "b_class").select("a_block", "a_member", "b_member", "distance")
    if not digest:  # equal hashes are pairs too
        pairs = pairs.unionByName(x.join(y, (F.col("a_class") == F.col("b_class")) & (F.col("a_member") < F.col("b_member"))).select("a_block", "a_member", "b_member", F.lit(0).alias("distance")))
    return pairs.select(F.col("a_block").alias("block"), F.least("a_member", "b_member").alias("left"), F.greatest("a_member", "b_member").alias("right"), "distance")


def near_links(df: DataFrame, key: str, block: str, hashes: Sequence[str], max_distance: int) -> DataFrame:
    """``(block, member, component, links)``: a row for each row with a hash, with its smallest reachable key and how many rows are within the distance.

    The same links as ``near_pairs`` has, without a row for each: classes of
    equal hashes count by their size.
    """
    members, near = _members_and_near(df, key, block, hashes, max_distance, None)
    sizes = materialise(members.groupBy("class").agg(F.count("*").alias("size")), "sizes")
    both = near.select(F.col("a_class").alias("class"), F.col("b_class").alias("other")).unionByName(near.select(F.col("b_class").alias("class"), F.col("a_class").alias("other")))
    others = both.join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("size").alias("others"))
    # edges between smallest neighbours hold the components, and most edges fall on one node there
    low = materialise(both.groupBy("class").agg(F.min("other").alias("m")).select("class", F.least("class", "m").alias("low")), "low")
    ends = near.join(low.select(F.col("class").alias("a_class"), F.col("low").alias("src")), "a_class").join(low.select(F.col("class").alias("b_class"), F.col("low").alias("dst")), "b_class")
    parts = connected_components(ends.where("src <> dst").select("src", "dst").distinct()).withColumnRenamed("node", "low")
    found = low.join(parts, "low", "left").select("class", F.coalesce("component", "low").alias("component"))
    each = sizes.join(others, "class", "left").join(found, "class", "left")
    links = F.col("size") - 1 + F.coalesce("others", F.lit(0))
    return members.join(each.select("class", F.coalesce("component", "class").alias("component"), links.alias("links")), "class").select("block", "member", "component", "links")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """The report's order: by distance, block and keys."""
    return pairs.orderBy("distance", "block", "left", "right")
