"""Hamming pairs held against all pairs, and the groups' numbers."""

import random

import pytest
from pyspark.sql import functions as F

from corvid.operators import audit
from corvid.operators.near_hashes import Band, bands_of, near_links, near_pairs, ordered_pairs, plan_bands
from corvid.functions.scoring import hash_words


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(seed, n, columns, distance):
    """Random hashes, some of them near others, some equal."""
    rng = random.Random(seed)
    out = [[rng.getrandbits(64) for _ in range(columns)] for _ in range(n // 2)]
    while len(out) < n:
        near = list(rng.choice(out))
        for bit in rng.sample(range(64 * columns), rng.choice([0, 1, distance - 1, distance, distance + 1, distance + 2]) if distance else rng.randrange(2)):
            near[bit // 64] ^= 1 << bit % 64
        out.append(near)
    return [(i, rng.choice("xxxy"), *map(signed, h), rng.choice(["d", "e", "f", None])) for i, h in enumerate(out)]


@pytest.mark.parametrize(("seed", "columns", "distance"), [(1, 1, 0), (2, 1, 3), (3, 1, 20), (4, 4, 8), (5, 4, 0), (6, 2, 17)])
@pytest.mark.parametrize("digest", [None, "digest"])
def test_against_all_pairs(spark, seed, columns, distance, digest):
    rows = hashes(seed, 120, columns, distance)
    rows += [(1000, "x", *[None] * columns, "d"), (1001, None, *rows[0][2 : 2 + columns], "d"), rows[3], rows[3]]
    names = [f"h{k}" for k in range(columns)]
    df = spark.createDataFrame(rows, f"id int, block string, {', '.join(f'{n} long' for n in names)}, digest string").withColumns({"class": F.lit(1), "band": F.lit(2)}).repartition(3)
    got = sorted(tuple(r) for r in near_pairs(df, "id", "block", names, distance, digest).collect())
    known = {r[0]: r for r in rows if r[1] is not None and r[2] is not None}
    want = []
    for i, a in known.items():
        for j, b in known.items():
            far = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[2:-1], b[2:-1], strict=True))
            if i < j and a[1] == b[1] and far <= distance and not (digest and a[-1] == b[-1]):
                want.append((a[1], i, j, far))
    assert got == sorted(want) and len(got) > 3
    if not digest:
        linked = {r.member: r for r in near_links(df, "id", "block", names, distance).collect()}
        assert linked.keys() == known.keys() and all(linked[i].links == sum(i in p[1:3] for p in want) for i in known)
        low = {i: i for i in known}
        for _ in known:
            for _, i, j, _ in want:
                low[i] = low[j] = min(low[i], low[j])
        assert {i: r.component for i, r in linked.items()} == low


@pytest.mark.parametrize(("columns", "distance", "partners"), [(1, 20, 10), (1, 20, 1e6), (4, 8, 1e7), (4, 40, 1e5), (1, 0, 5), (1, 3, 1e9)])
def test_bands_suffice(columns, distance, partners):
    bands = plan_bands(columns, distance, partners)
    assert sum(b.radius + 1 for b in bands) > distance and sum(b.listed for b in bands) <= 4000
    assert len({(b.column, b.shift) for b in bands}) == len(bands) and all(len(set(b.masks())) == b.listed for b in bands)
    assert all(0 <= b.shift and b.shift + b.width <= 64 for b in bands)
    for count in range(columns, 64 * columns + 1):
        assert sum(b.radius + 1 for b in bands_of(columns, count, distance)) > distance
    assert sum(b.width for b in bands_of(columns, columns, distance)) == 64 * columns and Band(0, 0, 64, 0).listed == 1


def test_copies_meet_once_and_empty_tables(spark):
    rows = [(i, "b", 7, "same") for i in range(3000)] + [(5000, "b", 6, "other"), (5001, "b", 7, "other")]
    df = spark.createDataFrame(rows, "id int, block string, h long, digest string")
    got = near_pairs(df, "id", "block", ["h"], 2, "digest")
    assert got.count() == 6000 and {r.distance for r in got.select("distance").distinct().collect()} == {0, 1}
    assert near_pairs(df.limit(0), "id", "block", ["h"], 2).count() == 0 and [r.distance for r in ordered_pairs(got).limit(2).collect()] == [0, 0]
    with pytest.raises(ValueError, match="distance"):
        near_pairs(df, "id", "block", ["h"], -1)


def test_hex_words(spark):
    r = spark.range(1).select(*hash_words(F.lit("f" * 16 + "0" * 15 + "1" + "8" + "0" * 15 + "0123456789abcdef"))).first()
    assert list(r) == [-1, 1, -(1 << 63), 0x0123456789ABCDEF]


def test_groups_are_numbered_in_ranges(spark):
    pairs = spark.createDataFrame([("b", 2 * k, 2 * k + 1, k % 5) for k in range(300)] + [("b", 1, 900, 7)], "block string, left long, right long, distance int")
    groups = {r.group_id: r for r in audit.near_groups(pairs).collect()}
    assert groups["near-0001"].members == [0, 1, 900] and groups["near-0001"].max_distance == 7 and groups["near-0002"].members == [2, 3] and groups["near-0300"].members == [598, 599]
    assert audit.near_membership(pairs).count() == 601
