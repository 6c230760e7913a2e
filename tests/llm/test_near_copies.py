"""The pipeline's near-dedup stage, held against the similarity of every pair."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from corvid.llm import near_copies, simhash
from corvid.llm.common import BATCH_BYTES, BATCH_SETTING

DOCS = "doc_id long, text string"


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_kept(rows):
    sets, group = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= len(sets[i] | sets[j]) * 4:
                group = [group[j] if g == group[i] else g for g in group]
    return {i for k, (i, _) in enumerate(rows) if i == min(x for (x, _), g in zip(rows, group, strict=True) if g == group[k])}


@pytest.mark.parametrize("met", [4, 2])
def test_near_copies_of_every_degree_go(spark, monkeypatch, met):
    monkeypatch.setattr(near_copies, "MET", met)
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.integers(0, 3000))}"
    rows, shared = [], [word() for _ in range(40)]
    for k in range(24):
        base = [word() for _ in range(int(rng.integers(5, 220)))] + shared * (k % 2)
        rows.append((len(rows), " ".join(base)))
        for changes in (1, 2, 4, 8):
            own = list(base)
            for at in rng.integers(0, len(own), changes):
                own[at] = word()
            rows.append((len(rows), " ".join(own).upper()))
    rows += [(900, ""), (901, "a b"), (902, None), (903, "A  b"), (904, "a c")]
    kept = slow_kept(rows)
    assert {r.doc_id for r in simhash.keep_one_per_group(spark.createDataFrame(rows, DOCS).repartition(3)).collect()} == kept
    assert 1 not in kept and 24 < len(kept) < len(rows) - 24


def test_a_large_group_forms_no_pairs(spark):
    rng = np.random.default_rng(7)
    base = [f"g{int(x)}" for x in rng.integers(0, 4000, 300)]
    rows = []
    for k in range(300):
        own = list(base)
        own[int(rng.integers(0, 300))] = f"own{k}"
        rows.append((k, " ".join(own)))
    keyed = spark.createDataFrame([(s, k, len(x)) for k, (_, t) in enumerate(rows) for x in [near_copies.shingle_set(t.encode()).view(np.int64).tolist()] for s in x], "s long, node long, size int")
    assert near_copies.leader_pairs(keyed).count() < 10 * len(rows)
    assert [r.doc_id for r in simhash.keep_one_per_group(spark.createDataFrame(rows, DOCS)).collect()] == [0]


def test_a_dense_group_is_joined_without_most_of_its_pairs(spark, monkeypatch):
    rng, seen, write = np.random.default_rng(13), [], near_copies.materialise
    base = [f"g{int(x)}" for x in rng.integers(0, 4000, 150)]
    rows = []
    for k in range(240):  # most are like some others, few like one leader
        own = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 6))):
            own[at] = f"own{k}_{at}"
        rows.append((k, " ".join(own)))

    def counted(table, label, *parts):
        out = write(table, label, *parts)
        seen.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in kept} == slow_kept(rows)
    assert sum(seen) < 240 * 239 / 2 / 5


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    rows = [(1, "one text of some six words"), (2, "one text of some six words"), (2, "quite another text with other words")]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2]]


def test_sets_are_compared_without_batches_of_pairs(spark):
    base = list(range(-40, 40))
    cases = [(base, base, True), (base, base[:64], True), (base, base[:63], False), ([1], [2], False), ([7], [7], True), (base[:72], base[8:], True), (base[:71], base[8:], False)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, x array<long>, y array<long>")
    found = rows.select("k", near_copies.sets_similar("x", "y").alias("is"))
    assert "Python" not in found._jdf.queryExecution().toString()  # noqa: SLF001
    assert [r["is"] for r in found.orderBy("k").collect()] == [c for *_, c in cases]


def test_prefixes_leave_out_pairs_but_no_similar_ones(spark):
    none, rng = np.zeros(0, np.uint64), np.random.default_rng(11)
    rows, pairs, like = [], [], set()
    for k in range(60):
        n = int(rng.integers(1, 120))
        a, more = np.split(rng.choice(1 << 20, 2 * n, replace=False).astype(np.uint64), 2)
        b = np.concatenate([a[: n - n * (k % 6) // 18], more[: n * (k % 6) // 18]]) if k % 2 else np.concatenate([a[:1], more[1:]])
        for node, own in ((2 * k, np.sort(a)), (2 * k + 1, np.sort(b))):
            rows.append((node, len(own), near_copies.prefix_of(own, none, none).view(np.int64).tolist()))
        pairs.append((2 * k, 2 * k + 1))
        if len(np.intersect1d(a, b)) * 5 >= len(np.union1d(a, b)) * 4:
            like.add(pairs[-1])
    found = near_copies.allowed_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "node long, size int, prefix array<long>"))
    kept = {tuple(r) for r in found.collect()}
    assert like and like <= kept and len(kept) < 45


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(17)
    for n in (1, 2, 40, 900):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in "ab")
        b = np.union1d(a[: n // 2], b)
        differ = int(np.bitwise_count(near_copies.parities(a) ^ near_copies.parities(b)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ > 0) == (len(np.setxor1d(a, b)) > 0)


@pytest.mark.parametrize("own", [None, 1 << 20])
def test_stages_of_the_pipeline_get_texts_in_small_batches(spark, monkeypatch, own):
    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    monkeypatch.setattr(corpus_pipeline, "keep_one_per_group", lambda docs: docs.mapInArrow(batch_sizes, "n long, bytes long"))
    one = 50_000
    docs = spark.range(0, 240, 1, 1).selectExpr("id as doc_id", f"repeat('x', {one}) as text")
    spark.conf.unset(BATCH_SETTING)
    try:
        if own:
            spark.conf.set(BATCH_SETTING, own)
        found = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()
    finally:
        spark.conf.unset(BATCH_SETTING)
    assert sum(r.n for r in found) == 240
    assert max(r.bytes for r in found) <= (own or BATCH_BYTES) + 2 * one
