"""Operators on the whole corpus and the pipeline, held against plain definitions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvid.llm import chunks, decontaminate, ngram_model, pii, quality_rules, simhash, substring_dedup
from corvid.plans.scratch import materialise


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def passages(seed, n=40):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.integers(0, 400))}"
    shared = [" ".join(word() for _ in range(k)) for k in (13, 14, 30, 60)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 40))))]
        for k in rng.integers(0, 4, int(rng.integers(0, 3))):
            parts += [shared[k], " ".join(word() for _ in range(int(rng.integers(0, 9))))]
        rows.append((i, " ".join(parts)))
    return [*rows, (n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "a b c"), (None, shared[3]), (5, rows[5][1]), (n + 5, "r " * 500), (n + 6, "r " * 300), (n + 7, shared[2] + " " + shared[2])]


def slow_removal(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = passages(seed)
    df = materialise(frame(spark, rows).withColumn("chunk", F.lit("own")).withColumn("copy", F.lit(1)).repartition(3), "test")
    got = substring_dedup.dedup_phrases(df).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == slow_removal(rows)


def test_substring_dedup_of_a_plan_without_files(spark):
    rows = passages(3, 12)
    got = substring_dedup.dedup_phrases(frame(spark, rows)).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == slow_removal(rows)
    assert substring_dedup.dedup_phrases(frame(spark, [])).count() == 0


def test_a_chunk_without_any_repeat(spark):
    shared = " ".join(f"s{k}" for k in range(20))
    twice, once = [(1, shared), (2, "a b " + shared)], [(3, " ".join(f"t{k}" for k in range(50))), (4, "short")]
    df = materialise(frame(spark, twice).coalesce(1).union(frame(spark, once).coalesce(1)), "test")
    got = substring_dedup.dedup_phrases(df).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == slow_removal(twice + once)
    assert Counter(tuple(r) for r in substring_dedup.dedup_phrases(frame(spark, once)).drop("kept").collect()) == slow_removal(once)


def test_small_flushes_and_shards_change_nothing(spark, monkeypatch):
    rows = distinct_texts(passages(4))
    monkeypatch.setattr(substring_dedup, "FLUSH", 50)
    monkeypatch.setattr(substring_dedup.occurrences, "__defaults__", (7, 5))
    monkeypatch.setattr(chunks.blocks, "__defaults__", (bytes.split, 60))
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    got = in_one_process(rows)
    assert Counter(got) == slow_removal(rows)


def distinct_texts(rows):
    """Whole copies are not the automata's."""
    return list({t: (i, t) for i, t in rows if i is not None}.values())


def in_one_process(rows):
    """The three steps over two chunks without Spark, so that their parts can be replaced."""
    import pyarrow as pa

    batch = lambda own, chunk: pa.RecordBatch.from_pydict({"chunk": [chunk] * len(own), "part": [1] * len(own), "doc_id": pa.array([i for i, _ in own], pa.int64()), "text": pa.array([t for _, t in own], pa.string())})
    parts = [batch(rows[0::2], 1), batch(rows[1::2], 2)]

    def by(found, key, schema=None):
        whole = pa.Table.from_batches(list(found))
        return whole.sort_by([(key, "ascending")]).combine_chunks().to_batches()

    def meeting(answers):
        for chunk, docs in ((1, parts[0]), (2, parts[1])):
            own = [r for b in answers for r in b.to_pylist() if r["chunk"] == chunk]
            own.sort(key=lambda r: r["slot"])
            names = [c for c in (answers[0].schema.names if answers else []) if c != "chunk"]
            extra = {c: pa.array([r[c] for r in own], answers[0].schema.field(c).type) for c in names}
            n = len(own)
            yield pa.RecordBatch.from_pydict({"chunk": [chunk] * n, "part": pa.array([0] * n, pa.int64()), "doc_id": pa.array([None] * n, pa.int64()), "text": pa.array([None] * n, pa.string()), **extra})
            yield pa.RecordBatch.from_pydict({**{c: docs.column(c) for c in docs.schema.names}, **{c: pa.array([None] * docs.num_rows, answers[0].schema.field(c).type) for c in names}})

    recurring = list(substring_dedup.recurring_anchors(iter(by(substring_dedup.chunk_anchors(iter(parts), 3), "slot"))))
    confirmed = list(substring_dedup.confirmed_phrases(iter(by(substring_dedup.chunk_phrases(meeting(recurring), 3), "slot"))))
    return [tuple(r.values()) for b in substring_dedup.remove_phrases(meeting(confirmed)) for r in b.drop_columns(["text_key", "kept"]).to_pylist()]


def test_the_automata_decide_what_is_removed(monkeypatch):
    rows = distinct_texts(passages(5))
    assert Counter(in_one_process(rows)) == slow_removal(rows)
    monkeypatch.setattr(substring_dedup.Phrases, "shards", lambda self, size: iter(()))
    assert not any(r[2] for r in in_one_process(rows))


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [(3, a), (5, a), (5, b)]
    got = Counter(tuple(r) for r in substring_dedup.dedup_phrases(frame(spark, rows)).drop("kept").collect())
    assert got == slow_removal(rows) and {r[2] for r in got} == {0, 20}


def test_a_very_long_text(spark):
    long = " ".join(f"v{k % 90_001}" for k in range(450_000))
    rows = [(1, " ".join(f"v{k}" for k in range(500, 600))), (2, long), (3, None)]
    got = {r.doc_id: r for r in substring_dedup.dedup_phrases(frame(spark, rows)).collect()}
    assert (got[2].n_words, got[2].n_removed, got[1].n_removed) == (450_000, 500, 0)


# ---- language model


def own_discounts(counts):
    """Katz's discounts of counts 1 to 5 from scratch."""
    n = Counter(counts.values())
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    flat = flat if flat < 1 else n[1] / (n[1] + 1)
    out = {}
    for r in range(1, 6):
        tail = 6 * n[6] / n[1] if n[1] else 1.0
        good = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else 0.0
        out[r] = good if 0 < good < 1 else 1 - flat / r
    return out


def slow_model(rows):
    toks = [(i, [*(t or "").encode().lower().split(), "END"]) for i, t in rows]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    grams = [Counter(), Counter(), Counter()]
    for i, x in toks:
        if not out(i):
            padded = ["BEGIN", "BEGIN", *x]
            for k in range(3):
                grams[k].update(tuple(padded[at - k : at + 1]) for at in range(2, len(padded)))
    ds = [own_discounts(g) for g in grams]
    n, v = sum(grams[0].values()), len(grams[0])
    freed = sum(c * (1 - ds[0].get(c, 1.0)) for c in grams[0].values())
    shrink = 1.0
    if n and freed <= 0:
        shrink, freed = n / (n + 1), n / (n + 1)
    after = [None, defaultdict(dict), defaultdict(dict)]
    for k in (1, 2):
        for g, c in grams[k].items():
            after[k][g[:-1]][g[-1]] = c

    def p(h, w):
        if not h:
            c = grams[0][(w,)]
            return c * ds[0].get(c, 1.0) * shrink / n if c else (freed / n if n else 1.0)
        seen = after[len(h)].get(h)
        if not seen:
            return p(h[1:], w)
        size = sum(seen.values())
        size += size > 5
        share = lambda c: c * ds[len(h)].get(c, 1.0) / size
        if w in seen:
            return share(seen[w])
        return (1 - sum(map(share, seen.values()))) / (1 - sum(p(h[1:], x) for x in seen)) * p(h[1:], w)

    rows = {}
    for i, x in toks:
        padded = ["BEGIN", "BEGIN", *x]
        base = sum(math.log10((grams[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        score = sum(math.log10(p(tuple(padded[at - 2 : at]), padded[at])) for at in range(2, len(padded)))
        rows.setdefault(i, (out(i), len(x), sum((w,) in grams[0] for w in x), n, base, score))
    total = lambda h: sum(p(h, w) for (w,) in grams[0]) + p(h, "never seen")
    return rows, [total(h) for h in [(), *list(after[1])[:15], *list(after[2])[:25], ("never", "seen"), ("never seen",)]]


def check_model(got, rows, corpus=None):
    want, totals = slow_model(corpus or rows)
    assert len(got) == len(rows) and all(abs(t - 1) < 1e-9 for t in totals)
    for r in got:
        held, tokens, known, n, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_language_model(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "a", *[f"x{k}" for k in range(60)]], int(rng.integers(0, 60)), p=None))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "unseen words of its own"), (None, "the of a"), (103, "same same same same same same same"), (104, "word" * 5000)]
    check_model(ngram_model.score_documents(materialise(frame(spark, rows).withColumn("chunk", F.lit("own")).repartition(3), "test")).collect(), rows)


def test_language_model_without_training_rows(spark):
    rows = [(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = ngram_model.score_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all((r.n_known, r.train_tokens, r.score) == (0, 0, 0.0) for r in got)
    assert ngram_model.score_documents(frame(spark, [])).count() == 0


def test_a_stored_model_scores_other_documents(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"y{int(rng.integers(0, 30))}"
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 50))))) for i in range(60)]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    inside, outside = [r for r in rows if not out(r[0])], [r for r in rows if out(r[0])]
    model = ngram_model.fit(frame(spark, inside))
    got = {r.doc_id: r.score for r in ngram_model.score(frame(spark, outside), model).collect()}
    want = {r.doc_id: r.score for r in ngram_model.score_documents(frame(spark, rows)).collect()}
    assert len(got) == len(outside) and all(math.isclose(x, want[i], rel_tol=1e-9) for i, x in got.items())
    assert {r.ngram for r in model.counts.select("ngram").collect()} == {1, 2, 3} and {r.ngram for r in model.weights.select("ngram").collect()} == {1, 2}


def test_model_of_many_slots_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 700)
    monkeypatch.setattr(chunks, "SLOT_BYTES", 900)
    rows = [(i, " ".join(rng.choice([f"x{k}" for k in range(25)], int(rng.integers(0, 40))))) for i in range(60)] + [(None, "x1 x2 x3"), (3, "x1 x2 x3")]
    check_model([r for r in ngram_model.score_documents(frame(spark, rows)).collect() if r.doc_id != 3], [r for r in rows if r[0] != 3], rows)


@pytest.mark.parametrize("counts", [[100, 40, 20, 12, 8, 5, 0], [0] * 7, [7, 0, 0, 0, 0, 0, 0], [6, 1, 0, 0, 0, 1, 0], [0, 3, 1, 0, 0, 2, 9]])
def test_discounts(counts):
    got = ngram_model.good_turing(np.array(counts))
    want = own_discounts({(r, k): r + 1 for r, n in enumerate(counts[:6]) for k in range(n)})
    assert all(math.isclose(got[r], want[r]) and 0 < want[r] < 1 for r in want) and got[-1] == 1


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_places_and_packed_arrays(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64 - 1, n, np.uint64, endpoint=True))
    wanted = np.random.default_rng(1).permutation(keys)
    assert (keys[chunks.place(keys, wanted)] == wanted).all() and (chunks.unpack(chunks.pack(keys), "<u8") == keys).all()
    parts = chunks.cut(keys, 7)
    assert parts[0] == 0 and parts[-1] == len(keys) and (np.diff(parts) >= 0).all()


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"t{int(x)}" for x in rng.integers(0, 5000, n))
    item = "What is the name of the long bridge over the wide grey water near Ostrel? They call it the Bridge of Nine Lamps."
    rows = [(i, words(60)) for i in range(20)]
    rows += [(50, rows[0][1]), (51, rows[1][1].upper()), (60, f"{words(30)} {item} {words(30)}"), (70, f"{words(40)} mail me@site.example now {words(10)}"), (80, "too short"), (81, "again and again " * 40), (90, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    passed = {i: t for i, t in rows if t and len(t.split()) >= 20 and not quality_rules.measure(t.encode())[4] * 100 > 30 * len(t.split())}
    assert set(kept[0]) == set(passed)
    fps, groups = {i: simhash.fingerprint_of(t.encode()) % (1 << 64) for i, t in passed.items()}, {}
    for i in sorted(fps):
        groups[i] = next((g for j, g in groups.items() if (fps[i] ^ fps[j]).bit_count() <= 2), i)
    assert set(kept[1]) == {i for i, g in groups.items() if g == i} and 50 not in kept[1]
    assert set(kept[1]) - set(kept[2]) == {60} and set(kept[3]) == set(kept[2])
    assert "[email]" in kept[3][70] and "me@site" not in kept[3][70] and kept[3][2] == passed[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == set(kept[3]) and sum(r.length for r in final) == sum({r.doc_id: r.doc_tokens for r in final}.values())
    assert decontaminate.Settings() and pii.Settings()


def test_a_shuffled_plan_is_written_before_it_is_chunked(spark, tmp_path):
    rows = passages(6, 15)
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    shuffled = spark.read.parquet(str(tmp_path / "d")).repartition(3, "doc_id")
    assert chunks.chunked(shuffled)[0].select("chunk").distinct().count() >= 1
    got = substring_dedup.dedup_phrases(shuffled).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == slow_removal(rows)


def test_classifier_folds_are_crc32(spark):
    from corvid.llm.quality_classifier import fold

    ids = [0, 1, 17, 12345678901, -5]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold(3).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    some = lambda n: bytes(rng.choice(list(b"ab \t\n\x0b\x0c\r\x00\x1f\x85\xa0z"), int(n)).astype(np.uint8))
    word = lambda n: bytes(rng.integers(33, 256, int(n)).astype(np.uint8))
    texts = [b"", b" ", b"x", *(some(n) for n in rng.integers(0, 60, 200)), *(b" ".join(word(n) for n in rng.integers(1, 80, 40)) for _ in range(20)), b"", b"\n\n"]
    for part in (texts, texts[:1], texts[1:3], []):
        words = [w for x in part for w in x.split()]
        ids, n = chunks.hashed_words(part)
        assert ids.tolist() == chunks.word_ids(words).tolist() and n.tolist() == [len(x.split()) for x in part]
    monkeypatch.setattr(chunks, "word_ids", None)  # no word by word
    own = ngram_model.Chunk(ngram_model.blocks(iter([pa.RecordBatch.from_pydict({"doc_id": [1, None, 3], "text": ["A b\na", None, "b " * 9]})])), lambda d: True)
    assert own.lengths.tolist() == [4, 1, 10] and own.tokens[0][[3, 4, 14]].tolist() == [ngram_model.END] * 3


def test_the_stage_of_personal_data_takes_many_texts_with_numbers(spark):
    """Over 23,170 of them and a number that discloses someone: the squared count passed 32 bits."""
    plain = spark.range(24_000).select("id", F.concat(F.lit("lot "), F.col("id"), F.lit(" came late")).alias("text"))
    held = spark.range(24_000, 24_008).select("id", F.concat(F.lit("ask kim@firm.example about 7771234 in week "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 3)).alias("text"))
    clean = corpus_pipeline.pii(spark, plain.unionByName(held).select(F.col("id").alias("doc_id"), "text"), None)
    assert clean.where("text like '%7771234%'").count() == 0 and clean.where("text like '%[email] % [number] %'").count() == 8
