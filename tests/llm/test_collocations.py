"""Collocations held against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import collocations
from corvid.llm.collocations import Heavy, Stream, candidates, count_matches, heavy_cells, sketch
from corvid.plans.scratch import materialise

SCHEMA = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def split(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain(rows, at_least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for w in split(text):
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= at_least}
        scores = []
        for p, a in frequent.items():
            if any(frequent[q] >= a for q in frequent if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scores.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "c d", "é", "É", "x\ty", "new york city", "in the of a", "\x00", "\x1c", "z\u00a0z", "long" * 20]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", "\t", "\x0b", "!?", "  "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, rows[0], rows[0], (1, None, "en"), (2, "", "fr"), (3, "a " * 400, "en"), (4, " .,", None)]


@pytest.mark.parametrize(("seed", "at_least", "top"), [(1, 12, 2000), (2, 25, 7)])
def test_collocations(spark, seed, at_least, top):
    rows = texts(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"chunk": F.lit(1), "slot": F.lit("x"), "size": F.lit(2)}).repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(df, at_least, top).collect()) == plain(rows, at_least, top)


def test_many_chunks_and_slots(spark, monkeypatch):
    rows = texts(3, 200)
    df = materialise(spark.createDataFrame(rows, SCHEMA).repartition(4), "test")
    found = collocations.frequencies(df, 15, chunk_bytes=900).collect()
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for w in split(text):
            f[lang or "und"].update({(): len(w)})
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {(lang, len(p), " ".join(p), a) for lang, c in f.items() for p, a in c.items() if a >= 15 or not p}
    got = {(r.lang, r.size, r.phrase, r.f) for r in found}
    assert {x for x in got if x[1]} == {x for x in want if x[1]}
    assert {x for x in got if not x[1] and x[3]} == {x for x in want if not x[1] and x[3]}


def test_crowded_cells_lose_nothing(monkeypatch):
    """A sketch with few cells only adds candidates."""
    monkeypatch.setattr(collocations, "SLOT_CELLS", 64)
    import pyarrow as pa

    data = [t or "" for _, t, lang in texts(4) if lang == "en"]
    batch = pa.RecordBatch.from_pydict({"chunk": [k % 3 for k in range(len(data))], "lang": ["en"] * len(data), "text": data})
    rows = pa.Table.from_batches(list(sketch(iter([batch]), 3, 500))).sort_by("slot")
    answers = pa.Table.from_batches(list(heavy_cells(iter(rows.to_batches()), 10))).to_pylist()
    counts = Counter()
    for t in data:
        for w in split(t):
            counts.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    seen = Counter()
    for chunk in range(3):
        stream = Stream([t.encode() for k, t in enumerate(data) if k % 3 == chunk], "en")
        _, places = candidates(stream, Heavy([a for a in answers if a["chunk"] == chunk]), 3)
        phrases = [b" ".join(stream.words[i : i + k]) for k, at in places for i in at.tolist()]
        assert len(set(phrases)) == len(phrases)
        for i, n in count_matches(phrases, stream.words, 5).items():
            seen[tuple(phrases[i].decode().split(" "))] += n
    assert {p: n for p, n in seen.items() if n >= 10} == {p: n for p, n in counts.items() if n >= 10 and len(p) > 1}


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    rows = [("en", 0, "", 3 * big), ("en", 1, "p", big), ("en", 1, "q", big - 1), ("en", 2, "p q", big - 2), ("en", 1, "r", 5), ("en", 2, "q r", 4), ("en", 3, "p q r", 4)]
    got = {r.phrase: r for r in collocations.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).collect()}
    assert got["p q"].score == 1000 * (big - 2) * 3 * big // (big * (big - 1))
    cuts = {1: 1000 * 4 * 3 * big // (big * 4), 2: 1000 * 4 * 3 * big // ((big - 2) * 5)}
    assert got["p q r"].k == min(cuts, key=lambda k: (cuts[k], k)) and got["p q r"].score == min(cuts.values())
    left = {r.phrase for r in collocations.not_contained(spark.createDataFrame([tuple(got[p][:4]) for p in got], "lang string, size int, phrase string, a long")).collect()}
    assert left == {"p q", "p q r"}


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "a b", "en")], SCHEMA)
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    rows = [(1, " ".join(f"w{k}" for k in rng.integers(0, 40, 150_000)), "en"), (2, "w1 w2", "en")]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), 120).collect()
    assert sorted(map(tuple, got)) == [r for r in plain_long(rows, 120)]


def plain_long(rows, at_least):
    return plain(rows, at_least, 2000)
