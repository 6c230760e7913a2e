"""Operators on single texts and their host, held against plain definitions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvid.llm import chat_format, decontaminate, license_rules, packing, pii, quality_classifier, quality_rules, simhash

WS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "one two"), (6, "x " * 3000), (7, "word" * 20000), (8, "A b  c"), (8, "A b  c"), (None, "no id here at all"), (9, "line\nline\n\nline\n")]


def docs(spark, rows):
    return spark.createDataFrame([(i, x, "en", None if i is not None and i % 2 else "h", 0) for i, x in rows], DOCS)


def clash(df):
    """Extra columns with names that the operators use themselves."""
    for c in ("stats", "fp", "spans", "extra", "key", "gone", "component_id", "host", "kept", "v_host", "chunk", "x_doc"):
        df = df.withColumn(c, F.lit("own"))
    return df


# ---- SimHash


def slow_fingerprint(text):
    words = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_of_edges(spark):
    got = docs(spark, EDGE).select("text", simhash.fingerprint("text").alias("fp")).select("text", simhash.hex_of("fp").alias("h")).collect()
    assert all(r.h == f"{slow_fingerprint(r.text):016x}" for r in got) and len(got) == len(EDGE)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abAB é\n\t "), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text.encode()) % (1 << 64) == slow_fingerprint(text)


def groups_of(fps):
    """Smallest id reachable over at most two differing bits."""
    ids, parent = list(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: min(j for j in ids if root(j) == root(i)) for i in ids}


@pytest.mark.parametrize("bucket", [64, 3])
def test_components(spark, bucket):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = {}
    for i in range(240):
        x = base[i % 12]
        for b in rng.integers(0, 64, i % 6):
            x ^= 1 << int(b)
        fps[i] = x
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()] + [(1000, 0), (1001, 0), (None, 0)]
    got = {r.doc_id: r.component_id for r in simhash.with_components(spark.createDataFrame(signed, "doc_id long, fp long"), bucket).collect()}
    want = groups_of(fps | {1000: 0, 1001: 0})
    assert {k: v for k, v in got.items() if k is not None} == want and got[None] == 1000


def test_a_fingerprint_without_an_id_links_others(spark):
    rows = [(1, 0b11), (None, 0b1111), (2, 0b111111), (None, 1 << 40)]
    got = Counter((r.doc_id, r.component_id) for r in simhash.with_components(spark.createDataFrame(rows, "doc_id long, fp long")).collect())
    assert got == Counter([(1, 1), (None, 1), (2, 1), (None, None)])


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "quite another text with other words"), (None, "a b c d e f"), (4, None), (5, "")]
    kept = simhash.keep_one_per_group(clash(docs(spark, rows)))
    assert {r.doc_id for r in kept.collect()} == {1, 3, None, 4} and kept.columns == clash(docs(spark, rows)).columns
    assert simhash.keep_one_per_group(docs(spark, [])).count() == 0


# ---- quality rules


def slow_measures(text):
    text = text or ""
    words = WS.findall(text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_measures_of_edges(spark):
    rows = quality_rules.measured_texts(docs(spark, EDGE), ["text"]).collect()
    assert all(tuple(r)[1:] == slow_measures(r.text) for r in rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#c", "é", "\n", " "]), max_size=60))
def test_measures(parts):
    text = " ".join(parts)
    assert quality_rules.measure(text.encode()) == slow_measures(text)


def test_host_verdicts_are_shrunk_and_joined(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "short", "bad", i) for i in range(90)] + [(100 + i, good, "bad", i) for i in range(3)] + [(200 + i, good, "fine", i) for i in range(90)] + [(300, "short", "small", 0), (301, good, "small", 0), (302, good, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    measured = quality_rules.measured_texts(df, ["doc_id", "source"])
    got = {r.doc_id: r for r in quality_rules.with_verdicts(measured, "source").collect()}
    assert got[100].host_rejected and not got[100].kept and not got[100].base_failed
    assert got[200].kept and got[301].kept and got[302].kept and got[300].base_failed
    kept = quality_rules.keep_documents(df.withColumn("stats", F.lit(1)).withColumn("v_host", F.lit(2)))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns == [*df.columns, "stats", "v_host"]
    assert quality_rules.keep_documents(docs(spark, [])).count() == 0


# ---- licenses


def slow_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    places = [(i, label) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("text", ["Under the MIT License. under-the-mit-license", "Apache License, Version 2.0 and CC BY-NC 4.0", "cc by nc cc by nc", "undér the mit license", None, "", "mit license " * 4000])
def test_license_base(text):
    got = license_rules.scan((text or "").encode())
    assert tuple(got[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == slow_base(text)
    assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(","))) and 0 <= got["score"] <= 1


def test_license_rules_and_suppression():
    assert len(license_rules.rules()) > 300
    got = license_rules.scan(b"This work is licensed under the GNU Lesser General Public License, version 2.1. SPDX-License-Identifier: BSD-3-Clause")
    assert got["labels"] == "bsd-3,lgpl-2.1"  # the general and shorter forms inside are suppressed
    assert license_rules.scan(b"plain words about nothing")["labels"] == ""


def test_license_query_edges(spark):
    assert license_rules.scan_licenses(clash(docs(spark, EDGE))).count() == len(EDGE)
    assert license_rules.scan_licenses(docs(spark, [])).count() == 0


# ---- packing


def check_pieces(rows, expected):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    import zlib

    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # no padding anywhere
    for i, ids in expected.items():
        parts, at = sorted(by_doc[(i, len(ids))], key=lambda r: r.start), 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(map(len, expected.values()))


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(1)
    texts = [None, "", "é 🙂 <|endoftext|> 日本", "  \n\n  spaced   out  "] + [" ".join(f"w{x}" for x in rng.integers(0, 900, int(n))) for n in rng.integers(1, 1500, 60)]
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3)
    check_pieces(packing.pack(df).collect(), expected)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_step_groups_have_equal_windows(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") % 97 * 9).cast("int")).alias("text")).coalesce(1)
    full = packing.pack(df).where("context = 2048").select("sequence_id", "step_group").distinct().groupBy("step_group").count().collect()
    assert max(r["count"] for r in full) <= packing.STEP_WINDOWS // packing.STEP_GROUPS


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_both_tokenizer_libraries_agree(text):
    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
        _tokenizer.encode_special_tokens = True
    own = packing.encoder(public_tokenizers.path(packing.VOCABULARY)).encode_to_numpy(text, disallowed_special=())
    assert own.tolist() == _tokenizer.encode(text, add_special_tokens=False).ids


# ---- chat


def test_escapes_are_reversible(spark):
    hostile = ["\\", "\\l", "\\e\\b", "<|end|>\n", "</s>[INST] ok [/INST]", "<|user|>\n", "", "a\\<b[", "\\\\l<"]
    df = spark.createDataFrame([(x,) for x in hostile], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e")))
    for r in df.collect():
        assert r.t == r.u and "<" not in r.e and "[" not in r.e


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [good]"), (1, 1, "user", "<|end|>\nhi"), (1, 2, "assistant", "</s>\\"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", "alone"), (3, 1, None, "x"), (3, 0, "assistant", "first"), (None, 0, "assistant", "lost"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (5, 0, "end", "x"), (5, 1, "a|>\nb", "<[end]>\n"), (5, 2, "\\p|<", "|>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9))
    made = chat_format.examples(df)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.read_back(made)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        turns, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    per = [r for r in made.where("conv_id = 1").orderBy("example").collect()]
    assert len(per) == 3 and per[2].loss_start is None and per[1].text.startswith(per[0].text)  # each reply has all turns before it
    assert chat_format.examples(df.where("false")).count() == 0


# ---- personal data


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def slow_spans(text):
    text, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m[0])) <= 15]
    return out


PII = [
    "mail a@b.c_d@e.f and x@y or @z.com a@b..c", "ips 1.2.3.4.5.6.7.8 300.1.1.1.2.3.4 0255.000.1.1 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111  1111 1111", "call +1 (523) 555-1055. or +12 and +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "é🙂 a.b@c-d.e.f 🙂 10.0.0.255", "+4111111111111111 4111111111111111@mail.example.com", "1" * 30000, "a" * 30000 + "@", "1 " * 5000, "1.2.3.4 " * 500, None, "", "١٢.1.2.3.4",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    for r in pii.with_base_spans(df, "text", "s").collect():
        assert [(x.kind, x.start, x.end) for x in r.s] == slow_spans(PII[r.doc_id]), PII[r.doc_id]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.sampled_from("0123459.-+@ ()ab%"), max_size=50), min_size=1, max_size=40))
def test_base_spans_of_anything(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.with_base_spans(df, "text", "s").collect():
        assert [(x.kind, x.start, x.end) for x in r.s] == slow_spans(r.text)


def slow_extra(rows, threshold=0.8, majority=0.5, z=1.645):
    """Added spans by row, from the definitions: distinct texts counted for every term and entity, one by one."""
    run = regex.compile(r"[\p{L}\p{M}\p{N}]+")
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    words = [[(m[0], *m.span()) for m in run.finditer(t)] for t in low]
    entities, own = [], []
    for (_, t), w in zip(rows, words, strict=True):
        spans = slow_spans(t)
        value = lambda k, v: v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)
        entities.append({(k, value(k, t[a:b])) for k, a, b in spans})
        own.append({x for x, a, b in w if not any(a <= e and s <= b for _, s, e in spans)})
    once = [k for k, (_, t) in enumerate(rows) if (t or "") not in {u or "" for _, u in rows[:k]}]
    n, kind_of = len(once), lambda x: "word" if not regex.search(r"\p{N}", x) else "code" if regex.search(r"[\p{L}\p{M}]", x) else "number"
    rows_with = lambda of: Counter(x for r in of for x in set(r))
    n_t, n_e = rows_with([[x for x, _, _ in words[k]] for k in once]), rows_with([entities[k] for k in once])
    n_class = rows_with([[kind_of(x) for x, _, _ in w] + ["code"] * bool(regex.search(r"[\p{L}\p{M}]\p{N}|\p{N}[\p{L}\p{M}]", t)) for w, t in ((words[k], low[k]) for k in once)])
    together = Counter((e, x) for k in once for e in entities[k] for x in own[k])
    classes = Counter((e, c) for k in once for e in entities[k] for c in {kind_of(x) for x in own[k]})

    def tells(both, alone, e):
        p = n_e[e] / n
        rate = both / alone
        given = (rate + z * z / (2 * alone) - z * math.sqrt(rate * (1 - rate) / alone + (z / (2 * alone)) ** 2)) / (1 + z * z / alone)
        return p < 1 and given > majority and math.log(given / p) >= threshold * -math.log(p)

    action = {}
    for (e, x), both in together.items():
        if tells(both, n_t[x], e):
            k = kind_of(x)
            action[x] = "removed" if action.get(x) == "removed" or (k != "word" and tells(classes[e, k], n_class[k], e)) else k
    return [sorted({(action[x], a, b) for x, a, b in w if x in action}) for w in words]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_added_spans(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"p{k}@site.example" for k in range(4)] + ["10.1.2.3", "+1 523 555 1055"]
    rare = ["Zorblax", "kx9", "004417", "\u00e9t\u00e9", "O'Neil", "lone1", "x", "77"]
    rows = []
    for i in range(200):
        parts = [f"c{int(k)}" for k in rng.integers(0, 9, 12)] + ["and", "the"]
        if rng.random() < 0.5:
            who = int(rng.integers(0, 6))
            parts += [names[who], rare[who], rare[who + 2]] + ([f"u{i}"] if rng.random() < 0.5 else [])
        if rng.random() < 0.1:
            parts.append(rare[int(rng.integers(0, 8))])
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(300, None), (301, ""), (None, f"{names[0]} Zorblax"), (302, rows[0][1]), (3, rows[3][1]), (303, "me:p1@site.example. kx9,kx9"), (304, "a" * 30000)]
    found = pii.analyse(clash(docs(spark, rows)))
    got = {(r.doc_id, r.text_key): [(x.kind, x.start, x.end) for x in r.extra] for r in found.extra.collect()}
    keys = [r.k for r in docs(spark, rows).select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()]
    want = {(i, k): x for (i, _), k, x in zip(rows, keys, slow_extra(rows), strict=True) if x}
    assert got == want and len({k for x in want.values() for k, _, _ in x}) > 1


def test_disclosing_terms(spark):
    common = "we met the team and talked about plans for the next year"
    far = " ".join(["and so on"] * 30)
    rows = [(i, f"{common} write to boss@corp.com {far} about zorblax soon {i}") for i in range(8)] + [(200 + i, f"{common} and nothing else {i} {far}") for i in range(200)] + [(90, "only zorblax here"), (91, f"{common} one@two.com once"), (92, None)] + [(93 + i, f"{common} six@two.com copied") for i in range(9)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    clean = {r.doc_id: r for r in pii.sanitise(clash(df)).collect()}
    assert "zorblax" not in clean[0].text and "[email]" in clean[0].text and "the team" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[200].text == rows[8][1] and clean[90].text == "only [word] here" and clean[92].text is None
    assert clean[91].text == f"{common} [email] once"  # one text together proves nothing
    assert clean[95].text == f"{common} [email] copied"  # nor do copies of one text
    assert pii.sanitise(df.where("false")).count() == 0 and len(clean) == len(rows)


def test_a_number_discloses_among_many_texts_with_numbers(spark):
    """Counts of texts are squared: beyond 23,170 of them four squares pass 32 bits."""
    plain = spark.range(25_000).select("id", F.concat(F.lit("lot "), F.col("id"), F.lit(" came late")).alias("text"))
    held = spark.range(25_000, 25_008).select("id", F.concat(F.lit("ask kim@firm.example about 7771234 in week "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 3)).alias("text"))
    df = plain.unionByName(held).select(F.col("id").alias("doc_id"), "text")
    found = {r.doc_id: [r.text[x.start : x.end] for x in r.extra if x.kind == "number"] for r in pii.analyse(df).extra.join(df, "doc_id").collect()}
    assert found == {i: ["7771234"] for i in range(25_000, 25_008)}


def test_terms_are_generalised_to_a_class_that_discloses_nothing(spark):
    plain = "some text of ordinary words goes on here"
    rows = [(i, f"{plain} order 004417 by boss@corp.com under ref kx9 today {i}") for i in range(5)] + [(10 + i, f"{plain} with {i} and a{i} in it") for i in range(200)]
    clean = pii.sanitise(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")).where("doc_id = 0").first().text
    assert "[number]" in clean and "[code]" in clean and "004417" not in clean and "kx9" not in clean and plain in clean
    alone = [(i, f"{plain} by boss@corp.com under ref kx9 {'so ' * i}") for i in range(5)] + [(10 + i, f"{plain} {'on ' * i}") for i in range(200)]
    clean = pii.sanitise(spark.createDataFrame(alone, "doc_id long, text string")).where("doc_id = 0").first().text
    assert "kx9" not in clean and "[code]" not in clean  # no other row has a code, so the class tells as much
    counts = spark.createDataFrame([("12-3 x",), ("x12",), ("1 x",), ("none",), ("a-1",), ("1a",)], "t string")
    got = [(r.n, r.c) for r in counts.select(F.col("t").rlike(pii._NUMBER).alias("n"), F.col("t").rlike(pii._CODE).alias("c")).collect()]
    assert got == [(True, False), (False, True), (True, False), (False, False), (True, False), (False, True)]


# ---- decontamination

ITEM = "Which river runs past the old northern harbour town of Velm? It is the quiet green river Osk that runs there."
OTHER = "Short item of six words only here. Yes"


def test_contamination(spark):
    fill = " ".join(f"filler{i}" for i in range(300))
    rows = [(1, f"{fill} {ITEM} {fill}"), (2, ITEM.upper().replace(" ", "\n")), (3, fill), (4, ITEM[:50]), (5, None), (6, ITEM.replace("northern", "southern")), (1, f"{fill} {ITEM} {fill}"), (None, ITEM), (7, f"{ITEM} {OTHER}"), (8, "Too few!"), (9, "these are too few")]
    bench = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, "too few"), (14, OTHER), (15, "")], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(clash(docs(spark, rows)), bench).collect()]
    assert Counter(found) == Counter([(d, i) for d in (1, 1, 2, None, 7) for i in (10, 11)] + [(7, 14), (8, 13)])
    split = [(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs(spark, rows), bench, decontaminate.Settings(max_bytes=150)).collect()]
    assert Counter(split) == Counter(found)
    kept = decontaminate.drop_contaminated(clash(docs(spark, rows)), bench)
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [3, 4, 5, 6, 9]
    assert decontaminate.drop_contaminated(docs(spark, rows), bench.where("false")).count() == len(rows)
    assert decontaminate.contaminated_pairs(docs(spark, []), bench).count() == 0


def test_wand_finds_what_exhaustive_scoring_finds():
    rng = np.random.default_rng(3)
    words = [f"t{i}".encode() for i in range(300)]
    items = [(i, b" ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(12, 40, 150))]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    searcher = decontaminate.Searcher(items, df, len(items), 25.0, decontaminate.Settings(block=3))
    for k in range(60):
        passage = set(decontaminate.words_of(items[k][1])) | set(rng.choice(words, 30))
        for band in searcher.bands:
            terms = sorted(w for w in passage if w in band.lists)
            score = Counter()
            for w in terms:
                for i, v in zip(*band.lists[w], strict=True):
                    score[i] += v
            assert sorted(i for i, _ in band.search(terms)) == sorted(i for i, v in score.items() if v >= band.least)


@pytest.mark.parametrize("seed", range(6))
def test_found_pairs_against_the_overlap_of_all_passages(seed):
    rng = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(120)]
    some = lambda n: " ".join(rng.choice(words, int(n)))
    items = [(k, f"{some(rng.integers(1, 40))}? {some(rng.integers(1, 12))}.".encode()) for k in range(120)] + [(500, b"t1 t2"), (501, b"")]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    searcher = decontaminate.Searcher(items, df, len(items), 25.0, decontaminate.Settings(block=2, max_blocks=int(rng.integers(3, 40))))
    found = 0
    for _ in range(60):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            own = decontaminate.words_of(items[int(rng.integers(0, 120))][1])
            for at in rng.integers(0, len(own), int(rng.integers(0, 3))):
                own[at] = b"other"
            parts += [*own, *some(rng.integers(0, 60)).encode().split()]
        want = []
        for band in searcher.bands:
            for k, text in enumerate(band.texts):
                question, answer = decontaminate.question_and_answer(text)
                sets = [decontaminate.shingles(x) for x in (decontaminate.words_of(text), question, answer)]
                for begin in range(0, max(1, len(parts) - band.stride), band.stride):
                    near = decontaminate.shingles(parts[begin : begin + 2 * band.stride])
                    share = [len(x & near) / len(x) if x else 1.0 for x in sets]
                    if len(parts) >= 5 and share[0] >= 0.8 and min(share[1:]) >= 0.5:
                        want.append(band.ids[k])
                        break
        got = [m[0] for m in searcher.matches(b" ".join(parts))]
        assert Counter(got) == Counter(want if len(parts) >= 5 else got)
        found += len(got)
    assert found > 20


def test_a_large_benchmark_stays_small():
    import pickle

    rng = np.random.default_rng(1)
    words = np.array([f"v{i}" for i in range(30_000)])
    items = [(k, " ".join(words[(rng.zipf(1.3, int(n)) % 30_000)]).encode()) for k, n in enumerate(rng.integers(5, 120, 20_000))]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    searcher = decontaminate.Searcher(items, df, len(items), 60.0, decontaminate.Settings())
    assert len(pickle.dumps(searcher)) < 8 * sum(len(t) for _, t in items)
    text = b" ".join([*words[:3000].astype("S")]) + b" " + items[77][1]
    assert 77 in {m[0] for m in searcher.matches(text)}


def test_documents_share_the_look_at_block_maxima(monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(words, int(n))).encode()) for k, n in enumerate(rng.integers(1, 60, 80))]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    searcher = decontaminate.Searcher(items, df, len(items), 25.0, decontaminate.Settings())
    texts = [b" ".join([*rng.choice(words, int(rng.integers(0, 200))).astype("S"), *([items[k % 80][1]] if k % 3 else [])]) for k in range(300)] + [b"", items[2][1], b"t1 " * 9000]
    alone = [searcher.matches(x) for x in texts]
    assert sum(map(bool, alone)) > 150
    looks, look = [], decontaminate.Index.reachable
    monkeypatch.setattr(decontaminate.Index, "reachable", lambda *a: looks.append(1) or look(*a))
    for limit in (1, 700, decontaminate.BLOCK_WORDS):
        looks.clear()
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", limit)
        assert list(searcher.matches_of(texts)) == alone
    assert len(looks) <= 2 * len(searcher.bands)


def test_a_very_long_text_is_searched(spark):
    fill = " ".join(f"q{i % 5003}" for i in range(120_000))
    found = decontaminate.contaminated_pairs(docs(spark, [(1, f"{fill} {ITEM} {fill}"), (2, fill)]), spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 10)]


# ---- classifier


def test_classifier_learns_and_is_defined_on_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, len(quality_classifier.FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    forest = quality_classifier.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9
    assert quality_classifier.fit(x[:5], y[:5]).score(x[:3]).shape == (3,) and quality_classifier.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    measured = clash(docs(spark, EDGE)).select("doc_id", quality_classifier.text_statistics("text").alias("stats"))
    scores = quality_classifier.scored(measured, forest).collect()
    assert len(scores) == len(EDGE) and all(0 <= r.score <= 1 for r in scores)


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(quality_classifier.FEATURES))).astype(np.float32)
    forest = quality_classifier.fit(x, (x[:, 0] > 0).astype(float), quality_classifier.Settings(trees=5, depth=3))
    bins = forest.binned(x)
    for row, score in zip(bins, forest.score(x), strict=True):
        total = forest.start
        for f, s, v in zip(forest.feature, forest.split, forest.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > s[node])
            total += v[node - len(f)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
