"""The manifest held against a plain recursive tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corvid.llm import merkle
from corvid.plans.scratch import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes, fanout):
    """The top of a list of digests and each one's (left, right) siblings from the bottom up."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = nodes[at - at % fanout : at - at % fanout + fanout]
            paths[k].append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        nodes, where = [h("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)], [at // fanout for at in where]
    return nodes[0], paths


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, inner, ordered = {}, {}, {}
    for g in langs:
        ordered[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[g], inner[g] = tree([leaf(r) for r in ordered[g]], fanout)
    root, outer = tree([tops[g] for g in langs], fanout)
    return [(r[0], r[2], leaf(r), tops[g], root, path + outer[k]) for k, g in enumerate(langs) for r, path in zip(ordered[g], inner[g], strict=True)]


def documents(n, langs, repeat=()):
    rows = [(i, None if i % 7 == 3 else f"Text {i} ÄÉ " + "x" * (i % 50), langs[i * i % len(langs)], None if i % 5 == 0 else f"s{i % 3}", None if i % 11 == 0 else i) for i in range(n)]
    return rows + [r for r in rows if r[0] in repeat]


@pytest.mark.parametrize(("n", "langs", "fanout"), [(150, ["en", None, "", "Δ", "zz", "a"], 3), (130, ["en"], 8), (9, ["a", "b", "c", "d", "e", "f", "g", "h", "i"], 8), (1, ["en"], 8), (30, [f"l{k}" for k in range(30)], 2)])
def test_manifest(spark, n, langs, fanout):
    rows = [*documents(n, langs, repeat=(0, 4, 5)), (None, "no id", langs[0], None, 3), (None, "", None, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout=fanout).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.lang, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got) == order(plain(rows, fanout))


def test_one_row_and_no_row(spark):
    only = spark.createDataFrame([(7, "Abc", "en", "s", 3)], SCHEMA)
    r = merkle.manifest(only).first()
    assert r.leaf == r.subroot == r.root == leaf((7, "Abc", "en", "s", 3)) and r.path == []
    assert merkle.manifest(only.limit(0)).count() == 0


def test_the_query_finds_what_was_altered(spark, tmp_path):
    rows = documents(200, ["en", "de", None])
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "idx", "h", "path", "part", "children")})
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == 200
    for i, lang, own, subroot, root, path in plain(rows, 8):
        r, (_, text, _, source, n) = got[i], rows[i]
        changed = zlib.crc32(str(i).encode()) % 3 == 0
        folded = leaf((i, text if text is None or not changed else "".join(c.lower() if c.isascii() else c for c in text), lang, source, n))
        assert r.verified == (folded == own) == (not changed or text is None)
        for left, right in path:
            folded = h(left + folded + right)
        assert (r.leaf, r.subroot, r.root, r.folded_root, r.proof_sha256) == (own, subroot, root, folded, h("".join(a + b for a, b in path)))


def test_very_long_text_and_many_ranges(spark):
    rows = [(i, "w " * 300_000 if i == 3 else "w", "en", "s", 1) for i in range(40)]
    df = materialise(spark.createDataFrame(rows, SCHEMA).repartition(7), "test")
    got = merkle.manifest(df).collect()
    assert {(r.doc_id, r.leaf, r.root) for r in got} == {(p[0], p[2], p[4]) for p in plain(rows, 8)}
