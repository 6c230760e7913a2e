import html
import json
import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corvid.functions import similarity, text
from corvid.functions.parse import cards, decode_payload, first_per_slug, first_slug
from corvid.operators import evidence, ranking, taxonomy
from corvid.plans import more_queries, queries

CASES = {"Тёмный ЛЕС, №7": "темный лес no7", "naïve": "na ve", "A—B…C": "a b c", "x²": "x2", "\tТри   слова\n": "три слова", "…": "", "": ""}


def test_normalize_exact(spark):
    df = spark.createDataFrame([(x,) for x in CASES], "t string")
    assert {r.t: r.n for r in df.select("t", text.normalized_exact("t").alias("n")).collect()} == CASES
    assert text.normalize_text(None) == ""


def test_tokens_and_keys(spark):
    row = spark.range(1).select(text.tokens(F.lit("Q лес 3 1999 ab")).alias("t"), text.fuzzy_key(text.normalized(F.lit("РЕКА"))).alias("k"), text.edit_similarity(F.lit("lantern"), F.lit("lanterns")).alias("s"), text.vlm_lines(F.lit("## One\n* one\n\ny\nTwo<|endoftext|>")).alias("v")).first()
    assert row.t == ["лес", "1999", "ab"] and row.k == "reka" and math.isclose(row.s, 7 / 8) and [x.normalized for x in row.v] == ["one", "two"]


MAKERS = ["Северный мост", "Lantern Hill Estate", "Озеро"]
RESOLVE = [
    ([("СЕВЕРНЫЙ МОСТ", 0.9)], "Северный мост"), ([("lantern hill", 0.93)], "Lantern Hill Estate"), ([("OZERO", 0.97)], "Озеро"),
    ([("nothing of that kind", 0.99)], None), ([("some other line", 0.9), ("Озеро", 0.95)], "Озеро"),
]


@pytest.mark.parametrize(("lines", "expected"), RESOLVE)
def test_resolve(spark, lines, expected):
    rows = spark.createDataFrame([(4, i, x, s) for i, (x, s) in enumerate(lines)], "query_id int, position int, text string, score double")
    got = taxonomy.resolve(rows, spark.createDataFrame([(v,) for v in MAKERS], "value string")).first()
    assert got.value == expected and got.mode == ("hard" if expected else "none")


def test_ratios(spark):
    pairs = [("marchenko", "marchenka"), ("abcd", "bcda"), ("", "a"), ("x", "x")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.seq_ratio("a", "b").alias("s"), similarity.indel_ratio("a", "b").alias("i"))
    for r in df.collect():
        assert math.isclose(r.s, SequenceMatcher(None, r.a, r.b).ratio())
        table = [[0] * (len(r.b) + 1) for _ in range(len(r.a) + 1)]
        for i, x in enumerate(r.a):
            for j, y in enumerate(r.b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert math.isclose(r.i, 200 * table[-1][-1] / (len(r.a) + len(r.b)))


def test_text_scores_equal_the_definition(spark):
    lines, refs = [(0, "alpha beta gamma", 0.9), (0, "beta 12 delta", 0.5)], [(1, "alpho bexa delta 12"), (2, "zzzz yyyy")]

    def brute(ref):
        own, found = ref.split(), []
        for _, line, conf in lines:
            for token in line.split():
                s = float(token in own) if token.isdigit() else max(SequenceMatcher(None, token, c).ratio() for c in own)
                if s >= 0.55:
                    found.append((s, conf * min(len(token) / 7, 1)))
        found = sorted(found, key=lambda x: x[0] * x[1], reverse=True)[:6]
        d = sum(w for _, w in found)
        return sum(s * w for s, w in found) / d * (0.55 + 0.45 * min(len(found) / 3, 1)) if d else 0.0

    got = {r.item_id: r.score for r in evidence.text_scores(spark.createDataFrame(lines, "query_id int, text string, score double"), spark.createDataFrame(refs, "item_id int, text string")).collect()}
    for item, ref in refs:
        assert math.isclose(got.get(item, 0.0), brute(ref), abs_tol=1e-9)


def test_field_evidence(spark):
    q = spark.createDataFrame([(7, 3, "silver lantern reserve 1999")], "query_id int, item_id int, text string")
    score = lambda t: evidence.field_scores(q, spark.createDataFrame([(3, t)], "item_id int, text string")).first().score
    assert score("Silver Lantern 1999") > 0.9 > score("copper bucket")
    assert spark.range(1).select(evidence.year_evidence(F.lit("reserve 1999"), F.lit("reserve 1999")).alias("y"), evidence.year_evidence(F.lit("reserve 1998"), F.lit("reserve 1999")).alias("n")).first().y == 1.0


def test_deduplicated_lines(spark):
    df = spark.createDataFrame([(2, "Northern Harbour", 0.9), (2, "northern harbouz", 0.8), (2, "harbour", 0.7), (2, "1987", None)], "image int, text string, score double")
    assert sorted(r.text for r in evidence.deduplicated_lines(df, "image").collect()) == ["1987", "Northern Harbour"]


def test_cards(spark):
    page = '<a href="/wines/one" class="card wine-item"><img src="/x.png"><img src="https://api.host/i.webp?a=1&amp;b=2"><h2>One &amp; <b>only</b></h2><span>Maker</span></a><a href="/wines/two" class="wine-item"><h2>No image</h2></a>'
    got = first_per_slug(cards(spark.createDataFrame([(3, page), (4, page)], "page int, html string"), "https://site", "api.host")).collect()
    assert [(r.slug, r.title, r.manufacturer, r.source_url, r.image_source_url, r.catalog_page) for r in got] == [("one", "One & only", "Maker", "https://site/wines/one", "https://api.host/i.webp?a=1&b=2", 3)]


def page_of(cells):
    return f'<html><script type="application/json" id="__NUXT_DATA__">{html.escape(json.dumps(cells), quote=False)}</script></html>'


def test_payload_pointers():
    cells = [{"list": 1, "wrapped": 4, "yes": True, "none": -1, "far": 99}, [2, 3, 2], "a & b", 12.5, ["ShallowRef", 5], {"deep": 6}, ["Reactive", 2], "unused"]
    assert json.loads(decode_payload(page_of(cells))) == {"list": ["a & b", 12.5, "a & b"], "wrapped": {"deep": "a & b"}, "yes": True, "none": None, "far": None}
    assert json.loads(decode_payload(page_of([{"self": 0, "next": 1}, {"back": 0, "own": 2}, "x"]))) == {"self": None, "next": {"back": None, "own": "x"}}
    assert json.loads(decode_payload(page_of([7]))) == 7 and decode_payload(page_of([])) is None and decode_payload("<html>") is None and decode_payload(None) is None


def test_a_deep_payload():
    found, depth = json.loads(decode_payload(page_of([*([k + 1] for k in range(900)), "end"]))), 0
    while isinstance(found, list):
        (found,), depth = found, depth + 1
    assert (found, depth) == ("end", 900)


def test_first_slug(spark):
    df = spark.createDataFrame([('{"slug":"a"}',), ('[{"slug":"b"}]',), ('{"slug":""}',), ("broken",)], "j string")
    assert [r.s for r in df.select(first_slug(F.col("j")).alias("s")).collect()] == ["a", "b", None, None]


def test_field_scores_broadcast_no_tokens(spark, tmp_path):
    """A file of a few megabytes may hold millions of rows; several rows of a pair or an item count together."""
    asked = spark.createDataFrame([(q, q % 3, t) for q in range(9) for t in (["red harbour", "wine 7x"] if q == 4 else ["red harbor"])] + [(9, 1, None), (10, 2, "")], "query_id int, item_id int, text string")
    targets = spark.createDataFrame([(0, "red harbour"), (1, "red harbour"), (1, "red 7x"), (2, "blue"), (3, "red")], "item_id int, text string")
    for name, df in (("asked", asked), ("targets", targets)):
        df.write.parquet(f"{tmp_path}/{name}")
    found = evidence.field_scores(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("asked", "targets")), threshold=0.72)
    assert "BroadcastHashJoin [item_id" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.item_id): r.score for r in found.collect()}
    # item 1 has red (3) at place 0 once, harbour (7) and 7x (2) at place 1
    assert got == pytest.approx({(q, q % 3): {0: 1.0, 1: 1.0 if q == 4 else 10 / 12, 2: 0.0}[q % 3] for q in range(9)})


def test_edit_similarities_meet_each_pair_of_texts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evidence, "KEYS", 2)
    names = ["red rod", "red rod", "red rod", "blue rod", "", None, "red rod", "old gear"]
    rows = [(k, names[k % 8], f"b{k % 3}" if k % 11 else None, k % 2) for k in range(60)] + [(7, "red rod", "b1", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.edit_similarity(spark, str(tmp_path))
    assert "levenshtein" not in found._jdf.queryExecution().executedPlan().toString()  # not once for each pair of keys
    far = lambda a, b: F.levenshtein(F.lit(a), F.lit(b))
    known = [x for x in names if x is not None]
    edits = spark.range(1).select(*(far(a, b) for a in known for b in known)).first()
    edit = {(a, b): 1.0 if a == b else round(1 - d / max(len(a), len(b)), 9) for (a, b), d in zip(((a, b) for a in known for b in known), edits, strict=True)}
    want = [(a[0], b[0], edit.get((a[1], b[1]))) for a in rows for b in rows if a[2] is not None and a[2:] == b[2:] and a[0] < b[0]]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def copied_parts(spark, tmp_path):
    """600 parts of 12 names, 3 makers and 2 types that go with the names."""
    rows = [(k, f"{'red old blue'.split()[k * 7 % 3]} {'rod gear ring plate'.split()[k * 5 % 4]}", f"Brand#{k * 11 % 3 + 10}", f"{'PROMO SMALL'.split()[k % 2]}", k % 5, 1.0) for k in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_equal_texts_are_scored_once(spark, tmp_path):
    parts = queries.catalog(spark, copied_parts(spark, tmp_path))
    lines, known = (parts.select(F.col("slug").alias(c), F.concat_ws(" ", "title", "category").alias("text"), F.lit(0.9).alias("score")) for c in ("query_id", "item_id"))
    lines = lines.where("query_id % 100 = 0").unionByName(spark.createDataFrame([(0, "rod rod rod rod rod rod rod gear", 0.5), (7, None, 1.0), (8, "", 1.0), (9, "zzz", None)], "query_id long, text string, score double"))
    found = evidence.class_scores(lines, known.drop("score"), digits=9)
    sizes = found.scores.count(), found.asked.select("asked_class").distinct().count(), found.known.select("known_class").distinct().count()
    assert sizes[2] == 12 and sizes[0] <= sizes[1] * sizes[2] and found.pairs().count() > 20 * sizes[0]
    every = evidence.text_scores(lines, known.drop("score")).withColumn("score", F.round("score", 9))
    for k in (1, 5, 30, 1000):
        assert sorted(map(tuple, found.best(k).collect())) == sorted(map(tuple, ranking.top_k(every, k).select("query_id", "item_id", "score", "rank").collect()))
    some = every.where("item_id % 7 = 3")
    assert sorted(map(tuple, found.among(some.select("query_id", "item_id")).collect())) == sorted(map(tuple, some.collect()))


@pytest.mark.parametrize("query", [queries.text_scores, more_queries.fast_text_scores])
def test_text_queries_expand_no_pairs(spark, tmp_path, query):
    """The best items come from classes: nothing in the plan joins a query's words with all items."""
    found = query(spark, copied_parts(spark, tmp_path))
    assert "token" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 30 and found.where("rank = 1").count() == 6
