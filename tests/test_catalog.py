import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corvid.operators import audit, eventlog, promotion, retrieval
from corvid.operators.graph import connected_components
from corvid.sources import files
from corvid.streaming import decisions


def test_load_catalog_and_audit(spark, tmp_path, rows):
    wine = lambda s, a: {"slug": s, "title": s, "manufacturer": "Winery", "region": "R", "category": "C", "description": "d", "image_local": f"images\\{s}.webp", "source_url": "u", "alcohol": a}
    (tmp_path / "c.json").write_text(json.dumps({"captured_at": "now", "total_items_reported": 2, "wines": [wine("first", 12.0), wine("second", 108)]}))
    meta, wines = files.load_catalog(spark, str(tmp_path / "c.json"))
    assert meta["captured_at"] == "now" and wines.count() == 2
    assert [(r["code"], r["slug"]) for r in rows(audit.issues(wines))] == [("suspicious_alcohol", "second")]
    assert sorted(r["image_name"] for r in rows(audit.manifest(wines))) == ["first.webp", "second.webp"]
    images = spark.createDataFrame([("first", "h", "a", None), ("second", "h", "b", None), ("third", "x", "a", "r")], "slug string, sha string, title string, region string")
    assert [(r["count"], r["differing_fields"]) for r in rows(audit.exact_groups(images, "sha", ["title", "region"]))] == [(2, ["title"])]


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a":1}\n\n{"a":2}\n')
    bad.write_text('{"a":1}\nnot json\n')
    assert files.read_jsonl(spark, str(good), "a long").count() == 2
    assert files.read_jsonl(spark, str(bad), "a long", strict=False).count() == 1
    assert [r.line for r in files.bad_lines(spark, str(bad)).collect()] == ["not json"]
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_jsonl(spark, str(bad), "a long").collect()


def test_evaluator_manifest(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("query_id\timage_path\na-1\tx.jpg\nb\ty.jpg\n")
    assert files.evaluator_manifest(spark, str(p)).count() == 2
    p.write_text("query_id\timage_path\na\tx.jpg\na\ty.jpg\n")
    with pytest.raises(ValueError):
        files.evaluator_manifest(spark, str(p))
    answers = spark.createDataFrame([("a", 200, '{"slug":"s"}', "0.25"), ("b", 500, '{"slug":"s"}', "x")], "query_id string, status int, body string, seconds string")
    assert [tuple(r) for r in files.evaluator_results(answers).orderBy("query_id").collect()] == [("a", "s", 250), ("b", None, 0)]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", [1, 2])], "slug string, k array<int>")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "k array<int>, slug string").first().k == [1, 2]
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().k == "1|2"


def at(n):
    return dt.datetime(2024, 1, 1, 0, 0, n)


def test_log_flow(spark, rows):
    log = spark.createDataFrame([("r1", at(1), "same.jpg", "match", 10.0), ("r2", at(2), "same.jpg", "match", 20.0), ("r3", at(3), "o.jpg", "not_found", 30.0)], "id string, created_at timestamp, original_name string, decision string, total_ms double")
    fb = spark.createDataFrame([("r1", "correct", at(4)), ("r2", "incorrect", at(5)), ("r2", "not_in_store", at(6))], "recognition_id string, verdict string, created_at timestamp")
    joined = eventlog.with_feedback(log, fb)
    stats = eventlog.statistics(joined).first()
    assert (stats.total, stats.not_in_store, stats.incorrect, stats.reviewed) == (3, 1, 0, 2)
    names = spark.createDataFrame([("same.jpg", 0), ("o.jpg", 1)], "original_name string, position int")
    assert [r["id"] for r in rows(eventlog.latest_reviews(joined, names))] == ["r2"]
    page = eventlog.listing(joined, 2, 2).collect()
    assert [(r.id, r.total) for r in page] == [("r1", 3)]
    left, f = eventlog.deleted(log, fb, log.where("id = 'r2'").select("id"))
    assert left.count() == 2 and f.count() == 1


def test_feedback_rules(spark):
    df = spark.createDataFrame([("incorrect", "s"), ("incorrect", None), ("correct", "s"), ("correct", None), ("other", None)], "v string, s string")
    assert [r.ok for r in df.select(eventlog.valid_feedback(F.col("v"), F.col("s")).alias("ok")).collect()] == [True, False, False, True, False]
    paths = spark.createDataFrame([("a/b.jpg",), ("../x",), ("/etc",), ("a/../b",), ("a..b",)], "p string")
    assert [r.ok for r in paths.select(eventlog.safe_path(F.col("p")).alias("ok")).collect()] == [True, False, False, False, True]


def test_merged_lines(spark, rows):
    schema = "q int, position int, text string, normalized string, score double"
    a = spark.createDataFrame([(0, 0, "Red", "red", 0.5)], schema)
    b = spark.createDataFrame([(0, 0, "RED", "red", 0.0), (0, 1, "White", "white", 0.4)], schema)
    got = rows(retrieval.merged_lines(a, b, "q"), "normalized")
    assert [(r["text"], r["score"], r["source"]) for r in got] == [("Red", 1.0, "RapidOCR+GLM-OCR"), ("White", 0.4, "GLM-OCR")]


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in rows(connected_components(spark.createDataFrame([*chain, (None, 3)], "src long, dst long")))}
    assert {got[i] for i in range(1, 41)} == {1} and got[100] == got[101] == 100 and len(got) == 42
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_search_and_promotion(spark):
    c = spark.createDataFrame([("a", "Red One", "M", 0), ("b", "White", "M", 1)], "slug string, title string, manufacturer string, catalog_index int")
    assert [r.slug for r in promotion.search(c, " red ").collect()] == ["a"] and promotion.search(c, "").count() == 2
    live = spark.createDataFrame([("a", "Maker X"), ("n", "maker x"), ("z", "Other")], "slug string, manufacturer string")
    assert [r.slug for r in promotion.promoted(live, c, "MAKER").collect()] == ["n"]


def test_stream_counts(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, at(i % 60), 1, "view", 1.0, "{}") for i in range(10)]
    spark.createDataFrame([*rows, rows[0]], decisions.EVENTS).coalesce(1).write.parquet(str(source))
    stream = decisions.read_events(spark, str(source), "*.parquet")
    query = decisions.decision_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert [(r.event_type, r.n) for r in spark.sql("select * from counts").collect()] == [("view", 10)]
    finally:
        query.stop()
