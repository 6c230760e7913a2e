"""Log checks, payload expansion, order statistics, reports and reader ensembles on small data."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.functions import parse, similarity
from corvid.operators import audit, confidence, eventlog, evidence, ranking, retrieval
from corvid.sources import files


def at(n):
    return dt.datetime(2025, 3, 1, 0, 0, n)


RECOGNITIONS = "id string, created_at timestamp, decision string"


def test_checked_appends(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.createDataFrame([("a", at(1), "match"), ("b", at(2), "not_found")], RECOGNITIONS)
    eventlog.append_checked(rows, path, eventlog.RECOGNITION_CHECKS, "id")
    eventlog.append_checked(spark.createDataFrame([("c", at(3), "match")], RECOGNITIONS), path, eventlog.RECOGNITION_CHECKS, "id")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="already stored"):
        eventlog.append_checked(rows, path, eventlog.RECOGNITION_CHECKS, "id")
    with pytest.raises(ValueError, match="repeats"):
        eventlog.append_checked(spark.createDataFrame([("d", at(1), "match"), ("d", at(2), "match")], RECOGNITIONS), path, eventlog.RECOGNITION_CHECKS, "id")
    odd = spark.createDataFrame([("e", at(4), "perhaps")], RECOGNITIONS)
    with pytest.raises(Exception, match="unknown decision"):
        eventlog.append_checked(odd, path, eventlog.RECOGNITION_CHECKS, "id")
    wider = eventlog.widened(eventlog.RECOGNITION_CHECKS, "unknown decision", "decision", (*eventlog.DECISIONS, "perhaps"))
    eventlog.append_checked(odd, path, wider, "id")
    assert spark.read.parquet(path).count() == 4


def test_feedback_checks(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "recognition_id string, verdict string, correct_slug string")
    assert eventlog.checked(rows(("r", "incorrect", "s"), ("q", "correct", None)), eventlog.FEEDBACK_CHECKS).count() == 2
    for bad in [("r", "incorrect", None), ("r", "correct", "s"), ("r", "other", None), (None, "correct", None)]:
        with pytest.raises(Exception, match="slug|verdict|missing"):
            eventlog.checked(rows(bad), eventlog.FEEDBACK_CHECKS).collect()


def test_expanded_rows(spark):
    df = spark.createDataFrame([("a", '{"decision":"match","predictions":[{"slug":"x","score":0.5}]}', '{"read":3.5}', "correct", at(1)), ("b", "broken", None, None, None)], "id string, result_json string, pipeline_json string, feedback_verdict string, feedback_created_at timestamp")
    a, b = eventlog.expanded(df).orderBy("id").collect()
    assert a.result.predictions[0].slug == "x" and a.pipeline == {"read": 3.5} and a.feedback.verdict == "correct" and b.feedback is None and (b.result is None or b.result.decision is None)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_statistics_and_tiles(spark, seed):
    rng = np.random.default_rng(seed)
    data = [(f"g{int(rng.integers(0, 3))}", int(rng.integers(0, 20)), i) for i in range(150)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(5)
    groups = {g: sorted(v for h, v, _ in data if h == g) for g in {g for g, _, _ in data}}
    got = {r.g: r.v for r in ranking.order_statistic(df, "g", "v", 1 + F.ceil((F.col("n") - 1) * 0.3)).collect()}
    assert got == {g: v[math.ceil((len(v) - 1) * 0.3)] for g, v in groups.items()}
    log = df.select("g", F.col("v").cast("double").alias("total_ms"))
    assert {r.g: (r.p50, r.p95) for r in eventlog.latency_percentiles(log, "g").collect()} == {g: tuple(v[round((len(v) - 1) * f)] for f in (0.5, 0.95)) for g, v in groups.items()}
    tiled = ranking.tiles(df, "g", ["v", "i"], 4).collect()
    for g in groups:
        own = sorted((r.v, r.i, r.tile) for r in tiled if r.g == g)
        assert [t for *_, t in own] == [k + 1 for k, part in enumerate(np.array_split(np.arange(len(own)), 4)) for _ in part]


def test_audit_report(spark):
    wines = spark.createDataFrame([("a", "One", "M", "N", "red", "d", "img\\a.webp", "u", 12.0), ("b", "Two", "M", "N", "red", "d", "img\\b.webp", "u", 99.0), ("b", "Three", "", "S", "white", "d", "img\\c.webp", "u", 13.0)], "slug string, title string, manufacturer string, region string, category string, description string, image_local string, source_url string, alcohol double")
    found = spark.createDataFrame([("img/a.webp", "h"), ("img/b.webp", "h"), ("img/z.webp", "k")], "path string, sha string")
    got = {(r.section, r.name): r.value for r in audit.report(wines, found).collect()}
    assert got["total", "rows"] == 3 and got["missing", "manufacturer"] == 1 and got["issue", "duplicate_slug"] == 1 and got["issue", "suspicious_alcohol"] == 1 and got["issue", "missing_field"] == 1
    assert got["exact copies", "groups"] == 1 and got["exact copies", "rows"] == 2 and got["orphans", "files"] == 1 and got["orphans", "rows without a file"] == 1 and got["region", "N"] == 2


def test_line_scores_and_ensembles(spark):
    lines = spark.createDataFrame([(0, 1, "silver lantern"), (0, 1, "1999")], "query_id int, item_id int, text string")
    got = evidence.line_score(lines, spark.createDataFrame([(1, "silver lantern 1999")], "item_id int, text string")).first().score
    assert math.isclose(got, 0.75 + 0.25)  # a line whose tokens are all in the target
    a, b = (spark.createDataFrame(x, "image int, text string, score double") for x in ([(1, "Grey harbour", 0.5)], [(1, "grey harbouq", 0.9), (1, "1987", None)]))
    kept = {r.text: (r.score, r.reader) for r in evidence.ensemble({"first": (a, 1.0), "second": (b, 0.5)}, "image").collect()}
    assert kept == {"Grey harbour": (0.5, "first"), "1987": (0.5, "second")}
    times = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0)], "image int, ms double")
    assert {r.image: (r.total_ms, r.parallel_ms) for r in evidence.ensemble_times(times, "image").collect()} == {1: (12.0, 7.0), 2: (1.0, 1.0)}
    score = lambda **k: evidence.text_scores(spark.createDataFrame([(0, "harbour", None)], "query_id int, text string, score double"), spark.createDataFrame([(1, "harbour")], "item_id int, text string"), **k).collect()
    assert not score() and score(unscored=1.0)[0].score > 0.5


def test_flat_transformations(spark):
    schema = "id int, transformations struct<scale: double, rotation: double, blur: double, box: struct<x0: double, y0: double, x1: double, y1: double>>"
    rows = parse.flat_transformations(spark.createDataFrame([(1, (0.5, -12.0, 2.0, (0.25, 0.0, 0.75, 1.0))), (2, None)], schema)).orderBy("id").collect()
    assert (rows[0].abs_rotation, rows[0].effective_width, rows[0].effective_height) == (12.0, 128.0, 256.0) and (rows[1].scale, rows[1].blur, rows[1].effective_width) == (1.0, 0.0, 512.0)


def test_bad_lines_have_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\nno\n{"a":2}\n[1]\n')
    assert [(r[files.LINE], r.line) for r in files.bad_lines(spark, str(tmp_path / "x.jsonl")).collect()] == [(3, "no"), (5, "[1]")]


def test_sql_functions(spark):
    similarity.register(spark)
    assert spark.sql("select fuzzy_key('Тихая РЕКА №5') k, normalize_text('A  b') n").first().k == "tihaya reka no5"


def test_build_examples(spark):
    ranked = spark.createDataFrame([(1, f"s{k}", 1.0 - k / 10) for k in range(7)] + [(2, "s3", 0.4), (2, "s1", 0.4)], "query_id int, item_id string, score double")
    expected = spark.createDataFrame([(1, "s4", "pic"), (2, "s1", ""), (3, None, None)], "query_id int, expected string, source string")
    got = {r.query_id: r for r in confidence.build_examples(ranked, expected).collect()}
    assert (got[1].winner, got[1].safe, got[1].top5, got[1].known) == ("s0", False, True, True) and math.isclose(got[1].margin, 0.1)
    assert (got[2].winner, got[2].safe, got[2].margin) == ("s1", True, 0.0) and (got[3].winner, got[3].known, got[3].safe) == (None, False, False)
    assert got[1].split in ("calibration", "validation") and retrieval.field_grid(spark).count() == 231


def test_field_evidence(spark):
    asked = spark.createDataFrame([(1, 1, "Silver lantern 1999 oldmill"), (1, 2, "Silver lantern 1999 oldmill"), (2, 1, "..."), (2, 9, "unknown item"), (3, 2, None)], "query_id int, item_id int, text string")
    items = spark.createDataFrame([(1, "Silver Lantern", "Old Mill", "merlot", "lantern 1999"), (2, "Copper", None, "", None)], "item_id int, title string, manufacturer string, grapes string, year_text string")
    got = {(r.query_id, r.item_id): r for r in evidence.field_evidence(asked, items).collect()}
    assert len(got) == 5 and got[1, 1].title == 1.0 and got[1, 1].year == 1.0 and 0 < got[1, 1].manufacturer < 1
    assert got[1, 2].manufacturer == got[1, 2].grapes == got[1, 2].year == 0.0 and [got[2, 1][f] for f in (*evidence.FIELDS, "year")] == [0.0] * 4 == [got[k][f] for k in ((2, 9),) for f in (*evidence.FIELDS, "year")]
    both = (0.45 * 1.0 + 0.30 * got[1, 1].manufacturer + 0.20 * got[1, 1].grapes + 0.05, 0.45 + 0.30 * got[1, 1].manufacturer + 0.20 * got[1, 1].grapes)
    r = spark.createDataFrame([got[1, 1]]).select(evidence.structured_score(*(F.col(f) for f in (*evidence.FIELDS, "year"))).alias("a"), evidence.structured_score(*(F.col(f) for f in evidence.FIELDS)).alias("b")).first()
    assert abs(r.a - both[0]) < 1e-12 and abs(r.b - both[1]) < 1e-12
