"""Further operators of the inventory on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvid.functions import scoring, text
from corvid.functions.parse import first_slug, named
from corvid.functions.similarity import indel_ratio, partial_best_ratio, token_set_ratio
from corvid.operators import audit, confidence, eventlog, evidence, promotion, ranking, recognition, retrieval
from corvid.operators.similar_strings import similar_strings
from corvid.plans.queries import EX, HALVES, LOG, SIGNALS, TOKENS, asked, catalog, examples, feedback, index, log, signals, t
from corvid.plans.registry import query
from corvid.plans.scratch import materialise
from corvid.sources.files import evaluator_results, last_by_key, resolved_path


@query("s4_last_by_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_rows(spark, d):
    return last_by_key(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("s9_resolved_paths", "SELECT page_id, CASE WHEN starts_with(url, '/') THEN url ELSE '/base/' || url END AS path FROM pages")
def paths(spark, d):
    return t(spark, d, "pages").select("page_id", resolved_path(F.col("url"), "/base/").alias("path"))


@query("s15_first_rows", "SELECT p_partkey AS slug FROM part ORDER BY p_partkey LIMIT 25")
def first_rows(spark, d):
    return catalog(spark, d).orderBy("catalog_index").limit(25).select("slug")


@query("k10_evaluator_results", "SELECT CAST(event_id AS VARCHAR) AS query_id, CASE WHEN event_id % 5 < 3 AND event_type <> 'error' THEN event_type END AS predicted_slug, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(event_id % 1000 AS BIGINT) END AS latency_ms FROM events")
def evaluator(spark, d):
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("slug")))).otherwise(F.concat(F.lit("["), F.to_json(F.struct(F.col("event_type").alias("slug"))), F.lit("]")))
    body = F.when(F.col("event_type") == "error", F.lit('{"slug":""}')).otherwise(body)
    seconds = F.when(F.col("event_id") % 7 == 0, "none").otherwise(((F.col("event_id") % 1000) / 1000).cast("string"))
    status = F.when(F.col("event_id") % 5 < 2, 200).when(F.col("event_id") % 5 == 2, 201).otherwise(500)
    rows = t(spark, d, "events").select(F.col("event_id").cast("string").alias("query_id"), status.alias("status"), body.alias("body"), seconds.alias("seconds"))
    return evaluator_results(rows)


@query("p5_public_items", "SELECT p_partkey AS slug, p_name AS title, p_brand AS manufacturer, p_type AS category, p_size AS alcohol, 'https://images/' || p_partkey AS image_url FROM part")
def public_items(spark, d):
    return promotion.public_item(catalog(spark, d), "https://images/")


@query("p6_filled_fields", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, CASE WHEN p_size > 10 THEN p_brand ELSE '' END, '') AS name FROM part".replace("CASE WHEN p_size > 10 THEN p_brand ELSE '' END", "nullif(CASE WHEN p_size > 10 THEN p_brand ELSE '' END, '')"))
def filled(spark, d):
    return t(spark, d, "part").select("p_partkey", promotion.filled(F.when(F.col("p_size") > 25, F.col("p_name")), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("")).alias("name"))


@query("p14_valid_sessions", "SELECT count(*) FILTER (WHERE regexp_full_match(p_name, '[A-Za-z0-9._:-]{8,128}')) AS valid, count(*) AS n FROM part")
def sessions(spark, d):
    return t(spark, d, "part").agg(F.count_if(eventlog.valid_session(F.col("p_name"))).alias("valid"), F.count("*").alias("n"))


@query("p16_upload_errors", "SELECT p_partkey, CASE WHEN s = 0 THEN 'empty' WHEN s > 15728640 THEN 'too_large' WHEN k NOT IN ('JPEG', 'PNG', 'WEBP') THEN 'unsupported' WHEN least(w, h) < 64 THEN 'too_small' WHEN w * h > 40000000 THEN 'too_many_pixels' END AS error FROM (SELECT p_partkey, p_size * 400000 - 400000 AS s, CASE WHEN p_partkey % 3 = 0 THEN 'GIF' ELSE 'PNG' END AS k, p_size * 10 AS w, p_size * 100000 AS h FROM part)")
def uploads(spark, d):
    p = t(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "GIF").otherwise("PNG")
    return p.select("p_partkey", eventlog.upload_error(F.col("p_size") * 400000 - 400000, kind, F.col("p_size") * 10, F.col("p_size") * 100000).alias("error"))


@query("p18_safe_paths", "SELECT page_id, NOT regexp_matches(url, '(^/|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|$))') AS safe FROM pages")
def safe_paths(spark, d):
    return t(spark, d, "pages").select("page_id", eventlog.safe_path(F.col("url")).alias("safe"))


@query("p20_recheck_reasons", f"WITH {LOG} SELECT CASE WHEN verdict = 'correct' AND id % 2 = 0 THEN 'stable' ELSE 'needs_recheck' END AS reason, count(*) AS n FROM log JOIN fb ON id = recognition_id GROUP BY 1")
def recheck(spark, d):
    rows = eventlog.with_feedback(log(spark, d), feedback(spark, d), "inner")
    return rows.groupBy(eventlog.recheck_reason(F.col("feedback.verdict"), F.lit(0), F.col("id") % 2).alias("reason")).agg(F.count("*").alias("n"))


@query("p21_expected_slugs", f"WITH {LOG} SELECT id, CASE WHEN verdict = 'correct' THEN decision WHEN verdict = 'incorrect' THEN 'fixed' WHEN verdict IS NULL THEN 'old' END AS expected, CASE verdict WHEN 'correct' THEN 'top1_correct' WHEN 'incorrect' THEN 'top5_correct' END AS review FROM log LEFT JOIN fb ON id = recognition_id")
def expected(spark, d):
    rows = eventlog.with_feedback(log(spark, d), feedback(spark, d))
    v = F.col("feedback.verdict")
    return rows.select("id", eventlog.expected_slug(v, F.lit("fixed"), F.col("decision"), F.lit("old")).alias("expected"), eventlog.review_group(v).alias("review"))


@query("z6_annotations", f"WITH {LOG} SELECT id, CASE verdict WHEN 'correct' THEN decision WHEN 'incorrect' THEN 'fixed' END AS expected_slug, 'exact' AS label_status, round_even(total_ms / 7, 6) AS confidence FROM log JOIN fb ON id = recognition_id")
def annotations(spark, d):
    rows = eventlog.with_feedback(log(spark, d), feedback(spark, d), "inner")
    return rows.select("id", eventlog.annotation(F.col("feedback.verdict"), F.lit("fixed"), F.col("decision"), F.col("total_ms") / 7).alias("a")).select("id", "a.*")


@query("d4_upsert", f"WITH {LOG} SELECT k AS recognition_id, max_by(verdict, (f_at, recognition_id)) AS verdict, max(f_at) AS created_at FROM (SELECT recognition_id % 100 AS k, * FROM fb) GROUP BY k")
def upsert(spark, d):
    rows = feedback(spark, d).withColumn("own", F.col("recognition_id")).withColumn("recognition_id", F.col("recognition_id") % 100)
    return eventlog.latest_feedback(rows).select("recognition_id", "verdict", "created_at")


@query("d7_children", "SELECT p_partkey AS slug, unnest(string_split(p_name, ' ')) AS name FROM part")
def children(spark, d):
    return promotion.children(catalog(spark, d).withColumn("words", F.split("title", " ")), "words")


@query("j6_full_set_equality", "SELECT count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unmatched FROM (SELECT DISTINCT l_orderkey AS a FROM lineitem) FULL JOIN (SELECT o_orderkey AS b FROM orders) ON a = b")
def set_equality(spark, d):
    return audit.difference_both_ways(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k").agg(F.count("*").alias("unmatched"))


@query("a6_issue_counts", "SELECT 'suspicious_alcohol' AS code, 'warning' AS severity, count(*) AS n FROM part WHERE NOT (p_size BETWEEN 5 AND 25)")
def issue_counts(spark, d):
    rows = audit.suspicious_range(catalog(spark, d), "slug", "alcohol")
    return rows.groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("a7_totals", "SELECT count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars, count(DISTINCT length(html)) AS sizes, count(*) FILTER (WHERE html IS NULL) AS missing FROM pages")
def totals(spark, d):
    return t(spark, d, "pages").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"), F.count_distinct(F.length("html")).alias("sizes"), F.count_if(F.col("html").isNull()).alias("missing"))


@query("a15_sample_breakdown", "SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n, round(avg((r = 1)::INT), 9) AS top1, round(avg((r <= 5)::INT), 9) AS top5, round(avg(1.0 / r), 9) AS mrr FROM (SELECT CASE WHEN p_size < 20 THEN p_size END AS p_size, 1 + p_partkey % 9 AS r FROM part) WHERE p_size IS NOT NULL GROUP BY 1")
def sample_breakdown(spark, d):
    rows = t(spark, d, "part").select(F.when(F.col("p_size") < 20, F.col("p_size")).alias("size"), (1 + F.col("p_partkey") % 9).alias("rank"))
    return ranking.breakdown(rows, "size", None)


@query("a30_transform_effects", "SELECT effect, count(*) AS n, round(avg(l_discount), 9) AS rate FROM (SELECT l_discount, unnest(list_filter([CASE WHEN l_quantity > 25 THEN 'large' END, CASE WHEN l_tax > 0.04 THEN 'taxed' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS effect FROM lineitem) GROUP BY effect")
def transform_effects(spark, d):
    flags = retrieval.provenance({"large": F.col("l_quantity") > 25, "taxed": F.col("l_tax") > 0.04, "returned": F.col("l_returnflag") == "R"})
    return t(spark, d, "lineitem").select("l_discount", F.explode(flags).alias("effect")).groupBy("effect").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("rate"))


@query("a34_hit_counts", "SELECT p_brand AS value, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY 1 ORDER BY n DESC, first_seen")
def hit_counts(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("a28_benchmark_summary", "WITH m AS (SELECT p_brand AS config, avg(p_size / 50.0) AS title, avg(p_size / 100.0) AS manufacturer, avg(p_size / 60.0) AS grape, avg(p_size / 70.0) AS recall, avg(p_retailprice) AS char_count FROM part GROUP BY 1), q AS (SELECT *, 0.35 * title + 0.30 * manufacturer + 0.20 * grape + 0.15 * recall AS quality FROM m) SELECT config, round(quality, 6) AS quality, round(quality - (SELECT quality FROM q WHERE config = (SELECT min(p_brand) FROM part)), 6) AS gain FROM q")
def benchmark_summary(spark, d):
    p = t(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("config"), *((F.col("p_size") / n).alias(c) for c, n in (("title", 50.0), ("manufacturer", 100.0), ("grape", 60.0), ("recall", 70.0))), F.col("p_retailprice").alias("char_count"))
    base = p.agg(F.min("p_brand")).first()[0]
    return evidence.benchmark_summary(rows, base).select("config", F.round("quality", 6).alias("quality"), F.round("gain", 6).alias("gain"))


@query("w7_expected_rank", f"WITH {SIGNALS} SELECT query_id, min(rank) FILTER (WHERE item_label = expected) AS rank, round(max(embedding) FILTER (WHERE rank = 1) - max(embedding) FILTER (WHERE rank = 2), 6) AS margin FROM top GROUP BY query_id")
def expected_rank(spark, d):
    rows = signals(spark, d)
    lists = ranking.prediction_records(rows.select("query_id", "item_id", F.col("embedding").alias("score")), 30)
    hits = rows.where("item_label = expected").groupBy("query_id").agg(F.min_by("item_id", "rank").alias("expected"))
    out = lists.join(hits, "query_id", "left")
    return out.select("query_id", ranking.rank_of_expected(F.col("predictions.slug"), F.col("expected")).cast("long").alias("rank"), F.round(ranking.top1_margin(F.col("predictions")), 6).alias("margin"))


@query("og2_restricted", "SELECT l_orderkey AS query_id, l_linenumber AS item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rank FROM (SELECT *, max((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey) AS hard FROM lineitem) WHERE hard = 0 OR l_returnflag = 'R') WHERE rank <= 3")
def restricted(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("item_id"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("allowed"))
    return retrieval.restricted(rows, 3).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("u2_extended_candidates", f"WITH {SIGNALS}, nw AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(ocr, 9) DESC, item_id) AS r FROM sig ANTI JOIN (SELECT * FROM top WHERE rank <= 20) x USING (query_id, item_id)) SELECT query_id, item_id, rank AS position FROM top WHERE rank <= 20 UNION ALL SELECT query_id, item_id, 20 + r FROM nw WHERE r <= 5")
def extended(spark, d):
    q, i = asked(spark, d), index(spark, d)
    second = lambda df: df.withColumn("embedding", F.slice("embedding", 33, 32))
    own = retrieval.search(q, i, 20, others_only=True, digits=9).select("query_id", "item_id", F.col("rank").alias("position"))
    extra = retrieval.search(second(q), second(i), 25, others_only=True, digits=9).drop("rank")  # 20 of them may be there already
    return retrieval.extended(own, extra, 5).withColumn("position", F.col("position").cast("long"))


@query("u4_merged_lines", "WITH a AS (SELECT l_orderkey AS q, l_linenumber AS p, l_shipdate::DATE::VARCHAR || l_returnflag AS tx, CAST(l_partkey % 20 AS VARCHAR) AS n, l_discount AS s, 0 AS r FROM lineitem), b AS (SELECT l_orderkey AS q, l_linenumber AS p, l_shipdate::DATE::VARCHAR || l_returnflag AS tx, CAST(l_suppkey % 20 AS VARCHAR) AS n, coalesce(nullif(l_tax, 0), 1) AS s, 1 AS r FROM lineitem) SELECT q, n AS normalized, min_by(tx, (r, p, tx)) AS text, max(s) AS score, CASE WHEN count(DISTINCT r) = 2 THEN 'RapidOCR+GLM-OCR' WHEN min(r) = 0 THEN 'RapidOCR' ELSE 'GLM-OCR' END AS source FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY q, n")
def merged_lines(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("position"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag").alias("text"), "l_partkey", "l_suppkey", "l_discount", "l_tax")
    side = lambda key, score: rows.select("q", "position", "text", (F.col(key) % 20).cast("string").alias("normalized"), F.col(score).alias("score"))
    return retrieval.merged_lines(side("l_partkey", "l_discount"), side("l_suppkey", "l_tax"), "q").drop("at")


@query("t4_fuzzy_keys", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^0-9a-z]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def fuzzy_keys(spark, d):
    return t(spark, d, "part").select("p_partkey", text.fuzzy_key(text.normalized(F.concat_ws(" ", "p_name", "p_type"))).alias("key"))


@query("t5_homoglyph_keys", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda t: CASE WHEN length(t) >= 6 THEN translate(t, 'chpxy', 'snrhu') ELSE t END), ' ') AS key FROM part")
def homoglyphs(spark, d):
    return t(spark, d, "part").select("p_partkey", text.homoglyph_key(F.lower("p_name")).alias("key"))


@query("t6_aliases")
def alias_rows(spark, d):
    return catalog(spark, d).select("slug", F.explode(text.aliases(text.normalized(F.col("manufacturer")))).alias("alias"))


@query("f2_prefix_similarity", "SELECT a, b, round(CASE WHEN length(a) < 6 OR NOT starts_with(b, a) OR length(a) / length(b) < 0.58 THEN 0.0 ELSE 0.94 + 0.06 * length(a) / length(b) END, 9) AS s FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[1] || substr(CAST(p_partkey AS VARCHAR), 1, 3) AS b FROM part) WHERE a <> b")
def prefix_similarity(spark, d):
    first = F.split("p_name", " ")[0]
    pairs = t(spark, d, "part").select(first.alias("a"), F.concat(first, F.substring(F.col("p_partkey").cast("string"), 1, 3)).alias("b")).distinct().where("a <> b")
    return pairs.select("a", "b", F.round(text.prefix_similarity(F.col("a"), F.col("b")), 9).alias("s"))


@query("f3_window_similarity")
def window_similarity(spark, d):
    names = catalog(spark, d).select(F.lower("title").alias("q")).distinct()
    word = F.split("q", " ")[0]
    return names.select("q", F.round(text.window_similarity(F.col("q"), word), 9).alias("own"), F.round(text.window_similarity(F.col("q"), F.concat(word, F.lit("s"))), 9).alias("near"))


#: twice the longest common subsequence over both lengths, by rows of the usual table
INDEL_SQL = """2.0 * list_reduce([[0 FOR i IN range(0, length({a}) + 1)]] || [[unicode(c)] FOR c IN string_split({b}, '')],
  lambda above, c: list_reduce([[0]] || [[i] FOR i IN range(1, length({a}) + 1)],
    lambda row, i: list_append(row, greatest(above[i[1] + 1], row[i[1]], above[i[1]] + CASE WHEN unicode({a}[i[1]]) = c[1] THEN 1 ELSE 0 END)))
  )[-1] / (length({a}) + length({b}))"""


@query("f5_indel_ratio", f"""
WITH n AS (SELECT DISTINCT lower(p_name) AS t FROM part),
p AS (SELECT x.t AS a, y.t AS b, {INDEL_SQL.format(a="x.t", b="y.t")} AS ratio FROM n x, n y)
SELECT a, b, round(ratio, 9) AS ratio FROM p WHERE ratio >= 0.55""")
def indel_ratios(spark, d):
    """All pairs of distinct lower-case titles of 0.55 or more, in both orders."""
    names = catalog(spark, d).select(F.lower("title").alias("a")).distinct()
    pairs = similar_strings(names, names.withColumnRenamed("a", "b"), "a", "b", 0.55, indel_ratio, 100.0)
    return pairs.select("a", "b", F.round("similarity", 9).alias("ratio"))


@query("f8_fast_text_scores", f"""
WITH q AS (
  SELECT p_partkey AS query_id, unnest({TOKENS.format(c="(p_name || ' ' || p_brand)")}) AS token, CASE WHEN p_partkey % 200 = 0 THEN 0.8 ELSE 1.0 END AS conf
  FROM part WHERE p_partkey % 100 = 0),
words AS (SELECT *, row_number() OVER () AS k FROM q),
known AS (SELECT DISTINCT p_partkey AS item_id, unnest({TOKENS.format(c="(p_name || ' ' || p_brand || ' ' || p_type)")}) AS c FROM part),
pairs AS (
  SELECT t, c, CASE WHEN regexp_full_match(t, '[0-9]+') OR regexp_full_match(c, '[0-9]+') THEN CASE WHEN t = c THEN 1.0 ELSE 0 END ELSE {INDEL_SQL.format(a="t", b="c")} END AS s
  FROM (SELECT DISTINCT token AS t FROM words) x, (SELECT DISTINCT c FROM known) y),
best AS (
  SELECT query_id, k, conf * least(length(token) / 7.0, 1.0) AS w, item_id, max(round(s * 100) / 100) AS s
  FROM words JOIN pairs ON t = token JOIN known USING (c) WHERE s >= 0.55 GROUP BY ALL),
six AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY round(s * w, 12) DESC, s DESC) AS r FROM best QUALIFY r <= 6),
scores AS (
  SELECT query_id, item_id, round(sum(s * w) / sum(w) * (0.55 + 0.45 * least(count(*) / 3.0, 1.0)), 9) AS score
  FROM six GROUP BY ALL HAVING sum(w) > 0)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scores QUALIFY rank <= 5""")
def fast_text_scores(spark, d):
    """The second kernel: makers and titles as read, half of the lines without a score."""
    lines = catalog(spark, d).where("slug % 100 = 0").select(F.col("slug").alias("query_id"), F.concat_ws(" ", "title", "manufacturer").alias("text"), F.when(F.col("slug") % 200 == 0, 0.8).alias("score"))
    known = catalog(spark, d).select(F.col("slug").alias("item_id"), F.concat_ws(" ", "title", "manufacturer", "category").alias("text"))
    return evidence.class_scores(lines, known, digits=9, **evidence.FAST).best(5)


RECOGNITION = f"""
WITH q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0),
i AS (SELECT vec_id AS item_id, label, embedding FROM embeddings),
words AS (
  SELECT query_id, unnest({TOKENS.format(c="(p_name || ' ' || p_brand)")}) AS token FROM q JOIN part ON p_partkey = query_id + 1),
numbered AS (SELECT *, row_number() OVER () AS k FROM words),
known AS (SELECT DISTINCT item_id, unnest({TOKENS.format(c="(p_name || ' ' || p_brand || ' ' || p_type)")}) AS c FROM i JOIN part ON p_partkey = item_id),
pairs AS (
  SELECT t, c, CASE WHEN regexp_full_match(t, '[0-9]+') OR regexp_full_match(c, '[0-9]+') THEN CASE WHEN t = c THEN 1.0 ELSE 0 END ELSE {INDEL_SQL.format(a="t", b="c")} END AS s
  FROM (SELECT DISTINCT token AS t FROM words) x, (SELECT DISTINCT c FROM known) y),
best AS (
  SELECT query_id, k, least(length(token) / 7.0, 1.0) AS w, item_id, max(round(s * 100) / 100) AS s
  FROM numbered JOIN pairs ON t = token JOIN known USING (c) WHERE s >= 0.55 GROUP BY ALL),
six AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY round(s * w, 12) DESC, s DESC) AS r FROM best QUALIFY r <= 6),
txt AS (
  SELECT query_id, item_id, round(sum(s * w) / sum(w) * (0.55 + 0.45 * least(count(*) / 3.0, 1.0)), 9) AS ocr FROM six GROUP BY ALL),
every AS (
  SELECT query_id, item_id, i.label AS maker, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS visual, coalesce(ocr, 0) AS ocr,
    q.label = i.label AND query_id % 200 = 0 AS may
  FROM q CROSS JOIN i LEFT JOIN txt USING (query_id, item_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY visual DESC, item_id) AS vr,
    row_number() OVER (PARTITION BY query_id ORDER BY ocr > 0 DESC, ocr DESC, item_id) AS tr FROM every),
texts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ocr DESC, item_id) AS r FROM placed WHERE ocr > 0 AND vr > 30 QUALIFY r <= 40),
bring AS (
  SELECT query_id, item_id, min((p, r)) AS pr FROM (
    SELECT query_id, item_id, CASE WHEN vr <= 30 THEN 0 ELSE 2 END AS p, vr AS r FROM placed WHERE vr <= 40
    UNION ALL SELECT query_id, item_id, 1, r FROM texts) GROUP BY ALL),
pool AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY pr, item_id) AS position FROM bring QUALIFY position <= 40),
al AS (
  SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.65 * visual + 0.35 * ocr, 9) DESC, item_id) AS r FROM every WHERE may QUALIFY r <= 40),
gated AS (
  SELECT query_id, item_id, p = 0 AS allowed, row_number() OVER (PARTITION BY query_id ORDER BY p, r, item_id) AS position FROM (
    SELECT query_id, item_id, 0 AS p, r FROM al
    UNION ALL SELECT query_id, item_id, 1, position FROM pool ANTI JOIN al USING (query_id, item_id)) QUALIFY position <= 40),
fused AS (
  SELECT query_id, item_id, allowed, ocr, (item_id % 7) / 10.0 AS sift, vr <= 30 AS v, ocr > 0 AND tr <= 10 AS t,
    (visual - min(visual) OVER w) / greatest(max(visual) OVER w - min(visual) OVER w, 1e-7) AS e, bool_or(allowed) OVER w AS hard
  FROM gated JOIN placed USING (query_id, item_id) WINDOW w AS (PARTITION BY query_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT *, round(0.45 * e + 0.05 * sift + 0.50 * ocr, 9) AS score FROM fused) WHERE allowed OR NOT hard QUALIFY rank <= 5),
sizes AS (SELECT label, count(*) AS n FROM i GROUP BY label),
tops AS (
  SELECT query_id, list(item_id ORDER BY rank) AS items, list(round(score, 6) ORDER BY rank) AS scores,
    list(concat_ws('+', CASE WHEN v THEN 'visual' END, CASE WHEN t THEN 'ocr' END, CASE WHEN allowed THEN 'manufacturer' END) ORDER BY rank) AS sources,
    max(score) AS first, coalesce(max(score) FILTER (rank = 2), 0) AS second
  FROM ranked GROUP BY query_id)"""


@query("oh1_recognition", f"""{RECOGNITION}
SELECT query_id, items, scores, sources, round(first - second, 6) AS margin, CASE WHEN query_id % 200 = 0 THEN label END AS maker,
  CASE WHEN query_id % 200 = 0 THEN n ELSE 0 END AS candidate_count,
  CASE WHEN first >= 0.8 THEN 'match' WHEN first >= 0.4 THEN 'alternatives' ELSE 'not_found' END AS decision
FROM tops JOIN q USING (query_id) JOIN sizes USING (label)""")
def recognised(spark, d):
    """The whole recognition: the line that a query reads is the next item's title and maker."""
    q, i = asked(spark, d), index(spark, d)
    parts = catalog(spark, d)
    lines = q.join(parts, F.col("slug") == F.col("query_id") + 1).select("query_id", F.concat_ws(" ", "title", "manufacturer").alias("text"), F.lit(1.0).alias("score"))
    known = i.join(parts, F.col("slug") == F.col("item_id")).select("item_id", F.concat_ws(" ", "title", "manufacturer", "category").alias("text"))
    read = evidence.class_scores(lines, known, digits=9, **evidence.FAST)
    makers = q.where("query_id % 200 = 0").select("query_id", F.col("label").alias("maker"))  # stands for the queries whose maker is recognised
    geometry = lambda pool: pool.withColumn("score", (F.col("item_id") % 7) / 10)
    found = recognition.recognise(q.select("query_id", "embedding"), i.withColumnRenamed("label", "maker"), read, makers, geometry)
    sources = F.transform("predictions", lambda p: F.array_join(p["sources"], "+"))
    return found.select("query_id", F.col("predictions.item_id").alias("items"), F.transform("predictions", lambda p: F.round(p["score"], 6)).alias("scores"), sources.alias("sources"), F.round("margin", 6).alias("margin"), "maker", "candidate_count", "decision")


@query("f6_token_ratios")
def token_ratios(spark, d):
    return catalog(spark, d).select("title", "category").distinct().select("title", "category", F.round(token_set_ratio("title", "category"), 6).alias("token_set"), F.round(partial_best_ratio("title", "category"), 6).alias("partial"))


@query("f12_token_recall")
def token_recall(spark, d):
    q = catalog(spark, d).select(F.col("slug").alias("query_id"), F.col("slug").alias("item_id"), F.col("title").alias("text"))
    return evidence.field_scores(q, catalog(spark, d).select(F.col("slug").alias("item_id"), F.concat_ws(" ", "title", "manufacturer", "category").alias("text")), threshold=0.72).withColumn("score", F.round("score", 9))


PATCHES = "list_transform(range(0, 4), lambda k: {v}[k * 16 + 1:k * 16 + 16]::DOUBLE[])"


@query("f15_patch_maxsim", f"WITH {SIGNALS}, p AS (SELECT t.query_id, t.item_id, {PATCHES.format(v='q.embedding')} AS qs, {PATCHES.format(v='i.embedding')} AS rs FROM top t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings i ON i.vec_id = t.item_id WHERE t.rank <= 10) SELECT query_id, item_id, round(list_avg(list_transform(qs, lambda a: list_max(list_transform(rs, lambda b: list_dot_product(a, b))))), 6) AS score FROM p")
def patch_maxsim(spark, d):
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(v, k * 16 + 1, 16))
    q = asked(spark, d).select("query_id", F.array(parts(F.col("embedding"))).alias("q"))
    best = retrieval.search(asked(spark, d), index(spark, d), 10, others_only=True, digits=9).select("query_id", "item_id")
    rows = best.join(q, "query_id").join(index(spark, d).select("item_id", parts(F.col("embedding")).alias("r")), "item_id")
    return rows.select("query_id", "item_id", F.round(retrieval.patch_maxsim(F.col("q"), F.col("r")), 6).alias("score"))


@query("ov1_patch_rerank", f"""
WITH {SIGNALS},
mixed AS (
  SELECT query_id, item_id, round(0.55 * embedding + 0.45 * greatest(sift, ocr), 9) AS cls, row_number() OVER (PARTITION BY query_id ORDER BY round(embedding, 9) DESC, item_id) AS rank
  FROM sig QUALIFY rank <= 10),
p AS (
  SELECT m.*, {PATCHES.format(v="q.embedding")} AS qs, {PATCHES.format(v="i.embedding")} AS rs
  FROM mixed m JOIN embeddings q ON q.vec_id = m.query_id JOIN embeddings i ON i.vec_id = m.item_id),
s AS (SELECT query_id, item_id, round(0.7 * cls + 0.3 * list_avg(list_transform(qs, lambda a: list_max(list_transform(rs, lambda b: list_dot_product(a, b))))), 9) AS score FROM p)
SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 5""")
def patch_rerank(spark, d):
    """Ten candidates by the whole vector, two views mixed, patches blended in, ranked again."""
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(v, k * 16 + 1, 16))
    found = retrieval.signals(asked(spark, d), index(spark, d), HALVES, 10).select("query_id", "item_id", F.round(retrieval.two_view(F.col("embedding"), F.greatest("sift", "ocr")), 9).alias("cls"))
    q = asked(spark, d).select("query_id", F.array(parts(F.col("embedding"))).alias("q"))
    rows = found.join(q, "query_id").join(index(spark, d).select("item_id", parts(F.col("embedding")).alias("r")), "item_id")
    scored = rows.withColumn("score", F.round(retrieval.blended(F.col("cls"), retrieval.patch_maxsim(F.col("q"), F.col("r")), 0.3), 9))
    return ranking.top_k(scored, 5).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("f11_structured_scores", f"""
WITH p AS (
  SELECT a.p_partkey AS query_id, b.p_partkey AS item_id, a.p_name || ' ' || a.p_brand || ' ' || (1980 + a.p_size % 40) AS text,
    b.p_name || ' ' || (1980 + b.p_size % 40) AS title, b.p_brand AS manufacturer, b.p_type AS grapes
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
q AS (SELECT query_id, item_id, unnest(list_distinct({TOKENS.format(c="text")})) AS x FROM p),
t AS (
  SELECT query_id, item_id, f, unnest(ys) AS y, unnest(range(len(ys))) AS k FROM (
    SELECT query_id, item_id, 'title' AS f, {TOKENS.format(c="title")} AS ys FROM p
    UNION ALL SELECT query_id, item_id, 'manufacturer', {TOKENS.format(c="manufacturer")} FROM p
    UNION ALL SELECT query_id, item_id, 'grapes', {TOKENS.format(c="grapes")} FROM p)),
sim AS (SELECT x, y, {INDEL_SQL.format(a="y", b="x")} AS s FROM (SELECT DISTINCT x, y FROM q JOIN t USING (query_id, item_id))),
best AS (SELECT query_id, item_id, f, k, y, max(s) AS s FROM q JOIN t USING (query_id, item_id) JOIN sim USING (x, y) GROUP BY ALL),
scores AS (SELECT query_id, item_id, f, sum(s * least(length(y), 10)) / sum(least(length(y), 10)) AS v FROM best GROUP BY ALL),
fields AS (
  SELECT p.query_id, p.item_id, coalesce(max(v) FILTER (f = 'title'), 0) AS title, coalesce(max(v) FILTER (f = 'manufacturer'), 0) AS manufacturer,
    coalesce(max(v) FILTER (f = 'grapes'), 0) AS grapes, CASE WHEN any_value(p.text)[-4:] = any_value(p.title)[-4:] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS year
  FROM p LEFT JOIN scores s ON s.query_id = p.query_id AND s.item_id = p.item_id GROUP BY ALL)
SELECT query_id, item_id, round(title, 9) AS title, round(manufacturer, 9) AS manufacturer, round(grapes, 9) AS grapes, year,
  round(0.45 * title + 0.30 * manufacturer + 0.20 * grapes + 0.05 * year, 9) AS score FROM fields""")
def structured_scores(spark, d):
    """Field evidence and its mix: each item's text held against the next one's fields."""
    c = catalog(spark, d).withColumn("year", (1980 + F.col("alcohol") % 40).cast("string"))
    pairs = c.select(F.col("slug").alias("query_id"), (F.col("slug") + 1).alias("item_id"), F.concat_ws(" ", "title", "manufacturer", "year").alias("text"))
    title = F.concat_ws(" ", "title", "year")
    items = c.select(F.col("slug").alias("item_id"), title.alias("title"), "manufacturer", F.col("category").alias("grapes"), title.alias("year_text"))
    found = evidence.field_evidence(pairs.join(items.select("item_id"), "item_id", "left_semi"), items, kernel=indel_ratio, scale=100.0)
    score = evidence.structured_score(*(F.col(f) for f in (*evidence.FIELDS, "year")))
    return found.withColumn("score", F.round(score, 9)).withColumns({f: F.round(f, 9) for f in evidence.FIELDS})


@query("f17_geometry_score", "SELECT p_partkey, round(CASE WHEN g < 4 THEN least(g / 10.0, 1) * 0.18 ELSE (0.55 * least(i / 14.0, 1) + 0.30 * least(i / greatest(g, 1) / 0.65, 1) + 0.15 * least(c / 0.22, 1)) * CASE WHEN i < 4 THEN 0.25 ELSE 1 END END, 9) AS s FROM (SELECT p_partkey, p_size AS g, p_partkey % (p_size + 1) AS i, p_retailprice / 4000 AS c FROM part)")
def geometry(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(scoring.geometry_score(F.col("p_size"), F.col("p_partkey") % (F.col("p_size") + 1), F.col("p_retailprice") / 4000), 9).alias("s"))


@query("h6_digests", "SELECT page_id, sha256(html) AS sha FROM pages")
def digests(spark, d):
    return t(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("m7_features", f"WITH {EX} SELECT sample_id, round(ln(1 + sample_id % 64) / ln(65.0), 6) AS inliers, round(1 - least(confidence / 0.15, 1), 6) AS consistency, round(least((sample_id % 9) / 6.0, 1), 6) AS lines FROM ex")
def features(spark, d):
    have = {"sift_inliers": F.col("sample_id") % 64, "ocr_lines": F.col("sample_id") % 9, "winner_score_std": F.col("confidence")}
    x = scoring.confidence_features(lambda n: have.get(n, F.col("confidence")))
    names = scoring.FEATURE_NAMES
    return examples(spark, d).select("sample_id", F.round(x[names.index("sift_inliers_log")], 6).alias("inliers"), F.round(x[names.index("winner_view_consistency")], 6).alias("consistency"), F.round(x[names.index("ocr_line_count")], 6).alias("lines"))


@query("m14_timings", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax + l_discount, 6) AS serial_ms, round(greatest(l_quantity, l_tax) + l_discount, 6) AS parallel_ms FROM lineitem")
def timings(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") + F.col("l_tax") + F.col("l_discount"), 6).alias("serial_ms"), F.round(F.greatest("l_quantity", "l_tax") + F.col("l_discount"), 6).alias("parallel_ms"))


@query("r7_anchored", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN regexp_matches(p_type, '^S') THEN 'small' END AS slug FROM part")
def anchored(spark, d):
    return t(spark, d, "part").select("p_partkey", confidence.anchored(F.concat_ws("|", "p_name", "p_type"), [(r"^(?=.*red)[^|]*red", "red"), (r"\|S", "small")]).alias("slug"))


@query("r8_first_slugs", "SELECT event_id, event_type AS slug FROM events")
def first_slugs(spark, d):
    return t(spark, d, "events").select("event_id", first_slug(F.to_json(F.array(F.struct(F.col("event_type").alias("slug"))))).alias("slug"))


@query("z4_named_values", "SELECT event_id, event_type AS name FROM events")
def named_values(spark, d):
    value = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("name")))).otherwise(F.col("event_type"))
    return t(spark, d, "events").select("event_id", named(value).alias("name"))


@query("or2_rerank_policies", "SELECT l_orderkey, policy, arg_max(l_linenumber, (round(s, 9), -l_linenumber)) AS winner FROM (SELECT l_orderkey, l_linenumber, unnest(['current', 'balanced', 'field_priority', 'field_only']) AS policy, unnest([l_tax, 0.55 * l_tax + 0.45 * l_discount, 0.35 * l_tax + 0.65 * l_discount, l_discount]) AS s FROM lineitem) GROUP BY ALL")
def policies(spark, d):
    mixes = {"current": F.col("l_tax"), "balanced": 0.55 * F.col("l_tax") + 0.45 * F.col("l_discount"), "field_priority": 0.35 * F.col("l_tax") + 0.65 * F.col("l_discount"), "field_only": F.col("l_discount")}
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.array(*(F.struct(F.lit(p).alias("policy"), F.round(s, 9).alias("s")) for p, s in mixes.items()))))
    return rows.groupBy("l_orderkey", "policy").agg(F.max_by("l_linenumber", F.struct("s", -F.col("l_linenumber"))).alias("winner"))


@query("x_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rolled_up(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("x_sessions", "SELECT user_id, session, count(*) AS n, min(ts) AS start FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL")
def user_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) / 1e6
    rows = t(spark, d, "events").withColumn("new", F.when(gap <= 1800, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"))


EXPECTED = "exq AS (SELECT q.vec_id AS query_id, q.label AS source, CASE WHEN q.vec_id % 300 <> 0 THEN (SELECT min(i.vec_id) FROM embeddings i WHERE i.label = q.label AND i.vec_id <> q.vec_id) END AS expected FROM embeddings q WHERE q.vec_id % 100 = 0)"


def expected_items(spark, d) -> DataFrame:
    """The smallest other vector of the query's label; every third query stands for an unknown item."""
    least = F.array_sort(F.collect_list("item_id"))
    two = ranking.top_k(index(spark, d).select("label", "item_id", F.lit(0.0).alias("score")), 2, "label", "item_id").groupBy("label").agg(least.alias("two"))
    own = F.when(F.col("two")[0] == F.col("query_id"), F.col("two")[1]).otherwise(F.col("two")[0])
    return asked(spark, d).join(two, "label").select("query_id", F.col("label").alias("source"), F.when(F.col("query_id") % 300 != 0, own).alias("expected"))


@query("ox1_build_examples", f"WITH {SIGNALS}, {EXPECTED}, best AS (SELECT query_id, max(item_id) FILTER (WHERE place = 1) AS winner, max(score) FILTER (WHERE place = 1) AS s1, max(score) FILTER (WHERE place = 2) AS s2, list(item_id) FILTER (WHERE place <= 5) AS five FROM placed GROUP BY query_id) SELECT query_id, CAST(source AS VARCHAR) AS source, winner, round(s1 - s2, 6) AS margin, expected IS NOT NULL AS known, expected IS NOT NULL AND coalesce(winner = expected, false) AS safe, coalesce(list_contains(five, expected), false) AS top5, CASE WHEN ('0x' || substr(sha1(CAST(source AS VARCHAR)), 1, 8))::BIGINT % 5 = 0 THEN 'validation' ELSE 'calibration' END AS split FROM exq LEFT JOIN best USING (query_id)")
def build_examples(spark, d):
    ranked = retrieval.normalised_fusion(signals(spark, d), (0.45, 0.05, 0.50)).withColumn("score", F.round("score", 9)).drop("rank")
    rows = confidence.build_examples(ranked, expected_items(spark, d).withColumn("source", F.col("source").cast("string")))
    return rows.select("query_id", "source", "winner", F.round("margin", 6).alias("margin"), "known", "safe", "top5", "split")


@query("oc1_recognised", "WITH one AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS q, l_linenumber AS p, round(l_discount, 9) AS s, CASE WHEN l_returnflag = 'R' THEN 0.08 ELSE -0.04 END AS bonus, l_linestatus AS st, l_tax FROM one), c AS (SELECT *, count(*) OVER w AS n, max((st = 'O')::INT) OVER w AS cued FROM b WINDOW w AS (PARTITION BY q)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN cued = 0 THEN 0.0 WHEN n > 1 THEN -round(s + CASE WHEN st = 'O' THEN bonus ELSE 0.0 END, 9) ELSE -s END, p) AS place FROM c), t AS (SELECT *, s - lead(s) OVER (PARTITION BY q ORDER BY place) AS margin FROM r), m AS (SELECT q, p, s, margin, 1 / (1 + exp(-(0.5 + 2.0 * (s - 0.05) / 0.03 + 1.5 * coalesce(margin, 0)))) AS cal, l_tax >= 0.07 AS ver FROM t WHERE place = 1) SELECT q AS query_id, p AS slug, round(margin, 6) AS margin, round(CASE WHEN ver THEN greatest(cal, 0.95) ELSE cal END, 6) AS confidence, CASE WHEN ver OR cal >= 0.8 THEN 'match' WHEN cal >= 0.4 THEN 'alternatives' ELSE 'not_found' END AS decision FROM m")
def recognised(spark, d):
    one = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_discount", "l_tax", "l_returnflag", "l_linestatus")))  # a position is one prediction
    rows = one.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("position"), F.col("l_linenumber").alias("slug"), F.round("l_discount", 9).alias("score"), F.when(F.col("l_returnflag") == "R", 0.08).otherwise(-0.04).alias("bonus"), (F.col("l_linestatus") == "O").alias("cued"), "l_tax")
    model = confidence.Logistic([0.05, 0.0], [0.03, 1.0], [2.0, 1.5], 0.5)
    out = confidence.recognised(rows, model, F.array("score", F.coalesce("margin", F.lit(0.0))), F.col("l_tax") >= 0.07, 0.8, 0.4)
    return out.select("query_id", "slug", F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"), "decision")


@query("ow2_tune_fields", f"WITH {SIGNALS}, g AS (SELECT round(0.05 * e, 10) AS we, round(0.05 * s, 10) AS ws, round(1 - 0.05 * e - 0.05 * s, 10) AS wo FROM range(0, 21) a(e), range(0, 21) b(s) WHERE e + s <= 20), ex AS (SELECT query_id, min_by(item_id, rank) FILTER (WHERE item_label = expected) AS e_item FROM top GROUP BY query_id), sc AS (SELECT t.query_id, CASE WHEN t.query_id % 200 = 0 THEN 'calibration' ELSE 'validation' END AS split, t.item_id, we, ws, wo, e_item, round(we * embedding + ws * sift + wo * ocr, 12) AS s FROM top t JOIN ex USING (query_id), g WHERE e_item IS NOT NULL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, we, ws ORDER BY s DESC, item_id) AS r FROM sc), m AS (SELECT split, we, ws, wo, round(avg((r = 1)::INT), 9) AS top1, round(avg((r <= 5)::INT), 9) AS top5, round(avg(1.0 / r), 9) AS mrr FROM rk WHERE item_id = e_item GROUP BY ALL), j AS (SELECT m.*, m.top1 >= b.top1 AND m.top5 >= b.top5 AND m.mrr >= b.mrr AS holds FROM m JOIN m b ON m.split = b.split AND b.we = 0.45 AND b.ws = 0.05) SELECT we::DOUBLE AS w_embedding, ws::DOUBLE AS w_sift, wo::DOUBLE AS w_ocr, round(max(mrr) FILTER (WHERE split = 'calibration'), 6) AS mrr, bool_and(holds) FILTER (WHERE split = 'validation') AS safe, bool_and(holds) AS robust FROM j GROUP BY ALL")
def tune_fields(spark, d):
    rows = materialise(signals(spark, d).drop("expected"), "signals")
    labels = asked(spark, d).select("query_id", "label")
    expected = rows.join(labels, "query_id").where("item_label = label").groupBy("query_id").agg(F.min_by("item_id", "rank").alias("expected"))
    split = F.when(F.col("query_id") % 200 == 0, "calibration").otherwise("validation").alias("split")
    out = retrieval.tune_fields(rows.join(expected, "query_id").select("query_id", split, "expected", "item_id", "embedding", "sift", "ocr"), retrieval.field_grid(spark), (0.45, 0.05))
    return out.select("w_embedding", "w_sift", "w_ocr", F.round("mrr", 6).alias("mrr"), "safe", "robust")


@query("a17_weighted_metrics", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * (l_linenumber = 1)::INT) / sum(l_quantity), 6) AS top1, round(sum(l_quantity * (l_linenumber <= 5)::INT) / sum(l_quantity), 6) AS top5, round(sum(l_quantity / l_linenumber) / sum(l_quantity), 6) AS mrr FROM lineitem GROUP BY 1")
def weighted_metrics(spark, d):
    out = ranking.rank_metrics(t(spark, d, "lineitem"), ["l_returnflag"], rank="l_linenumber", weight="l_quantity")
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("top1", "top5", "mrr")))
