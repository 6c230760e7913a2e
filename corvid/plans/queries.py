"""The operators on the driver's tables.

Stand-ins: ``part`` is the catalog (title, maker p_brand, category p_type),
``embeddings`` the vector index (rows whose id divides by ten are the stated
queries), ``events`` the log of decisions, ``documents`` read text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions import scoring, text
from corvid.functions.parse import last_page, normalized_predictions
from corvid.functions.similarity import indel_ratio
from corvid.operators import audit, confidence, eventlog, evidence, near_hashes, promotion, ranking, recognition, retrieval, taxonomy
from corvid.operators.similar_strings import similar_strings
from corvid.plans.registry import query
from corvid.plans.scratch import materialise


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark, d) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("category"), F.col("p_size").alias("alcohol"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("catalog_index"))


def log(spark, d) -> DataFrame:
    kind = F.col("event_type")
    decision = F.when(kind == "purchase", "match").when(kind.isin("click", "view"), "alternatives").otherwise("not_found")
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("original_name"), decision.alias("decision"), F.col("value").alias("total_ms"), "props")


def feedback(spark, d) -> DataFrame:
    rows = t(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return rows.select(F.col("event_id").alias("recognition_id"), F.when(F.col("event_type") == "purchase", "correct").otherwise("incorrect").alias("verdict"), F.col("ts").alias("created_at"))


LOG = """log AS (SELECT event_id AS id, ts AS created_at, user_id AS original_name, CASE WHEN event_type = 'purchase' THEN 'match' WHEN event_type IN ('click', 'view') THEN 'alternatives' ELSE 'not_found' END AS decision, value AS total_ms, props FROM events),
fb AS (SELECT event_id AS recognition_id, CASE WHEN event_type = 'purchase' THEN 'correct' ELSE 'incorrect' END AS verdict, ts AS f_at FROM events WHERE event_type IN ('purchase', 'error'))"""


@query("l1_log_page", f"WITH {LOG} SELECT id, created_at, decision, verdict, (SELECT count(*) FROM log WHERE decision = 'match') AS total FROM log LEFT JOIN fb ON id = recognition_id WHERE decision = 'match' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def log_page(spark, d):
    page = eventlog.listing(log(spark, d), 20, 20, decision="match")
    return eventlog.with_feedback(page, feedback(spark, d)).select("id", "created_at", "decision", "feedback.verdict", F.col("total").cast("long").alias("total"))


@query("w3_latest_per_name", f"WITH {LOG} SELECT original_name, id, created_at, verdict FROM (SELECT *, row_number() OVER (PARTITION BY original_name ORDER BY created_at DESC, id) AS rn FROM log LEFT JOIN fb ON id = recognition_id) WHERE rn = 1")
def latest_per_name(spark, d):
    rows = eventlog.with_feedback(log(spark, d), feedback(spark, d))
    return eventlog.latest_per_name(rows, "original_name", "created_at").select("original_name", "id", "created_at", "feedback.verdict")


@query("w4_latest_reviews", f"WITH {LOG} SELECT original_name, id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY original_name ORDER BY created_at DESC, id) AS rn FROM log JOIN fb ON id = recognition_id WHERE original_name % 3 = 0) WHERE rn = 1")
def latest_reviews(spark, d):
    rows = log(spark, d)
    names = rows.where("original_name % 3 = 0").select("original_name").distinct().withColumn("position", F.col("original_name"))
    return eventlog.latest_reviews(eventlog.with_feedback(rows, feedback(spark, d)), names).select("original_name", "id", "feedback.verdict")


@query("j2_reviewed", f"WITH {LOG} SELECT decision, verdict, count(*) AS n, round(avg(total_ms), 6) AS mean_ms FROM log JOIN fb ON id = recognition_id GROUP BY ALL")
def reviewed(spark, d):
    return eventlog.with_feedback(log(spark, d), feedback(spark, d), "inner").groupBy("decision", "feedback.verdict").agg(F.count("*").alias("n"), F.round(F.avg("total_ms"), 6).alias("mean_ms"))


@query("a20_log_statistics", f"WITH {LOG} SELECT count(*) AS total, CAST(sum(CASE WHEN decision = 'match' THEN 1 ELSE 0 END) AS BIGINT) AS decision_match, CAST(sum(CASE WHEN decision = 'alternatives' THEN 1 ELSE 0 END) AS BIGINT) AS decision_alternatives, CAST(sum(CASE WHEN decision = 'not_found' THEN 1 ELSE 0 END) AS BIGINT) AS decision_not_found, round(avg(total_ms), 6) AS mean_ms, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'incorrect') AS incorrect, CAST(0 AS BIGINT) AS not_in_catalog, CAST(0 AS BIGINT) AS not_in_store, count(verdict) AS reviewed FROM log LEFT JOIN fb ON id = recognition_id")
def log_statistics(spark, d):
    return eventlog.statistics(eventlog.with_feedback(log(spark, d), feedback(spark, d)))


@query("a10_latency_percentiles", f"WITH {LOG} SELECT decision, list_extract(list_sort(list(total_ms)), 1 + round_even((count(*) - 1) * 0.5, 0)::INT) AS p50, list_extract(list_sort(list(total_ms)), 1 + round_even((count(*) - 1) * 0.95, 0)::INT) AS p95 FROM log GROUP BY decision")
def latency_percentiles(spark, d):
    return eventlog.latency_percentiles(log(spark, d), "decision")


@query("a9_nearest_rank", "SELECT event_type, quantile_disc(value, 0.05) AS p05, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90_linear FROM events GROUP BY event_type")
def nearest_rank(spark, d):
    p = scoring.pct_nearest_rank
    return t(spark, d, "events").groupBy("event_type").agg(p("value", 0.05).alias("p05"), p("value", 0.5).alias("p50"), p("value", 0.95).alias("p95"), F.round(F.median("value"), 6).alias("med"), F.round(F.percentile("value", 0.9), 6).alias("p90_linear"))


@query("a12_quantile_higher", "SELECT event_type, list_extract(list_sort(list(value)), 1 + ceil((count(*) - 1) * 0.05::DOUBLE)::INT) AS q FROM events GROUP BY event_type")
def quantile_higher(spark, d):
    return ranking.order_statistic(t(spark, d, "events"), "event_type", "value", 1 + F.ceil((F.col("n") - 1) * F.lit(0.05))).select("event_type", F.col("value").alias("q"))


@query("d6_delete_cascade", f"WITH {LOG} SELECT (SELECT count(*) FROM log WHERE id % 7 <> 0) AS recognitions, (SELECT count(*) FROM fb WHERE recognition_id % 7 <> 0) AS feedback")
def delete_cascade(spark, d):
    rows = log(spark, d)
    r, f = eventlog.deleted(rows, feedback(spark, d), rows.where("id % 7 = 0").select("id"))
    return r.agg(F.count("*").alias("recognitions")).join(f.agg(F.count("*").alias("feedback")))


@query("r5_event_json", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def event_json(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("k9_json_export", "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS json FROM events")
def json_export(spark, d):
    return t(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("json"))


@query("a2_coverage", "SELECT 'text' AS field, count(*) FILTER (WHERE trim(text) <> '') AS present, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE trim(lang) <> ''), count(*) FILTER (WHERE lang IS NULL OR trim(lang) = '') FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE trim(source) <> ''), count(*) FILTER (WHERE source IS NULL OR trim(source) = '') FROM documents")
def field_coverage(spark, d):
    return audit.coverage(t(spark, d, "documents").select("text", "lang", "source"))


@query("p2_missing_fields", "SELECT CAST(p_partkey AS BIGINT) AS slug, f AS message FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_type END AS category FROM part), LATERAL (SELECT unnest(list_filter([CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing required field: title' END, CASE WHEN category IS NULL OR trim(category) = '' THEN 'missing required field: category' END], lambda x: x IS NOT NULL)) AS f)")
def missing_fields(spark, d):
    rows = catalog(spark, d).withColumn("title", F.when(F.col("alcohol") <= 25, F.col("title"))).withColumn("category", F.when(F.col("slug") % 5 == 0, " ").otherwise(F.col("category")))
    return audit.missing_field_issues(rows, "slug", ["title", "category"]).select("slug", "message")


@query("p3_suspicious_range", "SELECT CAST(p_partkey AS BIGINT) AS slug, 'alcohol out of range: ' || p_size AS message FROM part WHERE NOT (p_size BETWEEN 5 AND 25)")
def suspicious(spark, d):
    return audit.suspicious_range(catalog(spark, d), "slug", "alcohol").select("slug", "message")


@query("a1_duplicate_keys", "SELECT p_name AS title, count(*) AS count FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return audit.duplicate_keys(catalog(spark, d), "title")


@query("a3_grouped_values", "SELECT key, count(*) AS count, min(value) AS value, list_sort(list(DISTINCT value)) AS observed_values, list_sort(list(item)) AS items FROM (SELECT lower(p_type) AS key, p_type AS value, p_partkey AS item FROM part) GROUP BY key HAVING count(*) > 1")
def grouped_values(spark, d):
    return audit.grouped_values(catalog(spark, d), "category", "slug", True)


@query("a4_exact_groups", "SELECT sha256(text) AS digest, count(*) AS count, list_filter([CASE WHEN count(DISTINCT lang) > 1 THEN 'lang' END, CASE WHEN count(DISTINCT source) > 1 THEN 'source' END], lambda x: x IS NOT NULL) AS differing_fields FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_groups(spark, d):
    return audit.exact_groups(t(spark, d, "documents").withColumn("digest", F.sha2("text", 256)).drop("text"), "digest", ["lang", "source"])


@query("a5_distribution", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1")
def distribution(spark, d):
    return audit.distribution(catalog(spark, d), "manufacturer")


@query("j14_orphans", "SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphans(spark, d):
    return audit.orphans(t(spark, d, "part").select(F.col("p_partkey").alias("path")), t(spark, d, "lineitem").where("l_quantity > 45"), "l_partkey")


@query("u8_difference_both_ways", "SELECT k, 'left' AS only_in FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'right' FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)")
def difference(spark, d):
    return audit.difference_both_ways(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("s11_foreign_keys", "SELECT count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def foreign_keys(spark, d):
    return audit.foreign_key_violations(t(spark, d, "lineitem"), t(spark, d, "orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("violations"))


def signs(spark, d) -> DataFrame:
    words = sum((F.when(F.col("embedding")[i] > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for i in range(64)), F.lit(0).cast("long"))
    return t(spark, d, "embeddings").select("vec_id", "label", words.alias("bits"))


SIGNS = "s AS (SELECT vec_id, label, " + " || ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN '1' ELSE '0' END" for i in range(64)) + " AS bits FROM embeddings), pairs AS (SELECT a.label AS block, a.vec_id AS \"left\", b.vec_id AS \"right\", hamming(a.bits, b.bits) AS distance FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id AND hamming(a.bits, b.bits) <= 20)"


@query("j7_near_pairs", f"WITH {SIGNS} SELECT * FROM pairs")
def near_pairs(spark, d):
    return near_hashes.ordered_pairs(near_hashes.near_pairs(signs(spark, d), "vec_id", "label", ["bits"], 20))


@query("od1_near_groups", f"WITH RECURSIVE {SIGNS}, both_ways AS (SELECT \"left\" AS n, \"right\" AS m FROM pairs UNION SELECT \"right\", \"left\" FROM pairs), reach AS (SELECT n, n AS r FROM both_ways UNION SELECT reach.n, both_ways.m FROM reach JOIN both_ways ON reach.r = both_ways.n), roots AS (SELECT n, min(r) AS c FROM reach GROUP BY n), g AS (SELECT c, count(*) AS size, list_sort(list(n)) AS members FROM roots GROUP BY c), sp AS (SELECT c, min(distance) AS min_distance, max(distance) AS max_distance FROM pairs JOIN roots ON \"left\" = n GROUP BY c) SELECT printf('near-%04d', row_number() OVER (ORDER BY size DESC, members)) AS group_id, size, members, min_distance, max_distance FROM g JOIN sp USING (c)")
def near_groups(spark, d):
    return audit.near_groups(materialise(near_hashes.near_pairs(signs(spark, d), "vec_id", "label", ["bits"], 20), "pairs"))


LEVELS = (-0.3, -0.2, 0.2, 0.3)


def level_hash(embedding) -> Column:
    """256 bits as hex, a digit for each of 64 numbers: which of four levels it is above."""
    digit = lambda x: sum((F.when(x > F.lit(level).cast("float"), F.lit(1 << k)).otherwise(F.lit(0)) for k, level in enumerate(LEVELS)), F.lit(0))
    return F.array_join(F.transform(embedding, lambda x: F.lower(F.hex(digit(x)))), "")


@query("f16_near_256", f"""
WITH RECURSIVE s AS (
  SELECT vec_id, label, {" || ".join(f"CASE WHEN embedding[{i + 1}] > {t}::FLOAT THEN '1' ELSE '0' END" for i in range(64) for t in LEVELS)} AS bits FROM embeddings),
pairs AS (SELECT a.vec_id AS n, b.vec_id AS m FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND hamming(a.bits, b.bits) <= 8),
reach AS (SELECT vec_id AS n, vec_id AS r FROM s UNION SELECT reach.n, m FROM reach JOIN pairs ON pairs.n = r)
SELECT label AS block, vec_id AS member, (SELECT min(r) FROM reach WHERE reach.n = vec_id) AS component, (SELECT count(*) FROM pairs WHERE pairs.n = vec_id) AS links FROM s""")
def near_256(spark, d):
    """256-bit hashes within eight bits of each other: every vector's group and number of links."""
    hashed = t(spark, d, "embeddings").select("vec_id", "label", level_hash(F.col("embedding")).alias("hash"))
    words = hashed.select("vec_id", "label", *(w.alias(f"w{k}") for k, w in enumerate(scoring.hash_words(F.col("hash")))))
    return near_hashes.near_links(words, "vec_id", "label", [f"w{k}" for k in range(4)], 8)


TOKENS = "list_filter(regexp_extract_all(replace(lower({c}), 'ё', 'е'), '[0-9a-zа-я]+'), lambda x: length(x) >= 2)"


@query("t2_tokens", f"SELECT doc_id, len({TOKENS.format(c='text')}) AS n, len(list_distinct({TOKENS.format(c='text')})) AS n_distinct FROM documents")
def count_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"))


@query("t3_metadata_text", "SELECT p_partkey, array_to_string(regexp_extract_all(replace(lower(concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))), 'ё', 'е'), '[0-9a-zа-я]+'), ' ') AS metadata FROM part")
def metadata_text(spark, d):
    return t(spark, d, "part").select("p_partkey", text.metadata_text(*(F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))).alias("metadata"))


@query("t9_collapse", "SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def collapse(spark, d):
    return t(spark, d, "documents").select("doc_id", F.length(text.collapse(F.col("text"))).cast("long").alias("n"))


@query("t12_plain_tokens", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-zа-яё]+', ' ', 'g')) AS s FROM part")
def plain_tokens(spark, d):
    return t(spark, d, "part").select("p_partkey", text.plain_tokens(F.concat_ws(" ", "p_name", "p_brand")).alias("s"))


@query("t13_safe_filename", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 4, '0') || '-' || rtrim(substr(p_name, 1, 42), '-') || '-' || substr(sha256(p_name), 1, 10) || '-v' || lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0') || '.jpg' AS file FROM part")
def safe_filename(spark, d):
    return t(spark, d, "part").select("p_partkey", text.safe_filename(F.col("p_size"), F.col("p_name"), F.col("p_name"), F.col("p_partkey") % 7).alias("file"))


@query("f1_edit_similarity", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 1.0 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END, 9) AS s FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def edit_similarity(spark, d):
    return evidence.edit_similarities(t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", "p_name", ["p_brand", "p_size"])


@query("u9_token_overlap", f"SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(list_distinct({TOKENS.format(c='a.text')}), list_distinct({TOKENS.format(c='b.text')}))) / greatest(1, least(len(list_distinct({TOKENS.format(c='a.text')})), len(list_distinct({TOKENS.format(c='b.text')})))), 9) AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def token_overlap(spark, d):
    x = t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("x"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("x").alias("y"))
    return x.join(y, "doc_id").select(F.col("doc_id").alias("a"), "b", F.round(text.overlap_coefficient(F.col("x"), F.col("y")), 9).alias("s"))


def index(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def asked(spark, d) -> DataFrame:
    """The stated queries; each is held against all vectors but its own."""
    return t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


SIGNALS = """sig AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label AS item_label, q.label AS expected, list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS embedding, list_dot_product(q.embedding[1:32]::DOUBLE[], i.embedding[1:32]::DOUBLE[]) AS sift, list_dot_product(q.embedding[33:64]::DOUBLE[], i.embedding[33:64]::DOUBLE[]) AS ocr FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(embedding, 9) DESC, item_id) AS rank FROM sig) WHERE rank <= 30),
norm AS (SELECT *, (embedding - min(embedding) OVER w) / greatest(max(embedding) OVER w - min(embedding) OVER w, 1e-7) AS e FROM top WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT *, round(0.45 * e + 0.05 * sift + 0.50 * ocr, 9) AS score FROM norm),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM fused)"""


HALVES = {"sift": slice(0, 32), "ocr": slice(32, 64)}


def signals(spark, d, k: int = 30) -> DataFrame:
    """The 30 nearest items of each query with three signals (whole vector, its halves)."""
    found = retrieval.signals(asked(spark, d), index(spark, d), HALVES, k)
    q = asked(spark, d).select("query_id", F.col("label").alias("expected"))
    i = index(spark, d).select("item_id", F.col("label").alias("item_label"))
    return found.join(F.broadcast(q), "query_id").join(i, "item_id")  # the stated queries are few


@query("w5_topk_cosine", f"WITH {SIGNALS} SELECT query_id, item_id, round(embedding, 6) AS score FROM top")
def topk_cosine(spark, d):
    return retrieval.search(asked(spark, d), index(spark, d), 30, others_only=True, digits=9).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("h1_hybrid_fusion", f"WITH {SIGNALS} SELECT query_id, item_id, place, round(score, 6) AS score, item_label = expected AS hit FROM placed WHERE place <= 5")
def hybrid_fusion(spark, d):
    rows = retrieval.normalised_fusion(signals(spark, d), (0.45, 0.05, 0.50)).withColumn("score", F.round("score", 9))
    best = ranking.top_k(rows.drop("rank"), 5)
    return best.select("query_id", "item_id", F.col("rank").cast("long").alias("place"), F.round("score", 6).alias("score"), (F.col("item_label") == F.col("expected")).alias("hit"))


@query("a16_rank_metrics", f"WITH {SIGNALS}, r AS (SELECT query_id, min(place) FILTER (WHERE item_label = expected) AS rank FROM placed GROUP BY query_id) SELECT count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 9) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS top5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM r")
def metrics(spark, d):
    rows = retrieval.normalised_fusion(signals(spark, d), (0.45, 0.05, 0.50)).withColumn("score", F.round("score", 9)).drop("rank")
    placed = ranking.top_k(rows, 30)
    per = placed.groupBy("query_id").agg(F.min(F.when(F.col("item_label") == F.col("expected"), F.col("rank"))).alias("rank"))
    return ranking.rank_metrics(per)


@query("a18_candidate_recall", f"WITH {SIGNALS} SELECT round(avg(h), 9) AS recall FROM (SELECT query_id, max(CASE WHEN item_label = expected THEN 1.0 ELSE 0.0 END) AS h FROM top GROUP BY query_id)")
def candidate_recall(spark, d):
    return signals(spark, d).groupBy("query_id").agg(F.max((F.col("item_label") == F.col("expected")).cast("double")).alias("h")).agg(F.round(F.avg("h"), 9).alias("recall"))


@query("ow1_weight_grid", f"WITH {SIGNALS}, g AS (SELECT i * 0.05 AS ws, j * 0.05 AS wo FROM range(0, 13) a(i), range(1, 11) b(j) WHERE i + j <= 16), ex AS (SELECT query_id, min_by(item_id, rank) FILTER (WHERE item_label = expected) AS e_item FROM top GROUP BY query_id HAVING count(*) FILTER (WHERE item_label = expected) > 0), sc AS (SELECT t.query_id, t.item_id, ws, wo, round((1 - ws - wo) * embedding + ws * sift + wo * ocr, 12) AS s, e_item FROM top t JOIN ex USING (query_id), g), rk AS (SELECT query_id, ws, wo, item_id, e_item, row_number() OVER (PARTITION BY query_id, ws, wo ORDER BY s DESC, item_id) AS r FROM sc) SELECT round(ws, 6) AS ws, round(wo, 6) AS wo, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS top5, round(avg(1.0 / r), 6) AS mrr FROM rk WHERE item_id = e_item GROUP BY ALL")
def weight_grid(spark, d):
    rows = materialise(signals(spark, d), "signals")
    expected = rows.where("item_label = expected").groupBy("query_id").agg(F.min_by("item_id", "rank").alias("item_id"))
    out = retrieval.choose_weights(rows.select("query_id", "item_id", "embedding", "sift", "ocr"), expected, retrieval.weight_grid(spark))
    return out.select(*(F.round(c, 6).alias(c) for c in ("ws", "wo", "top1", "top5", "mrr")))


@query("w9_view_agreement", f"WITH {SIGNALS}, views AS (SELECT query_id, item_id, 'full' AS v, round(embedding, 9) AS s FROM top UNION ALL SELECT query_id, item_id, 'medium', round(sift, 9) FROM top UNION ALL SELECT query_id, item_id, 'detail', round(ocr, 9) FROM top), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY s DESC, item_id) AS r FROM views), win AS (SELECT query_id, item_id AS winner FROM top WHERE rank = 1), ag AS (SELECT query_id, max(c) AS agree FROM (SELECT query_id, item_id, count(*) AS c FROM r WHERE r = 1 GROUP BY ALL) GROUP BY query_id) SELECT query_id, round(any_value(agree) / 3, 9) AS agreement, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 9) AS top1_fraction, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 9) AS top5_fraction, round(avg(s), 6) AS score_mean, round(stddev_pop(s), 6) AS score_std FROM r JOIN win USING (query_id) JOIN ag USING (query_id) WHERE item_id = winner GROUP BY query_id")
def view_agreement(spark, d):
    rows = materialise(signals(spark, d), "signals")
    views = F.array(*(F.struct(F.lit(v).alias("view"), F.round(c, 9).alias("score")) for v, c in (("full", "embedding"), ("medium", "sift"), ("detail", "ocr"))))
    winner = rows.where("rank = 1").select("query_id", F.col("item_id").alias("winner"))
    long = rows.join(winner, "query_id").select("query_id", "item_id", "winner", F.inline(views))
    return retrieval.views_summary(long).withColumns({c: F.round(c, 6) for c in ("score_mean", "score_std")})


@query("u1_candidate_union", f"WITH {SIGNALS}, txt AS (SELECT query_id, item_id, ocr AS s FROM sig WHERE ocr > 0), v AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(embedding, 9) DESC, item_id) AS r FROM sig), a AS (SELECT query_id, item_id, 0 AS p, r FROM v WHERE r <= 20), b AS (SELECT query_id, item_id, 1 AS p, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, item_id) AS r FROM txt ANTI JOIN a USING (query_id, item_id)), c AS (SELECT query_id, item_id, 2 AS p, r FROM v WHERE r > 20 AND r <= 30), u AS (SELECT query_id, item_id, min((p, r)) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL) SELECT query_id, item_id, position, source FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY k, item_id) AS position, ['visual', 'ocr', 'fill'][k[1] + 1] AS source FROM u) WHERE position <= 30")
def candidate_union(spark, d):
    q, i = asked(spark, d), index(spark, d)
    second = lambda df: df.withColumn("embedding", F.slice("embedding", 33, 32))
    visual = retrieval.search(q, i, 30, others_only=True, digits=9).drop("rank")
    # 20 of the textual candidates may be visual ones already
    textual = retrieval.search(second(q), second(i), 50, others_only=True, above=0.0, digits=9).drop("rank")
    return retrieval.candidate_union(visual, textual, 20, 10).withColumn("position", F.col("position").cast("long"))


@query("og1_gate", f"""
WITH {SIGNALS},
al AS (SELECT query_id, item_id, round(0.65 * embedding + 0.35 * ocr, 9) AS s FROM sig WHERE item_label = expected AND query_id % 200 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM al),
n AS (SELECT query_id, count(*) AS c FROM al GROUP BY 1),
u AS (
  SELECT query_id, item_id, 0 AS p, r FROM f WHERE r <= 30
  UNION ALL
  SELECT query_id, item_id, 1, rank FROM top ANTI JOIN (SELECT * FROM f WHERE r <= 30) x USING (query_id, item_id))
SELECT query_id, item_id, position, allowed, coalesce(c, 0) AS candidate_count
FROM (SELECT query_id, item_id, p = 0 AS allowed, row_number() OVER (PARTITION BY query_id ORDER BY p, r, item_id) AS position FROM u)
LEFT JOIN n USING (query_id) WHERE position <= 30""")
def gate(spark, d):
    """Injection by gate score: whole vectors as the visual signal, their second halves as the text's."""
    q, i = asked(spark, d), index(spark, d)
    hard = q.where("query_id % 200 = 0")  # stands for the queries whose maker is recognised
    both = lambda df, query: df.withColumn("embedding", recognition.gate_vectors(F.col("embedding"), F.slice("embedding", 33, 32), query))
    allowed = materialise(retrieval.search(both(hard, True), both(i, False), 30, same="label", others_only=True, digits=9).select("query_id", "item_id", "score"), "gate")
    counts = hard.join(i.groupBy("label").agg((F.count("*") - 1).alias("candidate_count")), "label").where("candidate_count > 0").select("query_id", "candidate_count")
    candidates = signals(spark, d).select("query_id", "item_id", F.col("rank").alias("position"))
    return retrieval.gated(candidates, allowed, allowed.select("query_id", "item_id"), 30, counts=counts).withColumn("position", F.col("position").cast("long"))


@query("m8_relative_support", f"WITH {SIGNALS} SELECT query_id, item_id, round(exp((score - max(score) OVER w) / 0.08) / sum(exp((score - max(score) OVER w) / 0.08)) OVER w2, 6) AS support FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM placed WHERE place <= 5) WINDOW w AS (PARTITION BY query_id), w2 AS (PARTITION BY query_id)".replace("exp((score - max(score) OVER w) / 0.08)", "exp((score - m) / 0.08)"))
def relative_support(spark, d):
    rows = ranking.top_k(retrieval.normalised_fusion(signals(spark, d), (0.45, 0.05, 0.50)).withColumn("score", F.round("score", 9)).drop("rank"), 5)
    top = F.max("score").over(Window.partitionBy("query_id"))
    return rows.withColumn("top", top).select("query_id", "item_id", F.round(scoring.relative_support(F.col("score"), "query_id", F.col("top")), 6).alias("support"))


def examples(spark, d) -> DataFrame:
    """Stand-in for scored examples: known is not toxic, safe is good quality, confidence a fixed function of length."""
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return rows.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("source_slug"), (F.col("toxic") == 0).alias("known"), (F.col("quality") == 1).alias("safe"), F.round((F.col("n_chars") % 1000) / 1000.0, 3).alias("confidence"))


EX = "ex AS (SELECT doc_id AS sample_id, source AS source_slug, toxic = 0 AS known, quality = 1 AS safe, round((n_chars % 1000) / 1000.0, 3)::DOUBLE AS confidence FROM labels JOIN documents USING (doc_id))"


@query("a21_rates", f"WITH {EX}, r AS (SELECT round(avg(CASE WHEN NOT known THEN (confidence >= 0.5)::INT END), 9) AS unknown_far, round(avg(CASE WHEN known AND safe THEN (confidence < 0.5)::INT END), 9) AS false_reject, round(avg((confidence >= 0.5)::INT), 9) AS coverage, round(avg(CASE WHEN confidence >= 0.5 THEN (known AND safe)::INT END), 9) AS precision, count(*) FILTER (WHERE NOT known AND confidence >= 0.5)::DOUBLE AS h, count(*) FILTER (WHERE NOT known)::DOUBLE AS n FROM ex) SELECT unknown_far, false_reject, coverage, precision, round(greatest((h / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 0), 9) AS far_low, round(least((h / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 1), 9) AS far_high FROM r")
def acceptance_rates(spark, d):
    return confidence.rates(examples(spark, d), F.col("confidence") >= 0.5)


@query("a22_sources_accepted", f"WITH {EX} SELECT source_slug AS source, bool_or(confidence >= 0.9) AS accepted FROM ex GROUP BY 1")
def sources_accepted(spark, d):
    return confidence.sources_accepted(examples(spark, d), F.col("confidence") >= 0.9)


@query("a24_auc", f"WITH {EX} SELECT round((SELECT avg(CASE WHEN p.confidence > n.confidence THEN 1.0 WHEN p.confidence = n.confidence THEN 0.5 ELSE 0 END) FROM ex p, ex n WHERE p.safe AND NOT n.safe), 9) AS auc")
def area_under_curve(spark, d):
    return ranking.auc(examples(spark, d), "safe", "confidence")


@query("a25_calibration_error", f"WITH {EX}, e AS (SELECT CASE WHEN i = 10 THEN 10 ELSE i END AS i, i * 0.1::DOUBLE AS lo, i * 0.1::DOUBLE + 0.1::DOUBLE AS hi FROM range(0, 10) t(i)), b AS (SELECT i, count(*) AS n, avg(safe::INT) AS y, avg(confidence) AS p FROM ex JOIN e ON confidence >= lo AND (confidence < hi OR (hi >= 1.0 AND confidence <= hi)) GROUP BY i) SELECT round(sum(n * abs(y - p)) / (SELECT count(*) FROM ex), 9) AS ece FROM b")
def calibration_error(spark, d):
    return confidence.calibration_error(examples(spark, d), "safe", "confidence")


@query("a26_brier", f"WITH {EX} SELECT round(avg((confidence - safe::INT) ** 2), 9) AS brier FROM ex")
def brier(spark, d):
    return confidence.brier(examples(spark, d), "safe", "confidence")


@query("p12_decision", f"WITH {EX} SELECT sample_id, CASE WHEN confidence >= 0.92 AND safe THEN greatest(confidence, 0.95) ELSE confidence END AS confidence, CASE WHEN confidence >= 0.92 AND safe THEN 'match' WHEN confidence >= 0.8 THEN 'match' WHEN confidence >= 0.4 THEN 'alternatives' ELSE 'not_found' END AS decision FROM ex")
def decisions(spark, d):
    rows = examples(spark, d)
    return rows.select("sample_id", *(c.alias(n) for n, c in confidence.final_decision(F.col("confidence"), (F.col("confidence") >= 0.92) & F.col("safe"), 0.8, 0.4).items()))


@query("m5_sigmoid", f"WITH {EX} SELECT sample_id, round(1 / (1 + exp(-greatest(least((confidence - 0.5) * 90, 35), -35))), 9) AS p FROM ex")
def sigmoid(spark, d):
    return examples(spark, d).select("sample_id", F.round(scoring.sigmoid((F.col("confidence") - 0.5) * 90), 9).alias("p"))


@query("ol2_thresholds", f"WITH {EX}, b AS (SELECT confidence AS c, count(*) FILTER (WHERE known AND safe) AS g, count(*) FILTER (WHERE known AND NOT safe) AS w, count(*) FILTER (WHERE NOT known) AS u FROM ex GROUP BY 1), s AS (SELECT sum(g) AS g, sum(w) AS w, sum(u) AS u FROM b), a AS (SELECT c, sum(g) OVER o AS g, sum(w) OVER o AS w, sum(u) OVER o AS u FROM b WINDOW o AS (ORDER BY c DESC)), f AS (SELECT a.c, a.g FROM a, s WHERE a.u <= 0.025 * s.u AND a.w <= 0.05 * s.w ORDER BY a.g DESC, a.c LIMIT 1), x AS (SELECT coalesce((SELECT max(c) FROM b WHERE c < (SELECT c FROM f)), 0.0) AS accept), v AS (SELECT min(c) AS review FROM (SELECT c, sum(g) OVER (ORDER BY c) AS n FROM b WHERE g > 0), s WHERE n >= ceil((s.g - 1) * 0.05) + 1) SELECT round(accept, 9)::DOUBLE AS accept, round(least(review, accept), 9)::DOUBLE AS review FROM x, v")
def thresholds(spark, d):
    accept, review = confidence.choose_thresholds(examples(spark, d))
    return spark.range(1).select(F.round(F.lit(accept), 9).alias("accept"), F.round(F.lit(review), 9).alias("review"))


@query("ol1_logistic")
def logistic(spark, d):
    rows = examples(spark, d).select(F.array("confidence", F.length("source_slug").cast("double")).alias("x"), "safe")
    m = confidence.fit_logistic(rows, "x", "safe", 2)
    return spark.range(1).select(F.array(*(F.round(F.lit(c), 9) for c in m.coefficients)).alias("coefficients"), F.round(F.lit(m.intercept), 9).alias("intercept"))


@query("h3_field_split", "SELECT p_partkey, CASE WHEN h <= 2 THEN 'calibration' WHEN h = 3 THEN 'validation' ELSE 'test' END AS split, h AS fold FROM (SELECT p_partkey, ('0x' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT % 5 AS h FROM part)")
def field_split(spark, d):
    return t(spark, d, "part").select("p_partkey", scoring.field_split(F.col("p_partkey").cast("string")).alias("split"), scoring.hash_fold(F.col("p_partkey"), 5).alias("fold"))


@query("h5_round_robin", "SELECT p_partkey, ['clean', 'glare', 'low_light', 'perspective', 'occlusion', 'low_res'][1 + (p_partkey + 3) % 6] AS profile FROM part")
def round_robin(spark, d):
    return t(spark, d, "part").select("p_partkey", scoring.round_robin(["clean", "glare", "low_light", "perspective", "occlusion", "low_res"], F.col("p_partkey") + 3).alias("profile"))


@query("h4_stable_seed", "SELECT p_partkey, substr(sha256('20260920:' || p_partkey || ':0'), 1, 16) AS h FROM part")
def stable_seed(spark, d):
    seed = scoring.stable_seed(20260920, F.col("p_partkey"), F.lit(0))
    return t(spark, d, "part").select("p_partkey", F.lower(F.lpad(F.conv(seed.cast("string"), 10, 16), 16, "0")).alias("h"))


@query("a14_breakdown", "SELECT coalesce(nullif(lang, ''), '<missing>') AS value, count(*) AS n, round(avg((r = 1)::INT), 9) AS top1, round(avg((r <= 5)::INT), 9) AS top5, round(avg(1.0 / r), 9) AS mrr FROM (SELECT lang, 1 + doc_id % 7 AS r FROM documents) GROUP BY 1")
def breakdown(spark, d):
    return ranking.breakdown(t(spark, d, "documents").select("lang", (1 + F.col("doc_id") % 7).alias("rank")), "lang")


@query("a29_entropy", "SELECT round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM part GROUP BY p_size)")
def entropy(spark, d):
    n = t(spark, d, "part").groupBy("p_size").count()
    total = n.agg(F.sum("count")).first()[0]
    return n.select((F.col("count") / total).alias("p")).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 9).alias("entropy"))


@query("a31_terciles", "SELECT lang, k AS tercile, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM (SELECT lang, n_chars, ntile(3) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents) GROUP BY ALL")
def terciles(spark, d):
    placed = ranking.tiles(t(spark, d, "documents").select("lang", "n_chars", "doc_id"), "lang", ["n_chars", "doc_id"], 3)
    return placed.groupBy("lang", F.col("tile").alias("tercile")).agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("a32_parameter_summary", "SELECT l_returnflag AS key, min(l_discount) AS low, round(median(l_discount), 9) AS middle, max(l_discount) AS high, count(*) AS n FROM lineitem GROUP BY 1")
def parameter_summary(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key")).agg(F.min("l_discount").alias("low"), F.round(F.median("l_discount"), 9).alias("middle"), F.max("l_discount").alias("high"), F.count("*").alias("n"))


@query("a33_gained_lost", "SELECT count(*) FILTER (WHERE a = 1 AND b <> 1) AS gained, count(*) FILTER (WHERE b = 1 AND a <> 1) AS lost, count(*) FILTER (WHERE a = 1 AND b = 1) AS kept, count(*) FILTER (WHERE a <> b) AS changed FROM (SELECT 1 + doc_id % 3 AS b, 1 + doc_id % 4 AS a FROM documents)")
def gained_lost(spark, d):
    rows = t(spark, d, "documents").select((1 + F.col("doc_id") % 3).alias("b"), (1 + F.col("doc_id") % 4).alias("a"))
    return ranking.gained_and_lost(rows, "b", "a")


@query("p9_catalog_search", "SELECT p_partkey AS slug, p_name AS title FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_partkey), 'red') ORDER BY p_partkey LIMIT 20")
def catalog_search(spark, d):
    return promotion.search(catalog(spark, d), " RED ").select("slug", "title")


@query("p7_promotion", "SELECT p_partkey AS slug FROM part WHERE contains(lower(p_brand), '#1') AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def promotion_filter(spark, d):
    return promotion.promoted(catalog(spark, d), catalog(spark, d).where("alcohol < 20"), "#1").select("slug")


@query("j3_catalog_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 WHERE l_quantity > 40")
def catalog_lookup(spark, d):
    return t(spark, d, "lineitem").where("l_quantity > 40").join(t(spark, d, "part").where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_name")


@query("r1_normalized_predictions", "SELECT u, list(s ORDER BY k) AS slugs FROM (SELECT user_id AS u, event_type AS s, min(event_id) AS k FROM events GROUP BY ALL) GROUP BY u")
def predictions(spark, d):
    first = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value")).alias("f"))  # a row for each type
    rows = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f.event_id", F.concat(F.lit(" "), "event_type").alias("s"), "f.value"))).alias("r"))
    return rows.select(F.col("user_id").alias("u"), normalized_predictions(F.col("r.s"), F.col("r.value")).getField("slug").alias("slugs"))


@query("r2_html_cards", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?is)<a href=\"([^\"]+)\"', 1)) AS links FROM pages")
def html_cards(spark, d):
    return t(spark, d, "pages").select("page_id", text.collapse(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit('(?is)<a href="([^"]+)"'), F.lit(1))).cast("long").alias("links"))


@query("r3_last_page", "SELECT page_id, CAST(NULL AS INT) AS last FROM pages")
def page_count(spark, d):
    return t(spark, d, "pages").select("page_id", last_page(F.col("html")).alias("last"))


@query("a27_coverage_metrics", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(line), 'ё', 'е'), '[0-9a-zа-я]+'), ' ') AS s FROM l), k AS (SELECT doc_id, count(DISTINCT w) AS unique_token_count, count(DISTINCT w) FILTER (WHERE length(w) >= 4) AS long_token_count, count(*) AS token_count FROM (SELECT doc_id, unnest(list_filter(string_split(s, ' '), lambda x: length(x) >= 2)) AS w FROM n) GROUP BY 1) SELECT doc_id, count(*) AS line_count, CAST(sum(length(replace(s, ' ', ''))) AS BIGINT) AS char_count, coalesce(any_value(k.token_count), 0) AS token_count, 1.0::DOUBLE AS mean_confidence, coalesce(any_value(unique_token_count), 0) AS unique_token_count, coalesce(any_value(long_token_count), 0) AS long_token_count FROM n LEFT JOIN k USING (doc_id) GROUP BY doc_id")
def coverage_metrics(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).withColumn("score", F.lit(1.0))
    return evidence.coverage_metrics(lines, "doc_id")


@query("m11_attribute_bonus")
def attribute_bonus(spark, d):
    rows = catalog(spark, d)
    key = text.fuzzy_key(text.normalized(F.col("title")))
    return rows.select("slug", F.round(confidence.attribute_bonus(key, text.fuzzy_key(text.normalized(F.col("category"))), F.lit("red")), 6).alias("bonus"))


@query("m12_semantic_rerank", "SELECT l_orderkey AS query_id, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN cued = 0 THEN 0 WHEN n > 1 AND l_linestatus = 'O' THEN -round(l_discount + CASE WHEN l_returnflag = 'R' THEN 0.08 ELSE -0.04 END, 9) ELSE -round(l_discount, 9) END, l_linenumber) AS new_position FROM (SELECT *, count(*) OVER w AS n, max((l_linestatus = 'O')::INT) OVER w AS cued FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))")
def semantic_rerank(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("position"), F.round("l_discount", 9).alias("score"), F.when(F.col("l_returnflag") == "R", 0.08).otherwise(-0.04).alias("bonus"), (F.col("l_linestatus") == "O").alias("cued"))
    return confidence.semantic_rerank(rows, cued="cued").select("query_id", "position", F.col("new_position").cast("long").alias("new_position"))


@query("f7_text_scores")
def text_scores(spark, d):
    lines = catalog(spark, d).where("slug % 100 = 0").select(F.col("slug").alias("query_id"), F.col("title").alias("text"), F.lit(0.9).alias("score"))
    known = catalog(spark, d).select(F.col("slug").alias("item_id"), F.concat_ws(" ", "title", "category").alias("text"))
    return evidence.class_scores(lines, known, digits=9).best(5)


@query("f9_field_scores")
def field_scores(spark, d):
    q = catalog(spark, d).select(F.col("slug").alias("query_id"), F.col("slug").alias("item_id"), F.col("category").alias("text"))
    return evidence.field_scores(q, catalog(spark, d).select(F.col("slug").alias("item_id"), F.col("title").alias("text"))).withColumn("score", F.round("score", 9))


@query("ot2_resolve_maker")
def resolve_maker(spark, d):
    lines = catalog(spark, d).select(F.col("slug").alias("query_id"), F.lit(0).alias("position"), F.col("manufacturer").alias("text"), F.lit(0.95).alias("score"))
    return taxonomy.resolve(lines, catalog(spark, d).select(F.col("manufacturer").alias("value")).distinct())


@query("f4_seq_ratio")
def sequence_ratio(spark, d):
    """All pairs of distinct titles of 0.75 or more by matching blocks."""
    names = catalog(spark, d).select(F.col("title").alias("a")).distinct()
    pairs = similar_strings(names, names.withColumnRenamed("a", "b"), "a", "b", 0.75, where=F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round("similarity", 9).alias("ratio"))


@query("j10_similar_words")
def similar_words(spark, d):
    """The words of the stated documents against those of all: insertion and deletion ratio of 0.9 or more."""
    texts = t(spark, d, "documents")
    asked, known = (evidence.exploded_tokens(x, [], "text").distinct() for x in (texts.where("doc_id % 100 = 0"), texts))
    pairs = evidence.token_similarities(asked, known, 0.9, indel_ratio, 100.0)
    return pairs.where("token <> candidate").select("token", "candidate", F.round("similarity", 9).alias("ratio"))
