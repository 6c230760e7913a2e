"""Resolving noisy lines to a taxonomy value (a producer)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import aliases, edit_similarity, normalized, prefix_similarity, source_keys
from corvid.operators.graph import connected_components
from corvid.operators.similar_strings import similar_strings
from corvid.plans.scratch import materialise


def alias_table(values: DataFrame, value: str = "value") -> DataFrame:
    """``(value, alias)`` of every distinct non-empty value."""
    named = values.select(F.trim(F.col(value)).alias("value")).where("value <> ''").distinct()
    return named.select("value", F.explode(aliases(normalized(F.col("value")))).alias("alias"))


def spelling_groups(values: DataFrame, value: str = "value") -> DataFrame:
    """``(value, root)``: spellings that share an alias of six letters or more are one producer.

    Each alias links its values to the smallest of them, so a shared alias
    costs a row per value.
    """
    named = values.select(F.trim(F.col(value)).alias("value")).where("value <> ''").distinct()
    long = alias_table(values, value).where(F.length(F.replace("alias", F.lit(" "), F.lit(""))) >= 6)
    roots = long.groupBy("alias").agg(F.min("value").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = long.join(roots, "alias").select(F.col("value").alias("src"), F.col("low").alias("dst")).where("src <> dst")
    parts = connected_components(edges)
    return named.join(parts, named.value == parts.node, "left").select("value", F.coalesce("component", "value").alias("root"))


def line_sources(lines: DataFrame, by: str = "query_id") -> DataFrame:
    """Keys of every line with its confidence, and one of all lines together."""
    rows = lines.select(by, "position", F.coalesce("score", F.lit(0.0)).alias("confidence"), F.posexplode(source_keys(normalized(F.col("text")))).alias("k", "text"))
    together = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "k", "text"))), lambda x: x["text"]), " ").alias("text"), F.avg("confidence").alias("confidence"))
    return rows.select(by, "text", "confidence").unionByName(together.select(by, "text", "confidence"))


def _kernel(window: Column, alias: Column) -> Column:
    return F.greatest(edit_similarity(window, alias), prefix_similarity(window, alias))


def windows_of(texts: DataFrame, longest: int) -> DataFrame:
    """``(text, window, width, whole)``: each text, and its runs of up to ``longest`` tokens."""
    q = texts.select("text", F.split("text", " ").alias("q"))
    widths = q.select("text", "q", F.explode(F.sequence(F.lit(1), F.least(F.size("q"), F.lit(longest)))).alias("width"))
    runs = widths.select("text", "q", "width", F.explode(F.sequence(F.lit(1), F.size("q") - F.col("width") + 1)).alias("at"))
    parts = runs.select("text", F.array_join(F.slice("q", F.col("at"), F.col("width")), " ").alias("window"), "width", F.lit(False).alias("whole"))
    return parts.distinct().unionByName(q.select("text", F.col("text").alias("window"), F.size("q").alias("width"), F.lit(True).alias("whole")))


def similar_texts(texts: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """``(text, alias, similarity)`` of ``cutoff`` or more (up to 0.58), as ``text.window_similarity`` has it.

    Windows and aliases meet through the index of ``similar_strings``: an edit
    similarity shares as many letters as a ratio of the same height, a prefix
    of 0.58 of a word is more than 0.58 of its letters, and a contained alias
    is a window of its own.
    """
    named = vocabulary.select("alias", F.size(F.split("alias", " ")).alias("size"))
    longest = named.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).first()["n"] + 1
    windows = materialise(windows_of(texts, longest), "windows")
    near = similar_strings(windows, vocabulary, "window", "alias", cutoff, _kernel)
    low = F.greatest(F.lit(1), F.col("size") - 1)
    fits = F.col("whole") | F.col("width").between(low, F.col("size") + 1)
    met = near.join(windows, "window").join(named, "alias").where(fits)
    return met.groupBy("text", "alias").agg(F.max("similarity").alias("similarity"))


def _best_groups(sources: DataFrame, named: DataFrame, similar: DataFrame, by: str) -> DataFrame:
    short = (F.length(F.replace("alias", F.lit(" "), F.lit(""))) <= 4) & (F.col("similarity") < 1)
    score = F.col("similarity") * (0.90 + 0.10 * F.greatest(F.lit(0.0), F.least(F.col("confidence"), F.lit(1.0)))) * F.when(short, 0.92).otherwise(1.0)
    scored = sources.join(similar, "text").join(named, "alias").select(by, "root", "value", "text", score.alias("score"))
    return scored.groupBy(by, "root").agg(F.max(F.struct("score", "value", "text")).alias("b")).select(by, "root", "b.*")


#: descending similarities: a query is done when two groups reach one, since no pair unseen so far can; the last finds every shared letter
CUTOFFS = (0.55, 0.3, 1e-6)


def two_best(sources: DataFrame, named: DataFrame, by: str, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """``(by, root, score, value, text, r)``: the two best groups of each query over all aliases, by rounds of falling cutoffs."""
    vocabulary = materialise(named.where("alias is not null").select("alias").distinct(), "aliases")
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("value"))
    left, found = sources, []
    for cutoff in cutoffs:
        texts = materialise(left.select("text").distinct(), "texts")
        best = materialise(_best_groups(left, named, similar_texts(texts, vocabulary, cutoff), by), "best")
        two = best.withColumn("r", F.row_number().over(order)).where("r <= 2")
        if cutoff == cutoffs[-1]:
            found.append(two)
            break
        done = materialise(best.where(F.col("score") >= cutoff).groupBy(by).count().where("count > 1").select(by), "done")
        found.append(two.join(done, by, "left_semi"))
        left = materialise(left.join(done, by, "left_anti"), "left")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def resolve(lines: DataFrame, values: DataFrame, by: str = "query_id", hard: float = 0.86, margin: float = 0.08) -> DataFrame:
    """One row per query with lines: best and second producer, scores, and whether the match is hard.

    ``lines(by, position, text, score)`` meets ``values(value)``; texts and
    aliases meet through an index, at falling cutoffs until both best groups
    of a query are known. Ties go to the greater value.
    """
    sources = materialise(line_sources(lines, by), "sources")
    named = materialise(spelling_groups(values).join(alias_table(values), "value", "left"), "named")
    two = two_best(sources, named, by)
    rows = two.groupBy(by).agg(*(F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}_{r}") for r in (1, 2) for c in ("score", "value", "text", "root")))
    gap = F.col("score_1") - F.coalesce("score_2", F.lit(0.0))
    mode = F.when(((F.col("score_1") >= 0.82) & (gap >= 0.15)) | ((F.col("score_1") >= hard) & (gap >= margin)), "hard").otherwise("none")
    spelled = named.select("root", "value").distinct().groupBy("root").agg(F.sort_array(F.collect_set("value")).alias("spellings"))
    out = rows.withColumns({"mode": mode, "margin": gap}).join(spelled, F.col("root_1") == F.col("root"), "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(by, F.when(F.col("mode") == "hard", F.col("value_1")).alias("value"), F.col("score_1").alias("score"), F.col("value_2").alias("runner_up"), F.coalesce("score_2", F.lit(0.0)).alias("runner_score"), "margin", "mode", F.col("text_1").alias("matched_text"), F.when(F.col("mode") == "hard", F.col("spellings")).otherwise(none).alias("values"))
