"""The indexed lookup held against every text with every alias."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvid.functions.text import window_similarity
from corvid.operators import taxonomy


def every_pair(texts, vocabulary):
    return texts.crossJoin(vocabulary).withColumn("similarity", window_similarity(F.col("text"), F.col("alias"))).where("similarity > 0")


def noisy(rng, word):
    w = list(word)
    for _ in range(rng.randrange(3)):
        k = rng.randrange(len(w) + 1)
        w[k : k + rng.randrange(2)] = rng.choice(["", *"abeioгд "])
    return "".join(w)


def makers(rng):
    part = ["north", "harbour", "silver", "lantern", "old", "mill", "виноградник", "долина", "stone", "rivermouth", "estate"]
    return sorted({" ".join(rng.sample(part, rng.randrange(1, 4))) + rng.choice(["", " x", "s"]) for _ in range(25)})


@pytest.mark.parametrize("cutoff", [0.55, 0.3, 1e-6])
def test_similar_texts(spark, cutoff):
    rng = random.Random(1)
    aliases = [m for m in makers(rng) if len(m) >= 4]
    texts = sorted({*(noisy(rng, " ".join(rng.sample(aliases, rng.randrange(1, 3)))).strip() for _ in range(30)), "a", "harbo", "harbourside walk", "q"} - {""})
    texts = spark.createDataFrame([(" ".join(t.split()),) for t in texts if t.split()], "text string").distinct()
    vocabulary = spark.createDataFrame([(a,) for a in aliases], "alias string")
    got = {(r.text, r.alias): round(r.similarity, 12) for r in taxonomy.similar_texts(texts, vocabulary, cutoff).collect()}
    assert got == {(r.text, r.alias): round(r.similarity, 12) for r in every_pair(texts, vocabulary).where(F.col("similarity") >= cutoff).collect()} and got


@pytest.mark.parametrize("seed", [1, 2])
def test_two_best(spark, seed):
    rng = random.Random(seed)
    values = makers(rng)
    lines = [(q, p, noisy(rng, rng.choice([*values, "zzzz", "completely other words"])), rng.choice([None, 0.3, 0.9, 1.4])) for q in range(14) for p in range(rng.randrange(1, 4))] + [(90, 0, "-", 0.5), (91, 0, None, 0.5), (92, 0, "jjjj", 1.0)]
    sources = taxonomy.line_sources(spark.createDataFrame(lines, "query_id int, position int, text string, score double"))
    catalog = spark.createDataFrame([(v,) for v in [*values, None, " "]], "value string")
    named = taxonomy.materialise(taxonomy.spelling_groups(catalog).join(taxonomy.alias_table(catalog), "value", "left"), "named")
    whole = every_pair(sources.select("text").distinct(), named.where("alias is not null").select("alias").distinct())
    best = taxonomy._best_groups(sources, named, whole, "query_id")
    want = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("value")))).where("r <= 2")
    plain = lambda df: sorted((r.query_id, r.r, r.root, r.value, r.text, round(r.score, 12)) for r in df.collect())
    assert plain(taxonomy.two_best(sources, named, "query_id")) == plain(want) and want.count() > 20


def test_one_maker_and_none(spark):
    lines = spark.createDataFrame([(1, 0, "silver lantern", 0.9), (2, 0, "other", 0.9)], "query_id int, position int, text string, score double")
    got = {r.query_id: r for r in taxonomy.resolve(lines, spark.createDataFrame([("Silver Lantern",)], "value string")).collect()}
    assert got[1]["mode"] == "hard" and got[1].runner_up is None and got[2]["mode"] == "none"
    assert taxonomy.resolve(lines, spark.createDataFrame([], "value string")).count() == 0
