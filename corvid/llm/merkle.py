"""Merkle manifest of a table: a leaf for each row, trees per group, one root.

Levels are DataFrames. Rows are numbered within their group (``row_number``
inside ranges of the order, plus the rows of the ranges before), every
``fanout`` consecutive nodes become one parent by the index divided by the
fanout, and parents keep their sorted children. From the root down, each
level is joined to the paths of its parents and every child appends its
siblings, so a join handles a level's parents and never all leaves at every
level. The groups' subroots form a tree of their own.

Defined results: null columns are ``-`` in a leaf; a null group is a group of
its own, before all others; null keys come first in their group; rows with
equal keys follow each other by leaf, so repeated rows have equal leaves and
neighbouring places; a group of one row has its leaf as subroot and a table of
one group has its subroot as root; an empty table gives an empty manifest.
Columns that are not named in ``columns`` are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.llm.common import table
from corvid.plans.scratch import materialise

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left string, right string>>"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(encoded, values)))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` plus ``idx`` (from 0 within ``tree``, by ``order``) and ``n`` (the tree's rows).

    Ranges of the whole order are numbered each by itself; what meets in one
    place is a count per range and tree.
    """
    tie = F.monotonically_increasing_id()  # splits even rows that are equal in the whole order
    ranges = rows.repartitionByRange("tree", *order, tie).withColumn("part", F.spark_partition_id())
    placed = materialise(ranges, "ranges")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("tree")
    upto = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("tree", "part", F.coalesce(upto, F.lit(0)).alias("before"), F.sum("c").over(whole).alias("n"))
    own = placed.withColumn("k", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)))
    return own.join(offsets, ["tree", "part"]).select(*rows.columns, (F.col("before") + F.col("k") - 1).alias("idx"), "n")


def parents_of(nodes: DataFrame, fanout: int) -> DataFrame:
    """``(tree, idx, n, h, children)`` one level above ``nodes(tree, idx, n, h, payload)``; single nodes have none."""
    runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("parent"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "h", "payload"))).alias("run"))
    return runs.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), digest(F.array_join("run.h", "")).alias("h"), F.transform("run", lambda c: F.struct(c["h"], c["payload"])).alias("children"))


def build(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents over ``leaves(tree, idx, n, h, payload)``, lowest first, and every tree's top ``(tree, level, h, payload)``."""
    none = F.lit(None).cast(leaves.schema["payload"].dataType).alias("payload")
    top = lambda nodes, level: nodes.where("n = 1").select("tree", F.lit(level).alias("level"), "h", "payload")
    nodes, levels, tops = leaves, [], [top(leaves, 0)]
    largest = leaves.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    while largest > 1:
        levels.append(materialise(parents_of(nodes, fanout), f"level-{len(levels)}"))
        nodes = levels[-1].select("tree", "idx", "n", "h", none)
        tops.append(top(nodes, len(levels)))
        largest = -(-largest // fanout)
    return levels, materialise(reduce(DataFrame.unionByName, tops), "tops")


def paths(levels: list[DataFrame], tops: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """``(h, payload, path, *carried)`` of every leaf, from ``tops(tree, level, h, payload, path, *carried)`` down."""
    keep = ["tree", "idx", "path", *carried]
    below = None
    for level in range(len(levels), 0, -1):
        here = tops.where(F.col("level") == level).withColumn("idx", F.lit(0).cast("long")).select(*keep)
        here = here if below is None else here.unionByName(below.select(*keep))
        met = levels[level - 1].select("tree", "idx", "children").join(here, ["tree", "idx"])
        each = met.select("tree", "idx", "children", F.posexplode("children").alias("at", "child"), "path", *carried)
        hashes = lambda first, size: F.array_join(F.slice("children", first, size)["h"], "")
        step = F.struct(hashes(F.lit(1), F.col("at")).alias("left"), hashes(F.col("at") + 2, F.lit(fanout)).alias("right"))
        below = each.select("tree", (F.col("idx") * fanout + F.col("at")).alias("idx"), "child.h", "child.payload", F.concat(F.array(step), "path").alias("path"), *carried)
    lone = tops.where("level = 0").select("h", "payload", "path", *carried)
    return lone if below is None else below.select("h", "payload", "path", *carried).unionByName(lone)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", fanout: int = FANOUT, **also: Column) -> DataFrame:
    """``(key, group, *also, leaf, subroot, root, path)``, a row for each of ``docs``.

    ``path`` has the leaf's siblings at each level up to the root, as hex
    digests to its left and right; ``fold(leaf, path)`` is the root.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    payload = F.struct(F.col(key).alias("key"), F.col(group).alias("group"), *(c.alias(name) for name, c in also.items()))
    rows = materialise(docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf(*map(F.col, columns)).alias("h"), payload.alias("payload")), "leaves")
    leaves = materialise(numbered(rows, "key", "h").drop("key"), "numbered")
    levels, tops = build(leaves, fanout)

    named = tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "h")
    second = materialise(numbered(named, "of").select("tree", "idx", "n", "h", F.struct("of").alias("payload")), "subroots")
    upper, root = build(second, fanout)
    start = root.withColumn("path", F.array().cast(PATH)).withColumn("root", F.col("h"))
    down = paths(upper, start, fanout, ["root"]).select(F.col("payload.of").alias("tree"), F.col("h").alias("subroot"), "path", "root")

    begun = tops.join(materialise(down, "root-paths"), "tree")
    out = paths(levels, begun, fanout, ["subroot", "root"])
    return out.select(F.col("payload.key").alias(key), F.col("payload.group").alias(group), *(F.col(f"payload.{name}").alias(name) for name in also), F.col("h").alias("leaf"), "subroot", "root", "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = leaf(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS))
    listed = manifest(table(spark, sf_dir, "documents"), altered=F.when(chosen, lowered))
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    out = listed.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: the CRC-32 of an id's digits is written out, since SQL has no function for it
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, text, concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
    list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0
      THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM d),
nodes(lvl, g, i, n, h) AS (
  SELECT 0, g, i, n, leaf FROM leaves
  UNION ALL
  SELECT any_value(lvl) + 1, g, i // 8, CAST(ceil(any_value(n) / 8) AS BIGINT), sha256(string_agg(h, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY g, i // 8),
subs AS (
  SELECT g, lvl, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers(lvl, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subs
  UNION ALL
  SELECT any_value(lvl) + 1, i // 8, CAST(ceil(any_value(n) / 8) AS BIGINT), sha256(string_agg(h, '' ORDER BY i))
  FROM uppers WHERE n > 1 GROUP BY i // 8),
runs AS (SELECT lvl, g, i // 8 AS p, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT lvl, i // 8 AS p, list(h ORDER BY i) AS hs FROM uppers WHERE n > 1 GROUP BY ALL),
walk(doc_id, leaf, g, lvl, i, proof, folded) AS (
  SELECT doc_id, leaf, g, 0, i, '', coalesce(altered, leaf) FROM leaves
  UNION ALL
  SELECT doc_id, leaf, w.g, w.lvl + 1, w.i // 8, proof || array_to_string(hs[1:w.i % 8] || hs[w.i % 8 + 2:], ''),
    sha256(array_to_string(hs[1:w.i % 8] || [folded] || hs[w.i % 8 + 2:], ''))
  FROM walk w JOIN runs r ON r.lvl = w.lvl AND r.g = w.g AND r.p = w.i // 8),
upper_walk(doc_id, leaf, subroot, lvl, i, proof, folded) AS (
  SELECT doc_id, leaf, subroot, 0, s.i, proof, folded FROM walk w JOIN subs s ON s.g = w.g AND s.lvl = w.lvl
  UNION ALL
  SELECT doc_id, leaf, subroot, w.lvl + 1, w.i // 8, proof || array_to_string(hs[1:w.i % 8] || hs[w.i % 8 + 2:], ''),
    sha256(array_to_string(hs[1:w.i % 8] || [folded] || hs[w.i % 8 + 2:], ''))
  FROM upper_walk w JOIN upper_runs r ON r.lvl = w.lvl AND r.p = w.i // 8)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM upper_walk w JOIN uppers u ON u.n = 1 AND u.lvl = w.lvl
"""
