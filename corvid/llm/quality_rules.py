"""Quality rules with host-level verdicts.

``text_stats`` measures each whole text. Rules on those measures give a
failure rate per host; an empirical beta prior, fitted to the hosts' own
rates, shrinks the rates of hosts with few documents; the verdict on a host
is joined back to its documents.

Defined results: a null text has no words; a null host is one host of its
own; an empty table gives an empty result; repeated rows each get a row;
rules fail strictly above their limits, so a tie passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import SPACES, as_bytes, table
from corvid.plans.scratch import fresh, materialise

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in STATS])


@dataclass(frozen=True)
class Limits:
    """Production parameters. Rates are of documents or of words."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 20
    max_dup_line_percent: int = 50
    #: a host goes when its shrunk rate of base failures is above this
    max_host_rate: float = 0.5
    #: above this shrunk rate of a soft rule, the host's failing documents go
    max_soft_rate: float = 0.25


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = ids[:n].copy()
        for k in range(1, size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    # Equal keys are only candidates: the words themselves decide.
    seen: dict[tuple[bytes, ...], int] = {}
    starts = np.flatnonzero(again)
    for i in starts:
        w = tuple(words[i : i + size])
        seen[w] = seen.get(w, 0) + 1
    edge = np.zeros(len(words) + 1, np.int32)
    for i in starts:
        if seen[tuple(words[i : i + size])] > 1:
            edge[i] += 1
            edge[i + size] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    blank = len(text) - len(text.translate(None, SPACES))
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    return (
        len(words),
        points - blank,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.arrow_udf(STATS_TYPE)
def text_stats(text: pa.Array) -> pa.Array:
    rows = [measure(x) for x in as_bytes(text)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(STATS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(STATS))


def base_rule(limits: Limits, c=F.col) -> Column:
    return (c("n_words") < limits.min_words) | (c("n_repeat_words") * 100 > c("n_words") * limits.max_repeat_percent)


def soft_rules(limits: Limits, c=F.col) -> dict[str, Column]:
    return {
        "symbols": c("n_symbols") * 100 > c("n_words") * limits.max_symbol_percent,
        "dup_lines": c("n_dup_lines") * 20 * 100 > c("n_words") * limits.max_dup_line_percent,
    }


def beta_prior(hosts: DataFrame, failed: str, total: str = "n") -> tuple[float, float]:
    """Method of moments over the hosts' rates, weighted by their documents.

    One row of sums comes back. Where the hosts do not differ (or there is
    one), the prior keeps the pooled rate with the strength of one document.
    """
    row = hosts.agg(
        F.sum(total).alias("n"), F.sum(failed).alias("f"), F.sum(F.col(failed) * F.col(failed) / F.col(total)).alias("s2"),
        F.sum(F.col(total) * F.col(total)).cast("double").alias("n2"), F.count("*").alias("k"),
    ).first()
    if not row or not row.n:
        return 0.5, 0.5
    n, f, k = float(row.n), float(row.f), int(row.k)
    mean = (f + 0.5) / (n + 1.0)
    between = (float(row.s2) - f * f / n) - (k - 1) * mean * (1 - mean)
    scale = n - float(row.n2) / n
    variance = between / scale if k > 1 and scale > 0 else 0.0
    if not 0 < variance < mean * (1 - mean):
        return mean, 1 - mean
    strength = max(1.0, mean * (1 - mean) / variance - 1)
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, host: str, limits: Limits = Limits()) -> DataFrame:
    """One row per host: shrunk failure rates of the base rule and each soft rule.

    Counts are summed before the shuffle, so a host with a third of all
    documents costs a few rows per task.
    """
    rules = {"base": base_rule(limits), **soft_rules(limits)}
    hosts = materialise(
        measured.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
        .agg(F.count("*").alias("n"), *(F.sum(r.cast("long")).alias(f"f_{k}") for k, r in rules.items())),
        "hosts",
    )
    priors = {k: beta_prior(hosts, f"f_{k}") for k in rules}
    out = hosts.select("host", *(((F.col(f"f_{k}") + a) / (F.col("n") + a + b)).alias(f"rate_{k}") for k, (a, b) in priors.items()))
    return materialise(
        out.select("host", (F.col("rate_base") > limits.max_host_rate).alias("host_rejected"), *((F.col(f"rate_{k}") > limits.max_soft_rate).alias(f"bad_{k}") for k in soft_rules(limits)), *(f"rate_{k}" for k in rules)),
        "verdicts",
    )


def with_verdicts(measured: DataFrame, host: str, limits: Limits = Limits(), verdicts: DataFrame | None = None) -> DataFrame:
    """``measured`` (with the five measures) plus base_failed, host_rejected and kept."""
    verdicts = host_verdicts(measured, host, limits) if verdicts is None else verdicts
    joined = measured.join(verdicts, F.coalesce(measured[host].cast("string"), F.lit("")) == verdicts.host, "left").drop(verdicts.host)
    rejected = F.coalesce("host_rejected", F.lit(False))
    for k, rule in soft_rules(limits).items():
        rejected = rejected | (rule & F.coalesce(f"bad_{k}", F.lit(False)))
    return joined.withColumn("base_failed", base_rule(limits)).withColumn("kept", ~F.col("base_failed") & ~rejected)


def measured_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*keep, text_stats(F.col("text")).alias("stats")).select(*keep, "stats.*")


def keep_documents(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the documents that the rules or their host's verdict reject.

    The texts are measured twice (for the hosts' rates, then for the filter)
    rather than written or shuffled between.
    """
    s = fresh("stats", docs.columns)
    verdicts = host_verdicts(measured_texts(docs, [host]), host, limits)
    v = {c: fresh(f"v_{c}", docs.columns) for c in verdicts.columns}
    named = verdicts.select(*(F.col(c).alias(v[c]) for c in verdicts.columns))
    measured = docs.withColumn(s, text_stats(F.col("text")))
    stat = lambda c: F.col(f"{s}.{c}")
    rejected = F.coalesce(v["host_rejected"], F.lit(False))
    for k, rule in soft_rules(limits, stat).items():
        rejected = rejected | (rule & F.coalesce(v[f"bad_{k}"], F.lit(False)))
    joined = measured.join(named, F.coalesce(measured[host].cast("string"), F.lit("")) == named[v["host"]], "left")
    return joined.where(~base_rule(limits, stat) & ~rejected).select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialise(measured_texts(table(spark, sf_dir, "documents"), ["doc_id", "source"]), "measures")
    return with_verdicts(measured, "source").select("doc_id", *STATS, "base_failed", "kept", "host_rejected")


def _prior_sql(rule: str) -> str:
    """The shrunk rate of one rule per host, as ``beta_prior`` and ``host_verdicts`` have it."""
    return f"""
{rule}_sums AS (SELECT sum(n)::DOUBLE AS n, sum(f_{rule})::DOUBLE AS f, sum(f_{rule} * f_{rule} / n::DOUBLE) AS s2, sum(n * n)::DOUBLE AS n2, count(*) AS k FROM hosts),
{rule}_moments AS (SELECT *, (f + 0.5) / (n + 1.0) AS mean FROM {rule}_sums),
{rule}_spread AS (SELECT mean, CASE WHEN k > 1 AND n - n2 / n > 0 THEN ((s2 - f * f / n) - (k - 1) * mean * (1 - mean)) / (n - n2 / n) ELSE 0 END AS v FROM {rule}_moments),
{rule}_prior AS (SELECT mean, CASE WHEN v > 0 AND v < mean * (1 - mean) THEN greatest(1.0, mean * (1 - mean) / v - 1) ELSE 1.0 END AS strength FROM {rule}_spread),
{rule}_rate AS (SELECT host, (f_{rule} + mean * strength) / (n + strength) AS rate_{rule} FROM hosts, {rule}_prior)"""


ORACLE = (
    r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
wins AS (SELECT doc_id, i, w[i:i + 7] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT doc_id, k FROM wins GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM wins JOIN again USING (doc_id, k), range(0, 8) t(o) GROUP BY doc_id),
m AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
r AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base, n_symbols * 100 > n_words * 20 AS symbols, n_dup_lines * 20 * 100 > n_words * 50 AS dup_lines FROM m),
hosts AS (SELECT host, count(*) AS n, sum(base::INT) AS f_base, sum(symbols::INT) AS f_symbols, sum(dup_lines::INT) AS f_dup_lines FROM r GROUP BY host),"""
    + ",".join(_prior_sql(rule) for rule in ("base", "symbols", "dup_lines"))
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND NOT (rate_base > 0.5 OR (symbols AND rate_symbols > 0.25) OR (dup_lines AND rate_dup_lines > 0.25)) AS kept, rate_base > 0.5 AS host_rejected
FROM r JOIN base_rate USING (host) JOIN symbols_rate USING (host) JOIN dup_lines_rate USING (host)
"""
)
