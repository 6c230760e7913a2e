"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule names a host and a beginning of a path; it fits that host and all its
subdomains. The longest fitting rule (host and path together, the longer host
on a tie, then the first listed) decides. URLs that no rule fits are judged by
their words: an automaton of all terms runs over the whole lower-cased URL,
and a hit counts where the characters on both sides are no letters or digits
(``inside`` terms count within longer words too). Strict terms weigh as much
as the limit, so one of them blocks; soft terms have smaller weights, each
distinct one counts once, and they block together when their weights reach
the limit.

Defined results: a null URL, or one without ``://``, has an empty host and
path, which no rule fits; its words are judged all the same (none for null),
and an empty table gives an empty result. Repeated rows each get a row;
other columns of the table are not read. A text of any length is scanned
whole, once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import as_bytes, table

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    """Terms are lower-case. ``inside`` names those that count within longer words too."""

    strict: frozenset[str]
    soft: dict[str, int]
    inside: frozenset[str] = frozenset()
    limit: int = 4

    def weight(self, term: str) -> int:
        return self.limit if term in self.strict else self.soft[term]


#: The production rules, in the order of a tie.
RULES = (Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"), Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/"))

#: Words of a URL that mark a page by themselves.
STRICT = """
porn porno pornos xxx xvideos hentai milf milfs camgirl camgirls blowjob handjob gangbang bukkake creampie cumshot
bdsm fetish nsfw escort escorts sexcam sexcams sexchat sexshop stripchat upskirt hardcore-sex casino-online
online-casino viagra cialis levitra kamagra warez keygen keygens cracked-software spam spam-farm linkfarm link-farm
phishing malware ransomware carding fullz
""".split()  # fmt: skip

#: Words that many harmless pages have too, with their weights.
SOFT = {
    3: "sex sexy nude nudes naked erotic erotica adult adults webcam webcams casino casinos poker slots jackpot betting torrent torrents crack cracks".split(),
    2: "dating singles hookup hookups lingerie teen teens hot amateur bet bets gambling lottery bingo pills pharmacy payday loans serial serials free-download hack hacks proxy".split(),
    1: "free win winner bonus cheap discount coupon coupons deal deals click ads popup promo prize rx pill download downloads ref referral affiliate utm_source tracking".split(),
}

#: Strict terms that no harmless word holds.
INSIDE = "porn hentai xvideos camgirl blowjob gangbang bukkake cumshot viagra cialis kamagra keygen spam-farm".split()

VOCABULARY = Vocabulary(frozenset(STRICT), {t: w for w, terms in SOFT.items() for t in terms}, frozenset(INSIDE))


def host_and_path(url: str | None) -> tuple[str, str]:
    """After the first ``://``: the host, its A-Z lower-cased, and the path up to ``?`` or ``#``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


@dataclass
class Judge:
    """Rules by host and the automaton; built once in each task."""

    rules: tuple[Rule, ...]
    vocabulary: Vocabulary
    by_host: dict[str, list[Rule]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for rule in self.rules:
            self.by_host.setdefault(rule.host, []).append(rule)
        self.automaton = ahocorasick.Automaton()
        for term in [*self.vocabulary.strict, *self.vocabulary.soft]:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest rule for the host or a domain above it."""
        best, at = None, 0
        while host:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                    best = rule
            at = host.find(".", at) + 1
            if not at:
                break
        return best

    def hits(self, url: str) -> Counter[str]:
        """How often each term stands in the URL, between boundaries."""
        text = url.encode().lower().decode()
        found: Counter[str] = Counter()
        for end, term in self.automaton.iter(text) if len(self.automaton) else ():
            before, after = text[end - len(term) : end - len(term) + 1] if end >= len(term) else "", text[end + 1 : end + 2]
            if term in self.vocabulary.inside or not (_joins(before) or _joins(after)):
                found[term] += 1
        return found

    def judge(self, url: str | None) -> tuple:
        """host, path, rule, verdict, strict terms, soft terms, their occurrences, weight."""
        host, path = host_and_path(url)
        rule, hits = self.rule(host, path), self.hits(url or "")
        strict = sorted(t for t in hits if t in self.vocabulary.strict)
        soft = sorted(t for t in hits if t not in self.vocabulary.strict)
        weight = sum(self.vocabulary.weight(t) for t in hits)
        verdict = rule.verdict if rule else BLOCK if weight >= self.vocabulary.limit else ALLOW
        return host, path, rule.text if rule else None, verdict, strict, soft, hits.total(), weight


def _joins(char: str) -> bool:
    return char.isascii() and char.isalnum()


_JUDGED = [("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict", pa.list_(pa.string())), ("soft", pa.list_(pa.string())), ("n_hits", pa.int64()), ("weight", pa.int64())]


def judge_batches(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    judge = Judge(rules, vocabulary)
    for batch in batches:
        rows = [judge.judge(url.decode("utf-8", "replace")) for url in as_bytes(batch.column(1))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_JUDGED)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _JUDGED, strict=True))], names=["id", *(n for n, _ in _JUDGED)])


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = VOCABULARY, key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, host, path, rule, verdict, strict, soft, n_hits, weight)``, a row for each of ``pages``.

    Rules and vocabulary travel with the tasks: they are lists that people
    write, not tables that grow with the pages. Nothing is shuffled.
    """
    slim = pages.select(pages[key].alias("id"), pages[url].cast("string").alias("url"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, host string, path string, rule string, verdict string, strict array<string>, soft array<string>, n_hits long, weight long"
    return slim.mapInArrow(partial(judge_batches, rules=rules, vocabulary=vocabulary), schema).withColumnRenamed("id", key)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"))
    return judged.selectExpr("page_id", "host", "path", "rule", "verdict", "array_join(strict, ',') AS strict_terms", "array_join(soft, ',') AS soft_terms", "weight")


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(repr, r))})" for r in rows)


ORACLE = f"""
WITH p AS (
  SELECT page_id, url, coalesce(regexp_extract(url, '^.*?://([^#]*)', 1, 's'), '') AS rest, coalesce(contains(url, '://'), false) AS has FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(k, verdict, host, path) AS (VALUES {_values([(k, r.verdict, r.host, r.path) for k, r in enumerate(RULES)])}),
best AS (
  SELECT page_id, url, p.host, p.path, arg_max((r.host || r.path, r.verdict), (length(r.host || r.path), length(r.host), -k)) AS r
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL),
terms(term, strict, weight, inside) AS (VALUES {_values([(t, int(t in VOCABULARY.strict), VOCABULARY.weight(t), int(t in VOCABULARY.inside)) for t in sorted({*VOCABULARY.strict, *VOCABULARY.soft})])}),
hits AS (
  SELECT page_id, string_agg(term, ',' ORDER BY term) FILTER (strict = 1) AS strict_terms, string_agg(term, ',' ORDER BY term) FILTER (strict = 0) AS soft_terms, sum(weight) AS weight
  FROM pages JOIN terms ON regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    CASE WHEN inside = 1 THEN term ELSE '(^|[^a-z0-9])' || term || '($|[^a-z0-9])' END)
  GROUP BY page_id)
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN coalesce(weight, 0) >= {VOCABULARY.limit} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(strict_terms, '') AS strict_terms, coalesce(soft_terms, '') AS soft_terms, CAST(coalesce(weight, 0) AS BIGINT) AS weight
FROM best LEFT JOIN hits USING (page_id)
"""
