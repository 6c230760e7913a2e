"""Personal data: base spans and information-theoretic sanitisation, in DataFrame functions only.

Base spans (emails, addresses, cards, phones) are found by regular
expressions; each value is a protected entity. Over whole documents the corpus
tells how strongly a term (a run of letters and digits, A-Z lowered) reveals
an entity: of n_t distinct texts with the term, n_et hold the entity too, and
p(e | t) is taken at the lower end of its Wilson interval (one-sided, ``z``
standard errors), so that a coincidence of one or two texts proves nothing
while a steady companion does. A term discloses the entity if that bound is
above ``majority`` and gives at least ``threshold`` of the entity's own
information -log p(e). Copies of a text are one observation.

A disclosing term is generalised to its class (number, code or word) if the
class itself does not disclose the entity, else removed, and that wherever the
term stands, also in documents without the entity.

What cannot reach the bound is left out before anything is paired, exactly:
n_et is at most n_e, and n_t at least the term's texts among those with
personal data. Entities that stand in the same texts, and terms that do, have
the same counts, so classes of them are paired instead of them.

Defined results: a null text is empty; spans are code points, end exclusive;
of overlapping spans, the earliest and longest decides the text that replaces
both; words that overlap a base span are no terms there; distinct texts are
what is counted, however often each is repeated; rows of equal id and text get
the same spans; an empty table gives an empty result.

The regular expressions are possessive and tied to the starts of runs, which
changes no match but keeps long runs linear.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import cells_of, in_cells, table
from corvid.plans.scratch import discard, fresh, materialise

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of 13 to 19 digits; other runs would be dropped anyway
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: what every match of a kind has in it, soon looked for
SIGNS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IN_TERM = r"\p{L}\p{M}\p{N}"
#: a term of the class number (no letter) or code (letters and digits) stands in the text
_NUMBER = rf"(?<![{_IN_TERM}])\p{{N}}++(?![{_IN_TERM}])"
_CODE = r"[\p{L}\p{M}]\p{N}|\p{N}[\p{L}\p{M}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    threshold: float = 0.8
    majority: float = 0.5
    z: float = 1.645

    @property
    def least(self) -> int:
        """The fewest texts whose bound can exceed the majority; with n of n it is n / (n + z^2)."""
        return math.floor(self.majority * self.z**2 / (1 - self.majority)) + 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled; the digit sums must end in zero."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(at, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _passes(kind, span) -> Column:
    return valid(kind, span["value"])


_EMPTY = "cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"


def located(text: Column, matches: Column, pattern: Column, kind: Column) -> Column:
    """Spans of ``matches`` (all matches of ``pattern`` in ``text``): the pieces between them give the places."""
    gaps = F.split(text, pattern, -1)
    paired = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    empty = F.struct(F.lit(0).alias("at"), F.expr(_EMPTY).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(paired, empty, step, lambda a: a["out"])).otherwise(F.expr(_EMPTY))


def with_base_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` plus ``out``: base spans by kind as listed, then start."""
    names = {k: fresh(f"m_{k}", docs.columns) for k in KINDS}
    sign = lambda k: F.contains(F.col(text), F.lit(SIGNS[k])) if len(SIGNS[k]) == 1 else F.col(text).rlike(SIGNS[k])
    none = F.expr("cast(array() as array<string>)")
    found = docs.withColumns({names[k]: F.when(sign(k), F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    kinds = [F.filter(located(F.col(text), F.col(names[k]), F.lit(PATTERNS[k]), F.lit(k)), partial(_passes, k)) for k in KINDS]
    return found.withColumn(out, F.concat(*kinds)).drop(*names.values())


def entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.xxhash64(span["kind"], value)


def term_class(term: Column) -> Column:
    return F.when(~term.rlike(r"\p{N}"), "word").when(term.rlike(r"[\p{L}\p{M}]"), "code").otherwise("number")


def lowered(text: Column) -> Column:
    """A-Z lowered, every code point in its place."""
    return F.translate(text, _UPPER, _LOWER)


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lowered(text), rf"[^{_IN_TERM}]++"), lambda w: w != ""))


def any_of(terms: Column) -> Column:
    """A pattern of whole terms; they are letters, marks and numbers only."""
    return F.concat(F.lit(rf"(?<![{_IN_TERM}])(?:"), F.array_join(terms, "|"), F.lit(rf")(?![{_IN_TERM}])"))


def replaced(text: Column, spans: Column, mark) -> Column:
    """``text`` with ``spans`` (start, back = -end, kind; in order) replaced by their mark."""

    def step(a: Column, v: Column) -> Column:
        piece = F.concat(F.substr(text, a["at"] + 1, F.greatest(v["start"] - a["at"], F.lit(0))), mark(v))
        return F.struct(F.greatest(a["at"], -v["back"]).alias("at"), F.when(v["start"] >= a["at"], F.array_append(a["out"], piece)).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text) + 1)))


def in_order(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda v: F.struct(v["start"].alias("start"), (-v["end"]).alias("back"), v["kind"].alias("kind"))))


@dataclass(frozen=True)
class Findings:
    """base: a row per document row; extra: spans that the method adds, by (row key, text key)."""

    base: DataFrame
    extra: DataFrame


def surely(n_et: Column, n_t: Column, s: Settings) -> Column:
    """Lower end of the Wilson interval of n_et / n_t. Counts become doubles first: a literal is 32 bits wide and its square overflows."""
    n_et, n_t = n_et.cast("double"), n_t.cast("double")
    z2, share = s.z**2, n_et / n_t
    return (share + z2 / (2 * n_t) - s.z * F.sqrt(share * (1 - share) / n_t + z2 / (4 * n_t * n_t))) / (1 + z2 / n_t)


def discloses(n_et: Column, n_t: Column, n_e: Column, n: int, s: Settings) -> Column:
    share, given = n_e / n, surely(n_et, n_t, s)
    return (share < 1) & (given > s.majority) & (F.log(given / share) >= s.threshold * -F.log(share))


def _same_texts() -> list[Column]:
    """128 bits of a set of texts: rows that stand in the same texts get the same two numbers."""
    return [F.bit_xor(F.xxhash64("text_key", F.lit(i))).alias(f"set{i}") for i in range(2)]


def analyse(docs: DataFrame, s: Settings = Settings()) -> Findings:
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    spanned = with_base_spans(slim, "text", "spans")
    hidden = replaced(F.col("text"), in_order(F.col("spans")), lambda _: F.lit("\ue000"))
    # a word that overlaps a span has the hidden mark in it, next to letters or alone
    masked = F.regexp_replace(hidden, rf"[{_IN_TERM}]*+\ue000[{_IN_TERM}\ue000]*+", " ")
    personal = F.size("spans") > 0
    base = materialise(
        spanned.select(
            "doc_id", "text_key", F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
            F.when(personal, F.array_distinct(F.transform("spans", entity))).alias("entities"), F.when(personal, terms_of(masked)).alias("terms"),
            F.col("text").rlike(_NUMBER).alias("number"), F.col("text").rlike(_CODE).alias("code"),
        ),
        "spans",
    )
    totals = base.select("text_key", "number", "code").distinct().agg(F.count("*").alias("n"), F.count_if("number").alias("number"), F.count_if("code").alias("code")).first()
    n = max(1, totals.n)
    found = _disclosing(slim, base.where("entities is not null").select("text_key", "entities", "terms"), totals, n, s)
    at = _places(slim.select("doc_id", "text_key", lowered(F.col("text")).alias("text")).join(found, "text_key"), F.map_keys("kinds"))
    extra = at.select("doc_id", "text_key", F.expr("kinds[at.value]").alias("kind"), "at.start", "at.end")
    grouped = extra.distinct().groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("extra"))
    out = Findings(base.select("doc_id", "text_key", "spans"), materialise(grouped, "extra"))
    discard(found)
    return out


def _disclosing(slim: DataFrame, personal: DataFrame, totals: Row, n: int, s: Settings) -> DataFrame:
    """``(text_key, kinds)``: every text with disclosing terms and what becomes of each; ``personal`` are the texts with base spans."""
    held = materialise(personal.dropDuplicates(["text_key"]), "held")
    has = lambda kind: F.exists("terms", lambda t: term_class(t) == kind)
    entities = held.select("text_key", has("number").alias("number"), has("code").alias("code"), F.explode("entities").alias("entity"))
    known = entities.groupBy("entity").agg(F.count("*").alias("n_e"), F.count_if("number").alias("e_number"), F.count_if("code").alias("e_code"), *_same_texts()).where(F.col("n_e") >= s.least)
    known = materialise(known.withColumnsRenamed({f"set{i}": f"e{i}" for i in range(2)}), "entities")
    terms = held.select("text_key", F.explode("terms").alias("term"))
    near = terms.groupBy("term").agg(F.count("*").alias("h_t"), *_same_texts()).where(F.col("h_t") >= s.least)
    near = materialise(near.withColumnsRenamed({f"set{i}": f"t{i}" for i in range(2)}), "terms")
    of_text = entities.join(known, "entity").select("text_key", "e0", "e1", "n_e", "e_number", "e_code").distinct()
    with_term = terms.join(near, "term").select("text_key", "t0", "t1", "h_t").distinct()
    # more than half of a term's texts have the entity, so its texts are fewer than n_e over the majority
    pairs = of_text.join(with_term, "text_key").where(F.col("h_t") * s.majority < F.col("n_e"))
    pairs = pairs.groupBy("e0", "e1", "t0", "t1", "h_t").agg(F.count("*").alias("n_et"), *(F.max(c).alias(c) for c in ("n_e", "e_number", "e_code")))
    able = materialise(pairs.where(discloses(F.col("n_et"), F.col("h_t"), F.col("n_e"), n, s)).join(near.drop("h_t"), ["t0", "t1"]).select("term", "n_et", "n_e", "e_number", "e_code").distinct(), "able")
    cells = cells_of(able, "term")
    words = slim.select("text_key", F.explode(F.split(lowered(F.col("text")), rf"[^{_IN_TERM}]++")).alias("term"))
    hits = materialise(words.where((F.col("term") != "") & in_cells(F.col("term"), cells)).distinct() if any(cells) else terms.where("false"), "hits")
    pairs = able.join(hits.groupBy("term").agg(F.count("*").alias("n_t")), "term").where(discloses(F.col("n_et"), F.col("n_t"), F.col("n_e"), n, s))
    kind = term_class(F.col("term"))
    of_class = F.when(kind == "number", discloses(F.col("e_number"), F.lit(totals.number), F.col("n_e"), n, s)).when(kind == "code", discloses(F.col("e_code"), F.lit(totals.code), F.col("n_e"), n, s)).otherwise(False)
    fate = F.when(of_class, F.lit("removed")).otherwise(kind)
    shared = pairs.withColumn("kind", fate).groupBy("term").agg(F.when(F.max(F.col("kind") == "removed"), "removed").otherwise(F.min("kind")).alias("kind"))
    found = materialise(hits.join(shared, "term").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds")), "disclosing")
    for done in (held, known, near, able, hits):
        discard(done)
    return found


def _places(rows: DataFrame, terms: Column) -> DataFrame:
    """A row for each place ``at`` (start, end, value) at which one of ``terms`` stands in the row's text."""
    pattern = rows.withColumn("pattern", any_of(terms))
    matched = pattern.withColumn("matches", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    return matched.withColumn("at", F.explode(located(F.col("text"), F.col("matches"), F.col("pattern"), F.lit("term"))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda span: span["kind"] == kind


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyse(table(spark, sf_dir, "documents"))
    extra = found.extra.select(F.col("doc_id").alias("x_doc"), F.col("text_key").alias("x_key"), "extra")
    rows = found.base.join(extra, found.base["doc_id"].eqNullSafe(extra["x_doc"]) & (found.base["text_key"] == extra["x_key"]), "left")
    base, counts = _listed(F.col("spans")), {k: F.size(F.filter("spans", _of(k))).cast("long") for k in KINDS}
    return rows.select("doc_id", *(c.alias(f"n_{k}") for k, c in counts.items()), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(_listed(F.col("extra")), F.lit(""))).alias("spans"))


def sanitise(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with base spans replaced by their kind and disclosing terms generalised or removed; n_chars follows the text."""
    found = analyse(docs, s)
    all_spans = found.base.where(F.size("spans") > 0).unionByName(found.extra.withColumnRenamed("extra", "spans"))
    all_spans = materialise(all_spans.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans")), "all")
    names = {c: fresh(c, docs.columns) for c in ("x_doc", "x_key", "spans")}
    marks = all_spans.withColumnsRenamed({"doc_id": names["x_doc"], "text_key": names["x_key"], "spans": names["spans"]})
    plain, spans = F.coalesce("text", F.lit("")), F.col(names["spans"])
    rows = docs.join(marks, docs["doc_id"].eqNullSafe(marks[names["x_doc"]]) & (F.xxhash64(plain) == marks[names["x_key"]]), "left")
    mark = lambda v: F.when(v["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), v["kind"], F.lit("]")))
    new = fresh("clean", rows.columns)
    rows = rows.withColumn(new, F.when(F.size(spans) > 0, replaced(plain, in_order(spans), mark)).otherwise(F.col("text")))
    size = F.when(F.size(spans) > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return rows.select(*(F.col(new).alias("text") if c == "text" else size.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))
