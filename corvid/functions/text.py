"""Text normalisation and string similarity.

``normalized`` is the SQL form (exact for text without compatibility
characters or special case folding); ``normalized_exact`` follows Unicode
NFKC and case folding in an Arrow UDF.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Transliteration of Cyrillic letters, applied after NFKD has
# taken the marks off (so the first letters of й and ё arrive as и and е).
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Words that name the kind of a producer, not the producer.
GENERIC_TOKENS = ["chateau", "estate", "hozyaystvo", "pomeste", "usadba", "vineyard", "vineyards", "vino", "vinodelnya", "winery", "wine", "wines", "zmv"]
# Places that are no producer when they stand alone.
AMBIGUOUS_TOKENS = ["dagestan", "don", "krym", "kuban", "samara"]
# Latin letters read for Cyrillic ones of the same shape.
HOMOGLYPHS = {"c": "s", "h": "n", "p": "r", "x": "h", "y": "u"}

_WORD = re.compile("[0-9a-zа-яё]+", re.IGNORECASE)


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def present(value: Column) -> Column:
    """Not null and, for a string, not blank."""
    return value.isNotNull() & (F.regexp_replace(value.cast("string"), r"(?U)\s+", "") != "")


def present_items(value: Column) -> Column:
    return value.isNotNull() & (F.size(value) > 0)


def normalized(text: Column) -> Column:
    lowered = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.array_join(F.regexp_extract_all(lowered, F.lit("[0-9a-zа-я]+"), F.lit(0)), " ")


def normalize_text(value: str | None) -> str:
    folded = unicodedata.normalize("NFKC", value or "").casefold().replace("ё", "е")
    return " ".join(_WORD.findall(folded))


@F.arrow_udf(T.StringType())
def normalized_exact(text: pa.Array) -> pa.Array:
    return pa.array([normalize_text(x) for x in text.to_pylist()], pa.string())


def tokens_of(normal: Column) -> Column:
    """Words of at least two characters of a normalised text."""
    return F.filter(F.split(normal, " "), lambda x: F.length(x) >= 2)


def tokens(text: Column) -> Column:
    return tokens_of(normalized(text))


def metadata_text(*fields: Column, items: Column | None = None) -> Column:
    parts = [f.cast("string") for f in fields] + ([F.array_join(items, " ")] if items is not None else [])
    return normalized(F.concat_ws(" ", *parts))


def fuzzy_key(normal: Column) -> Column:
    """Latin key of a normalised text: й and ё lose their marks, then letters are spelled."""
    out = F.translate(normal, "йё", "ие")
    for letter, latin in CYRILLIC_TO_LATIN.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    silent = "".join(k for k, v in CYRILLIC_TO_LATIN.items() if not v)
    out = F.translate(out, "".join(single) + silent, "".join(single.values()))
    return collapse(out)


@F.arrow_udf(T.StringType())
def fuzzy_key_exact(text: pa.Array) -> pa.Array:
    """``fuzzy_key`` of the normalised text in one function, for SQL."""
    letters = {ord(k): v for k, v in CYRILLIC_TO_LATIN.items()} | {ord("й"): "i", ord("ё"): "e"}
    return pa.array([" ".join(normalize_text(x).translate(letters).split()) for x in text.to_pylist()], pa.string())


def homoglyph_key(key: Column) -> Column:
    """The key with look-alike letters replaced in words of six letters or more."""
    swap = lambda t: F.when(F.length(t) >= 6, F.translate(t, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))).otherwise(t)
    return F.array_join(F.transform(F.split(key, " "), swap), " ")


def source_keys(normal: Column) -> Column:
    key = fuzzy_key(normal)
    return F.filter(F.array_distinct(F.array(key, homoglyph_key(key))), lambda x: x != "")


def aliases(normal: Column) -> Column:
    """Keys by which a producer may be read, longest first."""
    key = fuzzy_key(normal)
    meaningful = F.array_join(F.array_distinct(F.filter(F.split(key, " "), lambda t: ~t.isin(GENERIC_TOKENS))), " ")
    usable = lambda a: (F.length(F.replace(a, F.lit(" "), F.lit(""))) >= 4) & ~a.isin(AMBIGUOUS_TOKENS)
    kept = F.filter(F.array_distinct(F.array(key, meaningful)), usable)
    return F.transform(F.reverse(F.array_sort(F.transform(kept, lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))), lambda s: s["a"])


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def prefix_similarity(a: Column, b: Column) -> Column:
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ratio = F.length(short) / F.length(long)
    barred = a.contains(" ") | b.contains(" ") | short.isin(GENERIC_TOKENS) | (F.length(short) < 6) | ~long.startswith(short) | (ratio < 0.58)
    return F.when(barred, 0.0).otherwise(0.94 + 0.06 * ratio)


def window_similarity(query: Column, alias: Column) -> Column:
    """Best similarity of ``alias`` to the query and to its token windows of about the alias's length."""
    q, n = F.split(query, " "), F.size(F.split(query, " "))
    size = F.size(F.split(alias, " "))
    widths = F.sequence(F.greatest(F.lit(1), size - 1), F.greatest(F.least(n, size + 1), F.greatest(F.lit(1), size - 1)))
    texts = F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.array_join(F.slice(q, i, w), " "))))
    best = F.array_max(F.transform(F.concat(F.array(query), texts), lambda t: F.greatest(edit_similarity(t, alias), prefix_similarity(t, alias))))
    return F.when(F.concat(F.lit(" "), query, F.lit(" ")).contains(F.concat(F.lit(" "), alias, F.lit(" "))), 1.0).otherwise(best)


def overlap_coefficient(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))


def plain_text(markup: Column) -> Column:
    """Tags as spaces, the common entities decoded, white space collapsed."""
    text = F.regexp_replace(markup, "<[^>]+>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return collapse(text)


@F.arrow_udf(T.StringType())
def unescaped(text: pa.Array) -> pa.Array:
    """All HTML entities decoded."""
    return pa.array([None if x is None else html.unescape(x) for x in text.to_pylist()], pa.string())


def vlm_lines(answer: Column) -> Column:
    """Lines of a model's answer: end marks and list marks off, short and repeated ones dropped, score one."""
    raw = F.split(F.replace(answer, F.lit("<|endoftext|>"), F.lit("")), "\n")
    clean = F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"^[\s#>*\-•`]+", "")))
    lines = F.transform(F.filter(clean, lambda x: F.length(x) >= 2), lambda x: F.struct(x.alias("text"), normalized(x).alias("normalized"), F.lit(1.0).alias("score")))
    kept = F.filter(lines, lambda x: x["normalized"] != "")
    seen = lambda a, x: F.when(F.exists(a, lambda y: y["normalized"] == x["normalized"]), a).otherwise(F.array_append(a, x))
    return F.aggregate(kept, F.slice(kept, 1, 0), seen)


def plain_tokens(text: Column) -> Column:
    """The simple normaliser without folding: ё stays, everything else is a space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-zа-яё]+", " "))


def safe_filename(index: Column, slug: Column, digest: Column, variant: Column) -> Column:
    return F.concat(F.lpad(index.cast("string"), 4, "0"), F.lit("-"), F.rtrim(F.substring(slug, 1, 42), F.lit("-")), F.lit("-"), F.substring(F.sha2(digest, 256), 1, 10), F.lit("-v"), F.lpad(variant.cast("string"), 2, "0"), F.lit(".jpg"))


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def percent(value: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit(" %")), F.lit("—"))
