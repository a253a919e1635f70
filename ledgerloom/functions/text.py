"""Column functions over text: cleaning, character classes, fragments, numerals. All run in the JVM but HTML entities."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes. CJK is the class of body characters in reports; LETTERS serves other scripts.
CJK = "[一-鿿]"
LETTERS = r"[\p{L}]"

#: Names of bodies and standards that mark a fragment as proprietary.
PROPRIETARY = r"(?i)(GJB\s*\d+|ISO\s*\d+|IEC\s*\d+|IEEE\s*\d+|RFC\s*\d+|NIST|NASA|ESA|CARA|OWASP|MetaGPT|AgentDojo|SafeReview|Starlink|Starling|TRL\s*\d|SGP4|TLE|Cayley|Hanabi|ODP|MIT[- ]?LL|DLR)"
#: Glyphs of progress bars, and the replacement character.
NOISE = "[�▕█▏▎▍▌▋▊▉]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f asks for it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def without_fences(text: Column) -> Column:
    """Drops closed ``` blocks, across lines."""
    return F.regexp_replace(text, "(?s)```.*?```", "")


def decoded(content: Column) -> Column:
    """Text of a binary column: BOM dropped, line ends unified; bytes that are not UTF-8 become U+FFFD."""
    return unified(F.make_valid_utf8(content.cast("string")))


def unified(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def overlap_clean(text: Column) -> Column:
    """What overlap compares: no bracketed references, no marks of Markdown, no white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[[^\n]*?\]", ""), r"[#>*`_|]", ""), r"(?U)\s+", "")


def body_clean(text: Column) -> Column:
    """Plain text of a draft: front matter, fences, comments, images and inline code go; links keep their words; white space is squeezed."""
    steps = [
        (r"(?sm)^---\s*\n.*?^---\s*\n", ""), (r"(?s)```.*?```", ""), (r"(?s)<!--.*?-->", ""), (r"!\[.*?\]\(.*?\)", ""),
        (r"\[([^\]]+)\]\(.*?\)", "$1"), (r"(?m)^>\s?", ""), (r"`[^`]+`", ""), (r"(?U)\s+", " "),
    ]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))


def html_text(value: Column, entities: dict[str, str] | None = None) -> Column:
    """Label text: line breaks for br and closing div, p, li; other tags go; entities become characters. Only texts with an & go to Python for that, as the list of entities is its library's. Where entities are given, these alone are read, as they are spelled and one after the other (&amp; belongs last), and a null value stays null."""
    out = value if entities is not None else F.coalesce(value, F.lit(""))
    out = F.regexp_replace(out, r"(?i)<br[ \t\n\f\r]*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(div|p|li)[ \t\n\f\r]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    if entities is None:
        return unescaped(out)
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities.items(), out)


def unescaped(text: Column) -> Column:
    """Entities as characters."""

    def unescape(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(F.arrow_udf(unescape, "string")(F.when(F.contains(text, F.lit("&")), text)), text)


def class_count(text: Column, char_class: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(char_class)), F.lit(0)).cast("long")


def noise_ratio(text: Column) -> Column:
    """Share of noise characters; 0 for empty text."""
    n = F.length(text)
    return F.when(n > 0, class_count(text, NOISE) / n).otherwise(F.lit(0.0))


def fragment_kind(fragment: Column) -> Column:
    """Why a fragment may be shared: latin (over 30 % Latin letters), digits (over 30 %), term (a proprietary name), else null."""
    n = F.length(fragment)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(class_count(fragment, "[A-Za-z]") / n > 0.30, "latin")
        .when(class_count(fragment, "[0-9]") / n > 0.30, "digits")
        .when(fragment.rlike(PROPRIETARY), "term")
    )


def char_ngrams(text: Column, n: int) -> Column:
    """The set of character n-grams; empty for shorter text."""
    length = F.length(text)
    return F.when(length >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Distinct tokens: lower-case words and numbers of two characters or more, and pairs of CJK characters (a single one stands alone)."""
    words = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9_.]*|[0-9]+)"), 1), F.lower), lambda w: F.length(w) >= 2)
    cjk = F.regexp_replace(F.coalesce(text, F.lit("")), "[^一-鿿]", "")
    pairs = F.when(F.length(cjk) == 1, F.array(cjk)).otherwise(char_ngrams(cjk, 2))
    return F.array_distinct(F.concat(words, pairs))


def coverage(reference: Column, candidate: Column) -> Column:
    """Share of the reference tokens that the candidate has; 1 if there are none."""
    n = F.size(F.array_distinct(reference))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(reference, candidate)) / n)


def sentences(text: Column) -> Column:
    """Sentences that end in a full-width stop, without blank ones."""
    return F.filter(F.split(text, "[。！？]"), lambda s: F.trim(s) != "")


#: Characters that take two columns.
WIDE = "[⺀-鿿가-힣豈-﫿＀-｠￠-￦]"


def half_width_cut(text: Column, width: int) -> Column:
    """The longest head of at most so many half-width columns; CJK counts two. Only a text that is too wide is walked by characters."""
    chars = F.split(text, "")
    wide = lambda c: F.when(c.rlike(WIDE), 2).otherwise(1)
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("w"), F.lit(False).alias("done"))

    def step(acc: Column, c: Column) -> Column:
        w = acc["w"] + F.when(c == "", 0).otherwise(wide(c))
        over = acc["done"] | (w > width)
        return F.struct(F.when(over, acc["s"]).otherwise(F.concat(acc["s"], c)).alias("s"), F.when(over, acc["w"]).otherwise(w).alias("w"), over.alias("done"))

    return F.when(F.length(text) + class_count(text, WIDE) <= width, text).otherwise(F.aggregate(chars, start, step, lambda acc: acc["s"]))


#: The digits and units of Chinese numerals.
CN_DIGITS = "零一二三四五六七八九"
CN_TEN, CN_HUNDRED = "十", "百"


def chinese_numeral(n: Column) -> Column:
    """1 to 999 as a numeral; null beyond."""
    digit = lambda d: F.substr(F.lit(CN_DIGITS), d.cast("int") + 1, F.lit(1))
    h, t, u = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    hundreds = F.when(h > 0, F.concat(digit(h), F.lit(CN_HUNDRED))).otherwise("")
    tens = F.when(t > 0, F.concat(F.when((t == 1) & (h == 0), "").otherwise(digit(t)), F.lit(CN_TEN))).when((h > 0) & (u > 0), CN_DIGITS[0]).otherwise("")
    return F.when(n.between(1, 999), F.concat(hundreds, tens, F.when(u > 0, digit(u)).otherwise("")))


def from_chinese_numeral(text: Column) -> Column:
    """The number of a numeral from 1 to 999, also in digits; null if it is none."""
    pattern = f"^(?:([{CN_DIGITS}])百)?零?(?:([{CN_DIGITS}]?)(十))?([{CN_DIGITS[1:]}])?$"
    part = lambda g: F.regexp_extract(text, pattern, g)
    at = lambda g: F.when(part(g) == "", F.lit(0)).otherwise(F.call_function("locate", part(g), F.lit(CN_DIGITS)) - 1)
    tens = F.when(part(3) == "", 0).when(part(2) == "", 1).otherwise(at(2))
    n = at(1) * 100 + tens * 10 + at(4)
    return F.when(text.rlike("^[0-9]{1,3}$"), text.cast("int")).when(text.rlike(pattern) & (n > 0), n.cast("int"))


def build_date(first: Column, second: Column) -> Column:
    """YYYY-MM-DD of the first value that holds a date (2026年7月, 2026-7, 2026/07/05); a missing day is the first."""
    found = lambda c: F.regexp_extract(c, r"(\d{4})\s*[-/年.]\s*(\d{1,2})(?:\s*[-/月.]\s*(\d{1,2}))?", 0)
    one = lambda c, g: F.regexp_extract(c, r"(\d{4})\s*[-/年.]\s*(\d{1,2})(?:\s*[-/月.]\s*(\d{1,2}))?", g)
    date = lambda c: F.when(found(c) != "", F.try_to_date(F.concat_ws("-", one(c, 1), F.lpad(one(c, 2), 2, "0"), F.when(one(c, 3) == "", F.lit("01")).otherwise(F.lpad(one(c, 3), 2, "0"))), "yyyy-MM-dd"))
    return F.date_format(F.coalesce(date(first), date(second)), "yyyy-MM-dd")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def median_rank(values: Column, percent: int) -> Column:
    """The value at floor(n * percent / 100) of the sorted values, without interpolation; values: a sorted array."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, (F.least(n - 1, F.floor(n * percent / 100)) + 1).cast("int")))
