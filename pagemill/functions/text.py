"""Scalar text functions as columns. Regular expressions carry (?U), so that \\s, \\d, \\w and \\b know Unicode."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Which characters count as Japanese, which punctuation as its, and which acronyms are known.
JAPANESE = r"぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
JAPANESE_PUNCTUATION = "、。，．・：；！？「」『』（）［］【】〈〉《》〔〕｛｝"
JAPANESE_OR_PUNCTUATION = JAPANESE + JAPANESE_PUNCTUATION.replace("[", r"\[").replace("]", r"\]")
PAGE_NUMBER = r"(?U)^[\s\-–—―]*\d+[\s\-–—―]*\z"
KNOWN_ACRONYMS = ("AI", "API", "DB", "FAQ", "LLM", "OCR", "QA", "RAG", "SQL", "URL")
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_script(c: Column | str, pattern: str, replacement: str) -> Column:
    """regexp_replace, with Unicode classes only for texts that aren't ASCII alone: they cost ten times as much a character.
    White space, digits and letters of ASCII are the same in both."""
    c = col(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(c, f"(?U){pattern}", replacement)).otherwise(F.regexp_replace(c, pattern, replacement))


def strip(c: Column | str) -> Column:
    """Without white space at both ends, of any script."""
    return by_script(c, r"^\s+|\s+\z", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(by_script(c, r"\s+", " "))


def visible(c: Column | str) -> Column:
    """Without white space."""
    c = col(c)
    # Printable ASCII has blanks alone, and replacing one string is ten times as fast as translating characters.
    odd = F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(c, r"(?U)\s", "")).otherwise(F.translate(c, " \t\n\x0b\f\r", ""))
    return F.when(c.rlike(r"[^\x20-\x7E]"), odd).otherwise(F.replace(c, F.lit(" "), F.lit("")))


def is_page_number(c: Column | str) -> Column:
    return col(c).rlike(PAGE_NUMBER)


def collapse_japanese_spaces(c: Column | str) -> Column:
    """Without blanks and tabs between two Japanese characters or punctuation marks."""
    return F.regexp_replace(c, f"[ \\t](?<=[{JAPANESE_OR_PUNCTUATION}][ \\t])[ \\t]*(?=[{JAPANESE_OR_PUNCTUATION}])", "")  # blanks first: they are rarer


def unify_newlines(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def lines_of(c: Column | str) -> Column:
    """A text's lines, at every Unicode line end, without an empty one after the last; no line for an empty text."""
    parts = F.split(c, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def pages_of(c: Column | str) -> Column:
    return F.split(c, "\\f")


def japanese_count(c: Column | str) -> Column:
    return F.regexp_count(c, F.lit(f"[{JAPANESE}]"))


def ascii_share(c: Column | str) -> Column:
    """Share of ASCII letters and digits among the visible characters; 0 without any."""
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit("[A-Za-z0-9]")), F.length(visible(c))), F.lit(0.0))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def cut_bytes(c: Column | str, most: int) -> Column:
    """The longest prefix of whole characters with at most so many UTF-8 bytes."""
    c = col(c)
    # A code point has one to four bytes: a prefix of `most` characters has all that can fit; the byte at which each ends
    # is a running sum, and characters stay while it is within the limit.
    chars = F.split(F.left(c, F.lit(most)), "")
    kept = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), lambda a, x: F.struct((a["n"] + F.octet_length(x)).alias("n"), F.when(a["n"] + F.octet_length(x) <= most, F.concat(a["t"], x)).otherwise(a["t"]).alias("t")))["t"]
    return F.when(F.octet_length(c) <= most, c).otherwise(kept)


def safe_filename(c: Column | str, most: int = 180, compose: bool = True) -> Column:
    """A title without characters that file names can't have, at most so many bytes long. compose: in NFKC first."""
    text = nfkc(col(c)) if compose else col(c)
    text = F.regexp_replace(text, r'[\x00-\x1f\x7f<>:"/\\|?*]', " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[ .]+|[ .]+\z", "")
    return F.regexp_replace(cut_bytes(text, most), r"[ .]+\z", "")


def page_numbers(c: Column | str) -> Column:
    """The numbers of a list like 1-3,7 as a sorted array; an error for an empty part, a non-number or a falling range."""
    text = strip(c)
    parts = F.transform(F.split(text, ","), strip)
    bad = F.exists(parts, lambda p: ~p.rlike(r"^[1-9][0-9]*(-[1-9][0-9]*)?\z"))
    bounds = F.transform(parts, lambda p: F.split(p, "-"))
    first = lambda b: b[0].cast("int")
    last = lambda b: F.element_at(b, -1).cast("int")
    falling = F.exists(bounds, lambda b: last(b) < first(b))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda b: F.sequence(first(b), last(b))))))
    return F.when(text == "", F.array().cast("array<int>")).when(bad, F.raise_error(F.concat(F.lit("not a list of pages: "), text)).cast("array<int>")).when(falling, F.raise_error(F.concat(F.lit("a range falls: "), text)).cast("array<int>")).otherwise(numbers)
