"""Recognised lines: metrics, retries, noise, reading order, page text.

A line is a row (book, page, block_no, line_no, left, top, right, bottom, words, ..), its words an array of structs with text,
box and confidence. Windows are over the lines of one page; a page's lines meet in one task, books and corpora don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.numbers import rounded
from pagemill.functions.once import once
from pagemill.functions.text import JAPANESE, JAPANESE_OR_PUNCTUATION, by_script, collapse_japanese_spaces, is_page_number, strip, visible

PAGE = ["book", "page"]
# Characters that mean something, and punctuation that is no noise.
MEANINGFUL = f"A-Za-z0-9{JAPANESE}"
SAFE = JAPANESE_OR_PUNCTUATION.replace(JAPANESE, "") + r".,:;!?()\[\]{}<>+\-/%&@#'\""
ASCII_FINE = "".join(chr(c) for c in range(33, 127) if chr(c).isalnum() or chr(c) in ".,:;!?()[]{}<>+-/%&@#'\"")
ASCII_ODD = r"[^A-Za-z0-9.,:;!?()\[\]{}<>+\-/%&@#'\"]"
RETRY_CONFIDENCE, RETRY_SUSPICION, RETRY_LINES, RETRY_CHARACTERS = 0.78, 0.12, 15, 220


def by_page(*order: Column | str) -> Window:
    return Window.partitionBy(*PAGE).orderBy(*order)


def line_text(words: Column | str = "words") -> Column:
    """A line's words, stripped and joined by one space, without blanks between Japanese."""
    words = F.col(words) if isinstance(words, str) else words
    # One regular expression over the joined line, with a mark between words, rather than one for each word.
    return _normal(F.array_join(words["text"], "\x01"))


def _normal(marked: Column | str) -> Column:
    marked = F.col(marked) if isinstance(marked, str) else marked
    parted = by_script(by_script(marked, r"\s*\x01[\s\x01]*", " "), r"^\s+|\s+\z", "")
    # Nothing to do but to put blanks: printable ASCII words without white space, none of them empty.
    plain = ~marked.rlike(r"[^\x01\x21-\x7e]|\x01\x01|^\x01|\x01\z")
    return F.when(plain, F.replace(marked, F.lit("\x01"), F.lit(" "))).otherwise(collapse_japanese_spaces(parted))


def suspicion(text: Column | str, empty: float) -> Column:
    """Share of the visible characters that are neither meaningful nor safe punctuation."""
    text = visible(text)
    # What ASCII has of both goes by a table first; the large class then meets little.
    odd = F.when(text.rlike(ASCII_ODD), F.length(F.regexp_replace(F.translate(text, ASCII_FINE, ""), f"[{MEANINGFUL}{SAFE}]", ""))).otherwise(F.length(text) - F.length(text))
    return F.coalesce(F.try_divide(odd, F.length(text)), F.lit(empty))


def mean_confidence(words: Column | str = "words") -> Column:
    """Mean of the known confidences; null without any."""
    known = F.array_compact((F.col(words) if isinstance(words, str) else words)["confidence"])
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, c: a + c), F.size(known))


def line_metrics(lines: DataFrame) -> DataFrame:
    """lines with text, characters, confidence (2 places, 0 if none is known) and suspicious_ratio (0 for an empty line)."""
    out = once(lines.withColumn("_marked", F.array_join(F.col("words")["text"], "\x01")), text=_normal("_marked")).drop("_marked")
    out = out.withColumn("_visible", visible("text")).withColumn("characters", F.length("_visible"))
    return out.withColumn("confidence", rounded(F.coalesce(mean_confidence(), F.lit(0.0)), 2)).withColumn("suspicious_ratio", suspicion("_visible", 0.0)).drop("_visible")


def page_metrics(measured: DataFrame) -> DataFrame:
    """(book, page, line_count, character_count, mean_confidence, suspicious_ratio, score) of measured lines that have words.

    Means are of rounded line values, the confidence's to 2 places and the ratio's to 4; a page without characters has ratio 1. The score, 0 to 100, is a hundred times the
    confidence, at most 8 more for length, less 25 times the suspicious ratio.
    """
    shown = F.col("characters") > 0
    per = measured.where(F.size("words") > 0).groupBy(*PAGE).agg(
        F.count("*").alias("line_count"),
        F.sum("characters").alias("character_count"),
        F.coalesce(F.try_divide(F.sum(F.when(shown, F.rint(F.col("confidence") * 100))) / 100, F.count_if(shown)), F.lit(0.0)).alias("mean"),
        F.coalesce(F.try_divide(F.sum(F.rint(F.col("suspicious_ratio") * F.col("characters"))), F.sum("characters")), F.lit(1.0)).alias("odd"),
    )
    score = 100 * F.col("mean") + F.least(F.lit(8.0), F.col("character_count") / 80) - 25 * F.col("odd")
    return per.select(*PAGE, "line_count", "character_count", rounded(F.col("mean"), 2).alias("mean_confidence"), rounded(F.col("odd"), 4).alias("suspicious_ratio"), rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("score"))


def retry_decision(metrics: DataFrame, mode: int = 6) -> DataFrame:
    """metrics with retry, and alternate_mode, the segmentation to try instead of `mode`: sparse text for short pages, 3 else,
    and 6 if that is the mode already."""
    poor = (F.col("mean_confidence") < RETRY_CONFIDENCE) | (F.col("suspicious_ratio") > RETRY_SUSPICION)
    short = (F.col("line_count") <= RETRY_LINES) & (F.col("character_count") < RETRY_CHARACTERS)
    other = F.when((F.col("line_count") <= 18) | (F.col("character_count") < 260), 11).otherwise(3)
    return metrics.withColumn("retry", poor | short).withColumn("alternate_mode", F.when(other == mode, 6).otherwise(other))


def best_pass(primary: DataFrame, alternate: DataFrame, by: float = 1.0) -> DataFrame:
    """(book, page, chosen, score): the alternate pass where its score is more than `by` above the primary's."""
    both = primary.select(*PAGE, F.col("score").alias("own")).join(alternate.select(*PAGE, F.col("score").alias("other")), PAGE, "left")
    better = F.coalesce(F.col("other") > F.col("own") + by, F.lit(False))
    return both.select(*PAGE, F.when(better, "alternate").otherwise("primary").alias("chosen"), F.when(better, F.col("other")).otherwise(F.col("own")).alias("score"))


def best_retry_line(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's lines (.., nth, confidence) the most confident, the first of equal ones."""
    others = [c for c in candidates.columns if c not in keys]
    best = candidates.groupBy(*keys).agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "nth", *(c for c in others if c != "nth"))).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in others))


def accept_line_retry(pairs: DataFrame) -> DataFrame:
    """pairs (original_text, original_confidence, text, confidence, reasons) with `accepted`: no review reason, something
    meaningful, 0.45 to 2.2 times as long, and confidence at least 0.72 and 0.08 above the original's."""
    a, b = F.length("original_text"), F.length("text")
    size = F.coalesce(F.try_divide(b, F.greatest(F.lit(1), a)), F.lit(0.0))
    ok = (F.size("reasons") == 0) & F.col("text").rlike(f"[{MEANINGFUL}]") & size.between(0.45, 2.2)
    return pairs.withColumn("accepted", ok & (F.col("confidence") >= F.greatest(F.lit(0.72), F.col("original_confidence") + 0.08)))


def low_confidence(measured: DataFrame) -> DataFrame:
    """measured lines with `removed`: short lines of low confidence and odd characters, on short pages or standing apart.

    A line stands apart if the lesser gap to its neighbours is over 1.8 times the page's median line height. Neighbours
    are those of the page as recognised, removed or not. Empty lines and page numbers stay.
    """
    page = Window.partitionBy(*PAGE)
    order = by_page("top", "block_no", "line_no")
    height = F.col("bottom") - F.col("top")
    out = measured.withColumn("_typical", F.coalesce(F.median(F.when(height > 0, height)).over(page), F.lit(1.0))).withColumn("_n", F.count("*").over(page))
    above = F.greatest(F.lit(0.0), F.col("top") - F.lag("bottom").over(order))
    below = F.greatest(F.lit(0.0), F.lead("top").over(order) - F.col("bottom"))
    out = out.withColumn("_gap", F.least(F.when(F.lag("bottom").over(order).isNotNull(), above), F.when(F.lead("top").over(order).isNotNull(), below)))
    apart = F.coalesce(F.col("_gap") > 1.8 * F.col("_typical"), F.lit(False))
    noise = (F.col("confidence") < 0.48) & (F.col("characters") <= 40) & (F.col("suspicious_ratio") >= 0.18)
    removed = noise & (F.col("characters") > 0) & ~is_page_number("text") & ((F.col("_n") <= 18) | apart)
    return out.withColumn("removed", removed).drop("_typical", "_n", "_gap")


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with place (from 0): blocks by top and left, lines within a block likewise; moved, whether a block's rank or a
    line's rank in its block differs from the recognised order. A block without a box counts as its lines' least."""
    block = Window.partitionBy(*PAGE, "block_no")
    out = lines.withColumn("_bt", F.min("top").over(block)).withColumn("_bl", F.min("left").over(block))
    spot = ["_bt", "_bl", "block_no"]
    own = ["top", "left", "line_no"]
    out = out.withColumn("place", F.row_number().over(by_page(*spot, *own)) - 1)
    out = out.withColumn("_new", F.dense_rank().over(by_page(*spot))).withColumn("_old", F.dense_rank().over(by_page("block_no")))
    within = F.row_number().over(block.orderBy(*own)) != F.row_number().over(block.orderBy("line_no"))
    return out.withColumn("moved", within | (F.col("_new") != F.col("_old"))).drop("_bt", "_bl", "_new", "_old")


def manga_order(lines: DataFrame, height: Column | str = "page_height") -> DataFrame:
    """lines with place (from 0): bands of 8 % of the page from the top, in a band from right to left."""
    band = F.floor(F.col("top") / F.greatest(F.lit(1.0), F.lit(0.08) * (F.col(height) if isinstance(height, str) else height)))
    return lines.withColumn("place", F.row_number().over(by_page(band, F.col("left").desc(), "block_no", "line_no")) - 1)


def merge_dedupe(lines: DataFrame) -> DataFrame:
    """(book, page, place, text): lines in the order of place, without those that a kept line of the page equals or, from six
    characters on, holds or is held by, compared in NFKC without anything but word characters.

    A dropped line suppresses none, so the order decides; each page is one fold over its lines.
    """

    import re
    import unicodedata

    def keep(every: list) -> list[tuple]:
        keys, kept = [], []
        for x in every:
            key = re.sub(r"\W", "", unicodedata.normalize("NFKC", x["text"] or ""))
            if key and not any(key == k or len(key) >= 6 and (key in k or k in key) for k in keys):
                keys.append(key)
                kept.append((x["place"], x["text"]))
        return kept

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(book, page, *x) for book, page, every in zip(pdf["book"], pdf["page"], pdf["lines"], strict=True) for x in keep(every)]
            yield pd.DataFrame(rows, columns=[*PAGE, "place", "text"])

    whole = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"))
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    return whole.mapInPandas(pages, f"book {kinds['book']}, page {kinds['page']}, place {kinds['place']}, text string")


def merge_words(lines: DataFrame) -> DataFrame:
    """lines whose words are one word with the line's box and text and the least confidence; page numbers are left out."""
    least = F.array_min(F.col("words")["confidence"])
    out = lines.where(F.size("words") > 0).withColumn("_text", line_text()).where(~is_page_number("_text"))
    word = F.struct(F.col("_text").alias("text"), "left", "top", "right", "bottom", least.alias("confidence"))
    return out.withColumn("words", F.array(word)).drop("_text")


def page_text(lines: DataFrame, place: str = "place") -> DataFrame:
    """(book, page, text): the texts of a page's lines in order, one a line, without empty ones and page numbers."""
    shown = (F.col("text") != "") & ~is_page_number("text")
    # A null is no part, so a page without any still has its row, from one shuffle.
    parts = F.sort_array(F.collect_list(F.when(shown, F.struct(F.col(place).alias("place"), "text"))))
    joined = lines.groupBy(*PAGE).agg(F.array_join(parts["text"], "\n").alias("text"))
    return joined.select(*PAGE, F.coalesce(strip("text"), F.lit("")).alias("text"))
