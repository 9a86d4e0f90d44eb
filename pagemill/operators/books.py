"""From pages to reading text: repeated edges, stray blanks, wrapped lines, whole books, titles.

A page is a row (book, page, text). Nothing but what pages of a book share is shuffled: the candidates for repeated
edges, at most four short lines a page.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import JAPANESE_OR_PUNCTUATION as JP
from pagemill.functions.text import collapse_japanese_spaces, is_page_number, lines_of, nfc, pages_of, safe_filename, squeeze, strip, unify_newlines


def split_pages(books: DataFrame) -> DataFrame:
    """(book, text) with form feeds between pages -> (book, page from 1, text)."""
    return books.select("book", F.posexplode(pages_of("text")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def skip_pages(pages: DataFrame, numbers: Iterable[int]) -> DataFrame:
    """Pages whose number isn't listed. Do this before anything that counts pages."""
    numbers = sorted(set(numbers))
    return pages.where(~F.col("page").isin(numbers)) if numbers else pages


def exclude_last_page(pages: DataFrame) -> DataFrame:
    """Without each book's last page, unless it is the only one."""
    ends = pages.groupBy("book").agg(F.max("page").alias("last"), F.min("page").alias("first"))
    return pages.join(ends, "book").where("page < last or first = last").select(*pages.columns)


def stripped_lines(text: Column | str) -> Column:
    return F.transform(lines_of(text), lambda x: strip(x))


def edge_candidates(pages: DataFrame) -> DataFrame:
    """(book, page, line): the distinct lines among a page's first and last two that may be headers or footers."""
    edges = F.concat(F.slice("lines", 1, 2), F.slice("lines", F.greatest(F.lit(1), F.size("lines") - 1), F.lit(2)))
    kept = F.filter(F.array_distinct(F.transform(edges, lambda x: strip(x))), lambda x: F.length(x).between(4, 80) & ~is_page_number(x))
    return pages.select("book", "page", lines_of("text").alias("lines")).select("book", "page", F.explode(kept).alias("line"))


def repeated_edges(pages: DataFrame) -> DataFrame:
    """(book, line, pages): lines at the edge of two pages or more."""
    return edge_candidates(pages).groupBy("book", "line").agg(F.count("*").alias("pages")).where("pages >= 2")


def drop_repeated_edges(pages: DataFrame) -> DataFrame:
    """pages with the stripped lines as text, less those that are repeated edges, where they stand at an edge."""
    repeated = edge_candidates(pages).join(repeated_edges(pages).select("book", "line"), ["book", "line"], "left_semi")
    own = repeated.groupBy("book", "page").agg(F.collect_set("line").alias("repeated"))  # four at most
    lines = pages.select(*pages.columns, stripped_lines("text").alias("lines")).join(own, ["book", "page"], "left")
    n = F.size("lines")
    kept = F.filter("lines", lambda x, i: ~F.array_contains("repeated", x) | ((i >= 2) & (i < F.greatest(F.lit(0), n - 2))))
    text = F.array_join(F.when(F.col("repeated").isNull(), F.col("lines")).otherwise(kept), "\n")
    return lines.withColumn("text", text).select(*pages.columns)


def drop_spurious_blanks(text: Column | str) -> Column:
    """Without blank lines between a line that ends and one that begins with Japanese. Lines come out stripped."""
    return F.regexp_replace(F.array_join(stripped_lines(text), "\n"), f"\\n(?<=[{JP}]\\n)\\n+(?=[{JP}])", "\n")


def join_wrapped_lines(text: Column | str) -> Column:
    """Lines as paragraphs, with an empty line between two.

    A blank line ends a paragraph; a page number is left out and ends none. A hyphen before a Latin letter goes with the line
    end, Japanese on both sides is joined without a blank, and everything else by one.
    """
    lines = F.filter(stripped_lines(text), lambda x: ~is_page_number(x))
    text = F.array_join(lines, "\n")
    text = F.regexp_replace(text, r"-\n(?=[A-Za-z])", "")
    text = F.regexp_replace(text, f"\\n(?<=[{JP}]\\n)(?=[{JP}])", "")
    text = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def paragraphs(pages: DataFrame) -> DataFrame:
    """Pages as read aloud, one by one: repeated edges, stray blanks and wraps gone; pages without text left out."""
    return drop_repeated_edges(pages).withColumn("text", join_wrapped_lines(drop_spurious_blanks("text"))).where("text <> ''")


def join_pages(pages: DataFrame, between: str) -> DataFrame:
    """(book, text): the pages of each book in order. A book is one value, so it must fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("book").agg(F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text"))


def book_text(books: DataFrame, skip: Iterable[int] = (), compose: bool = True) -> DataFrame:
    """(book, text): each book (book, text with form feeds) as text to be read aloud, ending in a line end if not empty."""
    text = unify_newlines(nfc("text") if compose else F.col("text"))
    pages = skip_pages(split_pages(books.select("book", collapse_japanese_spaces(text).alias("text"))), skip)
    joined = join_pages(paragraphs(pages), "\n\n").withColumn("text", F.concat(strip("text"), F.lit("\n")))
    return books.select("book").join(joined, "book", "left").select("book", F.coalesce("text", F.lit("")).alias("text"))


# What is no title, what credits end with, and what marks titles.
NO_TITLE = (r"^(?:第[0-9０-９一二三四五六七八九十百]+[章節部]|序章|終章|目次)$", r"^(?:chapter|contents|目次)\s*[0-9０-９]*$", r"^(?:https?://|www\.)", r"^[0-9０-９\s./-]+$")
PAGE_CREDIT, LINE_CREDIT = r"(?U)(?:著|作者|訳|編|監修|出版社|出版)\s*$", r"(?:著|作者|訳|出版社|出版)$"
TITLE_MARKS, SENTENCE_END = "[『』【】]", "[。！？!?]$"


def title_candidates(pages: DataFrame, most_pages: int = 5, most_lines: int = 20) -> DataFrame:
    """(book, page, line_no, line, score, evidence) of each line of a book's first pages that may be its title.

    The page is counted from the book's first row here, 0; line_no counts lines with text.
    """
    nth = F.row_number().over(Window.partitionBy("book").orderBy("page")) - 1
    first = pages.select("book", "page").withColumn("nth", nth).where(F.col("nth") < most_pages)
    lines = F.filter(F.transform(lines_of(F.col("text")), lambda x: squeeze(x)), lambda x: x != "")
    own = pages.join(first, ["book", "page"]).select("book", F.col("nth").alias("page"), lines.alias("lines"))
    own = own.withColumn("credit", F.exists("lines", lambda x: x.rlike(PAGE_CREDIT))).withColumn("n", F.size("lines"))
    line = own.select("book", "page", "credit", "n", F.posexplode(F.slice("lines", 1, most_lines)).alias("line_no", "raw"))
    line = line.withColumn("line", F.regexp_replace("raw", r"^[『』「」【】\[\] ]+|[『』「」【】\[\] ]+\z", "")).withColumn("size", F.length("line"))
    out = F.lit(False)
    for pattern in NO_TITLE:
        out = out | F.col("line").rlike(f"(?iuU){pattern}")
    line = line.where(F.col("size").between(2, 80) & ~out & ~((F.col("size") > 30) & F.col("line").rlike(SENTENCE_END)))
    marks = F.col("raw").rlike(TITLE_MARKS)
    score = 5.0 - F.least("page", F.lit(4)) * 0.75 + F.greatest(F.lit(0.0), 2.0 - F.col("line_no") * 0.2)
    score = score + F.when(F.col("size").between(4, 40), 2.0).when(F.col("size") > 60, -2.0).otherwise(0.0)
    score = score + F.when(F.col("n") <= 8, 1.5).otherwise(0.0) + F.when(marks, 1.0).otherwise(0.0) - F.when(F.col("line").rlike(LINE_CREDIT), 3.0).otherwise(0.0)
    return line.select("book", "page", "line_no", "line", score.alias("score"), (F.col("credit") | marks).alias("evidence"))


def infer_titles(pages: DataFrame, compose: bool = True) -> DataFrame:
    """(book, title, confidence 0 to 1): the best candidate, the first of equal ones. A book without any has '' and 0."""
    # Of equal scores the first wins: the least (-score, page, line) struct, which is combined before the shuffle.
    best = title_candidates(pages).groupBy("book").agg(F.min(F.struct((-F.col("score")).alias("minus"), "page", "line_no", "line", "evidence")).alias("b"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-F.col("b.minus") - 4.0) / 7.0))
    confidence = F.when(F.col("b.evidence"), confidence).otherwise(F.least(confidence, F.lit(0.75)))
    found = best.select("book", safe_filename("b.line", compose=compose).alias("title"), confidence.alias("confidence"))
    every = pages.select("book").distinct().join(found, "book", "left")
    named = F.coalesce(F.col("title"), F.lit("")) != ""
    return every.select("book", F.when(named, F.col("title")).otherwise("").alias("title"), F.when(named, F.col("confidence")).otherwise(0.0).alias("confidence"))


def exclusive_names(wanted: DataFrame, taken: DataFrame, suffixes: list[str]) -> DataFrame:
    """(book, name): of each wanted (book, title) the first of title, title（2）, title（3）, .. of which no member title + suffix
    is among taken (name). Only as many candidates are looked at as there are names of that title, and one more."""
    names = taken.select(F.col("name").alias("full"))
    stems = None
    for s in suffixes:
        own = names.where(F.col("full").endswith(s)).select(F.expr(f"left(full, length(full) - {len(s)})").alias("stem"))
        stems = own if stems is None else stems.unionByName(own)
    number = F.when(F.col("stem").rlike(r"（[1-9][0-9]*）\z"), F.regexp_extract("stem", r"（([1-9][0-9]{0,8})）\z", 1).cast("int"))
    used = stems.distinct().select("stem", F.regexp_replace("stem", r"（[1-9][0-9]*）\z", "").alias("base"), number.alias("k"))
    plain = wanted.join(stems.distinct().select(F.col("stem").alias("title"), F.lit(True).alias("hit")), "title", "left")
    held = used.where("k >= 2").groupBy(F.col("base").alias("title")).agg(F.collect_set("k").alias("held"))
    free = plain.join(held, "title", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    # One of size(held) + 1 numbers must be free.
    k = F.array_min(F.array_except(F.sequence(F.lit(2), F.size("held") + 2), F.col("held")))
    name = F.when(F.col("hit").isNull(), F.col("title")).otherwise(F.concat("title", F.lit("（"), k.cast("string"), F.lit("）")))
    return free.select("book", name.alias("name"))


def path_collisions(paths: DataFrame) -> DataFrame:
    """(path, labels) of each path of (label, path) that two labels or more resolve to."""
    return paths.groupBy("path").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)


#: What a book's outputs are called after its own name, and their extensions.
OUTPUTS = (("output", "", ".pdf"), ("searchable", "_searchable", ".pdf"), ("ocr_text", "_ocr", ".txt"), ("readaloud", "_readaloud", ".txt"), ("quality", "_ocr_quality", ".json"))


def output_paths(wanted: DataFrame) -> DataFrame:
    """(book, kind, path, problem): where each output of wanted (book, output, searchable) goes.

    Unless it is searchable, a book has its output alone. Columns searchable_output, ocr_text_output, readaloud_output and
    quality_output, where there are any, name places of their own; null or empty, and without a column, the place is beside the output. problem is `collision` where
    another kind of that book has the path, else `extension` where the path hasn't that of its kind in any case, else null.
    Paths are compared as they are written.
    """
    ending = lambda p: F.regexp_extract(p, r"[^/](\.[^./]+)\z", 1)
    stem = F.expr("left(output, length(output) - length(_ending))")
    rows = []
    for kind, after, extension in OUTPUTS:
        path = F.col("output") if kind == "output" else F.concat(stem, F.lit(after + extension))
        if (chosen := f"{kind}_output") in wanted.columns:
            path = F.coalesce(F.when(F.col(chosen) != "", F.col(chosen)), path)
        rows.append(F.struct(F.lit(kind).alias("kind"), path.alias("path"), F.lit(extension).alias("extension")))
    own = wanted.withColumn("_ending", ending("output")).withColumn("_all", F.when(F.col("searchable"), F.array(*rows)).otherwise(F.array(rows[0])))
    own = own.select("book", F.col("_all.path").alias("paths"), F.explode("_all").alias("o"))
    shared = F.size(F.filter("paths", lambda p: p == F.col("o.path"))) > 1
    problem = F.when(shared, "collision").when(F.lower(ending("o.path")) != F.col("o.extension"), "extension")
    return own.select("book", "o.kind", "o.path", problem.alias("problem"))
