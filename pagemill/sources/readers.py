"""Inputs: texts with form feeds, page images, recogniser output, word lists, reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.operators.lines import MEANINGFUL, line_metrics, page_metrics

REPORT = "book string, page int, engine string, retried boolean, removed_lines int, corrections map<string,int>, review_candidates array<struct<text:string, reasons:array<string>>>, character_count int, line_count int, mean_confidence double, suspicious_ratio double, score double"


def book_of(path: str = "path"):
    """A file's name without its folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?\z", 1)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, text): each file under the path as one text in UTF-8."""
    return spark.read.text(path, wholetext=True).select(book_of("_metadata.file_path").alias("book"), F.col("value").alias("text"))


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """(book, page, content): files named .._0001.png and the like, numbered from 1, the folder being the book."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("book"), F.regexp_extract("path", r"_([0-9]+)\.[^.]*\z", 1).cast("int").alias("page"), "content")


def read_reports(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_lines(rows: DataFrame, width: str = "page_width", height: str = "page_height") -> DataFrame:
    """Recogniser rows (book, page, pos, value, page_width, page_height), value being x, y, w, h, confidence and text between tabs,
    as shares of the page and y from below -> lines with boxes in pixels from above and one word each.

    A row without six fields, with a field that is no number, or without meaning is left out; boxes are cut to the page and
    empty ones left out. On a page with three or more lines of at least 4 % of its height that have 15 characters together,
    only those stay.
    """
    part = F.split("value", "\t", 6)
    own = rows.where(F.size(part) == 6).select("book", "page", "pos", width, height, *(F.expr(f"try_cast(split(value, '\t', 6)[{i}] as double)").alias(c) for i, c in enumerate("xywhc")), strip(part[5]).alias("text"))
    own = own.where("x is not null and y is not null and w is not null and h is not null and c is not null and text <> ''").where(F.col("text").rlike(f"[{MEANINGFUL}]"))
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(F.col(most).cast("double"), v))
    own = own.select("book", "page", "pos", width, height, "text", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c")).alias("confidence"), cut(F.col("x") * F.col(width), width).alias("left"), cut((1 - F.col("y") - F.col("h")) * F.col(height), height).alias("top"), cut((F.col("x") + F.col("w")) * F.col(width), width).alias("right"), cut((1 - F.col("y")) * F.col(height), height).alias("bottom"))
    own = own.where("right > left and bottom > top").withColumn("large", F.col("bottom") - F.col("top") >= 0.04 * F.col(height))
    per = own.groupBy("book", "page").agg(F.count_if("large").alias("n"), F.sum(F.when(F.col("large"), F.length("text")).otherwise(0)).alias("chars"))
    kept = own.join(per, ["book", "page"]).where("large or not (n >= 3 and chars >= 15)")
    word = F.struct("text", "left", "top", "right", "bottom", "confidence")
    return kept.select("book", "page", F.lit(0).alias("block_no"), F.col("pos").alias("line_no"), "left", "top", "right", "bottom", F.array(word).alias("words"), width, height)


def usable_recognition(metrics: DataFrame) -> DataFrame:
    """Pages of metrics with at least two lines and ten characters."""
    return metrics.where("line_count >= 2 and character_count >= 10")


def preferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of two recognisers: of each page the first one's where they are usable_recognition(), the second one's elsewhere."""
    page = ["book", "page"]
    # Pages are few beside lines: their hash is built, and lines pass by it unsorted.
    good = usable_recognition(page_metrics(line_metrics(first))).select(*page).hint("shuffle_hash")
    return first.join(good, page, "left_semi").unionByName(second.join(good, page, "left_anti"))


def recognise(images: DataFrame, engine: Callable[[bytes], list[tuple]], rows: int = 16) -> DataFrame:
    """Page images (book, page, content) -> lines, by any recogniser: a function of an image's bytes that gives its width, its height and
    its lines (text, left, top, right, bottom, confidence). Each line is one word and all are one block. A null image
    has no lines; at most `rows` images are held at once. The function runs on executors and must be picklable.
    """
    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    names = ["book", "page", "block_no", "line_no", "left", "top", "right", "bottom", "words", "page_width", "page_height"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), rows):
                out = []
                for r in pdf.iloc[at : at + rows].itertuples():
                    width, height, found = engine(bytes(r.content)) if r.content is not None else (0, 0, [])
                    for n, (text, *box, sure) in enumerate(found):
                        word = dict(zip(("text", "left", "top", "right", "bottom", "confidence"), (text, *map(float, box), sure), strict=True))
                        out.append((r.book, r.page, 0, n, *map(float, box), [word], width, height))
                yield pd.DataFrame(out, columns=names)

    word = "array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>"
    schema = f"book {kinds['book']}, page {kinds['page']}, block_no int, line_no int, left double, top double, right double, bottom double, words {word}, page_width int, page_height int"
    return images.select("book", "page", "content").mapInPandas(run, schema)


def finished_pages(filtered: DataFrame, final: DataFrame) -> DataFrame:
    """(book, page, text): the pages of each book's final text (book, text), one row a book, between form feeds; where that is null or
    missing, the book's filtered pages (book, page, text)."""
    read = final.where("text is not null")
    own = read.select("book", F.posexplode(F.split("text", "\f")).alias("n", "text"))
    own = own.select("book", (F.col("n") + 1).cast(filtered.schema["page"].dataType).alias("page"), "text")
    return own.unionByName(filtered.join(read.select("book"), "book", "left_anti").select("book", "page", "text"))


def user_words(lines: DataFrame) -> DataFrame:
    """(word, first): the distinct words of dictionary rows (file, pos, line), by where each comes first.

    What follows # is a comment; blank rows and a byte order mark are left out. A word with white space in it, or a file name with
    other than a-z, 0-9, _ and -, is an error.
    """
    word = strip(F.regexp_replace(F.split_part("line", F.lit("#"), F.lit(1)), "^﻿", ""))
    own = lines.select("file", "pos", word.alias("word")).where("word <> ''")
    checked = F.when(~F.col("file").rlike(r"^[a-z0-9_-]+\z"), F.raise_error(F.concat(F.lit("not a dictionary name: "), "file"))).when(F.col("word").rlike(r"(?U)\s"), F.raise_error(F.concat(F.lit("white space in a word: "), "word"))).otherwise(F.col("word"))
    return own.select("file", "pos", checked.cast("string").alias("word")).groupBy("word").agg(F.min(F.struct("file", "pos")).alias("first"))


def missing(requested: DataFrame, installed: DataFrame) -> DataFrame:
    """Names requested, once each, that aren't installed."""
    return requested.select("name").distinct().join(installed.select("name"), "name", "left_anti")


def checksum_matches(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """(name, sha256, ok): each pinned (name, sha256) and whether the file (name, content) has it; false without the file."""
    own = files.select("name", F.sha2("content", 256).alias("found"))
    return pinned.join(own, "name", "left").select("name", "sha256", F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False)).alias("ok"))


def parse_hocr(pages: DataFrame) -> DataFrame:
    """(book, page, value), value being hOCR markup -> lines with boxes and words with confidences from 0 to 1.

    Paragraphs are blocks; elements of the line classes are lines, in the order of the markup. A line without words is left
    out, and one without a box of its own has that of its words. Markup is parsed as HTML, so it needn't be well-formed.
    """
    schema = "book {book}, page {page}, block_no int, line_no int, left double, top double, right double, bottom double, words array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>, page_width int, page_height int"
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                found = Hocr()
                found.feed(r.value or "")
                rows += [(r.book, r.page, *line) for line in found.rows()]
            yield pd.DataFrame(rows, columns=["book", "page", "block_no", "line_no", "left", "top", "right", "bottom", "words", "page_width", "page_height"])

    return pages.select("book", "page", "value").mapInPandas(parse, schema.format(**kinds))


class Hocr(HTMLParser):
    """Lines and words of hOCR, by its classes and the properties in its titles."""

    LINES = ("ocr_line", "ocr_header", "ocr_caption", "ocr_textfloat")

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[str] = []
        self.lines: list[dict] = []
        self.block, self.size = -1, (0, 0)

    @staticmethod
    def properties(title: str) -> dict[str, list[float]]:
        found = {}
        for part in title.split(";"):
            name, *values = part.split() or [""]
            found[name] = [float(v) for v in values if re.fullmatch(r"-?\d+(\.\d+)?", v)]
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        kind, p = (own.get("class") or "").split(" ")[0], self.properties(own.get("title") or "")
        box = p.get("bbox") if len(p.get("bbox", [])) == 4 else None
        if tag not in ("br", "meta", "img", "link", "hr", "input"):
            self.stack.append(kind)
        if kind == "ocr_page" and box:
            self.size = (int(box[2] - box[0]), int(box[3] - box[1]))
        elif kind == "ocr_par":
            self.block += 1
        elif kind in self.LINES:
            self.lines.append({"block": max(0, self.block), "box": box, "words": []})
        elif kind == "ocrx_word" and self.lines:
            sure = p.get("x_wconf")
            self.lines[-1]["words"].append(["", box, sure[0] / 100 if sure else None])

    def handle_endtag(self, tag: str) -> None:
        if self.stack:
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if "ocrx_word" in self.stack and self.lines and self.lines[-1]["words"]:
            self.lines[-1]["words"][-1][0] += data

    def rows(self) -> Iterator[tuple]:
        number = {}
        for line in self.lines:
            words = [(t.strip(), b or line["box"], c) for t, b, c in line["words"] if t.strip()]
            boxes = [b for _, b, _ in words if b]
            box = line["box"] or ([f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))] if boxes else None)
            if not words or not box:
                continue
            k = number[line["block"]] = number.get(line["block"], -1) + 1
            made = [dict(zip(("text", "left", "top", "right", "bottom", "confidence"), (t, *(b or box), c), strict=True)) for t, b, c in words]
            yield line["block"], k, *box, made, *self.size
