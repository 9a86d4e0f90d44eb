"""Outputs. Spark's committer makes each write appear whole or not at all; several writes are not one."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_place(a: str, b: str) -> bool:
    """Whether two addresses name one place; a bare path is a local one, and links aren't followed."""
    at = [(u.scheme or "file", u.netloc, posixpath.normpath(u.path)) for u in map(urlsplit, (a, b))]
    return at[0] == at[1]


def write_books(texts: DataFrame, path: str, overwrite: bool = False, source: str | None = None) -> None:
    """One folder per book, book=.., with its text in one file, which ends with a line end; an empty or null text's
    is nothing but that. The source that the texts were read from is never written over."""
    if source is not None and same_place(source, path):
        raise ValueError(f"texts would be written over what they are read from: {path}")
    # The writer ends each row itself.
    own = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\z", "")
    out = texts.select("book", own.alias("text")).repartition("book")
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("book").text(path)


def write_pages(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Pages as Parquet by book."""
    pages.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("book").parquet(path)


def write_reports(reports: DataFrame, path: str, overwrite: bool = False) -> None:
    """Reports as JSON lines, nested values kept, letters of any script as they are."""
    reports.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)
