"""Roll-ups of page reports (book, page, engine, retried, counters, corrections, review_candidates, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is summed over pages; a page, or a table, without one counts as 0.
COUNTERS = ("filtered_lines", "filtered_non_narrative_lines", "manga_regions_detected", "manga_regions_accepted", "filtered_figure_lines", "filtered_list_markers", "reordered_elements", "retried_lines")


def rollup(pages: DataFrame, post: DataFrame | None = None, counters: tuple[str, ...] = COUNTERS, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """(*by, pages, retried_pages, sums of the counters, candidates, post_candidates, automated_checks_passed, verified_error_free).

    post has a row (*by) for each candidate that the validation of the finished text found. The checks pass if neither a
    page nor that has a candidate for review. Nothing is ever verified to be free of errors.
    """
    sums = [(F.sum(F.coalesce(F.col(c), F.lit(0))) if c in pages.columns else F.lit(0)).cast("long").alias(c) for c in counters]
    open_ = F.sum(F.size(F.coalesce("review_candidates", F.expr("array()")))).alias("candidates")
    out = pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count_if(F.coalesce("retried", F.lit(False))).alias("retried_pages"), *sums, open_)
    if post is None:
        out = out.withColumn("post_candidates", F.lit(0).cast("long"))
    else:
        found = post.groupBy(*by).agg(F.count("*").alias("post_candidates"))
        out = out.join(found, list(by), "left").withColumn("post_candidates", F.coalesce("post_candidates", F.lit(0).cast("long")))
    return out.withColumn("automated_checks_passed", (F.col("candidates") == 0) & (F.col("post_candidates") == 0)).withColumn("verified_error_free", F.lit(False))


def engine_histogram(pages: DataFrame, by: tuple[str, ...] = ("book",), default: str = "tesseract") -> DataFrame:
    """(*by, engine, pages)."""
    return pages.groupBy(*by, F.coalesce("engine", F.lit(default)).alias("engine")).agg(F.count("*").alias("pages"))


def tagged_candidates(pages: DataFrame) -> DataFrame:
    """(book, page, nth, candidate fields): the candidates of all pages with their page."""
    return pages.select("book", "page", F.posexplode("review_candidates").alias("nth", "c")).select("book", "page", "nth", "c.*")


def correction_map(totals: DataFrame, by: list[str]) -> DataFrame:
    """(*by, corrections): totals (*by, name, count) as one map, by name."""
    return totals.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "count")))).alias("corrections"))
