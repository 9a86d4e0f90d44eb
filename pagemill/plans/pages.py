"""The whole page job: from recognised lines, and what else is known of the pages, to clean lines, texts and reports."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.rules import DEFAULT_PROFILES, expand_profiles
from pagemill.functions.text import nfkc
from pagemill.operators import corrections, layout, lines, pixels
from pagemill.operators.lines import PAGE


@dataclass(frozen=True)
class Options:
    """What to do with pages; the defaults are those of the command line this replaces."""

    profiles: tuple[str, ...] = DEFAULT_PROFILES
    adaptive: bool = True
    filter_low_confidence: bool = True
    correct: bool = True
    include_figures: bool = False
    include_list_markers: bool = False
    content: str = "document"
    comic_scope: str = "narrative"
    mode: int = 6

    def __post_init__(self) -> None:
        if self.content not in ("document", "manga") or self.comic_scope not in ("narrative", "all"):
            raise ValueError("content is document or manga, comic_scope narrative or all")

    @classmethod
    def of(cls, settings: dict[str, str]) -> Options:
        """From texts: flags are on for 1, profiles are a list with commas."""
        flag = lambda k, d: settings[k] == "1" if k in settings else d
        own = tuple(p.strip() for p in settings["profiles"].split(",") if p.strip()) if "profiles" in settings else DEFAULT_PROFILES
        return cls(own, *(flag(k, getattr(cls, k)) for k in ("adaptive", "filter_low_confidence", "correct", "include_figures", "include_list_markers")), settings.get("content", "document"), settings.get("comic_scope", "narrative"), int(settings.get("mode", 6)))


class Pages(NamedTuple):
    lines: DataFrame
    texts: DataFrame
    reports: DataFrame


def settled(df: DataFrame) -> DataFrame:
    """Rows written as a Parquet table to the cluster's checkpoint folder: steps read those before them several times, so without
    this a plan would double with every step. A line's words repeat its box, which columns hold in next to nothing and rows don't.
    The shuffles behind a table go with the write; the tables go at the driver's end.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pagemill-')}")
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path, before = f"{at.rstrip('/')}/pages-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its JVM with it
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*PAGE).agg(F.count("*").alias(name))


def _dropped(df: DataFrame, flag: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose flag isn't set, and how many had it, by page."""
    return df.where(f"not {flag}").drop(flag), _count(df.where(flag), name)


def choose_pass(primary: DataFrame, alternate: DataFrame | None, options: Options) -> tuple[DataFrame, DataFrame]:
    """The lines of the better pass of each page, and (book, page, retried, chosen, metrics). Only pages whose metrics ask for it
    look at the alternate pass."""
    first = lines.retry_decision(lines.page_metrics(lines.line_metrics(primary)), options.mode)
    if alternate is None or not options.adaptive:
        return primary, first.drop("retry", "alternate_mode").withColumn("retried", F.lit(False)).withColumn("mode", F.lit(options.mode))
    asked = first.where("retry").select(*PAGE, "alternate_mode")
    other = alternate.join(asked.select(*PAGE), PAGE, "left_semi")
    second = lines.page_metrics(lines.line_metrics(other))
    best = lines.best_pass(first, second).select(*PAGE, "chosen")
    took = best.where("chosen = 'alternate'").select(*PAGE)
    kept = primary.join(took, PAGE, "left_anti").unionByName(other.join(took, PAGE, "left_semi"))
    facts = first.drop("retry", "alternate_mode").join(took, PAGE, "left_anti").unionByName(second.join(took, PAGE, "left_semi"))
    facts = facts.join(asked, PAGE, "left").join(best, PAGE, "left")
    return kept, facts.withColumn("retried", F.col("alternate_mode").isNotNull()).withColumn("mode", F.when(F.col("chosen") == "alternate", F.col("alternate_mode")).otherwise(F.lit(options.mode))).drop("chosen", "alternate_mode")


def comic_lines(own: DataFrame, images: DataFrame, whole: DataFrame | None, bubbles: DataFrame | None, options: Options) -> tuple[DataFrame, DataFrame]:
    """Lines of comics in their order, and how many non-narrative ones were left out by page.

    whole has lines of a recogniser that sees full pages, bubbles those of accepted regions. Where a page has both, only titles
    of the former stay; where it has only the former, titles and speech. Without either a page keeps its own lines.
    """
    narrative = options.comic_scope == "narrative"
    regions = pixels.narrative_regions(images) if narrative else None
    texts = lambda df: lines.line_metrics(df).withColumn("text", nfkc("text"))
    parts, gone = [], []

    def keep(df: DataFrame, judged: DataFrame) -> DataFrame:
        gone.append(judged.where("not kept").select(*PAGE))
        return df.join(judged.where("kept").select(*layout.LINE), layout.LINE, "left_semi")

    bubble_pages = bubbles.select(*PAGE).distinct() if bubbles is not None else own.select(*PAGE).limit(0)
    if whole is not None:
        beside, alone = whole.join(bubble_pages, PAGE, "left_semi"), whole.join(bubble_pages, PAGE, "left_anti")
        parts.append((keep(beside, layout.title_lines(texts(beside))) if narrative else beside).withColumn("_part", F.lit(0)))
        parts.append((keep(alone, layout.narrative_lines(texts(alone), regions)) if narrative else alone).withColumn("_part", F.lit(0)))
    if bubbles is not None:
        parts.append(bubbles.withColumn("_part", F.lit(1)))
    seen = own.select(*PAGE).limit(0)
    for p in parts:
        seen = seen.unionByName(p.select(*PAGE))
    rest = own.join(seen.distinct(), PAGE, "left_anti")
    parts.append((keep(rest, layout.narrative_lines(texts(rest), regions)) if narrative else rest).withColumn("_part", F.lit(2)))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    from pyspark.sql import Window

    merged = lines.line_metrics(merged).withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("_part", "block_no", "line_no")) - 1)
    once = lines.merge_dedupe(merged).select(*PAGE, "place")
    ordered = lines.manga_order(merged.join(once, [*PAGE, "place"], "left_semi").drop("place"))
    lost = gone[0] if gone else own.select(*PAGE).limit(0)
    for g in gone[1:]:
        lost = lost.unionByName(g)
    return ordered.withColumn("block_no", F.lit(0)).withColumn("line_no", F.col("place").cast("int")).select(*own.columns), _count(lost, "filtered_non_narrative_lines")


def retry_lines(own: DataFrame, attempts: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Lines that ask for review with the best of their attempts (line key, nth, text, confidence, suspicious_ratio), where that is
    accepted; and how many were, by page."""
    asked = corrections.review_candidates(own, profiles=options.profiles).select(*layout.LINE, F.col("text").alias("original_text"), F.col("confidence").alias("original_confidence"))
    best = lines.best_retry_line(attempts.select(*layout.LINE, "nth", "text", "confidence", "suspicious_ratio"), layout.LINE)
    pairs = corrections.review_reasons(asked.join(best, layout.LINE), profiles=options.profiles)
    good = lines.accept_line_retry(pairs).where("accepted").select(*layout.LINE, F.col("text").alias("_text"), F.col("confidence").alias("_sure"))
    both = own.join(good, layout.LINE, "left")
    word = F.struct(F.col("_text").alias("text"), "left", "top", "right", "bottom", F.col("_sure").cast("double").alias("confidence"))
    both = both.withColumn("words", F.when(F.col("_text").isNotNull(), F.array(word)).otherwise(F.col("words")))
    return both.select(*[c for c in own.columns]), _count(good, "retried_lines")


def process_pages(primary: DataFrame, images: DataFrame | None = None, options: Options = Options(), alternate: DataFrame | None = None, whole: DataFrame | None = None, bubbles: DataFrame | None = None, attempts: DataFrame | None = None) -> Pages:  # noqa: B008
    """Lines of pages through every step, in the order on which results depend: choice of pass, comics, noise, figures, list markers,
    reading order, corrections, line retries and corrections again, review. Steps that need pixels are left out without
    images. Reports have the metrics of the chosen pass before anything was removed.
    """
    own, facts = choose_pass(primary, alternate, options)
    own, facts = settled(own), settled(facts)
    columns, counts = own.columns, []
    comic = options.content == "manga" and images is not None
    if comic:
        own, lost = comic_lines(own, images, whole, bubbles, options)
        own = settled(own)
        counts.append(lost)
    if options.filter_low_confidence:
        flagged = lines.low_confidence(lines.line_metrics(own))
        # Without images the lines are read but once again; the count then carries no words.
        own, lost = _dropped(settled(flagged) if images is not None else flagged, "removed", "filtered_lines")
        counts.append(lost)
    own = own.select(*columns)
    if images is not None and not (options.include_figures or comic):
        inked = settled(pixels.inked_lines(lines.line_metrics(own), images))
        kept = layout.outside_figures(inked, layout.figure_regions(layout.figure_flags(inked)))
        own, lost = _dropped(settled(kept.withColumn("gone", ~F.col("kept")).drop("kept")), "gone", "filtered_figure_lines")
        counts.append(lost)
        own = own.select(*columns)
    if images is not None and not options.include_list_markers:
        inked = settled(pixels.inked_lines(lines.line_metrics(own), images))
        first, rest = F.get("words", F.lit(0)), F.slice("words", F.lit(2), F.greatest(F.lit(0), F.size("words") - 1))
        box = [first[c].alias(c) for c in ("left", "top", "right", "bottom")]
        seen = inked.where(F.size("words") > 0).select(*layout.LINE, F.trim(first["text"]).alias("token"), *box, (F.size("words") == 1).alias("alone"), F.get("words", F.lit(1))["left"].alias("next_left"), lines.line_text(rest).alias("rest"), "text", "page_width", "page_height", F.col("marker_dark").alias("dark"))
        markers = settled(layout.list_markers(settled(seen)))
        own = own.join(markers.select(*layout.LINE, F.lit(True).alias("_cut")), layout.LINE, "left").withColumn("words", F.when(F.col("_cut"), rest).otherwise(F.col("words"))).where(F.size("words") > 0).select(*columns)
        counts.append(_count(markers, "filtered_list_markers"))
    ordered = None
    if not comic:
        own = lines.reading_order(own).withColumn("block_no", F.lit(0)).withColumn("line_no", F.col("place").cast("int")).select(*columns, "moved")
        own = own if options.correct else settled(own)
        ordered = own
    made = None

    def correct(df: DataFrame) -> DataFrame:
        nonlocal made, ordered
        done = settled(corrections.correct_lines(lines.line_metrics(df), profiles=options.profiles))
        totals = corrections.correction_totals(done, PAGE)
        made = totals if made is None else made.unionByName(totals)
        ordered = done if "moved" in done.columns else ordered
        return done.where("not removed").select(*columns)

    if options.correct:
        own = correct(own)
    if not comic:
        counts.append(ordered.groupBy(*PAGE).agg(F.count_if("moved").alias("reordered_elements")))
        own = own.select(*columns)
    if attempts is not None and options.adaptive and not comic:
        own, lost = retry_lines(lines.line_metrics(own), attempts, options)
        counts.append(lost)
        own = correct(own) if options.correct else own
    measured = lines.line_metrics(own.select(*columns))
    review = corrections.review_candidates(measured, profiles=options.profiles).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "confidence", "reasons"))).alias("review_candidates"))
    reports = facts
    for c in counts:
        reports = reports.join(c, PAGE, "left")
    if made is not None:
        per = made.groupBy(*PAGE, "name").agg(F.sum("count").cast("int").alias("n")).groupBy(*PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("corrections"))
        reports = reports.join(per, PAGE, "left")
    reports = reports.join(review, PAGE, "left").na.fill(0).withColumn("correction_profiles", F.array(*(F.lit(p) for p in sorted(expand_profiles(options.profiles)))))
    return Pages(lines.merge_words(measured).select(*columns), lines.page_text(measured, "line_no"), reports)
