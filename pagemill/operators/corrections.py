"""Ordered corrections with counts, repairs across lines, and candidates for review."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.book_rules import BOOK_CONTEXT, BOOK_CORRECTIONS, PROFILE, Context
from pagemill.functions.once import once
from pagemill.functions.rules import CORRECTIONS, LINE_REVIEWS, PAGE_REVIEWS, Correction, Review, active, expand_profiles
from pagemill.functions.text import JAPANESE, KNOWN_ACRONYMS, squeeze
from pagemill.operators.lines import by_page, mean_confidence

EMPTY = "cast(map() as map<string,int>)"
SPLIT_TITLE, CONTINUES = "LLM-as-a-", r"(?U)^J\s+udge\)\z"


def as_map(names: list[tuple[str, Column]]) -> Column:
    """name -> count of those above zero, by name."""
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.coalesce(c.cast("int"), F.lit(0)).alias("value")) for n, c in names)), lambda e: e["value"] > 0)
    return F.map_from_entries(F.array_sort(entries))


def needed(pattern: str) -> str:
    """The longest string outside groups that whatever a pattern matches must hold; empty if there's none or it isn't known. Looking for it is many times as fast as the pattern, and few lines have it."""
    if re.search(r"\\[^sSdDwWbBzZ\W_]|\(\?[^=!<:U]|\(\?U.", pattern.removeprefix("(?U)")) or "|" in re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", pattern):
        return ""
    outside = re.sub(r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[?*+{]?", "\0", pattern.removeprefix("(?U)"))  # groups are left alone
    if re.search(r"[()]", outside.replace(r"\(", "").replace(r"\)", "")):
        return ""
    plain = re.sub(r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?|\\.(?:[?*+]|\{[^}]*\})?|.(?:[?*]|\{[^}]*\})|[.^$+]", "\0", outside)
    return max(plain.split("\0"), key=len)


def correct(df: DataFrame, rules: Iterable[Correction] = (*CORRECTIONS, *BOOK_CORRECTIONS), profiles: Iterable[str] | None = None, text: str = "text", counts: str = "corrections") -> DataFrame:
    """df with text corrected by the active rules in order, each seeing what those before left, and how often each did.

    Each rule is a projection of its own, so an intermediate text is computed once though it is both counted and replaced.
    """
    own = active(rules, profiles)
    if not own:
        return df.withColumn(counts, F.expr(EMPTY))
    names = []
    for i, r in enumerate(own):
        count, made = F.regexp_count(text, F.lit(r.pattern)), F.regexp_replace(text, r.pattern, r.replacement.replace("\\", r"\\").replace("$", r"\$"))
        if part := needed(r.pattern):
            may = F.contains(F.col(text), F.lit(part))
            count, made = F.when(may, count).otherwise(0), F.when(may, made).otherwise(F.col(text))
        df = df.withColumn(f"_n{i}", count).withColumn(text, made)
        names.append((r.name, f"_n{i}"))
    totals: dict[str, Column] = {}
    for name, c in names:  # rules that share a name count together
        totals[name] = totals[name] + F.coalesce(F.col(c), F.lit(0)) if name in totals else F.coalesce(F.col(c), F.lit(0))
    return df.withColumn(counts, as_map(list(totals.items()))).drop(*(c for _, c in names))


def correct_in_context(df: DataFrame, rules: Iterable[Context] = BOOK_CONTEXT, prev: str = "prev", after: str = "next", counts: str = "corrections") -> DataFrame:
    """df (text, removed, prev, next, corrections) with the context rules applied in order; prev and next stay as recognised. A
    line that is removed is done with, and keeps the corrections only of the rule that removed it."""
    fired = []
    df = df.withColumn("_gone", F.lit(False))
    for i, r in enumerate(rules):
        hit = ~F.col("removed") & ~F.col("_gone") & F.col("text").rlike(r.text)
        hit = hit & F.col(prev).rlike(r.prev) if r.prev else hit
        hit = hit & F.col(after).rlike(r.next) if r.next else hit
        df = df.withColumn(f"_c{i}", hit)
        if r.replacement is None:
            df = df.withColumn("_gone", F.col("_gone") | F.col(f"_c{i}"))
        else:
            if "{" in r.replacement:
                head, tail = r.replacement.split("{text}")
                made = F.concat(F.lit(head), "text", *(F.col(prev) if x == "{prev}" else F.lit(x) for x in (tail.partition("{prev}")) if x))
            else:
                made = F.regexp_replace("text", r.text, r.replacement)
            df = df.withColumn("text", F.when(F.col(f"_c{i}"), made).otherwise(F.col("text")))
        fired.append((r, f"_c{i}"))
    named = lambda removing: as_map([(r.name, F.col(c)) for r, c in fired if r.name and (r.replacement is None) == removing])
    df = df.withColumn(counts, F.when(F.col("_gone"), named(True)).when(F.col("removed"), F.col(counts)).otherwise(F.map_concat(counts, named(False))))
    return df.withColumn("removed", F.col("removed") | F.col("_gone")).drop("_gone", *(c for _, c in fired))


def correct_lines(lines: DataFrame, rules: Iterable[Correction] = (*CORRECTIONS, *BOOK_CORRECTIONS), profiles: Iterable[str] | None = None) -> DataFrame:
    """lines (.., text, words) with text corrected also across lines, corrections and `removed`.

    What a line's neighbours say is their text before any correction. A corrected line has one word, with the line's box and the mean
    confidence; a continuation that its predecessor takes over is removed.
    """
    own = expand_profiles(profiles)
    ai = "ai-rag" in own
    order = by_page("block_no", "line_no")
    near = lines.withColumn("_prev", F.coalesce(F.lag("text").over(order), F.lit(""))).withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    near = near.withColumn("removed", F.lit(ai) & F.col("_prev").endswith(SPLIT_TITLE) & F.col("text").rlike(CONTINUES)).withColumn("_own", F.col("text"))
    out = correct(near, rules, profiles)
    takes = F.lit(ai) & F.col("text").endswith(SPLIT_TITLE) & F.col("_next").rlike(CONTINUES)
    out = out.withColumn("_takes", takes).withColumn("text", F.when(F.col("_takes"), F.concat("text", F.lit("Judge)"))).otherwise(F.col("text")))
    ends = F.lit(ai) & F.col("text").rlike(r"(?<![A-Za-z0-9])Al\z") & F.col("_next").startswith("の実務経験")
    out = out.withColumn("_ends", ends).withColumn("text", F.when(F.col("_ends"), F.regexp_replace("text", r"Al\z", "AI")).otherwise(F.col("text")))
    more = as_map([("split LLM-as-a-/J udge -> LLM-as-a-Judge", F.col("_takes")), ("Al -> AI (before next-line の実務経験)", F.col("_ends"))])
    out = out.withColumn("corrections", F.when(F.col("removed"), F.expr(EMPTY)).otherwise(F.map_concat("corrections", more)))
    if PROFILE in own:
        out = correct_in_context(out, BOOK_CONTEXT, "_prev", "_next")
    word = F.struct(F.col("text").alias("text"), "left", "top", "right", "bottom", mean_confidence().alias("confidence"))
    out = out.withColumn("words", F.when(F.col("removed"), F.expr("slice(words, 1, 0)")).when(F.size("corrections") > 0, F.array(word)).otherwise(F.col("words")))
    return out.withColumn("text", F.when(F.col("removed"), F.col("_own")).otherwise(F.col("text"))).drop("_prev", "_next", "_own", "_takes", "_ends")


def correction_totals(corrected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, name, count): corrections added up."""
    return corrected.select(*(by or []), F.explode("corrections").alias("name", "n")).groupBy(*(by or []), "name").agg(F.sum("n").alias("count"))


def review_reasons(measured: DataFrame, rules: Iterable[Review] = LINE_REVIEWS, profiles: Iterable[str] | None = None) -> DataFrame:
    """measured lines (text, confidence, suspicious_ratio) with reasons, sorted and distinct, why each should be looked at."""
    own = active(rules, profiles)
    known = F.regexp_extract("text", r"(?U)\b([A-Z]{1,4})[,.:;]?$", 1).isin(*KNOWN_ACRONYMS)
    hits = [F.when(F.col("text").rlike(r.pattern) & (~known if r.reason == "mixed_script_ending" else F.lit(True)), F.lit(r.reason)) for r in own]
    shaky = (F.col("confidence") < 0.48) & F.col("text").rlike(f"[{JAPANESE}]") & ((F.regexp_count("text", F.lit(r"(?U)\b[A-Z]{2,}\b")) >= 2) | (F.col("suspicious_ratio") >= 0.12))
    # Compared before sorting: most lines have no reason.
    found = F.array_compact(F.array(*hits, F.when(shaky, F.lit("low_confidence_mixed_script"))))
    return once(measured, _found=found).withColumn("reasons", F.when(F.size("_found") == 0, F.col("_found")).otherwise(F.sort_array(F.array_distinct("_found")))).drop("_found")


def review_candidates(measured: DataFrame, rules: Iterable[Review] = LINE_REVIEWS, profiles: Iterable[str] | None = None) -> DataFrame:
    return review_reasons(measured, rules, profiles).where((F.size("reasons") > 0) & (F.size("words") > 0))


def page_candidates(pages: DataFrame, rules: Iterable[Review] = PAGE_REVIEWS, profiles: Iterable[str] | None = None, around: int = 60) -> DataFrame:
    """(book, page, rule, nth, match, reason, context): each match of each active rule in each page's text, with up to `around`
    characters on both sides. rule is the rule's place among the active ones."""
    own = active(rules, profiles)
    found = None
    for i, r in enumerate(own):
        hits = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        part = pages.where(F.col("text").rlike(r.pattern)).select("book", "page", "text", F.split("text", r.pattern, -1).alias("rest"), hits.alias("hits"))
        part = part.select("book", "page", "text", F.lit(i).alias("rule"), F.lit(r.reason).alias("reason"), "rest", "hits", F.posexplode("hits").alias("nth", "match"))
        length = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda x, y: x + F.length(y))
        part = part.withColumn("start", length("rest", F.col("nth") + 1) + length("hits", F.col("nth")))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return pages.sparkSession.createDataFrame([], "book string, page int, rule int, nth int, match string, reason string, context string")
    low = F.greatest(F.lit(0), F.col("start") - around)
    context = squeeze(F.substring("text", low + 1, F.col("start") + F.length("match") + around - low))
    return found.select("book", "page", "rule", "nth", "match", "reason", context.alias("context"))
