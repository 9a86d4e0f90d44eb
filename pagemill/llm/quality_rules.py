"""Quality rules whose thresholds follow quantile sketches of each language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import column, pieces, raw_texts, text_hash, written

#: Whole numbers measured on each text, and the name, numerator, denominator, scale, side and least slack of each rule.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
RULES = (
    ("word_length", "word_chars", "n_words", 100, "both", 150),
    ("symbols", "n_symbols", "n_words", 1000, "high", 100),
    ("dup_lines", "n_dup_lines", "n_lines", 1000, "high", 250),
    ("repeat_words", "n_repeat_words", "n_words", 1000, "high", 250),
    ("upper", "n_upper", "word_chars", 1000, "high", 200),
    ("marks", "n_marks", "n_words", 1000, "high", 200),
)
SPREADS, LEAST = 6, 100
SYMBOLS, SPACES, MARKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c", b"!?"
UPPER = np.zeros(256, np.int64)
UPPER[ord("A") : ord("Z") + 1] = 1


def measure(raw: bytes | None) -> tuple[int, ...]:
    """COUNTS of a text's UTF-8 bytes. Words end at ASCII white space; a line counts if it has a word."""
    raw = raw or b""
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    chars = len(raw) - int(by[0x80:0xC0].sum()) - int(by[list(SPACES)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        seen = set(zip(words, words[1:], words[2:], strict=False))
        if len(seen) < n - 2:
            counts = Counter(zip(words, words[1:], words[2:], strict=False))
            twice = np.zeros(n + 2, bool)
            twice[2:n] = [counts[t] > 1 for t in zip(words, words[1:], words[2:], strict=False)]
            repeats = int((twice[:n] | twice[1 : n + 1] | twice[2 : n + 2]).sum())
    return n, chars, int(by[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeats, len(lines), int(by @ UPPER), int(by[list(MARKS)].sum())


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text_hash, *COUNTS), one row per row of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 512):
            found = np.array([measure(x) for x in raw_texts(b)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in kept), *(pa.array(x) for x in np.ascontiguousarray(found.T))], [*kept, *COUNTS])

    kept = ["doc_id", "lang", "source", "text_hash"]
    own = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text_hash().alias("text_hash"), "text")
    return own.mapInArrow(count, "doc_id long, lang string, source string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS))


def bucket(v: Column) -> Column:
    """Least whole number that shares v's five leading bits, so that a bucket is at most 1/16 wide of what it holds."""
    low = F.greatest(F.lit(0), F.length(F.bin(v)) - 5)
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(stats: DataFrame) -> DataFrame:
    """(lang_tag, source_tag, rule, bucket, n): a quantile sketch for each group and rule. Sketches of groups merge by
    adding the n of like buckets, whatever the order."""
    values = F.array(*(F.struct(F.lit(name).alias("rule"), F.floor(F.col(a) * scale / F.greatest(F.lit(1), F.col(b))).cast("long").alias("v")) for name, a, b, scale, *_ in RULES))
    each = stats.select("lang_tag", "source_tag", F.explode(values).alias("x"))
    return each.groupBy("lang_tag", "source_tag", F.col("x.rule").alias("rule"), bucket(F.col("x.v")).alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str], spreads: float = SPREADS) -> DataFrame:
    """keys, docs and low_ and high_ of each rule: the median less or plus `spreads` times its distance from the quartile
    on that side, or the rule's slack if that is more."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumn("up_to", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("all") * q, F.col("bucket")))  # noqa: E731
    quartiles = ranked.groupBy(*keys, "rule").agg(F.first("all").alias("docs"), *(at(q).alias(f"q{q}") for q in (1, 2, 3)))
    slack = F.element_at(F.create_map(*(F.lit(x) for name, *_, least in RULES for x in (name, least))), F.col("rule"))
    reach = lambda d: F.greatest(slack, spreads * d)  # noqa: E731
    quartiles = quartiles.withColumn("high", F.col("q2") + reach(F.col("q3") - F.col("q2"))).withColumn("low", F.col("q2") - reach(F.col("q2") - F.col("q1")))
    pick = [F.max(F.when(F.col("rule") == name, F.col(side))).alias(f"{side}_{name}") for name, *_ in RULES for side in ("low", "high")]
    return quartiles.groupBy(*keys).agg(F.max("docs").alias("docs"), *pick)


def judge(docs: DataFrame, spreads: float = SPREADS, least: int = LEAST) -> DataFrame:
    """(doc_id, lang, source, text_hash, *COUNTS, base_failed, kept, failed_rules), one row per row of docs (doc_id, text, lang,
    source; other columns are ignored).

    base_failed: under 50 words, or over half of them in three-word windows that recur in the text. Every other
    document goes into its language's and source's sketch and is kept if each rule's value lies within the group's
    fences. A group of fewer than `least` documents is judged by the merged sketch of its language, or of all languages if
    that has as few. A null lang or source is a group of its own; null and empty texts have no words and fail.
    Repeated rows count each. An empty table gives no rows.
    """
    tag = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-")).alias(f"{c}_tag")  # noqa: E731
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(measured(docs), "stats").select("*", tag("lang"), tag("source"), failed.alias("base_failed"))
    sketch = written(sketches(stats.where("not base_failed")), "sketches")
    per = fences(sketch, ["lang_tag", "source_tag"], spreads)
    per_lang = fences(sketch, ["lang_tag"], spreads)
    over_all = fences(sketch.withColumn("every", F.lit(0)), ["every"], spreads)
    sides = [f"{side}_{name}" for name, *_ in RULES for side in ("low", "high")]
    named = lambda df, p, keys: df.select(*keys, *(F.col(c).alias(f"{p}{c}") for c in ("docs", *sides)))  # noqa: E731
    limits = named(per, "a_", ["lang_tag", "source_tag"]).join(named(per_lang, "b_", ["lang_tag"]), "lang_tag").withColumn("every", F.lit(0)).join(F.broadcast(named(over_all, "c_", ["every"])), "every")  # one row
    limits = limits.select("lang_tag", "source_tag", *(F.when(F.col("a_docs") >= least, F.col(f"a_{c}")).when(F.col("b_docs") >= least, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}")).alias(c) for c in sides))
    joined = stats.join(written(limits, "limits"), ["lang_tag", "source_tag"], "left")
    broken = []
    for name, a, b, scale, side, _ in RULES:
        v = F.floor(F.col(a) * scale / F.greatest(F.lit(1), F.col(b)))
        bad = v > F.col(f"high_{name}")
        if side == "both":
            bad = bad | (v < F.col(f"low_{name}"))
        broken.append(F.when(bad & ~F.col("base_failed"), F.lit(name)))
    joined = joined.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    return joined.select("doc_id", "lang", "source", "text_hash", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def sql(spreads: float = SPREADS, least: int = LEAST) -> str:
    """What op6 returns, as DuckDB's SQL."""
    values = ", ".join(f"('{name}', {a} * {scale} // greatest(1, {b}))" for name, a, b, scale, *_ in RULES)
    slack = "CASE rule " + " ".join(f"WHEN '{name}' THEN {least_}" for name, *_, least_ in RULES) + " END"
    fence = lambda keys: f"""SELECT {keys}, rule, "all" AS docs, q2 + greatest({slack}, {spreads} * (q3 - q2)) AS high, q2 - greatest({slack}, {spreads} * (q2 - q1)) AS low
FROM (SELECT {keys}, rule, any_value("all") AS "all", {", ".join(f"min(CASE WHEN up_to * 4 >= {q} * \"all\" THEN bucket END) AS q{q}" for q in (1, 2, 3))} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, rule ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {keys}, rule) AS "all" FROM (SELECT {keys}, rule, bucket, count(*) AS n FROM good GROUP BY ALL)) GROUP BY ALL)"""  # noqa: E731
    both = "'" + "', '".join(name for name, _, _, _, side, _ in RULES if side == "both") + "'"
    order = "CASE x.rule " + " ".join(f"WHEN '{name}' THEN {i}" for i, (name, *_) in enumerate(RULES)) + " END"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS lang_tag, coalesce('=' || source, '-') AS source_tag, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
tw AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rp AS (SELECT r, count(DISTINCT i + j) AS n FROM tw, range(3) q(j) GROUP BY r),
m AS (SELECT w.r, doc_id, lang_tag, source_tag, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks FROM w LEFT JOIN rp USING (r)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT r, lang_tag, source_tag, x.rule, x.v FROM (SELECT *, unnest([{", ".join("{'rule': " + part[1:].split(",")[0] + ", 'v': " + part[:-1].split(", ", 1)[1] + "}" for part in values.replace("), (", ")@(").split("@"))}]) AS x FROM s WHERE NOT base_failed)),
good AS (SELECT *, (v >> greatest(0, length(bin(v)) - 5)) << greatest(0, length(bin(v)) - 5) AS bucket, 0 AS every FROM v),
fa AS ({fence("lang_tag, source_tag")}), fb AS ({fence("lang_tag")}), fc AS ({fence("every")}),
b AS (SELECT v.r, x.rule, {order} AS nth FROM v JOIN fa x USING (lang_tag, source_tag, rule) JOIN fb USING (lang_tag, rule) JOIN fc USING (rule)
WHERE v.v > CASE WHEN x.docs >= {least} THEN x.high WHEN fb.docs >= {least} THEN fb.high ELSE fc.high END OR (rule IN ({both}) AND v.v < CASE WHEN x.docs >= {least} THEN x.low WHEN fb.docs >= {least} THEN fb.low ELSE fc.low END)),
f AS (SELECT r, string_agg(rule, ',' ORDER BY nth) AS failed FROM b GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules FROM s LEFT JOIN f USING (r)"""
