"""One registered query per operator family over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions.numbers import sql_rounded
from pagemill.functions.rules import Correction, Review
from pagemill.operators import books, corrections, layout, lines, pixels, reports
from pagemill.plans import corpus, pages
from pagemill.plans.corpus import SQL_LINES, SQL_PAGES, SQL_TALKS
from pagemill.sources import readers
from pagemill.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


ARRAYS = SQL_PAGES + r""", a0 AS (SELECT book, page, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS a0 FROM p),
a AS (SELECT book, page, CASE WHEN a0[-1] = '' THEN a0[1:len(a0) - 1] ELSE a0 END AS a FROM a0)"""
NUMBER = r"'[\s\-–—―]*\d+[\s\-–—―]*'"
EDGES = ARRAYS + f""", c AS (SELECT DISTINCT book, page, unnest(list_concat(a[1:2], a[greatest(1, len(a) - 1):len(a)])) AS line FROM a),
r AS (SELECT book, line, count(*) AS pages FROM c WHERE length(line) BETWEEN 4 AND 80 AND NOT regexp_full_match(line, {NUMBER}) GROUP BY ALL HAVING count(*) >= 2)"""
JOINED = r"""regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(array_to_string(list_filter(a, lambda x: NOT regexp_full_match(x, """ + NUMBER + r""")), chr(10)), '-\n([A-Za-z])', '\1', 'g'), '\n\n+', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)), '^\n+', ''), '\n+$', '')"""


# --- books -----------------------------------------------------------------------------------------------------------
@query(f"WITH {EDGES} SELECT * FROM r")
def repeated_edges(spark, sf_dir):
    return books.repeated_edges(corpus.pages(spark, sf_dir))


@query(f"""WITH {EDGES}, i AS (SELECT book, page, len(a) AS n, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line FROM a),
k AS (SELECT i.* FROM i LEFT JOIN r USING (book, line) WHERE r.book IS NULL OR (i >= 2 AND i < greatest(0, n - 2)))
SELECT a.book, a.page, coalesce(t, '') AS text FROM a LEFT JOIN (SELECT book, page, string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY ALL) USING (book, page)""")
def drop_repeated_edges(spark, sf_dir):
    return books.drop_repeated_edges(corpus.pages(spark, sf_dir))


@query(f"WITH {ARRAYS} SELECT book, page, {JOINED} AS text FROM a")
def join_wrapped_lines(spark, sf_dir):
    return corpus.pages(spark, sf_dir).withColumn("text", books.join_wrapped_lines("text"))


@query(f"WITH {ARRAYS} SELECT book, page, array_to_string(a, chr(10)) AS text FROM a")
def drop_spurious_blanks(spark, sf_dir):
    return corpus.pages(spark, sf_dir).withColumn("text", books.drop_spurious_blanks("text"))


JPC = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}、。，．・：；！？「」『』（）［］【】〈〉《》〔〕｛｝]"


@query(rf"""WITH {SQL_TALKS}, j AS (SELECT book, page, replace(replace(replace(text, 'th', 'の'), ',', '、'), 'e', '読 ') AS text FROM p)
SELECT book, page, regexp_replace(regexp_replace(text, '({JPC})[ \t]+({JPC})', '\1\2', 'g'), '({JPC})[ \t]+({JPC})', '\1\2', 'g') AS text FROM j""")
def collapse_cjk_spaces(spark, sf_dir):
    mapped = F.replace(F.replace(F.replace("text", F.lit("th"), F.lit("の")), F.lit(","), F.lit("、")), F.lit("e"), F.lit("読 "))
    return corpus.talks(spark, sf_dir).withColumn("text", tx.collapse_japanese_spaces(mapped))


@query(f"WITH {SQL_PAGES} SELECT book, page FROM p WHERE page NOT IN (1, 2, 3, 7, 10, 11, 12)")
def skip_pages(spark, sf_dir):
    numbers = spark.range(1).select(tx.page_numbers(F.lit("1-3, 7,10-12"))).first()[0]
    return books.skip_pages(corpus.pages(spark, sf_dir).select("book", "page"), numbers)


@query("""SELECT event_id, list_sort(list_distinct(flatten(list_transform(string_split(spec, ','), lambda q: CASE WHEN contains(q, '-') THEN range(CAST(split_part(q, '-', 1) AS INT), CAST(split_part(q, '-', 2) AS INT) + 1) ELSE [CAST(q AS BIGINT)] END)))) AS numbers
FROM (SELECT event_id, (user_id + 1) || '-' || (user_id + 1 + event_id % 4) || ',' || (event_id % 9 + 1) AS spec FROM events)""")
def page_ranges(spark, sf_dir):
    spec = F.concat((F.col("user_id") + 1).cast("string"), F.lit("-"), (F.col("user_id") + 1 + F.col("event_id") % 4).cast("string"), F.lit(","), (F.col("event_id") % 9 + 1).cast("string"))
    return corpus.table(spark, sf_dir, "events").select("event_id", tx.page_numbers(spec).cast("array<bigint>").alias("numbers"))


@query(f"WITH {SQL_TALKS} SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY book) = 1 OR page < max(page) OVER (PARTITION BY book)")
def exclude_last_page(spark, sf_dir):
    return books.exclude_last_page(corpus.talks(spark, sf_dir))


TALK_ARRAYS = ARRAYS.replace(SQL_PAGES, SQL_TALKS + ", p0 AS (SELECT 1)")
TALK_EDGES = EDGES.replace(SQL_PAGES, SQL_TALKS + ", p0 AS (SELECT 1)")


@query(rf"""WITH {TALK_EDGES}, i AS (SELECT book, page, len(a) AS n, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line FROM a),
k AS (SELECT i.* FROM i LEFT JOIN r USING (book, line) WHERE r.book IS NULL OR (i >= 2 AND i < greatest(0, n - 2))),
d AS (SELECT book, page, list(line ORDER BY i) AS a FROM k GROUP BY ALL), t AS (SELECT book, page, {JOINED} AS text FROM d),
b AS (SELECT book, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM t WHERE text <> '' GROUP BY book)
SELECT x.book, coalesce(regexp_replace(b.text, '^\s+|\s+$', '', 'g') || chr(10), '') AS text FROM (SELECT DISTINCT book FROM p) x LEFT JOIN b USING (book)""")
def book_text(spark, sf_dir):
    whole = books.join_pages(corpus.talks(spark, sf_dir), "\f")
    return books.book_text(whole)


TITLES = rf"""{TALK_ARRAYS}, f AS (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY page) - 1 AS nth FROM p),
q0 AS (SELECT a.book, f.nth, list_filter(list_transform(a, lambda x: regexp_replace(x, '\s+', ' ', 'g')), lambda x: x <> '') AS a FROM a JOIN f USING (book, page) WHERE nth < 5),
q AS (SELECT book, nth, len(a) AS n, len(list_filter(a, lambda x: regexp_matches(x, '(?:著|作者|訳|編|監修|出版社|出版)\s*$'))) > 0 AS credit, a[1:20] AS b FROM q0),
e AS (SELECT book, nth, n, credit, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS raw FROM q),
s AS (SELECT *, regexp_replace(raw, '^[『』「」【】\[\] ]+|[『』「」【】\[\] ]+$', '', 'g') AS line FROM e),
c AS (SELECT *, length(line) AS z FROM s WHERE length(line) BETWEEN 2 AND 80 AND NOT regexp_matches(line, '(?i)^(?:第[0-9０-９一二三四五六七八九十百]+[章節部]|序章|終章|目次)$') AND NOT regexp_matches(line, '(?i)^(?:chapter|contents|目次)\s*[0-9０-９]*$') AND NOT regexp_matches(line, '(?i)^(?:https?://|www\.)') AND NOT regexp_matches(line, '^[0-9０-９\s./-]+$') AND NOT (length(line) > 30 AND regexp_matches(line, '[。！？!?]$'))),
v AS (SELECT *, 5.0::DOUBLE - least(nth, 4) * 0.75::DOUBLE + greatest(0.0::DOUBLE, 2.0::DOUBLE - i * 0.2::DOUBLE) + CASE WHEN z BETWEEN 4 AND 40 THEN 2.0 WHEN z > 60 THEN -2.0 ELSE 0.0 END::DOUBLE + CASE WHEN n <= 8 THEN 1.5 ELSE 0.0 END::DOUBLE + CASE WHEN regexp_matches(raw, '[『』【】]') THEN 1.0 ELSE 0.0 END::DOUBLE - CASE WHEN regexp_matches(line, '(?:著|作者|訳|出版社|出版)$') THEN 3.0 ELSE 0.0 END::DOUBLE AS score, credit OR regexp_matches(raw, '[『』【】]') AS evidence FROM c),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY book ORDER BY score DESC, nth, i) = 1),
t AS (SELECT book, regexp_replace(regexp_replace(regexp_replace(line, '[\x00-\x1f\x7f<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS title, CASE WHEN evidence THEN 1.0 ELSE 0.75 END::DOUBLE AS most, greatest(0.0, least(1.0, (score - 4.0) / 7.0)) AS conf FROM w)"""


@query(f"WITH {TITLES} SELECT x.book, coalesce(title, '') AS title, CASE WHEN coalesce(title, '') = '' THEN 0.0 ELSE least(conf, most) END AS confidence FROM (SELECT DISTINCT book FROM p) x LEFT JOIN t USING (book)")
def title_inference(spark, sf_dir):
    return books.infer_titles(corpus.talks(spark, sf_dir), compose=False)


@query(r"""SELECT page_id, regexp_replace(CASE WHEN strlen(t) <= 60 THEN t ELSE substr(t, 1, 60) END, '[ .]+$', '') AS name
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || '?q="' || page_id || '" . ', '[\x00-\x1f\x7f<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS t FROM pages)""")
def sanitize_filename(spark, sf_dir):
    name = F.concat("url", F.lit('?q="'), F.col("page_id").cast("string"), F.lit('" . '))
    return corpus.table(spark, sf_dir, "pages").select("page_id", tx.safe_filename(name, 60).alias("name"))


@query("""WITH n AS (SELECT n_nationkey, n_name AS title FROM nation), taken AS (SELECT n_name || CASE n_nationkey % 4 WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '（2）.pdf' END AS name FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_name || '（2）.txt' FROM nation WHERE n_nationkey % 8 = 1)
SELECT n_nationkey AS book, CASE WHEN NOT EXISTS (SELECT 1 FROM taken WHERE name IN (title || '.pdf', title || '.txt')) THEN title WHEN NOT EXISTS (SELECT 1 FROM taken WHERE name IN (title || '（2）.pdf', title || '（2）.txt')) THEN title || '（2）' ELSE title || '（3）' END AS name FROM n""")
def collision_free_name(spark, sf_dir):
    nation = corpus.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    first = nation.where(key % 4 != 0).select(F.concat("n_name", F.when(key % 4 == 1, ".pdf").when(key % 4 == 2, ".txt").otherwise("（2）.pdf")).alias("name"))
    taken = first.unionByName(nation.where(key % 8 == 1).select(F.concat("n_name", F.lit("（2）.txt")).alias("name")))
    return books.exclusive_names(nation.select(key.alias("book"), F.col("n_name").alias("title")), taken, [".pdf", ".txt"])


@query("SELECT path, list_sort(list(DISTINCT label)) AS labels FROM (SELECT '/out/' || o_custkey AS path, o_orderpriority AS label FROM orders) GROUP BY path HAVING count(DISTINCT label) > 1")
def path_collisions(spark, sf_dir):
    own = corpus.table(spark, sf_dir, "orders").select(F.concat(F.lit("/out/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("label"))
    return books.path_collisions(own)


# --- lines -----------------------------------------------------------------------------------------------------------
def measured(spark, sf_dir):
    return lines.line_metrics(corpus.lines(spark, sf_dir))


PAGE_METRICS = SQL_LINES + """,
g AS (SELECT book, page, count(*) AS line_count, sum(characters)::BIGINT AS character_count, coalesce(sum(CASE WHEN characters > 0 THEN CAST(confidence * 100 AS BIGINT) END)::DOUBLE / 100.0::DOUBLE / count(CASE WHEN characters > 0 THEN 1 END)::DOUBLE, 0.0) AS mean, coalesce(sum(CAST(suspicious_ratio * characters AS BIGINT))::DOUBLE / nullif(sum(characters), 0)::DOUBLE, 1.0) AS odd FROM m GROUP BY book, page),
pm AS (SELECT book, page, line_count, character_count, """ + sql_rounded("mean", 2) + """ AS mean_confidence, """ + sql_rounded("odd", 4) + """ AS suspicious_ratio, """ + sql_rounded("greatest(0.0, least(100.0, 100 * mean + least(8.0, character_count / 80.0) - 25 * odd))", 2) + """ AS score FROM g)"""


@query(f"WITH {SQL_LINES} SELECT book, page, line_no, text, characters, confidence, round(suspicious_ratio, 6) AS suspicious_ratio FROM m")
def line_metrics(spark, sf_dir):
    return measured(spark, sf_dir).select("book", "page", "line_no", "text", "characters", "confidence", F.round("suspicious_ratio", 6).alias("suspicious_ratio"))


@query(f"WITH {PAGE_METRICS} SELECT * FROM pm")
def page_metrics(spark, sf_dir):
    return lines.page_metrics(measured(spark, sf_dir)).select("book", "page", "line_count", "character_count", "mean_confidence", "suspicious_ratio", "score")


@query("""WITH g AS (SELECT doc_id AS page, len(string_split(text, chr(10))) AS line_count, length(text) AS character_count, (doc_id * 37 % 100) / 100.0 AS mean_confidence, (doc_id * 11 % 30) / 100.0 AS suspicious_ratio FROM documents)
SELECT page, mean_confidence < 0.78 OR suspicious_ratio > 0.12 OR (line_count <= 15 AND character_count < 220) AS retry, CASE WHEN line_count <= 18 OR character_count < 260 THEN 11 ELSE 3 END AS alternate_mode FROM g""")
def retry_decision(spark, sf_dir):
    own = corpus.pages(spark, sf_dir).select("page", F.size(F.split("text", "\n")).alias("line_count"), F.length("text").alias("character_count"), (F.col("page") * 37 % 100 / 100.0).alias("mean_confidence"), (F.col("page") * 11 % 30 / 100.0).alias("suspicious_ratio"))
    return lines.retry_decision(own).select("page", "retry", "alternate_mode")


@query("""SELECT source AS book, doc_id AS page, CASE WHEN doc_id % 3 > 0 AND b > a + 1 THEN 'alternate' ELSE 'primary' END AS chosen, CASE WHEN doc_id % 3 > 0 AND b > a + 1 THEN b ELSE a END AS score
FROM (SELECT *, CAST(doc_id * 13 % 50 AS DOUBLE) AS a, CAST(doc_id * 7 % 50 AS DOUBLE) AS b FROM documents)""")
def best_pass(spark, sf_dir):
    own = corpus.pages(spark, sf_dir)
    first = own.select("book", "page", (F.col("page") * 13 % 50).cast("double").alias("score"))
    second = own.where("page % 3 > 0").select("book", "page", (F.col("page") * 7 % 50).cast("double").alias("score"))
    return lines.best_pass(first, second)


@query("""SELECT doc_id, "c" AS confidence, nth FROM (SELECT doc_id, n AS nth, (doc_id * 7 + n * n * 5) % 11 / 16.0 AS c FROM documents, range(4) r(n)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, nth) = 1""")
def best_retry_line(spark, sf_dir):
    tries = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("nth"))
    return lines.best_retry_line(tries.withColumn("confidence", (F.col("doc_id") * 7 + F.col("nth") * F.col("nth") * 5) % 11 / 16.0), ["doc_id"])


@query("""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other, (turn * 29 + conv_id * 3) % 64 / 64.0 AS c1, (turn * 13 + conv_id * 11) % 64 / 64.0 AS c2 FROM conversations)
SELECT conv_id, turn, c2 >= greatest(0.72, c1 + 0.08) AND NOT contains(other, 'idiot') AND regexp_matches(other, '[A-Za-z0-9]') AND length(other) / greatest(1, length(text)) BETWEEN 0.45 AND 2.2 AS accepted FROM t WHERE other IS NOT NULL""")
def accept_line_retry(spark, sf_dir):
    from pyspark.sql import Window

    t = corpus.talks(spark, sf_dir)
    own = t.select("book", "page", F.col("text").alias("original_text"), F.lead("text").over(Window.partitionBy("book").orderBy("page")).alias("text"), ((F.col("page") * 29 + F.col("book") * 3) % 64 / 64.0).alias("original_confidence"), ((F.col("page") * 13 + F.col("book") * 11) % 64 / 64.0).alias("confidence")).where("text is not null")
    own = own.withColumn("suspicious_ratio", F.lit(0.0))
    reviewed = corrections.review_reasons(own, [Review("common", "bad_word", "idiot")])
    return lines.accept_line_retry(reviewed).select(F.col("book").alias("conv_id"), F.col("page").alias("turn"), "accepted")


@query(f"""WITH {SQL_LINES}, h AS (SELECT *, median(CASE WHEN bottom > "top" THEN bottom - "top" END) OVER (PARTITION BY book, page) AS typical, count(*) OVER (PARTITION BY book, page) AS n, lag(bottom) OVER o AS before, lead("top") OVER o AS after FROM m WINDOW o AS (PARTITION BY book, page ORDER BY "top", block_no, line_no)),
x AS (SELECT *, least(greatest(0, "top" - before), greatest(0, after - bottom)) AS gap FROM h)
SELECT book, page, line_no, confidence < 0.48 AND characters BETWEEN 1 AND 40 AND suspicious_ratio >= 0.18 AND NOT regexp_full_match(text, {NUMBER}) AND (n <= 18 OR coalesce(gap > 1.8 * coalesce(typical, 1.0), false)) AS removed FROM x""")
def low_confidence_filter(spark, sf_dir):
    return lines.low_confidence(measured(spark, sf_dir)).select("book", "page", "line_no", "removed")


@query(f"""WITH {SQL_LINES}, b AS (SELECT *, min("top") OVER w AS bt, min("left") OVER w AS bl FROM l WINDOW w AS (PARTITION BY book, page, block_no))
SELECT book, page, line_no, row_number() OVER (PARTITION BY book, page ORDER BY bt, bl, block_no, "top", "left", line_no) - 1 AS place,
row_number() OVER (PARTITION BY book, page, block_no ORDER BY "top", "left", line_no) <> row_number() OVER (PARTITION BY book, page, block_no ORDER BY line_no) OR dense_rank() OVER (PARTITION BY book, page ORDER BY bt, bl, block_no) <> dense_rank() OVER (PARTITION BY book, page ORDER BY block_no) AS moved FROM b""")
def reading_order(spark, sf_dir):
    return lines.reading_order(corpus.lines(spark, sf_dir)).select("book", "page", "line_no", "place", "moved")


@query(f"""WITH {SQL_LINES} SELECT book, page, line_no, row_number() OVER (PARTITION BY book, page ORDER BY floor("top" / 80.0), "left" DESC, block_no, line_no) - 1 AS place FROM l""")
def manga_order(spark, sf_dir):
    return lines.manga_order(corpus.lines(spark, sf_dir)).select("book", "page", "line_no", "place")


@query()
def merge_dedupe(spark, sf_dir):
    return lines.merge_dedupe(measured(spark, sf_dir).withColumnRenamed("line_no", "place"))


@query(f"WITH {SQL_LINES} SELECT book, page, line_no, text, list_min(cs) AS confidence FROM l WHERE len(cs) > 0 AND NOT regexp_full_match(text, {NUMBER})")
def merge_words(spark, sf_dir):
    out = lines.merge_words(corpus.lines(spark, sf_dir))
    return out.select("book", "page", "line_no", F.col("words")[0]["text"].alias("text"), F.col("words")[0]["confidence"].alias("confidence"))


@query(f"WITH {SQL_LINES} SELECT book, page, coalesce(regexp_replace(string_agg(text, chr(10) ORDER BY line_no) FILTER (text <> '' AND NOT regexp_full_match(text, {NUMBER})), '^\\s+|\\s+$', '', 'g'), '') AS text FROM l GROUP BY book, page")
def page_text(spark, sf_dir):
    return lines.page_text(measured(spark, sf_dir), "line_no")


# --- corrections -----------------------------------------------------------------------------------------------------
TEST_RULES = (Correction("common", "the -> The", r"\bthe\b", "The"), Correction("common", "an of -> of", "an of", "of"), Correction("other", "never", "e", "X"), Correction("common", "digits", r"[0-9]+", "#"))
RULES_SQL = r"""c1 AS (SELECT *, len(regexp_extract_all(text, '\bthe\b')) AS n1, regexp_replace(text, '\bthe\b', 'The', 'g') AS t1 FROM p),
c2 AS (SELECT *, len(regexp_extract_all(t1, 'an of')) AS n2, regexp_replace(t1, 'an of', 'of', 'g') AS t2 FROM c1),
c AS (SELECT book, page, n1, n2, len(regexp_extract_all(t2, '[0-9]+')) AS n3, regexp_replace(t2, '[0-9]+', '#', 'g') AS text FROM c2)"""


@query(f"WITH {SQL_PAGES}, {RULES_SQL} SELECT book, page, text, n1 AS n_the, n2 AS n_of, n3 AS n_digits FROM c")
def rule_corrections(spark, sf_dir):
    out = corrections.correct(corpus.pages(spark, sf_dir), TEST_RULES)
    count = lambda name: F.coalesce(F.col("corrections")[name], F.lit(0)).cast("bigint")
    return out.select("book", "page", "text", count("the -> The").alias("n_the"), count("an of -> of").alias("n_of"), count("digits").alias("n_digits"))


@query(f"""WITH {SQL_PAGES}, {RULES_SQL} SELECT * FROM (SELECT book, 'the -> The' AS name, sum(n1)::BIGINT AS "count" FROM c GROUP BY book UNION ALL SELECT book, 'an of -> of', sum(n2)::BIGINT FROM c GROUP BY book UNION ALL SELECT book, 'digits', sum(n3)::BIGINT FROM c GROUP BY book) WHERE "count" > 0""")
def correction_totals(spark, sf_dir):
    return corrections.correction_totals(corrections.correct(corpus.pages(spark, sf_dir), TEST_RULES), ["book"])


@query(rf"""WITH {SQL_LINES.replace("string_split(text, chr(10)) AS a", "string_split(replace(replace(text, ' thth', chr(10) || 'J udge)'), ' and', ' LLM-as-a-' ), chr(10)) AS a")}, o AS (SELECT *, lag(text) OVER w AS prev, lead(text) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY book, page ORDER BY block_no, line_no)),
r AS (SELECT *, coalesce(prev LIKE '%LLM-as-a-', false) AND regexp_full_match(text, 'J\s+udge\)') AS removed FROM o),
j AS (SELECT *, CASE WHEN removed THEN text ELSE regexp_replace(regexp_replace(text, '(^|[^A-Za-z])J\s+udge\b', '\1Judge', 'g'), '(^|[^A-Za-z])J\s+udge\b', '\1Judge', 'g') END AS fixed FROM r)
SELECT book, page, line_no, removed, CASE WHEN NOT removed AND fixed LIKE '%LLM-as-a-' AND coalesce(regexp_full_match(nxt, 'J\s+udge\)'), false) THEN fixed || 'Judge)' ELSE fixed END AS text FROM j""")
def context_corrections(spark, sf_dir):
    changed = F.replace(F.replace("text", F.lit(" thth"), F.lit("\nJ udge)")), F.lit(" and"), F.lit(" LLM-as-a-"))
    own = corpus.table(spark, sf_dir, "documents").withColumn("text", changed)
    out = corrections.correct_lines(lines.line_metrics(_lines_of(own)), profiles=["ai-rag"])
    return out.select("book", "page", "line_no", "removed", "text")


def _lines_of(documents: DataFrame) -> DataFrame:
    """corpus.lines over changed documents."""
    held = corpus.table
    corpus.table = lambda spark, sf_dir, name: documents
    try:
        return corpus.lines(documents.sparkSession, "")
    finally:
        corpus.table = held


@query(rf"""WITH {SQL_LINES} SELECT book, page, line_no, list_sort(list_distinct(list_filter([CASE WHEN regexp_matches(text, '\[(?:=|[A-Za-z]{{1,3}})\]') THEN 'ocr_symbol_fragment' END, CASE WHEN regexp_matches(text, '\bidiot\b|###') THEN 'embedded_noise' END], lambda x: x IS NOT NULL))) AS reasons FROM m
WHERE len(cs) > 0 AND (regexp_matches(text, '\[(?:=|[A-Za-z]{{1,3}})\]') OR regexp_matches(text, '\bidiot\b|###'))""")
def review_candidates(spark, sf_dir):
    from pagemill.functions.rules import LINE_REVIEWS

    rules = (*LINE_REVIEWS, Review("common", "embedded_noise", r"\bidiot\b|###"))
    return corrections.review_candidates(measured(spark, sf_dir), rules).select("book", "page", "line_no", "reasons")


@query(r"""WITH s AS (SELECT source AS book, doc_id AS page, text, regexp_split_to_array(text, 'License') AS parts FROM documents WHERE contains(text, 'License')),
i AS (SELECT book, page, text, unnest(range(len(parts) - 1)) AS nth, parts FROM s),
o AS (SELECT book, page, text, nth, list_sum(list_transform(parts[1:nth + 1], lambda x: length(x))) + nth * 7 AS start FROM i)
SELECT book, page, CAST(nth AS INT) AS nth, 'License' AS "match", 'license' AS reason, regexp_replace(regexp_replace(substr(text, CAST(greatest(0, start - 60) + 1 AS BIGINT), CAST(start + 67 - greatest(0, start - 60) AS BIGINT)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS context FROM o""")
def post_ocr_candidates(spark, sf_dir):
    out = corrections.page_candidates(corpus.pages(spark, sf_dir), [Review("common", "license", "License")])
    return out.select("book", "page", "nth", "match", "reason", "context")


# --- layout ----------------------------------------------------------------------------------------------------------
REGIONS_SQL = """rg AS (SELECT source AS book, doc_id AS page, r AS region_no, 20.0 + r * 90 AS r_left, 50.0 + r * 200 AS r_top, 220.0 + r * 150 AS r_right, 260.0 + r * 220 AS r_bottom FROM documents, range(3) t(r))"""


def regions(spark, sf_dir):
    own = corpus.pages(spark, sf_dir).select("book", "page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("region_no"))
    r = F.col("region_no")
    return own.select("book", "page", "region_no", (20.0 + r * 90).alias("r_left"), (50.0 + r * 200).alias("r_top"), (220.0 + r * 150).alias("r_right"), (260.0 + r * 220).alias("r_bottom"))


INSIDE = """("left" + "right") / 2 BETWEEN r_left AND r_right AND ("top" + bottom) / 2 BETWEEN r_top AND r_bottom"""


@query(f"WITH {SQL_LINES}, {REGIONS_SQL} SELECT l.book, l.page, block_no, line_no, region_no FROM l JOIN rg USING (book, page) WHERE {INSIDE}")
def point_in_region(spark, sf_dir):
    return layout.in_regions(corpus.lines(spark, sf_dir), regions(spark, sf_dir))


KINDS_SQL = r"""k AS (SELECT *, (bottom - "top") / 1000.0 AS rh, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / greatest(1, length(regexp_replace(text, '\s', '', 'g'))) AS ar,
regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:import|from|def|class|return|const|let|var|function|export|interface|system\.out|print|async|await|SELECT|INSERT|UPDATE|DELETE|CREATE|SQL\s+DUMP|CODE\s+BASE)(?:$|[^A-Za-z0-9_])|=>|==|!=|</?[A-Za-z]|[{}]') AS code FROM m)"""


@query(rf"""WITH {SQL_LINES}, {REGIONS_SQL}, {KINDS_SQL}, f AS (SELECT *, code OR (ar >= 0.65 AND rh < 0.04) AS foul FROM k),
h AS (SELECT f.*, region_no FROM f JOIN rg USING (book, page) WHERE {INSIDE}), cl AS (SELECT book, page, region_no FROM h GROUP BY ALL HAVING NOT bool_or(foul)),
ins AS (SELECT DISTINCT book, page, line_no, true AS inside FROM h JOIN cl USING (book, page, region_no))
SELECT f.book, f.page, f.line_no, text = '' OR ((((rh >= 0.04 AND "right" - "left" >= 1.2 * (bottom - "top")) OR ("top" <= 200 AND rh >= 0.025) OR coalesce(inside, false))) AND NOT foul AND NOT (ar >= 0.65 AND NOT (rh >= 0.04 AND "right" - "left" >= 1.2 * (bottom - "top")))) AS kept FROM f LEFT JOIN ins USING (book, page, line_no)""")
def narrative_filter(spark, sf_dir):
    return layout.narrative_lines(measured(spark, sf_dir), regions(spark, sf_dir)).select("book", "page", "line_no", "kept")


@query(rf"""WITH {SQL_LINES} SELECT book, page, line_no, "top" <= 200 AND (bottom - "top") / 1000.0 >= 0.025 AND length(regexp_replace(text, '[^の]', '', 'g')) >= 2 AND length(text) <= 100 AS kept
FROM (SELECT * REPLACE (replace(text, 'the', 'の') AS text) FROM m)""")
def title_filter(spark, sf_dir):
    own = measured(spark, sf_dir).withColumn("text", F.replace("text", F.lit("the"), F.lit("の")))
    return layout.title_lines(own).select("book", "page", "line_no", "kept")


@query(f"""WITH {SQL_LINES}, mk AS (SELECT * FROM l), pr AS (SELECT mk.book, mk.page, mk.line_no, f.line_no AS f_line_no, f."left" - mk."right" + abs((f."top" + f.bottom) / 2 - (mk."top" + mk.bottom) / 2) AS d, abs((f."top" + f.bottom) / 2 - (mk."top" + mk.bottom) / 2) AS apart, mk.bottom - mk."top" AS h, f.bottom - f."top" AS fh, f.block_no AS fb
FROM (SELECT * REPLACE ("left" + 8 AS "right") FROM mk) mk JOIN l f ON mk.book = f.book AND mk.page = f.page AND mk.line_no <> f.line_no WHERE f."left" > mk."right"),
be AS (SELECT * FROM pr WHERE apart <= greatest(0.55 * h, 0.75 * fh) QUALIFY row_number() OVER (PARTITION BY book, page, line_no ORDER BY d, fb, f_line_no) = 1)
SELECT mk.book, mk.page, mk.line_no, f_line_no, d AS distance FROM mk LEFT JOIN be USING (book, page, line_no)""")
def nearest_follower(spark, sf_dir):
    own = corpus.lines(spark, sf_dir).drop("words")
    markers = own.withColumn("right", F.col("left") + 8)
    return layout.nearest_follower(markers, own).select("book", "page", "line_no", "f_line_no", "distance")


@query(f"""WITH {SQL_LINES}, c AS (SELECT book, page, line_no, ("left" + "right") / 2 AS x, bottom - "top" AS h, line_no % 2 = 0 AS box FROM l)
SELECT a.book, a.page, a.line_no, (SELECT count(*) FROM c b WHERE b.book = a.book AND b.page = a.page AND b.box AND abs(b.x - a.x) <= greatest(0.45 * a.h, 7.2)) AS aligned FROM c a""")
def aligned_markers(spark, sf_dir):
    own = corpus.lines(spark, sf_dir).withColumn("checkbox", F.col("line_no") % 2 == 0)
    return layout.aligned_markers(own).select("book", "page", "line_no", "aligned")


FLAGS_SQL = """fl AS (SELECT *, (page * 3 + line_no * 7) % 40 / 1024.0 AS saturated, (page + line_no * 5) % 64 / 512.0 AS dark, (page * 5 + line_no) % 64 / 128.0 AS nonwhite FROM m),
ty AS (SELECT *, (list(bottom - "top") OVER (PARTITION BY book, page)) AS hs FROM fl),
fg AS (SELECT *, list_sort(hs)[least(len(hs), len(hs) * 3 // 4 + 1)] AS typical FROM ty)"""


def flagged(spark, sf_dir):
    own = measured(spark, sf_dir)
    own = own.withColumn("saturated", (F.col("page") * 3 + F.col("line_no") * 7) % 40 / 1024.0).withColumn("dark", (F.col("page") + F.col("line_no") * 5) % 64 / 512.0).withColumn("nonwhite", (F.col("page") * 5 + F.col("line_no")) % 64 / 128.0)
    return layout.figure_flags(own)


@query(rf"""WITH {SQL_LINES}, {FLAGS_SQL}, cand AS (SELECT * FROM fg WHERE saturated >= 0.012 OR (dark >= 0.075 AND nonwhite >= 0.18) OR ((bottom - "top" >= 1.7 * typical OR (confidence < 0.62 AND characters <= 18)) AND "right" - "left" <= 480) OR (confidence < 0.78 AND characters <= 18 AND (saturated >= 0.005 OR regexp_matches(text, '[A-Za-z<>=@#$\\|]')))),
nw AS (SELECT *, coalesce(CAST("top" - lag(bottom) OVER o > greatest(5 * typical, 150) AS INT), 0) AS nw FROM cand WINDOW o AS (PARTITION BY book, page ORDER BY "top", block_no, line_no))
SELECT book, page, line_no, (sum(nw) OVER (PARTITION BY book, page ORDER BY "top", block_no, line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS group_no FROM nw""")
def figure_groups(spark, sf_dir):
    return layout.figure_groups(flagged(spark, sf_dir)).select("book", "page", "line_no", "group_no")


@query()
def figure_regions(spark, sf_dir):
    return layout.figure_regions(flagged(spark, sf_dir))


@query(f"""WITH {SQL_LINES}, {REGIONS_SQL} SELECT book, page, line_no, NOT EXISTS (SELECT 1 FROM rg WHERE rg.book = m.book AND rg.page = m.page AND region_no = 0 AND (("top" + bottom) / 2 BETWEEN r_top AND r_bottom OR (characters <= 6 AND suspicious_ratio >= 0.25 AND ("top" + bottom) / 2 BETWEEN r_top - 150 AND r_bottom + 150))) AS kept FROM m""")
def figure_filter(spark, sf_dir):
    return layout.outside_figures(measured(spark, sf_dir), regions(spark, sf_dir).where("region_no = 0")).select("book", "page", "line_no", "kept")


@query(f"WITH {REGIONS_SQL} SELECT book, page, region_no, (r_bottom - r_top) > 1.08 * (r_right - r_left) AS vertical, CASE WHEN (r_bottom - r_top) > 1.08 * (r_right - r_left) THEN 5 ELSE 6 END AS mode FROM rg")
def region_orientation(spark, sf_dir):
    return layout.region_orientation(regions(spark, sf_dir)).select("book", "page", "region_no", "vertical", "mode")


# --- sources ---------------------------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT o_custkey AS page, o_orderkey AS pos, o_orderkey % 17 AS bad, (o_orderkey % 8) / 8.0 AS x, (o_custkey % 5) / 8.0 AS w, (o_orderkey % 6) / 64.0 AS h, o_orderpriority AS t FROM orders),
b AS (SELECT page, pos, greatest(0, least(600, x * 600)) AS "left", greatest(0, least(600, (x + w) * 600)) AS "right", greatest(0, least(1000, (1 - 0.25 - h) * 1000)) AS "top", 750.0 AS bottom, t FROM r WHERE bad <> 0),
k AS (SELECT *, bottom - "top" >= 40 AS large FROM b WHERE "right" > "left" AND bottom > "top"),
g AS (SELECT page, count(*) FILTER (large) AS n, coalesce(sum(length(t)) FILTER (large), 0) AS chars FROM k GROUP BY page)
SELECT page, pos AS line_no, "left"::DOUBLE AS "left", "top"::DOUBLE AS "top", "right"::DOUBLE AS "right", bottom::DOUBLE AS bottom FROM k JOIN g USING (page) WHERE large OR NOT (n >= 3 AND chars >= 15)""")
def tsv_parse(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    value = F.concat_ws("\t", F.when(key % 17 == 0, "x").otherwise((key % 8 / 8.0).cast("string")), F.lit("0.25"), (cust % 5 / 8.0).cast("string"), (key % 6 / 64.0).cast("string"), F.lit("0.75"), F.col("o_orderpriority"))
    rows = corpus.table(spark, sf_dir, "orders").select(F.lit("b").alias("book"), cust.alias("page"), key.alias("pos"), value.alias("value"), F.lit(600).alias("page_width"), F.lit(1000).alias("page_height"))
    return readers.parse_lines(rows).select("page", "line_no", "left", "top", "right", "bottom")


@query("""SELECT word, min(pos) AS first_pos FROM (SELECT conv_id * 1000 + turn AS pos, regexp_replace(split_part(word, '#', 1), '^\\s+|\\s+$', '', 'g') AS word FROM (SELECT conv_id, turn, role || '_' || (conv_id % 7) || CASE turn % 3 WHEN 0 THEN ' # comment' WHEN 1 THEN '' ELSE '  ' END AS word FROM conversations)) WHERE word <> '' GROUP BY word""")
def user_words(spark, sf_dir):
    c = corpus.table(spark, sf_dir, "conversations")
    line = F.concat("role", F.lit("_"), (F.col("conv_id") % 7).cast("string"), F.when(F.col("turn") % 3 == 0, " # comment").when(F.col("turn") % 3 == 1, "").otherwise("  "))
    rows = c.select(F.lit("common").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), line.alias("line"))
    return readers.user_words(rows).select("word", F.col("first.pos").alias("first_pos"))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def missing_names(spark, sf_dir):
    nation, supplier = corpus.table(spark, sf_dir, "nation"), corpus.table(spark, sf_dir, "supplier")
    have = supplier.where("s_acctbal < 0").join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("n_name").alias("name"))
    return readers.missing(nation.select(F.col("n_name").alias("name")), have)


@query("SELECT CAST(doc_id AS VARCHAR) AS name, sha256(CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE text END) AS sha256, doc_id % 5 <> 0 AS ok FROM documents")
def checksum_match(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string"))
    pinned = docs.select("name", F.sha2(F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("text")), 256).alias("sha256"))
    return readers.checksum_matches(docs.select("name", F.encode("text", "utf-8").alias("content")), pinned)


# --- reports ---------------------------------------------------------------------------------------------------------
def page_reports(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    hits = F.transform(F.regexp_extract_all("text", F.lit("License"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.array(F.lit("license")).alias("reasons")))
    engine = F.when(F.col("page") % 5 == 0, F.lit(None).cast("string")).when(F.col("page") % 2 == 0, "vision").otherwise("tesseract")
    return p.select("book", "page", engine.alias("engine"), (F.col("page") % 7 == 0).alias("retried"), F.length("text").cast("bigint").alias("character_count"), F.size(F.split("text", "\n")).cast("bigint").alias("line_count"), F.when(F.col("page") % 3 > 0, F.col("page") % 11).alias("filtered_lines"), (F.col("page") % 5).alias("retried_lines"), (F.length("text") % 3).alias("reordered_elements"), hits.alias("review_candidates"))


@query("""SELECT source AS book, count(*) AS pages, count(*) FILTER (doc_id % 7 = 0) AS retried_pages, coalesce(sum(doc_id % 11) FILTER (doc_id % 3 > 0), 0)::BIGINT AS filtered_lines, 0::BIGINT AS filtered_non_narrative_lines, 0::BIGINT AS manga_regions_detected, 0::BIGINT AS manga_regions_accepted, 0::BIGINT AS filtered_figure_lines, 0::BIGINT AS filtered_list_markers,
sum(length(text) % 3)::BIGINT AS reordered_elements, sum(doc_id % 5)::BIGINT AS retried_lines, sum(len(regexp_extract_all(text, 'License')))::BIGINT AS candidates, count(*) FILTER (contains(text, 'All rights')) AS post_candidates, sum(len(regexp_extract_all(text, 'License'))) = 0 AND count(*) FILTER (contains(text, 'All rights')) = 0 AS automated_checks_passed, false AS verified_error_free FROM documents GROUP BY source""")
def quality_rollup(spark, sf_dir):
    return reports.rollup(page_reports(spark, sf_dir), corpus.pages(spark, sf_dir).where(F.col("text").contains("All rights")))


@query("SELECT source AS book, CASE WHEN doc_id % 5 = 0 THEN 'tesseract' WHEN doc_id % 2 = 0 THEN 'vision' ELSE 'tesseract' END AS engine, count(*) AS pages FROM documents GROUP BY ALL")
def engine_histogram(spark, sf_dir):
    return reports.engine_histogram(page_reports(spark, sf_dir))


@query("SELECT source AS book, doc_id AS page, CAST(unnest(range(len(regexp_extract_all(text, 'License')))) AS INT) AS nth, 'License' AS text FROM documents WHERE contains(text, 'License')")
def tagged_candidates(spark, sf_dir):
    return reports.tagged_candidates(page_reports(spark, sf_dir)).select("book", "page", "nth", "text")


@query()
def page_job(spark, sf_dir):
    from pagemill.plans.pages import process_pages

    done = process_pages(corpus.lines(spark, sf_dir))
    return done.reports.join(done.texts, ["book", "page"], "left").drop("correction_profiles")


# --- pixels and frames -----------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
SELECT vec_id, list_max(list_transform(list_zip(embedding, before), lambda z: abs(z[1] - z[2]))) <= 0.5::FLOAT AS same FROM e WHERE before IS NOT NULL""")
def frame_equality(spark, sf_dir):
    from pyspark.sql import Window

    e = corpus.table(spark, sf_dir, "embeddings").withColumn("before", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.where("before is not null").select("vec_id", pixels.same_frames("embedding", "before", 0.5).alias("same"))


@query("""WITH f AS (SELECT user_id, ts, CAST(floor(value) AS BIGINT) % 3 AS v, event_id FROM events), b AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM f),
r AS (SELECT *, sum(CASE WHEN w IS NOT NULL AND v <> w THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id AS source, event_id, run::BIGINT AS run, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS nth FROM r""")
def frame_runs(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "event_id", F.col("event_id").alias("ts"), F.array((F.floor("value") % 3).cast("double")).alias("frame"))
    return frames.first_changes(e, 0.5).select("source", "event_id", F.col("run").cast("bigint").alias("run"), F.col("nth").cast("bigint").alias("nth"))


@query("""WITH f AS (SELECT user_id AS source, event_id AS ts, floor(value) % 3 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT source, v AS page FROM f WHERE i = 1), c AS (SELECT f.*, min(CASE WHEN v <> page THEN i END) OVER (PARTITION BY source) AS first_change FROM f JOIN p USING (source)),
a AS (SELECT *, lag(v) OVER (PARTITION BY source ORDER BY i) AS w FROM c), s AS (SELECT source, min(i) AS i FROM a WHERE i > first_change AND v = w GROUP BY source)
SELECT c.source, CAST(c.ts AS DOUBLE) AS ts, CASE WHEN s.i IS NOT NULL THEN 'stable' WHEN first_change IS NOT NULL THEN 'timeout' ELSE 'end' END AS outcome FROM c LEFT JOIN s USING (source) WHERE c.i = coalesce(s.i, n)""")
def stable_frames(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").cast("double").alias("ts"), F.array((F.floor("value") % 3).cast("double")).alias("frame"))
    return frames.stable_frames(e, 0.5, 2, 1e18)


def screens(spark, sf_dir):
    """Made-up screenshots of parts: a header, dark strips and a block, all by whole-number arithmetic of the key.

    Rows of pixels are repeated whole, in hexadecimal. A key of 8 bytes becomes a picture of 36,000, so keys are dealt out first: a
    file of a million is read by one task.
    """
    k = F.col("page")
    row = lambda tone: F.concat(F.repeat(F.lit("14" * 3), (k % 30).cast("int")), F.repeat(F.lit(tone * 3), (120 - k % 30).cast("int")))
    rgb = F.unhex(F.concat(F.repeat(row("C8"), (14 + k % 50).cast("int")), F.repeat(row("FF"), (86 - k % 50).cast("int"))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    keys = corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page")).repartition(tasks, "page")
    return keys.select(F.lit("b").alias("book"), "page", F.lit(120).alias("width"), F.lit(100).alias("height"), rgb.alias("pixels"))


@query("SELECT p_partkey AS page, CAST(14 + p_partkey % 50 AS INT) AS header FROM part")
def header_boundary(spark, sf_dir):
    return pixels.per_image(screens(spark, sf_dir), lambda im: [(pixels.header_bottom(im),)], "header int").select("page", "header")


@query("""SELECT p_partkey AS page, 0 AS "left", CASE WHEN k BETWEEN 1 AND 23 THEN 120 - greatest(8, k) ELSE 120 END AS "right" FROM (SELECT p_partkey, p_partkey % 30 AS k FROM part)""")
def right_strip(spark, sf_dir):
    # The screens turned about, so that the strip is at the right edge.
    return pixels.per_image(screens(spark, sf_dir), lambda im: [pixels.dark_edges(im[:, ::-1])], "left int, right int").select("page", "left", "right")


@query("""SELECT p_partkey AS page, (7 + 0.0) / 7 * CASE WHEN k >= 26 THEN 1.0 ELSE k / 26.0 END AS darkness, CASE WHEN k >= 26 THEN 1.0 ELSE k / 26.0 END AS dark FROM (SELECT p_partkey, p_partkey % 30 AS k FROM part)""")
def inked_boxes(spark, sf_dir):
    # Of the leftmost 26 columns at the bottom, a box's own and with its margin of 8, the strip's are dark.
    return pixels.per_image(screens(spark, sf_dir), lambda im: [(pixels.darkness(im, 0, 90, 26, 97), pixels.ink(im, 0, 90, 18, 97)[2])], "darkness double, dark double").select("page", "darkness", "dark")


@query()
def content_boxes(spark, sf_dir):
    return pixels.content_boxes(screens(spark, sf_dir))


@query()
def list_markers(spark, sf_dir):
    """Each line's first word as its marker, in a square box whose darkness is made up."""
    own = corpus.lines(spark, sf_dir).withColumn("text", F.array_join(F.col("words")["text"], " "))
    first, rest = F.substring_index("text", " ", 1), F.regexp_replace("text", r"^\\S* ?", "")
    marker = F.when(F.length(first) > 4, F.element_at(F.array(*map(F.lit, ("\u25a0", "[", "V", "\u2022"))), (F.col("line_no") % 4 + 1).cast("int"))).otherwise(first)
    own = own.select("book", "page", "block_no", "line_no", marker.alias("token"), "left", "top", (F.col("left") + 20).alias("right"), (F.col("top") + 20).alias("bottom"), (F.length(rest) == 0).alias("alone"), F.when(F.length(rest) > 0, F.col("left") + 45).alias("next_left"), F.when(F.length(rest) > 0, rest).alias("rest"), "text", "page_width", "page_height", ((F.col("line_no") * 7 + F.col("page")) % 16 / 16.0).alias("dark"))
    return layout.list_markers(pages.settled(own))  # read several times


@query("SELECT p_partkey AS page, CAST(CASE WHEN p_partkey % 30 BETWEEN 1 AND 23 THEN greatest(8, p_partkey % 30) ELSE 0 END AS INT) AS strip FROM part")
def dark_run_boundary(spark, sf_dir):
    # A strip narrower than 8 ends at 8; one of 24 or more leaves too few columns of the quarter to be sure of its end.
    return pixels.per_image(screens(spark, sf_dir), lambda im: [(pixels.dark_strip(im),)], "strip int").select("page", "strip")


@query("""WITH f AS (SELECT user_id AS source, floor(value) % 3 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT source, v AS page FROM f WHERE i = 1), c AS (SELECT f.source, n, min(CASE WHEN v <> page AND i <= 7 THEN i END) AS fc FROM f JOIN p USING (source) GROUP BY ALL),
d AS (SELECT *, 1 + 2 * ((fc - 1 + 1) // 2) AS deadline FROM c), a AS (SELECT source, i, v, lag(v) OVER (PARTITION BY source ORDER BY i) AS w FROM f),
s AS (SELECT d.source, min(a.i) AS si FROM d JOIN a ON a.source = d.source AND a.v = a.w AND a.i > fc AND a.i <= deadline GROUP BY d.source)
SELECT source, CAST(coalesce(si, least(n, coalesce(deadline, 7))) AS DOUBLE) AS ts, CASE WHEN si IS NOT NULL THEN 'stable' WHEN fc IS NOT NULL THEN 'timeout' ELSE 'end' END AS outcome FROM d LEFT JOIN s USING (source)""")
def retried_turns(spark, sf_dir):
    """Three attempts of two seconds each, a frame a second."""
    e = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double").alias("ts"), F.array((F.floor("value") % 3).cast("double")).alias("frame"))
    return frames.retried_turns(e, 2, 2.0, 0.5)


@query("""WITH w AS (SELECT s_suppkey AS book, '/out/' || replace(s_name, '#', '.') AS stem, CASE s_suppkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.pdf' END AS e, s_suppkey % 7 AS k, s_suppkey % 4 < 3 AS searchable FROM supplier),
o AS (SELECT book, 'output' AS kind, stem || e AS path, '.pdf' AS x FROM w UNION ALL SELECT book, 'searchable', stem || '_searchable.pdf', '.pdf' FROM w WHERE searchable UNION ALL SELECT book, 'ocr_text', stem || '_ocr.txt', '.txt' FROM w WHERE searchable
UNION ALL SELECT book, 'readaloud', CASE k WHEN 0 THEN stem || e WHEN 1 THEN '/out/speech.pdf' ELSE stem || '_readaloud.txt' END, '.txt' FROM w WHERE searchable UNION ALL SELECT book, 'quality', stem || '_ocr_quality.json', '.json' FROM w WHERE searchable)
SELECT book, kind, path, CASE WHEN count(*) OVER (PARTITION BY book, path) > 1 THEN 'collision' WHEN NOT ends_with(lower(path), x) THEN 'extension' END AS problem FROM o""")
def output_paths(spark, sf_dir):
    stem, k = F.concat(F.lit("/out/"), F.replace("s_name", F.lit("#"), F.lit("."))), F.col("s_suppkey")
    output = F.concat(stem, F.when(k % 5 == 0, ".PDF").when(k % 5 == 1, ".txt").otherwise(".pdf"))
    spoken = F.when(k % 7 == 0, output).when(k % 7 == 1, F.lit("/out/speech.pdf")).otherwise("")
    return books.output_paths(corpus.table(spark, sf_dir, "supplier").select(k.alias("book"), output.alias("output"), (k % 4 < 3).alias("searchable"), spoken.alias("readaloud_output")))


@query(r"""WITH f AS (SELECT conv_id AS book, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id), r AS (SELECT book, t FROM f WHERE book % 3 = 0 AND t IS NOT NULL)
SELECT book, CAST(i AS BIGINT) AS page, a[i] AS text FROM (SELECT book, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT book, string_split(t, 'e') AS a FROM r))
UNION ALL SELECT conv_id, CAST(turn AS BIGINT), text FROM conversations WHERE conv_id NOT IN (SELECT book FROM r)""")
def finished_pages(spark, sf_dir):
    """Final texts of a third of the books are readable; the others' are null."""
    talks = corpus.talks(spark, sf_dir).withColumn("page", F.col("page").cast("bigint"))
    first = talks.groupBy("book").agg(F.min_by("text", "page").alias("t"))
    return readers.finished_pages(talks, first.select("book", F.when(F.col("book") % 3 == 0, F.replace("t", F.lit("e"), F.lit("\f"))).alias("text")))


@query(f"WITH {PAGE_METRICS} SELECT l.book, l.page, l.line_no, CASE WHEN pm.line_count >= 2 AND pm.character_count >= 10 THEN l.block_no ELSE -1 END AS block_no FROM l LEFT JOIN pm USING (book, page)")
def preferred_recogniser(spark, sf_dir):
    own = corpus.lines(spark, sf_dir)
    return readers.preferred(own, own.withColumn("block_no", F.lit(-1))).select("book", "page", "line_no", "block_no")
