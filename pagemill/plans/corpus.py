"""The driver's tables as pages and recognised lines, in Spark and as SQL with the same values.

A source is a book and a document a page; where a whole book becomes one value, a conversation is the book and a turn the page. Boxes and
confidences are whole-number arithmetic of page and line; confidences are 64ths, so that sums of them are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.numbers import sql_rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir).select("book", "page", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    own = own.withColumn("block_no", F.floor(F.col("n") / 5).cast("int")).withColumn("line_no", F.col("n"))
    own = own.withColumn("left", (10 + F.pmod(F.col("page") * 7 + F.col("n") * 3, F.lit(40))).cast("double")).withColumn("top", (F.pmod(F.col("n") * 11 + F.col("page"), F.lit(17)) * 60 + F.pmod(F.col("n"), F.lit(3)) * 7).cast("double"))
    own = own.withColumn("right", F.col("left") + 80 + F.pmod(F.col("n") * 37, F.lit(400))).withColumn("bottom", F.col("top") + 14 + F.pmod(F.col("page") + F.col("n") * 5, F.lit(23)))
    # The i-th word's confidence is (page * 31 + n * 17 + i * 5) % 64 / 64: a stretch of one cycle of 64 values, the line's beginning at
    # thirteen times its own, as 13 * 5 = 1 modulo 64. Whole arrays are many times as fast as a function called for each word.
    own = own.withColumn("_texts", F.split("line", " ")).withColumn("_many", F.size("_texts"))
    cycle = F.array(*(F.lit(i * 5 % 64 / 64.0) for i in range(64)))
    begins = F.pmod((F.col("page") * 31 + F.col("n") * 17) * 13, F.lit(64)).cast("int") + 1
    sure = F.slice(F.flatten(F.array_repeat(cycle, F.floor((F.col("_many") + 126) / 64).cast("int"))), begins, F.col("_many"))
    words = F.arrays_zip(F.col("_texts").alias("text"), *(F.array_repeat(c, F.col("_many")).alias(c) for c in ("left", "top", "right", "bottom")), sure.alias("confidence"))
    return own.select("book", "page", "block_no", "line_no", "left", "top", "right", "bottom", words.alias("words"), F.lit(600).alias("page_width"), F.lit(1000).alias("page_height"))


SQL_PAGES = "p AS (SELECT source AS book, doc_id AS page, text FROM documents)"
SQL_TALKS = "p AS (SELECT conv_id AS book, turn AS page, text FROM conversations)"
SQL_LINES = SQL_PAGES + r""",
l0 AS (SELECT book, page, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS line FROM (SELECT book, page, string_split(text, chr(10)) AS a FROM p)),
l1 AS (SELECT *, CAST(n // 5 AS INT) AS block_no, CAST(n AS INT) AS line_no, CAST(10 + (page * 7 + n * 3) % 40 AS DOUBLE) AS "left", CAST((n * 11 + page) % 17 * 60 + n % 3 * 7 AS DOUBLE) AS "top" FROM l0),
l2 AS (SELECT *, "left" + 80 + (n * 37) % 400 AS "right", "top" + 14 + (page + n * 5) % 23 AS bottom, string_split(line, ' ') AS w FROM l1),
l3 AS (SELECT *, list_filter(list_transform(w, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ws, list_transform(w, lambda x, i: ((page * 31 + n * 17 + (i - 1) * 5) % 64) / 64.0) AS cs FROM l2),
l AS (SELECT book, page, block_no, line_no, "left", "top", "right", bottom, regexp_replace(array_to_string(ws, ' '), '^\s+|\s+$', '', 'g') AS text, cs FROM l3),
m AS (SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS characters, """ + sql_rounded("list_sum(cs) / len(cs)", 2) + r""" AS confidence,
  coalesce(length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[A-Za-z0-9、。，．・：；！？「」『』（）［］【】〈〉《》〔〕｛｝.,:;!?()\[\]{}<>+\-/%&@#''"]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 0.0) AS suspicious_ratio FROM l)"""
