"""From documents to packed sequences, in five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from pagemill.llm.shared import documents, text_hash, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Suffix hashes and counts of words are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
#: Some 50 words of four letters and a blank are 250 bytes: shorter than any passage of 50 words that is likely to recur.
PASSAGE = suffix_dedup.Shape(length=256, gram=64, widths=(30, 5, 1))


def same_row(docs: DataFrame, of: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(of["doc_id"]) & (text_hash(docs["text"]) == of["text_hash"])


def once(rows: DataFrame) -> DataFrame:
    """Equal rows of an id and a text as one."""
    return rows.dropDuplicates(["doc_id", "text"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    kept = quality_rules.judge(docs).where("kept").select("doc_id", "text_hash").distinct()
    return docs.join(kept, same_row(docs, kept), "left_semi").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id, a null one last; of rows that share it, one."""
    groups = simhash.near_groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    first = groups.groupBy("group").agg(F.min(order).alias("row")).select("row.doc_id", "row.text_hash")
    first = written(first, "representatives")
    rows = docs.join(first, same_row(docs, first), "left_semi").select(*COLUMNS)
    repeated = groups.groupBy("doc_id", "text_hash").count().where("count > 1")
    repeated = repeated.join(first, repeated["doc_id"].eqNullSafe(first["doc_id"]) & (repeated["text_hash"] == first["text_hash"]), "left_semi")
    return once(rows) if repeated.limit(1).count() else rows


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its bytes in strings of PASSAGE that recur; none is dropped, though some may be left empty."""
    out = suffix_dedup.dedup(docs, PASSAGE, with_text=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times."""
    taken = mixing.mix(docs).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    taken = written(taken, "taken").where("copies > 0")
    match = same_row(docs, taken) & docs["source"].eqNullSafe(taken["source"])
    rows = docs.join(taken.drop("lang"), match).select(*(docs[c] for c in COLUMNS), "copies", "rows")
    if taken.where("rows > 1").limit(1).count():
        rows = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["doc_id", "text", "source"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("simhash", keep_distinct),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
