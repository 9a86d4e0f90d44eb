"""Sources, sinks, names of outputs, recogniser functions and retried page turns."""

import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import books
from pagemill.operators.reports import correction_map
from pagemill.sinks import writers
from pagemill.sources import readers
from pagemill.streaming import frames

LINES = "book string, page int, block_no int, line_no int, left double, top double, right double, bottom double, words array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>, page_width int, page_height int"


def line(page, n, text, sure=0.9, book="b"):
    box = (10.0, 20.0 * n, 200.0, 20.0 * n + 15)
    return book, page, 0, n, *box, [(text, *box, sure)], 600, 1000


def test_books_go_out_and_come_back(spark, tmp_path):
    made = spark.createDataFrame([("a", "本文です。\n\n二つ目。\n"), ("b", "")], "book string, text string")
    writers.write_books(made, f"{tmp_path}/out")
    read = spark.read.text(f"{tmp_path}/out", wholetext=True).where("book = 'a'").collect()
    assert [r["value"] for r in read] == ["本文です。\n\n二つ目。\n"]
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_books(made, f"{tmp_path}/out")
    writers.write_books(made.limit(1), f"{tmp_path}/out", overwrite=True)
    assert [p.name for p in (tmp_path / "out").glob("book=*")] == ["book=a"]


def test_texts_never_replace_their_source(spark, tmp_path):
    (tmp_path / "ocr.txt").write_text("本文です。", encoding="utf-8")
    own = readers.read_books(spark, f"{tmp_path}/ocr.txt")
    assert [tuple(r) for r in own.collect()] == [("ocr", "本文です。")]
    with pytest.raises(ValueError, match="written over"):
        writers.write_books(own, f"file://{tmp_path}/x/../ocr.txt", overwrite=True, source=f"{tmp_path}/ocr.txt")
    assert (tmp_path / "ocr.txt").read_text(encoding="utf-8") == "本文です。"
    assert not writers.same_place("s3://a/x", "s3://b/x")


def test_pages_and_reports(spark, tmp_path):
    pages = spark.createDataFrame([("b", 1, "x"), ("b", 2, None)], "book string, page int, text string")
    writers.write_pages(pages, f"{tmp_path}/pages")
    assert sorted((r.book, r.page, r.text or "") for r in spark.read.parquet(f"{tmp_path}/pages").collect()) == [("b", 1, "x"), ("b", 2, "")]
    totals = spark.createDataFrame([("b", 1, "二重", 2), ("b", 1, "a", 1)], "book string, page int, name string, count int")
    reports = correction_map(totals, ["book", "page"]).withColumn("score", F.lit(91.5))
    writers.write_reports(reports, f"{tmp_path}/reports")
    assert "二重" in next((tmp_path / "reports").glob("part-*")).read_text(encoding="utf-8")
    got = readers.read_reports(spark, f"{tmp_path}/reports").first()
    assert (got.book, got.page, got.corrections, got.score, got.engine) == ("b", 1, {"a": 1, "二重": 2}, 91.5, None)


def test_recogniser_functions(spark, tmp_path):
    folder = tmp_path / "novel"
    folder.mkdir()
    for n, content in ((1, b"one line of text|and another"), (2, b"few"), (3, b"")):
        (folder / f"page_{n:04}.png").write_bytes(content)
    images = readers.read_page_images(spark, str(folder))
    assert sorted((r.book, r.page, bytes(r.content)) for r in images.collect())[1] == ("novel", 2, b"few")

    def engine(content):
        return 600, 1000, [(t, 10, 20 * n, 200, 20 * n + 15, 0.5) for n, t in enumerate(content.decode().split("|")) if t]

    found = readers.recognise(images.unionByName(images.limit(1).select("book", F.lit(9).alias("page"), F.lit(None).cast("binary").alias("content"))), engine)
    assert sorted((r.page, r.line_no, r["words"][0]["text"], r.top) for r in found.collect()) == [(1, 0, "one line of text", 0.0), (1, 1, "and another", 20.0), (2, 0, "few", 0.0)]
    other = spark.createDataFrame([line(n, 0, "other", book="novel") for n in (1, 2, 3)], LINES)
    kept = readers.preferred(found, other).collect()
    assert sorted((r.page, r["words"][0]["text"]) for r in kept) == [(1, "and another"), (1, "one line of text"), (2, "other"), (3, "other")]


def test_final_text_or_filtered_pages(spark):
    filtered = spark.createDataFrame([(b, n, f"{b}{n}") for b in "abc" for n in (1, 2)], "book string, page int, text string")
    final = spark.createDataFrame([("a", "x\fy\fz"), ("b", None)], "book string, text string")
    got = sorted(tuple(r) for r in readers.finished_pages(filtered, final).collect())
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "b1"), ("b", 2, "b2"), ("c", 1, "c1"), ("c", 2, "c2")]


def test_names_of_outputs(spark):
    rows = [("plain", "/o/book.pdf", True, None), ("single", "/o/a.b.pdf", False, None), ("same", "/o/book.pdf", True, "/o/book.pdf"), ("kind", "/o/book.pdf", True, "/o/speech.pdf"), ("none", "/o/book", True, ""), ("dot", "/o/.pdf", False, None), (None, None, True, None)]
    got = {}
    for r in books.output_paths(spark.createDataFrame(rows, "book string, output string, searchable boolean, readaloud_output string")).collect():
        got.setdefault(r.book, {})[r.kind] = (r.path, r.problem)
    assert got["plain"] == {"output": ("/o/book.pdf", None), "searchable": ("/o/book_searchable.pdf", None), "ocr_text": ("/o/book_ocr.txt", None), "readaloud": ("/o/book_readaloud.txt", None), "quality": ("/o/book_ocr_quality.json", None)}
    assert got["single"] == {"output": ("/o/a.b.pdf", None)}
    assert got["same"]["output"][1] == got["same"]["readaloud"][1] == "collision" and got["same"]["quality"][1] is None
    assert got["kind"]["readaloud"] == ("/o/speech.pdf", "extension")
    assert got["none"]["output"] == ("/o/book", "extension") and got["none"]["readaloud"] == ("/o/book_readaloud.txt", None)
    assert got["dot"] == {"output": ("/o/.pdf", "extension")}
    assert got[None]["output"] == (None, None)


def test_retried_turns(spark):
    def of(name, *seen):
        return [(name, float(ts), None if v is None else [float(v)]) for ts, v in seen]

    rows = of("second", (0, 0), (1, 0), (2, 0), (3, 50), (4, 50)) + of("late", (0, 0), (1, 0), (7, 50), (8, 50)) + of("lost", (0, 0), (1, 50), (1.1, None), (2, 0), (2.5, None)) + of("again", (0, 0), (1, 50), (1.2, None), (1.5, 60), (2, 60)) + of("cut", (0, 0), (1, 50), (4, 60)) + of("gone", (0, None))
    made = spark.createDataFrame(rows, "source string, ts double, frame array<double>")
    got = {r.source: (r.ts, r.outcome) for r in frames.retried_turns(made, 1, 2.0).collect()}
    assert got == {"second": (4.0, "stable"), "late": (1.0, "end"), "lost": (2.5, "lost"), "again": (2.0, "stable"), "cut": (1.0, "timeout")}
    # Each attempt takes 1.5 seconds at least, so that two reach to 3.
    assert {r.source: r.ts for r in frames.retried_turns(made, 1, 0.1).collect()}["second"] == 3.0


def test_stream_of_retried_turns(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("second", 0.0, [0.0]), ("second", 3.0, [50.0]), ("second", 3.5, [50.0]), ("lost", 0.0, [0.0]), ("lost", 1.0, None), ("lost", 1.5, None), ("lost", 2.0, None)]
    schema = "source string, ts double, frame array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    turns = frames.stream_stable_frames(stream, timeout=2, retries=1, idle=600)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = turns.writeStream.format("memory").queryName("retried").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("retried").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r) for r in spark.sql("SELECT * FROM retried ORDER BY source").collect()] == [("lost", 1.5, "lost"), ("second", 3.5, "stable")]
