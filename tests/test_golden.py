"""Known inputs and what must come out."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.functions import rules, text
from pagemill.functions.numbers import rounded
from pagemill.operators import books, corrections, layout, lines, pixels, reports
from pagemill.sources import readers
from pagemill.streaming import frames


def one(df):
    return df.first()[0]


def read(spark, t, skip=()):
    return books.book_text(spark.createDataFrame([("b", t)], "book string, text string"), skip).first()["text"]


@pytest.mark.parametrize(
    ("raw", "skip", "want"),
    [
        ("共通ヘッダー\n日 本 語 の 文 章\nで す。\n1\f共通ヘッダー\n次 の ページ\nで す。\n2", (), "日本語の文章です。\n\n次のページです。\n"),
        ("This is an exam-\nple.\n\nSecond paragraph.", (), "This is an example.\n\nSecond paragraph.\n"),
        ("最初の行です。\n\n次の行です。\n\nEnglish paragraph.", (), "最初の行です。次の行です。\n\nEnglish paragraph.\n"),
        ("表紙\f奥付\f本文です。", (1, 2), "本文です。\n"),
        ("", (), ""),
        ("が", (), "が\n"),
    ],
)
def test_book_text(spark, raw, skip, want):
    assert read(spark, raw, skip) == want


def test_page_numbers(spark):
    of = lambda s: one(spark.range(1).select(text.page_numbers(F.lit(s))))
    assert of("1-2,5,7-8") == [1, 2, 5, 7, 8]
    assert of(" ") == []
    for bad in ("3-1", "0", "1,,2", "a", "1-", "-1"):
        with pytest.raises(Exception, match="pages|falls"):
            of(bad)


def test_titles(spark):
    rows = [("a", 1, "生成AI時代の検索システム\n山田太郎 著"), ("a", 2, "第1章\nはじめに"), ("b", 1, "第1章\n本文です。"), ("c", 1, "")]
    got = {r.book: r for r in books.infer_titles(spark.createDataFrame(rows, "book string, page int, text string")).collect()}
    assert got["a"].title == "生成AI時代の検索システム" and got["a"].confidence >= 0.8
    assert got["b"].title != "第1章" and got["b"].confidence < 0.8
    assert (got["c"].title, got["c"].confidence) == ("", 0.0)


def test_file_names(spark):
    of = lambda s, n=180: one(spark.createDataFrame([(s,)], "t string").select(text.safe_filename("t", n)))
    assert of('a/b:c*"d"?') == "a b c d"
    assert of("ＡＢＣ　１") == "ABC 1"
    assert of("日本語", 7) == "日本"
    assert len(of("あ" * 200).encode()) <= 180
    wanted = spark.createDataFrame([("x", "書籍名"), ("y", "other")], "book string, title string")
    taken = spark.createDataFrame([("書籍名.pdf",), ("unrelated.pdf",)], "name string")
    assert {r.name for r in books.exclusive_names(wanted, taken, [".pdf", ".txt"]).collect()} == {"書籍名（2）", "other"}


LINES = "book string, page int, block_no int, line_no int, left double, top double, right double, bottom double, page_width int, page_height int, words array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>"


def make(spark, rows, width=600, height=1000):
    """rows of (text or words, confidence, left, top, right, bottom, block)."""
    out = []
    for i, r in enumerate(rows):
        t, conf, left, top, right, bottom, block = (*r, *(None, 0.9, 10.0, 20.0 + 40 * i, 200.0, None, 0)[len(r) :])
        bottom = top + 20.0 if bottom is None else bottom
        words = [t] if isinstance(t, str) else t
        out.append(("b", 1, block, i, float(left), float(top), float(right), float(bottom), width, height, [(w, float(left), float(top), float(right), float(bottom), conf) for w in words]))
    return spark.createDataFrame(out, LINES)


def test_line_text_and_metrics(spark):
    df = lines.line_metrics(make(spark, [(["日", "本", "語", "OpenAI", "API"], 0.5), (["12"], 0.4), ([], None)]))
    got = df.orderBy("line_no").collect()
    assert [r.text for r in got] == ["日本語 OpenAI API", "12", ""]
    assert [r.suspicious_ratio for r in got] == [0, 0, 0]
    merged = lines.merge_words(df).collect()
    assert [m.words[0].text for m in merged] == ["日本語 OpenAI API"]
    page = lines.page_metrics(df).first()
    assert (page.line_count, page.character_count) == (2, 14)


def test_low_confidence_and_retry(spark):
    df = lines.line_metrics(make(spark, [("KG $a RX [=", 0.15, 10, 20), ("本書の本文です。", 0.92, 10, 100)]))
    assert [r.removed for r in lines.low_confidence(df.withColumn("suspicious_ratio", F.when(F.col("line_no") == 0, 0.2).otherwise(0.0))).orderBy("line_no").collect()] == [True, False]
    metrics = lines.retry_decision(lines.page_metrics(lines.line_metrics(make(spark, [("KG $a RX [=", 0.2)]))), 6).first()
    assert metrics.retry and metrics.alternate_mode == 11


def test_reading_order(spark):
    df = make(spark, [("a", 0.9, 10, 100, 200, 120, 0), ("b", 0.9, 10, 60, 200, 80, 0), ("c", 0.9, 10, 20, 200, 40, 1)])
    got = lines.reading_order(df).orderBy("place").collect()
    assert [r.top for r in got] == [20, 60, 100]
    assert any(r.moved for r in got)


def test_manga_merge(spark):
    df = make(spark, [("第1章", 0.9, 100, 20, 300, 60), ("右の吹き出し", 0.9, 400, 300, 550, 330), ("第1章", 0.9, 100, 20, 300, 60), ("左の吹き出し", 0.9, 50, 300, 200, 330)])
    kept = lines.merge_dedupe(lines.line_metrics(df).withColumnRenamed("line_no", "place"))
    ordered = lines.manga_order(df.join(kept.withColumnRenamed("place", "line_no").select("line_no", "text"), "line_no")).orderBy("place")
    assert [r.text for r in ordered.collect()] == ["第1章", "右の吹き出し", "左の吹き出し"]


def test_corrections(spark):
    t = "生成 Al モデルで LIM を使い、ユュユーザーへ説明する。"
    df = spark.createDataFrame([(t,), ("LIMIT lim Al 合金",)], "text string")
    got = corrections.correct(df, profiles=["ai-rag"]).collect()
    assert got[0].text == "生成 AI モデルで LLM を使い、ユーザーへ説明する。" and sum(got[0].corrections.values()) == 3
    assert got[1].text == "LIMIT lim Al 合金" and not got[1].corrections
    assert corrections.correct(df, profiles=[]).first().text == t
    assert rules.expand_profiles(None) == {"common"} and rules.expand_profiles([]) == frozenset()
    assert rules.expand_profiles(["rag-accuracy-book"]) == {"rag-accuracy-book", "ai-rag", "common"}


def test_corrections_across_lines(spark):
    df = lines.line_metrics(make(spark, [("これは LLM-as-a-", 0.8), ("J udge)", 0.8), ("生成の Al", 0.8), ("の実務経験", 0.8)]))
    got = corrections.correct_lines(df, profiles=["ai-rag"]).orderBy("line_no").collect()
    assert [r.text for r in got if not r.removed] == ["これは LLM-as-a-Judge)", "生成の AI", "の実務経験"]
    assert got[1].removed and got[1].words == []


def test_reviews(spark):
    pages = spark.createDataFrame([("b", 1, "正常なページです。"), ("b", 2, "UM を評価者として、Self-RAGLLM が判断します。"), ("b", 3, "BLEU といっつた指標です。")], "book string, page int, text string")
    got = corrections.page_candidates(pages, profiles=["ai-rag"]).orderBy("page", "rule").collect()
    assert [(r.page, r.reason) for r in got] == [(2, "llm_variant_um"), (2, "joined_heading")]
    assert got[1].match == "Self-RAGLLM" and got[1].context == "UM を評価者として、Self-RAGLLM が判断します。"
    df = lines.line_metrics(make(spark, [("評価 [=] です", 0.9), ("日本語 ABC", 0.9), ("日本語 API", 0.9)]))
    assert [(r.line_no, r.reasons) for r in corrections.review_candidates(df).orderBy("line_no").collect()] == [(0, ["ocr_symbol_fragment"]), (1, ["mixed_script_ending"])]


def test_parse_lines(spark):
    rows = spark.createDataFrame([("b", 1, 0, "0.1\t0.2\t0.3\t0.1\t0.75\t第1章 AIエージェント", 1000, 2000), ("b", 1, 1, "x\t0.2\t0.3\t0.1\t0.75\tbad", 1000, 2000), ("b", 1, 2, "0.1\t0.2", 1000, 2000)], "book string, page int, pos int, value string, page_width int, page_height int")
    (r,) = readers.parse_lines(rows).collect()
    assert [round(v, 6) for v in (r.left, r.top, r.right, r.bottom)] == [100, 1400, 400, 1600]
    assert r.words[0].confidence == 0.75


def test_user_words(spark):
    rows = spark.createDataFrame([("a", 0, "﻿# comment"), ("a", 1, "LLM"), ("a", 2, "OpenAI"), ("b", 0, "OpenAI # again"), ("b", 1, "GraphRAG"), ("b", 2, "  ")], "file string, pos int, line string")
    assert [r.word for r in readers.user_words(rows).orderBy("first").collect()] == ["LLM", "OpenAI", "GraphRAG"]
    with pytest.raises(Exception, match="white space"):
        readers.user_words(spark.createDataFrame([("a", 0, "two words")], "file string, pos int, line string")).collect()


def test_markers(spark):
    schema = "book string, page int, block_no int, line_no int, token string, left double, top double, right double, bottom double, alone boolean, next_left double, rest string, text string, page_width int, page_height int, dark double"
    solid = ("b", 1, 0, 0, "e", 20.0, 20.0, 40.0, 40.0, False, 60.0, "first point", "e first point", 500, 500, 0.8)
    boxes = [("b", 1, 0, i, "[", 20.0, 60.0 * i, 40.0, 60.0 * i + 20, False, 60.0, "item", "[ item", 500, 500, 0.4) for i in (1, 2)]
    lone = ("b", 1, 0, 3, "V", 20.0, 300.0, 45.0, 325.0, True, None, None, "V", 500, 500, 0.25)
    word = ("b", 1, 0, 4, "Plain", 20.0, 400.0, 90.0, 420.0, False, 100.0, "text", "Plain text", 500, 500, 0.3)
    got = {r.line_no: r.detection for r in layout.list_markers(spark.createDataFrame([solid, *boxes, lone, word], schema)).collect()}
    assert got == {0: "solid_marker", 1: "aligned_checkbox", 2: "aligned_checkbox", 3: "aligned_checkbox"}


def test_narrative_and_titles(spark):
    df = make(spark, [("第1章 はじまり", 0.9, 50, 20, 500, 75), ("今日はいい天気", 0.9, 120, 320, 250, 340), ("import os", 0.9, 300, 600, 400, 620), ("Editor UI", 0.9, 300, 700, 400, 720)])
    df = lines.line_metrics(df)
    region = spark.createDataFrame([("b", 1, 0, 100.0, 300.0, 300.0, 400.0)], "book string, page int, region_no int, r_left double, r_top double, r_right double, r_bottom double")
    assert [r.kept for r in layout.narrative_lines(df, region).orderBy("line_no").collect()] == [True, True, False, False]
    df = lines.line_metrics(make(spark, [("『第2世代：対話型』", 0.9, 50, 500, 300, 530), ("上の説明文", 0.9, 50, 60, 300, 90), ("CODE BASE", 0.9, 50, 90, 300, 120), ("辞令", 0.9, 50, 700, 300, 730)]))
    assert [r.kept for r in layout.title_lines(df).orderBy("line_no").collect()] == [True, True, False, False]
    assert one(spark.createDataFrame([("補 完 対 話 x →",)], "t string").select(layout.clean_region_text("t"))) == "補完対話"


def test_figures(spark):
    body = [("本文の長い説明がここに続いています。そして続く。", 0.95, 50, 20 + 30 * i, 500, 40 + 30 * i) for i in range(3)]
    chart = [(f"L{i}", 0.5, 100 + 40 * i, 300 + 40 * i, 160 + 40 * i, 320 + 40 * i) for i in range(4)]
    df = lines.line_metrics(make(spark, [*body, *chart, ("続きの本文もまた長い説明がここにあります。はい。", 0.95, 50, 700, 500, 720)], 600, 800))
    ink = df.withColumn("saturated", F.when(F.col("line_no").between(3, 6), 0.3).otherwise(0.0)).withColumn("nonwhite", F.lit(0.1)).withColumn("dark", F.lit(0.01))
    found = layout.figure_regions(layout.figure_flags(ink))
    (r,) = found.collect()
    assert r.r_top <= 300 and r.r_bottom >= 440
    kept = layout.outside_figures(ink, found).orderBy("line_no").collect()
    assert [x.kept for x in kept] == [True] * 3 + [False] * 4 + [True]


def test_pixels():
    white = np.full((300, 400, 3), 255, np.int16)
    left = white.copy()
    left[:, :80] = 0
    assert pixels.dark_edges(left) == (80, 400)
    assert pixels.dark_edges(white * 0) == (0, 400)
    right = white.copy()
    right[:, 320:] = 0
    assert pixels.dark_edges(right) == (0, 320)
    page = np.full((300, 200, 3), 255, np.int16)
    page[40:250, 20:181] = 100
    assert pixels.content_box(page, header=20, left=10, right=15, bottom=30) == (10, 20, 185, 250)
    assert pixels.same_picture(page, page + 8) and not pixels.same_picture(page, page + 9) and not pixels.same_picture(page, white)
    bubble = np.full((480, 300, 3), 128, np.int16)
    y, x = np.ogrid[:480, :300]
    bubble[((y - 200) / 60) ** 2 + ((x - 150) / 50) ** 2 <= 1] = 255
    (b,) = pixels.bubbles(bubble)
    assert np.allclose(b, (100, 140, 201, 261), atol=3)
    assert pixels.darkness(left, 70, 0, 90, 10) == 0.5
    assert pixels.ink(white, 10, 10, 50, 30) == (0, 0, 0)


def test_image_frames(spark):
    im = np.full((60, 100, 3), 250, np.uint8)
    im[20:, :] = 60
    df = spark.createDataFrame(pd.DataFrame({"book": ["b"], "page": [1], "width": [100], "height": [60], "pixels": [im.tobytes()]}))
    assert pixels.per_image(df, lambda i: [(pixels.header_bottom(i),)], "header int").first().header == 20
    assert pixels.content_boxes(df, left=5, right=5).first().top == 20


def test_stable_frames(spark):
    rows = [("a", float(t), [float(v)]) for t, v in enumerate([0, 0, 50, 90, 90, 90])] + [("b", float(t), [0.0]) for t in range(3)] + [("c", 0.0, [0.0]), ("c", 1.0, [99.0])]
    got = {r.source: (r.ts, r.outcome) for r in frames.stable_frames(spark.createDataFrame(rows, "source string, ts double, frame array<double>"), timeout=60).collect()}
    assert got == {"a": (4.0, "stable"), "b": (2.0, "end"), "c": (1.0, "timeout")}


def test_stream_of_frames(spark, tmp_path):
    rows = [("a", float(t), [float(v)]) for t, v in enumerate([0, 0, 50, 90, 90, 90])] + [("b", float(t), [0.0]) for t in range(3)]
    spark.createDataFrame(rows, "source string, ts double, frame array<double>").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = spark.readStream.schema("source string, ts double, frame array<double>").parquet(f"{tmp_path}/in")
    q = frames.stream_stable_frames(stream, timeout=60, idle=1).writeStream.format("memory").queryName("turns").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("turns").count() < 3:
            time.sleep(0.5)
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r) for r in spark.sql("SELECT * FROM turns ORDER BY source, ts").collect()] == [("a", 4.0, "stable"), ("a", 5.0, "end"), ("b", 2.0, "end")]


def test_corrections_of_one_title(spark):
    texts = ["以下は評価パイプライ", "ジです。", "ジです。", "構成されま", "i :", "定番で", "Te", "す。", "「構造化された関係性」が特徴で", "1.2.3 Self-RAG", "(人名、組織、場所、出来事など)", "e ノード: 意味", "宮崎験の作品"]
    df = lines.line_metrics(make(spark, [(t, 0.8) for t in texts]))
    got = corrections.correct_lines(df, profiles=["rag-accuracy-book"]).orderBy("line_no").collect()
    assert [r.text for r in got if not r.removed] == ["以下は評価パイプライ", "ンです。", "ジです。", "構成されます：", "定番です。", "「構造化された関係性」が特徴です。", "1.2.3 Self-RAG：", "e ノード: 意味 (人名、組織、場所、出来事など)", "宮崎駿の作品"]
    assert got[6].removed and dict(got[6].corrections) == {"Te after 定番で -> removed": 1}
    assert corrections.correct_lines(df).where("size(corrections) > 0").count() == 0


def test_whole_page_job(spark):
    from pagemill.plans.pages import Options, process_pages

    rows = [("生成 Al モデルを説明する本文がここに続いています。", 0.9, 10, 100), ("KG $a RX \\ \\", 0.15, 10, 20), ("日本語の文章 ABC", 0.9, 10, 60)]
    primary = make(spark, [*rows, ("3", 0.9, 10, 900)])
    done = process_pages(primary, options=Options(profiles=("ai-rag",)))
    assert done.texts.first().text == "日本語の文章 ABC\n生成 AI モデルを説明する本文がここに続いています。"
    r = done.reports.first()
    assert r.filtered_lines == 1 and r.reordered_elements > 0 and not r.retried
    assert r.corrections == {"Al -> AI (after 生成)": 1} and [c.reasons for c in r.review_candidates] == [["mixed_script_ending"]]
    assert [len(x.words) for x in done.lines.collect()] == [1, 1]
    better = make(spark, [("もっとよく読めた本文です。" * 3, 0.95, 10, 100)])
    poor = make(spark, [("? ? ?", 0.2, 10, 100)])
    again = process_pages(poor, alternate=better, options=Options(filter_low_confidence=False))
    assert again.reports.first().retried and again.reports.first().mode == 11 and "もっと" in again.texts.first().text
    attempts = spark.createDataFrame([("b", 1, 0, 0, 0, "日本語の文章", 0.99, 0.0), ("b", 1, 0, 0, 1, "x", 0.2, 0.0)], "book string, page int, block_no int, line_no int, nth int, text string, confidence double, suspicious_ratio double")
    fixed = process_pages(primary, attempts=attempts)
    assert fixed.texts.first().text.startswith("日本語の文章\n") and fixed.reports.first().retried_lines == 1
    assert Options.of({"profiles": "a, b", "adaptive": "0"}) == Options(profiles=("a", "b"), adaptive=False)


def test_whole_page_job_with_images(spark):
    from pagemill.plans.pages import Options, process_pages

    im = np.full((1000, 600, 3), 255, np.uint8)
    im[300:500, 100:400] = (200, 40, 40)
    im[22:38, 12:28] = 0
    images = spark.createDataFrame(pd.DataFrame({"book": ["b"], "page": [1], "width": [600], "height": [1000], "pixels": [im.tobytes()]}))
    body = [("本文の長い説明がここに続いています。そして続く。", 0.95, 50, 700 + 40 * i, 500, 720 + 40 * i) for i in range(3)]
    chart = [(f"L{i}", 0.9, 120, 320 + 40 * i, 180, 340 + 40 * i) for i in range(4)]
    df = make(spark, [*body, *chart])
    marker = [("b", 1, 0, 50, 10.0, 20.0, 300.0, 40.0, 600, 1000, [("e", 12.0, 22.0, 28.0, 38.0, 0.9), ("最初の項目", 60.0, 20.0, 300.0, 40.0, 0.9)])]
    done = process_pages(df.unionByName(spark.createDataFrame(marker, LINES)), images)
    assert done.texts.first().text.splitlines() == ["最初の項目"] + ["本文の長い説明がここに続いています。そして続く。"] * 3
    assert done.reports.first().filtered_figure_lines == 4 and done.reports.first().filtered_list_markers == 1
    comic = process_pages(df, images, Options(content="manga", comic_scope="all"))
    assert comic.reports.count() == 1 and comic.texts.first().text


def test_hocr(spark):
    markup = """<div class='ocr_page' title='image "x.png"; bbox 0 0 600 800'><div class='ocr_carea'><p class='ocr_par'>
    <span class='ocr_line' title="bbox 10 20 200 40; baseline 0 -3"><span class='ocrx_word' title='bbox 10 20 60 40; x_wconf 91'>日本</span> <span class='ocrx_word' title='bbox 70 20 200 40; x_wconf 80'><strong>語</strong></span></span>
    <span class='ocr_line' title="bbox 10 50 200 70"><span class='ocrx_word' title='bbox 10 50 60 70'> </span></span></p>
    <p class='ocr_par'><span class='ocr_header'><span class='ocrx_word' title='bbox 5 90 60 110; x_wconf 50'>Head &amp; more</span></span></p></div></div>"""
    rows = spark.createDataFrame([("b", 1, markup), ("b", 2, None)], "book string, page int, value string")
    got = readers.parse_hocr(rows).orderBy("block_no", "line_no").collect()
    assert [(r.block_no, r.line_no, [w.text for w in r.words]) for r in got] == [(0, 0, ["日本", "語"]), (1, 0, ["Head & more"])]
    assert (got[0].left, got[0].bottom, got[0].page_width, got[0].page_height) == (10, 40, 600, 800)
    assert [w.confidence for w in got[0].words] == [0.91, 0.8] and (got[1].left, got[1].right) == (5, 60)


def test_rounding_is_that_of_the_exact_value(spark):
    rng = np.random.default_rng(5)
    values = [0.125, 0.375, 2.675, 1.005, 0.5, 0.0, 1.0, 0.015, 0.025, 99.995, 100.0, *(rng.integers(0, 100_000, 3000) / 1000).tolist(), *(rng.random(3000) * 100).tolist(), *(rng.integers(0, 8000, 500) / 64).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (2, 4):
        assert [r[0] for r in df.select(rounded(F.col("v"), places)).collect()] == [round(v, places) for v in values]


def test_rollup_counts_what_validation_found(spark):
    pages = spark.createDataFrame([("a", False, 2, []), ("a", True, None, []), ("b", False, 1, [("x", ["r"])])], "book string, retried boolean, filtered_lines int, review_candidates array<struct<text:string, reasons:array<string>>>")
    post = spark.createDataFrame([("a",)], "book string")
    rows = lambda *post: {r.book: (r.pages, r.retried_pages, r.filtered_lines, r.retried_lines, r.candidates, r.post_candidates, r.automated_checks_passed) for r in reports.rollup(pages, *post).collect()}
    assert rows() == {"a": (2, 1, 2, 0, 0, 0, True), "b": (1, 0, 1, 0, 1, 0, False)}
    assert rows(post) == {"a": (2, 1, 2, 0, 0, 1, False), "b": (1, 0, 1, 0, 1, 0, False)}
