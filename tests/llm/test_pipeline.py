"""run() against the stages' definitions, restated plainly over a small corpus."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pagemill.llm import mixing, packing
from tests.llm.test_quality_rules import base_of
from tests.llm.test_simhash import components_of, plain
from tests.llm.test_suffix_dedup import plain as repeated_of


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(90)
    rows = []
    for i in range(160):
        t = prose(rng.randint(60, 200))
        if i % 9 == 0:
            t = t + "\n" + shared + "\n" + prose(30)
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t)))
    copy = rows[5][1]
    rows += [(200 + i, copy, "en", "a", len(copy)) for i in range(20)]
    rows += [(300, None, "en", "a", 0), (301, "", None, "b", 0), (302, "too short", "en", "b", 9), (303, "spam spam spam " * 40, "en", "b", 600), (7, rows[7][1], *rows[7][2:])]
    rows += [(304, " ".join(f"{w}###$$$" for w in prose(80).split()), "en", "a", 1000)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string").write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_stages(spark, tables):
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    (_, good), (_, near), (_, cut), (_, mixed), (_, pack) = corpus_pipeline.STAGES

    kept = good(spark, docs, at)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    kept = [tuple(r) for r in kept.collect()]
    passed = [r for r in rows if not base_of(r[1])[-1]]
    assert not Counter(kept) - Counter(passed)
    assert {r[0] for r in passed} - {r[0] for r in kept} == {304}

    frame = lambda rs: spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long")
    single = [tuple(r) for r in near(spark, frame(kept), at).collect()]
    top = components_of({r[0]: plain(r[1]) for r in kept}, 2)
    assert Counter(r[0] for r in single) == Counter(set(top.values()))
    assert set(single) <= set(kept)

    short = {r[0]: tuple(r) for r in cut(spark, frame(single), at).collect()}
    assert len(short) == len(single)
    for r, (size, gone, _, _) in zip(single, repeated_of([r[1] for r in single], 400), strict=True):
        t = short[r[0]]
        assert len(t[1].encode()) == size - gone and t[4] == len(t[1]) and t[2:4] == r[2:4]
    assert any(len(short[r[0]][1]) < len(r[1]) for r in single)

    taken = [tuple(r) for r in mixed(spark, frame(list(short.values())), at).collect()]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums, got = defaultdict(int), defaultdict(int)
    for r in short.values():
        sums[r[3]] += words(r[1])
    for r in taken:
        got[r[3]] += words(r[1])
    aim = mixing.targets(list(sums.items()))
    assert all(abs(got[s] - aim[s]) <= 20 for s in sums)
    assert max(Counter(taken).values()) <= 2

    pieces = pack(spark, frame(taken), at).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    want = Counter(r[0] for r in taken for _ in range(-(-(len(encoder.encode(r[1])) // 4 + 1) // 2048)))
    assert Counter(r.doc_id for r in pieces) == want


def test_run_is_the_stages_in_turn(spark, tables):
    at, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, docs.collect())) == Counter(map(key, corpus_pipeline.run(spark, at).collect()))


def test_equal_rows_are_mixed_as_often_as_taken(spark, tables):
    rows = [(1, "one two three", "en", "a", 13)] * 5 + [(2, "x", "en", "b", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert got == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_of_fifty_words_are_cut(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [prose(rng.randint(51, 60)) for _ in range(12)]
    assert max(map(len, passages)) < 450
    rows = []
    for i in range(60):
        t = f"{prose(80)}\n{passages[i % 12]}\n{prose(80)}" if i < 36 else prose(160)
        rows.append((i, t, "en", "a", len(t)))
    cut = corpus_pipeline.STAGES[2][1]
    got = {r.doc_id: r.text for r in cut(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect()}
    for i, t, *_ in rows:
        if i < 36:
            middle = " ".join(passages[i % 12].split()[5:45])
            assert middle not in got[i] and len(got[i]) > 0.6 * len(t) - len(passages[i % 12])
        else:
            assert got[i] == t
