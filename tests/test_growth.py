"""Queries whose work must grow with their input alone: plans without repeated work, and results that stay the same."""

import numpy as np

from pagemill.operators import pixels
from pagemill.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_screens_are_dealt_out_and_made_of_whole_rows(spark):
    shots = queries.screens(spark, DATA)
    assert shots.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert "lambda" not in plan(shots)
    for r in shots.where("page in (1, 29, 30, 149)").collect():
        want = np.full((100, 120, 3), 255, np.uint8)
        want[: 14 + r.page % 50] = 200
        want[:, : r.page % 30] = 20
        assert (r.width, r.height, bytes(r.pixels)) == (120, 100, want.tobytes())


def test_samples_of_odd_sized_pictures():
    rng = np.random.default_rng(3)
    for _ in range(200):
        im = rng.integers(0, 256, (*rng.integers(1, 90, 2), 3)).astype(np.int16)
        part = im[::2, ::3]
        assert (pixels._channels(np.maximum, part) == part.max(2)).all() and (pixels._channels(np.minimum, part) == part.min(2)).all()


def test_line_texts_are_made_once_a_row(spark):
    for name in ("review_candidates", "page_text", "figure_regions"):
        assert plan(queries.QUERIES[name](spark, DATA)).count("array_join(") <= (2 if name == "page_text" else 1), name


def test_page_text_is_one_shuffle_and_figures_join_nothing(spark):
    assert "Join" not in plan(queries.page_text(spark, DATA)) and "Join" not in plan(queries.figure_regions(spark, DATA))


def test_lines_pass_by_a_hash_of_pages(spark):
    made = queries.preferred_recogniser(spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert made.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in made


def test_needed_strings_of_patterns(spark):
    from pagemill.operators.corrections import needed

    known = {"a|b": "", "abc?d": "ab", "ab{2}c": "a", "[0-9]+": "", r"\bthe\b": "the", "(?i)abc": "", "x(abc)?yz": "yz", r"\x41bc": "", r"\p{L}bc": "", r"(?<![A-Za-z])J\s+udge\b": "udge", r"(?<=生成 )Al(?![a-z])": "Al"}
    assert {p: needed(p) for p in known} == known
    assert "contains(" in plan(queries.context_corrections(spark, DATA)).lower()


def test_markers_read_written_lines(spark):
    assert "pages-" in "".join(queries.list_markers(spark, DATA).inputFiles())
