"""The SimHash stage on missing and clashing ids."""

from collections import Counter

import corpus_pipeline
from pagemill.llm import simhash
from tests.llm.test_simhash import components_of, plain


def test_missing_and_clashing_ids_lose_no_text(spark):
    prose = lambda k: " ".join(f"{k}w{i * (k + 3) % 89}x{i}" for i in range(300))
    near = next(t for i in range(300) if plain(t := prose(1).replace(f"x{i} ", "y ", 1)) != plain(prose(1)) and (plain(t) ^ plain(prose(1))).bit_count() <= 2)
    rows = [(None, prose(1)), (None, near), (None, prose(2)), (None, prose(2)), (None, prose(3)), (5, prose(4)), (5, prose(5)), (6, prose(3)), (7, prose(6))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_distinct(spark, docs, "").collect()
    top = components_of(dict(enumerate(plain(t) for _, t in rows)), 2)
    assert len(got) == len(set(top.values())) == 6
    left = Counter((r.doc_id, r.text) for r in got)
    assert left[None, prose(1)] + left[None, near] == 1
    assert left - Counter({(None, prose(1)): 1, (None, near): 1}) == Counter([(None, prose(2)), (6, prose(3)), (5, prose(4)), (5, prose(5)), (7, prose(6))])
    ids = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert ids[None, plain(prose(3))] == 6 and ids[None, plain(near)] is None
