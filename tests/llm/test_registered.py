"""Every registered query of this package on the smallest tables: its SQL where it has one, its columns and folds."""

import zlib
from pathlib import Path

import duckdb
import pytest

from pagemill.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_licenses": {"doc_id", "license", "confirmed"},
    "op8_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_simhash": {"doc_id", "fingerprint", "component_id"},
    "op10_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
}
FOLDS = {"op1_language": (3, 1), "op2_quality": (4, 2), "op4_toxicity": (3, 1)}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, DATA)
    assert COLUMNS[name] <= set(df.columns)
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    ids = sorted(i for (i,) in tables.execute("SELECT doc_id FROM documents").fetchall())
    if name not in ("op7_licenses", "op10_packing"):
        assert sorted(r.doc_id for r in rows) == ids
    else:
        assert {r.doc_id for r in rows} <= set(ids)
    if name in FOLDS:
        of, held = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == held) for r in rows)
        assert {r.held_out for r in rows} == {True, False}
    if name in queries.ORACLE_SQL:
        want = tables.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_held_out_labels_are_not_learned(spark, tmp_path, name):
    """Turning every held-out label leaves each score as it was."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    of, held = FOLDS[name]
    out = f"crc32(cast(doc_id as string)) % {of} = {held}"
    turned = docs.selectExpr("doc_id", "text", f"CASE WHEN {out} THEN 'xx' ELSE lang END AS lang", "source", "n_chars")
    turned.write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id", f"CASE WHEN {out} THEN 1 - quality ELSE quality END AS quality", f"CASE WHEN {out} THEN 1 - toxic ELSE toxic END AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    a, b = ({r.doc_id: r.score for r in queries.QUERIES[name](spark, d).collect()} for d in (DATA, str(tmp_path)))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)
