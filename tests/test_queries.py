"""Every registered query of the library's own operators against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from pagemill.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v if not hasattr(v, "as_tuple") else round(float(v), 6)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=repr)
    assert got or name in ("merge_dedupe", "review_candidates"), "no rows"
    if name in ORACLE_SQL:
        own = tables.execute(f"SELECT * FROM ({ORACLE_SQL[name]})")
        at = {d[0]: i for i, d in enumerate(own.description)}
        assert sorted(at) == names
        want = sorted((tuple(plain(r[at[c]]) for c in names) for r in own.fetchall()), key=repr)
        for g, w in zip(got, want):
            assert g == w
        assert len(got) == len(want)
