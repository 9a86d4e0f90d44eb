import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash
from pagemill.llm.components import connected_components


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps, radius):
    ids = sorted(fps)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in ids}


TEXTS = [None, "", " \t\n", "one", "ONE", "one two", "One two THREE four", "É é x y z w", "a b c d e f g h i j k", "a b c d e f g h i j k", "word " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)


def test_groups_against_brute_force(spark):
    base = " ".join(f"w{i % 97}x{i}" for i in range(400))
    near = [base.replace(f"w{i}x{i} ", f"v{i} ") for i in range(5, 60)]
    rows = [(i, t, i, "clash") for i, t in enumerate(TEXTS + near + [f"other {i} text number {i * i} of many" for i in range(60)])]
    rows.append((3, "one", 0, "again"))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {i: plain(t) for i, t, *_ in rows}
    want = components_of(fps, 2)
    for r in got:
        assert r.fp & (2**64 - 1) == fps[r.doc_id]
        assert r.component_id == want[r.doc_id]


def test_tiles_are_split_and_complete(spark):
    rng = __import__("random").Random(1)
    seeds = [rng.getrandbits(64) for _ in range(150)]
    fps = sorted({s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(4)} | set(seeds) | {0, 1, 3, 2**64 - 1, 2**64 - 2})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    want = {i: c for i, c in components_of(dict(enumerate(fps)), 2).items()}
    for blocks, tile in ((4, 2), (2, 16), (8, 2048)):
        got = dict(connected_components(simhash.links(df, 2, blocks, tile)).collect())
        assert {i: got.get(i, i) for i in want} == want


def test_cells_of_many_parts(spark):
    rng = __import__("random").Random(2)

    def balanced():  # four blocks of eight bits set each, so that all lie in one cell
        return sum(1 << (16 * b + i) for b in range(4) for i in rng.sample(range(16), 8))

    def moved(f):  # one bit to another place of its block: two bits differ
        b = 16 * rng.randrange(4)
        i, j = (rng.choice([k for k in range(b, b + 16) if (f >> k & 1) == v]) for v in (1, 0))
        return f ^ 1 << i ^ 1 << j

    fps = {balanced() for _ in range(120)}
    for _ in range(3):
        fps |= {moved(f) for f in list(fps)[:140]}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    tile = len(fps) // 60
    own = simhash.dealt(df, 2, 4, tile).where("home")
    assert own.select("cell").distinct().count() == 1 and own.select("part").distinct().count() >= 50
    want = components_of(dict(enumerate(fps)), 2)
    assert len(set(want.values())) < len(fps) - 100
    for blocks, chunk in ((4, 3), (4, 8192), (None, 8192)):
        got = dict(connected_components(simhash.links(df, 2, blocks, tile, chunk)).collect())
        assert {i: got.get(i, i) for i in want} == want


def test_rows_moved_follow_the_fingerprints(spark):
    """With cells that fill up, more blocks are taken: rows moved stay in proportion."""
    def each(n, tile):
        nodes = spark.range(n).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node"))
        return simhash.blocks_for(nodes, 2, tile), simhash.dealt(nodes, 2, simhash.blocks_for(nodes, 2, tile), tile).count() / n

    (few, a), (more, b) = each(2_000, 64), each(200_000, 16)
    assert few < more and b < 100 and a < 100, (few, a, more, b)
    assert each(200_000, 8192)[1] < 23


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 150)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 200: 150, 150: 150}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
