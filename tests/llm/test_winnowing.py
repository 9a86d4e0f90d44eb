import hashlib
import random

import pytest

from pagemill.llm import queries, winnowing


def gram_hash(gram):
    h = 0
    for c in gram:
        h = (h * winnowing.BASE + ord(c)) % winnowing.PRIME
    return h + 1


def selected(text, gram, window):
    """(hash, position) by the definition: of each window the rightmost least hash."""
    k = min(gram, len(text))
    h = [gram_hash(text[i : i + k]) for i in range(len(text) - k + 1)] if text else []
    found = []
    for i in range(max(1, len(h) - window + 1) if h else 0):
        part = h[i : i + window]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if at not in found:
            found.append(at)
    return [(h[i], i) for i in found]


def edited(a, b):
    n = len(a) // 2
    return a[: len(a) - n] + b[:n]


def parsed(text):
    return [(int(x[:-8], 16), int(x[-8:], 16)) for x in text.split(" ")] if text else []


def same(row, text, after, gram=winnowing.GRAM, window=winnowing.WINDOW):
    e = edited(text, after)
    assert row.n_chars == len(text)
    assert row.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    own, ed, nx = (selected(x, gram, window) for x in (text, e, after))
    assert parsed(row.fingerprint) == own
    assert parsed(row.edited_fingerprint) == ed
    for value, other in ((row.near_edited, ed), (row.near_next, nx)):
        x, y = {h for h, _ in own}, {h for h, _ in other}
        assert value == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


@pytest.mark.parametrize(("gram", "window", "piece"), [(8, 8, 4096), (4, 2, 16), (8, 4, 32), (2, 8, 7)])
def test_against_the_definition(spark, gram, window, piece):
    rng = random.Random(gram * window)
    texts = [None, "", " \n", "one", "a" * 50, "é ü\t日本 x\x0by z", "\U0001f600 " * 9 + "end", "\U0001f600"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(n))) for n in (20, 20, 40, 40, 40, 90, 90, 200, 200) for _ in range(4)]
    texts += ["the same text here"] * 3 + ["".join(chr(rng.randrange(0x4E00, 0x4E20)) for _ in range(120))]
    rng.shuffle(texts)
    rows = [(7 * i - 20, t, 0, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, grams string").repartition(3)
    got = {r.doc_id: r for r in winnowing.fingerprint(df, gram, window, piece).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(rows):
        same(got[i], t or "", rows[(k + 1) % len(rows)][1] or "", gram, window)


def test_a_very_long_text_without_spaces(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef日本") for _ in range(150_000))
    rows = [(1, "short one to begin with"), (2, long), (3, "a" * 30_000), (4, "end")]
    got = {r.doc_id: r for r in winnowing.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        same(got[i], t, rows[(k + 1) % 4][1])


def test_shared_runs_share_a_fingerprint(spark):
    rng = random.Random(9)
    run = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    rows = [(i, f"{i}x" * rng.randrange(60) + run + " tail" * i) for i in range(20)]
    got = winnowing.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set.intersection(*({h for h, _ in parsed(r.fingerprint)} for r in got))


def test_short_and_unspaced_texts_stay_near_their_edits(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8)))
    unspaced = lambda low, n: "".join(chr(rng.randrange(low, low + 80)) for _ in range(n))
    texts = [" ".join(word() for _ in range(n)) for n in range(8, 41)]
    texts += [unspaced(low, n) for low in (0x4E00, 0x3042, 0x0E01) for n in (60, 80, 400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "abc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        same(got[i], t or "", rows[(k + 1) % len(rows)][1] or "")
        if i < 900:
            assert got[i].near_edited > max(0.05, got[i].near_next)


def test_repeated_and_missing_ids(spark):
    rows = [(None, "x y z w v"), (None, "x y z w v"), (-(1 << 63), "x y z w v"), (1, "b b b b b"), (1, "a a a a a"), (1, "a a a a a"), (9, "c c")]
    got = winnowing.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.fingerprint), set()).add((r.edited_sha256, r.near_next))
    assert all(len(v) == 1 for v in by.values())  # equal rows, equal results
    one = winnowing.fingerprint(spark.createDataFrame([(4, "only me, all alone")], "doc_id long, text string")).first()
    same(one, "only me, all alone", "only me, all alone")
    assert winnowing.fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id long, text string")
    plan = winnowing.fingerprint(df)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan.replace("PythonRDD", "")
