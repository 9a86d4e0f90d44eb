import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import suffix_dedup as sd

SMALL = sd.Shape(length=28, gram=8, widths=(6, 2, 1), stretch=100, per_bucket=60)


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if starts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = int((gone[1:] < gone[:-1]).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, shape, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "x", 0) for i, t in zip(ids, texts)]
    got = sd.dedup(spark.createDataFrame(rows, "doc_id long, text string, lead string, pos int"), shape).collect()
    want = Counter((i, *w) for i, w in zip(ids, plain(texts, shape.length)))
    assert Counter(tuple(r) for r in got) == want


def noise(rng, n, letters="abcdefghijklmnop é"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [noise(rng, rng.randrange(20, 400)) for _ in range(8)]
    texts = [None, "", "short", noise(rng, 27), "a" * 300, "ab" * 90, "a" * 28, "b" * 29]
    for _ in range(60):
        parts = [noise(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            parts += [b[i : i + rng.choice([26, 27, 28, 29, 35, 60, 300])], noise(rng, rng.randrange(30))]
        texts.append("".join(parts))
    texts += [base[0]] * 3 + [base[1], base[1][:-1] + "Z", "Y" + base[1]]
    check(spark, texts, SMALL)


def test_few_letters_tie(spark):
    rng = random.Random(7)
    check(spark, [noise(rng, rng.randrange(150), "ab") for _ in range(40)] + ["ab" * 30 + "c", "ba" * 30], SMALL)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(8)
    t, u = noise(rng, 90), noise(rng, 120)
    check(spark, [t, t, u, u, t[10:60], noise(rng, 80)], SMALL, [5, 5, None, 6, 7, None])


def test_production_shape(spark):
    rng = random.Random(9)
    p, q = noise(rng, 401), noise(rng, 700)
    texts = [noise(rng, 900) for _ in range(30)]
    texts += [noise(rng, 10) + p + noise(rng, 500), noise(rng, 300) + p, q[:399] + noise(rng, 50), q, noise(rng, 80) + q[150:560] + noise(rng, 9), p[:-2] + "é" + noise(rng, 99)]
    texts += [q + q[5:], "z" * 5000]
    check(spark, texts, sd.Shape())


def test_nothing_repeats_and_empty(spark):
    check(spark, ["only one short", None], SMALL)
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 4, 500) for _ in range(3)]
    order, new = sd.multikey_order(*keys)
    rows = [tuple(int(k[i]) for k in keys) for i in order]
    assert rows == sorted(rows)
    for d in range(3):
        assert new[d].tolist() == [i == 0 or rows[i][: d + 1] != rows[i - 1][: d + 1] for i in range(500)]
