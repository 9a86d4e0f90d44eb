import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np

from pagemill.llm import mixing


def nearest(lengths, counts, budget):
    sums = {sum(x * k for x, k in zip(lengths, ks)) for ks in product(*(range(n + 1) for n in counts))}
    return min(abs(s - budget) for s in sums)


def test_fit_against_every_choice():
    rng = random.Random(1)
    for _ in range(300):
        lengths = rng.sample(range(1, 30), rng.randint(1, 4))
        counts = [rng.randint(1, 4) for _ in lengths]
        total = sum(map(lambda x, n: x * n, lengths, counts))
        budget = rng.randint(0, total)
        got = mixing.fit(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        off = abs(int(np.dot(got, lengths)) - budget)
        assert off <= nearest(lengths, counts, budget) + max(lengths)
        if 1 in lengths and counts[lengths.index(1)] >= 4:
            assert off <= max(lengths)


def test_fit_is_exact_where_lengths_allow():
    rng = random.Random(2)
    lengths = list(range(1, 400)) + [20_000, 1_000_000]
    counts = [rng.randint(1, 10**7) for _ in lengths]
    total = sum(map(lambda x, n: x * n, lengths, counts))
    for budget in (0, 1, 17, total // 3, total - 1, total, total + 5):
        got = mixing.fit(lengths, counts, budget)
        assert sum(int(a) * b for a, b in zip(got, lengths)) == min(budget, total)


def test_targets():
    sizes = [(None, 100), ("b", 100), ("a", 10), ("c", 1000)]
    # a: 5, b: 2, c: 1, null: 5 of 1815; a stops at 20, null at 200, b at 200, c takes the rest
    assert mixing.targets(sizes) == {"a": 20.0, None: 200.0, "b": 200.0, "c": 1395.0}
    even = mixing.targets([("x", 80), ("y", 80), ("z", 80)], (5, 2, 1))
    assert even == {"x": 160.0, "y": 400 / 3, "z": 200 / 3}
    assert mixing.targets([]) == {}


def test_mix(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        s = rng.choice(["a", "a", "a", "b", "é", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([1, 2, 3, 5, 8, 40, 40, 200]))), s, i, "x"))
    rows += [(1000, None, "a", 0, ""), (1001, "", None, 0, ""), (1002, " \t\n", "empty", 0, ""), (5, "w x", "b", 0, ""), (5, "w x", "b", 0, ""), (None, "no id", "b", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, tag string")
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, s, *_ in rows)
    sums, taken = defaultdict(int), defaultdict(int)
    for _, t, s, *_ in rows:
        sums[s] += size(t)
    aim = mixing.targets(list(sums.items()))
    for r in got:
        assert r.source_size == sums[r.source] and r.target == aim[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sums:
        assert abs(taken[s] - aim[s]) <= 1, s
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
