import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagemill.llm import packing

PATH = packing.default_tokenizer()
TEXTS = [None, "", " ", "  two  spaces ", "\n\nlead", " lead", "trail ", "Plain words, and more.\nNext line", "tab\there  nbsp 　wide", "É日本 語 text's don't WE'LL", "x" * 5000, " " * 300_000 + "x" * 200_000, "word " * 3000, "a\x1cb \x1cc", "<|endoftext|> is text", "1 22 333 !? ...", "́ combining \U0001f600 emoji", "line one \nline two", "a b  c\r\n d"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


SLOW = Tokenizer.from_file(PATH)
SLOW.encode_special_tokens = True


def whole(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_whole_texts(text, encoder):
    assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == whole(text)


def test_random_texts(encoder):
    rng = random.Random(2)
    e = encoder
    for _ in range(400):
        t = "".join(rng.choice(["a", "Bc", " ", " ", "\n", "é", "9", "'s", "!", "\t", "日", " ", "word", "\x1d"]) for _ in range(rng.randrange(30)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == whole(t)


def least(counts, capacity):
    """Fewest sequences by exhaustive search."""
    items = sorted(Counter(counts).elements(), reverse=True)
    best = [len(items)]

    def go(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(items):
            best[0] = len(gaps)
            return
        for g in sorted({g for g in gaps if g >= items[i]}):
            left = list(gaps)
            left.remove(g)
            go(i + 1, [*left, g - items[i]])
        go(i + 1, [*gaps, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plan():
    rng = random.Random(3)
    for _ in range(150):
        counts = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
        found = packing.plan(counts, 12)
        used = Counter()
        for pattern, times in found:
            assert sum(pattern) <= 12 and times > 0
            for x in pattern:
                used[x] += times
        assert used == Counter(counts)
        assert sum(t for _, t in found) <= least(counts, 12) + 1
    assert packing.plan({}) == []
    with pytest.raises(ValueError, match="0 tokens"):
        packing.plan({0: 1})


def test_plan_of_many_pieces_is_small():
    rng = random.Random(4)
    counts = {x: rng.randint(1, 10**9) for x in range(1, 2049)}
    found = packing.plan(counts)
    assert len(found) < 5000
    total = sum(x * n for x, n in counts.items())
    assert sum(t for _, t in found) <= 1.04 * total / 2048 + 10


def test_pack(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma,", "Δ"]) for _ in range(rng.randrange(4000))) for _ in range(40)] + ["same text"] * 300
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, "again", 1, "x"), (3, "again", 1, "x"), (None, "no id", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string")
    got = packing.pack(df, capacity=256, with_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
        assert len(r.ids) == r.length <= 256
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == i and i != 3), key=lambda r: r.piece)
        if i != 3:
            assert [x for r in own for x in r.ids] == [*whole(t), 0]
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
            assert all(r.length == 256 for r in own[1:])
    assert sum(r.doc_id is None for r in got) == 1
    total = sum(r.length for r in got)
    assert len(by) <= total / 256 * 1.02 + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
