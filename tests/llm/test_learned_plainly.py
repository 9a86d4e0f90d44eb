"""Learned operators against plain restatements of how they score, and samples that repeated rows must not fill."""

import math
import random

import numpy as np
import pytest

from pagemill.llm import codes, langid, toxicity
from tests.llm.test_models import SYLLABLES, prose

MIX = 0x9E3779B97F4A7C15


def bucket(gram, bits):
    h = len(gram)
    for c in gram:
        h = (h ^ c) * MIX % 2**64
        h ^= h >> 29
    return (h * MIX % 2**64) >> (64 - bits)


def spaced(text, digits):
    out = [0]
    for c in text.lower():
        if c.isalpha() or (digits and c.isalnum()):
            out.append(ord(c))
        elif out[-1]:
            out.append(0)
    return out + [0] * bool(out[-1])


@pytest.mark.parametrize("drawn", [0, 1, 2])
def test_copies_of_one_row_take_no_language_away(spark, drawn):
    rng = random.Random(drawn)
    copy = (7 + drawn, prose(rng, "aa", 12), "aa")
    rows = [copy] * 20_000 + [(100 + i, prose(rng, "cc", 12), "zz") for i in range(398)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "zz"]
    got = langid.predict(spark.createDataFrame([(1, copy[1]), (2, prose(rng, "cc", 30))], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "aa", 2: "zz"}


def test_many_languages_all_have_centroids(spark):
    rng = random.Random(5)
    rows = [(i, "".join(chr(97 + (i % 130 * 7 + rng.randrange(3)) % 26) for _ in range(20)), f"l{i % 130:03d}") for i in range(130 * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 130 and set(model.of.tolist()) == set(range(130))


def test_language_scores_plainly(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(2, 40)), lang) for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [*(t for _, t, _ in rows[:40]), "Ünïcode 日本 x", "a", "b c"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        x, tf = spaced(t, False), {}
        for n in langid.ORDERS:
            for j in range(len(x) - n + 1):
                b = bucket(x[j : j + n], langid.BITS)
                tf[b] = tf.get(b, 0) + 1
        v = {b: math.sqrt(n) * float(model.idf[b]) for b, n in tf.items()}
        norm = math.sqrt(sum(y * y for y in v.values()))
        best = [max(sum(y * float(c[b]) for b, y in v.items()) / norm for c, of in zip(model.centroids, model.of) if of == k) for k in range(len(model.langs))]
        top = max(best)
        assert got[i].lang_pred == model.langs[best.index(top)]
        assert got[i].score == pytest.approx(1 / sum(math.exp((b - top) / 0.05) for b in best), abs=1e-3)
        assert got[i].distance == pytest.approx(1 - top, abs=1e-4)


def model_of(rng):
    return toxicity.Model(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -0.1, 1.7, 0.3)


def plain_score(model, text):
    x = spaced(text, True)
    words, windows = [], []
    for c in x[1:]:
        if c == 0:
            words.append([])
    words, at = [[] for _ in words], 0
    for j in range(len(x)):
        at += x[j] == 0 and j > 0
        for n in toxicity.ORDERS:
            g = x[j : j + n]
            if len(g) == n and all(g[1:-1]):
                words[at + (g[0] == 0 and n > 1) - (g[0] == 0) if at < len(words) else -1].append(bucket(g, toxicity.BITS))
    if not any(words):
        return 0.0
    halves = [sum(words[i : i + toxicity.HALF], []) for i in range(0, len(words), toxicity.HALF)]
    windows = [set(a) | set(b) for a, b in zip(halves, halves[1:])] or [set(halves[0])]
    z = max(sum(float(model.weight[b]) for b in w) / (len(w) + toxicity.PRIOR) + model.bias for w in windows)
    return 1 / (1 + math.exp(-(model.slope * z + model.offset)))


def test_toxicity_scores_plainly():
    rng = random.Random(3)
    model = model_of(np.random.default_rng(3))
    for n in (1, 2, 15, 16, 17, 33, 50, 200):
        t = prose(rng, "bb", n)
        assert model.score(t) == pytest.approx(plain_score(model, t), abs=1e-4)
    assert model.score("") == model.score(None) == model.score("!!") == 0.0


@pytest.mark.parametrize("drawn", [0, 1])
def test_copies_of_one_label_or_document_take_no_label_away(spark, drawn):
    rng = random.Random(6)
    docs = [(i, prose(rng, "aa", 30) + (" grobnax vilptor" if i % 3 == 0 else "")) for i in range(120)]
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    many = docs + [docs[drawn]] * 20_000
    ls = spark.createDataFrame(labels + [labels[drawn]] * 20_000, "doc_id long, y int")
    model = toxicity.fit(spark.createDataFrame(many, "doc_id long, text string"), ls, sample=100)
    assert model is not None
    assert model.score(docs[3][1]) > model.score(docs[4][1])


def test_a_window_across_a_cut_is_seen_whole():
    rng = random.Random(8)
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0, 1.0, 0.0)
    passage = " ".join(f"grob{i}nax" for i in range(14))
    h, _ = toxicity.subwords(passage)
    model.weight[h] = 5.0
    alone = model.score(passage)
    plain = prose(rng, "aa", 300_000)
    cut = len(next(codes.segments(plain)))
    at = plain.rfind(" ", 0, cut - len(passage) // 2)
    long = plain[:at] + " " + passage + plain[at:]
    assert len(list(codes.segments(long))) > 1
    assert model.peak(long) > 0.5 * model.peak(passage) and alone > 0.5
