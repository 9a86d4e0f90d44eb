"""The learned operators: held-out accuracy on made-up languages, and every odd input."""

import random

import numpy as np
import pytest

from pagemill.llm import langid, quality, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ra"], "bb": ["sch", "eit", "ung", "ver", "ge"], "cc": ["eau", "ion", "oux", "ment", "re"]}
ODD = [None, "", " \n", "123 456 !!", "x", "日本語のテキスト", "\U0001f600", "a" * 3000, "word " * 50_000]


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 80)), lang, "x", 1.0) for i in range(600)]
    rows += [(1000, prose(rng, "aa", 20), None, "x", 1.0), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(df.where("doc_id % 2 = 0"))
    assert model.langs == sorted(SYLLABLES)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id % 2 == 1]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    by = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    for i, t in enumerate(ODD):
        assert (by[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert by[i].lang_pred in (*model.langs, "und")
    assert by[5].rejected
    assert not by[0].score


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.fit(df) is None
    assert langid.predict(df, None).first().lang_pred == "und"
    assert langid.predict(df.where("false"), None).count() == 0


def test_centroids_are_of_whole_corpus_frequencies(spark):
    rows = [(i, "ab ab cd" if i % 2 else "ef gh", "l" if i % 2 else "m") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=2)
    df = sum((langid.counts(t) > 0).astype(int) for _, t, _ in rows)
    assert np.allclose(model.idf, np.log((1 + 40) / (1 + df)) + 0.1, atol=1e-5)


def labelled(rng):
    docs, labels = [], []
    for i in range(700):
        good = rng.random() < 0.6
        words = prose(rng, "aa", rng.randint(30, 150)).split()
        if not good:
            words = [w + "$$$" for w in words] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "x", 0.5))
        if i % 3 == 0:
            labels.append((i, int(good)))
    return docs, labels


def test_quality(spark):
    docs, labels = labelled(random.Random(2))
    df = spark.createDataFrame(docs + [docs[3], (None, "no id", "x", 0.1)], "doc_id long, text string, score string, x double")
    ls = spark.createDataFrame([*labels, (0, None), (99_999, 1), (None, 1)], "doc_id long, y int")
    got = quality.score(df, ls).collect()
    assert len(got) == len(docs) + 2
    truth = {i: "$" not in t and not t.isupper() for i, t, *_ in docs}
    held = [r for r in got if r.doc_id is not None and r.doc_id % 3]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert len(quality.score(odd, ls.where("false")).collect()) == len(ODD)
    assert quality.score(df.where("false"), ls).count() == 0


def test_normal_equations_are_those_of_all_rows(spark):
    docs, labels = labelled(random.Random(3))
    x = quality.described(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"))
    own = x.join(spark.createDataFrame(labels, "doc_id long, y int"), "doc_id")
    model = quality.fit(own, width=16)
    held = {r[0] for r in own.selectExpr("doc_id").where("pmod(xxhash64(doc_id), 5) = 0").collect()}
    rows = [r for r in own.collect() if r.doc_id not in held]
    z = model.features(np.array([r.x for r in rows]))
    y = np.array([r.y for r in rows])
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(rows) / 17 * np.eye(17), z.T @ y)
    assert np.allclose(beta, model.beta, atol=1e-6)


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["grobnax", "vilptor", "snurgid"]
    docs, labels = [], []
    for i in range(700):
        words = prose(rng, rng.choice(list(SYLLABLES)), rng.randint(20, 300)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w = rng.choice(bad)
                if i % 3 == 1:  # a misspelling that no label shows
                    k = rng.randrange(2, len(w))
                    w = w[:k] + w[k - 1] + w[k:]
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), 0))
        if i % 3 != 1:
            labels.append((i, int(toxic)))
    df = spark.createDataFrame([*docs, docs[4]], "doc_id long, text string, y int")
    ls = spark.createDataFrame([*labels, (3, None), (99_999, 1)], "doc_id long, y int")
    model = toxicity.fit(df, ls)
    got = toxicity.predict(df, model).collect()
    assert len(got) == len(docs) + 1
    held = [r for r in got if r.doc_id % 3 == 1]
    hit = [r.predicted == (r.doc_id % 4 == 0) for r in held]
    assert np.mean(hit) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.score for r in toxicity.predict(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), model).collect()}
    assert odd[0] == odd[1] == odd[2] == 0
    again = toxicity.fit(df.repartition(5), ls)
    assert np.array_equal(again.weight, model.weight) and again.slope == pytest.approx(model.slope)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert toxicity.fit(df, spark.createDataFrame([(1, 1)], "doc_id long, y int")) is None
    assert toxicity.predict(df, None).first().score == 0.0
