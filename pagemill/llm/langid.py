"""Language identification: nearest of several clustered TF-IDF centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.codes import gram_buckets, kinds, segments, spaced
from pagemill.llm.shared import column, pieces

BITS, ORDERS, CLUSTERS, SAMPLE, SAMPLE_IN_ALL = 12, (1, 2, 3), 4, 600, 2400
UNKNOWN = "und"


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of a text's hashed letter n-grams, of orders 1 to 3, words bounded by a blank."""
    found = np.zeros(1 << bits, np.int64)
    for part in segments(text):
        x = spaced(part)
        for n in ORDERS:
            found += np.bincount(gram_buckets(x, n, bits), minlength=1 << bits)
    return found


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return bool((kinds()[x[x < 1 << 16]] == 2).any()) or any(chr(c).isalpha() for c in x[x >= 1 << 16])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means, started from vectors far from those chosen before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(v)))]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        far = np.maximum(0, 1 - near) + 1e-9
        chosen.append(int(rng.choice(len(v), p=far / far.sum())))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = unit(np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    farthest: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return unit(np.sqrt(tf).astype(np.float32) * self.idf)

    def classify(self, tf: np.ndarray, heat: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of counts: the language's number, a score from 0 to 1 and the distance to its centroid."""
        cos = self.vectors(tf) @ self.centroids.T
        best = np.stack([cos[:, self.of == i].max(1) for i in range(len(self.langs))], 1)
        lang = best.argmax(1)
        top = best[np.arange(len(best)), lang]
        share = 1 / np.exp((best - top[:, None]) / heat).sum(1)
        return lang, share, 1 - top


def fit(train: DataFrame, bits: int = BITS, clusters: int = CLUSTERS, sample: int = SAMPLE, sample_in_all: int = SAMPLE_IN_ALL) -> Model | None:
    """A model of train (doc_id, text, lang), whose rows without a lang are left out; None if there are none.

    Document frequencies are counted over all rows. Centroids are clustered from at most `sample` documents of
    each language, and sample_in_all in all but one of each language at least, chosen by a hash of doc_id and text; rows
    equal in these count once.
    """
    own = train.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("draw"))
    counted = own.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least")).collect()  # a row per language
    per = {r["lang"]: r["n"] for r in counted}
    least = {r["lang"]: r["least"] for r in counted}
    if not per:
        return None
    each = max(1, min(sample, sample_in_all // len(per)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in column(b, "text").to_pylist():
                df += counts(t, bits) > 0
                n += 1
        held = np.append(np.flatnonzero(df), -1)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.append(df[held[:-1]], n))], ["bucket", "df"])

    df = np.zeros((1 << bits) + 1, np.int64)
    for r in own.select("text").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # 2 ** bits + 1 rows at most
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.1)
    # Somewhat more than needed is drawn of each language, its least draw at any rate, and the lowest draws of each are kept.
    limit = F.element_at(F.create_map(*(F.lit(x) for lang, n in per.items() for x in (lang, max(least[lang] + 1, int(min(1.0, 1.25 * (each + 6 * each**0.5) / n) * (1 << 40)))))), F.col("lang"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            rows = [counts(t, bits).astype(np.float32).tobytes() for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "lang"), column(b, "draw"), pa.array(rows, pa.binary())], ["lang", "draw", "tf"])

    # Rows that repeat share a draw and count once: copies of one row can't fill the sample.
    drawn = own.where(F.col("draw") < limit).groupBy("lang", "draw").agg(F.min("text").alias("text")).select("text", "lang", "draw").mapInArrow(bags, "lang string, draw long, tf binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= each).toPandas().sort_values(["lang", "rank"])  # `each` rows a language at most
    langs, of, centroids, farthest = sorted(drawn["lang"].unique()), [], [], []
    assert len(langs) == len(per), "a language without a sample"
    for i, lang in enumerate(langs):
        tf = np.stack([np.frombuffer(x, np.float32) for x in drawn.loc[drawn["lang"] == lang, "tf"]])
        v = unit(np.sqrt(tf) * idf)
        c = cluster(v, clusters)
        d = 1 - (v @ c.T).max(1)
        centroids.append(c)
        of += [i] * len(c)
        farthest.append(min(1.0, float(np.quantile(d, 0.99)) + 0.1))
    return Model(langs, idf, np.concatenate(centroids).astype(np.float32), np.array(of), np.array(farthest))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, distance, rejected), one row per row of docs (doc_id, text; other columns are ignored).

    A null text, or one without a letter, is `und` with score 0. `rejected` marks a text farther from its nearest
    centroid than all but a few of that language's own; its nearest language is given all the same. Ties go to the
    language first in code point order. Without a model every text is `und`.
    """

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 128):
            texts = column(b, "text").to_pylist()
            some = [i for i, t in enumerate(texts) if model and has_letter(t)]
            lang, score, far, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), np.ones(len(texts), bool)
            if some:
                best, share, d = model.classify(np.stack([counts(texts[i]) for i in some]))
                for i, k in zip(some, best, strict=True):
                    lang[i] = model.langs[k]
                score[some], far[some], out[some] = share, d, d > model.farthest[best]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(far.astype(float)), pa.array(out)], ["doc_id", "lang_pred", "score", "distance", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(classify, "doc_id long, lang_pred string, score double, distance double, rejected boolean")
