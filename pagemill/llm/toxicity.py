"""Toxicity: embeddings of character n-grams, averaged, into a linear softmax, trained together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.codes import gram_buckets, segments, spaced
from pagemill.llm.shared import column, pieces

BITS, ORDERS, DIM, SAMPLE, HALF, PRIOR = 17, (3, 4, 5), 8, 1500, 16, 150
THRESHOLD = 0.7


def subwords(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams, which don't cross words but may have a word's bounds at their ends,
    and the number of the word that each is of."""
    x = spaced(text, 1)
    word = np.cumsum(x == 0) - 1
    buckets, words = [], []
    for n in ORDERS:
        if len(x) < n:
            continue
        h = gram_buckets(x, n, bits)
        inside = np.ones(len(h), bool)
        for i in range(1, n - 1):
            inside &= x[i : i + len(h)] != 0
        buckets.append(h[inside])
        words.append(word[1 : 1 + len(h)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(words)


def bag(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct buckets of a text."""
    seen = np.zeros(1 << bits, bool)
    for part in segments(text):
        seen[subwords(part, bits)[0]] = True
    return np.flatnonzero(seen).astype(np.int32)


def overlapping(text: str, words: int = 2 * HALF) -> Iterator[str]:
    """segments() of a text, each after the first led by the last words of the one before, so that a window across a cut
    lies whole in one of them."""
    last = ""
    for part in segments(text):
        yield last + part
        at = len(part)
        for _ in range(words):
            if (at := part.rfind(" ", 0, at)) < 0:
                break
        last = part[max(0, at) :]


@dataclass
class Model:
    """weight: what a bucket adds to the logit where it is the text's only one. A window's distinct buckets are averaged,
    with PRIOR neutral ones so that few don't decide; the highest window is the text's, and slope and offset make it a
    probability."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def windows(self, part: str, half: int = HALF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and windows of a part's n-grams, each of a window once, and each window's logit. Windows are of two
        halves, and each half but the first and last is in two of them."""
        h, word = subwords(part, len(self.weight).bit_length() - 1)
        if not len(h):
            return h, word, np.zeros(0)
        block = word // half
        n, bits = max(1, int(block.max())), len(self.weight).bit_length() - 1
        key = (block << bits | h).astype(np.uint32 if n < 1 << (31 - bits) else np.uint64)
        one = np.asarray(1 << bits, key.dtype)
        both = np.concatenate([key[block < n], key[block > 0] - one])
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])]
        window, h = (both >> bits).astype(np.int64), (both & (one - 1)).astype(np.int64)
        return h, window, np.bincount(window, self.weight[h], n) / (np.bincount(window, minlength=n) + PRIOR) + self.bias

    def peak(self, text: str | None) -> float:
        return max((float(self.windows(part)[2].max(initial=-np.inf)) for part in overlapping(text or "")), default=-np.inf)

    def score(self, text: str | None) -> float:
        z = self.peak(text)
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))) if z > -np.inf else 0.0


def train(bags: list[np.ndarray], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = 12, batch: int = 64, rate: float = 0.5, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and biases, by Adagrad over mini-batches, of averaged bags. Classes weigh alike."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full_like(e, 1e-6), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    weigh = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            idx = np.concatenate([bags[i] for i in own])
            size = np.array([len(bags[i]) for i in own])
            doc, val = np.repeat(np.arange(len(own)), size), np.repeat(1 / (size + PRIOR), size)
            hidden = np.stack([np.bincount(doc, val * e[idx, d], len(own)) for d in range(dim)], 1).astype(np.float32)
            logits = hidden @ w + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= (weigh[labels[own]] / len(own))[:, None].astype(np.float32)
            gh = p @ w.T
            dw, db = hidden.T @ p, p.sum(0)
            touched, back = np.unique(idx, return_inverse=True)
            de = np.stack([np.bincount(back, val * gh[doc, d], len(touched)) for d in range(dim)], 1).astype(np.float32)
            ge[touched] += de * de
            e[touched] -= rate * de / np.sqrt(ge[touched])
            gw += dw * dw
            w -= rate * dw / np.sqrt(gw)
            gb += db * db
            b -= rate * db / np.sqrt(gb)
    return e, w, b


def logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset that make z a probability of y, by damped Newton steps with a little ridge."""
    m, s = float(z.mean()), float(z.std()) or 1.0
    x, a = np.stack([(z - m) / s, np.ones_like(z)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * a)
        a += step / max(1.0, float(np.abs(step).max()))
    return float(a[0] / s), float(a[1] - a[0] * m / s)


def sampled(labels: DataFrame, each: int) -> tuple[DataFrame, dict[int, int]] | None:
    """At most `each` rows (doc_id, y, draw) of either label, by a hash of doc_id, and how many there are in all; None
    without both labels. Rows that repeat count once."""
    own = labels.where("y in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("draw")).distinct()
    per = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if len(per) < 2:
        return None
    # Somewhat more than needed is drawn, and the lowest draws are kept.
    near = {y: int(min(1.0, (each + 6 * each**0.5) / n) * (1 << 40)) for y, n in per.items()}
    parts = [own.where((F.col("y") == y) & (F.col("draw") < near[y])).orderBy("draw").limit(each) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), per


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of docs (doc_id, text) and labels (doc_id, y 0 or 1); None without both labels.

    At most `sample` labels of either kind are drawn, by hash, and of documents that share a doc_id the least text has the
    label; the bags of these, not their texts, come to the driver. Embeddings and softmax are trained together on the bags of whole
    texts. A quarter of the sample is kept to make the highest window's logit a probability, either label weighing as
    in the corpus.
    """
    if (found := sampled(labels, sample)) is None:
        return None
    rows = [tuple(r) for r in found[0].collect()]  # 2 * sample rows at most
    drawn = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, y int, draw long"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(drawn, "doc_id").groupBy("doc_id", "y", "draw").agg(F.min("text").alias("text"))
    texts = texts.select("text", "y", "draw", (F.col("draw") % 4 == 0).alias("kept"))

    def to_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 128):
            yield pa.RecordBatch.from_arrays([column(b, "y"), column(b, "draw"), pa.array([bag(t or "").tobytes() for t in column(b, "text").to_pylist()], pa.binary())], ["y", "draw", "held"])

    rows = texts.where("not kept").mapInArrow(to_bags, "y int, draw long, held binary").toPandas()  # 2 * sample rows at most
    rows = rows[rows["held"].str.len() > 0].sort_values(["draw", "y", "held"], kind="stable")
    if rows["y"].nunique() < 2:
        return None
    e, w, b = train([np.frombuffer(x, np.int32) for x in rows["held"]], rows["y"].to_numpy().astype(np.int64))
    model = Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]))

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, 128):
            yield pa.RecordBatch.from_arrays([column(p, "y"), column(p, "draw"), pa.array([model.peak(t) for t in column(p, "text").to_pylist()])], ["y", "draw", "z"])

    z = texts.where("kept").mapInArrow(peaks, "y int, draw long, z double").toPandas()
    z = z[np.isfinite(z["z"])].sort_values(["z", "y"])
    if z["y"].nunique() == 2:
        per = found[1]
        share = z["y"].map({y: per[y] / sum(per.values()) / max(1, (z["y"] == y).sum()) for y in (0, 1)}).to_numpy() * len(z)
        model.slope, model.offset = logistic(z["z"].to_numpy(), z["y"].to_numpy(), share)
    return model


def predict(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row per row of docs (doc_id, text; other columns are ignored).

    score is the probability that the text is toxic, 0 to 1; predicted is 1 from the threshold up. A null text, one
    without letters or digits, and any text without a model have score 0. Repeated rows score alike.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            s = np.array([model.score(t) if model else 0.0 for t in column(b, "text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, score double, predicted int")
