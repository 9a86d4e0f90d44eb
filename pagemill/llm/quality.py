"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonically calibrated."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.quality_rules import measure
from pagemill.llm.shared import column, pieces, raw_texts, written

WIDTH, RIDGE, THRESHOLD, BINS = 256, 1e-3, 0.7, 1000
STATISTICS = 24


def statistics(raw: bytes | None) -> list[float]:
    """What the classifier knows of a text: sizes, shares of kinds of characters, repetition, words and lines."""
    raw = raw or b""
    n_words, chars, symbols, dup_lines, repeats, n_lines, upper, marks = measure(raw)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words = max(1, len(raw)), raw.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    p = by[by > 0] / size
    share = lambda chars: float(by[list(chars)].sum()) / size
    per = max(1, n_words)
    top = Counter(words).most_common(1)[0][1] / per if words else 0.0
    ends = sum(x.rstrip().endswith((b".", b"!", b"?", b'"', b":")) for x in raw.split(b"\n"))
    return [
        math.log1p(n_words),
        math.log1p(len(raw)),
        chars / per,
        float(lengths.std()),
        float((lengths <= 2).mean()),
        math.log1p(float(lengths.max())),
        math.log1p(1000 * symbols / per),
        math.log1p(1000 * upper / max(1, chars)),
        math.log1p(1000 * share(b"0123456789")),
        math.log1p(1000 * marks / per),
        math.log1p(1000 * float(by[ord(".")]) / per),
        math.log1p(1000 * float(by[ord(",")]) / per),
        float(by[0x80:].sum()) / size,
        share(b" \t\n\r\x0b\x0c"),
        math.log1p(1000 * float(by[10]) / per),
        dup_lines / max(1, n_lines),
        repeats / per,
        len(set(words)) / per,
        float(-(p * np.log2(p)).sum()) if raw else 0.0,
        math.log1p(1000 * float(by[ord("|")]) / per),
        math.log1p(1000 * share(b"@/:;_=+~^\\{}[]()")),
        ends / max(1, n_lines),
        math.log1p(per / max(1, n_lines)),
        top,
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>), one row per row of docs."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 512):
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([statistics(x) for x in raw_texts(b)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(describe, "doc_id long, x array<double>")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.phase
        return np.hstack([np.cos(z) * math.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.ridge(x)
        return np.clip(np.interp(s, *self.steps) if self.steps else s, 0, 1)


def isotonic(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted x with weights and summed labels: the block centres and means of the best rising step function, by
    pooling adjacent violators."""
    blocks: list[list[float]] = []
    for xi, n, t in zip(x, weight, total, strict=True):
        blocks.append([xi * n, n, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([a / n for a, n, _ in blocks]), np.array([t / n for _, n, t in blocks])


def fit(labelled: DataFrame, width: int = WIDTH, ridge: float = RIDGE, seed: int = 11, rows_per_task: int = 100_000) -> Model | None:
    """A model of labelled (doc_id, x, y 0 or 1); None without both labels.

    A fifth of the rows, by a hash of doc_id, is kept for calibration. Each task of the rest adds up its normal equations, a
    matrix as wide as the features; rows of these matrices are added up by row number, so the driver gets one matrix
    whatever the number of rows and tasks. Calibration sees counts by score bin.
    """
    own = labelled.where("y in (0, 1)").select("doc_id", "x", F.col("y").cast("int").alias("y"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))
    facts = own.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *(f(F.col("x")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for f, name in ((F.avg, "m"), (F.stddev_pop, "s")))).first()
    if not facts["n"] or not 0 < facts["ones"] < facts["n"]:
        return None
    rng = np.random.default_rng(seed)
    scale = np.array([max(1e-6, facts[f"s{i}"]) for i in range(STATISTICS)])
    model = Model(np.array([facts[f"m{i}"] for i in range(STATISTICS)]), scale, rng.normal(0, 0.6 / math.sqrt(STATISTICS / 4), (STATISTICS, width)), rng.uniform(0, 2 * math.pi, width))
    names = ["i", "sums"]

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 2))
        for b in pieces(batches, 4096):
            z = model.features(matrix(b))
            total += z.T @ np.hstack([z, column(b, "y").to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})

    tasks = max(8, round(facts["n"] / rows_per_task))
    sums = own.where("not held").select("x", "y").repartition(tasks).mapInArrow(equations, "i int, sums array<double>")
    sums = sums.groupBy("i").applyInPandas(added, "i int, sums array<double>").toPandas().sort_values("i")
    a = np.stack(sums["sums"].to_list())
    rows = max(1.0, a[-1, width])
    model.beta = np.linalg.solve(a[:, :-1] + ridge * rows / (width + 1) * np.eye(width + 1), a[:, -1])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.floor(np.clip(model.ridge(matrix(b)), -0.5, 1.5) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), column(b, "y")], ["bin", "y"])

    held = own.where("held").select("x", "y").mapInArrow(rate, "bin long, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toPandas().sort_values("bin")  # 2 * BINS + 1 rows at most
    if len(held):
        model.steps = isotonic((held["bin"].to_numpy() + 0.5) / BINS, held["n"].to_numpy().astype(float), held["ones"].to_numpy().astype(float))
    return model


def predict(described_docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row per row of described_docs (doc_id, x). Without a model every score is 0.5."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(matrix(b)) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return described_docs.select("doc_id", "x").mapInArrow(rate, "doc_id long, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted), one row per row of docs (doc_id, text; other columns are ignored): the calibrated
    probability of label 1, and 1 from the threshold up.

    labels (doc_id, y 0 or 1) says which rows are learned; others of its values are left out, and a document with several
    labels is learned with each. A null text is empty, and empty texts are scored like others. Repeated rows score
    alike. Statistics are written once, about 200 bytes a document, and read for learning and for scoring.
    """
    x = written(described(docs), "statistics")
    return predict(x, fit(x.join(labels.select(F.col("doc_id").cast("long"), "y"), "doc_id")))
