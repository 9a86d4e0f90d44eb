"""Best-fit packing: token pieces into sequences of one capacity, by exact complements of piece lengths."""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import column, pieces, written

CAPACITY, END = 2048, 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# How a byte-level tokenizer splits a text, and the characters that stand for bytes in its vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_of() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in SHOWN]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, those that `tokenizers` gives for the file.

    Such a file's merges are in the order of its ids, so the ranks of its vocabulary are all that a faster
    implementation of byte-pair merging needs; a text that this can't take is left to `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        byte, special = byte_of(), {x["content"] for x in made["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in made["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except Exception:  # noqa: BLE001  the regular expression gave up on a run of characters
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for b in pieces(batches, 512):
            which, no, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(column(b, "text").to_pylist()):
                blob = encoder.encode(text or "") + END.to_bytes(4, "little")
                n = len(blob) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n]
                for k in range(len(at) - 1):
                    own = blob[4 * at[k] : 4 * at[k + 1]]
                    which.append(i)
                    no.append(k)
                    start.append(at[k])
                    length.append(at[k + 1] - at[k])
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            out = [column(b, "doc_id").take(pa.array(which, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)


def _exact(gap: int, free: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill the gap, the fewest and then the longest first; a length
    appears as often as it is available."""
    if gap < len(free) and free[gap] > 0:
        return (gap,)

    def pair(total: int, less: int = 0) -> tuple[int, int] | None:
        half = total // 2
        low = np.arange(1, half + 1)
        ok = (free[low] > (low == less)) & (free[total - low] > ((total - low) == less))
        if total % 2 == 0 and half:
            ok[-1] = free[half] >= 2 + (half == less)
        return (total - int(low[k]), int(low[k])) if ok.any() and (k := int(np.argmax(ok))) >= 0 else None

    if gap < 2:
        return None
    if found := pair(gap):
        return found
    for c in range(gap - 2, (gap + 2) // 3 - 1, -1):  # the longest of the three
        if free[c] > 0 and (found := pair(gap - c, c)):
            return (c, *found)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each, for so many pieces of each length.

    First, from the longest length down, gaps are filled exactly by one, two or three available lengths; a pattern
    is used as often as its scarcest length allows, so it uses one up and there are at most `capacity` such
    patterns, whatever the number of pieces. Then what is left is placed best fit, longest first, in the same way.
    """
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"no piece may have {length} tokens")
        free[length] = n
    found: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        times = min(int(free[x]) // k for x, k in Counter(pattern).items())
        for x in pattern:
            free[x] -= times
        found.append((pattern, times))

    for a in range(capacity, 0, -1):
        while free[a]:
            if a == capacity:
                use((a,))
                continue
            free[a] -= 1
            rest = _exact(capacity - a, free)
            free[a] += 1
            if not rest:
                break
            use((a, *rest))
    for a in range(capacity, 0, -1):
        while free[a]:
            pattern, gap = [a], capacity - a
            free[a] -= 1
            while gap and (fits := np.flatnonzero(free[1 : gap + 1])).size:
                rest = _exact(gap, free) or (int(fits[-1]) + 1,)
                for x in rest:
                    free[x] -= 1
                    pattern.append(x)
                    gap -= x
            for x in pattern:
                free[x] += 1
            use(tuple(pattern))
    return found


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows length, first rank, first sequence, offset; sorted. The pieces of a length take its slots by rank."""
    rows, rank, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.append((x, rank[x], sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length, ..) -> the same rows with sequence_id and offset.

    Only the number of pieces of each length, at most `capacity` rows, reaches the driver. A piece's rank among those of
    its length comes from counts by length and hash bucket, with about the square root of all pieces as buckets, so
    that no task gets a whole length, which may be that of a third of all pieces.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = _slots(plan(counts, capacity))
    buckets = max(1, round(sum(counts.values()) ** 0.5))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = dealt.groupBy("length", "_bucket").count()
    order = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_bucket", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))).join(before, ["length", "_bucket"])
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_rank") - 1).cast("long").alias("_rank"))

    own = cut.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(slots[:, 1].max(initial=0)) + 1
        keys = slots[:, 0] * span + slots[:, 1]
        for b in batches:
            length, rank = column(b, "length").to_numpy(), column(b, "_rank").to_numpy()
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            out = [column(b, c) for c in own] + [pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])]
            yield pa.RecordBatch.from_arrays(out, [*own, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset), one row per piece of docs (doc_id, text;
    other columns are ignored).

    A document is its whole text's ids and the end id. Only one of more than `capacity` tokens is cut, into pieces of
    `capacity` tokens of which the first may be shorter. A null or empty text is the end id alone, a piece of length 1.
    Repeated rows are packed each; a null doc_id is carried along. An empty table gives no rows.
    """
    return place(written(tokenized(docs, tokenizer or default_tokenizer(), capacity, with_ids), "pieces"), capacity)
