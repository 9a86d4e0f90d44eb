"""Suffix-array deduplication: bytes in strings of a given length that also start elsewhere are removed.

All suffixes of a corpus are too many to sort: only those are compared that a repeated string can't do without.
Anchors are the positions whose gram, of 128 bytes, has the least hash of some window of 273 grams, so that each
string of 400 bytes has an anchor, which depends on nothing but that string. Two equal strings thus have anchors
at like places, and what starts at these begins with the same gram.

Each record stands for the strings of 400 bytes that hold an anchor at one of a range of distances from their start.
It has a core, which all of these strings hold, and a hull, which holds them all. Equal hulls at two places: all
these strings are repeated. A core found nowhere else: none is. Otherwise the range of distances is split and
the parts are looked at alone, until a range is one distance, where core and hull are one string.
On each of these levels suffixes, that is records, are range-partitioned by leading bytes at sampled splitters,
buckets are sorted by multikey quicksort, and neighbours are compared, across the bounds of buckets too.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import column, forget, pieces, raw_texts, text_hash, written

LOW = np.uint64((1 << 20) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BYTES = np.random.default_rng(400).integers(0, 1 << 64, 256, np.uint64)
NULL_ID = -(1 << 63)


def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbours' hashes."""
    h = x * _A + y * _B
    h ^= h >> np.uint64(32)
    return h


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(len(parts))
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * _C
        h = h ^ (h >> np.uint64(29))
    return h * _A


def hashes(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the strings of such widths, powers of two, from every position along the last axis, by doubling."""
    h, at, found = _BYTES[data], 1, {1: None}
    while at < max(widths):
        if h.shape[-1] <= at:
            h = h[..., :0]
        else:
            h = join(h[..., :-at], h[..., at:])
        at *= 2
        found[at] = h
    return [found[w] for w in widths]


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as a number that sorts as they do."""
    lead = np.zeros(len(at), np.uint64)
    for i in range(8):
        lead |= data[at + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    return lead


def window_minima(v: np.ndarray, window: int) -> np.ndarray:
    m, width = v, 1
    while width * 2 <= window:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return m if width == window else np.minimum(m[: len(m) - (window - width)], m[window - width :])


@dataclass(frozen=True)
class Shape:
    """length: of the strings. gram: of an anchor, a power of two. widths: distances in a part, level by level, each a multiple
    of the next, down to 1. stretch: bytes of a text that are looked at together. per_bucket: records sorted together."""

    length: int = 400
    gram: int = 128
    widths: tuple[int, ...] = (42, 7, 1)
    stretch: int = 1 << 19
    per_bucket: int = 150_000

    def __post_init__(self) -> None:
        if self.gram & self.gram - 1 or self.gram < 8 or not 3 * self.gram <= self.length <= 4 * self.gram or self.length >= 1 << 10 or self.widths[0] > self.length - 2 * self.gram + 1 or self.widths[-1] != 1 or any(a % b for a, b in itertools.pairwise(self.widths)) or self.stretch + 3 * self.length >= 1 << 20:
            raise ValueError(f"hashes of two grams don't cover what they must: {self}")

    @property
    def span(self) -> int:
        """The largest distance of an anchor from the start of a string."""
        return self.length - self.gram


@dataclass
class Unit:
    """A stretch of one text: where it begins in the text, its bytes, and the first and last string start it answers for."""

    row: int
    base: int
    data: bytes
    first: int
    last: int


def units(texts: list[bytes], shape: Shape) -> Iterator[Unit]:
    """Texts of at least one string, the very long ones in stretches that hold what lies about their anchors."""
    length, stretch = shape.length, shape.stretch
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, stretch):
            base, end = max(0, at - length), min(len(t), at + stretch + 2 * length)
            yield Unit(i, base, t[base:end], at - base, min(at + stretch, len(t) - length + 1) - 1 - base)


def anchors(group: list[Unit], shape: Shape) -> tuple[np.ndarray, ...]:
    """(unit, position in the text, reach of the hull, lead, core, hull) of each anchor of the units."""
    length, gram, span = shape.length, shape.gram, shape.span
    data = np.frombuffer(b"".join(u.data for u in group), np.uint8)
    begins = np.cumsum([0] + [len(u.data) for u in group])
    small, large = hashes(data, (gram, 2 * gram))
    v = (small & ~LOW) | (LOW - np.arange(len(small), dtype=np.uint64))
    m = window_minima(v, span + 1)
    answers = np.zeros(len(data) + 1, np.int8)
    np.add.at(answers, begins[:-1] + [u.first for u in group], 1)
    np.add.at(answers, begins[:-1] + [u.last + 1 for u in group], -1)
    m = m[np.cumsum(answers)[: len(m)] > 0]
    at = (LOW - (m[np.append(True, m[1:] != m[:-1])] & LOW)).astype(np.int64)
    unit = np.searchsorted(begins, at, "right") - 1
    low, high = np.maximum(at - span, begins[unit]), np.minimum(at + length, begins[unit + 1])
    hull = mixed(large[low], large[np.minimum(low + 2 * gram, high - 2 * gram)], large[high - 2 * gram], at - low, high - at)
    shift = np.array([u.base for u in group])[unit] - begins[unit]
    return unit, at + shift, reach(at - low, high - at), leading(data, at), small[at], hull


def reach(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bytes of a hull before and from its anchor, as one number."""
    return (left << 10 | right).astype(np.int32)


LOW_END, HIGH_END = "pos - shiftright(reach, 10)", "pos + (reach & 1023)"
KEYS = ["lead", "core", "hull"]
PLACE = ["doc_id", "text_hash", "pos"]


def _batch(keys: tuple[np.ndarray, ...], ids: dict[str, np.ndarray], reaches: np.ndarray) -> pa.RecordBatch:
    columns = {c: np.ascontiguousarray(k).view(np.int64) for c, k in zip(KEYS, keys, strict=True)} | ids | {"reach": reaches}
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def anchored(texts: DataFrame, shape: Shape) -> DataFrame:
    """First level: a record for each anchor of texts (doc_id, text_hash, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            raw = [t or b"" for t in raw_texts(b)]
            doc, text = column(b, "doc_id").to_numpy(), column(b, "text_hash").to_numpy()
            group, size, seen = [], 0, {}
            for u in [*units(raw, shape), None]:
                if group and (u is None or size + len(u.data) > shape.stretch + 3 * shape.length or u.row == group[-1].row):
                    of, pos, reaches, *keys = anchors(group, shape)
                    row = np.array([x.row for x in group])[of]
                    fresh = pos > np.array([seen.get(r, -1) for r in row], np.int64)  # a stretch may end with the next one's first anchors
                    for r, p in zip(row[fresh].tolist(), pos[fresh].tolist(), strict=True):
                        seen[r] = p
                    row = row[fresh]
                    yield _batch(tuple(k[fresh] for k in keys), {"doc_id": doc[row], "text_hash": text[row], "pos": pos[fresh]}, reaches[fresh])
                    group, size = [], 0
                if u:
                    group.append(u)
                    size += len(u.data)

    return texts.select("doc_id", "text_hash", "text").mapInArrow(find, "lead long, core long, hull long, doc_id long, text_hash long, pos long, reach int")


def multikey_order(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Multikey quicksort, a key of all open groups at once: rows are sorted by one key, and only those that tie go on to
    the next. The order, and for each key whether a row begins a new run of rows that are equal up to that key."""
    n = len(keys[0])
    order = np.arange(n)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    found = []
    for k in keys:
        run = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if at.size:
            v = k[order[at]]
            by = np.lexsort((v, run[at]))
            order[at] = order[at][by]
            v = v[by]
            new = new.copy()
            new[at[1:]] |= (v[1:] != v[:-1]) & (run[at][1:] == run[at][:-1])
        found.append(new)
    return order, found


def classify(records: DataFrame, name: str, per_bucket: int) -> DataFrame:
    """Of records (lead, core, hull, ids, reach) the ids and reach of those whose core is found twice, with `same` (the hull is, too) and `open` (to be split further:
    the core has several hulls, and this is a hull found once or stands for the equal ones).

    Records go to buckets between sampled splitters of lead, core, hull and, so that equal ones may be split over buckets, the
    rest. A bucket's first and last runs of equal cores or hulls may go on in the next buckets; what all buckets have of
    these is put together and compared apart.
    """
    buckets = max(2, -(-records.count() // per_bucket))
    names = records.columns
    dealt = records.repartitionByRange(buckets, *names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        order, (_, cores, hulls) = multikey_order(*(table.column(c).to_numpy() for c in KEYS))
        core, hull = np.cumsum(cores) - 1, np.cumsum(hulls) - 1
        in_core, in_hull = np.bincount(core)[core], np.bincount(hull)[hull]
        core_edge = (core == 0) | (core == core[-1])
        kept = (in_core > 1) | core_edge
        flags = {"same": in_hull > 1, "several": np.bincount(core, hulls)[core] > 1, "first": hulls, "core_edge": core_edge, "hull_edge": (hull == 0) | (hull == hull[-1])}
        order, flags = order[kept], {c: v[kept] for c, v in flags.items()}
        for at in range(0, len(order), 20_000):
            part = table.take(pa.array(order[at : at + 20_000])).combine_chunks()
            for c, v in flags.items():
                part = part.append_column(c, pa.array(v[at : at + 20_000]))
            yield from part.to_batches()

    sorted_ = written(dealt.mapInArrow(bucket, f"{schema}, same boolean, several boolean, first boolean, core_edge boolean, hull_edge boolean"), name)
    # At most two cores and two hulls of each bucket may go on in the next: two rows a bucket are broadcast of either.
    cores = sorted_.where("core_edge").groupBy("lead", "core").agg((F.min("hull") != F.max("hull")).alias("on_several"))
    hulls = sorted_.where("hull_edge").groupBy("lead", "core", "hull").agg((F.count("*") > 1).alias("on_same"))
    known = sorted_.join(F.broadcast(cores.where("on_several")), ["lead", "core"], "left").join(F.broadcast(hulls.where("on_same")), ["lead", "core", "hull"], "left")
    same, several = F.col("same") | F.coalesce("on_same", F.lit(False)), F.col("several") | F.coalesce("on_several", F.lit(False))
    known = known.select(*names, same.alias("same"), (several & (~same | F.col("first"))).alias("open"))
    found = written(known.drop("lead", "core", "hull").where("same or open"), f"{name}-found")
    forget(sorted_)
    return found


def contexts(texts: DataFrame, found: DataFrame, shape: Shape) -> DataFrame:
    """(place, doc_id, text_hash, pos, left, right, around): of each open record the bytes about its anchor, filled up to a
    fixed width."""
    length, span = shape.length, shape.span
    wanted = found.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("places"))  # the anchors of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            which, pos, left, right, around = [], [], [], [], []
            for i, (t, places) in enumerate(zip(raw_texts(b), column(b, "places").to_pylist(), strict=True)):
                for p in places:
                    low, high = max(0, p - span), min(len(t), p + length)
                    which.append(i)
                    pos.append(p)
                    left.append(p - low)
                    right.append(high - p)
                    around.append(bytes(span - p + low) + t[low:high] + bytes(length - high + p))
            own = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").take(own), column(b, "text_hash").take(own), pa.array(pos, pa.int64()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(around, pa.binary())], ["doc_id", "text_hash", "pos", "left", "right", "around"])

    # Equal rows have equal texts: one of them tells what is about their anchors, but each is a place of its own.
    return texts.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places").mapInArrow(cut, "doc_id long, text_hash long, pos long, left int, right int, around binary").withColumn("place", F.monotonically_increasing_id())


def split(around: DataFrame, level: int, shape: Shape) -> DataFrame:
    """Records of a level's parts of each context, or past the first level of its open parts on the level before, an array."""
    length, gram, span, width = shape.length, shape.gram, shape.span, shape.widths[level]
    outer = shape.widths[level - 1] if level else width * -(-(span + 1) // width)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            data = np.frombuffer(b"".join(column(b, "around").to_pylist()), np.uint8).reshape(b.num_rows, span + length)
            (h,) = hashes(data, (2 * gram,))
            flat, wide = data.ravel(), span + length
            place, left, right = (column(b, c).to_numpy() for c in ("place", "left", "right"))
            open_ = column(b, "parts").to_pylist() if level else [[0]] * b.num_rows
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in open_])
            begin = np.array([p for x in open_ for p in x], np.int64) * outer
            for o1 in range(0, outer, width):
                o1 = begin + o1  # noqa: PLW2901
                o2 = np.minimum(span, o1 + width - 1)
                v1, v2 = np.maximum(o1, length - right[row]), np.minimum(o2, left[row])
                ok = v1 <= v2
                r, o1, o2, v1, v2 = (x[ok] for x in (row, o1, o2, v1, v2))  # noqa: PLW2901
                core = mixed(h[r, span - o1], h[r, span + length - o2 - 2 * gram], o1)
                hull = mixed(h[r, span - v2], h[r, span + length - v1 - 2 * gram], v1, v2)
                yield _batch((leading(flat, r * wide + span - o1), core, hull), {"place": place[r], "part": (o1 // width).astype(np.int32)}, reach(v2, length - v1))

    return around.mapInArrow(parts, "lead long, core long, hull long, place long, part int, reach int")


def repeated(texts: DataFrame, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """(doc_id, text_hash, spans array<struct<low, high>>): byte ranges of texts (doc_id, text_hash, text) that together are all
    strings of the length found at two places or more. Ranges may overlap."""
    records = written(anchored(texts, shape), "anchors")
    found = classify(records, "suffixes", shape.per_bucket)
    forget(records)
    around = written(contexts(texts, found.where("open"), shape), "contexts")
    spans = found.where("same").select(*PLACE, "reach")
    inner, wanted = None, around
    for level in range(len(shape.widths)):
        records = written(split(wanted, level, shape), f"level{level}")
        found = classify(records, f"level{level}-suffixes", shape.per_bucket)
        forget(records)
        same = found.where("same").select("place", "reach")
        inner = same if inner is None else inner.unionByName(same)
        if level < len(shape.widths) - 1:
            wanted = around.join(found.where("open").groupBy("place").agg(F.collect_set("part").alias("parts")), "place")
    spans = spans.unionByName(inner.join(around.select("place", *PLACE), "place").select(*PLACE, "reach"))
    each = spans.select("doc_id", "text_hash", F.struct(F.expr(LOW_END).alias("low"), F.expr(HIGH_END).alias("high")).alias("span"))
    return written(each.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")), "spans")


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and in how many runs."""
    kept, at, removed, runs = [], 0, 0, 0
    for low, high in sorted(spans):
        if low > at or not runs:
            kept.append(text[at:low])
            runs += 1
            removed += high - low
            at = high
        elif high > at:
            removed += high - at
            at = high
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def dedup(docs: DataFrame, shape: Shape = Shape(), with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, [kept_text, *carry]), one row per row of docs (doc_id, text and what is
    carried; others are ignored).

    Texts are UTF-8 bytes. Each byte in a string of 400 bytes, or the shape's length, that also starts elsewhere, in the
    same text or another, is removed; strings are judged on the input and may overlap. Shorter texts stay whole; null is
    empty. Rows that are equal are texts of their own, so both lose what they share, which is all of it. A null doc_id stays null;
    within, it goes by the smallest number, and a row that has that number and the same text has the same spans. kept_text leaves out characters of which only some bytes stay. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), text_hash().alias("text_hash"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"own_{c}") for c in carry)).alias("carried"))
    joined = texts.join(repeated(texts, shape), ["doc_id", "text_hash"], "left").select("carried", "text", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 if with_text else 4]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 128):
            rows = []
            for t, low, high in zip(raw_texts(b), column(b, "low").to_pylist(), column(b, "high").to_pylist(), strict=True):
                kept, removed, runs = cut_out(t, list(zip(low, high, strict=True)) if low else [])
                rows.append((len(t), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            made = [pa.array(list(v), k) for v, k, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)]
            yield pa.RecordBatch.from_arrays([column(b, "carried"), *made], ["carried", *names])

    carried = joined.schema["carried"].dataType.simpleString()
    out = joined.mapInArrow(remove, f"carried {carried}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.select("carried.doc_id", *names, *(F.col(f"carried.own_{c}").alias(c) for c in carry))
