"""SimHash near-duplicates: 64-bit fingerprints, linked by tiled exact comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.llm.shared import column, pieces, raw_texts, starts_of, text_hash, written

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BLOCKS = (4, 8, 16, 32)
BYTE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(raw: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's UTF-8 bytes: A-Z lower-cased, words split at ASCII white space, XXH64 of each
    shingle (repeats count; a shorter text is one shingle), a bit set if set in over half. No word: 0."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return digest(join(words), seed)
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 17):
        part = words[at : at + (1 << 17) + shingle - 1]
        h = np.array([digest(join(t), seed) for t in zip(*(part[i:] for i in range(shingle)), strict=False)], "<u8")
        by = np.bincount((h.view(np.uint8).reshape(-1, 8) + BYTE).ravel(), minlength=2048).reshape(8, 256)
        counts += (by @ BITS).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp long): the fingerprint's 64 bits as a signed number, one row per input row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 512):
            fps = np.array([fingerprint(x, shingle, seed) for x in raw_texts(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text").mapInArrow(hashed, "doc_id long, text_hash long, fp long")


def _offsets(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of block population counts that fingerprints within the radius can have, one of each opposite pair."""
    found = [()]
    for _ in range(blocks):
        found = [(*d, x) for d in found for left in [radius - sum(map(abs, d))] for x in range(-left, left + 1)]
    return [d for d in found if d >= (0,) * blocks]


def _forest(a: np.ndarray, b: np.ndarray, radius: int, label: np.ndarray, la: np.ndarray, lb: np.ndarray, rows: int = 256, cols: int = 4096) -> None:
    """Joins in label (smallest index of each group so far) what lies within the radius, tile by tile."""
    for i in range(0, len(a), rows):
        for j in range(0, len(b), cols):
            near = np.bitwise_count(a[i : i + rows, None] ^ b[None, j : j + cols]) <= radius
            x, y = np.nonzero(near)
            x, y = la[x + i], lb[y + j]
            while x.size:
                p, q = label[x], label[y]
                if not (open_ := p != q).any():
                    break
                x, y, p, q = x[open_], y[open_], p[open_], q[open_]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while not np.array_equal(deeper := label[label], label):
                    label[:] = deeper


def cells(nodes: DataFrame, blocks: int) -> DataFrame:
    """Adds cell: the population counts of so many blocks of fp, as one number."""
    width = 64 // blocks
    count = lambda i: F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long")
    return nodes.withColumn("cell", sum((count(i) * (width + 1) ** i for i in range(blocks)), F.lit(0).cast("long")))


def blocks_for(nodes: DataFrame, radius: int, tile: int) -> int:
    """The number of blocks that moves the fewest rows: more blocks make more cells, so that fewer have to be split in
    tiles, but each has more neighbours. The result of links() is the same for any."""
    best = None
    for blocks in BLOCKS:
        sizes = cells(nodes, blocks).groupBy("cell").agg(F.count("*").alias("n"))
        n, moved = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.ceil(F.col("n") / tile))).first()
        cost = len(_offsets(blocks, radius)) * (moved or 0)
        if best is None or cost < best[0]:
            best = cost, blocks
        if moved == n or not n:  # no cell is split: more blocks only add neighbours
            break
    return best[1]


def dealt(nodes: DataFrame, radius: int, blocks: int, tile: int) -> DataFrame:
    """(cell, part, home, fp, node): each cell's own rows, dealt to parts of about `tile` rows, and for each part the rows of
    the cell's neighbours and of the cell itself."""
    celled, base = cells(nodes, blocks), 64 // blocks + 1
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    if base**blocks <= 100_000:
        sizes = F.broadcast(sizes)  # at most base ** blocks rows of 12 bytes
    home = celled.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"), F.lit(True).alias("home"), "fp", "node")
    # Counts that leave 0..width would name another cell; such rows meet fingerprints in vain, which is harmless.
    steps = F.array(*(F.lit(sum(x * base**i for i, x in enumerate(d))).cast("long") for d in _offsets(blocks, radius)))
    guest = celled.select("fp", "node", F.explode(F.transform(steps, lambda s: s + F.col("cell"))).alias("cell")).join(sizes, "cell")
    guest = guest.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("home"), "fp", "node")
    return home.unionByName(guest)


def links(nodes: DataFrame, radius: int = 2, blocks: int | None = None, tile: int = 8192, chunk: int = 8192) -> DataFrame:
    """nodes (fp long, node long), each fp once -> edges (u, v) of nodes that join all that differ in radius
    bits or fewer, not every such pair; loops may be among them.

    A fingerprint lies in the cell of its blocks' population counts. Fingerprints within the radius lie in cells
    whose counts differ by the radius in sum, so all other pairs of cells are skipped; what is left is compared
    whole by exclusive-or and bit counts, in tiles. A full cell is dealt to several parts of about `tile` rows. A worker
    holds one part's own rows, which come first, and meets `chunk` rows of the neighbouring cells at a time. The matches
    of a chunk leave it as a spanning forest.
    """
    both = dealt(nodes, radius, blocks or blocks_for(nodes, radius, tile), tile)
    both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("home").desc())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, n, label = None, *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        for b in batches:
            cell, part, fp, node, here = (column(b, c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "fp", "node", "home"))
            at = np.append(starts_of(cell, part, here), len(cell))
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in itertools.pairwise(at):
                own, x, y = (cell[s], part[s]), fp[s:e].view(np.uint64), node[s:e]
                if here[s]:
                    f, n = (np.concatenate([f, x]), np.concatenate([n, y])) if own == key else (x.copy(), y.copy())
                    key, label = own, np.arange(len(n))
                elif own == key:  # else a cell without rows of its own
                    for i in range(0, len(x), chunk):
                        g, m = x[i : i + chunk], np.concatenate([n, y[i : i + chunk]])
                        label = np.concatenate([label, np.arange(len(n), len(m))])
                        before = label.copy()
                        _forest(f, g, radius, label, np.arange(len(n)), np.arange(len(n), len(m)))
                        joined = label != before
                        us.append(m[joined])
                        vs.append(m[label[joined]])
                        label = label[: len(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return both.mapInArrow(compare, "u long, v long")


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp, group), one row per row of docs (doc_id, text; other columns are ignored).

    Fingerprints within the radius are linked, and so what they reach, whatever the ids; group is the smallest
    fingerprint of the component, as a signed number. Null, empty and blank texts have fingerprint 0 and are linked with
    each other like any other.
    """
    fps = written(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = written(fps.select("fp", F.col("fp").alias("node")).distinct(), "nodes")
    found = connected_components(links(nodes, radius))
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("group"))
    return fps.join(of, "fp", "left").select("doc_id", "text_hash", "fp", "group")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp, component_id), one row per row of docs (doc_id, text; other columns are ignored).

    Groups are those of near_groups(); component_id is the smallest doc_id of the group. Repeated rows and ids stay. Rows
    with a null doc_id link others like any; a group of none but null ids has a null id. An empty table gives no rows.
    """
    groups = written(near_groups(docs, radius, shingle, seed), "groups")
    ids = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return groups.join(ids, "group").select("doc_id", "text_hash", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
