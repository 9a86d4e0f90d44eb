"""Page images as rows (book, page, width, height, pixels), pixels being RGB rows as bytes.

An image is one value and images don't depend on each other, so all of this is Arrow batches of whole images, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Image = np.ndarray  # height x width x 3, int16 where differences are taken


def image_of(width: int, height: int, pixels: bytes) -> Image:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3).astype(np.int16)


def _channels(of: np.ufunc, part: Image) -> np.ndarray:
    """The largest or least of each pixel's channels; numpy is slow along an axis of three."""
    return of(of(part[..., 0], part[..., 1]), part[..., 2])


def header_bottom(image: Image) -> int:
    """First row from 12 to 80 where the picture changes across its width; 0 for none.

    A row's change is the mean, over the middle 80 %, of the largest channel's difference from the row above; it must be
    at least 12 and three times the median change.
    """
    h, w = image.shape[:2]
    last = min(80, h - 1)
    if w < 2 or h < 2 or last <= min(12, h - 1):
        return 0
    left = int(w * 0.1)
    right = max(left + 1, int(w * 0.9))
    part = image[: last + 1, left : right : max(1, (right - left) // 160)]
    change = _channels(np.maximum, np.abs(part[1:] - part[:-1])).mean(1)
    rows = np.arange(1, last + 1)
    hit = rows[(rows >= min(12, h - 1)) & (change >= max(12.0, 3 * float(np.median(change))))]
    return int(hit[0]) if hit.size else 0


def dark_strip(image: Image, top: int = 0, fraction: float = 0.25) -> int:
    """Width of a dark strip at the left edge that plainly ends within the fraction of the width; 0 for none.

    A column is dark if three quarters of its samples, from 8 to 92 % of the height, are at most 45 in every channel.
    The end is a light column, at least 8 pixels and 2 % in, that hardly any of the next few dark ones follow.
    """
    h, w = image.shape[:2]
    if w < 40 or h < 40:
        return 0
    top = max(0, min(top, h - 1))
    low, high = top + int((h - top) * 0.08), top + int((h - top) * 0.92)
    rows = np.arange(low, max(low + 1, high), max(1, (high - low) // 240))
    step = max(1, w // 800)
    columns = np.arange(0, min(max(step, int(w * fraction)) + step, w), step)
    dark = (_channels(np.maximum, image[rows[0] : rows[-1] + 1 : max(1, (high - low) // 240), columns[0] : columns[-1] + 1 : step]) <= 45).mean(0) >= 0.75
    if not dark[0]:
        return 0
    need = max(2, max(8, int(w * 0.015)) // step)
    if len(dark) < need:
        return 0
    ahead = np.convolve(dark, np.ones(need, int), "valid")  # dark ones among a column and those after it
    ends = ~dark[: len(ahead)] & (columns[: len(ahead)] >= max(8, int(w * 0.02))) & (ahead <= need // 5)
    return int(columns[np.argmax(ends)]) if ends.any() else 0


def dark_edges(image: Image, top: int = 0) -> tuple[int, int]:
    """Where the picture begins and ends between dark strips."""
    w = image.shape[1]
    return dark_strip(image, top), w - dark_strip(image[:, ::-1], top)


def content_box(image: Image, tolerance: int = 15, header: int | None = None, left: int = 50, right: int = 50, bottom: int = 0, strips: bool = True) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of the page in a screenshot: below the header, within the margins and dark strips, down to the
    lowest row of the lower half that differs from the background."""
    h, w = image.shape[:2]
    top = max(0, min(header_bottom(image) if header is None else header, h - 1))
    first, last = dark_edges(image, top) if strips else (0, w)
    x0 = max(0, min(max(left, first), w - 1))
    x1 = max(x0 + 1, min(w - right, last, w))
    end = max(top + 1, h - bottom)
    start = max(top, h // 2) + 1
    part = image[start:end, x0 : x1 : max(1, min(w, h) // 80)]
    differs = np.flatnonzero((_channels(np.maximum, np.abs(part - image[top, 0])) > tolerance).any(1))
    return x0, top, x1, start + int(differs[-1]) + 1 if differs.size else end


def same_picture(a: Image, b: Image, tolerance: int = 8, centre: float = 0.75) -> bool:
    """Whether the middles of two pictures of one size differ by at most the tolerance everywhere."""
    if a.shape != b.shape:
        return False
    h, w = a.shape[:2]
    x, y = int(w * (1 - centre) / 2), int(h * (1 - centre) / 2)
    return int(np.abs(a[y : h - y, x : w - x] - b[y : h - y, x : w - x]).max(initial=0)) <= tolerance


def ink(image: Image, left: float, top: float, right: float, bottom: float) -> tuple[float, float, float]:
    """Shares of saturated, of non-white and of dark pixels in and around a line's box, from a grid of samples."""
    h, w = image.shape[:2]
    pad = max(8, int((bottom - top) * 0.8))
    x0, y0, x1, y1 = max(0, int(left) - pad), max(0, int(top) - pad), min(w, int(right) + pad), min(h, int(bottom) + pad)
    if x1 <= x0 or y1 <= y0:
        return 0.0, 0.0, 0.0
    part = image[y0 : y1 : max(1, (y1 - y0) // 70), x0 : x1 : max(1, (x1 - x0) // 220)]
    low, high = _channels(np.minimum, part), _channels(np.maximum, part)
    return float(((high - low > 35) & (low < 235)).mean()), float((low < 235).mean()), float((high < 100).mean())


def darkness(image: Image, left: float, top: float, right: float, bottom: float) -> float:
    """Share of a box's pixels whose grey is under 128."""
    h, w = image.shape[:2]
    part = image[max(0, int(top)) : min(h, int(bottom)), max(0, int(left)) : min(w, int(right))].astype(np.int64)
    grey = part @ np.array([19595, 38470, 7471]) + 0x8000 >> 16  # fixed values: luma weights in 65536ths
    return float((grey < 128).mean()) if grey.size else 0.0


def _components(mask: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(area, first and last column, first and last row) of each 4-connected part of a mask, by runs of rows joined downwards."""
    runs: list[tuple[int, int, int]] = []
    top: list[int] = []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    before: list[int] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            k = len(runs)
            runs.append((y, int(a), int(b)))
            top.append(k)
            for j in before:
                if runs[j][1] < b and a < runs[j][2]:
                    p, q = sorted((root(j), root(k)))
                    top[q] = p
            now.append(k)
        before = now
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for k, r in enumerate(runs):
        parts.setdefault(root(k), []).append(r)
    for own in parts.values():
        y, a, b = (np.array(v) for v in zip(*own, strict=True))
        yield int((b - a).sum()), int(a.min()), int(b.max()) - 1, int(y.min()), int(y.max())


def bubbles(image: Image, most: tuple[int, int] = (300, 480)) -> list[tuple[float, float, float, float]]:
    """Boxes of compact light or dark areas like speech bubbles, found on the picture scaled down by block means."""
    h, w = image.shape[:2]
    scale = min(1.0, most[0] / w, most[1] / h)
    sw, sh = max(1, round(w * scale)), max(1, round(h * scale))
    if (sw, sh) != (w, h):
        y, x = np.arange(sh) * h // sh, np.arange(sw) * w // sw
        sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), y, 0), x, 1)
        area = np.diff(np.append(y, h))[:, None] * np.diff(np.append(x, w))[None, :]
        image = np.rint(sums / area[:, :, None]).astype(np.int16)
    low, high = image.min(2), image.max(2)
    found = []
    for mask in ((low >= 225) & (high - low <= 32), high <= 55):
        for area, x0, x1, y0, y1 in sorted(_components(mask), key=lambda c: (c[3], c[1])):
            bw, bh = x1 - x0 + 1, y1 - y0 + 1
            if area >= 0.002 * sw * sh and 0.08 <= bw / sw <= 0.5 and 0.05 <= bh / sh <= 0.42 and 0.3 <= area / (bw * bh) <= 0.82:
                found.append((x0 * w / sw, y0 * h / sh, (x1 + 1) * w / sw, (y1 + 1) * h / sh))
    return found


def per_image(images: DataFrame, of: Callable[[Image], list[tuple]], fields: str) -> DataFrame:
    """(book, page, *fields): what `of` says of each image (book, page, width, height, pixels), a row for each tuple it gives."""
    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    names = ["book", "page", *(x.split()[0] for x in fields.split(", "))]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(r.book, r.page, *t) for r in pdf.itertuples() for t in of(image_of(r.width, r.height, r.pixels))]
            yield pd.DataFrame(rows, columns=names)

    return images.select("book", "page", "width", "height", "pixels").mapInPandas(batches, f"book {kinds['book']}, page {kinds['page']}, {fields}")


def content_boxes(images: DataFrame, **options) -> DataFrame:
    return per_image(images, lambda im: [content_box(im, **options)], "left int, top int, right int, bottom int")


def narrative_regions(images: DataFrame) -> DataFrame:
    return per_image(images, lambda im: [(i, *b) for i, b in enumerate(bubbles(im))], "region_no int, r_left double, r_top double, r_right double, r_bottom double")


def inked_lines(lines: DataFrame, images: DataFrame) -> DataFrame:
    """lines with saturated, nonwhite and dark of their boxes, and marker_dark of their first word's box. A page's boxes go to its
    image as one array."""
    first = F.get("words", F.lit(0))
    box = F.struct("block_no", "line_no", "left", "top", "right", "bottom", first.alias("word"))
    boxes = lines.groupBy("book", "page").agg(F.collect_list(box).alias("boxes"))
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                im = image_of(r.width, r.height, r.pixels)
                for b in r.boxes:
                    w = b["word"]
                    rows.append((r.book, r.page, b["block_no"], b["line_no"], *ink(im, b["left"], b["top"], b["right"], b["bottom"]), darkness(im, w["left"], w["top"], w["right"], w["bottom"]) if w else 0.0))
            yield pd.DataFrame(rows, columns=["book", "page", "block_no", "line_no", "saturated", "nonwhite", "dark", "marker_dark"])

    joined = images.select("book", "page", "width", "height", "pixels").join(boxes, ["book", "page"])
    found = joined.mapInPandas(batches, f"book {kinds['book']}, page {kinds['page']}, block_no {kinds['block_no']}, line_no {kinds['line_no']}, saturated double, nonwhite double, dark double, marker_dark double")
    return lines.join(found, ["book", "page", "block_no", "line_no"], "left")


def same_frames(a: str, b: str, tolerance: float = 8):
    """Whether two arrays are equally long and differ by at most the tolerance in every place."""
    apart = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return (F.size(a) == F.size(b)) & F.coalesce(apart <= tolerance, F.lit(True))
