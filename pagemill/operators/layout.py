"""Where lines stand: regions, figures, list markers, comics.

All joins here are keyed by page, with a range predicate on top; a page has tens of lines, so no task meets many pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.once import once
from pagemill.functions.text import ascii_share, japanese_count
from pagemill.operators.lines import MEANINGFUL, PAGE, by_page

# What looks like code, like a label of a user interface, and like a title.
CODE = r"(?i)(?:^|[^A-Za-z0-9_])(?:import|from|def|class|return|const|let|var|function|export|interface|system\.out|print|async|await|SELECT|INSERT|UPDATE|DELETE|CREATE|SQL\s+DUMP|CODE\s+BASE)(?:$|[^A-Za-z0-9_])|=>|==|!=|</?[A-Za-z]|[{}]"
INTERFACE = r"(?i)^(?:editor\s+ui|user\s+question|asking\s+ai|ai\s+responds(?:\s+with\s+code)?|terminal|codebase|legacy\s+repo|function\s+logs|java\s+class|sql\s+dump|documentation|pull\s+request|processing|queued)\z"
TITLE = r"(?U)[『「【].+[』」】]|第\s*\d+\s*[章世代]"
EXPLICIT_MARKERS = "●•○◉◦✓✔☑□■▪▫・"
MISREAD_MARKERS = ("e", "o", "O", "@", "$", "る", "®")
CHECKBOX_MISREADINGS = ("M", "V", "v", "W")

LINE = [*PAGE, "block_no", "line_no"]


def height() -> Column:
    return F.col("bottom") - F.col("top")


def width() -> Column:
    return F.col("right") - F.col("left")


def in_regions(lines: DataFrame, regions: DataFrame, *carry: str) -> DataFrame:
    """(line key, region_no, *carry of the line): the regions (book, page, region_no, r_left, r_top, r_right, r_bottom) that hold a line's centre."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    return lines.join(regions, PAGE).where(x.between(F.col("r_left"), F.col("r_right")) & y.between(F.col("r_top"), F.col("r_bottom"))).select(*LINE, "region_no", *carry)


def text_kinds(lines: DataFrame) -> DataFrame:
    """lines (text in NFKC, page_height) with relative_height, japanese, ascii_ratio, code_like, ui_like and ascii_ui."""
    out = lines.withColumn("relative_height", height() / F.col("page_height")).withColumn("japanese", japanese_count("text")).withColumn("ascii_ratio", ascii_share("text"))
    out = out.withColumn("code_like", F.col("text").rlike(CODE)).withColumn("ui_like", F.trim("text").rlike(INTERFACE))
    return out.withColumn("ascii_ui", (F.col("ascii_ratio") >= 0.65) & (F.col("japanese") <= 1) & (F.col("relative_height") < 0.04))


def narrative_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines with `kept`: titles, and what stands in a region that holds no code or interface text.

    Lines without visible text are left as they are. A region counts as spoilt if the centre of any code-like, interface
    or small Latin line lies in it.
    """
    own = text_kinds(lines)
    foul = F.col("code_like") | F.col("ui_like") | F.col("ascii_ui")
    # A page's regions as one value, so that lines are neither joined with themselves nor multiplied.
    corners = F.collect_list(F.struct("region_no", "r_left", "r_top", "r_right", "r_bottom")).alias("_regions")
    own = own.join(regions.where("region_no is not null").groupBy(*PAGE).agg(corners), PAGE, "left")
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    around = F.filter("_regions", lambda r: x.between(r["r_left"], r["r_right"]) & y.between(r["r_top"], r["r_bottom"]))
    own = own.withColumn("_held", F.transform(around, lambda r: r["region_no"]))
    spoilt = F.flatten(F.collect_set(F.when(foul, F.col("_held"))).over(Window.partitionBy(*PAGE)))
    own = own.withColumn("inside", F.size(F.array_except("_held", spoilt)) > 0)
    large = (F.col("relative_height") >= 0.04) & ((width() >= 1.2 * height()) | (F.col("japanese") >= 2))
    upper = (F.col("top") <= 0.2 * F.col("page_height")) & (F.col("relative_height") >= 0.025)
    screen = (F.col("ascii_ratio") >= 0.65) & (F.col("japanese") <= 1) & ~large
    wanted = large | F.col("text").rlike(TITLE) | upper | F.coalesce("inside", F.lit(False))
    blank = ~F.col("text").rlike(r"(?U)\S")
    return own.withColumn("kept", blank | (wanted & ~foul & ~screen)).select(*lines.columns, "kept")


def title_lines(lines: DataFrame) -> DataFrame:
    """lines with `kept`: titles by their marks, or near the top, large enough, with Japanese and not too long."""
    own = text_kinds(lines)
    upper = (F.col("top") <= 0.2 * F.col("page_height")) & (F.col("relative_height") >= 0.025) & (F.col("japanese") >= 2) & (F.length("text") <= 100)
    return own.withColumn("kept", F.col("text").rlike(TITLE) | upper).select(*lines.columns, "kept")


def nearest_follower(markers: DataFrame, lines: DataFrame) -> DataFrame:
    """markers with f_block_no and f_line_no: of each marker (a line of its own) the line to its right at about its height that
    is nearest, horizontally and vertically together; the first recognised of equally near ones; null for none.

    left, top, right and bottom are those of a line's first word. About its height: centres differ by no more than 0.55
    of the marker's height or 0.75 of the line's.
    """
    other = lines.select(*PAGE, *(F.col(c).alias(f"f_{c}") for c in ("block_no", "line_no", "left", "top", "right", "bottom")))
    pairs = markers.join(other, PAGE).where("f_left > right and not (block_no = f_block_no and line_no = f_line_no)")
    apart = F.abs((F.col("f_top") + F.col("f_bottom")) / 2 - (F.col("top") + F.col("bottom")) / 2)
    near = pairs.where(apart <= F.greatest(0.55 * height(), 0.75 * (F.col("f_bottom") - F.col("f_top"))))
    best = near.groupBy(*LINE).agg(F.min(F.struct((F.col("f_left") - F.col("right") + apart).alias("distance"), "f_block_no", "f_line_no")).alias("b"))
    return markers.join(best, LINE, "left").select(*markers.columns, "b.f_block_no", "b.f_line_no", F.col("b.distance").alias("distance"))


def aligned_markers(candidates: DataFrame, image_width: Column | str = "page_width") -> DataFrame:
    """candidates with aligned: how many checkbox candidates of the page, itself included, have their centre in the same column."""
    image_width = F.col(image_width) if isinstance(image_width, str) else image_width
    centre = (F.col("left") + F.col("right")) / 2
    # A page's centres as one value, so that candidates are neither joined with themselves nor multiplied.
    own = candidates.withColumn("_boxes", F.collect_list(F.when(F.col("checkbox"), centre)).over(Window.partitionBy(*PAGE)))
    own = own.withColumn("_centre", centre).withColumn("_reach", F.greatest(0.45 * height(), 0.012 * image_width))
    near = F.size(F.filter("_boxes", lambda c: F.abs(c - F.col("_centre")) <= F.col("_reach"))).cast("bigint")
    return once(own, aligned=near).select(*candidates.columns, "aligned")


def list_markers(words: DataFrame) -> DataFrame:
    """(line key, token, following, detection, dark): list markers to be taken out of their lines.

    words has a row per line: its first word's token and box, alone (no other word), next_left (of the second word), rest (the
    text of the others), text (of the whole line), page_width, page_height, and dark, the share of dark pixels in
    the first word's box. Solid markers are taken at once, checkboxes if two or more stand in a column; once two are, other
    lines' first words that look like misread checkboxes are looked at again.
    """
    least = F.least("page_width", "page_height")
    follow = nearest_follower(words.where("alone"), words).select(*LINE, "f_block_no", "f_line_no")
    texts = words.select(*PAGE, F.col("block_no").alias("f_block_no"), F.col("line_no").alias("f_line_no"), F.col("left").alias("o_left"), F.col("text").alias("o_text"))
    own = words.join(follow, LINE, "left").join(texts, [*PAGE, "f_block_no", "f_line_no"], "left")
    own = own.withColumn("gap", F.when(F.col("alone"), F.col("o_left")).otherwise(F.col("next_left")) - F.col("right")).withColumn("following", F.when(F.col("alone"), F.col("o_text")).otherwise(F.col("rest")))
    token, h, dark = F.col("token"), height(), F.col("dark")
    sized = (F.least(width(), h) >= F.greatest(F.lit(8.0), 0.005 * least)) & (width() / h).between(0.55, 1.65)
    plain = F.length(token).between(1, 4) & ~token.rlike(r"(?U)^(?:\d+|[A-Za-z])[.)]\z")
    explicit = F.length(token).eqNullSafe(1) & F.lit(EXPLICIT_MARKERS).contains(token)
    large = h >= 0.03 * least
    solid = (dark >= 0.68) & (explicit | (F.col("gap") >= F.greatest(F.lit(18.0), 0.7 * h)))
    box = (dark < 0.68) & ((dark >= 0.32) | (large & (dark >= 0.25))) & (F.col("gap") >= h * F.when(large, 0.15).otherwise(0.2)) & (token.startswith("[") | token.isin(*CHECKBOX_MISREADINGS) | large)
    prefix = F.regexp_extract("following", f"^([^{MEANINGFUL}]{{0,3}})[{MEANINGFUL}]", 1)
    starts = F.col("following").rlike(f"^[^{MEANINGFUL}]{{0,3}}[{MEANINGFUL}]") & (~prefix.rlike(r"(?U)\S") | explicit | token.isin(*MISREAD_MARKERS))
    able = (h > 0) & (width() > 0) & plain & sized & (F.col("gap") >= 0) & starts
    # Two steps: the conditions are planned with the whole of gap and following, which are made once.
    first = once(once(own, gap=F.col("gap"), following=F.col("following")), solid=able & solid, checkbox=able & box).where("solid or checkbox")
    taken = aligned_markers(first).where("solid or aligned >= 2").select(*LINE, "token", "following", "solid", "checkbox", "dark", "left", "right", "top", "bottom", "page_width")
    anchors = taken.where("checkbox").select(*PAGE, ((F.col("left") + F.col("right")) / 2).alias("a_centre"))
    enough = anchors.groupBy(*PAGE).agg(F.collect_list("a_centre").alias("centres")).where(F.size("centres") >= 2)
    again = words.join(enough, PAGE).join(taken.select(*LINE), LINE, "left_anti")
    strong = token.rlike(r"^\[[A-Za-z]{1,3}\]?\z")
    again = again.where(F.length(token).between(1, 4) & (token.startswith("[") | token.isin(*CHECKBOX_MISREADINGS)) & (F.col("alone") | strong))
    shaped = (F.least(width(), h) >= F.greatest(F.lit(8.0), 0.005 * least)) & large & F.try_divide(width(), h).between(0.35, 2.5)
    centre, reach = (F.col("left") + F.col("right")) / 2, F.greatest(0.45 * h, 0.012 * F.col("page_width"))
    near = F.size(F.filter("centres", lambda c: F.abs(c - centre) <= reach))
    again = again.where(strong | (shaped & (dark >= 0.2) & (near >= 2))).select(*LINE, "token", F.coalesce("rest", F.lit("")).alias("following"), F.lit(False).alias("solid"), "dark")
    both = taken.select(*LINE, "token", "following", "solid", "dark").unionByName(again)
    return both.select(*LINE, "token", F.left("following", F.lit(80)).alias("following"), F.when(F.col("solid"), "solid_marker").otherwise("aligned_checkbox").alias("detection"), F.round("dark", 3).alias("dark"))


def upper_quartile(of: Column, page: Window) -> Column:
    """The value at three quarters of a page's sorted values, of them, not between two; values are known."""
    nth, many = F.row_number().over(page.orderBy(of)), F.count(F.lit(1)).over(page)
    return F.when(nth == F.least(many, F.floor(many * 3 / 4) + 1), of)


def figure_flags(lines: DataFrame) -> DataFrame:
    """lines (text, characters, confidence, saturated, nonwhite, dark, page_width) with typical height and why each may be of a
    figure: coloured, ruled, laid_out, labelled."""
    page = Window.partitionBy(*PAGE)
    out = lines.withColumn("_quartile", upper_quartile(height(), page)).withColumn("typical", F.max("_quartile").over(page)).drop("_quartile")
    short = F.col("characters") <= 18
    out = out.withColumn("coloured", F.col("saturated") >= 0.012).withColumn("ruled", (F.col("dark") >= 0.075) & (F.col("nonwhite") >= 0.18))
    out = out.withColumn("laid_out", ((height() >= 1.7 * F.col("typical")) | ((F.col("confidence") < 0.62) & short)) & (width() <= 0.8 * F.col("page_width")))
    return out.withColumn("labelled", (F.col("confidence") < 0.78) & short & ((F.col("saturated") >= 0.005) | F.col("text").rlike(r"[A-Za-z<>=@#$\\|]")))


def figure_groups(flagged: DataFrame) -> DataFrame:
    """The candidate lines of flagged with group_no: a new group begins where the gap to the line above is more than five
    typical heights and 15 % of the page."""
    return _grouped(flagged).where("_member").drop("_member")


def _grouped(flagged: DataFrame) -> DataFrame:
    """flagged with _member, whether a line is a candidate, and group_no among its like: no join of lines with themselves."""
    own = flagged.withColumn("_member", F.coalesce(F.expr("coloured or ruled or laid_out or labelled"), F.lit(False)))
    order = Window.partitionBy(*PAGE, "_member").orderBy("top", "block_no", "line_no")
    gap = F.col("top") - F.lag("bottom").over(order)
    new = F.coalesce(gap > F.greatest(5 * F.col("typical"), 0.15 * F.col("page_height")), F.lit(False)).cast("int")
    return own.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


_FIELDS = ("block_no", "line_no", "left", "top", "right", "bottom", "characters", "saturated", "coloured", "ruled", "laid_out", "labelled", "group_no", "context", "typical", "page_width", "page_height")


def _regions_of(v: dict[str, np.ndarray]) -> list[tuple[float, float]]:
    """The figure regions of one page's flagged lines, in the order of their groups."""
    if len(v["top"]) < 2:
        return []
    tall, wide, typical = float(v["page_height"][0]), float(v["page_width"][0]), float(v["typical"][0])
    top, bottom, across = v["top"], v["bottom"], v["right"] - v["left"]
    centre = (top + bottom) / 2
    short = (v["characters"] <= 40) & (across <= 0.4 * wide)
    body = (v["characters"] >= 18) & (across >= 0.3 * wide) & (v["saturated"] < 0.005)
    # A kind of flag, how many lines of a group must have it, and how many typical heights the region must then span.
    kinds = (("coloured", 2, 2.5), ("ruled", 3, 3.0), ("laid_out", 3, 4.0), ("labelled", 2, 2.5))
    found = []
    for g in range(int(v["group_no"].max()) + 1):
        own = v["group_no"] == g
        above = top[own].min() - bottom
        shown = bool((v["context"] & (above >= 0) & (above <= 0.35 * tall)).any())
        enough = {k: int((v[k] & own).sum()) >= n and (k != "labelled" or shown) for k, n, _ in kinds}
        lead = next((k for k, *_ in kinds if enough[k]), None)
        single = not lead and own.sum() == 1 and bool((own & v["coloured"] & (v["saturated"] >= 0.05) & short).any())
        if not lead and not single:
            continue
        part = own & v[lead] if lead else own
        low, high = float(top[part].min()), float(bottom[part].max())
        if lead and high - low < typical * min(n for k, _, n in kinds if enough[k]):
            continue
        low, high = max(0.0, low - typical), min(tall, high + typical)
        for _ in range(2):  # near short labels are taken in, in the order of the lines, each held against the bounds so far
            before = low, high
            for i in np.flatnonzero(short):
                if low - 2 * typical <= centre[i] < low:
                    low = max(0.0, float(top[i]) - 0.5 * typical)
                elif high < centre[i] <= high + 2 * typical:
                    high = min(tall, float(bottom[i]) + 0.5 * typical)
            if before == (low, high):
                break
        if (body & ((centre < low) | (centre > high))).sum() >= 2:
            found.append((low, high))
    return found


def figure_regions(flagged: DataFrame) -> DataFrame:
    """(book, page, region_no, r_top, r_bottom): vertical stretches of charts, diagrams or screens among flagged lines.

    Taking in labels moves the bounds that the next label is held against, so each page is one fold, over the page's
    lines as one array; pages come in Arrow batches.
    """
    own = _grouped(flagged).withColumn("group_no", F.when(F.col("_member"), F.col("group_no")).otherwise(-1).cast("int")).withColumn("context", F.col("text").rlike("画面|イメージ"))
    whole = own.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*_FIELDS))).alias("lines"))

    def regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for book, page, every in zip(pdf["book"], pdf["page"], pdf["lines"], strict=True):
                v = {c: np.array([x[c] for x in every]) for c in _FIELDS}
                rows += [(book, page, i, low, high) for i, (low, high) in enumerate(_regions_of(v))]
            yield pd.DataFrame(rows, columns=["book", "page", "region_no", "r_top", "r_bottom"])

    kinds = {f.name: f.dataType.simpleString() for f in flagged.schema}
    return whole.mapInPandas(regions, f"book {kinds['book']}, page {kinds['page']}, region_no int, r_top double, r_bottom double")


def outside_figures(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines (text, characters, suspicious_ratio, page_height) with `kept`: not in a region by its centre, and no short noise
    within 15 % of the page from one."""
    y, reach = (F.col("top") + F.col("bottom")) / 2, 0.15 * F.col("page_height")
    noise = (F.col("characters") <= 6) & (F.col("suspicious_ratio") >= 0.25)
    hit = y.between(F.col("r_top"), F.col("r_bottom")) | (noise & (F.col("r_top") - reach <= y) & (y <= F.col("r_bottom") + reach))
    gone = lines.join(regions.select(*PAGE, "r_top", "r_bottom"), PAGE).where(hit).select(*LINE).distinct().withColumn("gone", F.lit(True))
    return lines.join(gone, LINE, "left").withColumn("kept", F.col("gone").isNull()).drop("gone")


def region_orientation(regions: DataFrame) -> DataFrame:
    """regions with vertical (taller than 1.08 times as wide) and the segmentation mode for it."""
    tall = (F.col("r_bottom") - F.col("r_top")) > 1.08 * (F.col("r_right") - F.col("r_left"))
    return regions.withColumn("vertical", tall).withColumn("mode", F.when(tall, 5).otherwise(6))


def accept_region_text(lines: DataFrame) -> DataFrame:
    """lines (text, confidence, suspicious_ratio) worth keeping of what a region's recognition gave."""
    return lines.where((japanese_count("text") >= 2) & (F.length("text") >= 2) & (F.col("confidence") >= 0.2) & (F.col("suspicious_ratio") <= 0.35) & ~F.col("text").rlike(CODE))


def clean_region_text(text: Column | str) -> Column:
    """Text in NFKC without stray short Latin tokens and tokens of no meaning; Al alone is AI."""
    from pagemill.functions.text import KNOWN_ACRONYMS, collapse_japanese_spaces, squeeze

    text = F.regexp_replace(text, r"(?<![A-Za-z0-9])Al(?![A-Za-z0-9])", "AI")
    kept = F.filter(F.split(squeeze(text), " "), lambda t: t.rlike(f"[{MEANINGFUL}]") & ~(t.rlike(r"^[A-Za-z]{1,2}\z") & ~F.upper(t).isin(*KNOWN_ACRONYMS)))
    return F.trim(collapse_japanese_spaces(F.array_join(kept, " ")))


