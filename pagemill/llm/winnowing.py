"""Document fingerprints by winnowing the rolling hashes of a text's characters, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import text_hash, written

GRAM, WINDOW, PIECE = 8, 8, 4096
#: The base's square is under 2 ** 20 modulo PRIME: the first of the steps in rolled() needs no remainder.
PRIME, BASE = (1 << 31) - 1, 1_000_364
LOW = (1 << 32) - 1
SMALLEST = -(1 << 63)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _nothing() -> Column:
    return F.array().cast("array<bigint>")


def _with_later(values: Column, by: int, f) -> Column:
    """f of each value and that `by` places on, which is null past the end."""
    return _let(values, lambda v: F.zip_with(v, F.slice(v, by + 1, F.size(v)), f))


def _hash(x: Column, y: Column, by: int, cut: bool = True) -> Column:
    """The hash of two neighbours' hashes, the second of `by` codes."""
    both = x * F.lit(pow(BASE, by, PRIME)).cast("long") + y
    return both % F.lit(PRIME).cast("long") if cut else both


def rolled(chars: Column, gram: int, pack) -> Column:
    """pack(hash, place) of the `gram` characters from each place on, null where fewer are left. The hash is a polynomial of the
    code points modulo PRIME. It rolls by doubling: that of 2 k codes is made of those of k codes at two places, so that
    each costs three steps for eight codes and is what a hash rolled code by code would be. gram is a power of two."""
    code = lambda c: F.ascii(c).cast("long")
    if gram == 2:
        return F.transform(chars, lambda c, i: pack(_hash(code(c), code(F.get(chars, i + 1)), 1), i))
    h, by = F.transform(chars, lambda c, i: _hash(code(c), code(F.get(chars, i + 1)), 1, cut=False)), 2
    while 2 * by < gram:
        h = _with_later(h, by, _doubling(by))
        by *= 2
    return _let(h, lambda v: F.transform(v, lambda x, i: pack(_hash(x, F.get(v, i + by), by), i)))


def _doubling(by: int):
    return lambda x, y: _hash(x, y, by)


def minima(packed: Column, window: int) -> Column:
    """The least value of the `window` values from each place on, or of all that are left. window is a power of two."""
    by = 1
    while by < window:
        packed = _with_later(packed, by, lambda x, y: F.least(x, y))
        by *= 2
    return packed


def piece_of(part: Column, first: Column | int, gram: int, window: int) -> Column:
    """The grams that are winnowed from a short string whose first character is number `first` of its text, in order.

    Each is its hash plus 1 above 32 bits that fall as its position rises, so a least value is a least hash and, of equal
    ones, the rightmost. A string shorter than a gram is one gram; fewer grams than a window are one window.
    """
    top = F.lit((1 << 32) + LOW) - first
    pack = lambda h, top: F.shiftleft(h, 32) + top
    code = lambda c: F.ascii(c).cast("long")

    def long_enough(chars: Column) -> Column:
        n = F.size(chars) - (gram - 1)
        least = minima(_let(top, lambda top: rolled(chars, gram, lambda h, i: pack(h, top - i))), window)
        return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.lit(1), n - (window - 1))))

    short = lambda chars: F.array(pack(F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: (a * F.lit(BASE) + code(c)) % F.lit(PRIME).cast("long")), top))
    n = F.length(part)
    return F.when(n >= gram, _let(F.split(part, ""), long_enough)).when(n > 0, _let(F.split(part, ""), short)).otherwise(_nothing())


def winnowed(text: str, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> Column:
    """array<long>: the winnowed grams of a column of texts, in order, as piece_of() packs them. The text's windows are dealt to
    pieces, so that a very long text takes no more memory than its fingerprint."""
    last = F.greatest(F.lit(1), F.length(text) - (gram + window - 2))
    count = F.ceil(last / piece).cast("int")
    own = lambda i: piece_of(F.substring(F.col(text), i * piece + 1, F.lit(piece + gram + window - 2)), i * piece, gram, window)
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), count - 1), own)))
    return F.when(count > 1, pieces).otherwise(piece_of(F.col(text), F.lit(0), gram, window))


def position(x: Column) -> Column:
    return F.lit(LOW) - x.bitwiseAND(F.lit(LOW))


def beginning(grams: str, last: Column, window: int) -> Column:
    """Those winnowed grams that some window up to number `last` takes: what winnowing gives of the text's beginning.

    A gram that is less than the one taken before is taken as soon as a window reaches it, any other one once windows have
    left the one before.
    """
    before = lambda i: F.get(F.col(grams), i - 1)
    start = lambda x, i: F.when(i == 0, F.lit(0).cast("long")).when(x < before(i), position(x) - (window - 1)).otherwise(position(before(i)) + 1)
    return _let(last, lambda last: F.filter(grams, lambda x, i: (position(x) <= last) | ((position(x) < last + window) & (start(x, i) <= last))))


def hashes(grams: str) -> Column:
    return F.array_distinct(F.transform(grams, lambda x: F.shiftrightunsigned(x, 32)))


def as_text(grams: str) -> Column:
    """Each gram as hexadecimal digits: its hash plus 1, and then eight digits of its position, the characters before it."""
    return F.array_join(F.transform(grams, lambda x: F.hex(x.bitwiseXOR(F.lit(LOW)))), " ")


def likeness(a: str, b: str) -> Column:
    """Distinct hashes in both over those in either; 1 for two empty fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def in_ranges(base: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds range, the number of the last bound that isn't above (key, mark), and first, whether it is that bound.

    Bounds are searched in two steps of about their square root."""
    one = lambda b: f"named_struct('key', {b[0]}L, 'mark', {b[1]}L)"
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.expr(f"array({', '.join(one(g[0]) for g in groups)})")
    inner = F.expr("array(" + ", ".join("array(" + ", ".join(map(one, g)) + ")" for g in groups) + ")")
    own = F.struct("key", "mark")
    up_to = lambda a: F.size(F.filter(a, lambda x: x <= own))
    out = base.withColumn("outer", F.greatest(F.lit(1), up_to(tops)))
    out = out.withColumn("inner", F.greatest(F.lit(1), up_to(F.element_at(inner, F.col("outer")))))
    first = F.element_at(F.element_at(inner, F.col("outer")), F.col("inner")) == own
    return out.withColumn("range", (F.col("outer") - 1) * step + F.col("inner") - 1).withColumn("first", first).drop("outer", "inner")


def followed(base: DataFrame, grams: Column) -> DataFrame:
    """Rows of base (key, mark, text, ..), each key and mark once, with grams, next_text and next_grams, those of the next row
    by key and mark, or of the first row after the last.

    Keys are dealt to ranges of like size, of which the least keys, a row for each, come to the driver. A range's first
    row also goes to the range before as its end, so texts move once and the next row is a window function within a range.
    """
    spark = base.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = base.select("key", "mark").repartitionByRange(parts, "key", "mark").groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "mark")).alias("least"))
    bounds = sorted((r["least"]["key"], r["least"]["mark"]) for r in least.collect()) or [(0, 0)]
    dealt = in_ranges(base, bounds)
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("end"))
    before = F.struct(F.when(F.col("range") > 0, F.col("range") - 1).otherwise(len(bounds) - 1).alias("range"), F.lit(True).alias("end"))
    dealt = dealt.withColumn("place", F.explode(F.when(F.col("first"), F.array(here, before)).otherwise(F.array(here)))).select(*base.columns, "place.range", "place.end")
    order = Window.partitionBy("range").orderBy("end", "key", "mark")
    rows = dealt.repartition("range").withColumn("grams", grams)
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_grams", F.lead("grams").over(order))
    return rows.where("not end").drop("range", "end")


def fingerprint(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of docs
    (doc_id, text; other columns are ignored).

    A gram is `gram` characters in a row, of any kind; its hash is a rolling polynomial. In each window of grams the least
    hash is kept, of equal ones the rightmost, with its position. Texts that share gram + window - 1 characters in a row
    share a fingerprint. A text shorter than a gram is one gram; fewer grams than a window are one window; an empty text has none.

    The edited text has the last half of the characters, rounded down, replaced by the first as many, or all, of the next
    document. Documents are in order of doc_id, a null one as the smallest possible number, and those of one doc_id in
    order of a hash of their texts; after the last comes the first. A null text is empty. Equal rows count as one in that
    order and have equal results. A single document follows itself. An empty table gives no rows.

    Each text is winnowed once. What the edited text's fingerprint has of a beginning of either text is told from theirs;
    only windows across the cut are winnowed anew.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("key"), text_hash().alias("mark"))
    ids = written(base.groupBy("key", "mark", F.col("doc_id").isNull().alias("missing")).agg(F.count("*").alias("rows")), "ids")
    if repeated := ids.groupBy("key", "mark").agg(F.sum("rows").alias("rows")).where("rows > 1").limit(1).count():
        base = base.drop("doc_id").dropDuplicates(["key", "mark"])
    both = followed(base, winnowed("text", gram, window, piece))
    reach = gram + window - 1
    both = both.withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    both = both.withColumn("kept", F.col("n") - F.col("half")).withColumn("taken", F.least("half", F.length("next_text")))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("kept")), F.substring("next_text", F.lit(1), F.col("taken"))))
    size, low = F.col("kept") + F.col("taken"), F.greatest(F.lit(0), F.col("kept") - (reach - 1))
    across = piece_of(F.substring("edited", low + 1, F.least(size, F.col("kept") + (reach - 1)) - low), low, gram, window)
    across = F.when((F.col("taken") == 0) & (size >= reach), _nothing()).otherwise(across)
    after = _let(F.col("kept"), lambda kept: F.transform(beginning("next_grams", F.col("taken") - reach, window), lambda x: x - kept))
    both = both.withColumn("edited_grams", F.array_distinct(F.concat(beginning("grams", F.col("kept") - reach, window), across, after)))
    both = both.withColumn("own_set", hashes("grams")).withColumn("edited_set", hashes("edited_grams")).withColumn("next_set", hashes("next_grams"))
    if repeated:
        both = both.join(ids, ["key", "mark"]).withColumn("doc_id", F.when(~F.col("missing"), F.col("key"))).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), as_text("grams").alias("fingerprint"), as_text("edited_grams").alias("edited_fingerprint"), likeness("own_set", "edited_set").alias("near_edited"), likeness("own_set", "next_set").alias("near_next"))


def sql() -> str:
    """The same as DuckDB's SQL: characters as rows, hashes and minima as window functions."""
    codes = ", ".join(f"lead(c, {j}) OVER o AS c{j}" if j else "c AS c0" for j in range(GRAM))
    hashed = "c0"
    for j in range(1, GRAM):
        hashed = f"(CASE WHEN c{j} IS NULL THEN {hashed} ELSE ({hashed} * {BASE} + c{j}) % {PRIME} END)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS (SELECT *, left(t, CAST(n - n // 2 AS BIGINT)) || left(nx, CAST(n // 2 AS BIGINT)) AS ed FROM x),
s AS (SELECT doc_id, 1 AS k, t AS s FROM e UNION ALL SELECT doc_id, 2, ed FROM e),
c AS (SELECT doc_id, k, length(s) AS n, unnest(list_transform(string_split(s, ''), lambda q: CAST(unicode(q) AS BIGINT))) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS i FROM s WHERE s <> ''),
r AS (SELECT doc_id, k, n, i, {codes} FROM c WINDOW o AS (PARTITION BY doc_id, k ORDER BY i)),
h AS (SELECT doc_id, k, greatest(1, n - {GRAM - 1}) AS g, i, {hashed} AS h FROM r),
m AS (SELECT doc_id, k, g, i, min((h + 1) * 4294967296 + {LOW} - i) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m FROM h WHERE i < g),
w AS (SELECT DISTINCT doc_id, k, m FROM m WHERE i <= greatest(0, g - {WINDOW})),
f AS (SELECT doc_id, k, string_agg(printf('%X%08X', m // 4294967296, {LOW} - m % 4294967296), ' ' ORDER BY {LOW} - m % 4294967296) AS f, list(DISTINCT m // 4294967296) AS hs FROM w GROUP BY ALL),
j AS (SELECT e.doc_id, n, ed, coalesce(a.f, '') AS fa, coalesce(b.f, '') AS fb, coalesce(a.hs, []) AS ha, coalesce(b.hs, []) AS hb FROM e LEFT JOIN (SELECT * FROM f WHERE k = 1) a USING (doc_id) LEFT JOIN (SELECT * FROM f WHERE k = 2) b USING (doc_id)),
z AS (SELECT *, coalesce(lead(ha) OVER (ORDER BY doc_id), first_value(ha) OVER (ORDER BY doc_id)) AS hn FROM j),
y AS (SELECT *, len(list_intersect(ha, hb)) AS ib, len(list_intersect(ha, hn)) AS i_n FROM z)
SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
CASE WHEN len(ha) + len(hb) = 0 THEN 1.0 ELSE ib / (len(ha) + len(hb) - ib)::DOUBLE END AS near_edited,
CASE WHEN len(ha) + len(hn) = 0 THEN 1.0 ELSE i_n / (len(ha) + len(hn) - i_n)::DOUBLE END AS near_next FROM y"""

