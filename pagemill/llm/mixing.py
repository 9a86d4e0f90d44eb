"""Mixing sources to target weights: exact budgets by subset sums over counts of document lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import WORD, text_hash, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words that the mix should take of each source, from (source, its words).

    Sources by code point, null last, have the weights in turn; they divide `share` times all words by weight. A
    source stops at `most` times its own words, and what it can't take is divided anew among the others.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left, found, open_ = share * sum(n for _, n in order), {}, [s for s, _ in order]
    while open_:
        per = left / sum(weight[s] for s in open_)
        if not (over := [s for s in open_ if per * weight[s] > cap[s]]):
            return found | {s: per * weight[s] for s in open_}
        for s in over:
            found[s] = float(cap[s])
            left -= cap[s]
        open_ = [s for s in open_ if s not in over]
    return found


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to the budget, or as near as can be.

    A like share of every length comes first, rounded down, and then one more of each, longest first, until about twice the
    median length is missing. That rest, widened by a few short documents given back, is a bounded knapsack: a table
    of reachable sums, as bits, grows by one length at a time with as many documents as are left of it, and stops
    once the exact rest is reachable. Work and memory follow the number of lengths, not documents or the budget.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = sum(int(x) * int(n) for x, n in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.array([int(n) * budget // total for n in counts], np.int64)
    missing = budget - sum(int(x) * int(n) for x, n in zip(lengths, taken, strict=True))
    order = np.argsort(-lengths, kind="stable")
    middle = int(lengths[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])
    half = 2 * middle
    for i in order:
        if (x := int(lengths[i])) <= missing - half and taken[i] < counts[i]:
            taken[i] += 1
            missing -= x
    back = 0
    for i in order[::-1]:
        n = min(int(taken[i]), max(0, half - back) // int(lengths[i]))
        taken[i] -= n
        back += n * int(lengths[i])
    goal, reach, steps = missing + back, 1, []
    mask = (1 << (2 * goal + 2 * half + 1)) - 1
    for i in order[::-1]:
        x, k = int(lengths[i]), 1
        n = min(int(counts[i] - taken[i]), mask.bit_length() // x)
        while n > 0 and not reach >> goal & 1:  # n documents of a length as bundles of 1, 2, 4 and so on
            k = min(k, n)
            steps.append((i, k, reach))
            reach = (reach | reach << (x * k)) & mask
            n -= k
            k *= 2
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    above = goal + (above & -above).bit_length() if above else None
    at = above if above is not None and above - goal < goal - below else below
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            at -= int(lengths[i]) * k
            taken[i] += k
    return taken


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_hash().alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken, copies), one row per row of docs (doc_id, text, source; other columns
    are ignored): a source's words taken add up to its target to within a few words where its lengths allow it.

    Documents are counted by source and length. Of each source every document is taken as often as the target holds
    the whole source; fit() says how many of each length go once more, and those with the lowest seeded hashes go.
    A target of several times a source never lets a document exceed `most` times its size. A null text has size 0;
    a null source is a source of its own. Equal rows tie and any of them may go, with the same result. Sizes of 0
    are taken 0 words. An empty table gives no rows.

    To the driver comes one row per source, and back; Spark broadcasts these rows only if they are small. A source's lengths meet in one task, a row per distinct length. A length
    of which only some go is dealt to about the square root of its documents as hash buckets, and only the bucket at the
    boundary is ranked, so no task ranks a large group.
    """
    spark = docs.sparkSession
    own = written(sized(docs), "sizes")
    sums = [(r["source"], r["n"]) for r in own.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    aim = targets(sums, weights, share, most)
    per = spark.createDataFrame([(s, n, aim[s]) for s, n in sums] or [], "source string, source_size long, target double")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(int(target // total), most) if total else 1
        more = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target) - base * total if base < most else 0)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "base": base, "more": more, "source_size": total, "target": target})

    sizes = own.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    plan = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).select(sizes["source"], "size", "n", "source_size", "target")
    plan = plan.groupBy("source").applyInPandas(choose, "source string, size long, n long, base int, more long, source_size long, target double")
    # A null source is joined by a text that no other source has: plain equality lets skewed joins be split.
    tag = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tag")
    plan = written(plan.select(tag, "size", "n", "base", "more", F.greatest(F.lit(1), F.round(F.sqrt("n")).cast("int")).alias("buckets")), "plan")
    dealt = own.select("*", tag, F.xxhash64("doc_id", "source", F.lit(seed)).alias("hash"))
    bucket = F.pmod(F.shiftright("hash", 20), "buckets").alias("bucket")
    some = dealt.join(plan.where("more > 0 and more < n"), ["tag", "size"])
    counts = some.groupBy("tag", "size", "more", bucket).agg(F.count("*").alias("held"))
    up = Window.partitionBy("tag", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = counts.withColumn("rest", F.col("more") - F.sum("held").over(up) + F.col("held")).where("rest > 0 and rest <= held").select("tag", "size", F.col("bucket").alias("edge"), "rest")
    plan = written(plan.join(edge, ["tag", "size"], "left"), "edges")
    per = per.select(tag, "source_size", "target")
    known = dealt.join(per, "tag").join(plan, ["tag", "size"], "left")
    known = written(known.select("doc_id", "text_hash", "tag", "size", "source_size", "target", "hash", F.coalesce("base", F.lit(0)).alias("base"), "more", "n", bucket, "edge", "rest"), "known")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    order = Window.partitionBy("tag", "size", "bucket").orderBy("hash", "doc_id", "text_hash")
    ranked = known.where(at_edge).withColumn("more_of_it", (F.row_number().over(order) <= F.col("rest")).cast("int"))
    others = known.where(~at_edge).withColumn("more_of_it", F.coalesce((F.col("more") == F.col("n")) | (F.col("bucket") < F.col("edge")), F.lit(False)).cast("int"))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("more_of_it")).otherwise(0)
    out = ranked.unionByName(others).withColumn("copies", copies.cast("int"))
    return out.select("doc_id", "text_hash", F.when(F.col("tag") != "-", F.substring("tag", 2, 1 << 30)).alias("source"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
