"""Mixing sources to target weights by exact subset sums over document lengths.

Spark counts documents by source and exact word count. Each source's target is met by whole passes over the source, then
by a part of one more pass: in proportion for all but a last stretch, evenly along the lengths from a seeded start, and for
that stretch by bounded-knapsack dynamic programming over the length counts, in a seeded order (bits of one integer are the
sums that can be reached). Documents of a length are then taken in the order of a seeded hash, by their exact rank.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take
nothing; repeated rows, also of the same id, are documents of their own; an empty table gives an empty result. Ties of the
hash go to the smaller doc_id, then to the text's hash; rows alike in all of these are interchangeable.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, table

WEIGHTS, BUDGET, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words of the stretch that dynamic programming fits (two of the longest documents if these are more); a bound on its memory.
STRETCH = 1 << 16


def size_of(text: Column) -> Column:
    """Number of words: the stretches between spaces, less an empty one at either end."""
    t = F.coalesce(text, F.lit(""))
    edge = lambda c: c.rlike(r"[\x20\x09-\x0D]").cast("int")
    ends = F.when(t == "", F.lit(1)).otherwise(edge(F.substring(t, 1, 1)) + edge(F.substring(t, -1, 1)))
    return F.greatest(F.size(F.split(t, SPACES)) - ends, F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size) rows: shares by weight, cut at ``most`` times the size.

    The excess goes to the other sources by weight until none is above: the level at which the cut shares add up to the
    budget. With the sources in order of cap by weight, one running sum finds the level, so nothing is iterated.
    """
    numbered = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    numbered = numbered.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights)).cast("int")))
    numbered = numbered.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = numbered.select(
        "*",
        (budget * F.sum("source_size").over(everything)).alias("total"),
        F.coalesce(F.sum("cap").over(order), F.lit(0.0)).alias("below"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0.0))).alias("w_left"),
    )
    # the level if this source and those after it were uncut; it is the right one for the first that stays uncut
    numbered = numbered.withColumn("level", (F.col("total") - F.col("below")) / F.col("w_left"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(everything)["level"]
    return numbered.withColumn("found", level).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("found"), F.col("cap"))).alias("target"))


def fit_counts(lengths: list[int], counts: list[int], goal: int, stretch: int = STRETCH, seed: int = 0) -> list[int]:
    """How many documents of each length to take, so that the words come as near to goal as they can.

    All but a last stretch is taken in proportion. The stretch is that of a few of the longest documents at first; while the
    goal is not met to the word it grows, up to ``stretch``.
    """
    goal = max(0, min(goal, sum(n * c for n, c in zip(lengths, counts))))
    longest = max(lengths, default=0)
    most = max(stretch, 2 * longest)
    last, best = min(most, 4 * longest), None
    while True:
        take = fit_stretch(lengths, counts, goal, last, seed)
        gap = abs(goal - sum(n * t for n, t in zip(lengths, take)))
        if best is None or gap < best[0]:
            best = gap, take
        if not best[0] or last >= min(most, goal):
            return best[1]
        last = min(most, 4 * last)


def fit_stretch(lengths: list[int], counts: list[int], goal: int, stretch: int, seed: int) -> list[int]:
    """The counts if all but ``stretch`` words are taken in proportion.

    Of the documents in order of length every (1 / share)th is taken, so that lengths of one document alone have their share
    too, and what is left is no more than a longest document away from the stretch. The rest of each length then takes part
    in a bounded knapsack whose reachable sums are the bits of an integer.
    """
    rng = np.random.default_rng(seed)
    total = sum(n * c for n, c in zip(lengths, counts))
    share = max(0, goal - stretch) / total if total else 0.0
    order = np.argsort(lengths, kind="stable")
    marks = np.floor(np.cumsum(np.array(counts, np.int64)[order]) * share + rng.random()).astype(np.int64)
    take = np.zeros(len(lengths), np.int64)
    take[order] = np.minimum(np.diff(marks, prepend=0), np.array(counts, np.int64)[order])
    take = take.tolist()
    left = goal - sum(n * t for n, t in zip(lengths, take))
    # items by powers of two, so that every count up to what is left can be made
    reach, items, seen, offered = 1, [], [], []
    bound = max(0, left) + max(lengths, default=0)
    mask = (1 << (bound + 1)) - 1
    for i, (n, c, t) in enumerate(zip(lengths, counts, take)):
        if n <= 0:
            continue
        spare, step = min(c - t, bound // n), 1
        while spare > 0:
            k = min(step, spare)
            offered.append((i, k))
            spare, step = spare - k, step * 2
    for at in rng.permutation(len(offered)):  # a seeded spread of lengths, not the shortest first
        i, k = offered[at]
        grown = reach | (reach << (lengths[i] * k)) & mask
        if grown != reach:
            items.append((i, k))
            seen.append(reach)
            reach = grown
        if left >= 0 and reach >> left & 1:
            break
    # the reachable sum nearest to what is left, the smaller one of two
    down = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1 if left >= 0 else 0
    above = reach >> (left + 1) if left >= 0 else 0
    up = left + 1 + ((above & -above).bit_length() - 1) if above else None
    at = down if up is None or left - down <= up - left else up
    for (i, k), before in zip(reversed(items), reversed(seen)):
        if not before >> at & 1:
            take[i] += k
            at -= lengths[i] * k
    return take


def plan(histogram: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """source_key, size, passes (of the whole source), more (documents of this size taken once more).

    A source's histogram has at most as many rows as lengths, which is the square root of twice its words or fewer.
    """
    joined = histogram.join(wanted, "source_key")

    def of_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        lengths, counts = pdf["size"].tolist(), pdf["n"].tolist()
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(target // total), int(MOST)) if total else 0
        rest = round(target - passes * total) if passes < MOST else 0
        own = zlib.crc32(f"{seed} {pdf['source_key'].iloc[0]}".encode("utf-8", "surrogatepass"))
        return pdf[["source_key", "size"]].assign(passes=passes, more=fit_counts(lengths, counts, rest, seed=own))

    return joined.groupBy("source_key").applyInPandas(of_source, "source_key string, size long, passes long, more long")


def mix(docs: DataFrame, *, seed: int = 11, carry: list[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken; carry: further columns, in a struct ``row``."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # null apart from every text
    rows = docs.select(
        "doc_id", key.alias("source_key"), size_of(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).alias("at"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    histogram = rows.groupBy("source_key", "size").agg(F.count("*").alias("n"))
    sizes = histogram.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = sizes.withColumn("source", F.when(F.col("source_key") != "-", F.expr("substring(source_key, 2)")))
    wanted = targets(named.select("source", "source_size")).withColumn(
        "source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).select("source_key", "source_size", "target")
    taking = plan(histogram, wanted, seed)
    # exact ranks within a source and length: by slices of the hash, so that no slice grows with its group
    total = Window.partitionBy("source_key", "size")
    slices = rows.groupBy("source_key", "size", slice_of(F.col("at")).alias("slice")).agg(F.count("*").alias("m"))
    before = F.sum("m").over(total.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("source_key", "size", "slice", "m", F.coalesce(before, F.lit(0)).alias("before"))
    decided = slices.join(taking, ["source_key", "size"]).join(wanted, "source_key")
    decided = decided.select(
        "source_key", "size", "slice", "passes", "source_size", "target",
        F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("m")).alias("here"),
        "m",
    )
    joined = rows.withColumn("slice", slice_of(F.col("at"))).join(decided, ["source_key", "size", "slice"])
    # only the slice that the limit cuts needs ranks
    rank = F.row_number().over(Window.partitionBy("source_key", "size", "slice").orderBy("at", "doc_id"))
    return joined.withColumn("rank", rank).select(
        "doc_id", F.when(F.col("source_key") != "-", F.expr("substring(source_key, 2)")).alias("source"), "size",
        "source_size", "target",
        (F.col("size") * (F.col("passes") + (F.col("rank") <= F.col("here")).cast("long"))).alias("taken"),
        *(["row"] if carry else []),
    )


def slice_of(at: Column, bits: int = 12) -> Column:
    """The top bits of the hash."""
    return F.shiftrightunsigned(at, 64 - bits).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with all their columns."""
    rows = mix(docs, carry=docs.columns).filter("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return rows.select("row", F.explode(times)).select(*[F.col("row")[c].alias(c) for c in docs.columns])
