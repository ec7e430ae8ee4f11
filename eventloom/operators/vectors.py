"""Vectors: similar pairs within groups, the nearest to a query, and drift scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import cosine

#: Vectors of a group that meet in one task.
TILE = 1024
# From these scores on, work comes closer to the goal, or holds its distance; without anything to hold against.
CLOSER, HOLDING, UNKNOWN = 0.82, 0.65, 0.7


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    x = np.array(column.to_pylist(), float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def similar_pairs(vectors: DataFrame, group: str, least: float, tile: int = TILE) -> DataFrame:
    """a, b, similarity of the pairs of a group (vec_id, embedding of one length) that are at least this alike.

    A group is cut into tiles that meet two by two, each meeting one matrix product, so that no task grows with a group.
    """
    tiles = vectors.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    rows = vectors.filter("embedding IS NOT NULL").join(tiles, group).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "own", F.xxhash64(group, F.least("own", "with"), F.greatest("own", "with")).alias("meeting"))

    def meet(t: pa.Table) -> pa.Table:
        ids, own, x = t.column("vec_id").to_numpy(), t.column("own").to_numpy(), _unit(t.column("embedding"))
        s = x @ x.T
        a, b = np.nonzero((s >= least) & (ids[:, None] < ids[None, :]))
        if own.min() != own.max():  # two tiles: pairs within one are met elsewhere
            a, b = a[own[a] != own[b]], b[own[a] != own[b]]
        return pa.table({"a": ids[a], "b": ids[b], "similarity": s[a, b]})

    return rows.groupBy("meeting").applyInArrow(lambda t: meet(t), "a long, b long, similarity double")


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors most like a query, ties to the smaller id (TK7, VE4)."""
    s = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select("vec_id", s.alias("s")).orderBy(F.desc("s"), "vec_id").limit(k).select("vec_id", F.round("s", 6).alias("similarity"))


def drift_scores(outputs: DataFrame, criteria: DataFrame, key: str) -> DataFrame:
    """outputs with score: the mean cosine to the criteria of their key, else that to their goal, else 0.7 (VE2)."""
    # a mean of cosines is a product with the sum of unit vectors: one for each key and length, so that rows don't meet criteria
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(F.col("criterion"), F.col("criterion")))
    units = criteria.withColumn("norm", norm).filter("norm > 0").select(key, F.size("criterion").alias("size"), "norm", F.posexplode("criterion").alias("at", "x"))
    sums = units.groupBy(key, "size", "at").agg(F.sum(F.col("x").cast("double") / F.col("norm")).alias("x"))
    sums = sums.groupBy(key, "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("sum"))
    rows = outputs.select("vec_id", key, "embedding", F.size("embedding").alias("size")).join(criteria.groupBy(key).agg(F.count("*").alias("n")), key).join(sums, [key, "size"], "left")
    own = F.sqrt(total(F.col("embedding"), F.col("embedding")))
    rows = rows.withColumn("cosines", F.when(F.col("sum").isNotNull() & (own > 0), total(F.col("embedding"), F.col("sum")) / own).otherwise(0.0))
    mean = rows.groupBy("vec_id").agg((F.sum("cosines") / F.sum("n")).alias("mean"))
    return outputs.join(mean, "vec_id", "left").withColumn("score", F.coalesce("mean", F.when(F.col("goal").isNotNull(), cosine(F.col("embedding"), F.col("goal"))), F.lit(UNKNOWN))).drop("mean")


def direction(score: Column) -> Column:
    """closer, holding or drifting (VE3)."""
    return F.when(score >= CLOSER, "closer").when(score >= HOLDING, "holding").otherwise("drifting")
