"""Ball k-means over integer vectors: Lloyd's rounds with the same outcome, and fewer distances.

A cluster is a ball: its centroid, and a radius that holds all members (the largest distance when they were assigned, plus
what the centroid has moved since). Only centroids within twice the radius can take a member away: the ball's neighbours,
nearest first. Half their distances cut the ball into a stable core, whose members stay, and annuli: a member at distance d
compares itself exactly with the neighbours within 2 d alone. Where neither the own centroid nor a neighbour has moved, that
comparison isn't made again.

A round is one pass over a written table of vectors with their clusters; each batch also writes a partial sum for each of
its clusters, so a cluster with any share of the vectors is spread over all tasks. The driver sees centroids and sums, k
times the width, and nothing of the vectors. Sums and squared distances are exact 64-bit integers.

Defined cases: a vector that is null, of another width, or holds null or non-finite components takes no part; rows that
repeat an id or a vector take part each; a row without an id takes part but never starts a cluster; rows of equal hash start
clusters in order of their vectors; with fewer vectors than clusters there are as many clusters as vectors; an empty table
gives an empty result; a component of 2^26 or more after scaling (a distance might not fit a long) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import table, written
from eventloom.llm.integer_vectors import integers, matrix

WIDTH, CLUSTERS, ROUNDS, LARGEST = 64, 40, 5, 1 << 26
SCHEMA = "kind string, vec_id long, x array<long>, cluster int, distance long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Balls:
    """centroids[k, width]; of each ball, its neighbours nearest first, and their squared distances; which centroids have moved."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    apart: list[np.ndarray]
    moved: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, radius: np.ndarray, moved: np.ndarray) -> Balls:
        near, apart = [], []
        for a, c in enumerate(centroids):
            d = squared(centroids, c)
            # a ball that stayed looks at the centroids that have moved alone
            other = (np.arange(len(centroids)) != a) & (moved | moved[a]) & (d <= 4 * radius[a] ** 2)
            j = np.flatnonzero(other)
            j = j[np.argsort(d[j], kind="stable")]
            near.append(j)
            apart.append(d[j])
        return cls(centroids, near, apart, moved)

    def assigned(self, x: np.ndarray, own: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (of equal ones the smaller number) and the squared distance to it."""
        best, near = own.copy(), distance.copy()
        for a in np.unique(own):
            rows = np.flatnonzero(own == a)
            if self.moved[a]:
                near[rows] = squared(x[rows], self.centroids[a])
            # how many neighbours each member has within twice its distance; none: the stable core
            annulus = np.searchsorted(self.apart[a], 4 * near[rows], side="right")
            order = np.argsort(-annulus, kind="stable")
            rows, annulus = rows[order], annulus[order]
            for t, j in enumerate(self.neighbours[a]):
                some = rows[:np.searchsorted(-annulus, -t, side="left")]
                if not len(some):
                    break
                d = squared(x[some], self.centroids[j])
                closer = (d < near[some]) | (d == near[some]) & (j < best[some])
                best[some[closer]], near[some[closer]] = j, d[closer]
        return best, near


def assign(state: DataFrame, balls: Balls) -> DataFrame:
    """The vectors with their clusters, and in rows of kind 'part' each batch's sums (with the count last) and largest distance a cluster."""
    sent, width = state.sparkSession.sparkContext.broadcast(balls), balls.centroids.shape[1]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), width)
            if np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component is {LARGEST} or more after scaling: squared distances may not fit a long")
            cluster, distance = sent.value.assigned(x, b.column("cluster").to_numpy().astype(np.int64), b.column("distance").to_numpy())
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums = np.column_stack([np.add.reduceat(x[order], first), np.diff(np.append(first, len(x)))])
            yield pa.RecordBatch.from_arrays([pa.array(["vector"] * len(x)), b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(distance)], names)
            yield pa.RecordBatch.from_arrays([
                pa.array(["part"] * len(found)), pa.nulls(len(found), pa.int64()), pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * (width + 1), pa.array(sums.ravel())),
                pa.array(found, pa.int32()), pa.array(np.maximum.reduceat(distance[order], first))], names)

    names = ["kind", "vec_id", "x", "cluster", "distance"]
    return state.select("vec_id", "x", "cluster", "distance").mapInArrow(batches, SCHEMA)


def starts(rows: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors of the smallest hashes of salt and id, in that order."""
    hashed = rows.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in hashed.orderBy("h", "x").limit(clusters).select("x").collect()], np.int64)


def ball_kmeans(vectors: DataFrame, *, width: int = WIDTH, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "2", scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x, cluster, distance of each vector after the rounds, and the centroids."""
    rows = written(integers(vectors.filter(F.size("embedding") == width), scale), "ball_vectors")
    centroids = starts(rows, clusters, salt)
    if not len(centroids):
        return rows.limit(0).select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
    # before the first round all vectors are in the ball of the first centroid, of any radius
    radius, moved = np.full(len(centroids), np.inf), np.ones(len(centroids), bool)
    for k in range(rounds + 1):
        out = written(assign(state, Balls.of(centroids, radius, moved)), "balls")
        state = out.filter("kind = 'vector'").drop("kind")
        if k == rounds:
            break
        parts = out.filter("kind = 'part'").select("cluster", "distance", F.posexplode("x").alias("at", "value"))
        sums, far = [[0] * (width + 1) for _ in centroids], np.zeros(len(centroids))
        for r in parts.groupBy("cluster", "at").agg(F.sum("value").alias("value"), F.max("distance").alias("far")).toLocalIterator():
            sums[r["cluster"]][r["at"]], far[r["cluster"]] = r["value"], r["far"]
        new = np.array([[s // x[-1] for s in x[:-1]] if x[-1] else old for x, old in zip(sums, centroids.tolist())], np.int64)
        shift = squared(new, centroids)
        radius = (np.sqrt(far) + np.sqrt(shift)) * (1 + 1e-9)  # rounded up: a ball may be too large, never too small
        centroids, moved = new, shift > 0
        if not moved.any():
            break  # the clusters are final
    return state, centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = ball_kmeans(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["inertia"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).toLocalIterator()}
    told = [(k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a cluster
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> str:
    """Lloyd's rounds in plain SQL."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT rid, vec_id, x, k, d FROM (
  SELECT v.*, c.k, list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k} c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        steps.append(f"""m{k} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
  SELECT k, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k}, range(1, {width + 1}) t(i) GROUP BY k, i)) GROUP BY k),
c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m USING (k))""" if k < rounds else f"""f AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a{k} GROUP BY k)""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clusters})),
{", ".join(steps)}
SELECT a.vec_id, a.k::INTEGER AS cluster, a.d AS distance, f.cluster_inertia, (SELECT sum(cluster_inertia) FROM f)::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN f USING (k) JOIN c{rounds} c USING (k)"""


ORACLE = oracle()
