"""Approximate nearest neighbours by a forest of random-projection trees.

Vectors are extended by one dimension so that all have the same norm and the largest inner product is the smallest angle.
Each tree cuts a level by a random direction at the median of the node's sample. A query walks all trees at once: one
priority queue holds the branches not taken, of every tree, by their distance from the cut, and the best are opened until
enough leaves are found. The candidates of these leaves are reranked by exact inner products of the original vectors.

The trees are fitted on a bounded sample (SAMPLE vectors in the order of a seeded hash) and every vector is indexed. Equal
vectors are one class in the index, which keeps its smallest ids, as many as a result can name, so copies make no leaf
large. Leaves with more than LEAF_MOST classes are cut into parts that each query meets.

How many leaves a query opens follows from the table: for PROBES of the distinct query vectors the nearest classes are found
by brute force, block by block, and as many leaves are opened as these probes need to meet AIM of them. Where no number below
that will do, this is every leaf, and the result exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; so do vectors of another length than the most frequent one; equal scores go to the smaller vec_id; with fewer
candidates than wanted all are returned; an empty table gives an empty result; rows that repeat an id are candidates once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import table, written

NEAREST, EVERY = 20, 20
#: Trees, vectors in the sample, classes wanted in a leaf, classes in a part of a leaf.
TREES, SAMPLE, LEAF, LEAF_MOST = 12, 1 << 16, 512, 4096
#: Query vectors that are held against brute force, and the recall wanted of them (0.9 with room for the sample's error).
PROBES, AIM = 128, 0.95


@dataclass
class Forest:
    """directions[t][level]: unit vectors; cuts[t][level][node]: the medians. The size depends on SAMPLE alone."""

    directions: np.ndarray
    cuts: list[list[np.ndarray]]
    norm: float

    def extended(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        x = self.extended(x)
        out = np.zeros((len(x), len(self.cuts)), np.int64)
        for t, levels in enumerate(self.cuts):
            for level, cut in enumerate(levels):
                out[:, t] = 2 * out[:, t] + (x @ self.directions[t, level] > cut[out[:, t]])
        return out

    def search(self, q: np.ndarray, opened: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves nearest to the cuts' sides that q is on, over all trees."""
        projected = self.directions @ np.append(q, 0.0)
        queue = [(0.0, t, 0, 0) for t in range(len(self.cuts))]
        found = []
        while queue and len(found) < opened:
            far, t, level, node = heapq.heappop(queue)
            levels = self.cuts[t]
            while level < len(levels):
                margin = projected[t, level] - levels[level][node]
                side = int(margin > 0)
                heapq.heappush(queue, (max(far, abs(margin)), t, level + 1, 2 * node + 1 - side))
                node, level = 2 * node + side, level + 1
            found.append((t, node))
        return found

    def distances(self, q: np.ndarray) -> np.ndarray:
        """[tree, leaf]: the value by which search orders the leaves."""
        projected = self.directions @ np.append(q, 0.0)
        out = []
        for t, levels in enumerate(self.cuts):
            far = np.zeros(1)
            for level, cut in enumerate(levels):
                margin = projected[t, level] - cut
                sides = np.column_stack([np.where(margin > 0, np.abs(margin), 0), np.where(margin > 0, 0, np.abs(margin))])
                far = np.maximum(far[:, None], sides).ravel()
            out.append(far)
        return np.array(out)

    def opened_for(self, probes: np.ndarray, near: list[np.ndarray], aim: float = AIM) -> int:
        """The fewest leaves a query by which the probes meet the share aim of near, the leaves [neighbour, tree] of each."""
        needed = []
        for q, leaves in zip(probes, near):
            far = self.distances(q)
            nearest_leaf = far[np.arange(len(far)), leaves].min(axis=1)
            needed.append(np.searchsorted(np.sort(far.ravel()), nearest_leaf, side="right"))
        needed = np.sort(np.concatenate([[1], *needed]))[1:]
        return int(needed[int(np.ceil(aim * len(needed))) - 1]) if len(needed) else 1


def grow(sample: np.ndarray, n: int, norm: float, *, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> Forest:
    """A forest whose leaves hold about leaf of n vectors; a level's nodes without sample vectors are cut at the level's median."""
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if len(sample) else 0
    levels = min(levels, 20)
    rng = np.random.default_rng(seed)
    width = sample.shape[1] + 1
    directions = rng.standard_normal((trees, max(levels, 1), width))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    forest = Forest(directions, [[] for _ in range(trees)], norm)
    x = forest.extended(sample)
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for level in range(levels):
            p = x @ directions[t, level]
            cut = np.full(1 << level, float(np.median(p)))
            order = np.lexsort((p, node))
            begin = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))
            size = np.diff(np.append(begin, len(node)))
            cut[node[order][begin]] = p[order][begin + (size - 1) // 2]
            forest.cuts[t].append(cut)
            node = 2 * node + (p > cut[node])
    return forest


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, each id once."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (width["n"] if width else 0))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their smallest ids; ids beyond keep are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("k", rank).filter(F.col("k") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy().reshape(len(column), -1)


def best_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at least the k rows of x with the largest products with each q; ties go to the smaller id.

    A matrix product picks all rows that may be among them, rounding included; scores are then taken row by row, so that
    equal vectors get equal scores, and order the rest.
    """
    s = q @ x.T
    if len(x) <= k:
        who, c = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
        return who, c, (q[who] * x[c]).sum(axis=1)
    kth = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
    slack = 1e-15 * x.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    who, c = np.nonzero(s >= (kth - slack)[:, None])
    score = (q[who] * x[c]).sum(axis=1)
    order = np.lexsort((ids[c], -score, who))
    who, c, score = who[order], c[order], score[order]
    first = np.searchsorted(who, np.arange(len(q)))
    few = np.arange(len(who)) - first[who] < k
    return who[few], c[few], score[few]


def neighbours_of(classes: DataFrame, probes: np.ndarray, sent, k: int) -> list[np.ndarray]:
    """The leaves [neighbour, tree] of the k classes nearest to each probe, its own left out; by brute force."""
    q_sent = classes.sparkSession.sparkContext.broadcast(probes)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, q = sent.value, q_sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, reps = _matrix(pa.chunked_array([b.column("vector")])), b.column("rep").to_numpy()
            who, c, score = best_rows(q, x, reps, k + 1)
            other = (q[who] != x[c]).any(axis=1)
            who, c, score = who[other], c[other], score[other]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(reps[c]), pa.array(score), pa.array(list(forest.leaves(x[c])), pa.list_(pa.int64()))], ["probe", "rep", "score", "leaves"])

    found = classes.select("rep", "vector").mapInArrow(best, "probe long, rep long, score double, leaves array<long>")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "rep"))
    near = [[] for _ in probes]
    for r in found.withColumn("c", rank).filter(F.col("c") <= k).select("probe", "leaves").toLocalIterator():
        near[r["probe"]].append(r["leaves"])
    return [np.array(x, np.int64).reshape(-1, len(sent.value.cuts)) for x in near]


def nearest(vectors: DataFrame, is_query, *, k: int = NEAREST, opened: int | None = None, leaf: int = LEAF, leaf_most: int = LEAF_MOST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that is_query(vec_id) picks.

    opened: leaves that a query opens; by default as many as AIM needs.
    """
    spark = vectors.sparkSession
    rows = written(valid(vectors), "vectors")
    classes = written(classes_of(rows, k + 1), "vector_classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    n = facts["n"]
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector")
    sample = np.array([r["vector"] for r in sample.toLocalIterator()], float)
    sent = spark.sparkContext.broadcast(grow(sample.reshape(len(sample), -1 if len(sample) else 1), n, float(np.sqrt(facts["norm2"] or 0.0)), leaf=leaf))
    queries = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vector")
    if opened is None:
        probes = queries.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(PROBES)
        probes = np.array([r["vector"] for r in probes.collect()], float)
        opened = sent.value.opened_for(probes, neighbours_of(classes, probes, sent, k)) if len(probes) else 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for b in batches:
            leaves = forest.leaves(_matrix(pa.chunked_array([b.column("vector")]))) if b.num_rows else np.zeros((0, TREES), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(leaves), pa.list_(pa.int64())), b.column("rep"), b.column("vector")], ["leaves", "rep", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for b in batches:
            found = [[t << 32 | node for t, node in forest.search(q, opened)] for q in _matrix(pa.chunked_array([b.column("vector")]))] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), b.column("query_id")], ["leaves", "query_id"])

    members = classes.select("rep", "vector").mapInArrow(index, "leaves array<long>, rep long, vector array<double>")
    members = members.select("rep", "vector", F.posexplode("leaves").alias("tree", "node")).select("rep", "vector", (F.shiftleft(F.col("tree").cast("long"), 32).bitwiseOR(F.col("node"))).alias("leaf"))
    # leaves that are too large (ties, or more vectors than the sample could part) are cut into parts
    parts = members.groupBy("leaf").agg(F.count("*").alias("m")).filter(F.col("m") > leaf_most).select("leaf", F.ceil(F.col("m") / leaf_most).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int"), F.lit(0))
    members = members.join(parts, "leaf", "left").select("rep", "vector", "leaf", part.alias("part"))
    asked = queries.mapInArrow(probe, "leaves array<long>, query_id long").select("query_id", F.explode("leaves").alias("leaf"))
    asked = asked.join(parts, "leaf", "left").select("query_id", "leaf", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    deals = max(8, -(-n * TREES // 50_000))
    key = F.xxhash64("leaf", "part")
    deal = F.pmod(key, F.lit(deals)).alias("deal")
    members = members.select("rep", "vector", key.alias("cell"), deal)
    # a query goes to a deal once, with the cells it opens there
    asked = asked.select("query_id", key.alias("cell"), deal).groupBy("query_id", "deal").agg(F.collect_list("cell").alias("cells")).join(queries, "query_id")

    def meet(own: pa.Table, of: pa.Table) -> pa.Table:
        """The k + 1 best classes of each query over the leaves of this deal."""
        schema = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
        if not own.num_rows or not of.num_rows:
            return schema.empty_table()
        x, q = _matrix(own.column("vector")), _matrix(of.column("vector"))
        reps, ids, lx = own.column("rep").to_numpy(), of.column("query_id").to_numpy(), own.column("cell").to_numpy()
        cells = of.column("cells").to_pylist()
        lq, who = np.array([c for cs in cells for c in cs], np.int64), np.repeat(np.arange(len(cells)), [len(cs) for cs in cells])
        ox, oq = np.argsort(lx, kind="stable"), np.argsort(lq, kind="stable")
        out_q, out_r, out_s = [ids[:0]], [reps[:0]], [np.zeros(0)]
        for cell in np.intersect1d(lx, lq):
            i = ox[np.searchsorted(lx[ox], cell):np.searchsorted(lx[ox], cell, "right")]
            j = who[oq[np.searchsorted(lq[oq], cell):np.searchsorted(lq[oq], cell, "right")]]
            for at in range(0, len(j), 256):
                some = j[at:at + 256]
                r, c, score = best_rows(q[some], x[i], reps[i], k + 1)
                out_q.append(ids[some][r])
                out_r.append(reps[i][c])
                out_s.append(score)
        a, b, s = np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        a, b, s = a[new], b[new], s[new]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = rank <= k
        return pa.table([a[keep], b[keep], s[keep]], schema=schema)

    met = members.groupBy("deal").cogroup(asked.groupBy("deal")).applyInArrow(meet, "query_id long, rep long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    met = met.withColumn("c", F.row_number().over(best)).filter(F.col("c") <= k + 1)
    met = met.join(classes.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % EVERY == 0)
