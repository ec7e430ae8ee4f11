"""Near-duplicate documents by 64-bit similarity fingerprints and pivot distance tables.

A fingerprint bit is set if more than half of the shingle hashes of a text have it. Equal fingerprints are one class.
Different classes meet in cells: of B equal parts of the 64 bits, two fingerprints at distance d or less share at least
B - d, so every choice of B - d parts makes one cell key, and no pair is missed. Within a cell, each fingerprint carries
its distances to PIVOTS reference fingerprints. By the triangle inequality, a pair whose table rows differ by more than d
anywhere is farther apart than d and is discarded; the rest are verified bit by bit. A cell gives the links of a spanning
star of each of its groups, not all pairs. Components of the links give the result.

Cells with more members than TILE are cut into tiles that meet two by two in groups of their own, so no group grows with
the corpus.

Defined cases: a text without words (null and empty ones too) has fingerprint zero and links like any other; a text with
fewer words than a shingle is one shingle; repeated rows and equal ids are rows of their own; a null doc_id takes part
and counts after all others (component_id is null if a component has no other id); an empty table gives an empty result;
extra columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.blocks import U64, mixed
from eventloom.llm.common import table, written
from eventloom.llm.components import connected

SHINGLE, SEED, DISTANCE = 4, 42, 4
PIVOTS, TILE = 24, 2048
_SHIFTS = np.arange(63, -1, -1, dtype=U64)


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= n:
        return hash_(b" ".join(words), SEED)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-n].tolist()]
    view = memoryview(joined)
    h = np.fromiter((hash_(view[a:z], SEED) for a, z in zip(starts, (ends[n - 1:] - 1).tolist())), U64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):  # big-endian bytes, so bit 0 of the row is the highest
        ones += np.unpackbits(h[k:k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(U64) << _SHIFTS).sum(dtype=U64))


def fingerprints(text: str) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        values = [fingerprint(t if isinstance(t, str) else None) for t in texts]
        yield pd.Series(np.array(values, U64).view(np.int64))


def parts_for(n: int, distance: int) -> int:
    """Number of parts whose cells hold about one of n evenly spread fingerprints."""
    parts = distance + 2
    while 64 * (parts - distance) // parts < np.log2(max(n, 2)) and parts < 16:
        parts += 1
    return parts


def cells(parts: int, distance: int) -> list[int]:
    """The bit masks of all choices of parts - distance parts."""
    edge = [64 * i // parts for i in range(parts + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(parts)]
    return [sum(part[i] for i in c) for c in itertools.combinations(range(parts), parts - distance)]


def pivot_table(fp: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Distances of each fingerprint to the reference fingerprints, which are the same for every corpus."""
    reference = mixed(np.arange(1, pivots + 1, dtype=U64))
    return np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)


def links_within(fp: np.ndarray, group: np.ndarray, other: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning star of each component among the fingerprints of each group.

    other: false for the members of a tile that meet those of another, true for these; where a group holds both kinds,
    only pairs of different kinds are looked at.
    """
    order = np.lexsort((fp, group))
    fp, group, other = fp[order], group[order], other[order]
    near = pivot_table(fp)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(begin, len(group)))
    pairs_a, pairs_b = [], []
    for size in np.unique(sizes[sizes > 1]).tolist():
        starts = begin[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(starts), step):
            a = (starts[k:k + step, None] + i[None, :]).ravel()
            b = (starts[k:k + step, None] + j[None, :]).ravel()
            mixed_kinds = np.repeat(np.add.reduceat(other.astype(np.int64), begin)[sizes == size][k:k + step] % size > 0, len(i))
            ok = ~mixed_kinds | (other[a] != other[b])
            a, b = a[ok], b[ok]
            for p in range(0, PIVOTS, 4):  # discard by the tables, four pivots at a time
                ok = np.abs(near[a, p:p + 4] - near[b, p:p + 4]).max(axis=1) <= distance
                a, b = a[ok], b[ok]
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            pairs_a.append(a[ok])
            pairs_b.append(b[ok])
    if not pairs_a:
        return []
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    signed = fp.view(np.int64)
    root = np.arange(len(fp))
    while True:  # smallest place reachable, within this group's links
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    members = np.flatnonzero(root != np.arange(len(fp)))
    return list(zip(signed[members].tolist(), signed[root[members]].tolist()))


def links(distinct: DataFrame, n: int, *, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b) links between the distinct fingerprints fp, enough to connect all that distance or less joins."""
    masks = cells(parts_for(n, distance), distance)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    member = distinct.select("fp", F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("way", "mask"))
    member = member.select("fp", "way", F.col("fp").bitwiseAND(F.col("mask")).alias("cell"))
    counts = member.groupBy("way", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    big = counts.filter(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / (tile // 2)).cast("int"))
    # the many small cells: dealt out by a hash of the cell, whole cells together
    spread = max(8, -(-n * len(masks) // 100_000))
    small = member.join(counts.filter(F.col("n") <= tile).select("way", "cell"), ["way", "cell"])
    small = small.select("fp", F.xxhash64("way", "cell").alias("group"), F.lit(False).alias("other"))
    # the few big ones: each member goes to the meetings of its tile with every tile
    large = member.join(big.select("way", "cell", "tiles"), ["way", "cell"])
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    large = large.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    large = large.select("fp", F.xxhash64("way", "cell", F.least("own", "with"), F.greatest("own", "with")).alias("group"), (F.col("own") > F.col("with")).alias("other"))

    def within(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        found = links_within(t.column("fp").to_numpy().view(U64), t.column("group").to_numpy(), t.column("other").to_numpy(zero_copy_only=False), distance)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    dealt = lambda rows, k: rows.withColumn("deal", F.pmod("group", F.lit(k))).groupBy("deal").applyInArrow(
        lambda t: within(t), "a long, b long")
    return dealt(small, spread).unionByName(dealt(large, 1 << 20)).distinct()


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, carry: list[str] = ()) -> DataFrame:
    """doc_id, fp, component_id for every row; carry: further columns, in a struct ``row``."""
    kept = [F.struct(*carry).alias("row")] if carry else []
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints("text").alias("fp"), *kept)
    ids = written(marked.select("doc_id", "fp"), "fingerprints")
    distinct = written(ids.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected(links(distinct, distinct.count(), distance=distance))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    found = classes.join(component, "root").select("fp", "component_id")
    return (marked if carry else ids).join(found, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
