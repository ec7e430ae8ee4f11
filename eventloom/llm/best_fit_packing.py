"""Bulk-synchronous best-fit: documents packed into sequences of a bounded number of tokens.

Pieces as long as a sequence are one. All others go through rounds. In a round, unplaced pieces and the gaps of open
sequences are sorted together by size, in ranges of about BUCKET rows (a size with more rows than that has several ranges).
Each range is swept from the largest size down: gaps are stacked and a piece takes the last one, which is the smallest that
it fits in, its successor; so pieces that want the same gap get, by their rank, it and those before it. What a range can't
match meets across ranges: the ranges' numbers of unmatched pieces and gaps say which runs of pieces get which runs of gaps,
and these are joined. A gap takes one piece a round and is smaller after it. When no piece fits in any gap, as many new
sequences are opened as the rest needs at least, and rounds go on; a rest with many pieces to a sequence is swept in bundles
of like pieces first, which are taken apart when none fits any more. Rounds over a single range need no exchange and are
repeated inside its task, with the same outcome.

The driver sees the number of rows of each size (at most the capacity) and two numbers a range.

Defined cases: null and empty texts are packed by their end id; repeated rows are packed each; ties go by key; an empty
table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import table, written
from eventloom.llm.token_pieces import CAPACITY, pieces, vocabulary_path

#: Rows in a range, about.
BUCKET = 1 << 14
#: Pieces to a new sequence from which on bundles are made, and the part of a sequence that a bundle fills at most.
BUNDLE_FROM, BUNDLE_PART = 6, 4
#: What a row of the rounds is: an unplaced piece or bundle, an open sequence, or a piece with its place.
ITEM, GAP, PLACED = 0, 1, 2
STATE = "kind int, id long, size long, members array<struct<key:long,size:long>>, sequence_id long, offset long"
LOCAL = f"{STATE}, bucket int, rank long"


def matched(size: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One sweep over rows that are sorted by falling size, gaps before pieces of their size.

    Places of the matched gaps and of their pieces, of the unmatched pieces in order, and of the unmatched gaps, last first.
    """
    open_gaps = np.cumsum(np.where(is_gap, 1, -1))
    lowest = np.minimum(np.minimum.accumulate(open_gaps), 0)
    alone = ~is_gap & (open_gaps < np.append(0, lowest[:-1]))
    level = open_gaps - lowest + ~is_gap  # a piece and its gap have the same; on a level they take turns
    place = np.flatnonzero(~alone)
    place = place[np.argsort(level[place], kind="stable")]
    pair = np.flatnonzero(is_gap[place[:-1]] & ~is_gap[place[1:]] & (level[place[:-1]] == level[place[1:]]))
    gaps, found = place[pair], place[pair + 1]
    rest = is_gap.copy()
    rest[gaps] = False
    return gaps, found, np.flatnonzero(alone), np.flatnonzero(rest)[::-1]


def order_of(kind: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, kind != GAP, -size))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _state(kind, ids, size, members, sequence, offset) -> dict:
    n = len(ids)
    return {"kind": pa.array(np.full(n, kind, np.int32)), "id": pa.array(ids), "size": pa.array(size), "members": members,
            "sequence_id": pa.array(sequence), "offset": pa.array(offset)}


def swept(t: pa.Table, capacity: int, bucket: int, repeat: bool, keep_gaps: bool) -> pa.Table:
    """One sweep over the items and gaps of a range, or sweeps until none fits; the rows after it, with ranks of what has no match.

    keep_gaps: gaps smaller than any item here are kept, for the pieces of bundles.
    """
    kind, size, ids = _column(t, "kind"), _column(t, "size").copy(), _column(t, "id")
    members, placed = t.column("members"), []
    live = order_of(kind, size, ids)
    while True:
        gaps, found, alone, rest = (live[x] for x in matched(size[live], kind[live] == GAP))
        placed.append(_state(PLACED, ids[found], size[found], members.take(pa.array(found)), ids[gaps], capacity - size[gaps]))
        size[gaps] -= size[found]
        if not repeat or not len(found) or not len(alone):
            break
        live = np.concatenate([alone, gaps, rest])
        live = live[(kind[live] != GAP) | (size[live] >= (1 if keep_gaps else size[alone].min()))]
        live = live[order_of(kind[live], size[live], ids[live])]
    none = np.full(len(t), -1)
    parts = placed + [_state(k, ids[x], size[x], members.take(pa.array(x)), none[:len(x)], none[:len(x)]) for k, x in ((ITEM, alone), (GAP, rest), (GAP, gaps))]
    rank = np.concatenate([*(none[:len(p["id"])] for p in placed), np.arange(len(alone)), np.arange(len(rest)), none[:len(gaps)]])
    columns = {c: pa.chunked_array([p[c].combine_chunks() if isinstance(p[c], pa.ChunkedArray) else p[c] for p in parts]) for c in parts[0]}
    return pa.table({**columns, "bucket": pa.array(np.full(len(rank), bucket, np.int32)), "rank": pa.array(rank)})


def bundled(t: pa.Table, most: int, bucket: int) -> pa.Table:
    """Like pieces of a range in bundles of up to ``most`` tokens; pieces above half of that stay alone."""
    size, ids = _column(t, "size"), _column(t, "id")
    live = np.lexsort((ids, -size))
    alone, small = live[size[live] > most // 2], live[size[live] <= most // 2]
    # the sizes of a bundle end in one window of a width that leaves room for the first, so they add up to most at the most
    bundle = (np.cumsum(size[small]) - 1) // max(1, most - int(size[small].max(initial=0)))
    first = np.flatnonzero(np.append(True, bundle[1:] != bundle[:-1])) if len(small) else np.zeros(0, np.int64)
    order = np.concatenate([alone, small])
    begin = np.concatenate([np.arange(len(alone)), len(alone) + first])
    keys = t.column("members").combine_chunks().flatten()  # of single pieces: one each
    members = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), keys.take(pa.array(order)))
    none = np.full(len(begin), -1)
    out = _state(ITEM, ids[order[begin]], np.add.reduceat(size[order], begin) if len(begin) else size[:0], members, none, none)
    return pa.table({**out, "bucket": pa.array(np.full(len(begin), bucket, np.int32)), "rank": pa.array(none)})


def ranges(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(size, its first range, how many it has), from the rows of each size, largest size first."""
    out, at, held = [], 0, 0
    for size, n in sorted(sizes, reverse=True):
        if held and held + n > most:
            at, held = at + 1, 0
        parts = -(-n // most)
        out.append((size, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


def across(unmatched: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which pieces get gaps of ranges before theirs: (range, first rank, range of the gaps, first rank there, how many).

    unmatched: (range, pieces, gaps) in order of the ranges. The last gap of a stack is its rank 0.
    """
    stack, out = [], []
    for bucket, items, gaps in unmatched:
        at = 0
        while at < items and stack:
            of, first, left = stack.pop()
            n = min(left, items - at)
            out.append((bucket, at, of, first, n))
            at += n
            if left > n:
                stack.append((of, first + n, left - n))
        if gaps:
            stack.append((bucket, 0, gaps))
    return out


def in_ranges(state: DataFrame, found: list[tuple[int, int, int]], seed: int) -> DataFrame:
    """state with its range; the table of ranges has a row a size, so its size is bounded by the capacity."""
    sizes = state.sparkSession.createDataFrame(found, "size long, first int, parts int")
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).cast("int")
    return state.join(F.broadcast(sizes), "size").withColumn("bucket", F.col("first") + part).drop("first", "parts")


def sweep(state: DataFrame, sizes: list[tuple[int, int]], capacity: int, seed: int, most: int, keep_gaps: bool) -> DataFrame:
    """The state after one round (after all rounds that need no exchange, where one range holds all)."""
    found = ranges(sizes, most)
    single = len(found) > 0 and found[-1][1] + found[-1][2] == 1
    local = in_ranges(state, found, seed).groupBy("bucket").applyInArrow(lambda key, t: swept(t, capacity, key[0].as_py(), single, keep_gaps), LOCAL)
    columns = state.columns
    if single:
        return written(local.select(columns), "packing_round")
    local = written(local, "packing_sweep")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    left = local.filter("rank >= 0").groupBy("bucket").agg(count(ITEM), count(GAP)).orderBy("bucket")
    runs = across([tuple(r) for r in left.toLocalIterator()])
    if not runs:
        return local.select(columns)
    spark = state.sparkSession
    runs = F.broadcast(spark.createDataFrame(runs, "bucket int, low long, of int, first long, n long"))  # two runs a range at most
    inside = (F.col("i.bucket") == F.col("r.bucket")) & (F.col("i.rank") >= F.col("r.low")) & (F.col("i.rank") < F.col("r.low") + F.col("r.n"))
    items = local.filter(F.col("kind") == ITEM).alias("i").join(runs.alias("r"), inside, "left")
    items = items.select("i.id", "i.size", "i.members", "r.of", (F.col("r.first") + F.col("i.rank") - F.col("r.low")).alias("at"))
    gaps = local.filter((F.col("kind") == GAP) & (F.col("rank") >= 0)).select(F.col("id").alias("gap_id"), F.col("size").alias("gap"), F.col("bucket").alias("of"), F.col("rank").alias("at"))
    pairs = written(gaps.join(items.filter("of is not null"), ["of", "at"], "left"), "packing_pairs")
    none = F.lit(-1).cast("long")
    item = lambda kind, sequence, offset: (F.lit(kind).alias("kind"), "id", "size", "members", sequence.alias("sequence_id"), offset.alias("offset"))
    empty = F.array().cast("array<struct<key:long,size:long>>")
    return (
        local.filter((F.col("kind") == PLACED) | (F.col("kind") == GAP) & (F.col("rank") < 0)).select(columns)
        .unionByName(pairs.filter("id is not null").select(*item(PLACED, F.col("gap_id"), capacity - F.col("gap"))))
        .unionByName(items.filter("of is null").select(*item(ITEM, none, none)))
        .unionByName(pairs.select(F.lit(GAP).alias("kind"), F.col("gap_id").alias("id"), (F.col("gap") - F.when(F.col("id").isNotNull(), F.col("size")).otherwise(0)).alias("size"), empty.alias("members"), none.alias("sequence_id"), none.alias("offset")))
    )


def pack(lengths: DataFrame, capacity: int = CAPACITY, *, bucket: int = BUCKET, bundle_from: int = BUNDLE_FROM) -> DataFrame:
    """key, sequence_id, offset for rows (key, length) with different keys of 0 or more and lengths from 1 to the capacity."""
    spark = lengths.sparkSession
    none, empty = F.lit(-1).cast("long"), F.array().cast("array<struct<key:long,size:long>>")
    full = lengths.filter(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    member = F.struct("key", F.col("length").alias("size"))
    state = lengths.filter(F.col("length") < capacity).select(
        F.lit(ITEM).alias("kind"), F.col("key").alias("id"), F.col("length").alias("size"), F.array(member).alias("members"), none.alias("sequence_id"), none.alias("offset"))
    done, opened, in_bundles, seed = [], 0, False, 0
    while True:
        seed += 1
        live = state.filter(F.col("kind") != PLACED)
        counts = [tuple(r) for r in live.groupBy("kind", "size").count().toLocalIterator()]
        if seed > 1:
            done.append(state.filter(F.col("kind") == PLACED))
        items = {size: n for kind, size, n in counts if kind == ITEM}
        if not items:
            break
        open_gaps = {size: n for kind, size, n in counts if kind == GAP and size >= (1 if in_bundles else min(items))}
        gaps = open_gaps if max(open_gaps, default=0) >= min(items) else {}
        live = live.filter((F.col("kind") == ITEM) | (F.col("size") >= (1 if in_bundles else min(items))))
        if not gaps and in_bundles:
            single = live.select(F.explode("members").alias("m"))
            state = written(single.select(F.lit(ITEM).alias("kind"), F.col("m.key").alias("id"), F.col("m.size").alias("size"), F.array("m").alias("members"), none.alias("sequence_id"), none.alias("offset"))
                            .unionByName(state.filter(F.col("kind") == GAP)), "packing_singles")
            in_bundles = False
            continue
        if not gaps:
            new = max(-(-sum(size * n for size, n in items.items()) // capacity), sum(n for size, n in items.items() if 2 * size > capacity))
            n_items = sum(items.values())
            if n_items > bundle_from * new and n_items > bucket:
                found, most = ranges(list(items.items()), bucket), capacity // BUNDLE_PART
                live = written(in_ranges(live, found, seed).groupBy("bucket").applyInArrow(lambda key, t: bundled(t, most, key[0].as_py()), LOCAL).select(state.columns), "packing_bundles")
                items, in_bundles = dict(tuple(r) for r in live.groupBy("size").count().toLocalIterator()), True
            fresh = spark.range(opened, opened + new).select(F.lit(GAP).alias("kind"), "id", F.lit(capacity).cast("long").alias("size"), empty.alias("members"), none.alias("sequence_id"), none.alias("offset"))
            opened, gaps, live = opened + new, {capacity: new}, live.unionByName(fresh)
        sizes = {size: items.get(size, 0) + gaps.get(size, 0) for size in {*items, *gaps}}
        state = sweep(live, list(sizes.items()), capacity, seed, bucket, in_bundles)
    for part in done:
        ends = F.transform("members", lambda m: m["size"])
        before = F.transform("members", lambda m, i: F.aggregate(F.slice(ends, 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
        at = part.select("sequence_id", "offset", F.explode(F.arrays_zip(F.col("members.key").alias("key"), before.alias("before"))).alias("m"))
        full = full.unionByName(at.select("m.key", "sequence_id", (F.col("offset") + F.col("m.before")).alias("offset")))
    return full


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, and its pieces in order (doc_id, piece, offset, ids), from pieces with ids and places."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("pieces"))


def packed_pieces(docs: DataFrame, file: str, *, carry: list[str] = ("doc_id",), capacity: int = CAPACITY, with_ids: bool = True, bucket: int = BUCKET) -> DataFrame:
    """The carried columns with piece, start, length, ids_crc32, ids, sequence_id and offset."""
    cut = written(pieces(docs, file, carry=carry, capacity=capacity, with_ids=with_ids), "packing_pieces")
    return cut.join(pack(cut.select("key", "length"), capacity, bucket=bucket), "key").drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False).withColumn("piece", F.col("piece").cast("int"))
