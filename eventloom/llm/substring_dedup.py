"""Removal of repeated passages by level-wise doubling.

Windows of a base length that occur once in the corpus cannot be part of a longer repeat. Those that repeat are extended
to twice the length, and so on until the wanted window length is reached or no candidate is left. At that length, the
first occurrence (smallest doc_id, then smallest start) of each word sequence stays, and every word that another
occurrence covers is removed.

Blocks of documents send the distinct window hashes of each level to buckets of hashes and get back those that other
blocks hold as well (see blocks.py), so a passage that many documents share costs one entry a block. Lower levels use 48
bits of hash, where a collision only costs work; the last level compares 96 bits.

Defined cases: null or empty texts have no words and stay as they are; a null doc_id counts as the largest id; rows that
share a doc_id count as one document, whose windows at equal starts are one occurrence, so exact repeated rows get the
same result; texts shorter than a window lose nothing; extra columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eventloom.llm.blocks import U64, Words, in_blocks, pack, pack_sorted, split_by_bucket, texts_of, unpack, unpack_sorted, whole_windows, windows
from eventloom.llm.common import block_count, table

WINDOW, BASE, BLOCK_BYTES = 20, 10, 4 << 20
LAST_ID = np.iinfo(np.int64).max
KEYS = "block int, bucket int, h binary, g binary, at binary"


def levels(window: int, base: int) -> list[int]:
    """base, twice base, ... and the window itself at the end."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def short(h: np.ndarray) -> np.ndarray:
    """The hash of the lower levels."""
    return h >> U64(16)


class Block:
    """The words of a block's documents in order of doc_id, with the document order of each word."""

    def __init__(self, t: pa.Table):
        ids = np.array([LAST_ID if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)
        self.order = np.argsort(ids, kind="stable")
        texts = texts_of(t)
        self.ids = ids[self.order]
        self.words = Words([texts[i] for i in self.order])
        self.h = self.words.hashes(0)

    @functools.cached_property
    def g(self) -> np.ndarray:
        """The second hash of each word, which the last level alone compares."""
        return self.words.hashes(1)

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the whole windows of n words, and their hashes."""
        at = np.flatnonzero(whole_windows(self.words, n))
        return at, windows(self.h, n, 0)[at]

    def candidates(self, n: int, before: int, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows of n words whose two halves of ``before`` words repeat; repeated: hashes that other blocks hold."""
        at, h = self.level(before)
        h = short(h)
        order = np.argsort(h, kind="stable")
        s = h[order]
        twin = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        hit = np.zeros(len(self.words) + 1, bool)
        hit[at[order[twin]]] = True
        if len(repeated):
            r = np.sort(repeated)
            hit[at[order[r[np.minimum(np.searchsorted(r, s), len(r) - 1)] == s]]] = True
        at, _ = self.level(n)
        return at[hit[at] & hit[at + n - before]]

    def places(self, at: np.ndarray) -> np.ndarray:
        """doc_id and start within the document of each word."""
        doc = self.words.doc[at]
        return np.column_stack([self.ids[doc], at - self.words.first[doc]])


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (quicker here than hashing)."""
    s = np.sort(x)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new]


def _sent(block: int, n_buckets: int, h: np.ndarray, g: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.Table:
    rows = {"block": [], "bucket": [], "h": [], "g": [], "at": []}
    for b, part in split_by_bucket(h, n_buckets):
        rows["block"].append(block)
        rows["bucket"].append(b)
        rows["h"].append(pack_sorted(h[part]))
        rows["g"].append(None if g is None else pack(g[part]))
        rows["at"].append(None if places is None else pack(places[part].T.ravel()))
    return pa.table(rows, schema=pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("at", pa.binary())]))


def _replies(t: pa.Table) -> np.ndarray:
    parts = [unpack_sorted(x) for x in t.column("h").to_pylist()] if t.num_rows else []
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def _first_of(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first equal (h, g) for each entry, and the indices that are such firsts."""
    order = np.lexsort((g, h))  # stable: the first of equals stays first
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order
    out = np.empty(len(h), np.int64)
    out[order] = first
    return out, np.sort(order[new])


def removed_spans(docs: DataFrame, n_blocks: int, *, window: int = WINDOW, base: int = BASE, finish, schema: str, columns=("doc_id", "text")) -> DataFrame:
    """Applies finish(table, mask by row of removed words, Words) to each block; returns its rows."""
    steps, n_buckets = levels(window, base), max(8, n_blocks)
    rows = in_blocks(docs, n_blocks, *columns)

    def start(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        return _sent(block, n_buckets, _distinct(short(Block(t).level(steps[0])[1])))

    def last(b: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return windows(b.h, window, 0)[at], (windows(b.g, window, 1)[at] >> U64(32)).astype(np.uint32)

    def firsts(block: int, b: Block, at: np.ndarray) -> pa.Table:
        h, g = last(b, at)
        _, first = _first_of(h, g)
        return _sent(block, n_buckets, h[first], g[first], b.places(at[first]))

    def extend(k: int):
        def step(t: pa.Table, replies: pa.Table) -> pa.Table:
            if not t.num_rows:
                return _sent(0, n_buckets, np.zeros(0, U64))
            block, b = t.column("block")[0].as_py(), Block(t)
            at = b.candidates(steps[k], steps[k - 1], _replies(replies))
            if k == len(steps) - 1:
                return firsts(block, b, at)
            return _sent(block, n_buckets, _distinct(short(windows(b.h, steps[k], 0)[at])))

        return step

    def shared(t: pa.Table) -> pa.Table:
        """Hashes that more than one block holds, back to each of these."""
        blocks, parts = t.column("block").to_pylist(), [unpack_sorted(x) for x in t.column("h").to_pylist()]
        found, times = np.unique(np.concatenate(parts), return_counts=True)
        found = found[times > 1]
        kept = [p[np.isin(p, found, assume_unique=True)] for p in parts]
        return pa.table({"block": pa.array(blocks, pa.int32()), "h": pa.array([pack_sorted(k) for k in kept], pa.binary()), "g": pa.nulls(len(kept), pa.binary())})

    def earlier(t: pa.Table) -> pa.Table:
        """Of each block, the word sequences whose first occurrence is in another block."""
        blocks, raw = t.column("block").to_pylist(), [t.column(c).to_pylist() for c in ("h", "g", "at")]
        each = [unpack_sorted(x) for x in raw[0]]
        h, g = np.concatenate(each), np.concatenate([unpack(x, np.uint32) for x in raw[1]])
        at = np.concatenate([unpack(x, np.int64).reshape(2, -1).T for x in raw[2]])
        owner = np.repeat(np.arange(len(blocks)), [len(x) for x in each])
        order = np.lexsort((at[:, 1], at[:, 0], g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        # rows of one id in several blocks may hold a sequence at the same place, which is one occurrence
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = np.zeros(len(h), bool)
        late[order[(at[order] != at[first]).any(axis=1)]] = True
        parts = np.split(np.flatnonzero(late), np.searchsorted(owner[late], np.arange(1, len(blocks))))
        return pa.table({"block": pa.array(blocks, pa.int32()), "h": pa.array([pack_sorted(h[p]) for p in parts], pa.binary()), "g": pa.array([pack(g[p]) for p in parts], pa.binary())})

    def end(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return finish(t, None, None)
        b = Block(t)
        at, _ = b.level(window)
        h, g = last(b, at)
        first, _ = _first_of(h, g)
        places = b.places(at)
        # at its own first place (rows of one id may hold it twice at one start), or in a block that is not the first
        late = (places != places[first]).any(axis=1)
        gone = pd.MultiIndex.from_arrays([_replies(replies), _second(replies)])
        if len(gone):
            late |= np.isin(h, gone.get_level_values(0)) & pd.MultiIndex.from_arrays([h, g]).isin(gone)
        covered = np.zeros(len(b.words) + 1, np.int64)
        np.add.at(covered, at[late], 1)
        np.add.at(covered, at[late] + window, -1)
        return finish(t.take(pa.array(b.order)), np.cumsum(covered)[:-1] > 0, b.words)

    reply = "block int, h binary, g binary"
    sent = rows.groupBy("block").applyInArrow(start, KEYS)
    for k in range(1, len(steps)):
        back = sent.groupBy("bucket").applyInArrow(shared, reply)
        sent = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(extend(k), KEYS)
    if len(steps) == 1:  # no level below the window itself: all of its windows are candidates
        sent = rows.groupBy("block").applyInArrow(lambda t: (lambda b: firsts(t.column("block")[0].as_py(), b, b.level(window)[0]))(Block(t)), KEYS)
    back = sent.groupBy("bucket").applyInArrow(earlier, reply)
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(end, schema)


def _second(t: pa.Table) -> np.ndarray:
    parts = [unpack(x, np.uint32) for x in t.column("g").to_pylist()] if t.num_rows else []
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _kept_texts(mask: np.ndarray, words: Words) -> list[tuple[int, int, bytes]]:
    """Of each text: words, removed words, kept words joined by one space."""
    raw, out = words.data.tobytes(), []
    for i in range(len(words.first) - 1):
        a, z = words.first[i], words.first[i + 1]
        gone = mask[a:z]
        own = raw[words.start[a]:words.end[z - 1]].split() if z > a else []  # the six ASCII spaces
        n = int(gone.sum())
        out.append((int(z - a), n, b" ".join(itertools.compress(own, (~gone).tolist()) if n else own)))
    return out


def dedup(docs: DataFrame, *, window: int = WINDOW, base: int = BASE, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text."""

    def finish(t: pa.Table, mask, words) -> pa.Table:
        done = _kept_texts(mask, words) if t.num_rows else []
        cols = {
            "doc_id": t.column("doc_id") if t.num_rows else pa.array([], pa.int64()),
            "n_words": pa.array([d[0] for d in done], pa.int64()), "n_removed": pa.array([d[1] for d in done], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string()),
        }
        if with_text:
            cols["kept_text"] = pa.array([d[2].decode("utf-8", "replace") for d in done], pa.string())
        return pa.table(cols)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return removed_spans(docs, block_count(docs, block_bytes), window=window, base=base, finish=finish, schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_text=False)


#: The same by plain SQL: every window of 20 words, and for each word sequence the first place.
ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE n > 1),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([x FOR x, j IN w IF NOT list_contains(coalesce(gone, []::BIGINT[]), j)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, with the kept words as text where any word was removed (else the text unchanged).

    n_chars, where there is one, follows the text. A document of which nothing is left goes.
    """
    own = docs.columns
    carried = [c for c in own if c not in ("doc_id", "text")]

    def finish(t: pa.Table, mask, words) -> pa.Table:
        rest = {"rest": t.column("rest")} if carried else {}
        if not t.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "n_removed": pa.array([], pa.int64()), **rest})
        done, texts = _kept_texts(mask, words), t.column("text").to_pylist()
        text = [d[2].decode("utf-8", "replace") if d[1] else x for d, x in zip(done, texts)]
        return pa.table({"doc_id": t.column("doc_id"), "text": pa.array(text, pa.string()), "n_removed": pa.array([d[1] for d in done], pa.int64()), **rest})

    # the other columns travel as they are, in a struct, so that their names don't matter here
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*carried).alias("rest")] if carried else []))
    kind = packed.schema
    schema = StructType([*kind.fields[:2], StructField("n_removed", LongType()), *kind.fields[2:]])
    out = removed_spans(packed, block_count(docs, BLOCK_BYTES), finish=finish, schema=schema, columns=packed.columns)
    out = out.filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    n_chars = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars"))} if "n_chars" in carried else {}
    pick = lambda c: F.col(c) if c in ("doc_id", "text") else n_chars[c].cast(docs.schema[c].dataType).alias(c) if c in n_chars else F.col("rest")[c].alias(c)
    return out.select(*[pick(c) for c in own])
