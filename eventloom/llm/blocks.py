"""Exchange between blocks of documents and buckets of keys.

Operators that need corpus-wide facts about very many small keys (windows, words, byte contexts) work in two kinds of
group. A block holds documents of about a fixed number of bytes, dealt out by a hash of id and text. A bucket holds the keys
that share a hash remainder. A block sends each bucket its distinct keys, packed as one binary value, so a key costs a few
bytes rather than a row, and a key that many documents share costs one entry a block. A bucket answers each block in the
same way. Blocks and buckets keep their size as the corpus grows; only their number grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the rolling hashes; any odd values do.
MULTIPLIERS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def in_blocks(docs: DataFrame, n_blocks: int, *columns) -> DataFrame:
    """The given columns with ``block``, dealt out by block. Every user of the result shares one exchange.

    Blocks go by id and text, so that many rows of one id, or of none, don't share one.
    """
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    return docs.select(block.alias("block"), *columns).repartition(n_blocks, "block")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pack(x: np.ndarray) -> bytes:
    """Byte planes: the high bytes of near values are runs, which the shuffle's compression makes small."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpack(raw: bytes, kind=U64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted values by their differences."""
    return pack(np.diff(x, prepend=U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=U64)


def powers(r: U64, n: int) -> np.ndarray:
    out = np.full(n, r, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a run of texts, as places in one buffer of bytes.

    start, end: of each word in ``data``; doc: the number of the text that it is in; first: of each text, its first word
    (one more entry than texts).
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        data = self.data = np.frombuffer(joined, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, then mixed with its length."""
        r, value, data = MULTIPLIERS[which], mixed(np.arange(256, dtype=U64) + U64(1 + which)), self.data
        p = powers(r, 1 + int((self.end - self.start).max(initial=0)))
        out = np.zeros(len(self.start), U64)
        # words are short: one step for each letter, over all words that are as long
        live = np.arange(len(self.start))
        size = self.end - self.start
        k = 0
        while len(live):
            if k == 64 and len(live):  # the few very long ones, one by one
                for i in live:
                    out[i] += (value[data[self.start[i] + k:self.end[i]]] * p[k:size[i]]).sum(dtype=U64)
                break
            out[live] += value[data[self.start[live] + k]] * p[k]
            k += 1
            live = live[size[live] > k]
        return mixed(out ^ size.astype(U64))


def windows(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each n values in a row, from each start (len(h) - n + 1 of them).

    A polynomial in the values. Runs of a and b values join as first * r^b + second, so doubling reaches n in few passes.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    p = powers(MULTIPLIERS[1 - which], n + 1)
    run, size, out, done = h, 1, None, 0
    while True:
        if n & size:  # the runs that make up n, shortest first
            out = run if out is None else out[:len(h) - done - size + 1] * p[size] + run[done:]
            done += size
        if done == n:
            return mixed(out[:m])
        run = run[:-size] * p[size] + run[size:]
        size *= 2


def whole_windows(words: Words, n: int) -> np.ndarray:
    """Whether the n words from each start are of one text."""
    m = len(words) - n + 1
    return words.doc[:m] == words.doc[n - 1:] if m > 0 else np.zeros(0, bool)


def split_by_bucket(keys: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket that has keys, with the places of its keys in order of key."""
    bucket = bucket_of(keys, n_buckets)
    order = np.lexsort((keys, bucket))
    found, begin = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, begin[1:]))) if len(keys) else []


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((mixed(keys) >> U64(40)) % U64(n_buckets)).astype(np.int64)


def texts_of(table: pa.Table, name: str = "text") -> list[bytes]:
    """The texts' bytes; null is empty."""
    return [x or b"" for x in table.column(name).cast(pa.binary()).to_pylist()]
