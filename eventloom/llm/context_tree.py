"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; the node of a decision within the byte, together with the last d bytes, is a context
of depth d, for every d from 0 to DEPTH. Each context estimates its decision by Krichevsky and Trofimov's rule from its
counts. The weighted tree gives every context the weight of its own estimate against those of the deeper contexts below
it, from the training counts alone; a decision is predicted by the mixture along its path, as deep as the training text
goes. The logarithm of a text's probability is the sum over its bytes (with an end byte), which per byte is its code length.

The counts are of all training rows, and so the tree grows with the corpus; nothing of it is sent to the driver. Blocks of documents send the distinct byte
sequences they hold to buckets that share the last SUFFIX bytes of context (see blocks.py); a bucket holds the part of
the tree below these and answers with a logarithm for each sequence. The words' counts for the plain word model travel
likewise, by a 64-bit hash of the word (two of 10 million words share one with a chance of 3e-6).

Defined cases: a null text counts as empty; an empty text is scored by its end alone; a null doc_id is held out or not by
the crc32 of the empty text; repeated rows count and score each for itself; without training rows every decision is even,
c, N and V are zero and base_score is -log10 of an even token for each; extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.blocks import U64, Words, in_blocks, pack, pack_sorted, split_by_bucket, texts_of, unpack, unpack_sorted
from eventloom.llm.common import block_count, remainder, table, written

#: Bytes of context (five at most: a sequence is a number of 48 bits), bytes of context that a bucket shares, bytes of text in a block, and the byte that ends a text.
DEPTH, SUFFIX, BLOCK_BYTES, END = 5, 3, 16 << 20, 0
#: Buckets for each block: a bucket's tree takes several times the room of its sequences.
BUCKETS = 4
HELD_OUT = 1
NODES = "ctx long, node int, a double, b double, lw double"
_SENT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
#: Bytes of text and sequences that are worked on at once.
_STEP, _KEYS = 2 << 20, 1 << 18


def _mask(n_bytes: int) -> U64:
    return U64((1 << (8 * n_bytes)) - 1)


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each text and its end: the depth bytes before it (zeros before the start) and itself, as one number."""
    pad = bytes(depth)
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    n = len(data) - depth
    out = np.zeros(n, U64)
    for k in range(depth + 1):
        out <<= U64(8)
        out |= data[k:k + n]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + depth)
    keep = np.ones(n, bool)
    for k in range(depth):  # the places where the next text's padding is predicted
        gone = ends - depth + k
        keep[gone[gone < n]] = False
    return out[keep]


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the estimator's probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - 2 * _log_gamma(np.array([0.5]))[0] - _log_gamma(a + b + 1.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, from x + 8 on."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def decision(keys: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The j-th decision of each key's last byte: the context joined with the node (1 to 255) in the byte's place, and the bit taken."""
    byte = (keys & U64(255)).astype(np.int64)
    return keys >> U64(8) << U64(8) | ((1 << j) | (byte >> (8 - j))).astype(U64), (byte >> (7 - j)) & 1


def _runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the weighted probability of a node, and the weight of its own estimate."""
    own = _log_kt(a, b)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class Subtree:
    """The levels of the tree from depth ``top`` to ``depth`` over the counted sequences of a bucket.

    Only the sequences themselves are kept, by depth. Sorted sequences are also in the order of each decision's nodes, so
    the nodes of one of the eight decisions are counted without sorting, used and dropped before the next one's.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int, depth: int):
        """keys: distinct and sorted."""
        self.top, self.depth, self.counted = top, depth, {}
        counts = counts.astype(float)
        for d in range(depth, top - 1, -1):
            if d < depth:
                keys = keys & _mask(d + 1)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                at = _runs_of(keys)
                keys, counts = keys[at], np.add.reduceat(counts[order], at) if len(at) else counts
            self.counted[d] = keys, counts

    def level(self, d: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes (context of depth d with the node, sorted) of the j-th decision, with their zeros and ones."""
        keys, counts = self.counted[d]
        nodes, bit = decision(keys, j)
        at = _runs_of(nodes)
        if not len(at):
            return nodes, counts, counts
        ones = np.add.reduceat(counts * bit, at)
        return nodes[at], np.add.reduceat(counts, at) - ones, ones

    def levels(self, j: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """Of the j-th decision by depth: nodes, zeros, ones and the weight of their own estimates; and the top's logarithms."""
        out, below = {}, None
        for d in range(self.depth, self.top - 1, -1):
            u, a, b = self.level(d, j)
            if below is None:
                lw, w = weigh(a, b, None)
            else:
                up = self._parent(below[0], d + 1)
                lw, w = weigh(a, b, np.bincount(np.searchsorted(u, up), weights=below[1], minlength=len(u)))
            out[d], below = (u, a, b, w), (u, lw)
        return out, below[1]

    @staticmethod
    def _parent(u: np.ndarray, d: int) -> np.ndarray:
        """A context of depth d without its oldest byte."""
        return ((u >> U64(8)) & _mask(d - 1)) << U64(8) | (u & U64(255))

    def log10(self, keys: np.ndarray, above: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 of the last byte of each key after the others.

        above: by depth from 0 to top - 1, sorted keys of nodes with the ones' share that all estimates down to there
        give, the weight they have, and the node's own estimate; the rest of the weight is for deeper ones.
        """
        out = np.zeros(len(keys))
        for j in range(8):
            levels, _ = self.levels(j)
            for at in range(0, len(keys), _KEYS):
                out[at:at + _KEYS] += self._log10_of(keys[at:at + _KEYS], j, levels, above)
        return out

    def _log10_of(self, keys: np.ndarray, j: int, levels: dict, above: list) -> np.ndarray:
        full, bit = decision(keys, j)
        ctx, node = full >> U64(8), full & U64(255)
        # from the shallow end: the ones' share so far, the weight still to give, the deepest estimate met
        ones, rest, last = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
        for d, (known, ones_above, mass_above, own) in enumerate(above):
            i, there = _find(known, (ctx & _mask(d)) << U64(8) | node)
            if not there.any():
                break
            ones, rest, last = np.where(there, ones_above[i], ones), np.where(there, 1 - mass_above[i], rest), np.where(there, own[i], last)
        for d in range(self.top, self.depth + 1):
            u, a, b, w = levels[d]
            i, there = _find(u, (ctx & _mask(d)) << U64(8) | node)
            if not there.any():
                break
            p = (b[i] + 0.5) / (a[i] + b[i] + 1)
            last = np.where(there, p, last)
            ones = np.where(there, ones + rest * w[i] * p, ones)
            rest = np.where(there, rest * (1 - w[i]), rest)
        p = ones + rest * last
        return np.log10(np.where(bit == 1, p, 1 - p))


def _find(u: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(u):
        return np.zeros(len(k), np.int64), np.zeros(len(k), bool)
    i = np.minimum(np.searchsorted(u, k), len(u) - 1)
    return i, u[i] == k


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=counts, minlength=len(u)).astype(np.int64)


def _runs(texts: list[bytes], step: int = _STEP):
    """Ranges of texts of about step bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= step or i == len(texts) - 1:
            yield at, i + 1
            at, size = i + 1, 0


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token and the number of the text that it is in; the end of a text is the token 0."""
    w = Words(texts)
    h = w.hashes(0)
    return np.concatenate([np.where(h == 0, U64(1), h), np.zeros(len(texts), U64)]), np.concatenate([w.doc, np.arange(len(texts))])


def _values(texts: list[bytes], depth: int, kind: int) -> np.ndarray:
    """The sequences (kind 0) or tokens (kind 1) of some texts."""
    return grams(texts, depth) if kind == 0 else word_tokens(texts)[0]


def _add(keys: np.ndarray, counts: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds sorted distinct u with counts c to sorted distinct keys."""
    if not len(keys):
        return u, c
    i = np.searchsorted(keys, u)
    at = np.minimum(i, len(keys) - 1)
    old = keys[at] == u
    counts[at[old]] += c[old]
    return np.insert(keys, i[~old], u[~old]), np.insert(counts, i[~old], c[~old])


def counted(texts: list[bytes], train: np.ndarray, depth: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sequences or tokens of all texts, in order, with their counts in training texts; run by run, so that no
    array is as long as the block."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    for a, z in _runs(texts):
        for used in (True, False):
            some = [x for x, k in zip(texts[a:z], train[a:z]) if k == used]
            if some:
                u, c = np.unique(_values(some, depth, kind), return_counts=True)
                keys, counts = _add(keys, counts, u, c if used else np.zeros(len(u), np.int64))
    return keys, counts


def looked_up(values: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """logs of each value's place among the sorted keys.

    Values of 48 bits are sorted in chunks together with their places in the chunk, so that they are found in order.
    """
    out = np.empty(len(values))
    for a in range(0, len(values), 1 << 16):
        part = values[a:a + (1 << 16)]
        both = np.sort(part << U64(16) | np.arange(len(part), dtype=U64))
        out[a + (both & U64(0xFFFF)).astype(np.int64)] = logs[np.searchsorted(keys, both >> U64(16))]
    return out


def by_bucket(keys: np.ndarray, kind: int, n_buckets: int, suffix: int) -> list[tuple[int, np.ndarray]]:
    """The places of the sorted keys that each bucket gets, in order."""
    return [(b, np.sort(part)) for b, part in split_by_bucket(keys >> U64(8) & _mask(suffix) if kind == 0 else keys, n_buckets)]


def gather(t: pa.Table, n_buckets: int, depth: int, suffix: int) -> pa.Table:
    """Of a block: its distinct sequences (kind 0) and tokens (kind 1) with their counts in training rows, by bucket."""
    block, texts = t.column("block")[0].as_py(), texts_of(t)
    train = np.array(t.column("train").to_pylist(), bool)
    rows = {name: [] for name in _SENT.names}
    for kind in (0, 1):
        keys, counts = counted(texts, train, depth, kind)
        for b, part in by_bucket(keys, kind, n_buckets, suffix):
            for name, x in zip(_SENT.names, (block, b, kind, pack_sorted(keys[part]), pack(counts[part].astype(np.uint32)))):
                rows[name].append(x)
    return pa.table(rows, schema=_SENT)


def _kind(t: pa.Table, kind: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    rows = [i for i, k in enumerate(t.column("kind").to_pylist()) if k == kind]
    pick = lambda name: [t.column(name)[i].as_py() for i in rows]
    return pick("block"), [unpack_sorted(x) for x in pick("keys")], [unpack(x, np.uint32).astype(np.int64) for x in pick("counts")]


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    u, c = _merge(list(zip(keys, counts)))
    return u[c > 0], c[c > 0]


def summary(t: pa.Table, depth: int, suffix: int) -> pa.Table:
    """Of a bucket: its nodes at depth suffix; as node -1, the shallower contexts that it will ask for (a: the bucket);
    as context -1, its training tokens and distinct ones (a, b)."""
    _, keys, counts = _kind(t, 0)
    u, c = _counted(keys, counts)
    _, wk, wc = _kind(t, 1)
    words, times = _counted(wk, wc)
    nodes, a, b, lw = np.zeros(0, U64), np.zeros(0), np.zeros(0), np.zeros(0)
    asked = np.unique(np.concatenate([k >> U64(8) & _mask(suffix - 1) for k in keys])) if keys else np.zeros(0, U64)
    bucket = float(t.column("bucket")[0].as_py())
    if len(u):
        tree, found = Subtree(u, c, suffix, depth), []
        for j in range(8):
            levels, top = tree.levels(j)
            found.append((*levels[suffix][:3], top))
        nodes, a, b, lw = (np.concatenate(x) for x in zip(*found))
    none = np.zeros(len(asked))
    return pa.table({
        "ctx": np.concatenate([(nodes >> U64(8)).astype(np.int64), asked.astype(np.int64), [-1]]),
        "node": np.concatenate([(nodes & U64(255)).astype(np.int32), none.astype(np.int32) - 1, [0]]).astype(np.int32),
        "a": np.concatenate([a, none + bucket, [times.sum()]]).astype(float),
        "b": np.concatenate([b, none, [len(words)]]).astype(float), "lw": np.concatenate([lw, none, [0.0]]),
    })


def shallow(nodes: DataFrame, suffix: int) -> DataFrame:
    """(d, ctx, node, ones, mass, last) for each depth d below suffix: the prediction of all depths from 0 to d.

    Levels are summed by Spark; the last sums (depth 1 to 0) are of at most 256 contexts.
    """
    gamma = lambda x: _sql_log_gamma(x)
    kt = lambda: gamma(F.col("a") + 0.5) + gamma(F.col("b") + 0.5) - F.lit(math.log(math.pi)) - gamma(F.col("a") + F.col("b") + 1.0)
    levels, at = {}, nodes
    for d in range(suffix - 1, -1, -1):
        up = at.withColumn("ctx", F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1))).groupBy("ctx", "node").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
        up = up.withColumn("own", kt())
        top = F.greatest("own", "below")
        up = up.withColumn("lw", top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("below") - top)) - F.lit(math.log(2)))
        levels[d] = at = written(up.select("ctx", "node", "a", "b", "lw", F.exp(F.col("own") - math.log(2) - F.col("lw")).alias("w")), "tree")
    p = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    at = levels[0].select("ctx", "node", (F.col("w") * p).alias("ones"), F.col("w").alias("mass"), p.alias("last"))
    out = at.withColumn("d", F.lit(0))
    for d in range(1, suffix):
        parent = at.select(F.col("ctx").alias("up"), "node", F.col("ones").alias("ones0"), F.col("mass").alias("mass0"))
        deeper = levels[d].withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))).join(parent, ["up", "node"])
        given = (1 - F.col("mass0")) * F.col("w")
        at = deeper.select("ctx", "node", (F.col("ones0") + given * p).alias("ones"), (F.col("mass0") + given).alias("mass"), p.alias("last"))
        out = out.unionByName(at.withColumn("d", F.lit(d)))
    return out


def _sql_log_gamma(x):
    shift = F.lit(1.0)
    for k in range(8):
        shift = shift * (x + float(k))
    y = x + 8.0
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(shift)


def answer(t: pa.Table, above: pa.Table, depth: int, suffix: int) -> pa.Table:
    """Of a bucket: to each block, log10 of each sequence and the count of each token, in the order in which it sent them."""
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("logs", pa.binary())])
    rows = {name: [] for name in schema.names}
    if t.num_rows:
        bucket = t.column("bucket")[0].as_py()
        owners, keys, counts = _kind(t, 0)
        if keys:
            k = above.column("ctx").to_numpy().astype(U64) << U64(8) | above.column("node").to_numpy().astype(U64)
            order, of, shallow_part = np.argsort(k), above.column("d").to_numpy(), []
            for d in range(suffix):
                rows_d = order[of[order] == d]
                shallow_part.append((k[rows_d], *(above.column(c).to_numpy()[rows_d] for c in ("ones", "mass", "last"))))
            tree, wanted = Subtree(*_counted(keys, counts), suffix, depth), np.unique(np.concatenate(keys))
            logs = tree.log10(wanted, shallow_part)
            for owner, own in zip(owners, keys):
                for name, x in zip(schema.names, (owner, bucket, 0, pack(logs[np.searchsorted(wanted, own)].astype(np.float32)))):
                    rows[name].append(x)
        owners, keys, counts = _kind(t, 1)
        if keys:
            u, c = _merge(list(zip(keys, counts)))
            for owner, own in zip(owners, keys):
                for name, x in zip(schema.names, (owner, bucket, 1, pack(c[np.searchsorted(u, own)].astype(np.uint32)))):
                    rows[name].append(x)
    return pa.table(rows, schema=schema)


def apply_logs(t: pa.Table, replies: pa.Table, depth: int, suffix: int, n_buckets: int, n_tokens: int, n_distinct: int) -> pa.Table:
    """Of a block: the scores of each document, from the answers of all buckets."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
    if not t.num_rows:
        return schema.empty_table()
    texts, place = texts_of(t), {}
    train = np.array(t.column("train").to_pylist(), bool)
    for i, of in enumerate(zip(replies.column("kind").to_pylist(), replies.column("bucket").to_pylist())):
        place[of] = i
    lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    total = math.log10(n_tokens + 0.5 * (n_distinct + 1))
    score, tokens, known, base = (np.zeros(len(texts)) for _ in range(4))
    for kind in (0, 1):
        keys, _ = counted(texts, train, depth, kind)
        logs = np.empty(len(keys))
        for b, part in by_bucket(keys, kind, n_buckets, suffix):
            logs[part] = unpack(replies.column("logs")[place[kind, b]].as_py(), (np.float32, np.uint32)[kind])
        for a, z in _runs(texts):
            n = z - a
            if kind == 0:
                each = looked_up(grams(texts[a:z], depth), keys, logs)
                score[a:z] = np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths[a:z])[:-1]]))
            else:
                h, doc = word_tokens(texts[a:z])
                u, inverse = np.unique(h, return_inverse=True)
                each = logs[np.searchsorted(keys, u)][inverse]
                tokens[a:z] = np.bincount(doc, minlength=n)
                known[a:z] = np.bincount(doc, weights=each > 0, minlength=n)
                base[a:z] = np.bincount(doc, weights=np.log10(each + 0.5) - total, minlength=n)
    return pa.table([t.column("doc_id"), pa.array(~train), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(lengths)], schema=schema)


def score(docs: DataFrame, *, depth: int = DEPTH, suffix: int = SUFFIX, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_blocks = block_count(docs, block_bytes)
    n_buckets = max(8, BUCKETS * n_blocks)
    rows = in_blocks(docs, n_blocks, F.col("doc_id").cast("long").alias("doc_id"), lower.alias("text"), (remainder(F.col("doc_id")) != HELD_OUT).alias("train"))
    sent = written(rows.groupBy("block").applyInArrow(lambda t: gather(t, n_buckets, depth, suffix), "block int, bucket int, kind int, keys binary, counts binary"), "sequences")
    # set apart by number, so that adaptive execution doesn't join buckets, small in bytes but not in work, into few tasks
    sent = sent.repartition(n_buckets, "bucket")
    found = written(sent.groupBy("bucket").applyInArrow(lambda t: summary(t, depth, suffix), NODES), "nodes")
    words = found.filter("ctx = -1").agg(F.sum("a").alias("n"), F.sum("b").alias("v")).first()
    n_tokens, n_distinct = int(words["n"] or 0), int(words["v"] or 0)
    above = shallow(found.filter("node > 0"), suffix)
    asked = found.filter("node = -1").select(F.col("a").cast("int").alias("bucket"), F.explode(F.array(*[
        F.struct(F.lit(d).alias("d"), F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("ctx")) for d in range(suffix)])).alias("x"))
    above = asked.select("bucket", "x.*").distinct().join(above, ["d", "ctx"]).select("bucket", "d", "ctx", "node", "ones", "mass", "last")
    back = sent.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(
        lambda t, up: answer(t, up, depth, suffix), "block int, bucket int, kind int, logs binary")
    out = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        lambda t, r: apply_logs(t, r, depth, suffix, n_buckets, n_tokens, n_distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
