"""Whole queries against plain Python versions of their contracts, on the small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventloom.llm import context_tree, quality_rules, simhash_neardup, source_mix

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


class BruteTree:
    """Context-tree weighting as it is defined: one dictionary of counts, one recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for ctx, node, bit in self.steps(t):
                for d in range(depth + 1):
                    self.counts[ctx[depth - d:], node][bit] += 1
                    if d:
                        self.children[ctx[depth - d + 1:], node].add(ctx[depth - d:])
        self.log = {}

    def steps(self, text):
        data = bytes(self.depth) + text + b"\0"
        for i in range(self.depth, len(data)):
            for j in range(8):
                yield data[i - self.depth:i], (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1

    def own(self, key):
        a, b = self.counts[key]
        g = math.lgamma
        return g(a + 0.5) + g(b + 0.5) - 2 * g(0.5) - g(a + b + 1)

    def weighted(self, ctx, node):
        key = ctx, node
        if key not in self.log:
            if len(ctx) == self.depth:
                self.log[key] = self.own(key)
            else:
                below = sum(self.weighted(c, node) for c in self.children[key])
                self.log[key] = np.logaddexp(self.own(key), below) - math.log(2)
        return self.log[key]

    def ones(self, ctx, node, d=0):
        key = ctx[self.depth - d:], node
        if key not in self.counts:
            return 0.5
        a, b = self.counts[key]
        p = (b + 0.5) / (a + b + 1)
        if d == self.depth or (ctx[self.depth - d - 1:], node) not in self.counts:
            return p
        w = math.exp(self.own(key) - math.log(2) - self.weighted(*key))
        return w * p + (1 - w) * self.ones(ctx, node, d + 1)

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for ctx, node, bit in self.steps(text) for p in [self.ones(ctx, node)])


def test_context_tree_is_the_weighted_tree(spark):
    rng = np.random.default_rng(6)
    words = np.array(["the", "then", "a", "ab", "abra", "cadabra", "é", "Zed"])
    rows = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 25, 60))] + [(60, None), (61, ""), (None, "the end")]
    out = {r["doc_id"]: r for r in context_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1 << 9).collect()}
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows}
    tree = BruteTree([lower(t).encode() for i, t in rows if not held[i]], context_tree.DEPTH)
    for i, t in rows:
        assert out[i]["held_out"] == held[i] and math.isclose(out[i]["score"], tree.score(lower(t).encode()), rel_tol=1e-5), i


def test_context_tree_counts_and_base(spark, docs):
    tokens = {i: [*re.findall(WORD, lower(t)), None] for i, t in zip(docs.doc_id, docs.text)}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    out = context_tree.query(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in train for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)


def water(sizes, budget, most=2.0, weights=(5.0, 2.0, 1.0)):
    """Targets by filling in turns: shares by weight, what is over a cap goes round again."""
    caps, left, target = {s: most * n for s, n in sizes.items()}, budget, dict.fromkeys(sizes, 0.0)
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    free = set(sizes)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > caps[s]}
        for s in over or free:
            target[s] = caps[s] if over else weight[s] * unit
            left -= target[s]
        free -= over or free
    return target


def test_source_mix_targets_and_taken(spark, docs):
    size = [len(re.findall(WORD, t or "")) for t in docs.text]
    of = defaultdict(int)
    for s, n in zip(docs.source, size):
        of[s] += n
    target, taken = water(of, 1.5 * sum(size)), defaultdict(int)
    where = dict(zip(docs.doc_id, zip(docs.source, size)))
    for r in source_mix.query(spark, SF).collect():
        s, n = where[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, of[s]) and math.isclose(r["target"], target[s], rel_tol=1e-9) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= 10 for s, t in target.items())  # ten documents a source leave few sums


def test_source_mix_of_a_null_source_and_ties(spark):
    rows = [(i, "w " * (1 + i % 7), None if i % 3 == 0 else "b") for i in range(60)] + [(7, "w w", "b")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [tuple(r) for r in source_mix.mix(df).collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += t.count("w")
    target = water(sizes, 1.5 * sum(sizes.values()))
    for s in (None, "b"):
        assert {round(r[4], 6) for r in out if r[1] == s} == {round(target[s], 6)}
        assert abs(sum(r[5] for r in out if r[1] == s) - target[s]) <= 1
    assert sorted(out, key=str) == sorted((tuple(r) for r in source_mix.mix(df.repartition(3)).collect()), key=str)


def test_simhash_components(spark, docs):
    out = simhash_neardup.query(spark, SF).collect()
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in out}
    ids, root = sorted(fp), {}
    for i in ids:  # breadth first from the smallest id
        if i in root:
            continue
        root[i], queue = i, [i]
        while queue:
            at = queue.pop()
            for j in ids:
                if j not in root and (fp[at] ^ fp[j]).bit_count() <= 4:
                    root[j] = i
                    queue.append(j)
    assert {r["doc_id"]: r["component_id"] for r in out} == root


def test_quality_rules_list_is_what_keeps(spark, docs):
    """The verdict of every row is that of the learned list, read as plain conditions on plain counts."""
    d, labels = spark.createDataFrame(docs), spark.read.parquet(f"{SF}/labels.parquet")
    counts, rules = quality_rules.learned(d, labels)
    assert rules
    for r in quality_rules.judged(counts, rules).collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        hit = next((k for k, rule in enumerate(rules, 1) if all((r[f"f_{t.feature}"] > t.threshold) == t.above for t in rule)), None)
        assert (r["base_failed"], r["kept"], r["rule"]) == (failed, not failed and hit is None, 0 if failed else hit)


def test_quality_rules_need_both_kinds(spark, docs):
    d = spark.createDataFrame(docs)
    good = spark.createDataFrame([(int(i), 1, 0) for i in docs.doc_id], "doc_id long, quality int, toxic int")
    for labels in (good, good.limit(0)):
        counts, rules = quality_rules.learned(d, labels)
        assert rules == [] and quality_rules.judged(counts, rules).filter("kept = base_failed").count() == 0
    # labels that contradict each other count as the lower one
    both = good.unionByName(spark.createDataFrame([(int(i), 0, 0) for i in docs.doc_id[::2]], good.schema))
    once = spark.createDataFrame([(int(i), int(k % 2), 0) for k, i in enumerate(docs.doc_id)], good.schema)
    assert quality_rules.learned(d, both)[1] == quality_rules.learned(d, once)[1]
