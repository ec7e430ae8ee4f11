"""The operators of this subpackage against brute force, SQL and the odd cases their docstrings define."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F

from eventloom.llm import compression_quality, context_tree, piece_codec, preference_chat, projection_forest, quality_rules, revisits, shingle_neardup, simhash_neardup, source_mix, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, row string"
PASSAGE = " ".join(f"w{i}" for i in range(30))
ODD = [
    (1, None, "en", None, None, 1, "r"), (2, "", "en", "a", 0, 1, "r"), (3, " \t\n", "en", "a", 3, 1, "r"), (4, "one", "en", "b", 3, 1, "r"),
    (5, PASSAGE, "en", "b", 1, 1, "r"), (6, f"lead {PASSAGE} tail", "en", "b", 1, 1, "r"), (7, PASSAGE, "en", None, 1, 1, "r"), (7, PASSAGE, "en", None, 1, 1, "r"),
    (None, f"x {PASSAGE}", "en", "c", 1, 1, "r"), (8, "word " * 30000, "en", "c", 1, 1, "r"), (9, "é\x00ü😀 ▁a b", "fr", "c", 1, 1, "r"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


def test_compression_scores(spark, odd, empty, labels):
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        found = compression_quality.score(docs, compression_quality.fit(docs, labels)).collect()
        assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
    # repeated rows give repeated results; labels that contradict each other count as the lower one
    twice = compression_quality.score(odd, compression_quality.fit(odd, labels)).filter("doc_id = 7").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_compression_fit_of_odd_labels(spark):
    docs = spark.createDataFrame([(i, ("good words of the best kind " if i % 2 else "$$$ win cash now $$$ ") * (3 + i % 7)) for i in range(200)], "doc_id long, text string")
    marks = [(i, i % 2, 0) for i in range(200)]
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    plain = compression_quality.fit(docs, of(marks))
    assert plain == compression_quality.fit(docs, of(marks + [(i, 1, 0) for i in range(0, 200, 2)]))  # the lower label counts
    out = compression_quality.score(docs, plain).collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in out)
    one = compression_quality.score(docs, compression_quality.fit(docs, of([m for m in marks if m[1]]))).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.9
    assert {r["score"] for r in compression_quality.score(docs, compression_quality.fit(docs, of([]))).collect()} == {0.5}


def test_compression_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    out = compression_quality.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert ((good.score >= 0.5).mean() + (bad.score < 0.5).mean()) / 2 > 0.93
    assert (out.predicted == out.quality).mean() > 0.95


def test_compression_scores_against_plain_python(spark):
    """Sample, dictionaries, sizes, differences, curve and scores of the small table, each worked out anew."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learn = [i for i in good if zlib.crc32(str(i).encode()) % 5 and text.get(i)]
    at = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in learn], "i long").select("i", F.xxhash64(F.lit(7), "i").alias("h")).collect()}
    dictionary, held = {}, []
    for kind in (1, 0):
        rows = sorted((i for i in learn if good[i] == kind), key=lambda i: (at[i], i))
        part, size = [], 0
        for k, i in enumerate(rows):
            raw = text[i].encode()
            if k % 3 == 2:
                held.append(i)
            elif size + len(raw) < compression_quality.DICTIONARY_BYTES:
                part.append(raw)
                size += len(raw) + 1
        dictionary[kind] = b"\n".join(part)
    compressor = {k: zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, d in dictionary.items()}

    def features(t):
        raw = t.encode()
        d = (len(compressor[0].compress(raw)) - len(compressor[1].compress(raw))) / len(raw) if raw else 0.0
        return [1.0, 10 * d, d * np.log2(1 + len(raw)) if raw else 0.0]

    x, y = np.array([features(text[i]) for i in held]), np.array([float(good[i]) for i in held])

    def loss(w):  # of the penalised curve, which has one least point
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.005 * w @ w

    model = compression_quality.fit(docs, labels)
    assert (model.good, model.bad) == (dictionary[1], dictionary[0])
    shares = Counter(q for i, q in good.items() if zlib.crc32(str(i).encode()) % 5)
    w = np.array(model.weights)
    w[0] -= np.log((shares[1] / shares[0]) / (y.sum() / (len(y) - y.sum())))
    for k in range(3):
        for step in (1e-3, -1e-3):
            assert loss(w) <= loss(w + step * np.eye(3)[k])
    for r in compression_quality.query(spark, SF).collect():
        wanted = 1 / (1 + np.exp(-np.clip(np.array(features(text[r["doc_id"]])) @ np.array(model.weights), -30, 30)))
        assert abs(r["score"] - wanted) < 1e-9 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_compression_fit_with_one_very_long_text(spark):
    docs = [(i, ("good words of the best kind " if i % 2 else "$$$ win cash now $$$ ") * (3 + i % 7)) for i in range(200)]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    marks = [(i, i % 2, 0) for i in range(200)]
    plain = compression_quality.fit(of(docs, "doc_id long, text string"), of(marks, "doc_id long, quality int, toxic int"))
    for k in (1000, 1001, 1002, 1003):  # some come first in the order of the hash
        long = of(docs + [(k, "words $$$ " * 900_000)], "doc_id long, text string")
        got = compression_quality.fit(long, of(marks + [(k, k % 2, 0)], "doc_id long, quality int, toxic int"))
        assert (got.good, got.bad) == (plain.good, plain.bad) and np.allclose(got.weights[1:], plain.weights[1:])
    only = compression_quality.fit(of([(i, "ab"[i % 2] * 200_000) for i in range(40)], "doc_id long, text string"), of(marks[:40], "doc_id long, quality int, toxic int"))
    assert only.good and only.bad


def test_nearest_of_equal_products(spark):
    """Very many vectors of one product with the query: the smallest ids come first, however leaves are cut."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 8))
    x[:, 0] = 1
    rows = [(0, [1.0] + [0.0] * 7)] + [(i + 1, v) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, leaf string")
    for leaf, opened in ((64, 10_000), (512, None)):
        out = projection_forest.nearest(table, lambda i: i == 0, leaf=leaf, opened=opened).orderBy("rank").collect()
        if opened:
            assert [r["vec_id"] for r in out] == list(range(1, 21))
        assert [r["vec_id"] for r in out] == sorted(r["vec_id"] for r in out) and {r["score"] for r in out} == {1.0}


def brute_counts(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, empty, labels):
    counts, rules = quality_rules.learned(odd, labels)
    got = sorted(tuple(r) for r in quality_rules.judged(counts, rules).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(brute_counts(r[1]) for r in ODD)
    assert quality_rules.judged(*quality_rules.learned(empty, labels)).count() == 0
    kept = quality_rules.keep_stage(spark, odd, SF)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {5, 6, 7, None}


def test_learned_rules_part_the_labels(spark):
    out = quality_rules.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed").toPandas()
    assert (out.kept == (out.quality == 1)).mean() > 0.95


def test_context_tree(spark, odd, empty):
    out = context_tree.score(odd, block_bytes=1 << 14).collect()
    assert len(out) == len(ODD) and all(r["score"] < 0 for r in out)
    assert context_tree.score(empty).count() == 0
    # a proper distribution: the probabilities of all next bytes add up to one
    train = [b"abracadabra abracadabra", b"abc abd"]
    keys, counts = np.unique(np.concatenate([context_tree.grams([t], 3) for t in train]), return_counts=True)
    tree = context_tree.Subtree(keys, counts, 0, 3)
    for ctx in (b"abr", b"zzz", b"\0\0\0"):
        all_next = np.array([int.from_bytes(ctx, "big") << 8 | b for b in range(256)], np.uint64)
        assert abs((10 ** tree.log10(all_next, [])).sum() - 1) < 1e-9
    # blocks and buckets of other sizes give the same
    a = {r["doc_id"]: r["score"] for r in context_tree.score(odd).collect()}
    assert all(abs(a[r["doc_id"]] - r["score"]) < 1e-4 * abs(r["score"]) for r in out if r["doc_id"] not in (7, None))


def test_projection_forest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(30)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = projection_forest.nearest(vectors, lambda c: c % 20 == 0, leaf=64, opened=60, leaf_most=40).toPandas()
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and i not in (2001, 2002, 2003)}
    ids, m = np.array(list(good)), np.array(list(good.values()))
    hits = []
    for q, part in out.groupby("query_id"):
        s = (m * good[q]).sum(axis=1)
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits.append(len(set(order) & set(part.vec_id)) / 20)
        assert len(part) == 20 and q not in set(part.vec_id)
    assert len(hits) == sum(i % 20 == 0 for i in good) and np.mean(hits) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in projection_forest.nearest(few, lambda c: c == 0).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert projection_forest.nearest(few.limit(0), lambda c: c == 0).count() == 0


def test_projection_forest_recall_of_many_leaves(spark):
    x = np.random.default_rng(3).standard_normal((8000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = projection_forest.nearest(vectors, lambda c: c % 40 == 0, leaf=16).toPandas()  # 12 trees of 512 leaves
    x = x.astype(float)
    hits = [len(set(np.argsort(-np.where(np.arange(8000) == q, -np.inf, x @ x[q]))[:20]) & set(part.vec_id)) / 20 for q, part in out.groupby("query_id")]
    assert len(hits) == 200 and np.mean(hits) >= 0.9


def test_source_mix(odd, empty):
    out = source_mix.mix(odd).toPandas()
    assert sorted(out["size"]) == sorted(len(re.findall(WORD, r[1] or "")) for r in ODD)
    assert (out.taken <= 2 * out["size"]).all()
    assert abs(out.groupby("source", dropna=False).target.first().sum() - 1.5 * out["size"].sum()) < 1e-6
    assert source_mix.mix(empty).count() == 0
    assert sorted(map(tuple, source_mix.mix(odd).collect()), key=str) == sorted(map(tuple, source_mix.mix(odd).collect()), key=str)


@pytest.mark.parametrize("goal", [0, 1, 7, 50, 99, 1000])
def test_knapsack_is_nearest(goal):
    lengths, counts = [3, 5, 11], [4, 2, 3]
    best = min(abs(goal - 3 * a - 5 * b - 11 * c) for a in range(5) for b in range(3) for c in range(4))
    take = source_mix.fit_counts(lengths, counts, goal)
    goal = min(goal, 55)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    assert abs(goal - sum(n * t for n, t in zip(lengths, take))) <= best


@pytest.mark.parametrize("top", [1000, 4000])
def test_partial_pass_takes_of_every_length(top):
    lengths, counts = [*range(1, top)], [3] * 50 + [1] * (top - 51)
    total = sum(n * c for n, c in zip(lengths, counts))
    taken = np.zeros(len(lengths))
    for seed in range(30):
        take = np.array(source_mix.fit_counts(lengths, counts, total // 2, seed=seed))
        assert (take <= counts).all() and (take * lengths).sum() == total // 2
        for part in np.array_split(np.arange(len(lengths)), 4):  # each quarter of the lengths gives about its half
            assert 0.3 < (take * lengths)[part].sum() / (np.array(counts) * lengths)[part].sum() < 0.7
        taken += take
    assert (taken > 0).all()


def brute_dedup(rows, n=20):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = re.findall(WORD, text or "")
        gone = set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            if k in seen:
                gone.update(range(i, i + n))
            seen.add(k)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("base,window", [(10, 20), (5, 20), (20, 20), (7, 20)])
def test_substring_dedup(odd, base, window):
    single = [(r[0], r[1]) for k, r in enumerate(ODD) if k != 7]
    docs = odd.dropDuplicates(["doc_id"])
    out = substring_dedup.dedup(docs, base=base, window=window, block_bytes=1 << 12).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out), key=str) == sorted(brute_dedup(single), key=str)


def test_substring_dedup_odd(spark, odd, empty):
    twice = substring_dedup.dedup(odd).filter("doc_id = 7").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert substring_dedup.dedup(empty).count() == 0
    stage = substring_dedup.dedup_stage(spark, odd, SF)
    assert stage.schema.simpleString() == odd.schema.simpleString()
    assert {r["doc_id"]: r["text"] for r in stage.collect()}[6] == "lead tail"


def test_piece_codec(spark, odd, empty):
    path = piece_codec.vocabulary_path()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.codec(path)
    for t in ["", " ", "a  b\n\nc\t d ", "▁a▁ b", "é\x00ü😀", "aaaaaaaa" * 50, "日本語テスト", "x" + " " * 40 + "y", "<s>x</s><unk><0x0A>"]:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.encoded([t])[2].to_pylist() == [library.decode([*ids, 2])]
    rng = np.random.default_rng(2)
    parts = np.array([*"abcdeé ü▁ \n\t😀日本\x00.,", "the ", "ing", " ▁", "a" * 70])
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 90, 400)]
    ids, sizes, decoded = own.encoded(texts)
    own.check(texts, ids, decoded)
    with pytest.raises(ValueError, match="library"):
        own.check(["a b"], *own.encoded(["a c"])[::2])
    assert sizes.tolist() == [len(x.split()) for x in ids.to_pylist()] and not len(own.encoded([])[1])
    out = {r["doc_id"]: r for r in piece_codec.digests(odd, path).collect()}
    for doc_id, text in ((r[0], r[1]) for r in ODD):
        ids = [*library.encode(text or ""), 2]
        assert (out[doc_id]["n_tokens"], out[doc_id]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert piece_codec.digests(empty, path).count() == 0
    stage = piece_codec.encode_stage(spark, odd.withColumn("ids", F.lit(1)), SF)  # a column of the result's name gives way
    assert stage.columns == [*odd.columns, "token_ids", "n_tokens"] and stage.filter(F.size("token_ids") != F.col("n_tokens")).count() == 0


def brute_fingerprint(t):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, empty):
    out = simhash_neardup.near_duplicates(odd).collect()
    want = {r[0]: brute_fingerprint(r[1]) for r in ODD}
    assert len(out) == len(ODD) and all(r["fp"] % 2**64 == want[r["doc_id"]] for r in out)
    assert {r["doc_id"]: r["component_id"] for r in out}[7] == 5
    assert simhash_neardup.near_duplicates(empty).count() == 0


def test_simhash_links_lose_none(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fp = {0, *centre.tolist()}
    for c in centre.tolist():  # chains and clouds around a few centres
        at = c
        for _ in range(25):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                at ^= 1 << int(b)
            fp.add(at)
    fp = sorted(fp)
    rows = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fp], "fp long")
    from eventloom.llm.components import connected

    for tile in (2048, 8):
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in connected(simhash_neardup.links(rows, len(fp), tile=tile)).collect()}
        root = {x: x for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, a in enumerate(fp):
            for b in fp[:i]:
                if (a ^ b).bit_count() <= 4:
                    root[find(a)] = find(b)
        groups = lambda f: {frozenset(y for y in fp if f(y) == r) for r in {f(x) for x in fp}}
        assert groups(find) == groups(lambda x: got.get(x, x))


def brute_kept(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))  # rows are in order of id
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return {rows[i][0] for i in range(len(rows)) if root[i] == i}


@pytest.mark.parametrize("tile", [shingle_neardup.TILE, 500])
def test_pipeline_drops_near_copies_by_shingles(spark, tile):
    rng = np.random.default_rng(4)
    rows = [(0, None), (1, "a b"), (2, "A  b"), (3, " ")]
    for _ in range(30):
        base = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(100, 300)))]
        for copy in range(6):  # from 0.6 to 1 of the shingles in common, round the limit mostly
            text = list(base)
            for at in rng.choice(len(base), int(len(base) * copy * 0.007), replace=False):
                text[at] = f"x{at}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = shingle_neardup.keep_stage(spark, docs, SF, tile=tile)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == brute_kept(rows)
    assert shingle_neardup.keep_stage(spark, docs.limit(0), SF).count() == 0


def test_preference_chat(spark):
    turn = lambda *t: [dict(zip(("turn", "role", "text"), x)) for x in t]
    rows = [(1, turn((0, "user", "q"), (1, "assistant", "a")), turn((0, "user", "q"), (1, "assistant", "b"))), (2, turn((0, "user", "q")), turn((0, "user", "q"))), (3, [], turn((0, "user", "q")))]
    kind = "array<struct<turn:int,role:string,text:string>>"
    out = {r["id"]: r for r in preference_chat.preferences(spark.createDataFrame(rows, f"id int, chosen {kind}, rejected {kind}")).collect()}
    assert out[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n" and [(s["text"], s["mask"]) for s in out[1]["rejected"]] == [("<|im_start|>assistant\n", 0), ("b<|im_end|>\n", 1)]
    assert out[2]["prompt_turns"] == 1 and out[2]["chosen"] == [] and out[3]["prompt"] == "" and len(out[3]["rejected"]) == 2


def test_preference_pairs_of_odd_conversations(spark):
    long = "word " * 30000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (0, 0, "user", "q"), (0, 1, None, None), (0, None, "user", "first"), (None, 0, "user", "x"), (5, 0, "user", long), (5, 1, "user", long)]
    turns = spark.createDataFrame([(*r, 7, "c") for r in rows], "conv_id long, turn int, role string, text string, chosen int, prompt string")
    convs = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in preference_chat.conversations(turns).collect()}
    assert convs == {0: [(None, "user", "first"), (0, "user", "q"), (1, "", "")], 1: [(0, "user", "q"), (1, "assistant", "a")], 5: [(0, "user", long), (1, "user", long)]}
    out = {r["conv_id"]: r for r in preference_chat.preferences(preference_chat.neighbour_pairs(turns)).collect()}
    assert {k: r["prompt_turns"] for k, r in out.items()} == {0: 0, 1: 1, 5: 2} and out[5]["chosen"] == out[5]["rejected"] == []
    assert [s["text"] for s in out[1]["rejected"]] == ["<|im_start|>user\n", "q<|im_end|>\n", "<|im_start|>\n", "<|im_end|>\n"]
    assert preference_chat.preferences(preference_chat.neighbour_pairs(turns.limit(0))).count() == 0


def test_preference_pairs_part_at_every_depth(spark):
    turns = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"{c} {t}") for c in range(24) for t in range(6 - c // 2 % 2)], "conv_id long, turn int, role string, text string")
    out = preference_chat.preferences(preference_chat.neighbour_pairs(turns)).collect()
    assert {r["prompt_turns"] for r in out} == set(range(6)) and all(r["prompt_turns"] == r["conv_id"] % (6 - r["conv_id"] // 2 % 2) for r in out)


def test_revisits(spark):
    head = "record_id long, url string, at long, kind string, headers map<string,string>, payload string"
    rows = [
        (1, "http://A.com/x/", 10, "response", {"ETag": '"1"', "Server": "s", "Date": "d0"}, "old"), (2, "http://a.com:80/x#f", 20, "response", {"ETag": '"2"', "Server": "s"}, "new"),
        (3, "http://a.com/x?utm_source=q", 20, "revisit", {"etag": 'W/"1"', "date": "d1", "server": "t"}, None), (4, "http://a.com/x", 99, "revisit", {"etag": '"1"'}, None),
        (5, "http://a.com/x", 5, "revisit", {}, None), (6, None, 50, "revisit", None, None), (7, "http://a.com/x", 30, "revisit", {}, None),
    ]
    out = {r["record_id"]: r for r in revisits.resolve(spark.createDataFrame(rows, head)).collect()}
    assert {k: r["status"] for k, r in out.items()} == {3: "resolved", 4: "mismatch", 5: "unmatched", 6: "unmatched", 7: "no_validator"}
    assert out[3]["payload"] == "old" and out[3]["headers"] == {"etag": 'W/"1"', "date": "d1", "server": "s"}
    assert revisits.resolve(spark.createDataFrame([], head)).count() == 0


def test_revisits_of_ids_that_repeat_across_urls(spark):
    head = "record_id long, url string, at long, kind string, headers map<string,string>, payload string"
    rows = [(1, "http://a/x", 10, "response", {"etag": "1"}, "a"), (1, "http://b/y", 20, "response", {"etag": "1"}, "b"), (1, "http://a/x", 30, "response", {"etag": "1"}, "later"),
            (2, "http://a/x", 15, "revisit", {"etag": "1"}, None), (3, "http://b/y", 25, "revisit", {"etag": "1"}, None), (4, "http://b/y", 15, "revisit", {"etag": "1"}, None)]
    out = {r["record_id"]: (r["status"], r["payload"]) for r in revisits.resolve(spark.createDataFrame(rows, head)).collect()}
    assert out == {2: ("resolved", "a"), 3: ("resolved", "b"), 4: ("unmatched", None)}


def test_canonical_urls(spark):
    urls = {"http://H:80/a/?b=2&a=1&utm_source=z#f": "http://h/a?a=1&b=2", "http://h:443/a": "http://h:443/a", "https://h:443/a": "https://h/a", "https://h:80/a": "https://h:80/a",
            "http://h/a?ref=v2": "http://h/a?ref=v2", " mailto:x ": "mailto:x", None: None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == urls


@pytest.mark.parametrize("slices", [None, 7])
def test_revisits_of_ties_and_repeats(spark, slices):
    head = "record_id long, url string, at long, kind string, headers map<string,string>, payload string, found long"
    rng = np.random.default_rng(8)
    rows = [(i, f"http://h/{rng.integers(3)}", int(rng.integers(40)), ("response", "revisit")[int(rng.integers(2))], {"etag": f'"{rng.integers(2)}"'}, f"p{i}", 5) for i in range(300)]
    rows += rows[:50] + [(900, "http://h/0", None, "revisit", None, None, None), (901, "http://h/1", None, "response", {}, "x", None)]
    got = revisits.resolve(spark.createDataFrame(rows, head), slices).collect()
    want = []
    for i, url, at, kind, headers, _, _ in rows:
        if kind == "revisit":
            seen = [r for r in rows if r[3] == "response" and r[1] == url and at is not None and r[2] is not None and r[2] < at]
            best = max(seen, key=lambda r: (r[2], r[0]), default=None)
            status = "unmatched" if best is None else "resolved" if best[4] == headers else "mismatch"
            want.append((i, status, best[0] if status == "resolved" else None, best[5] if status == "resolved" else None))
    assert sorted(((r["record_id"], r["status"], r["response_id"], r["payload"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("module", [substring_dedup, preference_chat, revisits])
def test_query_equals_its_sql(spark, module):
    db = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = module.query(spark, SF).toPandas(), db.sql(module.ORACLE).df()
    cell = lambda y: None if pd.isna(y) else int(y) if isinstance(y, float) else y
    key = lambda f: sorted(tuple(str(cell(y)) for y in r) for r in f[sorted(f.columns)].astype(object).values.tolist())
    assert key(ours) == key(theirs)


