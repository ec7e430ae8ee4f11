"""Ball k-means, best-fit packing and whitening against brute force, SQL and the odd cases their docstrings define."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import ball_kmeans, best_fit_packing, token_pieces, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, x string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "c") for i, v in rows], VECTORS)


def odd_vectors(width, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, width) / 7).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(2 * n)]  # a third and more of all rows are one vector
    rows += [rows[1], rows[1], (None, rows[2][1]), (-5, None), (-6, []), (-7, [1.0]), (-8, [None] * width), (-9, [float("nan")] * width), (-10, [float("inf")] + [0.0] * (width - 1))]
    return rows


def whole(rows, width):
    return [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]


def lloyd(rows, clusters, rounds):
    named = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x.tolist()) for i, x in rows if i is not None))[:clusters]
    c, x = [v for _, v in named], np.array([v for _, v in rows])
    for k in range(rounds + 1):
        d = ((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if k < rounds:
            c = [[int(s) // int((a == j).sum()) for s in x[a == j].sum(axis=0)] if (a == j).any() else v for j, v in enumerate(c)]
    return sorted((i if i is not None else -1, int(j), int(d[r, j])) for r, ((i, _), j) in enumerate(zip(rows, a))), c


@pytest.mark.parametrize(("width", "clusters", "rounds", "n"), [(3, 7, 5, 60), (2, 40, 4, 30), (5, 3, 0, 20), (4, 6, 30, 200)])
def test_ball_kmeans_equals_lloyd(spark, width, clusters, rounds, n):
    rows = odd_vectors(width, n)
    state, centroids = ball_kmeans.ball_kmeans(vectors(spark, rows).repartition(5), width=width, clusters=clusters, rounds=rounds)
    wanted, c = lloyd(whole(rows, width), clusters, rounds)
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"]) for r in state.collect()) == wanted
    assert centroids.tolist() == c


def test_ball_kmeans_looks_at_neighbours_alone():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (20, 4))
    x = centres[rng.integers(0, 20, 3000)] + rng.integers(-50, 51, (3000, 4))
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    own, near = d.argmin(axis=1), d.min(axis=1)
    radius = np.array([np.sqrt(near[own == k].max(initial=0)) for k in range(20)])
    balls = ball_kmeans.Balls.of(centres, radius, np.ones(20, bool))
    assert sum(map(len, balls.neighbours)) < 20  # far balls aren't neighbours
    still = ball_kmeans.Balls.of(centres, radius, np.zeros(20, bool))
    assert not any(map(len, still.neighbours))
    for b in (balls, still):
        found, far = b.assigned(x, own, near)
        assert (found == own).all() and (far == near).all()


def test_ball_kmeans_of_nothing_and_too_much(spark):
    state, centroids = ball_kmeans.ball_kmeans(vectors(spark, []), width=3)
    assert state.count() == 0 and len(centroids) == 0 and "cluster" in state.columns
    with pytest.raises(Exception, match="may not fit"):
        ball_kmeans.ball_kmeans(vectors(spark, [(1, [1e9, 0.0, 0.0])]), width=3)


def test_ball_kmeans_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    wanted = con.sql(ball_kmeans.ORACLE)
    own = ball_kmeans.query(spark, SF).select(wanted.columns)
    assert sorted(tuple(r) for r in own.collect()) == sorted(wanted.fetchall())


def brute_whitening(rows, components=4):
    x = np.array([v for _, v in rows])
    distinct = sorted({tuple(v.tolist()) for v in x})
    n, s = len(distinct), [sum(c) for c in zip(*distinct)]
    y = np.array(distinct, float) - np.array(s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return n, s, v, e[::-1][:components], u[:, ::-1][:, :components]


@pytest.mark.parametrize(("width", "n"), [(6, 300), (3, 40), (8, 4)])
def test_whitening_equals_brute_force(spark, width, n):
    rows = odd_vectors(width, n)
    good = whole(rows, width)
    k, s, v, e, u = brute_whitening(good)
    out = whitening.whiten(vectors(spark, rows).repartition(4)).collect()
    assert len(out) == len(good) * len(e) and {r["n"] for r in out} == {k}
    by = {}
    for r in out:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    scale = max(e[0], 1e-9)
    for i, x in good:
        dev = sum((k * int(a) - b) ** 2 for a, b in zip(x, s))
        for c in range(len(e)):
            for r in by[i, c + 1]:
                assert r["deviation"] == dev
                assert abs(r["explained"] - e[c] / np.trace(v)) < 1e-9
                if e[c] < 1e-12 * scale:
                    assert r["whitened"] is None
                elif min(abs(e[c] - f) for d, f in enumerate(np.linalg.eigvalsh(v)[::-1]) if d != c) > 1e-6 * scale:
                    assert abs(abs(r["whitened"]) - abs((x - np.array(s) / k) @ u[:, c] / np.sqrt(e[c]))) < 1e-6
    assert {r["identity_error"] for r in out}.pop() < 1e-9 and len({r["identity_error"] for r in out}) == 1


def test_whitening_odd_cases(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [float("nan")]), (3, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 2.0]), (1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [(1, 1, 0, None, None, None)] * 2 + [(2, 1, 0, None, None, None)] * 2
    # numbers beyond a long are added exactly all the same, and a deviation that doesn't fit is null
    big = whitening.whiten(vectors(spark, [(1, [1e16]), (2, [-1e16]), (3, [0.0])])).collect()
    assert [r["deviation"] for r in sorted(big)] == [None, None, 0]
    assert abs(sorted(big)[0]["whitened"]) == pytest.approx(np.sqrt(1.5)) and big[0]["identity_error"] < 1e-9


def test_whitening_query(spark):
    out = whitening.query(spark, SF).toPandas()
    assert len(out) == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert out.identity_error.max() < 1e-4 and out.groupby("component").explained.first().is_monotonic_decreasing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_pieces.vocabulary_path())


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(2)
    some = ["a", "T", "é", "ß", "Å", "Å", "T̈", "́", "'s", "'", "''s", "'RE", "1", "23", " ", "\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "<|endoftext|>",
            "<|ENDOFTEXT|>", "<|", "Σ", "ς", "İ", "ﬁ", "漢", "😀", "\x00", ".", "#*", "_", "K", "²", "Ⅷ", "-", "​", "word", "don't", "×", "÷", "ª", "𝔸"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + [None, "", "x" * 5000]
    small = token_pieces.Words(token_pieces.vocabulary_path(), remembered=50)
    for coder, size in ((token_pieces.Words(token_pieces.vocabulary_path()), 5003), (small, 100)):
        for a in range(0, len(texts), size):
            ids, begin = coder.encode(pa.array(texts[a:a + size], pa.string()))
            for k, text in enumerate(texts[a:a + size]):
                assert ids[begin[k]:begin[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_packing_query_against_brute_force(spark, tokenizer):
    out = best_fit_packing.query(spark, SF).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wanted = {}
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(-(-len(ids) // 2048)):
            part = ids[2048 * p:2048 * (p + 1)]
            wanted[i, p] = (2048 * p, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == wanted and len(out) == len(wanted)
    held(out, 2048, 1.03)


def held(out, capacity, ratio):
    """No sequence has a hole or is too long, and there are few more than can be."""
    out = out.sort_values(["sequence_id", "offset"])
    before = out.groupby("sequence_id").length.cumsum() - out.length
    assert (before == out.offset).all() and out.groupby("sequence_id").length.sum().max() <= capacity
    assert out.sequence_id.nunique() <= max(-(-out.length.sum() // capacity) + 2, ratio * out.length.sum() / capacity)


@pytest.mark.parametrize(("kind", "bucket", "ratio"), [("even", 300, 1.02), ("even", 1 << 14, 1.02), ("same", 200, 1.2), ("tiny", 500, 1.05), ("large", 300, 2.0), ("few", 1, 1.5)])
def test_packing_of_lengths(spark, kind, bucket, ratio):
    rng = np.random.default_rng(4)
    sizes = {"even": rng.integers(1, 257, 3000), "same": np.full(2000, 37), "tiny": rng.integers(1, 6, 5000), "large": rng.integers(129, 257, 1000), "few": np.array([256, 1, 255])}[kind]
    rows = spark.createDataFrame(list(enumerate(sizes.tolist())), "key long, length long").repartition(4)
    out = best_fit_packing.pack(rows, 256, bucket=bucket).join(rows, "key").toPandas()
    assert sorted(out.key) == list(range(len(sizes)))
    held(out, 256, ratio)
    if kind == "large":  # no two fit together
        assert out.sequence_id.nunique() == len(sizes)
    if kind == "same":
        assert out.sequence_id.nunique() == -(-2000 // 6)


def test_a_sweep_is_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = rng.integers(1, 40)
        size, is_gap = rng.integers(1, 12, n), rng.random(n) < 0.5
        order = np.lexsort((~is_gap, -size))
        size, is_gap = size[order], is_gap[order]
        gaps, items, alone, rest = best_fit_packing.matched(size, is_gap)
        left, wanted, none = [], [], []
        for i in range(n):  # the largest piece first takes the smallest gap
            if is_gap[i]:
                left.append(i)
            elif left:
                wanted.append((left.pop(), i))
            else:
                none.append(i)
        assert sorted(zip(gaps.tolist(), items.tolist())) == sorted(wanted) and alone.tolist() == none and rest.tolist() == left[::-1]


def test_packing_odd_documents(spark):
    schema = "doc_id long, text string, key string, piece string, extra int"
    rows = [(1, None, "k", "p", 1), (1, "", "k", "p", 1), (None, "a b", "k", "p", 1), (2, "word " * 5000, "k", "p", 1), (2, "word " * 5000, "k", "p", 1)]
    docs = spark.createDataFrame(rows, schema)
    out = best_fit_packing.packed_pieces(docs, token_pieces.vocabulary_path()).toPandas()
    assert len(out) == 3 + 2 * 3 and out.length.sum() == 1 + 1 + 3 + 2 * 5001
    held(out, 2048, 1.5)
    whole_ones = best_fit_packing.sequences(best_fit_packing.packed_pieces(docs, token_pieces.vocabulary_path())).collect()
    assert sum(r["n_tokens"] for r in whole_ones) == out.length.sum() and all(sum(len(p["ids"]) for p in r["pieces"]) == 4 * r["n_tokens"] for r in whole_ones)
    assert best_fit_packing.packed_pieces(docs.filter(F.lit(False)), token_pieces.vocabulary_path()).count() == 0
