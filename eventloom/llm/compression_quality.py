"""Quality scores from compressed sizes under two zstandard dictionaries.

One dictionary holds good labelled texts, the other bad ones, as they are. A text is compressed with each; the difference
of the two sizes, relative to the text's own size, is its evidence, and a logistic curve fitted on other labelled texts
turns the evidence, as it is and scaled by the logarithm of the text's size, into a probability.

Defined cases: a null text counts as empty; an empty text has evidence zero; a null doc_id is scored and held out or not
by the crc32 of the empty text; repeated rows give repeated results; without labelled texts of both kinds the score is
the share of good labels (0.5 without any). Columns other than doc_id and text are never looked at. Labels that
contradict each other count as the lower one.

The fit reads a bounded sample: the first SAMPLE labelled rows of each kind in the order of a seeded hash of the id, as
far as their texts stay within SAMPLE_BYTES together. A labelled text of over TEXT_BYTES is left out of it; a kind with
longer texts alone is learnt from their beginnings. All other work covers every row and whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import remainder, table

#: Labelled rows of each kind that the fit may read, bytes of their texts together, and of one.
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 1500, 8 << 20, 1 << 17
#: Most bytes of a dictionary, and the compression level.
DICTIONARY_BYTES, LEVEL = 1 << 20, 12
THRESHOLD = 0.3


@dataclass
class Model:
    """Dictionaries by kind (None where there were too few texts), and the curve's weights."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def compressors(model: Model) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(model.good), _compressor(model.bad)


def evidence(texts: list[str | None], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """One row a text: (bad size - good size) / own size, and that difference by the logarithm of the own size."""
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        if text:
            raw = text.encode("utf-8", "surrogatepass")
            d = (len(bad.compress(raw)) - len(good.compress(raw))) / len(raw)
            out[i] = d, d * math.log2(1 + len(raw))
    return out


def _features(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0] * 10, x[:, 1]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a lightly penalised logistic curve."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """Whole texts, one after the other, as far as they fit; what comes last is the cheapest to point at."""
    kept, size = [], 0
    for t in texts:
        if size + len(t) < DICTIONARY_BYTES:
            kept.append(t)
            size += len(t) + 1
    return b"\n".join(kept)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learns from labelled rows that are not held out, at most ``sample`` of each kind."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    marks = marks.filter(remainder(F.col("doc_id")) != 0).withColumn("at", F.xxhash64(F.lit(seed), "doc_id"))
    shares = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    # a third of the sample's ids as a reserve, for ids without a text; 2 * sample ids are a fixed bound for the broadcast
    few = marks.filter("good = 1").orderBy("at").limit(sample).unionByName(marks.filter("good = 0").orderBy("at").limit(sample))
    rows = docs.select("doc_id", "text").filter("doc_id is not null and length(text) > 0")
    rows = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"), F.first("at").alias("at"))
    long = F.octet_length("text") > TEXT_BYTES
    rows = rows.withColumn("none_short", F.min(long.cast("int")).over(Window.partitionBy("good"))).filter(~long | (F.col("none_short") == 1))
    rows = rows.withColumn("text", F.when(long, F.substring("text", 1, TEXT_BYTES // 4)).otherwise(F.col("text")))  # a character is four bytes at most
    sofar = F.sum(F.octet_length("text")).over(Window.partitionBy("good").orderBy("at", "doc_id"))  # at most 2 * sample rows
    rows = sorted(rows.withColumn("sofar", sofar).filter(F.col("sofar") <= SAMPLE_BYTES).collect(), key=lambda r: (r["at"], r["doc_id"]))
    of = lambda good, part: [r["text"].encode("utf-8", "surrogatepass") for i, r in enumerate(r for r in rows if r["good"] == good) if i % 3 != 2 or not part]
    good, bad = _dictionary(of(1, True)), _dictionary(of(0, True))
    held = [r for kind in (0, 1) for i, r in enumerate(r for r in rows if r["good"] == kind) if i % 3 == 2]
    y = np.array([r["good"] for r in held], dtype=float)
    total = sum(shares.values())
    if not len(y) or y.min() == y.max():
        share = (shares.get(1, 0) + 0.5) / (total + 1) if total else 0.5
        return Model(b"", b"", (math.log(share / (1 - share)), 0.0, 0.0))
    x = _features(evidence([r["text"] for r in held], *compressors(Model(good, bad, ()))))
    w = _logistic(x, y)
    # the sample takes both kinds alike: move the curve to the shares among all labels
    w[0] += math.log((shares[1] / shares[0]) / (y.sum() / (len(y) - y.sum())))
    return Model(good, bad, tuple(w))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score to doc_id of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        good, bad = compressors(m)
        for texts in batches:
            z = _features(evidence([t if isinstance(t, str) else None for t in texts], good, bad)) @ np.array(m.weights)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.select("doc_id", F.pandas_udf(scores, "double")("text").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
