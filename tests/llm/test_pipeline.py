"""The pipeline's stages against plain Python, one by one and as a whole."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import piece_codec, quality_rules
from eventloom.llm.common import written
from tests.llm.test_brute import WORD, water
from tests.llm.test_llm import ODD, SCHEMA, brute_counts, brute_dedup, brute_kept

SF = "/root/testdata/sf0.001"


def kept_by_rules(rows, rules):
    """Ids of the rows that the base rule and the learned list keep, from plain counts."""
    out = set()
    for i, t in rows:
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute_counts(t)
        words, lines = re.findall(WORD, t or ""), [x for x in (t or "").split("\n") if re.search(WORD, x)]
        f = {
            "n_words": n_words, "mean_word": word_chars / max(n_words, 1), "symbol_share": n_symbols / max(word_chars, 1), "dup_line_share": n_dup / max(len(lines), 1),
            "repeat_share": n_repeat / max(n_words, 1), "distinct_share": len(set(words)) / max(n_words, 1),
            "upper_share": sum(c.isupper() for c in t or "") / max(word_chars, 1), "line_words": n_words / max(len(lines), 1),
        }
        rejected = any(all((f[x.feature] > x.threshold) == x.above for x in rule) for rule in rules)
        if not (n_words < 10 or 100 * n_repeat > 20 * n_words or rejected):
            out.add(i)
    return out


def test_each_stage_is_what_plain_python_gives(spark):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    _, rules = quality_rules.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = written(stages["quality_rules"](spark, docs, SF), "good")
    assert {i for i, _ in rows(good)} == kept_by_rules(rows(docs), rules)
    alone = written(stages["shingle_neardup"](spark, good, SF), "alone")
    assert {i for i, _ in rows(alone)} == brute_kept(rows(good))
    cut = written(stages["substring_dedup"](spark, alone, SF), "cut")
    texts, digests = dict(rows(cut)), {i: (gone, sha) for i, _, gone, sha in brute_dedup(rows(alone))}
    for i, before in rows(alone):
        gone, sha = digests[i]
        assert texts.get(i, "") == before if not gone else hashlib.sha256(texts.get(i, "").encode()).hexdigest() == sha
    mixed = written(stages["source_mix"](spark, cut, SF), "mixed")
    of, size, taken = defaultdict(int), {}, defaultdict(int)
    for r in cut.collect():
        size[r["doc_id"]] = len(re.findall(WORD, r["text"] or ""))
        of[r["source"]] += size[r["doc_id"]]
    times = Counter(tuple(r) for r in mixed.collect())
    assert set(times) <= {tuple(r) for r in cut.collect()} and max(times.values()) <= 2
    for r, n in times.items():
        taken[r[mixed.columns.index("source")]] += n * size[r[0]]
    near = {s: abs(taken[s] - t) for s, t in water(of, 1.5 * sum(size.values())).items()}
    assert sum(near.values()) <= 0.01 * sum(size.values()), near  # few documents a source leave few sums
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.vocabulary_path())
    coded = stages["piece_codec"](spark, mixed, SF).collect()
    assert len(coded) == mixed.count() and all(r["token_ids"] == [*library.encode(r["text"] or ""), 2] and r["n_tokens"] == len(r["token_ids"]) for r in coded)
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r["doc_id"], r["text"], r["n_tokens"]) for r in whole.collect()) == Counter((r["doc_id"], r["text"], r["n_tokens"]) for r in coded)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_keeps_odd_rows_and_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = [F.lit("2020-01-01 00:00:00.123456").cast("timestamp").alias("at"), F.lit(1.5).alias("class_"), F.lit("x").alias("size"), F.create_map(F.lit("a"), F.lit(1)).alias("h"), F.col("doc_id").alias("root")]
    odd = spark.createDataFrame(ODD, SCHEMA).select("*", *extra)
    for docs in (odd, odd.limit(0), odd.unionByName(odd)):
        out = stage(spark, docs, SF)
        assert out.columns[:len(docs.columns)] == docs.columns
        for r in out.collect():
            assert (str(r["at"]), r["class_"], r["size"], r["h"], r["root"], r["row"]) == ("2020-01-01 00:00:00.123456", 1.5, "x", {"a": 1}, r["doc_id"], "r")


def test_the_entry_registers_it(spark):
    import __spark_entry__ as entry

    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert "pipeline" in entry.queries() and sorted(numbers) == list(range(1, 14))
