"""Preference pairs rendered for training.

A pair is two conversations, chosen and rejected. The turns that both begin with are the prompt and are rendered once; the
rest of each is its completion, in segments with a mask of 1 for what the assistant says (with its end mark) and 0 for
headers and other roles. Turns are brought together by one aggregation a conversation, and the common prefix is found by
array expressions.

Defined cases: a null role or text counts as empty; turns go by number, then by role and text, and exact repeats of a turn
are one turn; null turn numbers come first; a pair whose sides are equal has empty completions; a side without turns
completes with nothing; rows without an id take no part; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import table

#: The marks of a turn, as in the common chat format.
BEGIN, FINISH = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a conversation: its turns in order, as structs of turn, role and text."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    one = F.struct(F.col("turn"), empty("role"), empty("text"))
    return turns.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(one)).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(FINISH))


def segments(turns: Column) -> Column:
    """Text pieces with masks: each turn's header (0), then what it says with the end mark (1 for the assistant)."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.concat(F.lit(BEGIN), t["role"], F.lit("\n")).alias("text"), F.lit(0).alias("mask")),
        F.struct(F.concat(t["text"], F.lit(FINISH)).alias("text"), (t["role"] == "assistant").cast("int").alias("mask")),
    )))


def preferences(pairs: DataFrame) -> DataFrame:
    """From rows with arrays of turns ``chosen`` and ``rejected``: prompt_turns, prompt and the two masked completions."""
    differs = lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    # the first place where the sides differ; a side that has ended differs from any turn
    first = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(differs(a, b), F.lit(True))), True)
    n = F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int")
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0)))
    out = pairs.withColumn("prompt_turns", n)
    return out.select(
        *[c for c in pairs.columns if c not in ("chosen", "rejected")], "prompt_turns",
        F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("prompt_turns")), rendered), "").alias("prompt"),
        segments(rest("chosen")).alias("chosen"), segments(rest("rejected")).alias("rejected"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for a table that has no preferences: the rejected side keeps the first conv_id modulo n of the n turns and goes
    on as the conversation whose id differs in the lowest bit (as itself where there is none), so that sides part at every
    depth and may end at different lengths."""
    convs = conversations(turns)
    others = convs.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("turns").alias("other"))
    both = convs.join(others, "conv_id", "left").withColumn("other", F.coalesce("other", "turns"))
    both = both.withColumn("own", F.pmod(F.col("conv_id"), F.size("turns").cast("long")).cast("int"))
    rest = F.slice("other", F.col("own") + 1, F.greatest(F.size("other") - F.col("own"), F.lit(0)))
    return both.select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("own")), rest).alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences(neighbour_pairs(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    masked = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + F.when(x["mask"] == 1, F.length(x["text"])).otherwise(0)), F.lit(0))
    return pairs.select(
        "conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2(text("chosen"), 256).alias("chosen_sha256"), F.sha2(text("rejected"), 256).alias("rejected_sha256"),
        masked("chosen").cast("long").alias("chosen_masked_chars"), masked("rejected").cast("long").alias("rejected_masked_chars"),
    )


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM t),
k AS (SELECT DISTINCT conv_id, conv_id % m AS own, CASE WHEN xor(conv_id, 1) IN (SELECT conv_id FROM n) THEN xor(conv_id, 1) ELSE conv_id END AS other FROM n),
r AS (SELECT conv_id, i, role, text FROM n WHERE i <= conv_id % m
      UNION ALL SELECT k.conv_id, n.i, n.role, n.text FROM k JOIN n ON n.conv_id = k.other AND n.i > k.own),
j AS (SELECT conv_id, i, n.role AS crole, n.text AS ctext, r.role AS rrole, r.text AS rtext FROM n FULL JOIN r USING (conv_id, i)),
d AS (SELECT *, min(CASE WHEN crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext THEN i END) OVER (PARTITION BY conv_id) AS first,
             '<|im_start|>' || crole || chr(10) || ctext || '<|im_end|>' || chr(10) AS c, '<|im_start|>' || rrole || chr(10) || rtext || '<|im_end|>' || chr(10) AS x FROM j),
s AS (SELECT *, coalesce(i < first, TRUE) AS same FROM d)
SELECT conv_id, count(*) FILTER (same)::BIGINT AS prompt_turns,
       sha256(coalesce(string_agg(c, '' ORDER BY i) FILTER (same), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT same), '')) AS chosen_sha256,
       sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT same), '')) AS rejected_sha256,
       coalesce(sum(length(ctext) + 11) FILTER (NOT same AND crole = 'assistant'), 0)::BIGINT AS chosen_masked_chars,
       coalesce(sum(length(rtext) + 11) FILTER (NOT same AND rrole = 'assistant'), 0)::BIGINT AS rejected_masked_chars
FROM s GROUP BY conv_id
"""
