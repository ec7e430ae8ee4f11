"""Learned decision lists over text statistics, in Spark expressions only.

Sequential covering: each rule is a conjunction of thresholds grown on two thirds of the labelled rows and pruned on the
rest; rows that it covers leave, and the next rule is grown. Spark counts label by feature and bin, so the driver sees a
table of features times bins for each step, whatever the number of rows. The list becomes one ordered ``when`` expression.

Defined cases: a null or empty text has no words and fails the base rule; a doc_id that is null takes part; repeated rows
give repeated results; without labels of both kinds the list is empty and the base rule alone decides; columns of docs
other than doc_id and text are not looked at. Labels that contradict each other count as the lower one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import remainder, table, words_of, written

WINDOW = 5
#: Features that rules may use, from the counts of base_features().
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Test:
    """One threshold test: the feature is above (or at most) the threshold."""

    feature: str
    above: bool
    threshold: float

    def expr(self) -> Column:
        c = F.col(f"f_{self.feature}")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def base_features(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id with the word, symbol, line and repetition counts of each text; every step stays inside one row.
    carry: columns of docs to keep, as a struct ``row``.

    The 5-word windows of a text are compared by 64-bit hashes within that text alone: for a text of 20,000 words the
    chance of a false repeat is about 1e-11.
    """
    kept = ["row"] if carry else []
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), *([F.struct(*carry).alias("row")] if carry else []))
    rows = rows.select(
        "doc_id", *kept,
        words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
    )
    rows = rows.select(
        "doc_id", *kept, "n_symbols", "n_upper", "w",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct_words"),
    )
    window = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])
    rows = rows.select(
        *[c for c in rows.columns if c != "w"],
        F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), window)).alias("h"),
    )
    # windows with their places, sorted, so that equal ones are neighbours; only for texts that repeat any
    place = F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )
    rows = rows.select(*rows.columns, place.alias("s")).drop("h")
    same = lambda i, j: F.get("s", i)["x"] == F.get("s", j)["x"]
    repeated = F.sort_array(F.transform(
        F.filter(
            F.sequence(F.lit(0), F.size("s") - 1),
            lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
        ),
        lambda i: F.get("s", i)["i"],
    ))
    rows = rows.select(*rows.columns, F.when(F.col("s").isNotNull(), repeated).alias("r")).drop("s")
    # each repeated window covers up to the next one's start
    covered = F.aggregate(
        F.transform("r", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("r", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(
        "doc_id", *kept, F.col("n").cast("long").alias("n_words"), long("word_chars"), long("n_symbols"), long("n_dup_lines"),
        F.coalesce(F.when(F.col("r").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        long("n_lines"), long("n_distinct_words"), long("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_features(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[F.expr(c).cast("double").alias(f"f_{k}") for k, c in FEATURES.items()])


def _statistics(rows: DataFrame, bins: dict[str, list[float]]) -> dict[tuple[str, bool, int], tuple[int, int]]:
    """Bad and good rows by feature, grow or prune part and bin: one aggregation, a row for each bin."""
    bin_of = lambda k, cuts: F.aggregate(
        F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda a, c: a + (F.col(f"f_{k}") > c).cast("int"))
    each = rows.select("bad", "grow", F.explode(F.array(*[
        F.struct(F.lit(k).alias("feature"), bin_of(k, cuts).alias("bin")) for k, cuts in bins.items()])).alias("x"))
    found = each.groupBy("x.feature", "grow", "x.bin").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    return {(r["feature"], r["grow"], r["bin"]): (r["p"], r["n"]) for r in found}


def _best(stats: dict, bins: dict[str, list[float]], grow: bool, p0: int, n0: int) -> tuple[float, Test | None]:
    """The test with the largest information gain over (p0, n0)."""
    base, top = math.log2(p0 / (p0 + n0)), (0.0, None)
    for k, cuts in bins.items():
        cells = [stats.get((k, grow, b), (0, 0)) for b in range(len(cuts) + 1)]
        for i, cut in enumerate(cuts):
            for above, part in ((True, cells[i + 1:]), (False, cells[: i + 1])):
                p, n = sum(c[0] for c in part), sum(c[1] for c in part)
                if p and (gain := p * (math.log2(p / (p + n)) - base)) > top[0] + 1e-9:
                    top = (gain, Test(k, above, cut))
    return top


def learn(
    labelled: DataFrame, *, cuts: int = 24, max_rules: int = 8, max_tests: int = 3, min_precision: float = 0.8,
    min_cover: int = 3,
) -> list[list[Test]]:
    """Rules that reject, in order, from rows with f_* columns and label bad (0 or 1).

    A rule is kept if, on the rows held back for pruning (on the grown rows while fewer than min_cover are covered there),
    its share of bad rows is at least min_precision.
    """
    labelled = labelled.filter("bad in (0, 1)").withColumn("grow", remainder(F.col("doc_id"), 3) != 0)
    labelled = labelled.select("bad", "grow", *[f"f_{k}" for k in FEATURES])
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    # cut points come from the bad rows and from all rows, so that a rare kind of bad row has its own
    found = labelled.agg(*[F.percentile_approx(c, shares, 2000).alias(f"{k}_{kind}")
                           for k in FEATURES for kind, c in (("all", F.col(f"f_{k}")), ("bad", F.when(F.col("bad") == 1, F.col(f"f_{k}"))))]).first()
    bins = {k: sorted({x for kind in ("all", "bad") for x in found[f"{k}_{kind}"] or []}) for k in FEATURES}
    bins = {k: [(x + y) / 2 for x, y in zip(v, v[1:])] for k, v in bins.items()}  # midway, so no rule hugs a value seen
    bins = {k: v for k, v in bins.items() if v}
    rules, rest = [], labelled
    while bins and len(rules) < max_rules:
        rule: list[Test] = []
        part = rest
        stats = _statistics(part, bins)
        for _ in range(max_tests):
            some = next(iter(bins))
            p0 = sum(v[0] for (k, g, _), v in stats.items() if k == some and g)
            n0 = sum(v[1] for (k, g, _), v in stats.items() if k == some and g)
            if p0 < min_cover or not n0:
                break
            _, test = _best(stats, bins, True, p0, n0)
            if test is None:
                break
            rule.append(test)
            part = part.filter(test.expr())
            stats = _statistics(part, bins)
        if not rule:
            break
        # prune: the shortest prefix of the conjunction that does best on the rows held back
        counts = rest.agg(*[
            F.count(F.when(_all(rule[:i]) & (F.col("grow") == g) & (F.col("bad") == b), 1)).alias(f"c{i}_{int(g)}_{b}")
            for i in range(1, len(rule) + 1) for g in (True, False) for b in (0, 1)]).first()
        at = lambda i, g: (counts[f"c{i}_{int(g)}_1"], counts[f"c{i}_{int(g)}_0"])
        worth = lambda p, n: (p - n) / (p + n) if p + n else -1.0
        keep = max(range(1, len(rule) + 1), key=lambda i: (worth(*at(i, False)), -i))
        p, n = at(keep, False)
        if p + n < min_cover:
            p, n = at(keep, True)
        if p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(rule[:keep])
        rest = rest.filter(~_all(rule[:keep]))
    return rules


def _all(rule: list[Test]) -> Column:
    out = rule[0].expr()
    for t in rule[1:]:
        out = out & t.expr()
    return out


def verdict(rules: list[list[Test]]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects; a row that none covers is kept."""
    out = F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules):
        out = out.when(_all(rule), F.lit(i + 1))
    return out


def learned(docs: DataFrame, labels: DataFrame, **learning) -> tuple[DataFrame, list[list[Test]]]:
    """The counts of all documents, written, and the rules learned from those that labels mark."""
    counts = written(with_features(base_features(docs)), "quality_counts")
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    labelled = counts.filter(~base_failed()).join(marks, "doc_id")
    return counts, learn(written(labelled, "quality_labelled"), **learning)


def judged(counts: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """Adds base_failed, rule (0: base rule, 1..: learned rule that rejects, null: none) and kept."""
    out = counts.withColumn("rule", verdict(rules)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.col("rule").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(*learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the learned list keeps, with all their columns."""
    _, rules = learned(docs, table(spark, sf_dir, "labels"))
    rows = judged(with_features(base_features(docs, carry=docs.columns)), rules)
    # a column that isn't deterministic keeps the filter above the counts: pushed below, it would count anew for each word
    return rows.withColumn("barrier", F.monotonically_increasing_id()).filter("kept AND barrier >= 0").select(*[F.col("row")[c].alias(c) for c in docs.columns])
