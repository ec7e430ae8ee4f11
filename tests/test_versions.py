"""Numbers over ranges, logs of committed batches, and versions of a graph that outlive a failed update."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import versions


def test_numbers_follow_the_order_within_each_key(spark):
    rng = random.Random(1)
    rows = [(k, i) for k, n in (("hot", 3000), ("b", 5), (None, 7)) for i in range(n)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, i int").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = versions.numbered(table, ["i"], ["k"]).collect()
        alone = versions.numbered(table.filter("k = 'hot'"), ["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r["k"] or "", r["i"], r["seq"]) for r in got) == sorted((k or "", i, i + 1) for k, i in rows)
    assert all(r["seq"] == r["i"] + 1 for r in alone)
    assert versions.numbered(table.filter("false"), ["i"], ["k"]).count() == 0


def test_a_batch_is_there_once_it_is_committed(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    of = lambda *xs: spark.createDataFrame(list(xs), "g string, x int")
    assert versions.events(spark, log) is None
    assert versions.append(log, of(("a", 3), ("a", 1), ("b", 9)), "g", "x") == 1
    of(("a", 7)).withColumn("seq", F.lit(99).cast("long")).write.parquet(f"{log}/data/batch=half")
    assert sorted(tuple(r) for r in versions.events(spark, log).select("g", "x", "seq").collect()) == [("a", 1, 1), ("a", 3, 2), ("b", 9, 1)]
    assert versions.append(log, of(("a", 0), ("c", 5)), "g", "x") == 2
    assert sorted(tuple(r) for r in versions.events(spark, log).select("g", "x", "seq").collect()) == [("a", 0, 3), ("a", 1, 1), ("a", 3, 2), ("b", 9, 1), ("c", 5, 1)]
    with pytest.raises(Exception, match="(?i)exist"):  # the number is taken
        versions._commit(spark, log, 2, "other")


NODES = "id string, kind string, label string, path string, source_file string"


def prints(spark, rows, rules="r"):
    return spark.createDataFrame([(p, 1, h, rules) for p, h in rows], "path string, size long, hash string, rules string")


def test_updates_of_a_graph(spark, tmp_path):
    at, calls = f"file://{tmp_path}/graph", []
    paths = [f"src/f{i}.ts" for i in range(30)]
    links = [("e0", "file:0", "file:1", "depends_on")] + [(f"e{i}", f"file:{i}", f"file:{i + 1}", "depends_on") for i in range(10, 20)]

    def scan(label):
        def of(asked):
            calls.append(None if asked is None else sorted(r["path"] for r in asked.collect()))
            nodes = spark.createDataFrame([(f"file:{i}", "code_file", label, p, None) for i, p in enumerate(paths)], NODES)
            edges = spark.createDataFrame(links, "id string, src string, dst string, kind string")
            if asked is not None:
                nodes = nodes.join(asked, "path", "left_semi").select(*nodes.columns)
                own = nodes.select(F.col("id").alias("src"))
                edges = edges.join(own, "src", "left_semi").select(*edges.columns)
            return nodes, edges

        return of

    state = {p: "h" for p in paths}
    assert versions.snapshot(spark, at) is None
    assert versions.update(at, prints(spark, state.items()), scan("one")) == ("full", 1)
    assert versions.update(at, prints(spark, state.items()), scan("two")) == ("noop", 1) and calls == [None]
    state["src/f1.ts"] = "new"
    del state["src/f29.ts"]
    assert versions.update(at, prints(spark, state.items()), scan("two")) == ("incremental", 2)
    assert calls[-1] == ["src/f0.ts", "src/f1.ts"]  # f0 depends on f1
    now = versions.snapshot(spark, at)
    labels = {r["path"]: r["label"] for r in now["nodes"].collect()}
    assert labels == {p: "two" if p in ("src/f0.ts", "src/f1.ts") else "one" for p in paths[:29]}
    assert sorted(r["id"] for r in now["edges"].collect()) == sorted(x[0] for x in links)

    def broken(asked):
        nodes, edges = scan("three")(asked)
        lost = spark.range(1).select(F.lit("x").alias("id"), F.lit("y").alias("src"), F.lit("z").alias("dst"), F.raise_error(F.lit("disk lost")).cast("string").alias("kind"))
        return nodes, edges.unionByName(lost)  # the nodes have been written by then

    state["src/f5.ts"] = "newer"
    with pytest.raises(Exception):
        versions.update(at, prints(spark, state.items()), broken)
    assert versions.snapshot(spark, at)["version"] == 2 and {r["path"]: r["label"] for r in versions.snapshot(spark, at)["nodes"].collect()} == labels
    assert versions.update(at, prints(spark, state.items()), scan("three")) == ("incremental", 3)
    assert versions.update(at, prints(spark, state.items(), "other rules"), scan("four")) == ("full", 4)
    assert versions.snapshot(spark, at, 1)["nodes"].filter("label = 'one'").count() == 30
