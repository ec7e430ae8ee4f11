"""Traversals and paths against plain Python on small graphs, and streams against their batch results."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.operators import paths as p
from eventloom.operators import runs as r
from eventloom.sources import workspace as w
from eventloom.streaming import folds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    kinds = ["symbol", "code_file", "community", "test", "doc_file", "config_file"]
    nodes = [(f"n{i:02d}", rng.choice(kinds), f"Thing{i} {rng.choice(['(class)', '(interface)', '(method)', ''])}", f"src/t{i}.ts") for i in range(30)]
    links = []
    for k in range(60):
        a, b = rng.sample(range(30), 2)
        links.append((f"e{k:02d}", f"n{a:02d}", f"n{b:02d}", rng.choice(["references", "depends_on", "inherits", "belongs_to", "related_to"]), rng.choice(["extracted", "inferred", "ambiguous"]), None))
    n = spark.createDataFrame(nodes, "id string, kind string, label string, path string").withColumn("slug", F.lit(None).cast("string")).withColumn("parent", F.lit(None).cast("string")).withColumn("source_file", F.lit(None).cast("string"))
    return n, spark.createDataFrame(links, "id string, src string, dst string, kind string, provenance string, relation string")


def walk(edges, seeds, budget, depth, mode):
    near = defaultdict(set)
    for e in edges:
        near[e["src"]].add(e["dst"])
        near[e["dst"]].add(e["src"])
    found, open_ = list(seeds), [(s, 0) for s in seeds]
    while open_ and len(found) < budget:
        at, d = open_.pop(0) if mode == "bfs" else open_.pop()
        if d >= depth:
            continue
        for b in sorted(near[at]):
            if b not in found and len(found) < budget:
                found.append(b)
                open_.append((b, d + 1))
    return found


@pytest.mark.parametrize("mode", ["bfs", "dfs"])
@pytest.mark.parametrize("budget,depth", [(12, 4), (40, 2), (40, 6), (1, 3)])
def test_neighbourhoods(graph, mode, budget, depth):
    nodes, edges = graph
    found, inner, truncated = p.neighbourhood(nodes, edges, ["n03", "n07"], budget=budget, depth=depth, mode=mode)
    want = walk(edges.collect(), ["n03", "n07"], budget, depth, mode)
    assert [x["id"] for x in found.orderBy("place").collect()] == want and truncated == (len(want) >= budget)
    assert {e["id"] for e in inner.collect()} == {e["id"] for e in edges.collect() if {e["src"], e["dst"]} <= set(want)}


def test_ranked_paths(graph):
    nodes, edges = graph
    steps = p.weighted(nodes, edges, intent="code_to_code")
    ways = defaultdict(list)
    for s in steps.collect():
        ways[s["a"]].append((s["b"], s["cost"] + float(s["penalty"]), (s["t"], s["structural"], s["hub"], s["inheritance"], 1)))
    best, queue = {}, [((0.0, 0, 0, 0, 0, 0), "n03")]
    while queue:  # Dijkstra over the whole rank
        rank, at = heapq.heappop(queue)
        if at in best:
            continue
        best[at] = rank
        for b, cost, more in ways[at]:
            heapq.heappush(queue, ((rank[0] + cost, *[x + y for x, y in zip(rank[1:], more)]), b))
    got = p.ranks(steps, "n03", most=30)
    found = {x["id"]: tuple(x["rank"]) for x in got.collect()}
    assert set(found) == set(best) and all(found[i][0] == pytest.approx(best[i][0]) and found[i][1:] == best[i][1:] for i in best)
    goal = max(best, key=lambda i: best[i][5])
    path = p.path_to(p.ranks(steps, "n03", most=30, goal=goal), goal)
    assert path[0]["id"] == "n03" and path[-1]["id"] == goal and len(path) == best[goal][5] + 1 and path[-1]["cost"] == pytest.approx(best[goal][0])
    assert p.path_to(got, "no such") is None
    told = p.explained(nodes, edges, path, intent="code_to_code")
    assert told.count() == len(path) and p.quality(told).first()["hops"] == max(1, len(path) - 1)


def test_named_paths(graph):
    nodes, edges = graph
    path, mode, intent = p.ranked_path(nodes, edges, "n03", "n07")
    assert path[0]["id"] == "n03" and path[-1]["id"] == "n07" and mode in p.MODES
    assert p.ranked_path(nodes, edges, "zzz qqq", "n07")[0] is None
    assert p.parse_mode(" Semantic ") == "semantic"
    with pytest.raises(ValueError):
        p.parse_mode("odd")


def test_components_cycles_and_levels(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("b", "a")], "src string, dst string")
    assert {x["id"] for x in p.component(e, "a").collect()} == set("abcd")
    assert {x["cycle"] for x in p.cycles(e, 4).collect()} == {"a>b", "a>b>c"}
    assert {x["id"]: x["level"] for x in p.levels(e).collect()} == {"a": None, "b": None, "c": None, "d": None, "x": 0, "y": 1}


def stream(spark, log, folder):
    """The log as a stream of files, in order."""
    parts = log.orderBy("graph_id", "seq").repartitionByRange(3, "seq")
    parts.write.parquet(str(folder))
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(query, folder, mode):
    query.writeStream.format("memory").queryName(folder).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return query.sparkSession.table(folder)


def test_streams_equal_their_batches(spark, tmp_path):
    log = w.run_log(spark, SF).withColumn("seq", F.col("seq").cast("long"))
    source = stream(spark, log, tmp_path / "log")
    got = drained(folds.spans(source), "spans_table", "append")
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in r.spans(log).select("graph_id", "node_id", "begin_seq", "end_seq", "status").collect()}
    states = drained(folds.node_states(stream(spark, log, tmp_path / "log2")), "states_table", "update")
    last = states.groupBy("graph_id", "node_id").agg(F.max_by("status", "seq").alias("status"))
    assert {tuple(x) for x in last.collect()} == {tuple(x) for x in r.fold_nodes(log).select("graph_id", "node_id", "status").collect()}
    kept = drained(folds.sampled(stream(spark, log, tmp_path / "log3")), "sampled_table", "append")
    assert kept.filter("kept_for IS NULL AND tools IS NOT NULL").count() == 0 and kept.count() == log.count()
    counts = drained(folds.duration_counts(stream(spark, log, tmp_path / "log4"), "duration_ms", [100, 1000]), "durations_table", "complete").first()
    assert counts["count"] == log.filter("duration_ms IS NOT NULL").count() and counts["le_1000"] == log.filter("duration_ms <= 1000").count()


def test_graphs_and_manifests_from_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": "1", "rules": "r", "files": [{"path": "a.ts", "size": 3, "hash": "h"}]}')
    (tmp_path / "old.json").write_text('{"version": "0", "rules": "r", "files": [{"path": "a.ts", "size": 3, "hash": "h"}]}')
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "kind": "symbol"}, {"id": "b", "kind": "test"}], "edges": [{"id": "e", "src": "a", "dst": "b"}]}')
    assert [tuple(x) for x in w.load_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a.ts", 3, "h", "r")]
    assert w.load_manifest(spark, str(tmp_path / "old.json")) is None and w.load_manifest(spark, str(tmp_path / "none.json")) is None
    nodes, edges = w.load_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.select("src", "dst").collect() == [("a", "b")]
