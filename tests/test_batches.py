"""Many queries, paths and plans at once, against plain Python and against one at a time."""

import heapq
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from eventloom.operators import batches, code, docs, paths, runs
from eventloom.plans import paths as plans
from eventloom.session import kept
from eventloom.sources import workspace as w

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    n, e = plans.graph(spark, SF)
    return kept(n.orderBy("id").limit(400), "few_nodes"), e


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def bfs(edges, seeds, budget, depth):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, level = list(dict.fromkeys(seeds)), list(dict.fromkeys(seeds))
    for _ in range(depth):
        new = []
        for a in level:
            for b in sorted(near.get(a, ())):
                if b not in found and len(found) < budget:
                    found.append(b)
                    new.append(b)
        level = new
    return {(i, p) for p, i in enumerate(found)}


@pytest.mark.parametrize(("budget", "depth"), [(7, 3), (40, 2), (2, 2)])
def test_neighbourhoods_of_many_queries(spark, budget, depth):
    edges = random_edges(1, 30, 60)
    seeds = {"a": ["n1"], "b": ["n2", "n9", "lost"], "c": ["n1", "n1"], "d": ["lost"]}
    rows = [(q, i, p) for q, ids in seeds.items() for p, i in enumerate(dict.fromkeys(ids))]
    found = batches.neighbourhoods(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(rows, "query_id string, id string, place int"), budget=budget, depth=depth).collect()
    for q, ids in seeds.items():
        assert {(r["id"], r["place"]) for r in found if r["query_id"] == q} == bfs(edges, ids, budget, depth)


def least(steps, start):
    """Dijkstra by (cost, tests, structural, hubs, inheritance, hops)."""
    best, queue = {}, [((0.0, 0, 0, 0, 0, 0), start)]
    while queue:
        rank, at = heapq.heappop(queue)
        if at in best:
            continue
        best[at] = rank
        for a, b, _, cost, penalty, t, structural, hub, inheritance in steps:
            if a == at and b not in best:
                heapq.heappush(queue, ((rank[0] + cost + penalty, rank[1] + t, rank[2] + structural, rank[3] + hub, rank[4] + inheritance, rank[5] + 1), b))
    return best


def test_ranks_and_paths_of_many_cases(spark):
    rng = random.Random(3)
    steps = [(a, b, f"e{i}", float(rng.randrange(1, 4)), float(rng.randrange(2)), rng.randrange(2), rng.randrange(2), rng.randrange(2), rng.randrange(2)) for i, (a, b) in enumerate(random_edges(2, 15, 45)) if a != b]
    schema = "a string, b string, edge string, cost double, penalty double, t int, structural int, hub int, inheritance int"
    table = spark.createDataFrame(steps, schema).withColumn("how", F.lit("x"))
    tries = [(1, 0, "x", "n1", None), (2, 0, "x", "n2", None), (2, 1, "x", "n3", "n7"), (3, 0, "x", "n1", "lost"), (4, 0, "other", "n1", None)]
    best = kept(batches.ranks_of(table, spark.createDataFrame(tries, "case_id int, pair int, how string, a string, b string"), most=15), "best")
    rows = best.collect()
    for case, pair, how, start, goal in tries:
        wanted = least(steps, start) if how == "x" else {start: (0.0, 0, 0, 0, 0, 0)}
        got = {r["id"]: tuple(r["rank"]) for r in rows if (r["case_id"], r["pair"]) == (case, pair)}
        if goal is None or goal == "lost":
            assert got == wanted
        else:
            assert got[goal] == wanted[goal] and all(got[i] == wanted[i] for i in got if wanted[i] < wanted[goal])
    goals = [(1, 0, i) for i in sorted(least(steps, "n1"))[-1:]] + [(2, 1, "n7")]
    path = batches.traced(best, spark.createDataFrame(goals, "case_id int, pair int, id string")).orderBy("case_id", "hop").collect()
    cost = {s[2]: s for s in steps}
    for case, pair, goal in goals:
        own = [r for r in path if r["case_id"] == case]
        assert own[-1]["id"] == goal and own[0]["edge"] is None and [r["hop"] for r in own] == list(range(len(own)))
        assert all(cost[r["edge"]][:2] == (p["id"], r["id"]) for p, r in zip(own, own[1:]))
        assert own[-1]["cost"] == sum(cost[r["edge"]][3] + cost[r["edge"]][4] for r in own[1:])


def test_queries_at_once_equal_queries_one_by_one(spark, graph):
    nodes, _ = graph
    asked = ["order service architecture", "OrderService1.ts", "a", "user-controller", "how does payment work", "zzqx", "workspace", "src/components/m1", "_", "Repository3"]
    queries = spark.createDataFrame([(t, t, m) for t in asked for m in ("balanced",)], "query_id string, query string, requested string")
    seeds, named = code.seeds_of(nodes, queries).collect(), code.candidates_of(nodes, queries.drop("requested"), 3).collect()
    for t in asked:
        assert [(r["id"], r["place"], r["score"]) for r in sorted(seeds, key=lambda r: r["place"]) if r["query"] == t] == [(r["id"], r["place"], r["score"]) for r in code.seeds(nodes, t).orderBy("place").collect()]
        assert [(r["id"], r["score"], r["reason"]) for r in sorted(named, key=lambda r: r["place"]) if r["query"] == t] == [(r["id"], r["score"], r["reason"]) for r in code.candidates(nodes, t, 3).orderBy(F.desc("score"), "label", "id").collect()]


def test_levels_of_long_chains_and_of_many_graphs(spark):
    chain = [("g", f"c{i:03}", f"c{i + 1:03}") for i in range(25)] + [("h", "c001", "c000"), ("h", "c000", "c001"), ("h", "c001", "x")]
    edges = spark.createDataFrame(chain, "graph string, src string, dst string")
    found = {(r["graph"], r["id"]): r["level"] for r in paths.levels(edges, ("graph",)).collect()}
    assert found == {("g", f"c{i:03}"): i for i in range(26)} | {("h", x): None for x in ("c000", "c001", "x")}
    assert {r["id"] for r in paths.levels(edges.filter("graph = 'g'")).collect() if r["level"] is None} == set()


def test_plan_faults(spark):
    plans_ = {"fine": ["", "n0", "n0,n1"], "cycle": ["n1", "n0"], "behind": ["", "n2", "n1", "n2"], "missing": ["", "n9"], "empty_root": ["", ""]}
    rows = [(g, f"n{i}", f"t{i}", need, "do the thing", "artifact", 1) for g, needs in plans_.items() for i, need in enumerate(needs)] + [("bad", "n0", "t", "", " short ", "a", 1), ("bad", "n1", "t", "n0", None, "", 0)]
    found = runs.plan_faults(spark.createDataFrame(rows, "graph_id string, node_id string, title string, needs string, intent string, artifact string, criteria int"), 3).collect()
    assert {(r["graph_id"], r["fault"]) for r in found} == {("cycle", "cyclic"), ("cycle", "no_root"), ("cycle", "unreachable"), ("behind", "cyclic"), ("behind", "unreachable"), ("behind", "too_many_nodes"),
                                                           ("missing", "cyclic"), ("missing", "unreachable"), ("bad", "titles_repeat"), ("bad", "vague_intent"), ("bad", "invalid_contract")}


def test_links_to_long_paths_and_repairs_of_common_names(spark):
    far = "/".join(["d"] * 6000) + "/x.md"
    link = spark.createDataFrame([("a.md", 1, "link", 0, f"/{far}", None, None)], "path string, line int, kind string, n int, target string, anchor string, section string")
    files = spark.createDataFrame([(far,)], "path string")
    heads = spark.createDataFrame([], "path string, slug string")
    assert docs.resolved(link, files, heads).first()["file"] == far
    many = [f"f{i:02}/readme.md" for i in range(30)]
    broken = spark.createDataFrame([("a.md", 1, "F07/README.md", "missing_file"), ("a.md", 2, "gone/readme.md", "missing_file")], "path string, line int, target string, reason string")
    got = {r["line"]: (r["file"], r["score"], r["ambiguous"]) for r in docs.repairs(broken, spark.createDataFrame([(m,) for m in many], "path string")).collect()}
    assert got == {1: ("f07/readme.md", 0.92, False), 2: ("f00/readme.md", 0.45, True)}


def little_graph(spark, seed):
    """Nodes of kinds that paths avoid and prefer, parallel edges, loops, and a part of its own."""
    rng = random.Random(seed)
    nodes = [(f"n{i:02}", rng.choice(("symbol", "symbol", "code_file", "code_file", "test", "community", "doc_file")), f"Thing{i} {rng.choice(('(class)', '(method)', ''))}", f"src/t{i}.ts") for i in range(40)]
    links = [(*rng.sample(range(32), 2),) if k % 9 else (k % 32, k % 32) for k in range(90)] + [(33, 34), (34, 35), (35, 33)]
    rows = [(f"e{k:03}", f"n{a:02}", f"n{b:02}", rng.choice(("references", "depends_on", "inherits", "belongs_to", "tests")), rng.choice(("extracted", "manual", "ambiguous")), rng.choice((None, "calls", "constructor", "uses"))) for k, (a, b) in enumerate(links)]
    n = spark.createDataFrame(nodes, "id string, kind string, label string, path string")
    return kept(n, "n"), kept(spark.createDataFrame([*rows, ("lost", "n01", "gone", "references", "manual", None)], "id string, src string, dst string, kind string, provenance string, relation string"), "e")


@pytest.mark.parametrize("most", [12, 2])
def test_least_paths_lie_in_their_corridor(spark, most):
    nodes, edges = little_graph(spark, 5)
    steps = paths.Steps(nodes, edges)
    tries = [(i, i % 2, f"n{3 * i % 31:02}", f"n{7 * i % 29 + 1:02}") for i in range(9)] + [(9, 0, "n01", "n34"), (10, 0, "n33", "n35"), (11, 0, "n01", "n39")]
    rows = [(case, pair, f"{m}|code_to_code", m, "code_to_code", a, b) for case, pair, a, b in tries if a != b for m in (("balanced", "semantic")[case % 2],)]
    asked = kept(spark.createDataFrame(rows, "case_id int, pair int, how string, mode string, intent string, a string, b string"), "tries")
    every = kept(reduce(lambda x, y: x.unionByName(y), [steps(m, "code_to_code").withColumn("how", F.lit(f"{m}|code_to_code")) for m in ("balanced", "semantic")]), "all")
    goals = asked.select("case_id", "pair", F.col("b").alias("id"))
    found = []
    for best in (batches.ranks_of(every, asked.select("case_id", "pair", "how", "a", "b"), most=most), batches.least_ranks(steps, asked, most=most)):
        best = kept(best, "best")
        ends = {(r["case_id"], tuple(r["rank"])) for r in best.join(goals, ["case_id", "pair", "id"]).collect()}
        found.append((ends, {(r["case_id"], r["hop"], r["id"], r["edge"], r["cost"]) for r in batches.traced(best, goals).collect()}))
    assert found[0] == found[1] and most / 4 <= len(found[0][0]) < len(rows)
    if most == 12:
        ids, met, left = batches.corridor(steps, asked, [("balanced", "code_to_code"), ("semantic", "code_to_code")])
        assert left.isEmpty() and {r["case_id"] for r in met.collect()} == {x[0] for x in found[0][0]}
        assert ids.count() < 2 * nodes.count()


def test_a_path_benchmark_neither_weighs_all_edges_nor_repeats_a_search(spark, monkeypatch):
    nodes, edges = little_graph(spark, 5)
    rows = [(name, "n02", "n20", "balanced", "(?i)thing", "(?i)thing", None, [], [], []) for name in ("one", "two", "three")]
    cases = spark.createDataFrame(rows, "case_id string, source string, target string, mode string, from_pattern string, to_pattern string, path_pattern string, forbidden array<string>, required array<string>, preferred array<string>")
    searched, real = [], batches.corridor
    monkeypatch.setattr(batches, "corridor", lambda steps, tries, *x: searched.append(tries.count()) or real(steps, tries, *x))
    monkeypatch.setattr(paths.Steps, "__call__", None)
    for name in ("slug", "parent", "source_file"):
        nodes = nodes.withColumn(name, F.lit(None).cast("string"))
    got = batches.path_benchmark(nodes, edges, cases, paths.steps_by(nodes, edges)).collect()
    assert {(r["passed"], r["fault"]) for r in got} == {(True, None)} and len({r["path"] for r in got}) == 1 and len(got) == 3
    assert searched and set(searched) == {1}


def test_few_words_are_looked_up_without_an_index_of_letters(spark, monkeypatch):
    nodes = w.nodes(spark, SF)
    queries = spark.createDataFrame([("a", "order service"), ("b", "OrderService1.ts"), ("c", "user")], "query_id string, query string")
    rows = lambda: {(r["id"], r["query_id"]) for r in code.holding(nodes, queries).collect()}
    few = rows()
    assert "sequence" not in code.holding(nodes, queries)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(code, "FEW_WORDS", 0)
    assert few == rows() and len(few) > 3
