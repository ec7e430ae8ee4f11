"""Work that must not grow faster than its input: hubs, popular items and long lists against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from eventloom import session
from eventloom.operators import code, graph, paths, runs, vectors, workspace
from eventloom.operators import product as p
from eventloom.plans import code as code_plans
from eventloom.plans import product as product_plans
from eventloom.plans import reports as report_plans
from eventloom.plans import runs as run_plans
from eventloom.sources import views
from eventloom.sources import workspace as w

NODE, EDGE = "id string, kind string, title string, status string, tests int, scanned boolean, made string", "id string, src string, dst string, kind string, trust string, made string"
SF = "/root/testdata/sf0.001"


def product_graph(spark):
    """Ten tasks of two runs each; the runs meet one evidence, which has thirty test results; code that two runs touched."""
    nodes = [(f"t{i}", "task", "completed") for i in range(10)] + [(f"r{i}", "agent_run", "completed") for i in range(4)] + [("e", "evidence", "completed"), ("lone", "task", "completed")]
    nodes += [(f"x{i}", "test_result", "completed") for i in range(30)] + [(f"c{i}", "code_file", "completed") for i in range(5)] + [(f"i{i}", "requirement", "planned") for i in range(7)]
    edges = [(f"t{i}", f"r{i % k}", "produced_by") for i in range(10) for k in (3, 4)] + [(f"r{i}", "e", "produced_by") for i in range(3)] + [(f"x{i}", "e", "verifies") for i in range(30)] + [(f"r{i}", f"x{i}", "produced_by") for i in range(4)]
    edges += [(f"r{i}", f"c{j}", "touches") for i in range(4) for j in range(4) if (i + j) % 3 == 0] + [(f"t{i}", f"i{i % 5}", "implements") for i in range(0, 10, 2)] + [("r1", "i6", "verifies"), ("c4", "i5", "satisfies"), ("t1", "c2", "touches"), ("t1", "c4", "depends_on"), ("t0", "x7", "verifies")]
    n = spark.createDataFrame([(i, k, i, s, 0, False, "1995-01-01") for i, k, s in nodes], NODE)
    return n, spark.createDataFrame([(f"l{k}", *e, "manual", "1995-01-01") for k, e in enumerate(edges)], EDGE), dict((i, k) for i, k, _ in nodes), edges


def near(kind, edges, at, kinds, wanted):
    return {b for s, d, k in edges for a, b in ((s, d), (d, s)) if a == at and k in kinds and kind[b] in wanted}


def behind(kind, edges):
    """Of each code node its runs, tasks and intents."""
    out = {}
    for c in (x for x in kind if kind[x] == "code_file"):
        runs = near(kind, edges, c, ("touches",), ("agent_run",))
        tasks = near(kind, edges, c, p.AREA_LINKS, ("task",)).union(*[near(kind, edges, r, ("produced_by",), ("task",)) for r in runs])
        intents = near(kind, edges, c, p.INTENT_LINKS, p.ANCHORS).union(*[near(kind, edges, r, ("produced_by", "verifies"), p.ANCHORS) for r in runs], *[near(kind, edges, t, p.INTENT_LINKS, p.ANCHORS) for t in tasks])
        out[c] = (len(runs), len(tasks), len(intents))
    return out


def test_union_sizes_count_each_item_once(spark):
    have = [(a, b) for a, bs in {"hub": range(40), "small": (3, 50), "more": (50, 51, 2), "single": (60,)}.items() for b in bs]
    want = {"one": ["hub"], "both": ["hub", "small"], "all": ["hub", "small", "more", "single"], "few": ["small", "more"], "none": ["lost"]}
    got = p.union_sizes(spark.createDataFrame([(t, a) for t, xs in want.items() for a in xs], "task string, a string"), spark.createDataFrame(have + have[:3], "a string, b int"))
    lists = defaultdict(set)
    for a, b in have:
        lists[a].add(b)
    assert {r["task"]: r["n"] for r in got.collect()} == {t: len(set().union(*[lists[a] for a in xs])) for t, xs in want.items() if t != "none"}


def test_test_results_behind_a_hub_are_counted(spark):
    n, e, kind, edges = product_graph(spark)
    for r in p.test_evidence(n, e).collect():
        runs = near(kind, [x for x in edges if x[0] == r["task"]], r["task"], ("produced_by",), ("agent_run",))
        evidence = set().union(*[near(kind, edges, x, ("produced_by",), ("evidence",)) for x in runs])
        results = set().union(*[near(kind, edges, x, ("verifies", "produced_by"), ("test_result",)) for x in {r["task"]} | runs | evidence])
        assert (r["runs"], r["evidence"], r["results"]) == (len(runs), len(evidence), len(results))


def test_a_summary_counts_no_test_results(spark, monkeypatch):
    n, e, _, _ = product_graph(spark)
    rows = p.test_evidence(n, e).collect()
    monkeypatch.setattr(p, "test_evidence", None)
    monkeypatch.setattr(p, "union_sizes", None)
    got = p.execution_summary(n, e).first()
    assert (got["completed"], got["missing_run"], got["missing_evidence"], got["with_evidence"], got["missing_tests"]) == (
        11, sum(r["runs"] == 0 for r in rows), sum(r["evidence"] == 0 for r in rows), sum(r["linked"] for r in rows), sum(r["gap"] for r in rows))


def test_tasks_and_intents_of_code_are_counted_once(spark, monkeypatch):
    n, e, kind, edges = product_graph(spark)
    used, real = [], p.union_sizes
    monkeypatch.setattr(p, "union_sizes", lambda *x: used.append(1) or real(*x))
    assert {r["code"]: (r["runs"], r["tasks"], r["intents"]) for r in p.code_intent(n, e).collect()} == behind(kind, edges)
    assert len(used) == 2


def test_drift_of_intent_counts_none(spark, monkeypatch):
    n, e, kind, edges = product_graph(spark)
    monkeypatch.setattr(p, "code_intent", None)
    rows = [x for x in behind(kind, edges).values() if x[0]]
    assert tuple(p.intent_drift(n, e).first()) == (len(rows), sum(x[2] > 0 for x in rows), sum(x[2] == 0 for x in rows))


def test_code_looks_up_the_ends_of_its_edges_once(spark, monkeypatch):
    n, e, kind, edges = product_graph(spark)
    names, keep = [], p.kept
    monkeypatch.setattr(p, "kept", lambda df, name: (names.append((name, plan(df).count("Join"))), keep(df, name))[1])
    monkeypatch.setattr(p, "beside", None)
    gone = spark.createDataFrame([("g1", "lost", "c1", "touches", "manual", "1995-01-01"), ("g2", "t1", "lost", "implements", "manual", "1995-01-01")], EDGE)
    rows = behind(kind, edges)
    assert {r["code"]: (r["runs"], r["tasks"], r["intents"]) for r in p.code_intent(n, e.unionByName(gone)).collect()} == rows
    assert dict(names)["role_links"] == 2 and all(dict(names)[x] == 0 for x in ("code_runs", "run_tasks", "task_intents", "code_tasks"))
    changed = [x for x in rows.values() if x[0]]
    assert tuple(p.intent_drift(n, e.unionByName(gone)).first()) == (len(changed), sum(x[2] > 0 for x in changed), sum(x[2] == 0 for x in changed))


def test_intent_of_code_writes_no_whole_edges(spark, monkeypatch):
    names, keep = [], session.kept
    for module in (p, product_plans):
        monkeypatch.setattr(module, "kept", lambda df, name: (names.append(name), keep(df, name))[1])
    for query in (product_plans.code_intent, product_plans.intent_drift, product_plans.product_adjacency):
        assert query(spark, SF).count()
    assert "product_edges" not in names and "role_links" in names


def test_lists_of_edges_are_numbered_where_their_ends_are_looked_up(spark):
    n, e, _, edges = product_graph(spark)
    gone = spark.createDataFrame([("g1", "lost", "c1", "touches", "manual", "1994-01-01"), ("g2", "t1", "lost", "implements", "manual", "1994-01-01")], EDGE)
    want = {(end, way, x): k + 1 for i, way in ((1, "in"), (0, "out")) for end in {y[i] for y in edges} for k, x in enumerate(sorted(f"l{j}" for j, y in enumerate(edges) if y[i] == end))}
    rows = p.adjacency(session.kept(e.unionByName(gone), "edges"), n)
    assert plan(rows).count("Exchange hashpartitioning") == 5  # edges and nodes, by source and by target, and edges by source again
    assert {(r["node"], r["way"], r["id"]): r["place"] for r in rows.collect()} == want
    assert {(r["node"], r["way"], r["id"]): r["place"] for r in p.adjacency(e).collect()} == want


def test_the_gate_computes_its_summaries_once(spark, monkeypatch):
    n, e, _, _ = product_graph(spark)
    names, real = [], p.kept
    monkeypatch.setattr(p, "kept", lambda df, name: names.append(name) or real(df, name))
    p.gate(n, e).collect()
    assert names.count("gate_execution") == names.count("gate_freshness") == 1


def test_similar_sources_leave_their_task_alone(spark):
    have = {f"s{i}": {f"p{(i * k) % 23}" for k in range(1, 2 + i % 6)} | ({"hub"} if i % 2 else set()) for i in range(40)}
    e = spark.createDataFrame([(a, b, "k") for a, bs in have.items() for b in sorted(bs)], "src string, dst string, kind string")
    want = {(a, b, len(have[a] & have[b])) for a in have for b in have if a < b and round(len(have[a] & have[b]) / len(have[a] | have[b]), 6) >= 0.5}
    for longest in (64, 2, 0):  # as lists, both ways, as rows
        rows = graph.jaccard_neighbours(e, "k", 0.5, longest).collect()
        assert len(rows) == len(want) and {(r["a"], r["b"], r["common"]) for r in rows} == want


def test_lists_of_targets_move_once(spark, monkeypatch):
    have = {f"s{i}": {f"p{(i * k) % 23}" for k in range(1, 2 + i % 6)} | {"hub"} for i in range(40)}
    e = spark.createDataFrame([(a, b, "k") for a, bs in have.items() for b in sorted(bs)], "src string, dst string, kind string")
    rows = graph.jaccard_neighbours(e, "k", 0.5)
    one = plan(rows)
    assert one.count("Join") == 3 and one.count("Exchange hashpartitioning") <= 3  # popular targets (sent to both sides), both sides, and the pairs
    want = {(a, b, len(have[a] & have[b])) for a in have for b in have if a < b and round(len(have[a] & have[b]) / len(have[a] | have[b]), 6) >= 0.5}
    assert {(r["a"], r["b"], r["common"]) for r in rows.collect()} == want
    monkeypatch.setattr(graph, "TILE", 4)  # a popular target in tiles
    assert {(r["a"], r["b"], r["common"]) for r in graph.jaccard_neighbours(e, "k", 0.5).collect()} == want


def test_a_mix_of_communities_needs_no_edge_ids(spark):
    kinds = [("community", "c0"), ("community", "c1"), *[("symbol", f"s{i}") for i in range(9)], ("external_dep", "x"), ("external_dep", "y")]
    n = spark.createDataFrame([(i, k, None) for k, i in kinds], "id string, kind string, path string")
    pick = random.Random(4)
    home = {f"s{i}": f"c{i % 2}" for i in range(7)} | {"x": "c1", "c0": "c0", "c1": "c1"}
    rows = [(a, c, "belongs_to", "manual", None) for a, c in home.items() if a != c]
    rows += [(pick.choice(kinds)[1], pick.choice(("gone", *[i for _, i in kinds])), pick.choice(("depends_on", "references")), pick.choice(("extracted", "inferred", "ambiguous", None)), pick.choice((None, "calls", "contains"))) for _ in range(80)]
    got = workspace.community_mix(n, spark.createDataFrame(rows, "src string, dst string, kind string, provenance string, relation string"))
    for r in got.collect():
        mine = [x for x in rows if r["community"] in (home.get(x[0]), home.get(x[1]))]
        assert tuple(r)[1:6] == (len(mine), *[sum(x[3] == v for x in mine) for v in ("extracted", "inferred", "ambiguous", "manual")])
        semantic = sum(x[4] == "calls" or x[4] is None and x[2] in ("depends_on", "references") for x in mine)
        assert tuple(r)[6:] == (sum(x[2] == "depends_on" for x in mine), semantic, sum(x[1] in ("x", "y") for x in mine))
    assert {r["community"] for r in got.collect()} == {"c0", "c1"}


def test_steps_of_paths_join_their_ends_once(spark):
    steps = paths.weighted(w.nodes(spark, SF), w.edges(spark, SF), intent="code_to_code")
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") <= 4 and "Union" not in plan.split("Join")[0]


def test_levels_write_their_edges_once(spark, monkeypatch):
    written, real = [], paths.kept
    monkeypatch.setattr(paths, "kept", lambda df, name: written.append(df.columns) or real(df, name))
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "x"), ("x", "y"), ("q", "r"), ("r", "q"), ("a", "q")]
    got = paths.levels(spark.createDataFrame(e + e[:2], "src string, dst string"))
    assert {r["id"]: r["level"] for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "q": None, "r": None}
    assert sum("src" in c for c in written) == 1


def test_code_map_edges_are_not_written_first(spark, monkeypatch):
    monkeypatch.setattr(report_plans, "graph", None)
    assert report_plans.code_map_edges(spark, SF).count() == w.edges(spark, SF).count()


def test_drift_scores_are_mean_cosines(spark, monkeypatch):
    calls, real = [], vectors.cosine
    monkeypatch.setattr(vectors, "cosine", lambda a, b: calls.append(1) or real(a, b))
    rows = [(1, "k", [1.0, 2.0]), (2, "k", [0.0, 0.0]), (3, "k", [1.0]), (4, "k", None), (5, "none", [1.0, 0.0]), (6, None, [1.0, 0.0]), (7, "k", [-3.0, 1.0]), (7, "m", [2.0, 2.0])]
    criteria = [("k", [1.0, 0.0]), ("k", [0.0, 0.0]), ("k", [3.0, 4.0]), ("k", [2.0]), ("k", None), ("m", [0.0, 1.0])]
    outputs = spark.createDataFrame([(*r, [0.0, 1.0] if r[0] == 6 else None) for r in rows], "vec_id long, key string, embedding array<double>, goal array<double>")
    got = {(r["vec_id"], r["key"]): r["score"] for r in vectors.drift_scores(outputs, spark.createDataFrame(criteria, "key string, criterion array<double>"), "key").collect()}

    def cos(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) if a and b and len(a) == len(b) else 0
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    for i, key, _ in rows:
        found = [cos(a, c) for v, k, a in rows for q, c in criteria if v == i and k == q]
        want = sum(found) / len(found) if found else 0.0 if i == 6 else 0.7
        assert abs(got[i, key] - want) < 1e-12, (i, key)
    assert len(calls) == 1  # with the goal; criteria are met as a sum


def test_names_are_looked_up_in_one_pass(spark, monkeypatch):
    n = w.nodes(spark, SF)
    want = {(t, r["id"], r["score"], r["reason"]) for t in code_plans.NAMED for r in code_plans.c.candidates(n, t, 3).collect()}
    monkeypatch.setattr(code_plans.c, "candidates", None)
    assert {tuple(r) for r in code_plans.name_candidates(spark, SF).collect()} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_tables_are_not_sent_to_every_executor(spark):
    nodes, edges = w.nodes(spark, SF), w.edges(spark, SF)
    assert "Broadcast" not in plan(edges)
    queries = spark.createDataFrame([(0, "order service", "balanced")], "query_id int, query string, requested string")
    found = plan(code.holding(nodes, queries))
    assert found.count("BroadcastExchange") == 1 and "BuildRight" in found and "BuildLeft" not in found  # the queries' words alone


def test_of_the_nodes_and_edges_only_those_of_a_path_are_sent(spark):
    nodes, edges = session.kept(w.nodes(spark, SF), "n"), session.kept(w.edges(spark, SF), "e")
    asked = spark.createDataFrame([("order service", "a"), ("?", "b")], "query string, query_id string")
    crossed = plan(code.candidates_of(nodes, asked, 3))
    assert "BroadcastNestedLoopJoin" not in crossed or "BroadcastNestedLoopJoin BuildRight" in crossed
    steps = [{"id": e["src"], "edge": e["id"], "cost": 1.0} for e in edges.limit(2).collect()]
    explained = plan(paths.explained(nodes, edges, steps))
    assert "LeftSemi" in explained  # edges meet the path before they are sent
    few, many = spark.range(3), spark.range(30)
    assert "Broadcast" in plan(many.join(session.sided(few, 3), "id")) and "Broadcast" not in plan(many.join(session.sided(few, session.FEW + 1), "id"))


def test_line_items_are_dealt_in_fixed_shares(spark, monkeypatch):
    monkeypatch.setattr(session, "SHARE", 100)
    lines = views.table(spark, SF, "lineitem").count()
    dealt = plan(graph.degree(views.edges(spark, SF)))
    assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in dealt


def test_cheapest_paths_do_not_group_their_edges(spark, monkeypatch):
    written, keep = {}, graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: (written.setdefault(name, plan(df)), keep(df, name))[1])
    rows = [("a", "b", 5.0), ("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 9.0), ("c", "d", 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = graph.cheapest_paths(edges, spark.createDataFrame([("a",)], "id string"), edges["weight"], 3)
    assert {(r["id"], r["cost"], r["hops"]) for r in got.collect()} == {("a", 0.0, 0), ("b", 2.0, 1), ("c", 3.0, 2), ("d", 4.0, 3)}
    assert "Aggregate" not in written["steps"]


CONTROLS = ("run.started", "run.paused", "run.completed", "run.stopped", "run.failed")


def random_runs(spark, graphs=40, events=60):
    """A log of graphs with and without nodes, judged or not, some of few events, some with nulls."""
    pick, empty = random.Random(5), dict.fromkeys(w.run_log(spark, SF).columns)
    kinds = ["node.planned"] + ["node.completed", "node.evaluated"] * 9 + ["node.executing", "node.failed", "node.superseded", "run.review_requested", *CONTROLS]
    rows = []
    for g in range(graphs):
        for s in range(pick.choice((1, 9, events))):
            kind = pick.choice(CONTROLS) if g % 6 == 5 else "node.planned" if s < 8 else pick.choice(kinds)
            x = empty | {"graph_id": f"g{g}", "seq": s, "kind": kind, "node_id": f"n{s if s < 8 else pick.randrange(8)}" if kind.startswith("node.") else None, "ts": f"1995-01-{pick.randrange(1, 9):02}"}
            if kind == "node.planned":
                x |= {"node_kind": pick.choice(("revision", "task", "task", "replan")), "parent": pick.choice((None, "n0", "n1")), "needs": "", "depth": 0}
            if kind == "node.evaluated":
                x |= {"drift": pick.choice((None, 0.1, 0.5, 0.55, 0.9)), "direction": pick.choice(("drifting", "drifting", "closer")), "llm_ok": True, "checks_ok": pick.choice((None, True, True, g % 3 > 0))}
            rows.append(tuple(x.values()))
    return spark.createDataFrame(rows, w.run_log(spark, SF).schema)


def board(nodes, graphs, events):
    """The dashboard's rows by plain Python."""
    for g in graphs:
        mine, log = [n for n in nodes if n["graph_id"] == g["graph_id"]], sorted((e for e in events if e["graph_id"] == g["graph_id"]), key=lambda e: e["seq"])
        judged = sorted((n for n in mine if n["status"] == "completed" and n["drift"] is not None), key=lambda n: (n["completed_at"], n["planned"]), reverse=True)
        delta = round(judged[0]["drift"] - judged[:3][-1]["drift"], 9) if len(judged) > 1 else 0
        trend = "improving" if delta > 0.08 else "worsening" if delta < -0.08 else "steady"
        often = Counter(n["parent"] or n["node_id"] for n in mine if n["kind"] == "revision")
        reason = (
            "revised_often" if max(often.values(), default=0) >= 3 else "checks_failed" if sum(n["checks_ok"] is False for n in judged[:2]) == 2 else "drifting" if sum(n["direction"] == "drifting" for n in judged[:3]) == 3
            else "nothing_runnable" if g["status"] == "blocked" and not any(n["status"] in ("pending", "ready") for n in mine) else None)
        control = [e["kind"] for e in log if e["kind"] in CONTROLS][-1:]
        worst = (
            "critical" if g["status"] == "blocked" else "warning" if reason or g["status"] == "stopped" or trend == "worsening" or any(n["checks_ok"] is False for n in mine)
            else "info" if control == ["run.paused"] or g["status"] == "completed" else None)
        planned, done = sum(n["kind"] not in ("revision", "replan") for n in mine), sum(n["status"] == "completed" for n in mine)
        yield g["graph_id"], g["status"], g["updated_at"], math.floor(done * 100 / planned + 0.5) if planned else 0, trend, reason, worst


def test_a_dashboard_sums_a_graph_in_one_pass_of_fixed_shares(spark, monkeypatch):
    monkeypatch.setattr(session, "SHARE", 10)
    events = random_runs(spark)
    nodes, graphs = session.kept(runs.fold_nodes(events), "n"), session.kept(runs.fold_graphs(events), "g")
    rows = runs.dashboard(nodes, graphs, events)
    want = set(board(nodes.collect(), graphs.collect(), events.collect()))
    assert {tuple(r) for r in rows.collect()} == want and len({x[4:] for x in want}) > 8
    one, n = plan(runs.dashboard(nodes, graphs, events)), nodes.count() + graphs.count()
    assert one.count("SortMergeJoin") == 2 and one.count("Sort [") <= 6 and "Broadcast" not in one
    assert one.count(f", {-(-n // 10)}), REPARTITION_BY_NUM") == 3 and "ENSURE_REQUIREMENTS" not in one  # a task's rows don't grow, nor move again


def test_events_are_folded_in_fixed_shares(spark, monkeypatch):
    monkeypatch.setattr(session, "SHARE", 500)
    written, keep = {}, session.kept
    monkeypatch.setattr(run_plans, "kept", lambda df, name: (written.setdefault(name, plan(df)), keep(df, name))[1])
    log = run_plans.folded(spark, SF)[2]
    shares = f", {-(-log.count() // 500)}), REPARTITION_BY_NUM"
    assert all(written[name].count(shares) == 1 and "ENSURE_REQUIREMENTS" not in written[name] for name in ("run_nodes", "run_graphs"))


def test_a_dashboard_folds_only_the_fields_that_it_needs(spark, monkeypatch):
    written, keep, log = {}, session.kept, w.run_log(spark, SF)
    monkeypatch.setattr(run_plans, "kept", lambda df, name: (written.setdefault(name, (df.columns, plan(df))), keep(df, name))[1])
    got = [tuple(x) for x in run_plans.dashboard_first(spark, SF).collect()]
    fields, one = written["run_nodes"]
    assert fields == ["graph_id", *runs.STATE_FIELDS] and "direction" in one
    assert not any(f"{c}#" in one for c in ("title", "needs", "depth", "tools", "commands", "files", "checksums", "llm_ok", "successor", "person"))  # nor are they sent
    rows = sorted(board(runs.fold_nodes(log).collect(), runs.fold_graphs(log).collect(), log.collect()))
    first = sorted(rows, key=lambda x: x[2], reverse=True)
    assert got == [x[:4] for x in sorted(first, key=lambda x: (runs.RANK.get(x[6], 3), x[5] is None))][:10]
