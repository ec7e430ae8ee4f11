"""The product graph: projection of its event log, and what its items and links say about evidence, drift and readiness.

Nodes: id, kind, title, status, tests (test commands of evidence), scanned, at. Edges: id, src, dst, kind, trust, at. Links
count both ways unless a direction is named; every item of a result is counted once. Lists stay rows, so that an item with
very many links makes no long row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import kept

# Kinds by what they mean here.
ANCHORS, CODE = ("feature", "user_story", "requirement", "acceptance_criterion"), ("code_file", "code_symbol", "code_community")
SETTLED = ("resolved", "completed", "superseded", "archived")
NODE_KINDS = (
    "idea", "feature", "user_story", "requirement", "acceptance_criterion", "open_question", "decision", "plan", "task", "contract", "quickstart_scenario", "code_file", "code_symbol",
    "code_community", "agent_run", "test_result", "evidence")
EDGE_KINDS = ("belongs_to", "satisfies", "implements", "verifies", "touches", "uses", "exports", "depends_on", "extends", "blocked_by", "derived_from", "consulted", "produced_by", "supersedes")
STATUSES = ("proposed", "planned", "blocked", "in_progress", "completed", "resolved", "superseded", "archived")
INTENT_LINKS, AREA_LINKS = ("implements", "satisfies", "verifies"), ("touches", "implements", "depends_on")


NODE_FIELDS, EDGE_FIELDS = ("kind", "title", "status", "tests", "scanned", "made"), ("src", "dst", "kind", "trust", "made")


def folded(events: DataFrame, node_fields: tuple = NODE_FIELDS, edge_fields: tuple = EDGE_FIELDS) -> tuple[DataFrame, DataFrame]:
    """The last state of nodes and edges that it doesn't archive, of these fields alone; edges whose ends may be gone (EV1)."""
    def last(key: str, event: str, names: tuple, renamed: dict) -> DataFrame:
        fields = [F.col(renamed.get(n, n)).alias(n) for n in names]
        # whether it is there in place of the event's name, so that less is moved
        x = F.max_by(F.struct((F.col("kind") == event).alias("there"), *fields), "seq").alias("x")
        return events.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(x).filter("x.there").select("id", *[F.col(f"x.{n}").alias(n) for n in names])

    return last("node_id", "product.node.upserted", node_fields, {"kind": "node_kind"}), last("edge_id", "product.edge.upserted", edge_fields, {"kind": "edge_kind"})


def project(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The visible nodes and edges: the last event of an item decides, and an edge needs both its ends (EV1, EV2)."""
    nodes, edges = folded(events)
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges.select("id", *EDGE_FIELDS)


def unresolved() -> Column:
    """An open question that nothing has settled (FI20)."""
    return (F.col("kind") == "open_question") & ~F.col("status").isin(*SETTLED)


def is_anchor() -> Column:
    """Kinds that say what is wanted (FI19)."""
    return F.col("kind").isin(*ANCHORS)


def is_code() -> Column:
    return F.col("kind").isin(*CODE)


def both_ways(edges: DataFrame, *kinds: str) -> DataFrame:
    """(a, b) for each end of the edges of these kinds."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def beside(nodes: DataFrame, edges: DataFrame, kinds: tuple, of: Column, to: Column) -> DataFrame:
    """Distinct (a, b): nodes ``of`` and their neighbours ``to`` by edges of these kinds (JO12)."""
    left, right = nodes.filter(of).select(F.col("id").alias("a")), nodes.filter(to).select(F.col("id").alias("b"))
    return both_ways(edges, *kinds).join(left, "a", "left_semi").join(right, "b", "left_semi").select("a", "b").distinct()


def adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Each node's edges, by direction, with their place by time and id (EV1's lists as rows); with nodes only of edges that have both ends.

    The ends are looked up where the edges are sorted: edges that meet their targets are numbered there, and move once more to their sources.
    """
    e = edges.select("src", "dst", "id", "made")
    for end in ("src", "dst") if nodes is not None else ():
        e = e.join(nodes.select(F.col("id").alias(end)).hint("merge"), end, "left_semi")
    place = lambda end: F.row_number().over(Window.partitionBy(end).orderBy("made", "id"))
    e = e.withColumn("in", place("dst")).withColumn("out", place("src"))
    row = lambda end, way: F.struct(F.col(end).alias("node"), F.lit(way).alias("way"), "id", F.col(way).alias("place"))
    return e.select(F.explode(F.array(row("dst", "in"), row("src", "out"))).alias("x")).select("x.*")


def blockers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, question): what an unresolved question blocks."""
    open_ = nodes.filter(unresolved()).select(F.col("id").alias("dst"))
    return edges.filter("kind = 'blocked_by'").join(open_, "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("question"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by kind of nodes and edges, of unresolved questions and of blocked tasks (AG1)."""
    blocked = nodes.filter("kind = 'task'").join(blockers(nodes, edges).select(F.col("node").alias("id")), "id", "left_semi")
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("all").alias("kind"), "n")
    by = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return by(nodes, "node").unionByName(by(edges, "edge")).unionByName(one(nodes.filter(unresolved()), "unresolved_question")).unionByName(one(blocked, "blocked_task"))


def criteria(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (feature, criterion) that a satisfies edge joins, either way (JO13)."""
    return beside(nodes, edges, ("satisfies",), F.col("kind") == "feature", F.col("kind") == "acceptance_criterion").select(F.col("a").alias("feature"), F.col("b").alias("criterion"))


def verification(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each acceptance criterion the verifiers (test results, runs) and evidence: its own and its verifiers' (JO14)."""
    criterion, evidence, verifier = F.col("kind") == "acceptance_criterion", F.col("kind") == "evidence", F.col("kind").isin("test_result", "agent_run")
    by = beside(nodes, edges, ("verifies",), criterion, verifier)
    own = beside(nodes, edges, ("verifies",), criterion, evidence)
    of_verifier = beside(nodes, edges, ("produced_by",), verifier, evidence).select(F.col("a").alias("b"), F.col("b").alias("evidence"))
    found = own.select("a", F.col("b").alias("evidence")).unionByName(by.join(of_verifier, "b").select("a", "evidence")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = by.groupBy("a").agg(F.count("*").alias("verifiers")).join(found.groupBy("a").agg(F.count("*").alias("evidence")), "a", "full_outer").withColumnRenamed("a", "criterion")
    return nodes.filter(criterion).select(F.col("id").alias("criterion")).join(counts, "criterion", "left").select("criterion", zero("verifiers"), zero("evidence"))


def acceptance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, total, verified, unverified criteria; features without criteria have no row (PR1)."""
    rows = criteria(nodes, edges).join(verification(nodes, edges), "criterion")
    ok = F.col("verifiers") + F.col("evidence") > 0
    return rows.groupBy("feature").agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("verified"), F.count(F.when(~ok, 1)).alias("unverified"))


def percent(part: Column, whole: Column) -> Column:
    """The share in whole percent, halves upwards; zero of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("long")


def acceptance_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over all features (PR2)."""
    rows = nodes.filter("kind = 'feature'").select(F.col("id").alias("feature")).join(acceptance(nodes, edges), "feature", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = rows.agg(F.count("*").alias("features"), F.count("total").alias("with_criteria"), F.count(F.when(F.col("unverified") > 0, 1)).alias("needing_evidence"), n("total").alias("criteria"), n("verified").alias("verified"), n("unverified").alias("unverified"))
    return out.withColumn("coverage_percent", percent(F.col("verified"), F.col("criteria")))


def acceptance_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, criterion) without verification (PR3)."""
    return criteria(nodes, edges).join(verification(nodes, edges).filter("verifiers + evidence = 0"), "criterion").select("feature", "criterion")


def _done(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'task' AND status = 'completed'").select(F.col("id").alias("task"))


def task_runs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, run): the runs that a task names as producing it."""
    runs = nodes.filter("kind = 'agent_run'").select(F.col("id").alias("run"))
    return edges.filter("kind = 'produced_by'").select(F.col("src").alias("task"), F.col("dst").alias("run")).join(runs, "run", "left_semi").join(_done(nodes), "task", "left_semi").distinct()


def _counted(tasks: DataFrame, /, **found: DataFrame) -> DataFrame:
    """tasks with the number of rows that each frame (task, ...) has for them."""
    for name, rows in found.items():
        tasks = tasks.join(rows.groupBy("task").agg(F.count("*").alias(name)), "task", "left")
    return tasks.select("task", *[F.coalesce(n, F.lit(0)).alias(n) for n in found])


def execution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each completed task the linked runs, their evidence and touched files, and what is missing (PR4)."""
    runs, is_run = task_runs(nodes, edges), F.col("kind") == "agent_run"
    of = lambda kinds, to: runs.join(beside(nodes, edges, kinds, is_run, to).withColumnRenamed("a", "run"), "run").select("task", "b").distinct()
    out = _counted(_done(nodes), runs=runs, evidence=of(("produced_by",), F.col("kind") == "evidence"), files=of(("touches",), F.col("kind") == "code_file"))
    return out.select("*", (F.col("runs") == 0).alias("no_run"), (F.col("evidence") == 0).alias("no_evidence"), ((F.col("runs") == 0) | (F.col("evidence") == 0)).alias("drift"))


def union_sizes(near: DataFrame, of: DataFrame) -> DataFrame:
    """(task, n): how many distinct b the nodes a near a task have together; near (task, a), of (a, b). Tasks without any have no row.

    A task's a with the most b counts by its size alone, and so do b that only one a has; listed are the others' shared b. So
    tasks around one hub cost a row each, not as many as the hub has.
    """
    of = kept(of.distinct(), "union_of")
    marked = of.join(of.groupBy("b").agg((F.count("*") > 1).alias("shared")), "b")
    sizes = marked.groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(~F.col("shared"), 1)).alias("alone"))
    most = Window.partitionBy("task").orderBy(F.desc("n"), "a")
    near = kept(near.distinct().join(sizes, "a").withColumn("k", F.row_number().over(most)).withColumn("top", F.first("a").over(most)), "union_near")
    listed = near.filter("k > 1").join(marked.filter("shared"), "a").select("task", "top", "b")
    # made distinct where they have met the top's, so that they move once
    listed = listed.join(of.withColumnRenamed("a", "top"), ["top", "b"], "left_anti").distinct().select("task", F.lit(1).cast("long").alias("n"))
    return near.select("task", F.when(F.col("k") == 1, F.col("n")).otherwise(F.col("alone")).alias("n")).unionByName(listed).groupBy("task").agg(F.sum("n").alias("n"))


def _tested(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The runs (task, run) and evidence (task, evidence) of completed tasks, what may have test results (task, a), those (a, b), and test commands by task."""
    runs, is_run = kept(task_runs(nodes, edges), "task_runs"), F.col("kind") == "agent_run"
    found = runs.join(beside(nodes, edges, ("produced_by",), is_run, F.col("kind") == "evidence").withColumnRenamed("a", "run"), "run").select("task", F.col("b").alias("evidence")).distinct()
    found = kept(found, "task_evidence")
    related = _done(nodes).select("task", F.col("task").alias("a")).unionByName(runs.select("task", F.col("run").alias("a"))).unionByName(found.select("task", F.col("evidence").alias("a")))
    results = beside(nodes, edges, ("verifies", "produced_by"), F.lit(True), F.col("kind") == "test_result")
    commands = found.join(nodes.select(F.col("id").alias("evidence"), "tests"), "evidence").groupBy("task").agg(F.sum("tests").alias("commands"))
    return runs, found, related, results, commands


def _linked(rows: DataFrame) -> DataFrame:
    linked = (F.col("runs") > 0) & (F.col("evidence") > 0)
    return rows.select("*", linked.alias("linked"), (linked & (F.col("results") == 0) & (F.col("commands") == 0)).alias("gap"))


def test_evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each completed task the test results beside it, its runs and their evidence, and the evidence's test commands (PR5)."""
    runs, found, related, results, commands = _tested(nodes, edges)
    sizes = union_sizes(related, results).withColumnRenamed("n", "results")
    out = _counted(_done(nodes), runs=runs, evidence=found).join(sizes, "task", "left").join(commands, "task", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return _linked(out.select("task", "runs", "evidence", zero("results"), zero("commands")))


def execution_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: completed tasks, and those that lack a run, evidence or tests (PR6, PR7). Whether there are test results is enough here."""
    runs, found, related, results, commands = _tested(nodes, edges)
    tested = related.join(results.select("a"), "a", "left_semi")
    out = _linked(_counted(_done(nodes), runs=runs, evidence=found, results=tested).join(commands, "task", "left").withColumn("commands", F.coalesce("commands", F.lit(0))))
    n = lambda c: F.count(F.when(c, 1))
    no_run, no_evidence = F.col("runs") == 0, F.col("evidence") == 0
    return out.agg(F.count("*").alias("completed"), n(no_run | no_evidence).alias("with_drift"), n(no_run).alias("missing_run"), n(no_evidence).alias("missing_evidence"), n(F.col("linked")).alias("with_evidence"), n(F.col("gap")).alias("missing_tests"))


def readiness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Planned tasks with the number of questions that block them (PR8)."""
    tasks = nodes.filter("kind = 'task' AND status = 'planned'").select(F.col("id").alias("task"))
    return _counted(tasks, blockers=blockers(nodes, edges).withColumnRenamed("node", "task")).withColumn("ready", F.col("blockers") == 0)


def _behind(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, ...]:
    """What is beside code: its runs and tasks (a, b), and the intents of code, of tasks and of runs, the runs' own and their tasks'."""
    # an edge takes its ends' roles along once; the roles stand in the order in which one is behind the other
    code, run, task, anchor = range(4)
    role = F.when(is_code(), code).when(F.col("kind") == "agent_run", run).when(F.col("kind") == "task", task).when(is_anchor(), anchor)
    at = nodes.select("id", role.alias("role")).filter("role IS NOT NULL")
    end = lambda x: at.select(F.col("id").alias(x), F.struct("role", F.col("id").alias("id")).alias(f"{x}_at"))
    e = edges.filter(F.col("kind").isin(*sorted({"touches", "produced_by", *INTENT_LINKS, *AREA_LINKS}))).select("src", "dst", "kind")
    e = e.join(end("src"), "src").join(end("dst"), "dst").select("kind", F.least("src_at", "dst_at").alias("a"), F.greatest("src_at", "dst_at").alias("b")).filter("a.role < b.role")
    e = kept(e.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.role").alias("of"), F.col("b.role").alias("to"), "kind"), "role_links")
    links = lambda kinds, of, to: e.filter(F.col("kind").isin(*kinds) & (F.col("of") == of) & (F.col("to") == to)).select("a", "b").distinct()
    runs = kept(links(("touches",), code, run), "code_runs")
    of_run = kept(links(("produced_by",), run, task), "run_tasks")
    of_task = kept(links(INTENT_LINKS, task, anchor), "task_intents")
    by_task = of_run.join(of_task.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    by_run = kept(links(("produced_by", "verifies"), run, anchor).unionByName(by_task).distinct(), "run_intents")
    return runs, of_run, kept(links(AREA_LINKS, code, task), "code_tasks"), links(INTENT_LINKS, code, anchor), of_task, by_run


def code_intent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each code node the runs that touched it, the tasks and the intents behind it, and whether changed code has none (PR9).

    The tasks and intents of a run are listed once a run; code counts them by ``union_sizes``.
    """
    runs, of_run, area, own, of_task, by_run = _behind(nodes, edges)
    rows = nodes.filter(is_code()).select(F.col("id").alias("task"))
    near = rows.select("task", F.col("task").alias("a")).unionByName(runs.select(F.col("a").alias("task"), F.col("b").alias("a")))
    to_task = area.select(F.col("a").alias("task"), F.col("b").alias("a"))
    tasks = union_sizes(near, of_run.unionByName(area)).withColumnRenamed("n", "tasks")
    intents = union_sizes(near.unionByName(to_task), own.unionByName(by_run).unionByName(of_task.join(to_task.select("a"), "a", "left_semi"))).withColumnRenamed("n", "intents")
    out = _counted(rows, runs=runs.withColumnRenamed("a", "task")).join(tasks, "task", "left").join(intents, "task", "left").fillna(0, ["tasks", "intents"]).withColumnRenamed("task", "code")
    return out.select("*", (F.col("runs") > 0).alias("changed"), ((F.col("runs") > 0) & (F.col("intents") == 0)).alias("drift"))


def intent_drift(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: changed code, with and without intent (PR10). Whether there are intents is enough here, so none are counted."""
    runs, _, area, own, of_task, by_run = _behind(nodes, edges)
    has = lambda near, of: near.join(of.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    meant = own.select("a").unionByName(has(area, of_task)).unionByName(has(runs, by_run)).distinct().withColumn("meant", F.lit(1))
    return runs.select("a").distinct().join(meant, "a", "left").agg(F.count("*").alias("changed"), F.count("meant").alias("with_intent"), F.count(F.when(F.col("meant").isNull(), 1)).alias("without"))


def scan_freshness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: scanned code, the latest scan, touched code, and code changed after it (PR11)."""
    scan = nodes.filter(is_code() & F.col("scanned")).agg(F.count("*").alias("scanned"), F.max("made").alias("latest"))
    at = lambda name, of: nodes.filter(of).select(F.col("id").alias(name), F.col("made").alias(f"{name}_at"))
    e = edges.filter("kind = 'touches'").select("src", "dst", F.col("made").alias("edge_at"))
    pairs = e.select(F.col("src").alias("run"), F.col("dst").alias("code"), "edge_at").unionByName(e.select(F.col("dst").alias("run"), F.col("src").alias("code"), "edge_at"))
    touched = pairs.join(at("run", F.col("kind") == "agent_run"), "run").join(at("code", is_code()), "code").groupBy("code").agg(F.max(F.greatest("edge_at", "run_at", "code_at")).alias("changed_at"))
    out = touched.crossJoin(scan.select("latest")).agg(F.count("*").alias("touched"), F.count(F.when(F.col("latest").isNull() | (F.col("changed_at") > F.col("latest")), 1)).alias("changed_after"))  # single rows
    return scan.crossJoin(out).select("*", ((F.col("scanned") == 0) & (F.col("touched") > 0)).alias("missing"), ((F.col("scanned") > 0) & (F.col("changed_after") > 0)).alias("stale"))


def planning_inputs(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Of each task up to k intents, code areas and open questions beside it, by time and id (PR12, PR13)."""
    task = F.col("kind") == "task"
    links = ("belongs_to", "satisfies", "implements", "verifies", "depends_on", "derived_from")
    found = beside(nodes, edges, links, task, is_anchor()).withColumn("what", F.lit("intent"))
    found = found.unionByName(beside(nodes, edges, AREA_LINKS, task, is_code()).withColumn("what", F.lit("area")))
    found = found.unionByName(beside(nodes, edges, ("blocked_by",), task, unresolved()).withColumn("what", F.lit("question")))
    rows = found.join(nodes.select(F.col("id").alias("b"), "made"), "b")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("a", "what").orderBy("made", "b"))).filter(F.col("place") <= k).select(F.col("a").alias("task"), "what", F.col("b").alias("item"), "place")


def gate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, n) of every check that fails: intent, run and test evidence, acceptance, freshness, or no data at all (PR20)."""
    row = lambda df, code, n: df.select(F.lit(code).alias("code"), n.cast("long").alias("n"))
    execution_, fresh = kept(execution_summary(nodes, edges), "gate_execution"), kept(scan_freshness(nodes, edges), "gate_freshness")
    parts = [
        row(nodes.agg(F.count("*").alias("n")), "empty_product_graph", (F.col("n") == 0).cast("int")),
        row(intent_drift(nodes, edges), "code_intent_drift", F.col("without")), row(execution_, "execution_evidence_drift", F.col("with_drift")), row(execution_, "test_evidence_drift", F.col("missing_tests")),
        row(acceptance_gaps(nodes, edges).agg(F.count("*").alias("n")), "acceptance_evidence_gap", F.col("n")),
        row(fresh, "code_scan_missing", F.when(F.col("missing"), F.greatest("touched", "changed_after")).otherwise(0)), row(fresh, "code_scan_stale", F.when(F.col("stale"), F.greatest("touched", "changed_after")).otherwise(0)),
    ]
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def invalid_nodes(rows: DataFrame, title_length: int = 160, id_length: int = 128) -> DataFrame:
    """(id, error): the first rule that an offered node breaks (PR18)."""
    title = F.trim(F.coalesce("title", F.lit("")))
    error = (
        F.when(~F.coalesce(F.col("kind").isin(*NODE_KINDS), F.lit(False)), "kind").when((title == "") | (F.length(title) > title_length), "title")
        .when(~F.coalesce("status", F.lit("planned")).isin(*STATUSES), "status").when(F.length(F.trim("id")) > id_length, "id"))
    return rows.select("id", error.alias("error")).filter("error IS NOT NULL")


def invalid_edges(rows: DataFrame) -> DataFrame:
    """(id, error): the first rule that an offered edge breaks (PR18)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    error = (
        F.when(~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False)), "kind").when(blank("src"), "source").when(blank("dst"), "target").when(F.trim("src") == F.trim("dst"), "same"))
    return rows.select("id", error.alias("error")).filter("error IS NOT NULL")


def bundle_duplicates(items: DataFrame) -> DataFrame:
    """Ids that a bundle offers more than once (PR17)."""
    return items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def accepted_plans(prompts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Plan nodes of prompts (task, prompt), keyed by task and prompt, without those that are there already (PR19)."""
    key = F.concat(F.lit("plan:"), F.substring(F.sha1(F.concat_ws(":", "task", "prompt")), 1, 12))
    plans = prompts.select(key.alias("id"), "task", F.sha2("prompt", 256).alias("prompt_sha256")).distinct()
    return plans.join(nodes.select("id"), "id", "left_anti")


def trace(nodes: DataFrame, edges: DataFrame, start: DataFrame, *, hops: int = 2, most: int = 100) -> DataFrame:
    """(id, hop, place): nodes within hops of the start, nearest first, then by time and id, at most ``most`` (GR12)."""
    near = both_ways(edges).distinct()
    reached = frontier = kept(start.select("id").distinct().withColumn("hop", F.lit(0)), "trace")
    for hop in range(1, hops + 1):
        step = near.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        frontier = kept(step.withColumn("hop", F.lit(hop)), "trace")
        reached = reached.unionByName(frontier)
    found = reached.join(nodes.select("id", "made"), "id").orderBy("hop", "made", "id").limit(most)
    return found.withColumn("place", F.row_number().over(Window.orderBy("hop", "made", "id")))  # at most ``most`` rows
