"""Agent runs: the fold of a run's event log into nodes and graphs, and what follows from them.

Events: graph_id, seq, kind, node_id, ts and the payload's fields. A node starts anew with each ``node.planned``; events
before its first one don't count. Rows of a graph are reduced by aggregates and windows within the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.paths import levels, reachable
from eventloom.session import dealt, kept

STATES = {"node.executing": "executing", "node.completed": "completed", "node.failed": "failed", "node.superseded": "superseded"}
GRAPH_STATES = {"run.started": "running", "run.completed": "completed", "run.failed": "blocked", "run.stopped": "stopped"}
#: Severities of alerts, and their order.
SEVERITY = {"run_completed": "info", "run_paused": "info", "run_blocked": "critical", "review_needed": "warning", "drift_worsening": "warning", "deterministic_failure": "warning", "run_stopped": "warning"}
RANK = {"critical": 0, "warning": 1, "info": 2}
#: What a graph's state (_states) needs of its folded nodes, besides graph_id.
STATE_FIELDS = ("node_id", "kind", "parent", "planned", "status", "completed_at", "updated_at", "drift", "direction", "checks_ok")
MARKS, CONTROLS = ("run.completed", "run.paused", "run.stopped", "run.failed", "run.review_requested"), ("run.started", "run.paused", "run.completed", "run.stopped", "run.failed")


def _map(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _last(value, where: Column) -> Column:
    """The value of the last event for which where holds."""
    return F.max_by(F.when(where, value), F.when(where, F.col("seq")))


def fold_nodes(events: DataFrame) -> DataFrame:
    """One row a planned node: the fields of its last plan and what came after (EV3)."""
    planned = F.max(F.when(F.col("kind") == "node.planned", F.col("seq"))).over(Window.partitionBy("graph_id", "node_id"))
    e = events.filter("node_id IS NOT NULL").withColumn("planned", planned).filter("seq >= planned")
    is_ = lambda k: F.col("kind") == k
    state, done, judged = _map(STATES, F.col("kind")), is_("node.completed"), is_("node.evaluated")
    first = lambda c: F.min_by(c, "seq")
    return e.groupBy("graph_id", "node_id").agg(
        first("node_kind").alias("kind"), *[first(c).alias(c) for c in ("title", "parent", "needs", "depth")], first("ts").alias("created_at"), F.min("seq").alias("planned"),
        F.coalesce(_last(state, state.isNotNull()), F.lit("pending")).alias("status"), F.max(F.when(done, F.col("ts"))).alias("completed_at"),
        *[_last(F.col(c), done).alias(c) for c in ("tools", "commands", "files", "failed_commands", "checksums")], *[_last(F.col(c), judged).alias(c) for c in ("drift", "direction", "llm_ok", "checks_ok")],
        _last(F.col("llm_ok") & F.col("checks_ok"), judged).alias("passed"), _last(F.col("successor"), is_("node.superseded")).alias("superseded_by"), F.max("ts").alias("updated_at"))


def fold_graphs(events: DataFrame) -> DataFrame:
    """One row a graph: status by its last run event, planned without one (EV3)."""
    state = _map(GRAPH_STATES, F.col("kind"))
    return events.groupBy("graph_id").agg(
        F.coalesce(_last(state, state.isNotNull()), F.lit("planned")).alias("status"), F.max("ts").alias("updated_at"), F.max("seq").alias("last_seq"), F.count("*").alias("events"))


def evidence_coverage() -> Column:
    """none, partial or grounded (EV7); checksums: bit 1 for the one before, bit 2 for the one after."""
    return (
        F.when(F.col("tools").isNull(), "none").when((F.col("tools") > 0) & (F.col("checksums") == 3), "grounded")
        .when((F.col("tools") > 0) | (F.col("commands") > 0) | (F.col("files") > 0) | (F.col("checksums") > 0), "partial").otherwise("none"))


def confidence_badge() -> Column:
    """high, medium or low (EV8)."""
    full = (evidence_coverage() == "grounded") & F.col("passed") & F.col("llm_ok") & F.col("checks_ok")
    return F.when(full, "high").when((evidence_coverage() == "none") | (F.col("status") == "failed") | ~F.col("passed"), "low").otherwise("medium")


def edges(nodes: DataFrame) -> DataFrame:
    """depends_on from each node's needs, revises of revisions, supersedes; each once (EV6)."""
    needs = nodes.select("graph_id", F.explode(F.split("needs", ",")).alias("src"), F.col("node_id").alias("dst"), F.lit("depends_on").alias("kind")).filter("src <> ''")
    revises = nodes.filter("kind = 'revision' AND parent IS NOT NULL").select("graph_id", F.col("node_id").alias("src"), F.col("parent").alias("dst"), F.lit("revises").alias("kind"))
    after = nodes.filter("superseded_by IS NOT NULL").select("graph_id", F.col("superseded_by").alias("src"), F.col("node_id").alias("dst"), F.lit("supersedes").alias("kind"))
    return needs.unionByName(revises).unionByName(after).distinct()


def _judged(nodes: DataFrame) -> DataFrame:
    """Completed and judged nodes with k, their place from the latest back."""
    w = Window.partitionBy("graph_id").orderBy(F.desc("completed_at"), F.desc("planned"))
    return nodes.filter("status = 'completed' AND drift IS NOT NULL").withColumn("k", F.row_number().over(w))


def _trend(n: Column, delta: Column, step: float) -> Column:
    return F.when(n < 2, "steady").when(F.round(delta, 9) > step, "improving").when(F.round(delta, 9) < -step, "worsening").otherwise("steady").alias("trend")


def trend(nodes: DataFrame, n: int = 3, step: float = 0.08) -> DataFrame:
    """graph_id, trend of the last n drift scores, higher being better (WI1 over the fold)."""
    few = _judged(nodes).filter(F.col("k") <= n).groupBy("graph_id").agg(F.count("*").alias("n"), (F.min_by("drift", "k") - F.max_by("drift", "k")).alias("delta"))
    return few.select("graph_id", _trend(F.col("n"), F.col("delta"), step))


def _counts() -> dict[str, Column]:
    """Counts of a graph's nodes by name."""
    n = lambda c: F.count(F.when(c, 1))
    again, done = F.col("kind").isin("revision", "replan"), F.col("status") == "completed"
    return {
        "planned": n(~again), "completed": n(done), "failed": n(F.col("status").isin("failed", "blocked")), "superseded": n(F.col("status") == "superseded"), "revised": n(again),
        "passed": n(done & F.col("passed")), "grounded": n(done & (evidence_coverage() == "grounded"))}


def health(nodes: DataFrame) -> DataFrame:
    """Counts and rates of a graph's nodes; nothing of nothing is zero (AG5)."""
    c = nodes.groupBy("graph_id").agg(*[c.alias(name) for name, c in _counts().items()])
    rate = lambda a, b, name: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6).alias(name)
    return c.select("*", rate("passed", "completed", "pass_rate"), rate("revised", "planned", "revision_rate"), rate("grounded", "completed", "grounded_rate"))


def _summed(nodes: DataFrame, last: int = 3, step: float = 0.08) -> DataFrame:
    """One row a graph, of one pass over its nodes: planned, completed, trend, the rules of review, the latest completed and the latest unchecked node."""
    judged = (F.col("status") == "completed") & F.col("drift").isNotNull()
    of, back = Window.partitionBy("graph_id", F.coalesce("parent", "node_id")), Window.partitionBy("graph_id").orderBy(F.desc(judged), F.desc("completed_at"), F.desc("planned"))
    rows = nodes.withColumn("same", F.count(F.when(F.col("kind") == "revision", 1)).over(of)).withColumn("k", F.row_number().over(back))
    recent = lambda k: judged & (F.col("k") <= k)
    n = lambda c: F.count(F.when(c, 1))
    when_ = F.coalesce("completed_at", "updated_at")
    latest = lambda c: F.max_by(F.when(c, F.struct("node_id", when_.alias("when_"))), F.when(c, F.struct(when_, "planned")))
    at = lambda by: by(F.when(recent(last), F.col("drift")), F.when(recent(last), F.col("k")))
    found = rows.groupBy("graph_id").agg(
        *[_counts()[c].alias(c) for c in ("planned", "completed")], n(recent(last)).alias("n"), (at(F.min_by) - at(F.max_by)).alias("delta"), (F.max("same") >= 3).alias("often"),
        (n(recent(2) & ~F.col("checks_ok")) == 2).alias("checks"), (n(recent(3) & (F.col("direction") == "drifting")) == 3).alias("drifting"), F.max(F.col("status").isin("pending", "ready")).alias("runnable"),
        latest(F.col("status") == "completed").alias("done"), latest(~F.col("checks_ok")).alias("unchecked"))
    return found.withColumn("trend", F.when(F.col("n") > 0, _trend(F.col("n"), F.col("delta"), step)))


def _states(nodes: DataFrame, graphs: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Graphs with status, updated_at, what _summed says of their nodes, reason, and marks of their events.

    Nodes and graphs are counted first (they had better be written). Each table is dealt by graph in the same shares, so that
    two joins follow without another shuffle and a task's rows don't grow with the input.
    """
    n = nodes.count() + graphs.count()
    share = lambda rows, *columns: dealt(rows.select("graph_id", *columns), n, "graph_id")
    summed = _summed(share(nodes, *STATE_FIELDS))
    rows = share(graphs, "status", "updated_at").join(summed.hint("merge"), "graph_id", "left")
    blocked = (F.col("status") == "blocked") & ~F.coalesce("runnable", F.lit(False))
    rows = rows.withColumn("reason", F.when(F.col("often"), "revised_often").when(F.col("checks"), "checks_failed").when(F.col("drifting"), "drifting").when(blocked, "nothing_runnable"))
    if events is None:
        return rows
    at = lambda k: _last(F.col("ts"), F.col("kind") == k).alias(k.split(".")[1])
    marks = share(events.filter(F.col("kind").isin(*MARKS, *CONTROLS)), "seq", "kind", "ts").groupBy("graph_id").agg(F.struct(*[at(k) for k in MARKS]).alias("marks"), _last(F.col("kind"), F.col("kind").isin(*CONTROLS)).alias("control"))
    return rows.join(marks.hint("merge"), "graph_id", "left")


def review(nodes: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, reason: why a person should look, the first rule that holds; null for none (WI2)."""
    return _states(nodes, graphs).select("graph_id", "reason")


def frontier_status(nodes: DataFrame, graphs: DataFrame) -> DataFrame:
    """blocked, drifting, exploring or on_track, by the latest judged node (WI4, EV10)."""
    last = _judged(nodes).filter("k = 1").select("graph_id", "direction")
    status = (
        F.when(F.col("status") == "blocked", "blocked").when(F.col("direction").isNull(), F.when(F.col("status") == "failed", "drifting").otherwise("on_track"))
        .when(F.col("direction") == "drifting", "drifting").when(F.col("direction") == "holding", "exploring").otherwise("on_track"))
    state = F.when(F.col("direction").isNull(), F.when(F.col("status") == "blocked", "drifting").otherwise("on_track")).when(F.col("direction") == "drifting", "drifting").when(F.col("direction") == "holding", "exploring").otherwise("on_track")
    return graphs.join(last, "graph_id", "left").select("graph_id", status.alias("frontier"), state.alias("state"))


def _raised() -> Column:
    """The list of what the state of a graph (_states) calls for: type, at, node_id."""
    one = lambda kind, on, when, node=None: F.when(on, F.struct(F.lit(kind).alias("type"), when.alias("at"), (F.lit(None).cast("string") if node is None else node).alias("node_id")))
    status, updated, mark = F.col("status"), F.col("updated_at"), lambda k: F.col(f"marks.{k}")
    return F.array_compact(F.array(
        one("review_needed", F.col("reason").isNotNull(), F.coalesce(mark("review_requested"), updated), F.col("unchecked.node_id")), one("run_blocked", (status == "blocked") & mark("failed").isNotNull(), mark("failed")),
        one("run_paused", (F.col("control") == "run.paused"), mark("paused")), one("run_stopped", (status == "stopped") & mark("stopped").isNotNull(), mark("stopped")),
        one("drift_worsening", F.col("trend") == "worsening", F.coalesce("done.when_", updated), F.col("done.node_id")), one("deterministic_failure", F.col("unchecked").isNotNull(), F.col("unchecked.when_"), F.col("unchecked.node_id")),
        one("run_completed", (status == "completed") & mark("completed").isNotNull(), mark("completed"))))


def alerts(nodes: DataFrame, graphs: DataFrame, events: DataFrame) -> DataFrame:
    """graph_id, type, severity, at, node_id, place: what a graph's state calls for, gravest and latest first (EV11, TK6)."""
    out = _states(nodes, graphs, events).select("graph_id", F.explode(_raised()).alias("x")).select("graph_id", "x.*").withColumn("severity", _map(SEVERITY, F.col("type")))
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(_map(RANK, F.col("severity")), F.desc("at"), "type"))
    return out.withColumn("place", place)


def new_alerts(nodes: DataFrame, graphs: DataFrame, events: DataFrame, before: DataFrame) -> DataFrame:
    """Alerts that an earlier list (graph_id, type) doesn't hold (SE6)."""
    return alerts(nodes, graphs, events).join(before, ["graph_id", "type"], "left_anti").select("graph_id", "type")


def lifecycle(graphs: DataFrame, reasons: DataFrame, now: str, seen: int, days: int = 7) -> DataFrame:
    """graph_id, bucket: needs_attention, archived (ended, nothing new, old), completed_recent or active (EV12)."""
    rows = graphs.join(reasons, "graph_id", "left")
    ended, news = F.col("status").isin("completed", "stopped", "failed"), F.col("last_seq") > seen
    old = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("updated_at").cast("timestamp")) >= days * 86_400_000
    bucket = F.when(F.col("reason").isNotNull() | (F.col("status") == "blocked"), "needs_attention").when(ended & ~news & old, "archived").when(F.col("status") == "completed", "completed_recent").otherwise("active")
    return rows.select("graph_id", bucket.alias("bucket"))


def dashboard(nodes: DataFrame, graphs: DataFrame, events: DataFrame) -> DataFrame:
    """One wide row a graph, with its place: gravest alert, need of review, latest event, id (EV14, TK1)."""
    rank = F.array_min(F.transform(_raised(), lambda x: _map(RANK, _map(SEVERITY, x["type"]))))
    progress = F.when(F.col("planned") > 0, F.floor(F.col("completed") * 100 / F.col("planned") + 0.5)).otherwise(0).cast("long")
    return _states(nodes, graphs, events).select(
        "graph_id", "status", "updated_at", progress.alias("progress"), F.coalesce("trend", F.lit("steady")).alias("trend"), "reason", _map({r: s for s, r in RANK.items()}, rank).alias("top_severity"))


def ordered(rows: DataFrame, k: int) -> DataFrame:
    """The k dashboard rows that come first (TK1)."""
    return rows.orderBy(F.coalesce(_map(RANK, F.col("top_severity")), F.lit(3)), F.col("reason").isNull(), F.desc("updated_at"), "graph_id").limit(k)


def dashboard_summary(rows: DataFrame) -> DataFrame:
    """One row of counts (AG6)."""
    n = lambda c: F.count(F.when(c, 1))
    return rows.agg(F.count("*").alias("graphs"), n(F.col("top_severity") == "critical").alias("urgent"), n(F.col("reason").isNotNull()).alias("needs_review"), n(F.col("status") == "blocked").alias("blocked"), n(F.col("status") == "running").alias("active"))


def filtered(rows: DataFrame, name: str) -> DataFrame:
    """A dashboard filter by name (FI14)."""
    rules = {"all": F.lit(True), "needs_review": F.col("reason").isNotNull(), "blocked": F.col("status") == "blocked", "active": F.col("status").isin("running", "planned"), "completed": F.col("status") == "completed"}
    return rows.filter(rules[name])


def text_match(rows: DataFrame, query: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows with match, field: the best field's points (6 equal, 4 prefix, 2 inside, for each word), the first of equals (SEA14, TK2)."""
    asked = [w for w in query.lower().split() if w]
    value = lambda f: F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))))
    points = lambda f: reduce(lambda a, b: a + b, [F.when(value(f) == w, 6).when(value(f).startswith(w), 4).when(value(f).contains(w), 2).otherwise(0) for w in asked], F.lit(0))
    best = F.array_max(F.array(*[F.struct(points(f).alias("score"), F.lit(-i).alias("i"), F.lit(f).alias("field")) for i, f in enumerate(fields)]))
    return rows.withColumn("best_", best).filter("best_.score > 0").withColumn("match", F.col("best_.score")).withColumn("field", F.col("best_.field")).drop("best_")


def scheduling(nodes: DataFrame) -> DataFrame:
    """Nodes of a graph by status (AG7)."""
    return nodes.groupBy("graph_id", "status").agg(F.count("*").alias("n"))


def evidence_stats(nodes: DataFrame) -> DataFrame:
    """Files, commands and failed commands of a graph's evidence (AG21)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return nodes.groupBy("graph_id").agg(total("files"), total("commands"), total("failed_commands"), F.count("tools").alias("nodes_with_evidence"))


def annotations(events: DataFrame) -> DataFrame:
    """Notes on each node: how many, by how many people, the latest text (AG30)."""
    notes = events.filter("kind = 'node.annotated'")
    return notes.groupBy("graph_id", "node_id").agg(F.count("*").alias("n"), F.countDistinct("person").alias("people"), F.max_by("title", "seq").alias("latest"))


def proposals(events: DataFrame) -> DataFrame:
    """Each proposal with its state: open, accepted or dismissed, the last word counting (EV15)."""
    e = events.filter(F.col("kind").startswith("proposal."))
    made = F.col("kind") == "proposal.made"
    rows = e.groupBy("graph_id", "node_id").agg(_last(F.col("title"), made).alias("title"), F.max(F.when(made, F.col("seq"))).alias("made_seq"), _last(F.col("kind"), ~made).alias("word"))
    state = F.when(F.col("word") == "proposal.accepted", "accepted").when(F.col("word") == "proposal.dismissed", "dismissed").otherwise("open")
    return rows.filter("made_seq IS NOT NULL").select("graph_id", "node_id", "title", "made_seq", state.alias("state"))


def open_proposals(events: DataFrame, k: int = 3) -> DataFrame:
    """The k newest open proposals of each graph (FI23)."""
    w = Window.partitionBy("graph_id").orderBy(F.desc("made_seq"))
    return proposals(events).filter("state = 'open'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("graph_id", "node_id", "title", "place")


def frontier(nodes: DataFrame, k: int = 8) -> DataFrame:
    """The first k nodes that are not completed or superseded, executing before pending before failed, latest first (FI22)."""
    rank = F.when(F.col("status") == "executing", 0).when(F.col("status") == "pending", 1).otherwise(2)
    w = Window.partitionBy("graph_id").orderBy(rank, F.desc("updated_at"), "node_id")
    return nodes.filter("status NOT IN ('completed', 'superseded')").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("graph_id", "node_id", "status", "place")


def report_order(nodes: DataFrame) -> DataFrame:
    """Nodes in a report's order: depth, creation (TK3)."""
    return nodes.select("graph_id", "node_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("depth", "created_at", "planned")).alias("place"))


def next_nodes(nodes: DataFrame) -> DataFrame:
    """Of each graph the pending node made first all of whose needs are completed or superseded (JO15, EV18)."""
    done = nodes.filter("status IN ('completed', 'superseded')").select("graph_id", F.col("node_id").alias("need"))
    open_ = nodes.filter("status IN ('pending', 'ready')")
    waits = open_.select("graph_id", "node_id", F.explode(F.split("needs", ",")).alias("need")).filter("need <> ''").join(done, ["graph_id", "need"], "left_anti").select("graph_id", "node_id").distinct()
    return open_.join(waits, ["graph_id", "node_id"], "left_anti").groupBy("graph_id").agg(F.min_by("node_id", "planned").alias("next"))


def active_nodes(nodes: DataFrame) -> DataFrame:
    """Of each graph the executing node and the one finished last (EV18)."""
    running, ended = F.col("status") == "executing", F.col("status").isin("completed", "failed")
    return nodes.groupBy("graph_id").agg(F.max_by(F.when(running, F.col("node_id")), F.when(running, F.col("planned"))).alias("active"), F.max_by(F.when(ended, F.col("node_id")), F.when(ended, F.struct("updated_at", "planned"))).alias("finished"))


def sampling_reason(fast: int = 800, sure: float = 0.75) -> Column:
    """Why an event's payload is kept whole; null where it may be made small: healthy, fast and sure completions (EV20, ST5)."""
    return (
        F.when(F.col("kind") != "node.completed", "other_kind").when(F.col("failed_commands") > 0, "command_failed").when(F.col("duration_ms").isNull(), "unknown_duration").when(F.col("duration_ms") >= fast, "slow")
        .when(F.col("confidence") < sure, "unsure"))


def spans(events: DataFrame) -> DataFrame:
    """Each executing event with the first completed or failed one after it and before the next executing one (JO24, SR22)."""
    e = events.filter("kind IN ('node.executing', 'node.completed', 'node.failed')")
    w = Window.partitionBy("graph_id", "node_id").orderBy("seq")
    begin = F.col("kind") == "node.executing"
    # runs of events that belong to one begin; its first end is the next row
    return e.withColumn("end_kind", F.lead("kind").over(w)).withColumn("end_seq", F.lead("seq").over(w)).filter(begin & F.coalesce(F.col("end_kind") != "node.executing", F.lit(False))).select("graph_id", "node_id", F.col("seq").alias("begin_seq"), "end_seq", F.when(F.col("end_kind") == "node.failed", "error").otherwise("ok").alias("status"))


def histogram(rows: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """Cumulative counts by upper bound, with +Inf, and the sum and count of all (AG22)."""
    rows = rows.filter(F.col(value).isNotNull())
    per = rows.groupBy(*keys).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("count"), F.sum(value).alias("sum"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n"))]
    return per.select(*keys, F.explode(F.array(*cells)).alias("x"), "sum", "count").select(*keys, "x.le", "x.n", "sum", "count")


def gauges(events: DataFrame, value: str, *keys: str) -> DataFrame:
    """A counter (sum) and a gauge (last value) by labels (AG23)."""
    return events.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("counter"), F.max_by(value, "seq").alias("gauge"))


def mode_of(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The most frequent non-empty value, the smallest of equals (AG24)."""
    n = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def delta(events: DataFrame, seen: int) -> DataFrame:
    """Status and counts of each graph before and after an event number (WI13)."""
    state = _map(GRAPH_STATES, F.col("kind"))
    was = state.isNotNull() & (F.col("seq") <= seen)
    n = lambda k, new: F.count(F.when((F.col("kind") == k) & (F.col("seq") > seen), 1)).alias(new)
    return events.groupBy("graph_id").agg(
        F.coalesce(_last(state, was), F.lit("planned")).alias("before"), F.coalesce(_last(state, state.isNotNull()), F.lit("planned")).alias("after"), F.count(F.when(F.col("seq") > seen, 1)).alias("new_events"),
        n("node.completed", "newly_completed"), n("node.failed", "newly_failed"))


def comparison(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Two graphs' figures side by side (JO26)."""
    side = lambda g, s: rows.filter(F.col("graph_id") == g).select(*[F.col(c).alias(f"{s}_{c}") for c in ("graph_id", "planned", "completed", "pass_rate")])
    return side(left, "left").crossJoin(side(right, "right"))  # one row each


def fallback_outputs(nodes: DataFrame, k: int = 3) -> DataFrame:
    """For each pending node the k completed nodes of its graph nearest in depth, latest first (TK8).

    Completed nodes of a graph are cut to the k latest of each depth before they meet.
    """
    w = Window.partitionBy("graph_id", "depth").orderBy(F.desc("completed_at"), F.desc("planned"))
    done = nodes.filter("status = 'completed'").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("graph_id", F.col("node_id").alias("found"), F.col("depth").alias("d"), "completed_at", "planned")
    asks = nodes.filter("status = 'pending'").select("graph_id", "node_id", "depth")
    near = Window.partitionBy("graph_id", "node_id").orderBy(F.abs(F.col("d") - F.col("depth")), F.desc("completed_at"), F.desc("planned"))
    return asks.join(done, "graph_id").withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).select("graph_id", "node_id", "found", "place")


def plan_faults(nodes: DataFrame, most: int = 12) -> DataFrame:
    """(graph_id, fault) of all plans at once (GR19): too many nodes, titles that repeat, no node without needs, nodes that can't be
    put in order (in or behind a cycle, or a need that isn't there), nodes that no such start leads to; and, where nodes have
    the columns intent, artifact and criteria (their number), intents of under eight characters and contracts without either.
    """
    own = nodes.select("graph_id", "node_id")
    needs = nodes.select("graph_id", "node_id", F.explode(F.array_distinct(F.split("needs", ","))).alias("need")).filter("need <> ''")
    there = own.select("graph_id", F.col("node_id").alias("need"), F.lit(True).alias("there"))
    needs = kept(needs.join(there, ["graph_id", "need"], "left"), "plan_needs")
    # a need that isn't there never ends: its node waits for itself
    order = levels(needs.select("graph_id", F.when(F.col("there"), F.col("need")).otherwise(F.col("node_id")).alias("src"), F.col("node_id").alias("dst")), ("graph_id",))
    starts = nodes.filter("needs = ''").select("graph_id", F.col("node_id").alias("id"))
    found = reachable(needs.filter("there").select("graph_id", F.col("need").alias("src"), F.col("node_id").alias("dst")), starts, ("graph_id",))
    lost = own.join(found.withColumnRenamed("id", "node_id"), ["graph_id", "node_id"], "left_anti")
    n = lambda x: F.count(F.when(x, 1))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    vague = n(F.length(text("intent")) < 8) if "intent" in nodes.columns else F.lit(0)
    unsigned = n((text("artifact") == "") | (F.coalesce("criteria", F.lit(0)) == 0)) if {"artifact", "criteria"} <= {*nodes.columns} else F.lit(0)
    g = nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"), n(F.col("needs") == "").alias("roots"), vague.alias("vague"), unsigned.alias("unsigned"))
    faults = F.array_compact(F.array(
        F.when(F.col("n") > most, "too_many_nodes"), F.when(F.col("titles") < F.col("n"), "titles_repeat"), F.when(F.col("vague") > 0, "vague_intent"),
        F.when(F.col("unsigned") > 0, "invalid_contract"), F.when(F.col("roots") == 0, "no_root")))
    out = g.select("graph_id", F.explode(faults).alias("fault"))
    some = lambda rows, name: rows.select("graph_id").distinct().select("graph_id", F.lit(name).alias("fault"))
    return out.unionByName(some(order.filter("level IS NULL"), "cyclic")).unionByName(some(lost, "unreachable"))


def similar_runs(target: DataFrame, others: DataFrame, k: int = 5) -> DataFrame:
    """The k others most like the target (one row; id, vector, words): by cosine where that is above zero, else by shared words (JO25, SEA17)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    t = F.broadcast(target.select(F.col("id").alias("t_id"), F.col("vector").alias("t_vector"), F.col("words").alias("t_words")))  # one row
    norm = F.sqrt(dot(F.col("vector"), F.col("vector"))) * F.sqrt(dot(F.col("t_vector"), F.col("t_vector")))
    cos = F.when((F.size("vector") == F.size("t_vector")) & (norm > 0), dot(F.col("vector"), F.col("t_vector")) / norm).otherwise(0.0)
    union = F.size(F.array_union("words", "t_words"))
    jac = F.when((F.size("words") > 0) & (F.size("t_words") > 0), F.size(F.array_intersect("words", "t_words")) / union).otherwise(0.0)
    out = others.join(t, F.col("id") != F.col("t_id")).withColumn("cos", cos).withColumn("score", F.round(F.when(F.col("cos") > 0, F.col("cos")).otherwise(jac), 6))
    return out.filter("score > 0").orderBy(F.desc("score"), "id").limit(k).select("id", "score")
