"""Neighbourhoods, paths and cycles of a graph.

Every step is a join of the frontier with the edges; frontiers are written (``kept``), so that plans don't grow with the
number of steps, and only what has changed is followed. Results that a budget bounds are small enough for the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import batches
from eventloom.operators import code as c
from eventloom.operators import graph as g
from eventloom.session import kept, sided

# Costs of relations and kinds, multipliers of provenances, penalties of nodes.
RELATION_COST = {"calls": 3.0, "references": 4.0, "depends_on": 5.0, "uses": 5.0, "route_to_handler": 6.0, "asset_references": 8.0}
CONSTRUCTOR_COST = {"structural": 90.0, "semantic": 32.0, "balanced": 28.0}
PROVENANCE_FACTOR = {"extracted": 1.0, "manual": 1.0, "inferred": 1.25, "ambiguous": 1.6}
STRUCTURAL_FACTOR = {"extracted": 1.0, "manual": 1.0, "inferred": 1.1, "ambiguous": 1.25}
MODES, RANK = ("semantic", "balanced", "structural"), ("cost", "tests", "structural", "hubs", "inheritance", "hops")


def parse_mode(name: str) -> str:
    """The path mode of a name, in any case; others are an error (SC34)."""
    if name.strip().lower() not in MODES:
        raise ValueError(f"unknown path mode {name!r}: one of {', '.join(MODES)}")
    return name.strip().lower()


def undirected(edges: DataFrame) -> DataFrame:
    return g.both_ways(edges)


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: list[str], *, budget: int = 40, depth: int = 4, mode: str = "bfs") -> tuple[DataFrame, DataFrame, bool]:
    """The nodes found from the seeds with their place, the edges among them, and whether the budget ran out (GR1, GR2).

    Neighbours are found in order of their parent's place, then id; ids that are no nodes use the budget up as well. Breadth
    first takes a level at a time, in Spark (``batches.neighbourhoods``); depth first takes the one found last, of at most
    ``budget`` ids that the driver holds.
    """
    seeds = list(dict.fromkeys(seeds))
    places = list(enumerate(seeds)) if mode == "bfs" else list(enumerate(_depth_first(edges, seeds, budget, depth)))
    place = edges.sparkSession.createDataFrame([(0, i, p) for p, i in places], "query_id int, id string, place long")
    if mode == "bfs":
        place = batches.neighbourhoods(edges, place, budget=budget, depth=depth)
    place = kept(place.select("id", F.col("place").cast("int").alias("place")), "neighbourhood")
    ids = place.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)
    return nodes.join(place, "id"), inner, place.count() >= budget


def _depth_first(edges: DataFrame, seeds: list[str], budget: int, depth: int) -> list[str]:
    spark, found, stack = edges.sparkSession, list(seeds), [(s, 0) for s in seeds]
    met, lists = set(found), {}

    def fetch(ids: list[str]) -> None:
        """The first neighbours of each id that could be new: as many as the budget."""
        asked = spark.createDataFrame([(i,) for i in ids], "a string")
        w = Window.partitionBy("a").orderBy("b")
        rows = batches.around(edges, asked).distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 2 * budget).select("a", "b").collect()  # bounded by the budget twice
        lists.update({i: [] for i in ids})
        for r in sorted(rows, key=lambda r: (r["a"], r["b"])):
            lists[r["a"]].append(r["b"])

    while stack and len(found) < budget:
        missing = [i for i, d in stack if d < depth and i not in lists]
        if missing:
            fetch(missing)
        at, d = stack.pop()
        for b in lists.get(at, []) if d < depth else []:
            if b not in met and len(found) < budget:
                met.add(b)
                found.append(b)
                stack.append((b, d + 1))
    return found


def search(nodes: DataFrame, edges: DataFrame, query: str, *, lens: str | None = None, requested: str = "balanced", k: int = 5, budget: int = 40, depth: int = 4, mode: str = "bfs") -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Lens, seeds, neighbourhood, and the communities of what was found: (nodes, edges, communities, truncated) (GR3)."""
    if lens:
        nodes, edges = c.lens_graph(nodes, edges, lens)
        nodes, edges = kept(nodes, "lens_nodes"), kept(edges, "lens_edges")
    seeds = [r["id"] for r in c.seeds(nodes, query, k, requested).orderBy("place").collect()]  # k ids
    found, inner, truncated = neighbourhood(nodes, edges, seeds, budget=budget, depth=depth, mode=mode)
    home = edges.filter("kind = 'belongs_to'").select(F.col("src").alias("id"), F.col("dst").alias("community"))
    homes = found.select("id").join(home, "id").join(nodes.filter("kind = 'community'").select(F.col("id").alias("community"), F.col("label").alias("community_label")), "community")
    return found, inner, homes.groupBy("community", "community_label").agg(F.count("*").alias("found")), truncated


def hops_from(edges: DataFrame, start: str, most: int) -> DataFrame:
    """id, hops, path: the least path in hops from a node to every other within ``most``; of equal ones the least by ids (GR4)."""
    near = kept(undirected(edges), "adjacency")
    reached = frontier = kept(edges.sparkSession.createDataFrame([(start, 0, [start])], "id string, hops int, path array<string>"), "hops")
    for h in range(1, most + 1):
        step = near.join(frontier.select(F.col("id").alias("a"), "path"), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.array_append("path", F.col("b"))).alias("path"))
        frontier = kept(step.join(reached.select("id"), "id", "left_anti").select("id", F.lit(h).alias("hops"), "path"), "hops")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def component(edges: DataFrame, start: str, most: int = 64) -> DataFrame:
    """Ids that a node is connected with, however far (GR13)."""
    near = kept(undirected(edges), "adjacency")
    reached = frontier = kept(edges.sparkSession.createDataFrame([(start,)], "id string"), "component")
    for _ in range(most):
        step = near.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = kept(step.join(reached, "id", "left_anti"), "component")
        if frontier.isEmpty():
            return reached
        reached = kept(reached.unionByName(frontier), "component")
    raise RuntimeError(f"more than {most} steps away from {start}")


def edge_cost(mode: str = "balanced", intent: str = "mixed_or_unknown", lens: str | None = None) -> Column:
    """What an edge costs on a path; null where a path may not use it. src_test, dst_test: whether an end is a test (GR6)."""
    r, kind, code = c.relation(), F.col("kind"), intent == "code_to_code"
    relation_cost = F.when(r == "constructor", CONSTRUCTOR_COST[mode]).when(r == "tests", 4.0 if lens == "tests" else 24.0).otherwise(c.lookup(RELATION_COST, r))
    belongs = F.lit(45.0) if mode == "structural" else F.when(r == "belongs_to", 220.0).otherwise(120.0)
    kinds = {"references": 4.0, "depends_on": 5.0, "implements": 14.0 if code else 8.0, "inherits": 16.0 if code else 9.0, "tests": 4.0 if lens == "tests" else 24.0, "declares": 28.0, "documents": 55.0, "related_to": 50.0, "build_produces": 75.0}
    kind_cost = F.when(kind == "belongs_to", belongs).otherwise(F.coalesce(c.lookup(kinds, kind), F.lit(35.0)))
    factor = F.coalesce(c.lookup(STRUCTURAL_FACTOR if mode == "structural" else PROVENANCE_FACTOR, F.col("provenance")), F.lit(1.4))
    cost = F.coalesce(relation_cost, kind_cost) * factor
    if code and mode != "structural":
        cost = F.when(r == "belongs_to", F.greatest(cost, F.lit(320.0 if mode == "semantic" else 220.0))).otherwise(cost)
    if code:
        semantic = r.isin("calls", "references", "depends_on", "uses", "route_to_handler", "tests", "asset_references")
        cost = F.when(relation_cost.isNotNull() & semantic, F.least(cost, relation_cost)).otherwise(cost)
    barred = F.lit(False)
    if mode == "semantic":
        barred = barred | ~c.is_semantic_edge()
    if code and mode != "structural":
        barred = barred | (kind == "documents") | F.coalesce(F.col("relation").isin("doc_link", "doc_wikilink", "doc_code_ref"), F.lit(False))
    if lens != "tests":
        barred = barred | ((r == "constructor") & (F.col("src_test") | F.col("dst_test")))
    return F.when(~barred, cost)


def node_penalty(mode: str = "balanced", intent: str = "mixed_or_unknown", lens: str | None = None) -> Column:
    """What a node costs on a path, whole numbers, halves upwards (GR7)."""
    kind, low, code = F.col("kind"), F.lower("label"), intent == "code_to_code"
    no_docs = code and mode != "structural"
    symbol = (
        F.when(low.contains("(namespace)"), 900).when(low.contains("(external)"), 700).when(low.contains("(interface)"), 180 if code else 80).when(low.rlike(r"\((field|property)\)"), 240)
        .when(low.rlike(r"\((method|function)\)"), 12).otherwise(2))
    plain = {"workspace": 5000, "package": 450, "directory": 400, "community": 350, "god_node": 250, "config_file": 120, "doc_section": 50_000 if no_docs else 35, "doc_file": 50_000 if no_docs else 100,
             "asset_file": 90, "external_dep": 500, "test": 4 if lens == "tests" else 12_000, "code_file": 18, "route": 24, "command": 24}
    project = F.when((F.col("label") == "workspace-root") | F.col("path").eqNullSafe("."), 2500).otherwise(600)
    base = F.when(kind == "symbol", symbol).when(kind == "project", project).otherwise(F.coalesce(c.lookup(plain, kind), F.lit(40)))
    whole = F.floor(base * (0.35 if mode == "structural" else 1.0) + 0.5).cast("long")
    out = F.when(kind.isin(*c.DOC_KINDS), 50_000).otherwise(whole) if no_docs else whole
    if code and lens != "tests":
        tested = F.when(c.is_test(), 12_000).otherwise(out)
        out = F.when(kind.isin(*c.DOC_KINDS), out).otherwise(tested) if no_docs else tested
    return F.when(c.is_low_value_bridge(), 50_000).otherwise(out) if mode == "semantic" else out


def weighted(nodes: DataFrame, edges: DataFrame, *, mode: str = "balanced", intent: str = "mixed_or_unknown", lens: str | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """Steps a to b of usable edges, with the parts of the rank that each adds (GR6, GR7); degrees (id, degree) where edges are not all of the nodes'."""
    known = c.with_degree(nodes, edges) if degrees is None else nodes.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = known.select(
        F.col("id"), node_penalty(mode, intent, lens).alias("penalty"), c.is_test().cast("int").alias("t"), (c.is_low_value_bridge() | (F.col("degree") >= 12)).cast("int").alias("hub"))
    r, kind = c.relation(), F.col("kind")
    structural = r.isin("belongs_to", "source_file", "declares", "constructor", "project_reference", "using_directive") | kind.isin("belongs_to", "declares")
    heirs = r.isin("inherits", "implements") | kind.isin("inherits", "implements")
    # both costs before the joins, with tests at the ends and without, so that few and narrow columns are shuffled
    cost = edge_cost(mode, intent, lens).cast("double")
    e = edges.withColumns({"src_test": F.lit(False), "dst_test": F.lit(False)}).withColumn("plain_cost", cost).withColumn("src_test", F.lit(True)).withColumn("test_cost", cost)
    e = e.filter("plain_cost IS NOT NULL").select("src", "dst", F.col("id").alias("edge"), "plain_cost", F.col("test_cost").isNotNull().alias("for_tests"), structural.cast("int").alias("structural"), heirs.cast("int").alias("inheritance"))
    end = lambda x: n.select(F.col("id").alias(x), F.struct("penalty", "t", "hub").alias(f"{x}_node"))
    e = e.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    test = lambda x: F.coalesce(F.col(f"{x}_node.t") == 1, F.lit(False))
    e = e.filter(F.col("for_tests") | ~(test("src") | test("dst")))
    ways = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"{b}_node").alias("node")) for a, b in (("src", "dst"), ("dst", "src"))])
    steps = e.select(F.explode(ways).alias("way"), "edge", F.col("plain_cost").alias("cost"), "structural", "inheritance").filter("way.node IS NOT NULL")
    return steps.select("way.b", "way.a", "edge", "cost", "structural", "inheritance", "way.node.penalty", "way.node.t", "way.node.hub")


def ranks(steps: DataFrame, start: str, *, most: int = 12, goal: str | None = None) -> DataFrame:
    """id, rank, pred, edge: the least rank of each node from start (cost, then tests, structural steps, hubs, inheritance and hops
    on the way), within ``most`` steps (GR5); with a goal only of nodes below it.

    Of equal ranks the predecessor with the least rank and id counts, then the least edge.
    """
    tries = steps.sparkSession.createDataFrame([(0, 0, "", start, goal)], "case_id int, pair int, how string, a string, b string")
    return kept(batches.ranks_of(steps.withColumn("how", F.lit("")), tries, most=most).drop("case_id", "pair"), "ranks")


def path_to(best: DataFrame, goal: str) -> list[dict] | None:
    """The steps from the start to a goal, by their predecessors; a path's length of rows."""
    key = {"case_id": F.lit(0), "pair": F.lit(0)}
    goals = best.sparkSession.createDataFrame([(0, 0, goal)], "case_id int, pair int, id string")
    rows = batches.traced(best.withColumns(key), goals).orderBy("hop").collect()
    return [{"id": r["id"], "edge": r["edge"], "cost": r["cost"]} for r in rows] or None


class Steps:
    """The weighted steps of a graph: all of a mode and an intent, those between some nodes, and those around some. The last two read the edges by the nodes, without moving them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, lens: str | None = None):
        self.nodes, self.edges, self.lens, self.weights = nodes, edges, lens, {}

    def __call__(self, mode: str, intent: str) -> DataFrame:
        return weighted(self.nodes, self.edges, mode=mode, intent=intent, lens=self.lens)

    def within(self, mode: str, intent: str, ids: DataFrame, n: int) -> DataFrame:
        """The steps with both ends among n ids."""
        met = kept(g.touching(self.edges, ids, n), "path_edges")
        return weighted(self.nodes.join(sided(ids, n), "id", "left_semi"), met.filter("src_in AND dst_in").select(self.edges.columns), mode=mode, intent=intent, lens=self.lens, degrees=g.degree_among(met))

    def near(self, rows: DataFrame, n: int, hows: list[tuple[str, str]]) -> DataFrame:
        """rows (way, id, cost, penalty, t; how and keys), n in number, one step on: of a step out the cost without the entered node's, and whether tests may take it."""
        keys = ["case_id", "pair", "how", "way"]
        # written, so that what the few edges cost isn't part of the pass over all
        met = kept(g.touching(self.edges.select("src", "dst", "kind", "provenance", "relation"), rows.select("id").distinct(), n), "path_near")
        ends = F.array(F.when(F.col("src_in"), F.struct(F.col("src").alias("at"), F.col("dst").alias("id"))), F.when(F.col("dst_in"), F.struct(F.col("dst").alias("at"), F.col("src").alias("id"))))
        e = met.select("kind", "provenance", "relation", F.explode(ends).alias("end")).filter("end IS NOT NULL").select("kind", "provenance", "relation", "end.*")
        e = e.join(rows.select(*keys, F.col("id").alias("at"), F.col("cost").alias("so_far"), "penalty", "t"), "at")
        cost = F.coalesce(*[F.when(F.col("how") == "|".join(x), edge_cost(*x, self.lens).cast("double")) for x in hows])
        e = e.withColumns({"src_test": F.lit(False), "dst_test": F.lit(False)}).withColumn("plain", cost).withColumn("src_test", F.lit(True)).withColumn("for_tests", cost.isNotNull())
        e = e.filter(F.col("plain").isNotNull() & (F.col("for_tests") | (F.col("t") == 0)))
        own = F.when(F.col("way") == "in", F.col("penalty")).otherwise(0)
        return e.groupBy(*keys, "id", "for_tests").agg(F.min(F.col("so_far") + F.col("plain") + own).alias("cost"))

    def placed(self, rows: DataFrame, hows: list[tuple[str, str]]) -> DataFrame:
        """rows whose id is a node, with its penalty and whether it is a test; steps that tests may not take end at none, and the way out costs the node's penalty."""
        for x in hows:
            if x not in self.weights:
                self.weights[x] = kept(self.nodes.select("id", node_penalty(*x, self.lens).cast("double").alias("penalty"), c.is_test().cast("int").alias("t")), "path_weights")
        rows = kept(rows, "path_rows")
        n = rows.count()
        out = reduce(DataFrame.unionByName, [self.weights[x].join(sided(rows.filter(F.col("how") == "|".join(x)), n), "id") for x in hows])
        if "for_tests" not in rows.columns:
            return out
        return out.filter(F.col("for_tests") | (F.col("t") == 0)).withColumn("cost", F.col("cost") + F.when(F.col("way") == "out", F.col("penalty")).otherwise(0)).drop("for_tests")


def steps_by(nodes: DataFrame, edges: DataFrame, lens: str | None = None) -> Steps:
    """What ``batches`` asks for the weighted steps of a mode and an intent."""
    return Steps(nodes, edges, lens)


def ranked_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, *, lens: str | None = None, mode: str = "balanced", most: int = 12, whole: bool = True) -> tuple[list[dict] | None, str, str]:
    """The path between the nodes that two queries name, its mode and its intent: a single case of ``batches.ranked_paths`` (GR8)."""
    if lens:
        nodes, edges = c.lens_graph(nodes, edges, lens)
        nodes, edges = kept(nodes, "path_nodes"), kept(edges, "path_edges")
    case = nodes.sparkSession.createDataFrame([(0, source, target, mode)], "case_id int, source string, target string, mode string")
    chosen, paths = batches.ranked_paths(nodes, edges, case, steps_by(nodes, edges, lens), most=most, whole=whole)
    one = chosen.first()
    rows = paths.orderBy("hop").collect()
    path = [{"id": r["id"], "edge": r["edge"], "cost": r["cost"]} for r in rows] or None
    return (path, one["mode"], one["intent"]) if one else (None, mode, "mixed_or_unknown")


def has_hub(nodes: DataFrame, edges: DataFrame, path: list[dict]) -> bool:
    """Whether a node inside a path is a hub (GR10)."""
    inner = [s["id"] for s in path[1:-1]]
    rows = c.with_degree(nodes.filter(F.col("id").isin(*inner)), edges.filter(F.col("src").isin(*inner) | F.col("dst").isin(*inner))) if inner else None
    return bool(inner) and not rows.filter(c.is_low_value_bridge() | (F.col("degree") >= 12)).isEmpty()


def explained(nodes: DataFrame, edges: DataFrame, path: list[dict], *, mode: str = "balanced", intent: str = "mixed_or_unknown") -> DataFrame:
    """The steps of a path as rows: hop, id, label, kind, the edge's relation, class and cost, the node's penalty (GR9)."""
    steps = F.broadcast(nodes.sparkSession.createDataFrame([(i, s["id"], s["edge"]) for i, s in enumerate(path)], "hop int, id string, edge string"))  # a path's length
    e = edges.withColumn("src_test", F.lit(False)).withColumn("dst_test", F.lit(False)).select(F.col("id").alias("edge"), c.relation().alias("relation"), c.edge_class().alias("class"), edge_cost(mode, intent).alias("cost"), F.col("kind").alias("edge_kind"))
    penalty = F.when(F.col("hop") > 0, node_penalty(mode, intent)).otherwise(0)
    e = F.broadcast(e.join(steps.select("edge"), "edge", "left_semi"))  # of the edges the path's alone are sent
    return steps.join(nodes, "id").withColumn("penalty", penalty.cast("long")).join(e, "edge", "left").select("hop", "id", "label", "kind", "edge", "relation", "class", "edge_kind", "cost", "penalty")


def quality(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row about explained steps: edges by class, hubs, outside nodes, inheritance, directness between 0 and 1, relations in order (GR21);
    with keys (columns of steps) a row for each path."""
    n = lambda x: F.count(F.when(x, 1))
    out = steps.groupBy(*keys).agg(
        n(F.col("class") == "semantic").alias("semantic"), n(F.col("class") == "structural").alias("structural"), n(F.col("kind").isin("community", "project", "workspace")).alias("hubs"), n(F.lower("label").contains("(external)")).alias("outside"),
        n(F.col("relation").isin("inherits", "implements") | (F.col("edge_kind") == "inherits")).alias("inheritance"), F.greatest(F.count("edge"), F.lit(1)).alias("hops"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("edge").isNotNull(), F.struct("hop", "relation")))), lambda x: x["relation"]), ",").alias("relations"))
    direct = (F.col("semantic") + 1) / (F.col("semantic") + F.col("structural") + F.col("hubs") + F.col("inheritance") + F.col("hops"))
    return out.withColumn("directness", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), direct)), 6))


def explain_node(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """The neighbours of the node that a query names, by label, with the edges between (GR11)."""
    node = c.candidates(nodes, query, 1).select(F.col("id").alias("node"))
    e = edges.select(F.col("id").alias("edge"), "src", "dst", F.col("kind").alias("edge_kind"), "provenance")
    mine = e.join(F.broadcast(node), (F.col("src") == F.col("node")) | (F.col("dst") == F.col("node")))  # one row
    other = F.when(F.col("src") == F.col("node"), F.col("dst")).otherwise(F.col("src"))
    return mine.withColumn("id", other).join(nodes.select("id", "label", "kind"), "id").select("node", "edge", "edge_kind", "provenance", "id", "label", "kind")


def cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """Simple directed cycles of up to ``longest`` nodes, each once: from its least id on (GR14)."""
    e = kept(edges.select("src", "dst").distinct().filter("src <> dst"), "cycle_edges")
    paths = e.filter("dst > src").select(F.col("src").alias("first"), F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = None
    for _ in range(2, longest + 1):
        paths = kept(paths, "cycle_paths")
        closed = paths.join(e, (F.col("at") == F.col("src")) & (F.col("first") == F.col("dst"))).select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        paths = paths.join(e, F.col("at") == F.col("src")).filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select("first", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
        if paths.isEmpty():
            break
    return found


def levels(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """id, level: the longest way to each node from one without predecessors; null for nodes in or behind a cycle (TK9).

    Nodes without open predecessors leave level by level, until none leaves; what stays then is cyclic. With keys (columns of
    edges) each combination of them is a graph of its own, and all graphs are peeled at once: steps are as many as the longest
    chain of any graph has.
    """
    key = list(keys)
    open_ = kept(edges.select(*key, "src", "dst").distinct(), "levels")
    ends = open_.select(*key, F.col("src").alias("id"), F.lit(0).alias("n")).unionByName(open_.select(*key, F.col("dst").alias("id"), F.lit(1).alias("n")))
    rest = kept(ends.groupBy(*key, "id").agg(F.sum("n").alias("n")), "levels")
    # a node leaves once, and takes its own edges from its successors' open ones; edges are never written again
    ready, rest = rest.filter("n = 0").select(*key, "id").withColumn("level", F.lit(0)), rest.filter("n > 0")
    out, level = None, 0
    while not ready.isEmpty():
        out = ready if out is None else out.unionByName(ready)
        level += 1
        taken = open_.join(ready.select(*key, F.col("id").alias("src")), [*key, "src"], "left_semi").groupBy(*key, F.col("dst").alias("id")).agg(F.count("*").alias("taken"))
        left = kept(rest.join(taken, [*key, "id"], "left").select(*key, "id", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n")), "levels")
        ready, rest = left.filter("n = 0").select(*key, "id").withColumn("level", F.lit(level)), left.filter("n > 0")
    stuck = rest.select(*key, "id").withColumn("level", F.lit(None).cast("int"))
    return stuck if out is None else out.unionByName(stuck)


def reachable(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ids that directed edges lead to from the starts (id), themselves included; of each graph where keys name its columns."""
    key = list(keys)
    way = kept(edges.select(*key, F.col("src").alias("id"), "dst").distinct(), "reachable_edges")
    reached = frontier = kept(starts.select(*key, "id").distinct(), "reachable")
    while not frontier.isEmpty():
        step = way.join(frontier, [*key, "id"]).select(*key, F.col("dst").alias("id")).distinct()
        frontier = kept(step.join(reached, [*key, "id"], "left_anti"), "reachable")
        reached = kept(reached.unionByName(frontier), "reachable")
    return reached


def impact(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, role): what selected nodes import, what imports them, and what else is linked (GR15)."""
    pick = lambda end, other, role: edges.join(selected.select(F.col("id").alias(end)), end, "left_semi").select(F.col(other).alias("id"), role.alias("role"))
    rows = pick("src", "dst", F.when(F.col("kind") == "depends_on", "imports").otherwise("linked")).unionByName(pick("dst", "src", F.when(F.col("kind") == "depends_on", "imported_by").otherwise("linked")))
    return rows.join(nodes.select("id"), "id", "left_semi").join(selected.select("id"), "id", "left_anti").distinct()


def orphan_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Code files without a dependency or semantic link of their own or of their symbols (GR16)."""
    links = edges.filter(~F.col("kind").isin("belongs_to", "declares"))
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    symbols = nodes.filter("kind = 'symbol'").select(F.col("id").alias("src"))
    by_symbol = edges.filter("kind = 'belongs_to'").join(symbols, "src", "left_semi").join(ends.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    files = nodes.filter("kind = 'code_file'").select("id")
    return files.join(ends, "id", "left_anti").join(by_symbol, "id", "left_anti")


def quick_filters(nodes: DataFrame, edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(filter, id): nodes by what a reader may look for: dependencies, semantic links, outside nodes, unresolved ends, orphans, cycles of dependencies (FI16)."""
    ends = lambda e, name: e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().select(F.lit(name).alias("filter"), "id")
    outside = nodes.filter("kind = 'external_dep'").select(F.lit("external").alias("filter"), "id")
    lost = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(nodes.select("id"), "id", "left_anti").select(F.lit("unresolved").alias("filter"), "id")
    round_ = cycles(dependencies, 4).select(F.explode(F.split("cycle", ">")).alias("id")).distinct().select(F.lit("cycles").alias("filter"), "id")
    parts = [ends(edges.filter("kind = 'depends_on'"), "dependencies"), ends(edges.filter(c.edge_class() == "semantic"), "semantic"), outside, lost, orphan_files(nodes, edges).select(F.lit("orphans").alias("filter"), "id"), round_]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def architecture_health(nodes: DataFrame, edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Nodes by quick filter, the sections of a health report (GR17)."""
    return quick_filters(nodes, edges, dependencies).groupBy("filter").agg(F.count("*").alias("n"))
