"""Many queries and paths at once: frontiers are keyed by query and node, and ranks and budgets hold within a query.

A loop takes as many steps as its deepest query, whatever the number of queries. Edges are read by the frontier, which
budgets bound, so no second copy of them is made. A step writes the rows that have changed alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import code as c
from eventloom.operators import graph as g
from eventloom.session import kept, sided

RANK = "struct<cost:double,tests:int,structural:int,hubs:int,inheritance:int,hops:int>"
#: The cost up to which both ends of a path go on at first, how it grows while they don't meet, and what rounding may make of a cost.
REACH, WIDER, SLACK = 32.0, 2.0, 1e-6


def around(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """frontier (with its nodes in column a) and each neighbour b of a, whichever way an edge goes."""
    way = lambda a, b: edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(frontier, "a")
    return way("src", "dst").unionByName(way("dst", "src"))


def neighbourhoods(edges: DataFrame, seeds: DataFrame, *, budget: int = 40, depth: int = 4) -> DataFrame:
    """query_id, id, place of what each query finds breadth first (GR1, SEA21), from seeds (query_id, id, place from 0 on).

    Neighbours are found in order of their parent's place, then id; a query ends when its budget of ids is used up, and keeps
    all its seeds. Of a parent's neighbours twice the budget, by id, hold as many new ones as the budget can take.
    """
    found = frontier = kept(seeds.select("query_id", "id", F.col("place").cast("long").alias("place")), "neighbourhoods")
    for _ in range(depth):
        near = around(edges, frontier.select("query_id", F.col("id").alias("a"), F.col("place").alias("parent"))).distinct()
        few = Window.partitionBy("query_id", "a").orderBy("b")
        near = near.withColumn("k", F.row_number().over(few)).filter(F.col("k") <= 2 * budget)
        new = near.groupBy("query_id", F.col("b").alias("id")).agg(F.min("parent").alias("parent")).join(found, ["query_id", "id"], "left_anti")
        so_far = found.groupBy("query_id").agg((F.max("place") + 1).alias("n"))
        place = F.col("n") + F.row_number().over(Window.partitionBy("query_id").orderBy("parent", "id")) - 1
        frontier = kept(new.join(so_far, "query_id").withColumn("place", place).filter(F.col("place") < budget).select("query_id", "id", "place"), "neighbourhoods")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def ranks_of(steps: DataFrame, tries: DataFrame, *, most: int = 12) -> DataFrame:
    """case_id, pair, id, rank, before, pred, edge: the least rank of nodes from a try's start, within ``most`` steps (GR5).

    steps: how, a, b, edge and what each adds; tries: case_id, pair, how, a (start), b (goal or null). Only nodes that improved
    go on, and only while they are below the goal's rank. Of equal ranks the predecessor with the least rank and id counts,
    then the least edge.
    """
    key = ["case_id", "pair"]
    zero = F.struct(F.lit(0.0).alias("cost"), *[F.lit(0).alias(x) for x in ("tests", "structural", "hubs", "inheritance", "hops")]).cast(RANK)
    none = F.lit(None).cast("string")
    changed = frontier = kept(tries.select(*key, "how", F.col("a").alias("id"), F.struct(zero.alias("rank"), zero.alias("before"), none.alias("pred"), none.alias("edge")).alias("x")), "ranks")
    ends = tries.select(*key, F.col("a").alias("start"), F.col("b").alias("goal"))
    n = total = frontier.count()
    for _ in range(most):
        r = lambda name, add: (F.col("rank")[name] + F.col(add)).alias(name)
        new = F.struct((F.col("rank.cost") + F.col("cost") + F.col("penalty")).alias("cost"), r("tests", "t"), r("structural", "structural"), r("hubs", "hub"), r("inheritance", "inheritance"), (F.col("rank.hops") + 1).alias("hops")).cast(RANK)
        step = steps.join(sided(frontier.select(*key, "how", F.col("id").alias("a"), F.col("x.rank").alias("rank")), n), ["how", "a"])
        step = step.select(*key, "how", F.col("b").alias("id"), F.struct(new.alias("rank"), F.col("rank").alias("before"), F.col("a").alias("pred"), "edge").alias("x"))
        step = step.groupBy(*key, "how", "id").agg(F.min("x").alias("x"))
        known = changed.groupBy(*key, "id").agg(F.min("x").alias("known"))
        goal = ends.select(*key, F.col("goal").alias("id")).join(known, [*key, "id"]).select(*key, F.col("known.rank").alias("bound"))
        better = step.join(sided(known, total), [*key, "id"], "left").filter(F.col("known").isNull() | (F.col("x") < F.col("known")))
        better = better.join(ends, key).filter("id <> start").join(goal, key, "left")
        frontier = kept(better.withColumn("on", F.col("bound").isNull() | (F.col("x.rank") < F.col("bound"))).select(*key, "how", "id", "x", "on"), "ranks")
        n = frontier.count()
        if not n:
            break
        total += n
        changed = changed.unionByName(frontier.drop("on"))
        # those that have reached no better place than the goal's are kept, but lead nowhere
        found = frontier.join(ends.select(*key, F.col("goal").alias("id")), [*key, "id"]).groupBy(*key).agg(F.min("x.rank").alias("now"))
        frontier = frontier.filter("on").join(found, key, "left").filter(F.col("now").isNull() | (F.col("x.rank") < F.col("now"))).drop("on", "now")
    return changed.groupBy(*key, "id").agg(F.min("x").alias("x")).select(*key, "id", "x.*")


def corridor(steps_of, tries: DataFrame, hows: list[tuple[str, str]], most: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """how, id: the nodes that a least path of a try can be on; the tries that a path connects, with its cost whatever its hops; those given up.

    Both ends of a try go on at once, from nodes within a reach that grows until they meet; from then on the reach is half the
    least cost at which they met. Every node of a least path lies within half its cost of one end, so nothing further away is
    looked at. A side that has no node left to go on from meets nothing; a try that isn't done after three times ``most`` rounds
    is given up.
    """
    key, where = ["case_id", "pair"], ["case_id", "pair", "how", "way", "id"]
    end = lambda x, way: tries.select(*key, "how", F.lit(way).alias("way"), F.col(x).alias("id"), F.lit(0.0).alias("cost"))
    known = steps_of.placed(end("a", "out").unionByName(end("b", "in")), hows).withColumn("open", F.lit(True))
    reach, some = REACH, lambda x: F.count(F.when(x, 1)) > 0
    for _ in range(3 * most):
        side = lambda way: known.filter(F.col("way") == way).select(*key, "id", F.col("cost").alias(way))
        least = side("out").join(side("in"), [*key, "id"]).groupBy(*key).agg(F.min(F.col("out") + F.col("in")).alias("least"))
        ways = known.groupBy(*key).agg((some(F.col("open") & (F.col("way") == "out")) & some(F.col("open") & (F.col("way") == "in"))).alias("both"))
        within = F.when(F.col("least").isNotNull(), F.col("least") / 2 + SLACK * (1 + F.col("least"))).when(F.col("both"), F.lit(reach)).otherwise(-1.0)
        rows = known.join(ways.join(least, key, "left"), key).withColumn("on", F.col("open") & (F.col("cost") <= within))
        rows = kept(rows.withColumn("waits", F.col("open") & ~F.col("on") & F.col("least").isNull() & F.col("both")), "corridor_rows")
        n, nearest = rows.agg(F.count(F.when(F.col("on"), 1)), F.min(F.when(F.col("waits"), F.col("cost")))).first()
        if not n and nearest is None:
            break
        if n:
            more = steps_of.placed(steps_of.near(rows.filter("on"), n, hows), hows).withColumn("open", F.lit(True))
            rows = rows.withColumn("open", F.col("open") & ~F.col("on")).select(more.columns).unionByName(more)
            # of equal costs the one that has gone on
            x = F.min(F.struct("cost", "open")).alias("x")
            known = rows.groupBy(*where).agg(x, F.first("penalty").alias("penalty"), F.first("t").alias("t")).select(*where, "x.*", "penalty", "t")
        else:
            known = rows.select(known.columns)
            reach = max(reach * WIDER, nearest)
    done = rows.filter("least IS NOT NULL")
    ids = kept(done.filter(F.col("cost") <= F.col("least") / 2 + SLACK * (1 + F.col("least"))).select("how", "id").distinct(), "corridor_ids")
    left = rows.filter("on OR waits").select(*key).distinct()
    return ids, kept(tries.join(done.select(*key, "least").distinct(), key).join(left, key, "left_anti"), "corridor_met"), kept(tries.join(left, key, "left_semi"), "corridor_left")


def least_ranks(steps_of, tries: DataFrame, *, most: int = 12) -> DataFrame:
    """``ranks_of`` the nodes on the least paths of tries (case_id, pair, how, mode, intent, a, b) to their goals, by the steps of their corridors.

    Where the least cost takes more than ``most`` steps, or a corridor was given up, all steps count.
    """
    key, hows = ["case_id", "pair"], [(r["mode"], r["intent"]) for r in tries.select("mode", "intent").distinct().collect()]  # a few modes by a few intents
    steps = lambda among: reduce(DataFrame.unionByName, [among(*x).withColumn("how", F.lit("|".join(x))) for x in hows])
    ids, met, left = corridor(steps_of, tries, hows, most)
    best, n = None, ids.count()
    if not met.isEmpty():
        near = steps(lambda mode, intent: steps_of.within(mode, intent, ids.filter(F.col("how") == f"{mode}|{intent}").select("id"), n))
        best = kept(ranks_of(kept(near, "steps"), met.select(*key, "how", "a", "b"), most=most), "path_ranks")
        found = best.select(*key, F.col("id").alias("b"), F.col("rank.cost").alias("cost")).join(met.select(*key, "b", "least"), [*key, "b"])
        left = kept(left.unionByName(met.join(found.filter(F.col("cost") <= F.col("least") + SLACK * (1 + F.col("least"))), key, "left_anti").select(left.columns)), "path_left")
    if left.isEmpty():
        return best
    whole = kept(ranks_of(kept(steps(steps_of), "steps"), left.select(*key, "how", "a", "b"), most=most), "path_ranks")
    return whole if best is None else best.join(left, key, "left_anti").unionByName(whole)


def traced(best: DataFrame, goals: DataFrame) -> DataFrame:
    """case_id, pair, hop, id, edge, cost: the steps of each path from its start to its goal (case_id, pair, id), by their predecessors."""
    at, out, back = goals, None, 0
    while True:
        row = kept(at.join(best, ["case_id", "pair", "id"]).select("case_id", "pair", F.lit(back).alias("back"), "id", "edge", F.col("rank.cost").alias("cost"), "pred"), "path")
        out = row if out is None else out.unionByName(row)
        at, back = row.filter("pred IS NOT NULL").select("case_id", "pair", F.col("pred").alias("id")), back + 1
        if at.isEmpty():
            break
    hop = F.max("back").over(Window.partitionBy("case_id", "pair")) - F.col("back")
    return out.withColumn("hop", hop.cast("int")).drop("back", "pred")


def ranked_paths(nodes: DataFrame, edges: DataFrame, cases: DataFrame, steps_of, *, most: int = 12, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The path of each case (case_id, source, target, mode) between the nodes that its two queries name (GR8, SEA21).

    Cases: case_id, a, b (the ends), mode, intent; and their steps: case_id, hop, id, edge, cost; none where no path was found.
    Only where the best pair of candidates isn't connected do other pairs count, the cheapest of them first. A balanced path
    over hubs gives way to a semantic one without. steps_of: the graph's ``paths.Steps``. Cases with the same ends, mode and intent
    are one search.
    """
    asked = cases.select(F.col("source").alias("query")).union(cases.select("target")).distinct().withColumn("query_id", F.col("query"))
    ends = kept(c.candidates_of(nodes, asked, 3).select("query", "place", "id", "kind"), "path_ends")
    end = lambda q, x: ends.select(F.col("query").alias(q), F.col("place").alias(f"{x}_place"), F.col("id").alias(x), F.col("kind").alias(f"{x}_kind"))
    pairs = cases.join(end("source", "a"), "source").join(end("target", "b"), "target").withColumn("intent", c.path_intent(F.col("a_kind"), F.col("b_kind")))
    pairs = kept(pairs.select("case_id", ((F.col("a_place") - 1) * 3 + F.col("b_place") - 1).alias("pair"), "a", "b", "mode", "intent"), "path_pairs")

    def solved(tries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The tries with the cost of their goal, and all ranks."""
        tries = tries.filter("a <> b").withColumn("how", F.concat_ws("|", "mode", "intent"))
        same = ["how", "mode", "intent", "a", "b"]
        leads = kept(tries.groupBy(*same).agg(F.min(F.struct("case_id", "pair")).alias("x")).select("x.*", *same), "path_tries")
        best = None if leads.isEmpty() else least_ranks(steps_of, leads, most=most)
        if best is None:
            return tries.withColumn("cost", F.lit(0.0)).limit(0), None
        mine = tries.select(*same, "case_id", "pair").join(leads.select(*same, F.struct("case_id", "pair").alias("lead")), same).select("lead", "case_id", "pair")
        best = kept(best.withColumn("lead", F.struct("case_id", "pair")).drop("case_id", "pair").join(mine, "lead").drop("lead"), "path_ranks")
        reached = best.select("case_id", "pair", F.col("id").alias("b"), F.col("rank.cost").alias("cost"))
        return kept(tries.join(reached, ["case_id", "pair", "b"]), "path_goals"), best

    def steps_of_goals(goals: DataFrame, best: DataFrame | None) -> DataFrame:
        if best is None:
            return cases.sparkSession.createDataFrame([], f"case_id {dict(cases.dtypes)['case_id']}, hop int, id string, edge string, cost double")
        return traced(best, goals.select("case_id", "pair", F.col("b").alias("id"))).select("case_id", "hop", "id", "edge", "cost")

    goals, best = solved(pairs.filter("pair = 0"))
    paths = steps_of_goals(goals, best)
    chosen = goals.select("case_id", "a", "b", "mode", "intent", "pair")
    if whole:
        rest = pairs.filter("pair > 0").join(goals, "case_id", "left_anti")
        others, best = solved(kept(rest, "path_rest"))
        first = Window.partitionBy("case_id").orderBy("cost", "pair")
        others = others.withColumn("k", F.row_number().over(first)).filter("k = 1")
        paths, chosen = kept(paths.unionByName(steps_of_goals(others, best)), "paths"), kept(chosen.unionByName(others.select(chosen.columns)), "path_chosen")
    # balanced paths over hubs: a semantic one between the same ends, if it has none
    last = F.max("hop").over(Window.partitionBy("case_id"))

    def over_hubs(rows: DataFrame) -> DataFrame:
        inner = rows.withColumn("last", last).filter((F.col("hop") > 0) & (F.col("hop") < F.col("last")))
        ids = kept(inner.select("id").distinct(), "path_nodes")
        degrees = g.degree_among(g.touching(edges.select("src", "dst"), ids, ids.count()))
        on = nodes.join(F.broadcast(ids), "id", "left_semi").join(degrees, "id", "left")  # of nodes and edges those on the paths alone are sent
        met = on.filter(c.is_low_value_bridge() | (F.coalesce("degree", F.lit(0)) >= 12)).select("id")
        return inner.join(F.broadcast(met), "id", "left_semi").select("case_id").distinct()

    retry = chosen.filter("mode = 'balanced'").join(over_hubs(paths), "case_id", "left_semi").withColumn("mode", F.lit("semantic"))
    again, best = solved(kept(retry, "path_retry"))
    if best is not None:
        better = kept(steps_of_goals(again, best), "paths")
        better = kept(better.join(over_hubs(better), "case_id", "left_anti"), "paths")
        paths = better.unionByName(paths.join(better, "case_id", "left_anti"))
        done = again.join(better, "case_id", "left_semi").select(chosen.columns)
        chosen = done.unionByName(chosen.join(done, "case_id", "left_anti"))
    # cases without a path have their best pair
    plain = pairs.filter("pair = 0").join(chosen, "case_id", "left_anti").select(chosen.columns)
    return chosen.unionByName(plain).drop("pair"), paths


def matches(label: str, pattern: str) -> Column:
    """Whether a column's text holds a match of the pattern in another column; null where that is null."""
    return F.rlike(F.col(label), F.col(pattern))


def query_benchmark(nodes: DataFrame, edges: DataFrame, cases: DataFrame, *, budget: int = 24) -> DataFrame:
    """Which of the cases (case_id, query, seed_pattern, result_pattern or null) find what they should (SEA21).

    case_id, passed, seed_labels (in order), found (number of nodes): a seed's label must match the one pattern, and a found
    node's the other; without it any node will do.
    """
    queries = cases.select(F.col("case_id").alias("query_id"), "query", F.lit("balanced").alias("requested"))
    seeds = kept(c.seeds_of(nodes, queries).select("query_id", "id", "label", "place"), "benchmark_seeds")
    found = neighbourhoods(edges, seeds.withColumn("place", F.col("place") - 1), budget=budget).join(nodes.select("id", "label"), "id")
    mine = cases.withColumnRenamed("case_id", "query_id")
    s = seeds.join(mine, "query_id").groupBy("query_id").agg(
        F.max(matches("label", "seed_pattern")).alias("seed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), ",").alias("seed_labels"))
    r = found.join(mine, "query_id").groupBy("query_id").agg(F.max(F.coalesce(matches("label", "result_pattern"), F.lit(True))).alias("result"), F.count("*").alias("found"))
    out = cases.select(F.col("case_id").alias("query_id")).join(s, "query_id", "left").join(r, "query_id", "left")
    ok = F.coalesce(F.col("seed") & F.col("result"), F.lit(False))
    return out.select(F.col("query_id").alias("case_id"), ok.alias("passed"), F.coalesce("seed_labels", F.lit("")).alias("seed_labels"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def path_benchmark(nodes: DataFrame, edges: DataFrame, cases: DataFrame, steps_of) -> DataFrame:
    """Which of the cases find a path as it should be (SEA21, GA6): case_id, passed, path (labels), fault.

    cases: case_id, source, target, mode, from_pattern, to_pattern, path_pattern (null: a path of two nodes), forbidden (node
    kinds), required (edge kinds), preferred (patterns). The first of a wrong end, no path, a forbidden kind, a missing edge
    kind and a missing pattern is the fault.
    """
    chosen, paths = ranked_paths(nodes, edges, cases.select("case_id", "source", "target", "mode"), steps_of)
    label = nodes.select("id", "label", "kind")
    taken = F.broadcast(paths.filter("edge IS NOT NULL").select("edge").distinct())  # the steps of the cases' paths
    kinds = edges.select(F.col("id").alias("edge"), F.col("kind").alias("edge_kind")).join(taken, "edge", "left_semi")
    rows = paths.join(label, "id").join(F.broadcast(kinds), "edge", "left").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("hop", "label", "kind", "edge_kind"))).alias("p"))
    ends = chosen.join(label.select(F.col("id").alias("a"), F.col("label").alias("from_label")), "a").join(label.select(F.col("id").alias("b"), F.col("label").alias("to_label")), "b").select("case_id", "from_label", "to_label")
    out = cases.join(ends, "case_id", "left").join(rows, "case_id", "left")
    labels, has = F.transform("p", lambda x: x["label"]), F.col("p").isNotNull()
    on_path = F.when(F.col("path_pattern").isNull(), F.size("p") >= 2).otherwise(F.exists(labels, lambda x: F.rlike(x, F.col("path_pattern"))))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    fault = (
        F.when(no(matches("from_label", "from_pattern")), "from").when(no(matches("to_label", "to_pattern")), "to").when(~has | no(on_path), "path")
        .when(F.arrays_overlap(F.transform("p", lambda x: x["kind"]), "forbidden"), "forbidden_kind")
        .when(F.size(F.array_except("required", F.transform("p", lambda x: x["edge_kind"]))) > 0, "required_edge")
        .when(~F.forall("preferred", lambda w: F.exists(labels, lambda x: F.rlike(x, w))), "preferred_node"))
    return out.select("case_id", fault.isNull().alias("passed"), F.coalesce(F.array_join(labels, ">"), F.lit("")).alias("path"), fault.alias("fault"))
