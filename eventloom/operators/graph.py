"""Property-graph operators: DataFrames of nodes (id, kind, label, path) and edges (src, dst, kind, provenance, weight) in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import kept, sided

#: Sources of one target that meet in one task; targets that a source brings along as a list.
TILE, LONGEST = 1024, 64


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected adjacency (a, b), each pair once a direction (JO2)."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree: one pass over the edges' ends, summed before the shuffle."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def touching(edges: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Edges with an end among n distinct ids, and which (src_in, dst_in): one pass over the edges, which stay where they are while the ids are few."""
    mark = lambda x: sided(ids.select(F.col("id").alias(x), F.lit(True).alias(f"{x}_in")), n)
    return edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").filter("src_in OR dst_in")


def degree_among(touched: DataFrame) -> DataFrame:
    """id, degree: of the ids that ``touching`` was given."""
    ends = touched.select(F.explode(F.array(F.when(F.col("src_in"), F.col("src")), F.when(F.col("dst_in"), F.col("dst")))).alias("id"))
    return ends.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("degree"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (FI3, JO3)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    lost = lambda end: edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(edges.columns)
    return lost("src").unionByName(lost("dst")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")), "id", "left_anti")


def endpoint_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges counted by kind and by the kinds of both ends (JO1)."""
    kind = lambda end: nodes.select(F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"))
    return edges.join(kind("src"), "src").join(kind("dst"), "dst").groupBy("kind", "src_kind", "dst_kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def provenance_summary(edges: DataFrame, confidence: dict[str, float]) -> DataFrame:
    """Edges by kind and provenance, with the mean default confidence."""
    score = F.element_at(F.create_map(*[F.lit(x) for kv in confidence.items() for x in kv]), F.col("provenance"))
    return edges.groupBy("kind", "provenance").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.round(F.avg(score), 6).alias("confidence"))


def lenses(path: Column, rules: dict[str, str]) -> Column:
    """The names of all rules (regular expressions) that a path matches, in the rules' order (FI1)."""
    return F.array_compact(F.array(*[F.when(path.rlike(pattern), F.lit(name)) for name, pattern in rules.items()]))


def lens_summary(nodes: DataFrame, rules: dict[str, str]) -> DataFrame:
    return nodes.select("kind", F.explode(lenses(F.col("path"), rules)).alias("lens")).groupBy("lens", "kind").agg(F.count("*").alias("n"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, *, directed: bool = False) -> DataFrame:
    """id, depth: nodes within depth steps of the seeds, at their least depth (GR1). One join a step, each from written tables; nothing is collected."""
    near = kept(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if directed else both_ways(edges), "adjacency")
    reached = frontier = kept(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    for d in range(1, depth + 1):
        step = near.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = kept(step.join(reached.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def search(nodes: DataFrame, query: str, *, kind_weight: dict[str, float] | None = None) -> DataFrame:
    """id, score: how many words of the query a node's label, path and kind hold as substrings, labels twice (SEA1, SEA2)."""
    words = sorted({w for w in query.lower().split() if w})
    hit = lambda c, w, s: F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w)), F.lit(s)).otherwise(F.lit(0.0))
    total = reduce(lambda a, b: a + b, [hit("label", w, 2.0) + hit("path", w, 1.0) + hit("kind", w, 0.5) for w in words], F.lit(0.0))
    if kind_weight:
        total = total * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kind_weight.items() for x in kv]), F.col("kind")), F.lit(1.0))
    return nodes.select("id", "kind", "label", "path", total.alias("score")).filter("score > 0")


def seeds(nodes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The k best nodes; ties go to the smaller id (SEA6)."""
    return search(nodes, query).orderBy(F.desc("score"), "id").limit(k)


def search_context(nodes: DataFrame, edges: DataFrame, query: str, *, k: int = 5, depth: int = 2) -> DataFrame:
    """Keyword search, seeds, bounded traversal: the nodes found with their depth and degree."""
    nodes, edges = kept(nodes, "nodes"), kept(edges, "edges")
    found = bfs(edges, seeds(nodes, query, k), depth, directed=True)
    return found.join(nodes, "id").join(degree(edges).select("id", "degree"), "id", "left").select("id", "kind", "label", "depth", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def hubs(edges: DataFrame, least: int = 12) -> DataFrame:
    """Nodes of at least this degree (FI12)."""
    return degree(edges).filter(F.col("degree") >= least).select("id", "degree")


def cheapest_paths(edges: DataFrame, sources: DataFrame, cost: Column, hops: int) -> DataFrame:
    """id, cost, hops: cheapest directed walk of at most hops steps from any source; each step keeps one row a node.

    Parallel edges stay apart: what a step keeps is the least of them, so that edges are neither grouped nor, while few rows go on, moved.
    """
    step = kept(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), cost.alias("c")), "steps")
    best = changed = kept(sources.select("id").distinct().select("id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops")), "best")
    n = total = changed.count()
    for _ in range(hops):  # only what became cheaper goes on
        more = step.join(sided(changed, n), F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        more = more.groupBy("id").agg(F.min(F.struct("cost", "hops")).alias("m"))
        known = sided(best.select("id", F.struct("cost", "hops").alias("known")), total)
        changed = kept(more.join(known, "id", "left").filter(F.col("known").isNull() | (F.col("m") < F.col("known"))).select("id", "m.cost", "m.hops"), "best")
        n = changed.count()
        if not n:
            break
        total += n
        best = kept(best.join(sided(changed.select("id"), n), "id", "left_anti").unionByName(changed), "best")
    return best


def impact(edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """What depends on changed nodes: traversal against the edges' direction."""
    return bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed, depth, directed=True)


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs that point at each other, each once, and loops."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").filter("src <= dst")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of each community by belongs_to edges, with inner and crossing edges counted."""
    member = edges.filter("kind = 'belongs_to'").join(nodes.filter("kind = 'community'").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("community"))
    a, b = member.select(F.col("id").alias("src"), F.col("community").alias("ca")), member.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    crossing = edges.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("community")).agg(F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("inner_edges"), F.count(F.when(F.col("ca") != F.col("cb"), 1)).alias("crossing_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return member.groupBy("community").agg(F.count("*").alias("members")).join(crossing, "community", "left").select("community", "members", zero("inner_edges"), zero("crossing_edges"))


def jaccard_neighbours(edges: DataFrame, kind: str, least: float, longest: int = LONGEST) -> DataFrame:
    """Pairs of sources that share targets, by Jaccard similarity.

    Sources of a target that very many share are cut into tiles that meet two by two, so that no task grows with a target.
    Sources bring their targets along, so that a pair is held against the threshold where it meets and only similar ones leave
    the task; lists of more than ``longest`` targets stay rows, and pairs with such a source are counted by joins.
    """
    e = edges.filter(F.col("kind") == kind).select("src", "dst").distinct()
    # prefix filter: a pair above the threshold shares one of the first few targets in a global rare-first order
    rare = kept(e.join(e.groupBy("dst").agg(F.count("*").alias("f")), "dst"), "jaccard_edges")
    size = kept(rare.groupBy("src").agg(F.count("*").alias("n")), "jaccard_sizes")
    short = rare.join(size.filter(F.col("n") <= longest), "src").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("f", "dst"))).alias("list"))
    short = kept(short.select("src", F.size("list").cast("long").alias("n"), "list"), "jaccard_lists")
    targets = F.transform("list", lambda x: x["dst"])
    first = short.select("src", "n", targets.alias("list"), F.explode(F.slice("list", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("x")).select("src", "n", "list", "x.dst", "x.f")
    many = rare.join(size.filter(F.col("n") > longest), "src").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("f", "dst")))
    many = many.filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("src", "n", F.lit(None).cast("array<string>").alias("list"), "dst", "f")
    long = size.filter(F.col("n") > longest).count()
    prefix = first.unionByName(many) if long else first
    # only a target that more than a tile's sources have can need tiles; the others are not looked up
    popular = kept(prefix.filter(F.col("f") > TILE).groupBy("dst").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).filter("tiles > 1"), "jaccard_tiles")
    tiled = prefix.join(sided(popular, popular.count()), "dst", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("src"), F.col("tiles")).cast("int")
    dealt = tiled.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("src", "n", "list", F.col("list").isNotNull().alias("listed"), "dst", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))
    side = lambda rows, x, *more: rows.select(F.col("src").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more], "dst", "lo", "hi")
    similarity = F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6)
    meet = lambda rows, *more: side(rows, "a", *more).join(side(rows, "b", *more), ["dst", "lo", "hi"]).filter("a < b").filter(F.round(F.least("na", "nb") / F.greatest("na", "nb"), 6) >= least)
    here = meet(dealt.filter("listed"), "list").withColumn("common", F.size(F.array_intersect("list_a", "list_b")).cast("long"))
    here = here.withColumn("similarity", similarity).filter(F.col("similarity") >= least).select("a", "b", "common", "similarity").distinct()
    if not long:
        return here
    e = rare.select("src", "dst")
    pairs = meet(dealt, "listed").filter(~(F.col("listed_a") & F.col("listed_b"))).select("a", "b", "na", "nb").distinct()
    there = pairs.join(e.select(F.col("src").alias("a"), "dst"), "a").join(e.select(F.col("src").alias("b"), "dst"), ["b", "dst"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return here.unionByName(there.withColumn("similarity", similarity).filter(F.col("similarity") >= least).select("a", "b", "common", "similarity"))
