"""Smaller views: text search and projections, log findings, task lists, checks, pass rates, retrieval and slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import scalars as s
from eventloom.operators import code as c
from eventloom.operators import graph as g
from eventloom.operators import versions

# How many labels a community shows of each part that nodes play.
BUCKETS = {"start_with": 3, "core_implementation": 5, "public_contracts": 4, "related_tests": 3, "supporting_docs": 3, "operational_config": 3}
SECRET_LINE = r"(?i)(api[_-]?key|secret|password|token|bearer\s)"


def matching(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows that hold a query in any of the fields, in any case (FI17)."""
    return rows.filter(F.lower(F.concat_ws("\n", *fields)).contains(query.strip().lower()))


def shown(nodes: DataFrame) -> DataFrame:
    """id, kind, label, path of nodes, their text redacted (FI21)."""
    return nodes.select("id", "kind", s.redacted(F.col("label"), 240).alias("label"), s.redacted(F.col("path"), 500).alias("path"))


def edge_roles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, semantic, dependency: what an edge is on a code map, by relation, else by the kinds of its ends (FI18)."""
    kind = lambda end: nodes.select(F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"))
    symbols = (F.col("src_kind") == "symbol") & (F.col("dst_kind") == "symbol")
    on_map = lambda end: F.col(f"{end}_kind").isin("code_file", "symbol", "community")
    told = F.coalesce(F.col("relation").isin("calls", "uses", "semantic_calls", "semantic_constructor"), F.lit(False))
    linked, depends = F.col("kind").isin("references", "inherits", "implements", "depends_on"), F.col("kind") == "depends_on"
    # what the edge alone says comes first, so that the joins shuffle flags and not names
    rows = edges.select("id", "src", "dst", linked.alias("linked"), told.alias("told"), depends.alias("depends"), F.coalesce(F.col("relation").isin("imports", "import"), F.lit(False)).alias("imports"))
    rows = rows.join(kind("src"), "src", "left").join(kind("dst"), "dst", "left")
    semantic = F.col("linked") & (F.col("told") | F.coalesce(symbols, F.lit(False)))
    dependency = F.col("depends") & (F.col("imports") | F.coalesce(on_map("src") & on_map("dst"), F.lit(False)))
    return rows.select("id", semantic.alias("semantic"), dependency.alias("dependency"))


def log_findings(lines: DataFrame, rules: dict[str, str], k: int = 4) -> DataFrame:
    """(rule, line, text): the first k lines of each rule that match, without lines that may hold secrets (SR23)."""
    clean = lines.withColumn("text", F.trim("text")).filter((F.col("text") != "") & ~F.col("text").rlike(SECRET_LINE)).withColumn("text", s.redacted(F.col("text"), 240))
    hits = clean.select("line", "text", F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules.items()]))).alias("rule"))
    w = Window.partitionBy("rule").orderBy("line")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("rule", "line", "text", "place")


def task_list(files: DataFrame) -> DataFrame:
    """path, line, task, done, parallel, title of task lines in Markdown: ``- [x] T001 [P] title`` (SR14)."""
    pattern = r"^\s*[-*]\s+\[( |x|X)\]\s+(?:(T\d+)\s+)?(\[P\]\s+)?(.+?)\s*$"
    rows = files.select("path", F.posexplode(F.split("body", "\n")).alias("i", "text")).filter(F.col("text").rlike(pattern))
    part = lambda k: F.regexp_extract("text", pattern, k)
    return rows.select("path", (F.col("i") + 1).alias("line"), F.nullif(part(2), F.lit("")).alias("task"), (F.lower(part(1)) == "x").alias("done"), (part(3) != "").alias("parallel"), part(4).alias("title"))


def spec_edges(tasks: DataFrame) -> DataFrame:
    """(src, dst, kind) of a plan's tasks: each belongs to its file, and needs the last task before it that isn't parallel (SR14)."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~F.col("parallel"), F.col("task")), ignorenulls=True).over(w)
    named = tasks.filter("task IS NOT NULL").withColumn("before", before)
    belongs = named.select(F.concat_ws("#", "path", "task").alias("src"), F.col("path").alias("dst"), F.lit("belongs_to").alias("kind"))
    needs = named.filter("before IS NOT NULL").select(F.concat_ws("#", "path", "task").alias("src"), F.concat_ws("#", "path", "before").alias("dst"), F.lit("depends_on").alias("kind"))
    return belongs.unionByName(needs)


def scan_events(graph_id: str, nodes: DataFrame, edges: DataFrame, edges_gone: DataFrame, nodes_gone: DataFrame, last_seq: int) -> DataFrame:
    """One batch of events that brings a log up to a scan: nodes, edges, then archived edges and nodes, numbered on (SR19, SR2, SE4).

    The numbers of a batch follow one order, by prefix sums over ranges of it (``versions.numbered``).
    """
    of = lambda df, turn, kind: df.select(F.lit(turn).alias("turn"), F.lit(kind).alias("kind"), "id")
    rows = of(nodes, 0, "product.node.upserted").unionByName(of(edges, 1, "product.edge.upserted")).unionByName(of(edges_gone, 2, "product.edge.archived")).unionByName(of(nodes_gone, 3, "product.node.archived"))
    return versions.numbered(rows, ["turn", "id"]).select(F.lit(graph_id).alias("graph_id"), "kind", "id", (F.col("seq") + last_seq).alias("seq"))


def support_matrix(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each scanner of a catalog (scanner_id, tier) with its files, symbols and the kinds of support that counts say (AG17, EX2)."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    found = nodes.filter("scanner_id IS NOT NULL").groupBy("scanner_id").agg(n("code_file").alias("files"), n("symbol").alias("symbols"), F.count("*").alias("nodes"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return catalog.join(found, "scanner_id", "left").select("scanner_id", "tier", zero("files"), zero("symbols"), zero("nodes"))


def community_buckets(nodes: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Of each community the first labels of every part that its nodes play (SEA16). homes: id, community."""
    rows = c.with_degree(nodes.filter(c.is_eligible(tests=True, docs=True)), edges).join(homes, "id")
    rows = rows.withColumn("bucket", c.guidance_bucket()).withColumn("score", c.guidance_score(F.col("degree"), tests=True)).withColumn("shown", c.shown())
    best = rows.groupBy("community", "bucket", "shown").agg(F.min(F.struct("score", "label")).alias("best"))
    w = Window.partitionBy("community", "bucket").orderBy("best", "shown")
    most = c.lookup(BUCKETS, F.col("bucket"))
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("community", "bucket", "shown", "place")


def goal_intent(goal: Column, words: dict[str, list[str]]) -> Column:
    """The task intent with most words of the goal, in the order of ``words`` among equals; general without one (SEA18)."""
    asked = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(goal, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) > 2)
    meets = lambda ws: lambda w: reduce(lambda a, b: a | b, [w.contains(x) | F.lit(x).contains(w) for x in ws])
    hits = {n: F.size(F.filter(asked, meets(ws))) for n, ws in words.items()}
    best = F.greatest(*hits.values())
    out = F.when(best == 0, "general")
    for n, h in hits.items():
        out = out.when(h == best, n)
    return out


def checks(rows: DataFrame) -> DataFrame:
    """id, criterion, finding: what a criterion lacks in the evidence beside it (VE5).

    rows: id, criterion, files (array), commands (array of command and exit_code), output.
    """
    low, file = F.lower("criterion"), F.regexp_extract("criterion", r"([A-Za-z0-9_\-./\\]+\.[A-Za-z0-9]+)", 1)
    code = F.coalesce(F.nullif(F.regexp_extract("criterion", r"(?i)exit code\s+(\d+)", 1), F.lit("")), F.lit("0")).cast("int")
    finding = (
        F.when(low.contains("exists"), F.when(file == "", "cannot_verify").when(~F.array_contains("files", file), "missing_file"))
        .when(low.contains("exit code"), F.when(~F.exists("commands", lambda x: x["exit_code"] == code), "no_exit_code"))
        .when(low.contains("test"), F.when(~F.exists("commands", lambda x: x["command"].rlike("(?i)test") & (x["exit_code"] == 0)), "no_passing_test"))
        .when((F.trim(F.coalesce("output", F.lit(""))) == "") | F.col("output").rlike(r"(?i)TODO|placeholder|\.\.\."), "bad_output"))
    return rows.select("id", "criterion", finding.alias("finding")).filter("finding IS NOT NULL")


def pass_rates(results: DataFrame, *keys: str) -> DataFrame:
    """Share of passed results, null for none, and whether a floor is met (AG27, GA7, GA17)."""
    rate = F.avg(F.col("passed").cast("double"))
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.round(rate, 6).alias("rate"))


def scorecard(scores: DataFrame) -> DataFrame:
    """Categories with a status (good from 80, fair from 60, else weak), and their mean as a row of its own (GA11)."""
    status = lambda x: F.when(x >= 80, "good").when(x >= 60, "fair").otherwise("weak")
    one = scores.select("category", s.clamped(F.col("score")).alias("score"))
    mean = one.agg(s.clamped(F.avg("score")).alias("score")).select(F.lit("overall").alias("category"), "score")
    return one.unionByName(mean).withColumn("status", status(F.col("score")))


def path_faults(quality: DataFrame, *, most: dict[str, int] = {}, directness: float = 0.0, forbidden: tuple[str, ...] = (), required: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """The rules that paths' quality rows break, with their keys (GA6): most by column, the least directness, relations that must not
    occur, and relations that must, in this order."""
    faults = [F.when(F.col(k) > n, F.lit(f"too_many_{k}")) for k, n in most.items()]
    faults += [F.when(F.col("directness") < directness, F.lit("indirect"))] + [F.when(F.array_contains(F.split("relations", ","), r), F.lit(f"forbidden_{r}")) for r in forbidden]
    if required:
        met = F.aggregate(F.split("relations", ","), F.lit(0), lambda at, x: F.when(F.element_at(F.array(*map(F.lit, required), F.lit("")), at + 1) == x, at + 1).otherwise(at))
        faults.append(F.when(met < len(required), F.lit("required_order")))
    return quality.select(*keys, F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def commands(lines: DataFrame) -> DataFrame:
    """(kind, command, sources): verification commands that files name, each once, with how many files name it (GA13)."""
    pattern = r"\b(npm (?:run )?[\w:-]+|pytest|tox|make [\w-]+|cargo test|go test|dotnet test)\b"
    rows = lines.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("command"))
    kind = F.when(F.col("command").rlike(r"test|tox"), "test").when(F.col("command").rlike("lint"), "lint").when(F.col("command").rlike("build"), "build").otherwise("other")
    return rows.groupBy(kind.alias("kind"), "command").agg(F.countDistinct("path").alias("sources"))


def command_conflicts(found: DataFrame) -> DataFrame:
    """Kinds with more than one command, and kinds of build and test with none (GA13)."""
    many = found.groupBy("kind").agg(F.count("*").alias("n")).filter("n > 1 AND kind <> 'other'").select(F.lit("conflict").alias("what"), "kind")
    have = found.agg(F.collect_set(F.when(F.col("kind").isin("test", "build", "lint"), F.col("kind"))).alias("have"))  # three at most
    gaps = have.select(F.explode(F.array_except(F.array(F.lit("test"), F.lit("build"), F.lit("lint")), "have")).alias("kind")).select(F.lit("gap").alias("what"), "kind")
    return many.unionByName(gaps)


def fusion_checks(symbols_now: int, symbols_before: int | None, stale: bool, gates: DataFrame) -> DataFrame:
    """Gates, and two more: a stale report, and a fall of the symbols below four fifths (GA2)."""
    spark = gates.sparkSession
    more = [("stale_handoff", "warn", 0)] * stale
    if symbols_before is not None and symbols_now < int(symbols_before * 0.8):
        more.append(("symbol_regression", "fail", symbols_before - symbols_now))
    return gates.unionByName(spark.createDataFrame(more, "code string, severity string, n long"))


def retrieved_by(nodes: DataFrame, edges: DataFrame, ids: DataFrame, prefix: str, *, budget: int = 8, members: int = 12, links: int = 8) -> DataFrame:
    """What each retrieval id (column retrieval_id) stands for, with what lies beside it (GR24): retrieval_id, kind, label, place, id,
    edge_kind.

    A node has its first neighbours, by label; a community its first members; a piece of documentation the other ends of its
    first edges, by edge; a path its two ends; a benchmark nothing. An id of something that isn't there has no row, one
    without neighbours a row without a place.
    """
    kind, first, second = s.retrieval_parts(prefix, F.col("retrieval_id"))
    asked = ids.select("retrieval_id", kind.alias("kind"), first.alias("a"), second.alias("other")).distinct()
    real = asked.join(nodes.select(F.col("id").alias("a"), F.col("label"), F.col("kind").alias("node_kind")), "a")
    real = real.filter((F.col("kind") == "node") | (F.col("kind") == "community") & (F.col("node_kind") == "community") | (F.col("kind") == "doc") & F.col("node_kind").isin(*c.DOC_KINDS))
    ends = edges.select("id", "src", "dst", "kind")
    way = lambda a, b: ends.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("id").alias("edge"), F.col("kind").alias("edge_kind"), F.lit(a == "dst").alias("into"))
    near = way("src", "dst").unionByName(way("dst", "src").filter("a <> b")).join(real.select("a", "kind", "retrieval_id"), "a")
    labels = nodes.select(F.col("id").alias("b"), F.col("label").alias("b_label"))
    first_of = lambda rows, most, *order: rows.withColumn("place", F.row_number().over(Window.partitionBy("retrieval_id").orderBy(*order))).filter(F.col("place") <= most).select("retrieval_id", "place", F.col("b").alias("id"), "edge_kind")
    of_node = near.filter("kind = 'node' AND b <> a").groupBy("retrieval_id", "b").agg(F.min("edge_kind").alias("edge_kind")).join(labels, "b")
    of_home = near.filter("kind = 'community' AND edge_kind = 'belongs_to' AND into").select("retrieval_id", "b", "edge_kind").distinct().join(labels, "b")
    of_doc = near.filter("kind = 'doc'").join(labels, "b")
    beside = first_of(of_node, budget, "b_label", "b").unionByName(first_of(of_home, members, "b_label", "b")).unionByName(first_of(of_doc, links, "edge"))
    found = real.select("retrieval_id", "kind", "label").join(beside, "retrieval_id", "left")
    paths = asked.filter("kind = 'path'").select("retrieval_id", "kind", F.concat_ws(" > ", "a", "other").alias("label"), F.posexplode(F.array_compact(F.array("a", "other"))).alias("k", "id"))
    paths = paths.select("retrieval_id", "kind", "label", (F.col("k") + 1).alias("place"), "id", F.lit(None).cast("string").alias("edge_kind"))
    none = F.lit(None).cast("string")
    marks = asked.filter("kind = 'benchmark'").select("retrieval_id", "kind", F.col("a").alias("label"), F.lit(None).cast("int").alias("place"), none.alias("id"), none.alias("edge_kind"))
    return found.unionByName(paths).unionByName(marks)


def retrieved(nodes: DataFrame, edges: DataFrame, id: str, budget: int = 8) -> DataFrame:
    """The first neighbours of a node, by label, with the edge's kind (GR24)."""
    near = edges.filter(F.col("src") == id).select(F.col("dst").alias("id"), F.col("kind").alias("edge_kind")).unionByName(edges.filter(F.col("dst") == id).select(F.col("src").alias("id"), F.col("kind").alias("edge_kind")))
    one = near.filter(F.col("id") != id).groupBy("id").agg(F.min("edge_kind").alias("edge_kind"))
    return one.join(nodes.select("id", "label", "kind"), "id").orderBy("label", "id").limit(budget)


def context_slice(nodes: DataFrame, edges: DataFrame, linked: DataFrame, query: str, *, most_nodes: int = 24, most_edges: int = 32) -> tuple[DataFrame, DataFrame]:
    """Nodes that a run touched, then those that a query finds, and the first edges among them (GR25)."""
    a = nodes.join(linked.select("id"), "id", "left_semi").select("id", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("score"))
    b = c.intent_ranked(nodes, query).select("id", F.lit(1).alias("turn"), "score")
    both = a.unionByName(b).groupBy("id").agg(F.min(F.struct("turn", -F.col("score"))).alias("k")).orderBy("k", "id").limit(most_nodes)
    found = nodes.join(both.select("id"), "id", "left_semi")
    return found, g.induced(found, edges).orderBy("id").limit(most_edges)


def run_links(runs: DataFrame, touched: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind) from runs to the code files that they touched, by safe relative path, and from evidence to its run (PR16).

    touched: run, path. Absolute paths and those that climb out of the workspace are left out.
    """
    safe = touched.filter(~F.col("path").rlike(r"^(/|[A-Za-z]:[\\/])") & ~F.concat(F.lit("/"), F.col("path"), F.lit("/")).contains("/../"))
    hit = safe.join(files.select("path", F.col("id").alias("dst")), "path").select(F.concat(F.lit("run:"), F.col("run").cast("string")).alias("src"), "dst", F.lit("touches").alias("kind"))
    made = runs.select(F.concat(F.lit("evidence:"), F.col("run").cast("string")).alias("src"), F.concat(F.lit("run:"), F.col("run").cast("string")).alias("dst"), F.lit("produced_by").alias("kind"))
    return hit.unionByName(made).distinct()


def first_of(rows: DataFrame, keys: list[str], order: list, most: int | None = None) -> DataFrame:
    """The first row of each key by an order, and of these the first ``most`` (SE5)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("k_")
    return out if most is None else out.orderBy(*order).limit(most)


def scope_files(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Of each task scope the k files with most edges, then dependencies, then symbols (AG20)."""
    files = c.with_degree(nodes.filter("kind = 'code_file'"), edges)
    dep = edges.filter("kind = 'depends_on'").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("dependencies"))
    own = edges.filter("kind = 'belongs_to'").join(nodes.filter("kind = 'symbol'").select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("symbols"))
    rows = files.join(dep, "id", "left").join(own, "id", "left").fillna(0, ["dependencies", "symbols"]).withColumn("scope", F.explode(c.matched(F.col("path"), c.SCOPES)))
    w = Window.partitionBy("scope").orderBy(F.desc("degree"), F.desc("dependencies"), F.desc("symbols"), "path", "id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("scope", "id", F.col("degree").cast("long").alias("degree"), "dependencies", "symbols", "place")


def guidance_faults(read_first: DataFrame, hubs: DataFrame) -> DataFrame:
    """What is wrong with a read-first list: nothing in it, a test or generated path in it, or no label shared with the hubs' starts (GR23, GA5).

    read_first: id, kind, label, path (a short list); hubs: shown.
    """
    row = read_first.agg(
        F.count("*").alias("n"), F.count(F.when(c.is_test(), 1)).alias("tests"), F.count(F.when(F.col("path").rlike(f"(?i){c.GENERATED}"), 1)).alias("generated"))
    shared = read_first.select(c.shown().alias("shown")).join(hubs.select("shown").distinct(), "shown", "left_semi").agg(F.count("*").alias("shared"))
    faults = F.array_compact(F.array(
        F.when(F.col("n") == 0, "empty"), F.when(F.col("tests") > 0, "tests_in_list"), F.when(F.col("generated") > 0, "generated_in_list"), F.when((F.col("n") > 0) & (F.col("shared") == 0), "apart_from_hubs")))
    return row.crossJoin(shared).select(F.explode(faults).alias("fault"))  # single rows
