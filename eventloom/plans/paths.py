"""Registered queries of neighbourhoods, paths and cycles, with SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import batches
from eventloom.operators import code as c
from eventloom.operators import paths as p
from eventloom.operators import reports as r
from eventloom.plans.catalog import query
from eventloom.plans.code import BRIDGE, DEG, G, LOWP, RELATION, TEST, resolution_sql, seeds_sql
from eventloom.session import kept
from eventloom.sources import workspace as w

START = "symbol:17"
NEAR = "nr AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges))"


def graph(spark, d):
    return kept(w.nodes(spark, d), "code_nodes"), kept(w.edges(spark, d), "code_edges")


def bfs_sql(seeds: str, budget: int, depth: int) -> str:
    """Levels by place: the first ones that the budget leaves room for."""
    ctes = [f"q0 AS ({seeds})", "v0 AS (SELECT * FROM q0)"]
    for k in range(1, depth + 1):
        ctes.append(f"q{k} AS (SELECT id, (SELECT count(*) FROM v{k - 1}) + row_number() OVER (ORDER BY pp, id) - 1 AS place FROM (SELECT b AS id, min(place) AS pp FROM nr JOIN q{k - 1} ON a = id WHERE b NOT IN (SELECT id FROM v{k - 1}) GROUP BY b) QUALIFY place < {budget})")
        ctes.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM q{k})")
    return ", ".join(ctes)


@query(f"{G}, {NEAR}, {bfs_sql(f'SELECT {chr(39)}{START}{chr(39)} AS id, 0 AS place', 60, 3)} SELECT v3.id, place::INT AS place FROM v3 JOIN nodes USING (id)")
def budgeted_bfs(spark, d):
    n, e = graph(spark, d)
    return p.neighbourhood(n, e, [START], budget=60, depth=3)[0].select("id", "place")


@query()
def budgeted_dfs(spark, d):
    n, e = graph(spark, d)
    return p.neighbourhood(n, e, [START], budget=40, depth=4, mode="dfs")[0].select("id", "place")


ASKED = "order service architecture"


@query(f"{G}, {seeds_sql(ASKED, 'balanced')}, {NEAR}, {bfs_sql('SELECT id, place - 1 AS place FROM seed', 40, 4)}, x AS (SELECT e.dst AS community, m.label AS community_label FROM v4 JOIN nodes n ON n.id = v4.id JOIN edges e ON e.src = v4.id AND e.kind = 'belongs_to' JOIN nodes m ON m.id = e.dst AND m.kind = 'community') SELECT community, community_label, count(*)::BIGINT AS found FROM x GROUP BY ALL")
def search_communities(spark, d):
    return p.search(*graph(spark, d), ASKED)[2]


@query(f"{G}, {NEAR}, h0 AS (SELECT '{START}' AS id, 0 AS hops, ['{START}'] AS path), h1 AS (SELECT b AS id, 1 AS hops, min(list_append(path, b)) AS path FROM nr JOIN h0 ON a = id WHERE b NOT IN (SELECT id FROM h0) GROUP BY b), h2 AS (SELECT b AS id, 2 AS hops, min(list_append(path, b)) AS path FROM nr JOIN h1 ON a = id WHERE b NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1) GROUP BY b) SELECT id, hops::INT AS hops, array_to_string(path, '>') AS path FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)")
def hop_paths(spark, d):
    return p.hops_from(graph(spark, d)[1], START, 2).select("id", "hops", F.array_join("path", ">").alias("path"))


@query(f"{G}, e AS (SELECT src, dst FROM edges WHERE kind = 'depends_on' AND id LIKE 'f:%'), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), k AS (SELECT DISTINCT id FROM (WITH RECURSIVE z(id) AS (SELECT 'file:1' UNION SELECT b FROM z JOIN r ON a = z.id) SELECT id FROM z)) SELECT id FROM k")
def file_component(spark, d):
    return p.component(graph(spark, d)[1].filter("kind = 'depends_on' AND id LIKE 'f:%'"), "file:1")


PROV = "CASE provenance WHEN 'inferred' THEN 1.25 WHEN 'ambiguous' THEN 1.6 ELSE 1 END"
SYMBOL = "CASE WHEN contains(lower(label), '(namespace)') THEN 900 WHEN contains(lower(label), '(external)') THEN 700 WHEN contains(lower(label), '(interface)') THEN 180 WHEN regexp_matches(lower(label), '\\((field|property)\\)') THEN 240 WHEN regexp_matches(lower(label), '\\((method|function)\\)') THEN 12 ELSE 2 END"
ISTEST = f"({TEST} OR contains({LOWP}, 'tests/'))"
PENALTY = f"""CASE WHEN kind IN ('doc_section', 'doc_file') THEN 50000 WHEN {ISTEST} THEN 12000 WHEN kind = 'symbol' THEN {SYMBOL} WHEN kind = 'project' THEN CASE WHEN label = 'workspace-root' OR path IS NOT DISTINCT FROM '.' THEN 2500 ELSE 600 END
 ELSE CASE kind WHEN 'workspace' THEN 5000 WHEN 'package' THEN 450 WHEN 'directory' THEN 400 WHEN 'community' THEN 350 WHEN 'god_node' THEN 250 WHEN 'config_file' THEN 120 WHEN 'asset_file' THEN 90 WHEN 'external_dep' THEN 500 WHEN 'code_file' THEN 18 WHEN 'route' THEN 24 WHEN 'command' THEN 24 ELSE 40 END END"""
RCOST = "CASE r WHEN 'constructor' THEN 28 WHEN 'tests' THEN 24 WHEN 'calls' THEN 3 WHEN 'references' THEN 4 WHEN 'depends_on' THEN 5 WHEN 'uses' THEN 5 WHEN 'route_to_handler' THEN 6 WHEN 'asset_references' THEN 8 END"
KCOST = "CASE kind WHEN 'references' THEN 4 WHEN 'depends_on' THEN 5 WHEN 'implements' THEN 14 WHEN 'inherits' THEN 16 WHEN 'tests' THEN 24 WHEN 'declares' THEN 28 WHEN 'belongs_to' THEN CASE WHEN r = 'belongs_to' THEN 220 ELSE 120 END WHEN 'documents' THEN 55 WHEN 'related_to' THEN 50 WHEN 'build_produces' THEN 75 ELSE 35 END"
STEPS = f"""{DEG}, np AS (SELECT n.id, ({PENALTY})::DOUBLE AS penalty, ({ISTEST})::INT AS t, (({BRIDGE}) OR coalesce(degree, 0) >= 12)::INT AS hub FROM nodes n LEFT JOIN deg USING (id)),
ex AS (SELECT e.*, {RELATION} AS r FROM edges e), ec AS (SELECT ex.*, coalesce({RCOST}, {KCOST})::DOUBLE * {PROV} AS c0, ({RCOST})::DOUBLE AS rc, coalesce(s.t, 0) + coalesce(d.t, 0) AS tt FROM ex LEFT JOIN np s ON s.id = src LEFT JOIN np d ON d.id = dst),
ed AS (SELECT *, CASE WHEN rc IS NOT NULL AND r IN ('calls', 'references', 'depends_on', 'uses', 'route_to_handler', 'tests', 'asset_references') THEN least(CASE WHEN r = 'belongs_to' THEN greatest(c0, 220) ELSE c0 END, rc) WHEN r = 'belongs_to' THEN greatest(c0, 220) ELSE c0 END AS cost,
 (r IN ('belongs_to', 'source_file', 'declares', 'constructor', 'project_reference', 'using_directive') OR kind IN ('belongs_to', 'declares'))::INT AS st, (r IN ('inherits', 'implements') OR kind IN ('inherits', 'implements'))::INT AS inh FROM ec
 WHERE kind <> 'documents' AND coalesce(relation, '') NOT IN ('doc_link', 'doc_wikilink', 'doc_code_ref') AND NOT (r = 'constructor' AND tt > 0)),
sp AS (SELECT a, b, edge, cost, st, inh, penalty, t, hub FROM (SELECT src AS a, dst AS b, id AS edge, cost, st, inh FROM ed UNION ALL SELECT dst, src, id, cost, st, inh FROM ed) JOIN np ON np.id = b)"""


@query(f"{G}, {STEPS} SELECT edge, a, b, cost, penalty, t, hub, st AS structural, inh AS inheritance FROM sp")
def path_steps(spark, d):
    s = p.weighted(*graph(spark, d), intent="code_to_code")
    return s.select("edge", "a", "b", "cost", F.col("penalty").cast("double").alias("penalty"), "t", "hub", "structural", "inheritance")


ROW = "row(cost := round(k.cost + sp.cost + penalty, 6), te := te + t, st := k.st + sp.st, hu := hu + hub, inh := k.inh + sp.inh, hops := hops + 1)"


def walk(k: int) -> str:
    return f"w{k} AS (SELECT b AS id, min({ROW.replace('row(', 'struct_pack(').replace('k.', 'w.')}) AS m FROM (SELECT id, m.cost AS cost, m.te AS te, m.st AS st, m.hu AS hu, m.inh AS inh, m.hops AS hops FROM w{k - 1}) w JOIN sp ON a = w.id WHERE b <> '{START}' GROUP BY b)"


@query(f"{G}, {STEPS}, w0 AS (SELECT '{START}' AS id, struct_pack(cost := 0.0::DOUBLE, te := 0, st := 0, hu := 0, inh := 0, hops := 0) AS m), {walk(1)}, {walk(2)}, u AS (SELECT id, min(m) AS m FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY id) SELECT id, round(m.cost, 6) AS cost, m.te::INT AS tests, m.st::INT AS structural, m.hu::INT AS hubs, m.inh::INT AS inheritance, m.hops::INT AS hops FROM u")
def path_ranks(spark, d):
    """Ranks within two steps of a node; the paths themselves are held against plain Python in the tests."""
    best = p.ranks(kept(p.weighted(*graph(spark, d), intent="code_to_code"), "steps"), START, most=2)
    return best.select("id", F.round("rank.cost", 6).alias("cost"), *[F.col("rank")[n].alias(n) for n in p.RANK[1:]])


ENDS = ("OrderService56", "OrderService1.ts")


@query()
def named_path(spark, d):
    n, e = graph(spark, d)
    path, mode, intent = p.ranked_path(n, e, *ENDS)
    return p.explained(n, e, path or [], mode=mode, intent=intent)


@query()
def path_quality(spark, d):
    return p.quality(named_path(spark, d))


@query(f"{G}, t AS (SELECT id AS node FROM ({resolution_sql('Repository3')}) WHERE score > 0 ORDER BY score DESC, label, id LIMIT 1) SELECT node, e.id AS edge, e.kind AS edge_kind, provenance, n.id, n.label, n.kind FROM t JOIN edges e ON node IN (src, dst) JOIN nodes n ON n.id = CASE WHEN src = node THEN dst ELSE src END")
def explained_node(spark, d):
    return p.explain_node(*graph(spark, d), "Repository3")


FILES = "e AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'depends_on' AND id LIKE 'f:%' AND src <> dst)"
CYCLES = f"{FILES}, cy AS (SELECT path, len(path) AS n FROM (WITH RECURSIVE z(first, path, tip) AS (SELECT src, [src, dst], dst FROM e WHERE dst > src UNION ALL SELECT first, list_append(path, e.dst), e.dst FROM z JOIN e ON e.src = z.tip WHERE e.dst > first AND NOT list_contains(path, e.dst) AND len(path) < 8) SELECT * FROM z) q WHERE EXISTS (SELECT 1 FROM e WHERE e.src = q.tip AND e.dst = q.first))"


@query(f"{G}, {CYCLES} SELECT array_to_string(path, '>') AS cycle, n::INT AS length FROM cy")
def dependency_cycles(spark, d):
    return p.cycles(graph(spark, d)[1].filter("kind = 'depends_on' AND id LIKE 'f:%'"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'x1', 'x2' UNION SELECT 'x2', 'x1' UNION SELECT 'x2', 's1'), c(id, behind) AS (SELECT 'x1', TRUE UNION SELECT dst, TRUE FROM e JOIN c ON src = id), d(id, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM e JOIN d ON src = id) SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN -1 ELSE max(level) END::INT AS level FROM (SELECT id, level FROM d UNION ALL SELECT id, 0 FROM c) GROUP BY id")
def topological_order(spark, d):
    """Levels of customers, orders, parts and suppliers, with a cycle put in that one supplier lies behind; -1 for what is cyclic."""
    return p.levels(w.of(spark, d, "SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM {lineitem} UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM {lineitem} UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM {orders} UNION SELECT 'x1', 'x2' UNION SELECT 'x2', 'x1' UNION SELECT 'x2', 's1'")).select("id", F.coalesce("level", F.lit(-1)).alias("level"))


@query(f"{G}, s AS (SELECT id FROM nodes WHERE kind = 'code_file' AND path LIKE 'src/components/m1%'), r AS (SELECT dst AS id, CASE WHEN kind = 'depends_on' THEN 'imports' ELSE 'linked' END AS role FROM edges WHERE src IN (SELECT id FROM s) UNION SELECT src, CASE WHEN kind = 'depends_on' THEN 'imported_by' ELSE 'linked' END FROM edges WHERE dst IN (SELECT id FROM s)) SELECT id, role FROM r WHERE id IN (SELECT id FROM nodes) AND id NOT IN (SELECT id FROM s)")
def change_impact(spark, d):
    n, e = graph(spark, d)
    return p.impact(n, e, n.filter("kind = 'code_file' AND path LIKE 'src/components/m1%'").select("id"))


ORPHANS = "en AS (SELECT src AS id FROM edges WHERE kind NOT IN ('belongs_to', 'declares') UNION SELECT dst FROM edges WHERE kind NOT IN ('belongs_to', 'declares')), orp AS (SELECT id FROM nodes WHERE kind = 'code_file' AND id NOT IN (SELECT id FROM en) AND id NOT IN (SELECT dst FROM edges WHERE kind = 'belongs_to' AND src IN (SELECT id FROM nodes WHERE kind = 'symbol') AND src IN (SELECT id FROM en)))"


@query(f"{G}, ed2 AS (SELECT * FROM edges WHERE kind = 'documents' OR kind = 'belongs_to'), en AS (SELECT src AS id FROM ed2 WHERE kind <> 'belongs_to' UNION SELECT dst FROM ed2 WHERE kind <> 'belongs_to') SELECT id FROM nodes WHERE kind = 'code_file' AND id NOT IN (SELECT id FROM en) AND id NOT IN (SELECT dst FROM ed2 WHERE kind = 'belongs_to' AND src IN (SELECT id FROM nodes WHERE kind = 'symbol') AND src IN (SELECT id FROM en))")
def orphan_files(spark, d):
    """Files that no documentation names (the whole graph has no orphans): only documents and belongs_to edges take part."""
    n, e = graph(spark, d)
    return p.orphan_files(n, e.filter("kind IN ('documents', 'belongs_to')"))


CLASS = f"CASE WHEN r IN ('belongs_to', 'declares', 'inherits', 'implements', 'contains', 'constructor', 'source_file', 'project_reference', 'using_directive') THEN 'structural' WHEN r IN ('calls', 'references', 'depends_on', 'uses', 'route_to_handler', 'tests', 'asset_references') THEN 'semantic' WHEN kind IN ('belongs_to', 'declares', 'inherits', 'implements', 'contains') THEN 'structural' WHEN kind IN ('calls', 'references', 'depends_on', 'uses', 'tests', 'documents') THEN 'semantic' ELSE 'structural' END"
QUICK = f"""{ORPHANS}, {CYCLES.replace('len(path) < 8', 'len(path) < 4')}, rx AS (SELECT e.*, {RELATION} AS r FROM edges e), qf AS (SELECT 'dependencies' AS filter, src AS id FROM edges WHERE kind = 'depends_on' UNION SELECT 'dependencies', dst FROM edges WHERE kind = 'depends_on' UNION SELECT 'semantic', src FROM rx WHERE {CLASS} = 'semantic' UNION SELECT 'semantic', dst FROM rx WHERE {CLASS} = 'semantic'
UNION SELECT 'external', id FROM nodes WHERE kind = 'external_dep' UNION SELECT 'unresolved', src FROM edges WHERE src NOT IN (SELECT id FROM nodes) UNION SELECT 'unresolved', dst FROM edges WHERE dst NOT IN (SELECT id FROM nodes) UNION SELECT 'orphans', id FROM orp UNION SELECT 'cycles', unnest(path) FROM cy)"""


@query(f"{G}, {QUICK} SELECT filter, id FROM qf")
def quick_filters(spark, d):
    n, e = graph(spark, d)
    return p.quick_filters(n, e, e.filter("kind = 'depends_on' AND id LIKE 'f:%'"))


@query(f"{G}, {QUICK} SELECT filter, count(*)::BIGINT AS n FROM qf GROUP BY filter")
def architecture_health(spark, d):
    n, e = graph(spark, d)
    return p.architecture_health(n, e, e.filter("kind = 'depends_on' AND id LIKE 'f:%'"))


def batch_bfs_sql(seeds: str, budget: int, depth: int) -> str:
    """The same levels for many queries: places by a window within a query."""
    ctes = [f"q0 AS ({seeds})", "v0 AS (SELECT * FROM q0)"]
    for k in range(1, depth + 1):
        ctes.append(f"""q{k} AS MATERIALIZED (SELECT query_id, id, n + row_number() OVER (PARTITION BY query_id ORDER BY pp, id) - 1 AS place FROM (SELECT q.query_id, b AS id, min(place) AS pp FROM nr JOIN q{k - 1} q ON a = q.id
 WHERE NOT EXISTS (SELECT 1 FROM v{k - 1} v WHERE v.query_id = q.query_id AND v.id = b) GROUP BY ALL) JOIN (SELECT query_id, count(*) AS n FROM v{k - 1} GROUP BY ALL) USING (query_id) QUALIFY place < {budget})""")
        ctes.append(f"v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM q{k})")
    return ", ".join(ctes)


COMMUNITIES = "SELECT id AS query_id, id, 0 AS place FROM nodes WHERE kind = 'community'"


@query(f"{G}, {NEAR}, {batch_bfs_sql(COMMUNITIES, 30, 3)} SELECT query_id, id, place::BIGINT AS place FROM v3")
def batched_neighbourhoods(spark, d):
    """The neighbourhood of every community, all in one loop."""
    n, e = graph(spark, d)
    return batches.neighbourhoods(e, n.filter("kind = 'community'").select(F.col("id").alias("query_id"), "id", F.lit(0).alias("place")), budget=30, depth=3)


#: case_id, query, and the patterns that a seed and a found node must match.
CASES = [("docs", "order service architecture", "(?i)section|architecture", "(?i)service"), ("class", "OrderService", "(?i)orderservice", None), ("lost", "payment guide", "(?i)payment guide", "(?i)nothing of the kind"),
         ("wrong", "user controller test", "(?i)^invoice", None), ("none", "zzqx", ".", None)]


def case_sql(case: str, text: str, seed: str, result: str | None) -> str:
    match = f"coalesce((SELECT max(regexp_matches(label, '{result}')::INT) FROM r), 0) = 1" if result else "(SELECT count(*) FROM r) > 0"
    return f"""(WITH {seeds_sql(text, 'balanced')}, {bfs_sql('SELECT id, place - 1 AS place FROM seed', 24, 4)}, r AS (SELECT n.label FROM v4 JOIN nodes n USING (id)) SELECT '{case}' AS case_id, coalesce((SELECT max(regexp_matches(label, '{seed}')::INT) FROM seed), 0) = 1 AND {match} AS passed,
 coalesce((SELECT string_agg(label, ',' ORDER BY place) FROM seed), '') AS seed_labels, (SELECT count(*) FROM r)::BIGINT AS found)"""


@query(f"{G}, {NEAR} " + " UNION ALL ".join(case_sql(*x) for x in CASES))
def query_benchmark(spark, d):
    cases = spark.createDataFrame(CASES, "case_id string, query string, seed_pattern string, result_pattern string")
    return batches.query_benchmark(*graph(spark, d), cases)


@query()
def path_benchmark(spark, d):
    """Paths from a class to the files of its name, as their benchmark asks for them; held against plain Python in the tests."""
    n, e = graph(spark, d)
    none = ([], [], [])
    rows = [("found", *ENDS, "balanced", "(?i)^orderservice", "(?i)^orderservice", None, *none), ("forbidden", *ENDS, "balanced", "(?i)^orderservice", "(?i)^orderservice", None, ["symbol"], [], []),
            ("edge", *ENDS, "balanced", "(?i)^orderservice", "(?i)^orderservice", None, [], ["documents"], []), ("ends", *ENDS, "balanced", "(?i)^invoice", "(?i)^orderservice", None, *none)]
    cases = spark.createDataFrame(rows, "case_id string, source string, target string, mode string, from_pattern string, to_pattern string, path_pattern string, forbidden array<string>, required array<string>, preferred array<string>")
    return batches.path_benchmark(n, e, cases, p.steps_by(n, e))


#: Steps of a path for every order: its lines in order, with relations and kinds by number.
STEPS_OF = """SELECT l_orderkey AS path, CAST(l_linenumber AS INT) AS hop, CASE WHEN l_linenumber > 1 THEN 'e' || CAST(l_linenumber AS VARCHAR(9)) END AS edge, CASE WHEN l_linenumber > 1 THEN split_part('calls,uses,inherits,belongs_to,declares', ',', CAST(1 + min(l_partkey) % 5 AS INT)) END AS relation,
CASE WHEN l_linenumber > 1 THEN CASE WHEN min(l_partkey) % 5 < 2 THEN 'semantic' ELSE 'structural' END END AS class, CASE WHEN l_linenumber > 1 THEN 'k' END AS edge_kind, split_part('symbol,community,code_file,project', ',', CAST(1 + min(l_suppkey) % 4 AS INT)) AS kind, CASE WHEN min(l_suppkey) % 9 = 0 THEN 'X (external)' ELSE 'Y' END AS label FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
QUALITY = f"""so AS ({w.bound(STEPS_OF)}), ql AS (SELECT *, round(greatest(0, least(1, (semantic + 1) / (semantic + structural + hubs + inheritance + hops))), 6)::DOUBLE AS directness FROM (SELECT path, count(*) FILTER (class = 'semantic') AS semantic, count(*) FILTER (class = 'structural') AS structural,
 count(*) FILTER (kind IN ('community', 'project')) AS hubs, count(*) FILTER (label = 'X (external)') AS outside, count(*) FILTER (relation = 'inherits') AS inheritance, greatest(count(edge), 1) AS hops, coalesce(string_agg(relation, ',' ORDER BY hop) FILTER (edge IS NOT NULL), '') AS relations FROM so GROUP BY path))"""


@query(f"WITH {QUALITY} SELECT path, semantic::BIGINT AS semantic, structural::BIGINT AS structural, hubs::BIGINT AS hubs, outside::BIGINT AS outside, inheritance::BIGINT AS inheritance, hops::BIGINT AS hops, relations, directness FROM ql")
def path_qualities(spark, d):
    return p.quality(w.of(spark, d, STEPS_OF), ("path",))


@query(f"WITH {QUALITY} SELECT path, 'too_many_hubs' AS fault FROM ql WHERE hubs > 2 UNION ALL SELECT path, 'too_many_structural' FROM ql WHERE structural > 3 UNION ALL SELECT path, 'indirect' FROM ql WHERE directness < 0.3 UNION ALL SELECT path, 'forbidden_declares' FROM ql WHERE list_contains(string_split(relations, ','), 'declares') UNION ALL SELECT path, 'required_order' FROM ql WHERE NOT regexp_matches(',' || relations || ',', ',calls,(.*,)?uses,')")
def path_faults(spark, d):
    quality = p.quality(w.of(spark, d, STEPS_OF), ("path",))
    return r.path_faults(quality, most={"hubs": 2, "structural": 3}, directness=0.3, forbidden=("declares",), required=("calls", "uses"), keys=("path",))
