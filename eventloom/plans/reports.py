"""Registered queries of the smaller views, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import reports as r
from eventloom.operators import workspace as ws
from eventloom.operators.code import SCOPES
from eventloom.plans.catalog import query
from eventloom.plans.code import DEG, G, LIKE, ROLES, SHOWN, START, TEST, TEXT, CENTRAL, SCORE, ranked_sql, rl, rules_sql
from eventloom.plans.paths import graph
from eventloom.plans.workspace import HOME
from eventloom.sources import workspace as w


@query(f"{G} SELECT id FROM nodes WHERE contains(lower(concat_ws(chr(10), id, kind, label, path, scanner_id)), 'service')")
def nodes_with_text(spark, d):
    return r.matching(w.nodes(spark, d), " Service", ["id", "kind", "label", "path", "scanner_id"]).select("id")


@query(f"{G} SELECT id, kind, label, path FROM nodes")
def shown_nodes(spark, d):
    return r.shown(w.nodes(spark, d))


@query(f"{G} SELECT e.id, e.kind IN ('references', 'inherits', 'implements', 'depends_on') AND (coalesce(relation IN ('calls', 'uses', 'semantic_calls', 'semantic_constructor'), FALSE) OR coalesce(s.kind = 'symbol' AND t.kind = 'symbol', FALSE)) AS semantic, e.kind = 'depends_on' AND (coalesce(relation IN ('imports', 'import'), FALSE) OR coalesce(s.kind IN ('code_file', 'symbol', 'community') AND t.kind IN ('code_file', 'symbol', 'community'), FALSE)) AS dependency FROM edges e LEFT JOIN nodes s ON s.id = src LEFT JOIN nodes t ON t.id = dst")
def code_map_edges(spark, d):
    return r.edge_roles(w.edges(spark, d), w.nodes(spark, d))  # edges are read once, so they aren't written


LOG = "SELECT event_id AS line, CASE event_type WHEN 'error' THEN 'graph.json missing for run ' || event_id WHEN 'signup' THEN 'password=' || event_id WHEN 'view' THEN '  roslyn not found, fallback ' || event_id ELSE 'all well' END AS text FROM {events}"
FOUND = {"stale_graph": r"(?i)(stale|outdated|graph\.json.*missing)", "missing_analyzer": r"(?i)(roslyn|analyzer.*unavailable|fallback)"}


@query(f"WITH l AS ({w.bound(LOG)}), h AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, line, trim(text) AS text FROM l WHERE regexp_matches(text, '{p}') AND NOT regexp_matches(text, '{r.SECRET_LINE}')" for n, p in FOUND.items()) + ") SELECT rule, line, text, row_number() OVER (PARTITION BY rule ORDER BY line)::INT AS place FROM h QUALIFY place <= 4")
def log_findings(spark, d):
    return r.log_findings(w.of(spark, d, LOG), FOUND)


SPECS = "SELECT 'specs/s' || c_custkey || '/tasks.md' AS path, '# Tasks' || chr(10) || '- [x] T001 set up ' || c_custkey || chr(10) || 'text' || chr(10) || '- [ ] T002 [P] one' || chr(10) || '* [ ] T003 [P] two' || chr(10) || '- [X] T004 join' || chr(10) || '- [ ] no number' AS body FROM {customer}"
TASKS = f"WITH sp AS ({w.bound(SPECS)}), tk AS (SELECT path, unnest([2, 4, 5, 6, 7]) AS line, unnest(['T001', 'T002', 'T003', 'T004', NULL]) AS task, unnest([TRUE, FALSE, FALSE, TRUE, FALSE]) AS done, unnest([FALSE, TRUE, TRUE, FALSE, FALSE]) AS parallel, unnest(['set up ' || regexp_extract(path, 's([0-9]+)/', 1), 'one', 'two', 'join', 'no number']) AS title FROM sp)"


@query(f"{TASKS} SELECT path, line::INT AS line, task, done, parallel, title FROM tk")
def spec_tasks(spark, d):
    return r.task_list(w.of(spark, d, SPECS))


@query(f"{TASKS} SELECT path || '#' || task AS src, path AS dst, 'belongs_to' AS kind FROM tk WHERE task IS NOT NULL UNION ALL SELECT path || '#' || task, path || '#T001', 'depends_on' FROM tk WHERE task IN ('T002', 'T003', 'T004')")
def spec_edges(spark, d):
    return r.spec_edges(r.task_list(w.of(spark, d, SPECS)))


@query(f"{G}, b AS (SELECT 0 AS turn, 'product.node.upserted' AS kind, id FROM nodes WHERE kind = 'code_file' UNION ALL SELECT 1, 'product.edge.upserted', id FROM edges WHERE id LIKE 'f:%' UNION ALL SELECT 2, 'product.edge.archived', id FROM edges WHERE id LIKE 'i:%' UNION ALL SELECT 3, 'product.node.archived', id FROM nodes WHERE kind = 'test') SELECT 'p1' AS graph_id, kind, id, (1000 + row_number() OVER (ORDER BY turn, id))::BIGINT AS seq FROM b")
def scan_events(spark, d):
    n, e = graph(spark, d)
    return r.scan_events("p1", n.filter("kind = 'code_file'"), e.filter("id LIKE 'f:%'"), e.filter("id LIKE 'i:%'"), n.filter("kind = 'test'"), 1000)


CATALOG = [("typescript", "T0"), ("python", "T1"), ("go", "T1"), ("dotnet", "T1.5"), ("docs", "T1"), ("terraform", "T2"), ("swift", "T2")]


@query(f"{G}, c AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in CATALOG)}) t(scanner_id, tier)) SELECT c.scanner_id, tier, count(*) FILTER (kind = 'code_file')::BIGINT AS files, count(*) FILTER (kind = 'symbol')::BIGINT AS symbols, count(id)::BIGINT AS nodes FROM c LEFT JOIN nodes USING (scanner_id) GROUP BY ALL")
def support_matrix(spark, d):
    return r.support_matrix(w.nodes(spark, d), spark.createDataFrame(CATALOG, "scanner_id string, tier string"))


BUCKET = f"CASE WHEN {TEST} THEN 'related_tests' WHEN kind IN ('doc_file', 'doc_section') THEN 'supporting_docs' WHEN kind = 'config_file' THEN 'operational_config' WHEN kind = 'symbol' AND contains(lower(label), '(interface)') THEN 'public_contracts' WHEN kind = 'symbol' AND {LIKE} AND {rl(START + '|entrypoint|manager|provider')} THEN 'start_with' WHEN kind = 'code_file' AND {rl(START, TEXT)} THEN 'start_with' ELSE 'core_implementation' END"
MOST = "CASE bucket " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in r.BUCKETS.items()) + " END"


@query(f"{G}, {DEG}, {ROLES}, {HOME}, x AS (SELECT community, {BUCKET} AS bucket, {SHOWN} AS shown, {SCORE} + {CENTRAL} AS sc, label FROM roles JOIN hm USING (id) WHERE kind IN ('symbol', 'code_file', 'community', 'config_file', 'test', 'doc_file', 'doc_section') AND NOT regexp_matches(replace({SHOWN}, '\\', '/'), '(?i)(?:^|/)(?:bin|obj|node_modules|dist|build|\\.git|\\.next|\\.turbo|coverage)(?:/|$)') AND NOT contains(lower({SHOWN}), '(external)')), y AS (SELECT community, bucket, shown, min(struct_pack(sc := sc, l := label)) AS b FROM x GROUP BY ALL) SELECT community, bucket, shown, row_number() OVER (PARTITION BY community, bucket ORDER BY b, shown)::INT AS place FROM y QUALIFY place <= {MOST}")
def community_buckets(spark, d):
    n, e = graph(spark, d)
    return r.community_buckets(n, e, ws.node_communities(n, e))


INTENTS = {"graph": ["graph", "path"], "docs": ["guide", "docs", "readme"], "backend": ["service", "order"], "frontend": ["view", "page"], "tests": ["test"]}
HITS = {n: "len(list_filter(ws, lambda w: " + " OR ".join(f"contains(w, '{x}') OR contains('{x}', w)" for x in xs) + "))" for n, xs in INTENTS.items()}


@query(f"{G}, q AS (SELECT id, list_filter(string_split(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2) AS ws FROM nodes), h AS (SELECT id, {', '.join(f'{h} AS {n}' for n, h in HITS.items())} FROM q) SELECT id, CASE WHEN greatest({', '.join(INTENTS)}) = 0 THEN 'general' " + " ".join(f"WHEN {n} = greatest({', '.join(INTENTS)}) THEN '{n}'" for n in INTENTS) + " END AS intent FROM h")
def goal_intents(spark, d):
    """Labels as goals."""
    return w.nodes(spark, d).select("id", r.goal_intent(F.col("label"), INTENTS).alias("intent"))


CRITERIA = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'File src/a' || o_orderkey % 5 || '.ts exists' WHEN 1 THEN 'Exit code ' || o_orderkey % 3 WHEN 2 THEN 'All tests pass' ELSE 'Reads well' END AS criterion, o_orderkey % 7 AS k FROM {orders}"


@query(f"SELECT id, criterion, CASE WHEN criterion LIKE 'File%' THEN 'missing_file' WHEN criterion LIKE 'Exit%' THEN 'no_exit_code' WHEN criterion LIKE 'All%' THEN 'no_passing_test' ELSE 'bad_output' END AS finding FROM ({w.bound(CRITERIA)}) WHERE CASE WHEN criterion LIKE 'File%' THEN criterion NOT LIKE '%a2.ts%' WHEN criterion LIKE 'Exit%' THEN right(criterion, 1)::INT <> k % 2 WHEN criterion LIKE 'All%' THEN k % 2 <> 0 ELSE k IN (0, 3) END")
def criterion_checks(spark, d):
    rows = w.of(spark, d, CRITERIA)
    commands = F.array(F.struct(F.lit("npm test").alias("command"), (F.col("k") % 2).cast("int").alias("exit_code")))
    output = F.when(F.col("k") == 0, F.lit(None)).when(F.col("k") == 3, "TODO later").otherwise("done")
    return r.checks(rows.select("id", "criterion", F.array(F.lit("src/a2.ts")).alias("files"), commands.alias("commands"), output.alias("output")))


@query("SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, round(avg((c_acctbal > 0)::INT), 6) AS rate FROM customer GROUP BY 1")
def segment_pass_rates(spark, d):
    """Customers with a positive balance as passed results."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 0).alias("passed"))
    return r.pass_rates(rows, "segment")


@query("WITH s AS (SELECT c_mktsegment AS category, least(100, greatest(0, floor(100 * avg((c_acctbal > 0)::INT) + 0.5)))::BIGINT AS score FROM customer GROUP BY 1), a AS (SELECT * FROM s UNION ALL SELECT 'overall', floor(avg(score) + 0.5)::BIGINT FROM s) SELECT *, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'weak' END AS status FROM a")
def scorecard(spark, d):
    rates = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("category")).agg((100 * F.avg((F.col("c_acctbal") > 0).cast("double"))).alias("score"))
    return r.scorecard(rates)


DOCS = "SELECT 'doc' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN 'run npm test first' WHEN 1 THEN 'use pytest and make lint' WHEN 2 THEN 'npm run lint:all' WHEN 3 THEN 'cargo test' ELSE text END AS text FROM {documents}"
CMD = "(npm (?:run )?[\\w:-]+|pytest|tox|make [\\w-]+|cargo test|go test|dotnet test)"
COMMANDS = f"WITH t AS (SELECT path, unnest(regexp_extract_all(text, '\\b{CMD}\\b', 1)) AS command FROM ({w.bound(DOCS)})), cm AS (SELECT CASE WHEN regexp_matches(command, 'test|tox') THEN 'test' WHEN contains(command, 'lint') THEN 'lint' WHEN contains(command, 'build') THEN 'build' ELSE 'other' END AS kind, command, count(DISTINCT path)::BIGINT AS sources FROM t GROUP BY ALL)"


@query(f"{COMMANDS} SELECT * FROM cm")
def verification_commands(spark, d):
    return r.commands(w.of(spark, d, DOCS))


@query(f"{COMMANDS} SELECT 'conflict' AS what, kind FROM cm WHERE kind <> 'other' GROUP BY kind HAVING count(*) > 1 UNION ALL SELECT 'gap', k FROM unnest(['test', 'build', 'lint']) x(k) WHERE k NOT IN (SELECT kind FROM cm)")
def command_conflicts(spark, d):
    return r.command_conflicts(r.commands(w.of(spark, d, DOCS)))


@query(f"{G}, near AS (SELECT dst AS id, kind AS ek FROM edges WHERE src = 'symbol:17' UNION ALL SELECT src, kind FROM edges WHERE dst = 'symbol:17') SELECT id, min(ek) AS edge_kind, label, kind FROM near JOIN nodes USING (id) WHERE id <> 'symbol:17' GROUP BY id, label, kind ORDER BY label, id LIMIT 8")
def retrieved_neighbours(spark, d):
    return r.retrieved(*graph(spark, d), "symbol:17").select("id", "edge_kind", "label", "kind")


@query(f"{G}, {ranked_sql('order service', 'balanced')}, u AS (SELECT id, 0 AS turn, 0 AS s FROM nodes WHERE id IN ('file:3', 'file:5') UNION ALL SELECT id, 1, -score FROM ranked), p AS (SELECT id, min(struct_pack(t := turn, s := s)) AS k FROM u GROUP BY id ORDER BY k, id LIMIT 24) SELECT id, src, dst FROM edges WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p) ORDER BY id LIMIT 32")
def context_slice(spark, d):
    n, e = graph(spark, d)
    return r.context_slice(n, e, n.filter("id IN ('file:3', 'file:5')").select("id"), "order service")[1].select("id", "src", "dst")


#: Ids of every community, some symbols and sections as what they are and as what they aren't, of what isn't there, paths and benchmarks.
ASKED_IDS = """SELECT 'g:community:' || id AS retrieval_id FROM nodes WHERE kind IN ('community', 'project') UNION ALL SELECT 'g:node:' || id FROM nodes WHERE kind = 'symbol' AND id LIKE '%7' UNION ALL SELECT 'g:doc:' || id FROM nodes WHERE kind IN ('doc_section', 'symbol') AND id LIKE '%3'
UNION ALL SELECT 'g:node:gone' UNION ALL SELECT 'g:path:a:b' UNION ALL SELECT 'g:benchmark:speed' UNION ALL SELECT 'g:other:x'"""


@query(f"""{G}, iq AS ({ASKED_IDS}), q AS (SELECT retrieval_id, string_split(retrieval_id, ':')[2] AS kind, regexp_replace(retrieval_id, '^g:[a-z]+:', '') AS a FROM iq), rl AS (SELECT q.*, label FROM q JOIN nodes n ON n.id = a WHERE q.kind = 'node' OR q.kind = 'community' AND n.kind = 'community' OR q.kind = 'doc' AND n.kind IN ('doc_file', 'doc_section')),
nr AS (SELECT src AS a, dst AS b, id AS edge, kind AS edge_kind, FALSE AS into_ FROM edges UNION ALL SELECT dst, src, id, kind, TRUE FROM edges WHERE src <> dst), x AS (SELECT rl.retrieval_id, rl.kind, nr.*, n.label AS bl FROM rl JOIN nr USING (a) JOIN nodes n ON n.id = b),
bs AS (SELECT retrieval_id, row_number() OVER (PARTITION BY retrieval_id ORDER BY bl, b) AS place, b AS id, edge_kind FROM (SELECT retrieval_id, b, bl, min(edge_kind) AS edge_kind FROM x WHERE kind = 'node' AND a <> b GROUP BY ALL) QUALIFY place <= 8
 UNION ALL SELECT retrieval_id, row_number() OVER (PARTITION BY retrieval_id ORDER BY bl, b) AS place, b, edge_kind FROM (SELECT DISTINCT retrieval_id, b, bl, edge_kind FROM x WHERE kind = 'community' AND edge_kind = 'belongs_to' AND into_) QUALIFY place <= 12
 UNION ALL SELECT retrieval_id, row_number() OVER (PARTITION BY retrieval_id ORDER BY edge) AS place, b, edge_kind FROM x WHERE kind = 'doc' QUALIFY place <= 8)
SELECT retrieval_id, kind, label, place::INT AS place, bs.id, edge_kind FROM rl LEFT JOIN bs USING (retrieval_id) UNION ALL SELECT 'g:path:a:b', 'path', 'a > b', 1, 'a', NULL UNION ALL SELECT 'g:path:a:b', 'path', 'a > b', 2, 'b', NULL UNION ALL SELECT 'g:benchmark:speed', 'benchmark', 'speed', NULL, NULL, NULL""")
def retrieved_ids(spark, d):
    n, e = graph(spark, d)
    return r.retrieved_by(n, e, spark.sql(ASKED_IDS.replace("FROM nodes", "FROM {nodes}"), nodes=n), "g")


TOUCHED = "SELECT l_suppkey AS run, CASE l_linenumber % 3 WHEN 0 THEN '/abs/' WHEN 1 THEN '' ELSE '../' END || {path} AS path FROM {lineitem}"


@query(f"{G}, t AS (SELECT l_suppkey AS run, {w.file_path('l_partkey')} AS path FROM lineitem WHERE l_linenumber % 3 = 1) SELECT DISTINCT 'run:' || run AS src, n.id AS dst, 'touches' AS kind FROM t JOIN nodes n ON n.path = t.path AND n.kind = 'code_file' UNION SELECT DISTINCT 'evidence:' || l_suppkey, 'run:' || l_suppkey, 'produced_by' FROM lineitem")
def run_links(spark, d):
    touched = w.of(spark, d, TOUCHED.replace("{path}", w.file_path("l_partkey")))
    files = w.nodes(spark, d).filter("kind = 'code_file'")
    return r.run_links(touched.select("run").distinct(), touched, files)


@query(f"{G}, x AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY path ORDER BY kind, id) = 1) SELECT id, path FROM x ORDER BY kind, id LIMIT 40")
def first_of_each_path(spark, d):
    return r.first_of(w.nodes(spark, d), ["path"], ["kind", "id"], 40).select("id", "path")


@query(f"{G}, {DEG}, dp AS (SELECT id, count(*)::BIGINT AS dependencies FROM (SELECT src AS id FROM edges WHERE kind = 'depends_on' UNION ALL SELECT dst FROM edges WHERE kind = 'depends_on') GROUP BY id), sy AS (SELECT dst AS id, count(*)::BIGINT AS symbols FROM edges WHERE kind = 'belongs_to' AND src IN (SELECT id FROM nodes WHERE kind = 'symbol') GROUP BY dst), f AS (SELECT n.id, path, coalesce(degree, 0)::BIGINT AS degree, coalesce(dependencies, 0)::BIGINT AS dependencies, coalesce(symbols, 0)::BIGINT AS symbols, unnest({rules_sql('path', SCOPES)}) AS scope FROM nodes n LEFT JOIN deg USING (id) LEFT JOIN dp USING (id) LEFT JOIN sy USING (id) WHERE kind = 'code_file') SELECT scope, id, degree, dependencies, symbols, row_number() OVER (PARTITION BY scope ORDER BY degree DESC, dependencies DESC, symbols DESC, path, id)::INT AS place FROM f QUALIFY place <= 5")
def scope_files(spark, d):
    return r.scope_files(*graph(spark, d))


@query("SELECT 'tests_in_list' AS fault UNION ALL SELECT 'apart_from_hubs'")
def guidance_faults(spark, d):
    """A list of two tests, against starts of hubs that it shares nothing with."""
    n = w.nodes(spark, d)
    return r.guidance_faults(n.filter("kind = 'test'").orderBy("id").limit(2), n.filter("kind = 'config_file'").select(F.col("path").alias("shown")))
