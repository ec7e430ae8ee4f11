"""Registered queries over the product graph, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import product as p
from eventloom.plans.catalog import query
from eventloom.session import kept
from eventloom.sources import workspace as w

P = w.PRODUCT_SQL
ANCHORS, CODE = ("(" + ", ".join(f"'{x}'" for x in xs) + ")" for xs in (p.ANCHORS, p.CODE))
UNRESOLVED = "kind = 'open_question' AND status NOT IN ('resolved', 'completed', 'superseded', 'archived')"


def graph(spark, d):
    """The projection, written once: every query reads it several times."""
    nodes, edges = p.project(w.product_events(spark, d))
    return kept(nodes, "product_nodes"), kept(edges, "product_edges")


def roles(spark, d):
    """Nodes with their kinds, written, and edges of all nodes that ever were, not written: the operators of intent read them once and look up both ends."""
    nodes, edges = p.folded(w.product_events(spark, d), ("kind",), ("src", "dst", "kind"))
    return kept(nodes, "product_kinds"), edges


def beside(name: str, kinds: str, of: str, to: str) -> str:
    """CTE of distinct (a, b)."""
    return f"{name} AS (SELECT DISTINCT a, b FROM pa JOIN pn x ON x.id = a JOIN pn y ON y.id = b WHERE pa.kind IN ({kinds}) AND {of.format(n='x')} AND {to.format(n='y')})"


CRIT = beside("crit", "'satisfies'", "{n}.kind = 'feature'", "{n}.kind = 'acceptance_criterion'")
VERI = ", ".join([
    beside("vby", "'verifies'", "{n}.kind = 'acceptance_criterion'", "{n}.kind IN ('test_result', 'agent_run')"), beside("vown", "'verifies'", "{n}.kind = 'acceptance_criterion'", "{n}.kind = 'evidence'"),
    beside("vev", "'produced_by'", "{n}.kind IN ('test_result', 'agent_run')", "{n}.kind = 'evidence'"),
    "veri AS (SELECT id AS criterion, (SELECT count(*) FROM vby WHERE a = id)::BIGINT AS verifiers, (SELECT count(*) FROM (SELECT b FROM vown WHERE a = id UNION SELECT vev.b FROM vby JOIN vev ON vev.a = vby.b WHERE vby.a = id))::BIGINT AS evidence FROM pn WHERE kind = 'acceptance_criterion')"])
ACC = f"{CRIT}, {VERI}, acc AS (SELECT crit.a AS feature, count(*)::BIGINT AS total, count(*) FILTER (verifiers + evidence > 0)::BIGINT AS verified, count(*) FILTER (verifiers + evidence = 0)::BIGINT AS unverified FROM crit JOIN veri ON criterion = crit.b GROUP BY 1)"
RUNS = "done AS (SELECT id AS task FROM pn WHERE kind = 'task' AND status = 'completed'), runs AS (SELECT DISTINCT src AS task, dst AS run FROM pe WHERE kind = 'produced_by' AND src IN (SELECT task FROM done) AND dst IN (SELECT id FROM pn WHERE kind = 'agent_run'))"
EXEC = ", ".join([
    RUNS, beside("rev", "'produced_by'", "{n}.kind = 'agent_run'", "{n}.kind = 'evidence'"), beside("rfi", "'touches'", "{n}.kind = 'agent_run'", "{n}.kind = 'code_file'"),
    "tev AS (SELECT DISTINCT task, b AS evidence FROM runs JOIN rev ON a = run), tfi AS (SELECT DISTINCT task, b AS file FROM runs JOIN rfi ON a = run)",
    "exe AS (SELECT task, coalesce(r.n, 0)::BIGINT AS runs, coalesce(e.n, 0)::BIGINT AS evidence, coalesce(f.n, 0)::BIGINT AS files FROM done LEFT JOIN (SELECT task, count(*) AS n FROM runs GROUP BY 1) r USING (task) LEFT JOIN (SELECT task, count(*) AS n FROM tev GROUP BY 1) e USING (task) LEFT JOIN (SELECT task, count(*) AS n FROM tfi GROUP BY 1) f USING (task))"])
TESTS = ", ".join([
    beside("tre", "'verifies', 'produced_by'", "TRUE", "{n}.kind = 'test_result'"),
    "rel AS (SELECT task, task AS a FROM done UNION SELECT task, run FROM runs UNION SELECT task, evidence FROM tev), trs AS (SELECT DISTINCT task, tre.b FROM rel JOIN tre ON tre.a = rel.a)",
    "tes AS (SELECT task, runs, evidence, coalesce(r.n, 0)::BIGINT AS results, coalesce(c.n, 0)::BIGINT AS commands, runs > 0 AND evidence > 0 AS linked FROM exe LEFT JOIN (SELECT task, count(*) AS n FROM trs GROUP BY 1) r USING (task) LEFT JOIN (SELECT task, sum(tests) AS n FROM tev JOIN pn ON id = evidence GROUP BY 1) c USING (task))"])
BLOCK = f"blk AS (SELECT src AS node, dst AS question FROM pe WHERE kind = 'blocked_by' AND dst IN (SELECT id FROM pn WHERE {UNRESOLVED}))"
INTENT = ", ".join([
    beside("crun", "'touches'", f"{{n}}.kind IN {CODE}", "{n}.kind = 'agent_run'"), beside("rtask", "'produced_by'", "{n}.kind = 'agent_run'", "{n}.kind = 'task'"), beside("ctask", "'touches', 'implements', 'depends_on'", f"{{n}}.kind IN {CODE}", "{n}.kind = 'task'"),
    beside("cint", "'implements', 'satisfies', 'verifies'", f"{{n}}.kind IN {CODE}", f"{{n}}.kind IN {ANCHORS}"), beside("rint", "'produced_by', 'verifies'", "{n}.kind = 'agent_run'", f"{{n}}.kind IN {ANCHORS}"),
    beside("tint", "'implements', 'satisfies', 'verifies'", "{n}.kind = 'task'", f"{{n}}.kind IN {ANCHORS}"),
    "alltask AS (SELECT crun.a, rtask.b FROM crun JOIN rtask ON rtask.a = crun.b UNION SELECT a, b FROM ctask), allint AS (SELECT a, b FROM cint UNION SELECT crun.a, rint.b FROM crun JOIN rint ON rint.a = crun.b UNION SELECT alltask.a, tint.b FROM alltask JOIN tint ON tint.a = alltask.b)",
    f"cin AS (SELECT id AS code, coalesce(r.n, 0)::BIGINT AS runs, coalesce(t.n, 0)::BIGINT AS tasks, coalesce(i.n, 0)::BIGINT AS intents FROM pn LEFT JOIN (SELECT a, count(*) AS n FROM crun GROUP BY 1) r ON r.a = id LEFT JOIN (SELECT a, count(*) AS n FROM alltask GROUP BY 1) t ON t.a = id LEFT JOIN (SELECT a, count(*) AS n FROM allint GROUP BY 1) i ON i.a = id WHERE kind IN {CODE})"])
FRESH = f"""scn AS (SELECT count(*)::BIGINT AS scanned, max(made) AS latest FROM pn WHERE kind IN {CODE} AND scanned),
tch AS (SELECT c.id, max(greatest(pe.made, r.made, c.made)) AS changed_at FROM pe JOIN pn r ON r.id IN (src, dst) AND r.kind = 'agent_run' JOIN pn c ON c.id IN (src, dst) AND c.kind IN {CODE} WHERE pe.kind = 'touches' GROUP BY c.id),
fre AS (SELECT scn.scanned, scn.latest, (SELECT count(*) FROM tch)::BIGINT AS touched, (SELECT count(*) FROM tch, scn WHERE latest IS NULL OR changed_at > latest)::BIGINT AS changed_after FROM scn)"""


@query(f"{P} SELECT id, kind, title, status, made FROM pn")
def product_nodes(spark, d):
    return p.project(w.product_events(spark, d))[0].select("id", "kind", "title", "status", "made")


@query(f"{P} SELECT * FROM pe")
def product_edges(spark, d):
    return p.project(w.product_events(spark, d))[1]


@query(f"{P}, e AS (SELECT dst AS node, 'in' AS way, id, made FROM pe UNION ALL SELECT src, 'out', id, made FROM pe) SELECT node, way, id, row_number() OVER (PARTITION BY node, way ORDER BY made, id)::INT AS place FROM e")
def product_adjacency(spark, d):
    nodes, edges = p.folded(w.product_events(spark, d), (), ("src", "dst", "made"))
    return p.adjacency(edges, kept(nodes, "product_ids"))


@query("WITH pev AS (" + w.bound(w.PRODUCT) + ") SELECT seq::BIGINT AS seq, kind, coalesce(node_id, edge_id) AS item FROM pev")
def product_log_scan(spark, d):
    return w.product_events(spark, d).select(F.col("seq").cast("long").alias("seq"), "kind", F.coalesce("node_id", "edge_id").alias("item"))


@query(f"{P}, {BLOCK} SELECT 'node' AS what, kind, count(*)::BIGINT AS n FROM pn GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM pe GROUP BY kind UNION ALL SELECT 'unresolved_question', 'all', count(*) FROM pn WHERE {UNRESOLVED} UNION ALL SELECT 'blocked_task', 'all', count(*) FROM pn WHERE kind = 'task' AND id IN (SELECT node FROM blk)")
def product_summary(spark, d):
    return p.summary(*graph(spark, d))


@query(f"{P}, {BLOCK} SELECT node, question FROM blk")
def product_blockers(spark, d):
    return p.blockers(*graph(spark, d))


@query(f"{P}, {CRIT} SELECT a AS feature, b AS criterion FROM crit")
def feature_criteria(spark, d):
    return p.criteria(*graph(spark, d))


@query(f"{P}, {VERI} SELECT * FROM veri")
def criterion_evidence(spark, d):
    return p.verification(*graph(spark, d))


@query(f"{P}, {ACC} SELECT * FROM acc")
def feature_acceptance(spark, d):
    return p.acceptance(*graph(spark, d))


@query(f"""{P}, {ACC}, f AS (SELECT pn.id, acc.* FROM pn LEFT JOIN acc ON feature = pn.id WHERE kind = 'feature'), h AS (SELECT count(*)::BIGINT AS features, count(total)::BIGINT AS with_criteria, count(*) FILTER (unverified > 0)::BIGINT AS needing_evidence,
coalesce(sum(total), 0)::BIGINT AS criteria, coalesce(sum(verified), 0)::BIGINT AS verified, coalesce(sum(unverified), 0)::BIGINT AS unverified FROM f) SELECT *, CASE WHEN criteria > 0 THEN floor(verified * 100 / criteria + 0.5) ELSE 0 END::BIGINT AS coverage_percent FROM h""")
def acceptance_health(spark, d):
    return p.acceptance_health(*graph(spark, d))


@query(f"{P}, {CRIT}, {VERI} SELECT a AS feature, b AS criterion FROM crit JOIN veri ON criterion = b WHERE verifiers + evidence = 0")
def acceptance_gaps(spark, d):
    return p.acceptance_gaps(*graph(spark, d))


@query(f"{P}, {EXEC} SELECT *, runs = 0 AS no_run, evidence = 0 AS no_evidence, runs = 0 OR evidence = 0 AS drift FROM exe")
def task_execution(spark, d):
    return p.execution(*graph(spark, d))


@query(f"{P}, {EXEC}, {TESTS} SELECT *, linked AND results = 0 AND commands = 0 AS gap FROM tes")
def task_tests(spark, d):
    return p.test_evidence(*graph(spark, d))


@query(f"{P}, {EXEC}, {TESTS} SELECT count(*)::BIGINT AS completed, count(*) FILTER (runs = 0 OR evidence = 0)::BIGINT AS with_drift, count(*) FILTER (runs = 0)::BIGINT AS missing_run, count(*) FILTER (evidence = 0)::BIGINT AS missing_evidence, count(*) FILTER (linked)::BIGINT AS with_evidence, count(*) FILTER (linked AND results = 0 AND commands = 0)::BIGINT AS missing_tests FROM tes")
def execution_summary(spark, d):
    return p.execution_summary(*graph(spark, d))


@query(f"{P}, {BLOCK} SELECT id AS task, (SELECT count(*) FROM blk WHERE node = id)::BIGINT AS blockers, (SELECT count(*) FROM blk WHERE node = id) = 0 AS ready FROM pn WHERE kind = 'task' AND status = 'planned'")
def task_readiness(spark, d):
    return p.readiness(*graph(spark, d))


@query(f"{P}, {INTENT} SELECT *, runs > 0 AS changed, runs > 0 AND intents = 0 AS drift FROM cin")
def code_intent(spark, d):
    return p.code_intent(*roles(spark, d))


@query(f"{P}, {INTENT} SELECT count(*)::BIGINT AS changed, count(*) FILTER (intents > 0)::BIGINT AS with_intent, count(*) FILTER (intents = 0)::BIGINT AS without FROM cin WHERE runs > 0")
def intent_drift(spark, d):
    return p.intent_drift(*roles(spark, d))


@query(f"{P}, {FRESH} SELECT *, scanned = 0 AND touched > 0 AS missing, scanned > 0 AND changed_after > 0 AS stale FROM fre")
def code_scan_freshness(spark, d):
    return p.scan_freshness(*graph(spark, d))


PLANNING = ", ".join([
    beside("pin", "'belongs_to', 'satisfies', 'implements', 'verifies', 'depends_on', 'derived_from'", "{n}.kind = 'task'", f"{{n}}.kind IN {ANCHORS}"), beside("par", "'touches', 'implements', 'depends_on'", "{n}.kind = 'task'", f"{{n}}.kind IN {CODE}"),
    beside("pqu", "'blocked_by'", "{n}.kind = 'task'", "({n}.kind = 'open_question' AND {n}.status NOT IN ('resolved', 'completed', 'superseded', 'archived'))")])


@query(f"{P}, {PLANNING}, f AS (SELECT a, b, 'intent' AS what FROM pin UNION ALL SELECT a, b, 'area' FROM par UNION ALL SELECT a, b, 'question' FROM pqu) SELECT a AS task, what, b AS item, row_number() OVER (PARTITION BY a, what ORDER BY made, b)::INT AS place FROM f JOIN pn ON id = b QUALIFY place <= 5")
def planning_inputs(spark, d):
    return p.planning_inputs(*graph(spark, d))


@query(f"""{P}, {EXEC}, {TESTS}, {INTENT}, {CRIT}, {VERI}, {FRESH}, g AS (SELECT 'code_intent_drift' AS code, count(*) AS n FROM cin WHERE runs > 0 AND intents = 0 UNION ALL SELECT 'execution_evidence_drift', count(*) FROM exe WHERE runs = 0 OR evidence = 0
UNION ALL SELECT 'test_evidence_drift', count(*) FROM tes WHERE linked AND results = 0 AND commands = 0 UNION ALL SELECT 'acceptance_evidence_gap', count(*) FROM crit JOIN veri ON criterion = b WHERE verifiers + evidence = 0
UNION ALL SELECT CASE WHEN scanned = 0 THEN 'code_scan_missing' ELSE 'code_scan_stale' END, CASE WHEN scanned = 0 AND touched > 0 OR scanned > 0 AND changed_after > 0 THEN greatest(touched, changed_after) ELSE 0 END FROM fre) SELECT code, n::BIGINT AS n FROM g WHERE n > 0""")
def product_gate(spark, d):
    return p.gate(*graph(spark, d))


OFFERED = "SELECT 'n' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'novel' ELSE 'task' END AS kind, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN repeat('t', 200) ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN 'late' ELSE NULL END AS status FROM documents"


@query(f"WITH o AS ({OFFERED}) SELECT id, CASE WHEN kind <> 'task' THEN 'kind' WHEN coalesce(trim(title), '') = '' OR length(title) > 160 THEN 'title' ELSE 'status' END AS error FROM o WHERE kind <> 'task' OR coalesce(trim(title), '') = '' OR length(title) > 160 OR status IS NOT NULL")
def invalid_nodes(spark, d):
    """Nodes made of documents, of which some have an unknown kind, no title, a long one, or an unknown status."""
    docs = w.of(spark, d, OFFERED.replace("documents", "{documents}"))
    return p.invalid_nodes(docs)


@query("SELECT id, CASE WHEN kind = 'unknown' THEN 'kind' WHEN src = '' THEN 'source' ELSE 'same' END AS error FROM (SELECT l_orderkey || ':' || l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE 'uses' END AS kind, CASE WHEN l_linenumber = 2 THEN '' ELSE 'p' || l_partkey % 50 END AS src, 'p' || l_suppkey % 50 AS dst FROM lineitem) WHERE kind = 'unknown' OR src = '' OR src = dst")
def invalid_edges(spark, d):
    rows = w.of(spark, d, "SELECT l_orderkey || ':' || l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE 'uses' END AS kind, CASE WHEN l_linenumber = 2 THEN '' ELSE 'p' || l_partkey % 50 END AS src, 'p' || l_suppkey % 50 AS dst FROM {lineitem}")
    return p.invalid_edges(rows)


@query("SELECT 'p:' || l_partkey AS id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def bundle_duplicates(spark, d):
    return p.bundle_duplicates(w.of(spark, d, "SELECT 'p:' || l_partkey AS id FROM {lineitem}"))


@query(f"{P}, q AS (SELECT id AS task, 'Plan for ' || title AS prompt FROM pn WHERE kind = 'task'), k AS (SELECT 'plan:' || substr(sha1(task || ':' || prompt), 1, 12) AS id, task, sha256(prompt) AS prompt_sha256 FROM q) SELECT * FROM k WHERE id NOT IN (SELECT id FROM k WHERE task LIKE '%0')")
def accepted_plans(spark, d):
    """Plans of all tasks; those of tasks whose name ends in 0 were accepted before."""
    tasks = graph(spark, d)[0].filter("kind = 'task'")
    prompts = tasks.select(F.col("id").alias("task"), F.concat(F.lit("Plan for "), "title").alias("prompt"))
    before = p.accepted_plans(prompts.filter("task LIKE '%0'"), tasks)
    return p.accepted_plans(prompts, before)


@query(f"""{P}, n0 AS (SELECT 'question:2' AS id, 0 AS hop), n1 AS (SELECT DISTINCT b AS id, 1 AS hop FROM pa WHERE a IN (SELECT id FROM n0) AND b NOT IN (SELECT id FROM n0)), n2 AS (SELECT DISTINCT b AS id, 2 AS hop FROM pa WHERE a IN (SELECT id FROM n1) AND b NOT IN (SELECT id FROM n0 UNION SELECT id FROM n1)),
f AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2) SELECT f.id, hop, made, row_number() OVER (ORDER BY hop, made, f.id)::INT AS place FROM f JOIN pn USING (id) QUALIFY place <= 100""")
def product_trace(spark, d):
    nodes, edges = graph(spark, d)
    return p.trace(nodes, edges, nodes.filter("id = 'question:2'"))
