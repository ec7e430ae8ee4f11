"""A code graph and a product event log over the star-schema tables, as SQL that Spark and DuckDB both read.

Table names stand in braces: Spark binds them to DataFrames, the oracles to views.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages", "embeddings")


def pick(names: str, n: str) -> str:
    """The n-th (from 0, modulo their number) of some comma-separated names."""
    return f"split_part('{names}', ',', CAST(1 + ({n}) % {names.count(',') + 1} AS INT))"


def half(n: str, by: int = 2) -> str:
    return f"CAST(floor(({n}) / {by}) AS BIGINT)"


FOLDERS = "src/components,backend/routes,packages/core/services,tests/unit,docs/guide,infra/terraform,db/migrations,desktop/views,assets/scenes,auth/crypto,providers/openai,src/obj,scripts,vscode-extension/extension-host,packages/web/pages"
NAMES = "MainViewModel,OrderService,user-controller,program,helper,repository,startup,widget,Adapter,index,parser,readme,plan"
ENDINGS = ".ts,.tsx,.py,.go,.cs,.md,.tf,.xaml,.yaml,.sql,.rs,.test.ts,.java,.css"


def file_path(k: str) -> str:
    return f"({pick(FOLDERS, k)} || '/m' || CAST(({k}) % 97 AS VARCHAR(9)) || '/' || {pick(NAMES, k)} || CAST({k} AS VARCHAR(19)) || {pick(ENDINGS, half(k, 13))})"


def file_kind(k: str) -> str:
    ending = pick(ENDINGS, half(k, 13))
    return f"CASE WHEN {ending} IN ('.tf', '.yaml') THEN 'config_file' WHEN {ending} = '.md' THEN 'doc_file' WHEN {ending} = '.test.ts' OR {pick(FOLDERS, k)} = 'tests/unit' THEN 'test' ELSE 'code_file' END"


_SYMBOL = "'(class),(method),(interface),(function),(field),(namespace),(external),(property),(record)'".strip("'")
_CLASS = "OrderService,UserController,MainViewModel,Repository,Helper,TestRunner,PaymentAdapter,Invoice"
_SECTION = "Getting started,Architecture overview,Payment guide,Order service runbook,Release plan,How the user controller works"

#: id, kind, label, path, scanner_id, slug, parent (of a documentation section), source_file.
NODES = f"""
SELECT 'file:' || CAST(p_partkey AS VARCHAR(19)) AS id, {file_kind('p_partkey')} AS kind, {pick(NAMES, 'p_partkey')} || CAST(p_partkey AS VARCHAR(19)) || {pick(ENDINGS, half('p_partkey', 13))} AS label,
       {file_path('p_partkey')} AS path, {pick('typescript,python,go,dotnet,docs,terraform', half('p_partkey', 13))} AS scanner_id,
       CAST(NULL AS VARCHAR(99)) AS slug, CAST(NULL AS VARCHAR(99)) AS parent, CAST(NULL AS VARCHAR(99)) AS source_file FROM {{part}}
UNION ALL SELECT 'symbol:' || CAST(c_custkey AS VARCHAR(19)), 'symbol',
       {pick(_CLASS, 'c_custkey')} || CAST(c_custkey AS VARCHAR(19)) || CASE WHEN c_custkey % 9 IN (1, 3, 4, 7) THEN '.run_it ' ELSE ' ' END || {pick(_SYMBOL, 'c_custkey')},
       {file_path('c_custkey')}, {pick('typescript,python,go,dotnet,docs,terraform', half('c_custkey', 13))}, NULL, NULL, NULL FROM {{customer}}
UNION ALL SELECT 'community:' || CAST(n_nationkey AS VARCHAR(19)), 'community', {pick('Core,Docs site,Src,Payments,Tests', 'n_nationkey')} || ' ' || n_name, 'packages/' || lower(n_name), NULL, NULL, NULL, NULL FROM {{nation}}
UNION ALL SELECT 'project:' || CAST(r_regionkey AS VARCHAR(19)), 'project', CASE WHEN r_regionkey = 0 THEN 'workspace-root' ELSE lower(r_name) END, CASE WHEN r_regionkey = 0 THEN '.' ELSE 'packages/' || lower(r_name) END, NULL, NULL, NULL, NULL FROM {{region}}
UNION ALL SELECT 'workspace:root', 'workspace', 'workspace', '.', NULL, NULL, NULL, NULL FROM {{region}} WHERE r_regionkey = 0
UNION ALL SELECT 'item:' || CAST(s_suppkey AS VARCHAR(19)), {pick('route,command,asset_file,directory,package,god_node,external_dep', 's_suppkey')}, 'item ' || CAST(s_suppkey AS VARCHAR(19)) || CASE WHEN s_suppkey % 7 = 6 THEN ' (external)' ELSE '' END,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'packages/items/i' || CAST(s_suppkey AS VARCHAR(19)) END, NULL, NULL, NULL, NULL FROM {{supplier}}
UNION ALL SELECT 'section:' || CAST(doc_id AS VARCHAR(19)), 'doc_section', {pick(_SECTION, 'doc_id')} || ' ' || CAST(doc_id AS VARCHAR(19)) || ' (doc_section)', {file_path('1 + doc_id % 150')}, 'docs',
       lower(replace({pick(_SECTION, 'doc_id')}, ' ', '-')), CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'overview' END, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {file_path('1 + doc_id % 150')} END FROM {{documents}}"""

_LINE = " || ':' || ".join(f"CAST({c} AS VARCHAR(19))" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) + " || ':' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10))"
#: id, src, dst, kind, provenance, source, confidence, relation.
EDGES = f"""
SELECT 'l:' || {_LINE} AS id, 'file:' || CAST(l_partkey AS VARCHAR(19)) AS src, 'symbol:' || CAST(o_custkey AS VARCHAR(19)) AS dst,
       {pick('references,depends_on,implements,tests,related_to,build_produces,references', 'l_linenumber')} AS kind, {pick('extracted,extracted,inferred,ambiguous,manual', 'l_suppkey')} AS provenance,
       nullif({pick('typescript,roslyn,docs,,unknown,kernel', 'l_orderkey')}, '') AS source, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST((l_suppkey % 13) / 10.0 AS DOUBLE) END AS confidence,
       nullif({pick('calls,uses,constructor,,semantic_calls,tests,semantic_constructor,view_viewmodel,route_to_handler', 'l_orderkey')}, '') AS relation
FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey
UNION ALL SELECT 's:' || CAST(c_custkey AS VARCHAR(19)), 'symbol:' || CAST(c_custkey AS VARCHAR(19)), 'file:' || CAST(c_custkey AS VARCHAR(19)), 'belongs_to', 'extracted', 'typescript', CAST(0.9 AS DOUBLE), CASE WHEN c_custkey % 2 = 0 THEN 'source_file' END FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey
UNION ALL SELECT 'c:' || CAST(p_partkey AS VARCHAR(19)), 'file:' || CAST(p_partkey AS VARCHAR(19)), 'community:' || CAST(p_partkey % 25 AS VARCHAR(19)), 'belongs_to', 'inferred', 'kernel', NULL, NULL FROM {{part}} WHERE p_partkey % 10 <> 9
UNION ALL SELECT 'd:' || CAST(doc_id AS VARCHAR(19)), 'section:' || CAST(doc_id AS VARCHAR(19)), 'file:' || CAST(1 + doc_id % 150 AS VARCHAR(19)), CASE WHEN doc_id % 3 = 0 THEN 'documents' ELSE 'references' END, 'extracted', 'docs', CAST(0.9 AS DOUBLE), {pick('doc_link,doc_code_ref,doc_wikilink', 'doc_id')} FROM {{documents}}
UNION ALL SELECT 'i:' || CAST(c_custkey AS VARCHAR(19)), 'symbol:' || CAST(c_custkey AS VARCHAR(19)), 'symbol:' || CAST({half('c_custkey')} AS VARCHAR(19)), CASE WHEN c_custkey % 20 = 0 THEN 'inherits' ELSE 'implements' END, 'extracted', 'roslyn', CAST(0.9 AS DOUBLE), NULL FROM {{customer}} WHERE c_custkey % 10 = 0
UNION ALL SELECT 'f:' || CAST(a.p_partkey AS VARCHAR(19)), 'file:' || CAST(a.p_partkey AS VARCHAR(19)), 'file:' || CAST(b.p_partkey AS VARCHAR(19)), 'depends_on', {pick('extracted,inferred,manual', 'a.p_partkey')}, 'typescript', CAST(0.8 AS DOUBLE), {pick('imports,import,external_import', 'a.p_partkey')}
          FROM {{part}} a JOIN {{part}} b ON b.p_partkey = CASE WHEN a.p_partkey % 8 = 7 THEN a.p_partkey - 3 WHEN a.p_partkey % 8 = 3 THEN a.p_partkey - 2 ELSE a.p_partkey + 1 END"""


def bound(sql: str) -> str:
    """The SQL with plain table names, as the oracles take it."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables; joins of growing tables merge, since by the size of its file a table may pass for small that the driver can't hold."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if " JOIN " in sql:
        tables = {t: rows if t in ("region", "nation") else rows.hint("merge") for t, rows in tables.items()}
    return spark.sql(sql, **tables)


MANIFEST = "version string, rules string, files array<struct<path:string,size:long,hash:string>>"


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """path, size, hash and rules of a manifest in JSON; None where there is none, or of another version (SR16)."""
    try:
        rows = spark.read.schema(MANIFEST).json(path, multiLine=True).filter("version = '1'").selectExpr("rules", "inline(files)")
        return None if rows.isEmpty() else rows.select("path", "size", "hash", "rules")
    except AnalysisException:
        return None


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph in JSON with lists of these names (SR15)."""
    rows = spark.read.json(path, multiLine=True)
    return rows.selectExpr("inline(nodes)"), rows.selectExpr("inline(edges)")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, EDGES)


NODES_SQL, EDGES_SQL = f"nodes AS ({bound(NODES)})", f"edges AS ({bound(EDGES)})"
GRAPH_SQL = f"WITH {NODES_SQL}, {EDGES_SQL}"


_INTENT = "CASE c_custkey % 4 WHEN 0 THEN 'feature' WHEN 1 THEN 'user_story' WHEN 2 THEN 'requirement' ELSE 'acceptance_criterion' END"
_DAY = "CAST(CAST({0} AS DATE) AS VARCHAR(10))"
#: Events of product items: seq, kind, node_id, edge_id and the item's fields (node_kind, title, status, tests, scanned; src, dst, edge_kind, trust; made).
PRODUCT = f"""
SELECT o_orderkey * 10 AS seq, 'product.node.upserted' AS kind, 'task:' || CAST(o_orderkey AS VARCHAR(19)) AS node_id, CAST(NULL AS VARCHAR(99)) AS edge_id, 'task' AS node_kind, 'Task ' || CAST(o_orderkey AS VARCHAR(19)) AS title,
       {pick('completed,planned,in_progress,superseded', 'o_orderkey')} AS status, 0 AS tests, FALSE AS scanned, CAST(NULL AS VARCHAR(99)) AS src, CAST(NULL AS VARCHAR(99)) AS dst, CAST(NULL AS VARCHAR(99)) AS edge_kind, CAST(NULL AS VARCHAR(99)) AS trust, {_DAY.format('o_orderdate')} AS made FROM {{orders}}
UNION ALL SELECT o_orderkey * 10 + 1, 'product.node.archived', 'task:' || CAST(o_orderkey AS VARCHAR(19)), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {_DAY.format('o_orderdate')} FROM {{orders}} WHERE o_orderkey % 17 = 0
UNION ALL SELECT o_orderkey * 10 + 2, 'product.node.upserted', 'task:' || CAST(o_orderkey AS VARCHAR(19)), NULL, 'task', 'Task again ' || CAST(o_orderkey AS VARCHAR(19)), 'completed', 0, FALSE, NULL, NULL, NULL, NULL, {_DAY.format('o_orderdate')} FROM {{orders}} WHERE o_orderkey % 34 = 0
UNION ALL SELECT c_custkey * 10 + 3, 'product.node.upserted', 'intent:' || CAST(c_custkey AS VARCHAR(19)), NULL, {_INTENT}, 'Intent ' || CAST(c_custkey AS VARCHAR(19)), 'planned', 0, FALSE, NULL, NULL, NULL, NULL, '1995-01-01' FROM {{customer}}
UNION ALL SELECT s_suppkey * 10 + 4, 'product.node.upserted', 'run:' || CAST(s_suppkey AS VARCHAR(19)), NULL, {pick('agent_run,test_result,evidence', 's_suppkey')}, 'Run ' || CAST(s_suppkey AS VARCHAR(19)), 'completed', CASE WHEN s_suppkey % 12 = 2 THEN CAST(s_suppkey % 5 AS INT) ELSE 0 END, FALSE, NULL, NULL, NULL, NULL, '1996-06-01' FROM {{supplier}}
UNION ALL SELECT p_partkey * 10 + 5, 'product.node.upserted', 'code:' || CAST(p_partkey AS VARCHAR(19)), NULL, {pick('code_file,code_symbol,code_file,code_community', 'p_partkey')}, 'Code ' || CAST(p_partkey AS VARCHAR(19)), 'completed', 0, p_partkey % 2 = 0, NULL, NULL, NULL, NULL, CASE WHEN p_partkey % 2 = 0 THEN '1996-01-01' ELSE '1995-06-01' END FROM {{part}}
UNION ALL SELECT n_nationkey * 10 + 6, 'product.node.upserted', 'question:' || CAST(n_nationkey AS VARCHAR(19)), NULL, 'open_question', 'Question ' || n_name, {pick('proposed,resolved,planned,archived', 'n_nationkey')}, 0, FALSE, NULL, NULL, NULL, NULL, '1995-01-01' FROM {{nation}}
UNION ALL SELECT (l_orderkey * 8 + l_linenumber) * 10 + 7, 'product.edge.upserted', NULL, 'link:' || {_LINE}, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN l_linenumber IN (1, 3, 7) THEN 'task:' || CAST(l_orderkey AS VARCHAR(19)) WHEN l_linenumber IN (2, 5, 6) THEN 'run:' || CAST(l_suppkey AS VARCHAR(19)) ELSE 'intent:' || CAST({half('o_custkey', 4)} * 4 + 3 AS VARCHAR(19)) END,
       CASE l_linenumber WHEN 1 THEN 'run:' || CAST(l_suppkey AS VARCHAR(19)) WHEN 2 THEN 'code:' || CAST(l_partkey AS VARCHAR(19)) WHEN 3 THEN 'intent:' || CAST(o_custkey AS VARCHAR(19)) WHEN 4 THEN 'intent:' || CAST({half('o_custkey', 4)} * 4 AS VARCHAR(19))
         WHEN 5 THEN 'intent:' || CAST(o_custkey AS VARCHAR(19)) WHEN 6 THEN 'run:' || CAST(l_suppkey % 10 AS VARCHAR(19)) ELSE 'question:' || CAST(l_orderkey % 25 AS VARCHAR(19)) END,
       {pick('produced_by,touches,implements,satisfies,verifies,produced_by,blocked_by', 'l_linenumber - 1')}, {pick('extracted,inferred,ambiguous,manual', 'l_suppkey')}, {_DAY.format('l_shipdate')} FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey
UNION ALL SELECT (l_orderkey * 8 + l_linenumber) * 10 + 8, 'product.edge.archived', NULL, 'link:' || {_LINE}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {_DAY.format('l_shipdate')} FROM {{lineitem}} WHERE l_orderkey % 23 = 0"""


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, PRODUCT)


#: The visible items by SQL: pn (nodes) and pe (edges).
PRODUCT_SQL = f"""WITH pev AS ({bound(PRODUCT)}),
pn AS (SELECT node_id AS id, node_kind AS kind, title, status, tests, scanned, made FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) AS k FROM pev WHERE node_id IS NOT NULL) WHERE k = 1 AND kind = 'product.node.upserted'),
pe AS (SELECT edge_id AS id, src, dst, edge_kind AS kind, trust, made FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY seq DESC) AS k FROM pev WHERE edge_id IS NOT NULL) WHERE k = 1 AND kind = 'product.edge.upserted' AND src IN (SELECT id FROM pn) AND dst IN (SELECT id FROM pn)),
pa AS (SELECT id AS edge, src AS a, dst AS b, kind FROM pe UNION ALL SELECT id, dst, src, kind FROM pe WHERE src <> dst)"""

_NODE = "'n' || CAST(o_orderkey AS VARCHAR(19))"
_COLUMNS = ("node_kind", "title", "parent", "needs", "depth", "tools", "commands", "files", "failed_commands", "checksums", "duration_ms", "confidence", "drift", "direction", "llm_ok", "checks_ok", "successor", "person")
_TYPES = dict(zip(_COLUMNS, ("VARCHAR(99)",) * 4 + ("INT",) * 6 + ("BIGINT", "DOUBLE", "DOUBLE", "VARCHAR(99)", "BOOLEAN", "BOOLEAN", "VARCHAR(99)", "VARCHAR(99)")))


def _event(k: int, kind: str, where: str, node: bool = True, **fields: str) -> str:
    values = ", ".join(f"CAST({fields.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _TYPES.items())
    return (f"SELECT 'g' || CAST(o_custkey AS VARCHAR(19)) AS graph_id, o_orderkey * 32 + {k} AS seq, '{kind}' AS kind, {_NODE if node else 'CAST(NULL AS VARCHAR(99))'} AS node_id, "
            f"{_DAY.format('o_orderdate')} AS ts, {values} FROM {{orders}} WHERE {where}")


_PLANNED = dict(
    node_kind="CASE WHEN o_orderkey % 5 = 0 THEN 'revision' WHEN o_orderkey % 11 = 0 THEN 'replan' WHEN o_orderkey % 7 = 1 THEN 'branch' ELSE 'task' END", title="'Step ' || CAST(o_orderkey AS VARCHAR(19))",
    parent="CASE WHEN o_orderkey % 5 = 0 THEN 'n' || CAST(o_orderkey - 1 - o_orderkey % 2 AS VARCHAR(19)) END", needs="CASE WHEN o_orderkey % 3 = 0 THEN 'n' || CAST(o_orderkey + 1 AS VARCHAR(19)) || ',n' || CAST(o_orderkey + 2 AS VARCHAR(19)) ELSE '' END", depth="o_orderkey % 4")
#: Events of agent runs: a graph for each customer, a node for each order; seq orders a graph's events.
RUNS = " UNION ALL ".join([
    _event(0, "node.planned", "TRUE", **_PLANNED), _event(1, "node.executing", "o_orderkey % 7 <> 6"),
    _event(2, "node.completed", "o_orderkey % 7 < 4", tools="o_orderkey % 3", commands="o_orderkey % 4", files="o_orderkey % 5", failed_commands="CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END",
           checksums="o_orderkey % 4", duration_ms="o_orderkey * 7 % 2000", confidence="CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0 END"),
    _event(3, "node.evaluated", "o_orderkey % 7 < 4 AND o_orderkey % 5 <> 1", drift="(o_orderkey * 13 % 101) / 100.0",
           direction="CASE WHEN o_orderkey * 13 % 101 >= 82 THEN 'closer' WHEN o_orderkey * 13 % 101 >= 65 THEN 'holding' ELSE 'drifting' END", llm_ok="o_orderkey % 4 <> 0", checks_ok="o_orderkey % 3 <> 0"),
    _event(4, "node.failed", "o_orderkey % 7 = 4"), _event(5, "node.superseded", "o_orderkey % 13 = 0", successor="'n' || CAST(o_orderkey + 1 AS VARCHAR(19))"),
    _event(6, "node.planned", "o_orderkey % 29 = 0", **_PLANNED), _event(7, "node.annotated", "o_orderkey % 6 = 0", title="'Note ' || CAST(o_orderkey AS VARCHAR(19))", person="'u' || CAST(o_orderkey % 5 AS VARCHAR(9))"),
    _event(8, "run.started", "o_orderkey % 9 = 0", False), _event(9, "run.pause_requested", "o_orderkey % 17 = 0", False), _event(10, "run.paused", "o_orderkey % 19 = 0", False), _event(11, "run.stopped", "o_orderkey % 23 = 0", False),
    _event(12, "run.failed", "o_orderkey % 10 = 1", False), _event(13, "run.completed", "o_orderkey % 37 = 0", False), _event(14, "run.review_requested", "o_orderkey % 41 = 0", False),
    _event(15, "proposal.made", "o_orderkey % 4 = 1", title="'Proposal ' || CAST(o_orderkey AS VARCHAR(19))"), _event(16, "proposal.accepted", "o_orderkey % 8 = 1"), _event(17, "proposal.dismissed", "o_orderkey % 16 = 5"),
])


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, RUNS)


#: The fold by SQL: rev (events), rn (nodes), rg (graphs).
RUNS_SQL = f"""WITH rev AS ({bound(RUNS)}), lp AS (SELECT graph_id, node_id, max(seq) AS planned FROM rev WHERE kind = 'node.planned' GROUP BY ALL),
ev AS (SELECT rev.* FROM rev JOIN lp USING (graph_id, node_id) WHERE seq >= planned),
rn AS (SELECT graph_id, node_id, arg_min(node_kind, seq) AS kind, arg_min(title, seq) AS title, arg_min(parent, seq) AS parent, arg_min(needs, seq) AS needs, arg_min(depth, seq) AS depth, arg_min(ts, seq) AS created_at, min(seq) AS planned,
  coalesce(arg_max(CASE kind WHEN 'node.executing' THEN 'executing' WHEN 'node.completed' THEN 'completed' WHEN 'node.failed' THEN 'failed' WHEN 'node.superseded' THEN 'superseded' END, seq) FILTER (kind IN ('node.executing', 'node.completed', 'node.failed', 'node.superseded')), 'pending') AS status,
  max(ts) FILTER (kind = 'node.completed') AS completed_at, arg_max(tools, seq) FILTER (kind = 'node.completed') AS tools, arg_max(commands, seq) FILTER (kind = 'node.completed') AS commands, arg_max(files, seq) FILTER (kind = 'node.completed') AS files,
  arg_max(failed_commands, seq) FILTER (kind = 'node.completed') AS failed_commands, arg_max(checksums, seq) FILTER (kind = 'node.completed') AS checksums, arg_max(drift, seq) FILTER (kind = 'node.evaluated') AS drift, arg_max(direction, seq) FILTER (kind = 'node.evaluated') AS direction,
  arg_max(llm_ok, seq) FILTER (kind = 'node.evaluated') AS llm_ok, arg_max(checks_ok, seq) FILTER (kind = 'node.evaluated') AS checks_ok, arg_max(llm_ok AND checks_ok, seq) FILTER (kind = 'node.evaluated') AS passed, arg_max(successor, seq) FILTER (kind = 'node.superseded') AS superseded_by, max(ts) AS updated_at
  FROM ev GROUP BY graph_id, node_id),
rg AS (SELECT graph_id, coalesce(arg_max(CASE kind WHEN 'run.started' THEN 'running' WHEN 'run.completed' THEN 'completed' WHEN 'run.failed' THEN 'blocked' WHEN 'run.stopped' THEN 'stopped' END, seq) FILTER (kind IN ('run.started', 'run.completed', 'run.failed', 'run.stopped')), 'planned') AS status,
  max(ts) AS updated_at, max(seq) AS last_seq, count(*)::BIGINT AS events FROM rev GROUP BY graph_id)"""
