"""Registered queries of workspace profiles and the unified graph, with SQL oracles."""

from __future__ import annotations

from eventloom.operators import unified as o
from eventloom.plans.catalog import query
from eventloom.plans.code import case_of
from eventloom.session import kept
from eventloom.sources import workspace as w

#: Every part's file, and markers in folders of the suppliers, none of them at the top.
FILES = f"""SELECT {w.file_path('p_partkey')} AS path FROM {{part}} UNION ALL SELECT 'apps/a' || CAST(s_suppkey AS VARCHAR(19)) || CASE s_suppkey % 6 WHEN 0 THEN '/package.json' WHEN 1 THEN '/Core.csproj' WHEN 2 THEN '/deep/Cargo.toml' WHEN 3 THEN '/tsconfig.web.json' WHEN 4 THEN '/ProjectSettings/ProjectVersion.txt' ELSE '/notes.zzz' END FROM {{supplier}}"""
_MARK = "regexp_extract(path, '([^/]*)$', 1)"
_TYPE = f"coalesce(CASE WHEN ends_with(path, 'ProjectSettings/ProjectVersion.txt') THEN 'unity-app' END, {case_of(o.MARKER_FILES, f'lower({_MARK})')}, {', '.join(f'CASE WHEN regexp_matches(lower({_MARK}), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{t}{chr(39)} END' for p, t in o.MARKER_PATTERNS.items())})"
PROFILE = f"""fl AS ({w.bound(FILES)}), mh AS (SELECT * FROM (SELECT path, {_MARK} AS marker, {_TYPE} AS type, len(path) - len(replace(path, '/', '')) AS depth FROM fl) WHERE type IS NOT NULL),
et AS (SELECT {case_of(o.ENDING_TYPES, 'e')} AS type, e FROM (SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS e FROM fl)),
sg AS (SELECT type, sum(points)::BIGINT AS confidence, count(DISTINCT marker)::BIGINT AS markers FROM (SELECT type, marker, 12 + greatest(0, 6 - depth) AS points FROM mh UNION ALL SELECT type, e, 4 FROM et WHERE type IS NOT NULL) GROUP BY type),
wr AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM mh ORDER BY depth, path LIMIT 1),
sr AS (SELECT root, (row_number() OVER (ORDER BY CASE WHEN root = (SELECT root FROM wr) THEN 0 ELSE 1 END, root) - 1)::BIGINT AS place FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM mh UNION SELECT regexp_extract(path, '^([^/]+)/', 1) FROM mh UNION SELECT '.'))"""


def files(spark, d):
    return kept(w.of(spark, d, FILES), "profile_files")


@query(f"WITH {PROFILE} SELECT type, confidence, markers FROM sg")
def workspace_signals(spark, d):
    return o.type_signals(files(spark, d))


@query(f"WITH {PROFILE} SELECT type, confidence, type = (SELECT type FROM sg ORDER BY confidence DESC, type LIMIT 1) AS is_primary FROM sg UNION ALL SELECT 'mixed-polyglot', NULL, FALSE")
def workspace_types(spark, d):
    return o.detected_types(files(spark, d))


@query(f"WITH {PROFILE} SELECT root, place FROM sr")
def source_roots(spark, d):
    return o.source_roots(files(spark, d))


@query(f"WITH {PROFILE} SELECT DISTINCT s.scanner_id FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {chr(39)}{t}{chr(39)})' for s, ts in o.SCANNERS.items() for t in ts)}) s(scanner_id, type) JOIN sg USING (type)")
def active_scanners(spark, d):
    return o.active_scanners(o.detected_types(files(spark, d)))


#: Product items: files of parts, some below the suppliers' folders, symbols and communities; and their edges, of all kinds.
ITEMS = f"""SELECT 'code file/' || CAST(p_partkey AS VARCHAR(19)) AS id, CASE WHEN p_partkey % 10 = 9 THEN 'task' ELSE 'code_file' END AS kind, {w.file_path('p_partkey')} AS title, CASE WHEN p_partkey % 3 = 0 THEN 'apps/a' || CAST(p_partkey % 40 AS VARCHAR(19)) || '/src/x.ts' WHEN p_partkey % 3 = 1 THEN {w.file_path('p_partkey')} END AS path,
 CASE WHEN p_partkey % 4 > 0 THEN 'python' END AS scanner_id, CAST(NULL AS VARCHAR(99)) AS symbol_kind, CAST(NULL AS VARCHAR(99)) AS community_label, CAST(NULL AS VARCHAR(99)) AS community_path FROM {{part}}
UNION ALL SELECT 'code symbol/' || CAST(c_custkey AS VARCHAR(19)), 'code_symbol', 'S' || CAST(c_custkey AS VARCHAR(19)), 'apps/a' || CAST(c_custkey % 40 AS VARCHAR(19)) || '/deep/y.rs', NULL, CASE WHEN c_custkey % 5 = 0 THEN 'doc_section' ELSE 'class' END, NULL, NULL FROM {{customer}}
UNION ALL SELECT 'community/' || CAST(n_nationkey AS VARCHAR(19)), 'code_community', 'C', 'src', NULL, NULL, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, CASE WHEN n_nationkey % 3 = 0 THEN 'apps/a' || CAST(n_nationkey AS VARCHAR(19)) END FROM {{nation}}"""
LINKS = """SELECT 'e ' || CAST(l_orderkey AS VARCHAR(19)) || ' ' || CAST(l_linenumber AS VARCHAR(9)) || ' ' || CAST(min(l_partkey) AS VARCHAR(19)) AS id, 'code file/' || CAST(min(l_partkey) AS VARCHAR(19)) AS src, 'code symbol/' || CAST(min(l_suppkey) AS VARCHAR(19)) AS dst,
 CASE l_linenumber WHEN 1 THEN 'belongs_to' WHEN 2 THEN 'depends_on' WHEN 3 THEN 'implements' WHEN 4 THEN 'extends' WHEN 5 THEN 'uses' ELSE 'touches' END AS kind, CASE l_orderkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'inferred' WHEN 2 THEN 'ambiguous' ELSE 'imported' END AS trust,
 'label' AS label, CASE WHEN l_orderkey % 2 = 0 THEN 'doc_code_ref' END AS relation, CAST(NULL AS VARCHAR(99)) AS scanner_id FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
SID = lambda prefix, raw: f"('{prefix}:' || regexp_replace({raw}, '[^A-Za-z0-9._:-]+', '-', 'g'))"
UNIFIED = f"""{PROFILE}, it AS ({w.bound(ITEMS)}), lk AS ({w.bound(LINKS)}), un AS (SELECT {SID('node', 'id')} AS id, CASE kind WHEN 'code_community' THEN 'community' WHEN 'code_symbol' THEN CASE WHEN symbol_kind = 'doc_section' THEN 'doc_section' ELSE 'symbol' END
 ELSE CASE WHEN regexp_matches(lower(title), '(^|\\.)(md|rst|txt)$') THEN 'doc_file' WHEN regexp_matches(lower(title), '(^|\\.)(json|yaml|yml|toml|csproj|sln|props|targets)$') THEN 'config_file' ELSE 'code_file' END END AS kind, coalesce(community_label, title) AS label,
 coalesce(CASE WHEN kind = 'code_community' THEN community_path END, path, title) AS path, coalesce(scanner_id, 'typescript') AS scanner_id, id AS product_id FROM it WHERE kind IN ('code_file', 'code_symbol', 'code_community'))"""


def unified(spark, d):
    roots = kept(o.source_roots(files(spark, d)), "roots")
    return o.unified_graph(kept(w.of(spark, d, ITEMS), "items"), w.of(spark, d, LINKS), roots, "/work/my repo", "typescript", "node")


@query(f"""WITH {UNIFIED} SELECT id, kind, label, path, scanner_id, product_id FROM un UNION ALL SELECT {SID('workspace', "'/work/my repo'")}, 'workspace', 'workspace', '.', NULL, NULL
 UNION ALL SELECT {SID('project', 'root')}, CASE WHEN root = '.' THEN 'project' ELSE 'package' END, CASE WHEN root = '.' THEN 'workspace-root' ELSE root END, root, 'typescript', NULL FROM sr""")
def unified_nodes(spark, d):
    return unified(spark, d)[0]


@query(f"""WITH {UNIFIED}, hm AS (SELECT un.id, scanner_id, arg_min(root, place) AS root FROM un JOIN sr ON root = '.' OR path = root OR starts_with(path, root || '/') GROUP BY ALL)
SELECT {SID('edge', "id || '->' || root || '|belongs_to'")} AS id, id AS src, {SID('project', 'root')} AS dst, 'belongs_to' AS kind, 'extracted' AS provenance, scanner_id, NULL AS label, NULL AS relation FROM hm
UNION ALL SELECT {SID('edge', SID('project', 'root') + " || '->workspace|declares'")}, {SID('workspace', "'/work/my repo'")}, {SID('project', 'root')}, 'declares', 'extracted', 'kernel', NULL, NULL FROM sr
UNION ALL SELECT {SID('edge', 'id')}, {SID('node', 'src')}, {SID('node', 'dst')}, CASE WHEN kind = 'uses' AND relation = 'doc_code_ref' THEN 'documents' WHEN kind = 'extends' THEN 'inherits' WHEN kind = 'uses' THEN 'references' ELSE kind END, CASE WHEN trust IN ('manual', 'inferred', 'ambiguous') THEN trust ELSE 'extracted' END, scanner_id, label, relation FROM lk WHERE kind <> 'touches'""")
def unified_edges(spark, d):
    return unified(spark, d)[1]
