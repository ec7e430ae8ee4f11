"""Registered queries over workspace files, updates, gates and scalar functions, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import scalars as s
from eventloom.operators import reports as r
from eventloom.operators import workspace as o
from eventloom.plans.catalog import query
from eventloom.plans.code import G, RELATION, SHOWN, names
from eventloom.plans.paths import CLASS, graph
from eventloom.session import kept
from eventloom.sources import workspace as w

#: Files: those of the graph, with markers, packages, a namespace for some and a project for others; content is a document's text.
FILES = f"""SELECT 'file:' || CAST(p_partkey AS VARCHAR(19)) AS id, CASE p_partkey % 9 WHEN 0 THEN 'packages/' || {w.pick('api,web,cli', w.half('p_partkey', 9))} || '/' ELSE '' END || {w.file_path('p_partkey')} AS path,
 CASE WHEN p_partkey % 6 = 1 THEN 'Shop.' || {w.pick('Orders,Users,Core', 'p_partkey')} || '.Impl' END AS namespace, CASE WHEN p_partkey % 5 = 2 THEN {w.pick('backend,docs,Scripts', 'p_partkey')} END AS project FROM {{part}}
UNION ALL SELECT 'marker:' || CAST(s_suppkey AS VARCHAR(19)), {w.pick('infra/terraform/go.mod,desktop/app.sln,db/migrations/m3/package.json,lone-file.txt,TODO-list.md,release-plan.md', 's_suppkey')} || CASE WHEN s_suppkey >= 6 THEN CAST(s_suppkey AS VARCHAR(19)) || '/x.ts' ELSE '' END, NULL, NULL FROM {{supplier}}"""
F0 = f"fl AS ({w.bound(FILES)})"
NORM = "regexp_replace(regexp_replace(replace({0}, '\\', '/'), '^/+', ''), '^\\./', '')"
PARTS = f"list_filter(string_split({NORM.format('path')}, '/'), lambda x: x <> '')"
GEN = f"len(list_intersect(list_transform({PARTS}, lambda x: lower(x)), [{names(o.GENERATED)}])) > 0"
TESTP = f"regexp_matches('/' || lower({NORM.format('path')}) || '/', '/tests?/|\\.tests?/|/__tests__/|/spec/|\\.spec\\.|\\.test\\.')"
DOCP = "regexp_matches(lower(path), '\\.(md|rst|txt)$')"
RULES = [(".", "*.css"), (".", "/infra/"), (".", "!infra/terraform/m5/**"), ("tests/unit", "pro*"), (".", "# note"), (".", "Adapter?.ts"), (".", "assets/scenes/m*/index*")]
SEEDS = f"""rt AS (SELECT root, min(title) AS title FROM (SELECT CASE WHEN d = '' THEN '.' ELSE d END AS root, CASE WHEN d = '' THEN regexp_replace(lower(n), '\\.[^.]+$', '') ELSE regexp_extract(d, '([^/]*)$', 1) END AS title FROM (SELECT regexp_extract({NORM.format('path')}, '^(.*)/[^/]*$', 1) AS d, regexp_extract(path, '([^/]*)$', 1) AS n FROM fl WHERE regexp_matches(path, '{o.MARKER}'))) GROUP BY root),
fp AS (SELECT *, {PARTS} AS parts, (SELECT arg_max(struct_pack(root := root, title := title), CASE WHEN root = '.' THEN -1 ELSE length(root) END) FROM rt WHERE root = '.' OR starts_with({NORM.format('fl.path')}, root || '/')) AS near FROM fl),
sd AS (SELECT id, path, namespace, project, CASE WHEN {GEN} THEN struct_pack(k := 'generated/' || array_to_string(parts[1:2], '/'), t := array_to_string(parts[1:2], '/'), kd := 'generated', s := 'generated-path') WHEN near IS NOT NULL THEN struct_pack(k := near.root, t := near.title, kd := 'project', s := 'project-marker')
 WHEN parts[1] = 'packages' AND len(parts) > 1 THEN struct_pack(k := array_to_string(parts[1:2], '/'), t := array_to_string(parts[1:2], '/'), kd := 'package', s := 'package-boundary')
 WHEN namespace IS NOT NULL THEN struct_pack(k := 'ns:' || array_to_string(string_split(namespace, '.')[1:2], '.'), t := array_to_string(string_split(namespace, '.')[1:2], '.'), kd := 'namespace', s := 'namespace')
 WHEN project IS NOT NULL AND len(list_filter(parts, lambda x: contains(lower(x), lower(project)))) > 0 THEN struct_pack(k := array_to_string(parts[1:list_position(list_transform(parts, lambda x: contains(lower(x), lower(project))), TRUE)], '/'), t := project, kd := 'project', s := 'project-name')
 WHEN len(parts) > 2 AND lower(parts[1]) IN ({names(o.STRUCTURAL)}) THEN struct_pack(k := array_to_string(parts[1:2], '/'), t := parts[2], kd := 'directory', s := 'structural-directory')
 WHEN len(parts) > 1 THEN struct_pack(k := parts[1], t := parts[1], kd := 'directory', s := 'top-level-directory') ELSE struct_pack(k := '.', t := 'root', kd := 'root', s := 'workspace-root') END AS c FROM fp),
se AS (SELECT id, path, namespace, project, c.k AS key, c.t AS title, c.kd AS kind, c.s AS signal FROM sd)"""
SPLIT = f"""bg AS (SELECT key FROM se WHERE kind <> 'generated' GROUP BY key HAVING count(*) > 36), sn AS (SELECT *, key IN (SELECT key FROM bg) AND kind <> 'generated' AS big, regexp_extract(CASE WHEN key <> '.' AND starts_with({NORM.format('path')}, key || '/') THEN {NORM.format('path')}[length(key) + 2:] ELSE {NORM.format('path')} END, '^/*([^/]*)', 1) AS sub FROM se),
sk AS (SELECT id, path, namespace, project, CASE WHEN NOT big OR sub = '' THEN key WHEN key = '.' THEN sub ELSE key || '/' || sub END AS key, CASE WHEN big AND kind <> 'namespace' THEN 'directory' ELSE kind END AS kind, CASE WHEN big THEN signal || '+split' ELSE signal END AS signal, title, big FROM sn),
sf AS (SELECT *, CASE WHEN big THEN regexp_extract(key, '([^/]*)$', 1) ELSE title END AS t2 FROM sk), sy AS (SELECT key, arg_min(struct_pack(t := t2, k := kind, s := signal), path) AS x FROM sf GROUP BY key), sp AS (SELECT id, path, namespace, project, sf.key, x.t AS title, x.k AS kind, x.s AS signal FROM sf JOIN sy USING (key))"""
DEPENDS = "dp AS (SELECT src, dst FROM edges WHERE kind = 'depends_on' AND id LIKE 'f:%')"
#: The greedy pass as one fold over the tiny communities in order; an element and the state have the same fields.
MERGE = f"""sz AS (SELECT key, kind, count(*) AS n FROM sp GROUP BY ALL), tn AS (SELECT key FROM sz WHERE n < 2 AND kind <> 'generated'),
pr AS (SELECT key, regexp_extract(key, '^(.*)/[^/]*$', 1) AS target, -1 AS pref, 0 AS wt FROM tn WHERE NOT starts_with(key, 'ns:') AND NOT starts_with(key, 'generated/') AND contains(key, '/') AND regexp_extract(key, '^(.*)/[^/]*$', 1) IN (SELECT key FROM sz)),
pp AS (SELECT a.key AS a, b.key AS b, count(*) AS wt FROM dp JOIN sp a ON a.id = src JOIN sp b ON b.id = dst WHERE a.key <> b.key GROUP BY ALL), td AS (SELECT key, target, 0 AS pref, max(wt) AS wt FROM (SELECT a AS key, b AS target, wt FROM pp UNION ALL SELECT b, a, wt FROM pp) WHERE key IN (SELECT key FROM tn) GROUP BY ALL),
wi AS (SELECT key, list(target ORDER BY pref, wt DESC, target) AS c FROM (SELECT * FROM pr UNION ALL SELECT * FROM td) GROUP BY key),
sq AS (SELECT list_reduce(list(struct_pack(k := key, c := c, moved := []::VARCHAR[], tos := []::VARCHAR[]) ORDER BY key), lambda s, x: CASE WHEN len(list_filter(x.c, lambda y: NOT list_contains(s.moved, y))) = 0 THEN s
 ELSE struct_pack(k := s.k, c := s.c, moved := list_append(s.moved, x.k), tos := list_append(s.tos, list_filter(x.c, lambda y: NOT list_contains(s.moved, y))[1])) END, struct_pack(k := '', c := []::VARCHAR[], moved := []::VARCHAR[], tos := []::VARCHAR[])) AS r FROM wi),
mv AS (SELECT unnest(r.moved) AS key, unnest(r.tos) AS target FROM sq), en AS (SELECT key, tip FROM (WITH RECURSIVE z(key, tip) AS (SELECT key, target FROM mv UNION ALL SELECT z.key, mv.target FROM z JOIN mv ON mv.key = z.tip) SELECT * FROM z) WHERE tip NOT IN (SELECT key FROM mv)),
tk AS (SELECT target AS key, count(*) AS took FROM mv GROUP BY target), ft AS (SELECT key, arg_min(struct_pack(t := title, k := kind, s := signal), path) AS x FROM sp GROUP BY key),
asg AS (SELECT id, path, namespace, project, ft.key, x.t AS title, x.k AS kind, x.s || repeat('+merged', coalesce(took, 0)::INT) AS signal FROM sp LEFT JOIN en USING (key) JOIN ft ON ft.key = coalesce(en.tip, sp.key) LEFT JOIN tk ON tk.key = ft.key)"""
LOWP = f"list_transform({PARTS}, lambda x: lower(x))"
LENS = "CASE WHEN bool_or(" + DOCP + f" OR list_contains({LOWP}, 'docs')) THEN 'docs-handoff' " + " ".join(f"WHEN bool_or(len(list_intersect({LOWP}, [{names(ws)}])) > 0) THEN '{n}'" for n, ws in o.LENS_WORDS.items()) + " ELSE 'backend-runtime' END"
FINAL = f"""fa AS (SELECT key, arg_min(struct_pack(t := title, k := kind), path) AS x, count(*)::BIGINT AS files, {LENS} AS lens, bool_and({GEN}) AS g, bool_and({TESTP}) AS t, bool_and({DOCP}) AS d, (SELECT string_agg(p, ', ' ORDER BY p) FROM (SELECT z.path AS p FROM asg z WHERE z.key = asg.key ORDER BY z.path LIMIT 4)) AS top,
 (SELECT project FROM asg z WHERE z.key = asg.key AND project IS NOT NULL GROUP BY project ORDER BY count(*) DESC, project LIMIT 1) AS project FROM asg GROUP BY key),
fz AS (SELECT key, CASE WHEN g THEN 'generated/build' WHEN t THEN coalesce(project, x.t) || ' tests' WHEN d THEN coalesce(project, x.t) || ' docs' WHEN project IS NOT NULL AND x.k <> 'package' THEN project WHEN starts_with(key, 'packages/') THEN key WHEN key <> '.' AND NOT contains(x.t, '/') AND x.k <> 'namespace' THEN regexp_extract(key, '([^/]*)$', 1) ELSE x.t END AS title,
 CASE WHEN g THEN 'generated' WHEN t THEN 'tests' WHEN d THEN 'docs' WHEN project IS NOT NULL AND x.k = 'directory' THEN 'project' WHEN project IS NOT NULL AND x.k <> 'package' THEN x.k WHEN starts_with(key, 'packages/') THEN 'package' ELSE x.k END AS kind, files, lens, top FROM fa)"""


def files(spark, d):
    return w.of(spark, d, FILES)


def depends(spark, d):
    return w.edges(spark, d).filter("kind = 'depends_on' AND id LIKE 'f:%'").select("src", "dst")


def communities(spark, d):
    return kept(o.finalised(kept(o.assigned(files(spark, d), depends(spark, d)), "assigned")), "communities")


@query(f"WITH {F0}, {SEEDS} SELECT id, path, key, title, kind, signal FROM se")
def community_seeds(spark, d):
    return o.seeds(files(spark, d)).select("id", "path", "key", "title", "kind", "signal")


@query(f"WITH {F0}, {SEEDS}, {SPLIT} SELECT id, key, title, kind, signal FROM sp")
def community_splits(spark, d):
    return o.split_large(o.seeds(files(spark, d))).select("id", "key", "title", "kind", "signal")


@query(f"WITH {w.EDGES_SQL}, {F0}, {SEEDS}, {SPLIT}, {DEPENDS}, {MERGE} SELECT id, key, title, kind, signal FROM asg")
def community_assignments(spark, d):
    return o.assigned(files(spark, d), depends(spark, d)).select("id", "key", "title", "kind", "signal")


@query(f"WITH {w.EDGES_SQL}, {F0}, {SEEDS}, {SPLIT}, {DEPENDS}, {MERGE}, {FINAL} SELECT *, title || ' (' || kind || ', ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END || '). Start with ' || array_to_string(string_split(top, ', ')[1:2], ', ') || '. Lens: ' || lens || '.' AS summary FROM fz")
def community_list(spark, d):
    return communities(spark, d)


@query(f"WITH {w.EDGES_SQL}, {F0}, {SEEDS}, {SPLIT}, {DEPENDS}, {MERGE}, {FINAL} SELECT key, title, files FROM fz ORDER BY files DESC, title, key LIMIT 12")
def largest_communities(spark, d):
    return o.community_top(communities(spark, d))


GENERIC = f"(lower(trim(title)) IN ({names(o.GENERIC)}, '', 'generated/build'))"


@query(f"""WITH {w.EDGES_SQL}, {F0}, {SEEDS}, {SPLIT}, {DEPENDS}, {MERGE}, {FINAL}, q AS (SELECT count(*)::BIGINT AS communities, count(*) FILTER (NOT {GENERIC} AND kind <> 'generated')::BIGINT AS meaningful, count(*) FILTER ({GENERIC})::BIGINT AS generic, coalesce(sum(files) FILTER (kind = 'generated'), 0) / sum(files) AS sh, sum(files) AS f FROM fz)
SELECT communities, meaningful, generic, round(sh, 6)::DOUBLE AS generated_share, array_to_string(list_filter([CASE WHEN sh > 0.5 THEN 'generated_dominates' END, CASE WHEN f >= 20 AND meaningful < 2 THEN 'too_few_meaningful' END, CASE WHEN f >= 20 AND communities >= 2 AND generic = communities THEN 'all_generic' END], lambda x: x IS NOT NULL), ',') AS fails FROM q""")
def community_gates(spark, d):
    return o.community_gates(communities(spark, d))


@query(f"{G} SELECT id, lower(trim(label)) IN ({names(o.GENERIC)}, '', 'generated/build') AS generic FROM nodes")
def generic_labels(spark, d):
    return w.nodes(spark, d).select("id", o.is_generic(F.col("label")).alias("generic"))


HOME = f"""dc AS (SELECT src AS id, max(dst) AS community FROM edges WHERE kind = 'belongs_to' AND dst IN (SELECT id FROM nodes WHERE kind = 'community') GROUP BY src),
pf AS (SELECT src AS id, max(dst) AS file FROM edges WHERE kind = 'belongs_to' AND dst IN (SELECT id FROM nodes WHERE kind IN ('code_file', 'config_file', 'doc_file')) GROUP BY src), pt AS (SELECT {NORM.format('path')} AS p, max(id) AS file FROM nodes WHERE kind IN ('code_file', 'config_file', 'doc_file') AND path IS NOT NULL GROUP BY 1),
hm AS (SELECT * FROM (SELECT n.id, CASE WHEN n.kind = 'community' THEN n.id ELSE coalesce(a.community, b.community, CASE WHEN n.kind IN ('symbol', 'test', 'doc_section') THEN c.community END) END AS community FROM nodes n LEFT JOIN dc a USING (id) LEFT JOIN pf ON pf.id = n.id LEFT JOIN dc b ON b.id = pf.file LEFT JOIN pt ON pt.p = {NORM.format('n.path')} LEFT JOIN dc c ON c.id = pt.file) WHERE community IS NOT NULL)"""


@query(f"{G}, {HOME} SELECT * FROM hm")
def node_communities(spark, d):
    return o.node_communities(*graph(spark, d))


@query(f"{G}, {HOME}, x AS (SELECT a.community AS a, b.community AS b, e.kind AS edge_kind, count(*)::BIGINT AS n FROM edges e JOIN hm a ON a.id = src JOIN hm b ON b.id = dst WHERE a.community <> b.community GROUP BY ALL), y AS (SELECT a AS community, 'out' AS way, edge_kind, b AS other, n FROM x UNION ALL SELECT b, 'in', edge_kind, a, n FROM x) SELECT *, row_number() OVER (PARTITION BY community, way ORDER BY n DESC, edge_kind, other)::INT AS place FROM y QUALIFY place <= 3")
def community_relations(spark, d):
    return o.community_relations(*graph(spark, d))


@query(f"{G}, {HOME}, x AS (SELECT DISTINCT e.id, community FROM edges e JOIN hm ON hm.id IN (src, dst)), r AS (SELECT e.*, {RELATION} AS r FROM edges e) SELECT community, count(*)::BIGINT AS edges, count(*) FILTER (provenance = 'extracted')::BIGINT AS extracted, count(*) FILTER (provenance = 'inferred')::BIGINT AS inferred, count(*) FILTER (provenance = 'ambiguous')::BIGINT AS ambiguous, count(*) FILTER (provenance = 'manual')::BIGINT AS manual, count(*) FILTER (kind = 'depends_on')::BIGINT AS dependencies, count(*) FILTER (({CLASS}) = 'semantic')::BIGINT AS semantic, count(*) FILTER (dst IN (SELECT id FROM nodes WHERE kind = 'external_dep'))::BIGINT AS outside FROM x JOIN r USING (id) GROUP BY community")
def community_mix(spark, d):
    nodes, edges = w.nodes(spark, d).select("id", "kind", "path"), w.edges(spark, d).select("src", "dst", "kind", "provenance", "relation")
    return o.community_mix(kept(nodes, "mix_nodes"), kept(edges, "mix_edges"))


@query(f"{G}, dg AS (SELECT id, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT id, label, degree FROM dg JOIN nodes USING (id) WHERE kind = 'community' AND degree >= 12")
def hub_warnings(spark, d):
    return o.hub_warnings(*graph(spark, d))


@query(f"{G}, r AS (SELECT e.*, {RELATION} AS r FROM edges e), q AS (SELECT id, path, (SELECT count(*) FROM edges WHERE kind = 'depends_on' AND src = n.id)::BIGINT AS imports, (SELECT count(*) FROM edges WHERE kind = 'depends_on' AND dst = n.id)::BIGINT AS imported_by, (SELECT count(*) FROM (SELECT src AS i FROM r WHERE kind <> 'depends_on' AND ({CLASS}) = 'semantic' UNION ALL SELECT dst FROM r WHERE kind <> 'depends_on' AND ({CLASS}) = 'semantic') WHERE i = n.id)::BIGINT AS semantic FROM nodes n WHERE kind = 'code_file') SELECT *, imports + imported_by + semantic AS score FROM q WHERE imports + imported_by + semantic > 0 ORDER BY score DESC, imported_by DESC, path, id LIMIT 5")
def dependency_hotspots(spark, d):
    return o.hotspots(*graph(spark, d))


@query(f"{G} SELECT CASE WHEN contains({SHOWN}, '/') THEN split_part({SHOWN}, '/', 1) ELSE '.' END AS part, count(*) FILTER (kind = 'code_file')::BIGINT AS files, count(*) FILTER (kind = 'symbol')::BIGINT AS symbols FROM nodes WHERE kind IN ('code_file', 'symbol') GROUP BY part ORDER BY files + symbols DESC, part LIMIT 8")
def path_groups(spark, d):
    return o.path_groups(w.nodes(spark, d))


FOLDERS = f"fo AS (SELECT DISTINCT array_to_string(pa[1:k], '/') AS path FROM (SELECT {PARTS} AS pa FROM fl), unnest(range(1, 8)) t(k) WHERE k < len(pa))"


@query(f"WITH {F0}, {FOLDERS}, x AS (SELECT path FROM fo UNION ALL SELECT {NORM.format('path')} FROM fl) SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, path AS item FROM x")
def folder_edges(spark, d):
    return o.folders(files(spark, d))[1]


@query(f"WITH {F0} SELECT lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS extension, count(*)::BIGINT AS n, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.md', '.rst', '.txt') AS docs FROM fl GROUP BY ALL")
def extension_counts(spark, d):
    return o.extension_counts(files(spark, d))


SIGNALS = {"node": (r"package\.json$", 5, r"\.tsx?$", 1), "go": (r"go\.mod$", 5, r"\.go$", 1), "dotnet": (r"\.sln$", 4, r"\.cs$", 1), "php": (r"composer\.json$", 5, r"\.php$", 1)}


@query(f"WITH {F0}, x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS type, (count(*) FILTER (regexp_matches(path, '{m}')) * {a} + least(count(*) FILTER (regexp_matches(path, '{e}')), 10) * {b})::BIGINT AS score FROM fl" for n, (m, a, e, b) in SIGNALS.items()) + ") SELECT * FROM x WHERE score > 0")
def type_signals(spark, d):
    return o.type_signals(files(spark, d), SIGNALS)


RULE_HITS = ", ".join(f"CASE WHEN {'TRUE' if sc == '.' else f'starts_with(path, {chr(39)}{sc}/{chr(39)})'} AND regexp_matches({'path' if sc == '.' else f'path[{len(sc) + 2}:]'}, '{o.rule_pattern(line)[0]}') THEN {2 * i + o.rule_pattern(line)[1]} END" for i, (sc, line) in enumerate(RULES) if o.rule_pattern(line))


@query(f"WITH {F0}, h AS (SELECT id, path, list_max(list_filter([{RULE_HITS}], lambda x: x IS NOT NULL)) AS hit, len(list_intersect({PARTS}[1:-2], [{names(o.SKIPPED)}])) > 0 AS always FROM fl) SELECT id, CASE WHEN always THEN 'global' WHEN hit % 2 = 0 THEN 'rule' END AS reason FROM h")
def ignored_files(spark, d):
    return o.ignored(files(spark, d), RULES).select("id", "reason")


SNAPSHOT = f"SELECT {{path}} AS path, CASE WHEN doc_id % 40 = 7 AND {{new}} THEN text || '!' ELSE text END AS content FROM {{documents}} WHERE doc_id % 41 <> {{gone}}"


def snapshot(spark, d, new: bool):
    sql = SNAPSHOT.replace("{path}", w.file_path("doc_id")).replace("{new}", str(new).upper()).replace("{gone}", "3" if new else "5")
    return w.of(spark, d, sql)


SNAP = {n: w.bound(SNAPSHOT.replace("{path}", w.file_path("doc_id")).replace("{new}", str(n).upper()).replace("{gone}", "3" if n else "5")) for n in (True, False)}


@query(f"WITH sn AS ({SNAP[True]}) SELECT path, octet_length(encode(content))::INT AS size, sha256(content) AS hash, sha256('{chr(10).join(f'{a}{chr(9)}{b}' for a, b in RULES)}') AS rules FROM sn")
def file_manifest(spark, d):
    return o.manifest(snapshot(spark, d, True), RULES)


CHANGES = f"ch AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN md5(a.content) <> md5(b.content) THEN 'changed' ELSE 'unchanged' END AS change FROM ({SNAP[False]}) a FULL JOIN ({SNAP[True]}) b ON a.path = b.path)"


def diff(spark, d):
    return o.changes(o.manifest(snapshot(spark, d, False), RULES), o.manifest(snapshot(spark, d, True), RULES))


@query(f"WITH {CHANGES} SELECT * FROM ch")
def manifest_changes(spark, d):
    return diff(spark, d)


@query(f"{G} SELECT id, regexp_matches({NORM.format(SHOWN)}, '{o.STRUCTURAL_FILES}') AS structural, regexp_matches({NORM.format(SHOWN)}, '{o.BEARING}') AS bearing FROM nodes")
def path_predicates(spark, d):
    from eventloom.operators.code import shown

    return w.nodes(spark, d).select("id", o.is_structural(shown()).alias("structural"), o.bears_dependencies(shown()).alias("bearing"))


TOUCHED = f"tc AS (SELECT path FROM nodes WHERE id IN ('file:1', 'file:2', 'file:14'))"
NEIGHBOURS = f"own AS (SELECT id, {NORM.format(SHOWN)} AS path FROM nodes WHERE kind IN ('code_file', 'config_file', 'doc_file', 'test', 'symbol')), ht AS (SELECT id FROM own WHERE path IN (SELECT path FROM tc)), nb AS (SELECT DISTINCT path FROM own WHERE id IN (SELECT dst FROM edges WHERE src IN (SELECT id FROM ht) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM ht)) AND id NOT IN (SELECT id FROM ht) AND regexp_matches(path, '{o.BEARING}') AND path NOT IN (SELECT path FROM tc))"


def touched(nodes):
    return nodes.filter("id IN ('file:1', 'file:2', 'file:14')").select("path")


@query(f"{G}, {TOUCHED}, {NEIGHBOURS} SELECT path FROM nb")
def neighbour_paths(spark, d):
    n, e = graph(spark, d)
    return o.neighbour_paths(n, e, touched(n))


@query(f"{G}, {CHANGES}, k AS (SELECT count(*) FILTER (change <> 'unchanged') AS t, count(*) FILTER (change <> 'added') AS n, count(*) FILTER (change <> 'unchanged' AND regexp_matches(path, '{o.STRUCTURAL_FILES}')) AS s FROM ch) SELECT CASE WHEN t = 0 THEN 'noop' WHEN t > 20 OR t / n > 0.15 OR s > 0 THEN 'full' ELSE 'incremental' END AS mode FROM k")
def update_plan(spark, d):
    """The mode of an update between two snapshots of all documents as files, without neighbours in the graph."""
    changes = kept(diff(spark, d), "changes")
    mode, _ = o.plan(changes, changes.filter("path IS NULL").select("path"))
    return spark.createDataFrame([(mode,)], "mode string")


STRIPPED = f"gn AS (SELECT id FROM nodes, tc WHERE kind IN ('code_file', 'config_file', 'doc_file', 'symbol', 'test') AND ({NORM.format(SHOWN.replace('path', 'nodes.path'))} = tc.path OR starts_with({NORM.format(SHOWN.replace('path', 'nodes.path'))}, tc.path || '/') OR (kind = 'symbol' AND contains({NORM.format(SHOWN.replace('path', 'nodes.path'))}, tc.path)))), ln AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gn)), le AS (SELECT * FROM edges WHERE src IN (SELECT id FROM ln) AND dst IN (SELECT id FROM ln))"


@query(f"{G}, {TOUCHED}, {STRIPPED} SELECT id FROM le")
def stripped_edges(spark, d):
    n, e = graph(spark, d)
    return o.stripped(n, e, touched(n))[1].select("id")


@query(f"{G}, {TOUCHED}, {STRIPPED}, pn AS (SELECT * REPLACE (label || ' (new)' AS label) FROM nodes WHERE id LIKE 'file:%' OR kind IN ('workspace', 'project')), px AS (SELECT * FROM pn WHERE kind NOT IN ('workspace', 'project', 'package')) SELECT id, label FROM ln WHERE id NOT IN (SELECT id FROM px) UNION ALL SELECT id, label FROM px")
def merged_graph(spark, d):
    """The graph with three files' paths taken out and all files scanned anew, under new labels."""
    n, e = graph(spark, d)
    part = n.filter("id LIKE 'file:%' OR kind IN ('workspace', 'project')").withColumn("label", F.concat("label", F.lit(" (new)")))
    return o.updated(n, e, part, e.filter("id LIKE 'f:%'"), touched(n))[0].select("id", "label")


GATES = f"{G}, fi AS (SELECT * FROM nodes WHERE kind IN ('code_file', 'config_file', 'doc_file', 'test')), k AS (SELECT count(*) AS n, count(*) FILTER ({GEN}) AS g FROM fi) SELECT 'unsupported_language_risk' AS code, 'warn' AS severity, 4::BIGINT AS n UNION ALL SELECT 'partial_scan_breaker', 'warn', 2 UNION ALL SELECT 'generated_path_dominance', 'fail', g FROM k WHERE g * 100 / n > 40.5"


@query(GATES)
def quality_gates(spark, d):
    markers = files(spark, d).filter(F.col("path").rlike(o.MARKER))
    return o.quality_gates(w.nodes(spark, d), markers, {"breaker": 2, "unsupported": 4})


NOISE = f"nz AS (SELECT DISTINCT 'generated_artifact' AS kind, path, CASE WHEN contains(path, 'node_modules') THEN 'high' ELSE 'medium' END AS severity FROM fl WHERE {GEN} UNION SELECT 'large_file', path, 'medium' FROM fl WHERE length(id) * 20000 >= 200000 UNION SELECT 'stale_plan', path, 'low' FROM fl WHERE NOT contains(path, '/') AND regexp_matches(path, '(?i)^[^/]*plan[^/]*\\.md$') UNION SELECT 'root_clutter', path, 'low' FROM fl WHERE NOT contains(path, '/') AND regexp_matches(path, '(?i)^(REPORT|NOTES|TODO|SCRATCH|OLD)-'))"


def noise(spark, d):
    return o.noise(files(spark, d).withColumn("size", F.length("id") * 20000), 2)


@query(f"WITH {F0}, {NOISE} SELECT * FROM nz")
def context_noise(spark, d):
    return noise(spark, d)[0]


@query(f"WITH {F0}, {NOISE} SELECT count(*)::BIGINT AS items, greatest(0, least(100, 80 - sum(CASE severity WHEN 'low' THEN 4 WHEN 'medium' THEN 10 ELSE 18 END)))::BIGINT AS score FROM nz")
def context_noise_score(spark, d):
    return noise(spark, d)[1]


@query(f"{G} SELECT x AS missing FROM unnest(['typescript', 'python', 'ruby', 'docs', 'php']) t(x) WHERE x NOT IN (SELECT scanner_id FROM nodes WHERE scanner_id IS NOT NULL)")
def missing_scanners(spark, d):
    return o.missing(["typescript", "python", "ruby", "docs", "php"], w.nodes(spark, d), "scanner_id")


# --- scalar functions --------------------------------------------------------------------------------------------------

_K = "CAST(l_orderkey AS VARCHAR(19))"
#: Lines of log text with tokens, secrets, paths and imports.
SAID = f"""SELECT {_K} || ':' || CAST(l_linenumber AS VARCHAR(9)) AS id, CASE l_linenumber
WHEN 1 THEN 'sent Authorization: Bearer abc.DEF-' || {_K} || '== to  host' WHEN 2 THEN 'API_KEY = k' || {_K} || ', user_token:' || {_K} WHEN 3 THEN 'key sk_live' || {_K} || 'abcdefghij end' WHEN 4 THEN 'open /home/me' || {_K} || '/work/src/a' || {_K} || '.ts failed'
WHEN 5 THEN 'see /tmp/run/x' || {_K} || '/out.log now' WHEN 6 THEN 'import x from "./m' || {_K} || '"; const y = require("fs"); export * from "../z"; import("lazy")' ELSE 'plain   text ' || {_K} || ' of line' END AS text FROM {{lineitem}}"""


@query(f"WITH x AS ({w.bound(SAID)}) SELECT DISTINCT id, text, CASE WHEN text LIKE 'sent%' THEN 'sent Authorization: Bearer <redacted-token> to host' WHEN text LIKE 'API_KEY%' THEN 'API_KEY=<redacted-secret>, user_token=<redacted-secret>' WHEN text LIKE 'key sk%' THEN 'key <redacted-secret> end' WHEN text LIKE 'open%' THEN 'open <home>/src/a' || split_part(id, ':', 1) || '.ts failed' WHEN text LIKE 'see%' THEN 'see <temp>/x' || split_part(id, ':', 1) || '/out.log now' WHEN text LIKE 'plain%' THEN 'plain text ' || split_part(id, ':', 1) || ' of line' ELSE text END AS redacted FROM x")
def redacted_text(spark, d):
    return w.of(spark, d, SAID).select("id", "text", s.redacted(F.col("text")).alias("redacted")).distinct()


@query(f"WITH x AS ({w.bound(SAID)}) SELECT DISTINCT id, './m' || split_part(id, ':', 1) || ',fs,../z,lazy' AS found FROM x WHERE text LIKE 'import%'")
def module_imports(spark, d):
    """Imports in lines that hold some; the order is by kind: import, export, dynamic, require."""
    rows = w.of(spark, d, SAID).filter("text LIKE 'import%'")
    found = s.imports(F.col("text"))
    return rows.select("id", F.concat_ws(",", found[0], found[3], found[1], found[2]).alias("found")).distinct()


@query(f"{G} SELECT id, {NORM.format(SHOWN)} AS normal, lower(regexp_extract(replace({SHOWN}, '\\', '/'), '([^/]*)/*$', 1)) AS base, lower(regexp_extract({SHOWN}, '(\\.[^./]*)$', 1)) AS ending, trim(regexp_replace(lower(regexp_extract(trim(regexp_extract(label, '^([^(]*)', 1)), '([^.]*)$', 1)), '[^a-z0-9]+', ' ', 'g')) AS class, CASE WHEN contains(lower(label), '(namespace)') THEN trim(regexp_replace(lower(regexp_extract(label, '^([^(]*)', 1)), '[^a-z0-9]+', ' ', 'g')) END AS tail, CASE WHEN starts_with({SHOWN}, '/') THEN regexp_extract({SHOWN}, '([^/]*)$', 1) ELSE {SHOWN} END AS evidence FROM nodes")
def path_functions(spark, d):
    from eventloom.operators.code import shown

    return w.nodes(spark, d).select(
        "id", o.normal(shown()).alias("normal"), s.base_name(shown()).alias("base"), o.ending(shown()).alias("ending"), s.class_name(F.col("label")).alias("class"), s.namespace_tail(F.col("label")).alias("tail"), s.evidence_path(shown()).alias("evidence"))


@query(f"{G}, r AS (SELECT id, 'g:' || CASE WHEN length(id) % 3 = 0 THEN 'path:a:' WHEN length(id) % 3 = 1 THEN 'node:' ELSE 'odd:' END || id AS rid FROM nodes) SELECT id, CASE WHEN rid LIKE 'g:path:%' THEN 'path' WHEN rid LIKE 'g:node:%' THEN 'node' END AS kind, CASE WHEN rid LIKE 'g:path:%' THEN 'a' WHEN rid LIKE 'g:node:%' THEN id END AS first, CASE WHEN rid LIKE 'g:path:%' THEN id END AS second FROM r")
def retrieval_ids(spark, d):
    n = w.nodes(spark, d)
    kind = F.when(F.length("id") % 3 == 0, "path").when(F.length("id") % 3 == 1, "node").otherwise("odd")
    rid = F.when(kind == "path", s.retrieval_id("g", kind, F.lit("a"), F.col("id"))).otherwise(s.retrieval_id("g", kind, F.col("id")))
    a, b, c = s.retrieval_parts("g", rid)
    return n.select("id", a.alias("kind"), b.alias("first"), c.alias("second"))


@query("""SELECT o_orderkey, floor((epoch_ms(TIMESTAMP '2000-01-01') - epoch_ms(o_orderdate)) / 86400000.0)::BIGINT AS age, CASE WHEN o_orderkey % 5 = 0 THEN TRUE WHEN o_orderkey % 5 = 1 THEN FALSE ELSE o_orderdate::DATE < DATE '1997-01-01' END AS stale, (epoch_us(o_orderdate) * 1000)::VARCHAR AS nanos,
least(100, greatest(0, floor(o_totalprice / 1000 - 50 + 0.5)))::BIGINT AS clamped, CASE WHEN o_orderkey >= 1000 THEN 'hit' WHEN o_orderkey >= 850 THEN 'near' ELSE 'ok' END AS breaker, round(o_orderkey / 2.0, 2)::DOUBLE AS speed, CASE WHEN o_orderkey > 0 THEN floor(greatest(5000 - o_orderkey, 0) / (o_orderkey / 2.0) * 1000 + 0.5) ELSE -1 END::BIGINT AS eta FROM orders""")
def time_and_number_functions(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet")
    made = F.when(F.col("o_orderkey") % 5 == 1, "not a time").when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    rates = s.scan_rates(F.col("o_orderkey"), F.lit(1), F.lit(2.0), F.lit(5000))
    return t.select(
        "o_orderkey", s.age_days(F.lit("2000-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("age"), s.is_stale(made, F.lit("1997-01-01")).alias("stale"), s.unix_nanos(F.col("o_orderdate").cast("timestamp")).alias("nanos"),
        s.clamped(F.col("o_totalprice") / 1000 - 50).alias("clamped"), s.breaker(F.col("o_orderkey"), F.lit(1000)).alias("breaker"), rates["files"].alias("speed"), F.coalesce(rates["eta_ms"], F.lit(-1)).alias("eta"))


@query("""WITH a AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS ws, p_name, p_type FROM part) SELECT p_partkey, array_to_string(ws, ', ')[:480] AS listed, CASE WHEN length(p_name || '   ' || p_type) - 2 > 20 THEN rtrim((p_name || ' ' || p_type)[:17]) || '...' ELSE p_name || ' ' || p_type END AS bounded,
CASE WHEN p_partkey % 2 = 0 THEN 'name,size' ELSE 'name' END AS keys, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 0 END::DOUBLE AS number, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'forbidden_key' ELSE '' END AS forbidden FROM a""")
def list_map_and_json_functions(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    m = s.compact(F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string"))))
    json = F.to_json(F.create_map(F.when(F.col("p_partkey") % 3 == 0, "userPassword").otherwise("user"), F.col("p_name")))
    return t.select(
        "p_partkey", s.listed(F.split("p_name", " ")).alias("listed"), s.bounded(F.concat("p_name", F.lit("   "), "p_type"), 20).alias("bounded"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), s.number_of(m, "size").alias("number"),
        s.text_of(s.sanitised(m), "name").alias("name"), F.array_join(s.forbidden(json), ",").alias("forbidden"))


SIDE = lambda key, label, name: f"{name} AS (SELECT key, list(struct_pack(o := -n, label := label, kind := 'depends_on') ORDER BY n DESC, label) AS r FROM (SELECT {key} AS key, {label} AS label, sum(n)::BIGINT AS n FROM hn GROUP BY {key}, {label} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY sum(n) DESC, {label}) <= 3) GROUP BY key)"
BOTH = "list_concat(s.{0}, x.{0})"
ADDED = lambda f: f"""list_filter(list_transform(list_distinct(list_transform({BOTH.format(f)}, lambda y: struct_pack(label := y.label, kind := y.kind))), lambda k: struct_pack(o := coalesce(list_sum(list_transform(list_filter({BOTH.format(f)}, lambda y: y.label = k.label AND y.kind = k.kind), lambda y: y.o)), 0)::BIGINT, label := k.label, kind := k.kind)), lambda y: y.label <> x.label)"""
COUNT = lambda r: f"(-coalesce(list_sum(list_transform({r}, lambda y: y.o)), 0))::BIGINT"
#: Relations as o (the count, negative, so that lists sort by it), label and kind; the fold's elements and state have the same fields.
HUBS = f"""hc AS (SELECT key AS id, min(title) AS label, min(kind) AS kind, count(*)::BIGINT AS files, list(path ORDER BY path)[1:6] AS top FROM asg GROUP BY key),
hn AS (SELECT a.key AS a, a.title AS at_, b.key AS b, b.title AS bt, count(*) AS n FROM dp JOIN asg a ON a.id = src JOIN asg b ON b.id = dst WHERE a.key <> b.key GROUP BY ALL), {SIDE('b', 'at_', 'hi')}, {SIDE('a', 'bt', 'ho')},
hu AS (SELECT hc.*, files < 5 AND (kind IN ('directory', 'root') OR {GENERIC.replace('title', 'label')}) AS thin, coalesce(hi.r, []) AS inc, coalesce(ho.r, []) AS outg, row_number() OVER (ORDER BY files DESC, label, id) AS place FROM hc LEFT JOIN hi ON hi.key = id LEFT JOIN ho ON ho.key = id),
hp AS (SELECT id, CASE WHEN contains(trim(id, '/'), '/') THEN regexp_extract(id, '^(.*)/[^/]*$', 1) ELSE '.' END AS up FROM hu WHERE thin),
ht AS (SELECT t.id, coalesce((SELECT arg_min(h.id, h.place) FROM hu h JOIN hp ON hp.id = t.id WHERE NOT h.thin AND (h.id = up OR h.label = regexp_extract(up, '([^/]*)$', 1))),
 (SELECT arg_min(tid, struct_pack(o := o, p := p)) FROM (SELECT (SELECT arg_min(h.id, h.place) FROM hu h WHERE NOT h.thin AND h.label = r.label) AS tid, r.o, p FROM (SELECT unnest(list_concat(t.inc, t.outg)) AS r, generate_subscripts(list_concat(t.inc, t.outg), 1) AS p)) WHERE tid IS NOT NULL)) AS target FROM hu t WHERE thin),
hs AS (SELECT target, list(struct_pack(files := files, top := top, inc := inc, outg := outg, degree := 0::BIGINT, merged := []::VARCHAR[], label := label) ORDER BY place) AS src FROM ht JOIN hu USING (id) WHERE target IS NOT NULL GROUP BY target),
hx AS (SELECT id, label AS lb, list_reduce(coalesce(src, []), lambda s, x: struct_pack(files := s.files + x.files, top := list_concat(s.top, list_filter(x.top, lambda y: NOT list_contains(s.top, y)))[1:6], inc := list_sort({ADDED('inc')})[1:3], outg := list_sort({ADDED('outg')})[1:3],
 degree := {COUNT(ADDED('inc'))} + {COUNT(ADDED('outg'))}, merged := list_append(s.merged, x.label), label := s.label), struct_pack(files := files, top := top, inc := inc, outg := outg, degree := {COUNT('inc')} + {COUNT('outg')}, merged := []::VARCHAR[], label := label)) AS x
 FROM hu LEFT JOIN hs ON target = id WHERE id NOT IN (SELECT id FROM ht WHERE target IS NOT NULL))"""
TOLD = "array_to_string(list_transform(x.{0}, lambda y: y.label || ':' || (-y.o)), ',')"


@query(f"WITH {w.EDGES_SQL}, {F0}, {SEEDS}, {SPLIT}, {DEPENDS}, {MERGE}, {HUBS} SELECT id, lb AS label, x.files AS files, array_to_string(x.top, ',') AS top_files, {TOLD.format('inc')} AS incoming, {TOLD.format('outg')} AS outgoing, x.degree AS degree, array_to_string(x.merged, ',') AS merged FROM hx")
def merged_hubs(spark, d):
    hubs = kept(o.hubs_of(kept(o.assigned(files(spark, d), depends(spark, d)), "assigned"), depends(spark, d), 5), "hubs")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["label"], x["n"].cast("string"))), ",").alias(c)
    return o.merged_hubs(hubs).select("id", "label", "files", F.array_join("top_files", ",").alias("top_files"), told("incoming"), told("outgoing"), "degree", F.array_join("merged", ",").alias("merged"))



@query(f"{GATES} UNION ALL SELECT 'stale_handoff', 'warn', 0 UNION ALL SELECT 'symbol_regression', 'fail', count(*)::BIGINT FROM nodes WHERE kind = 'symbol'")
def fusion_checks(spark, d):
    """The gates of a graph with half the symbols that it had before, and of a report that is stale."""
    symbols = w.nodes(spark, d).filter("kind = 'symbol'").count()
    return r.fusion_checks(symbols, 2 * symbols, True, quality_gates(spark, d))
