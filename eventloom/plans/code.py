"""Registered queries over the code graph: classes of nodes and edges, summaries, search and naming, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import code as c
from eventloom.plans.catalog import query
from eventloom.sources import workspace as w

G = w.GRAPH_SQL
SHOWN = "coalesce(path, label)"
ASKED = {"balanced": "order service architecture", "code": "fix the order service class", "docs": "payment guide"}


def graph(spark, d):
    return w.nodes(spark, d), w.edges(spark, d)


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def rules_sql(path: str, rules: dict) -> str:
    """The list of matching rules' names."""
    normal = f"lower(regexp_replace(replace({path}, '\\', '/'), '^/+', ''))"
    part = {"normal": normal, "base": f"regexp_extract({normal}, '([^/]*)/*$', 1)", "padded": f"('/' || {normal} || '/')"}
    test = lambda f, p: f"{'NOT ' if f[0] == '!' else ''}regexp_matches({part[f.lstrip('!')]}, '{p}')"
    cases = [f"CASE WHEN {' OR '.join('(' + ' AND '.join(test(*t) for t in way) + ')' for way in ways)} THEN '{n}' END" for n, ways in rules.items()]
    return f"CASE WHEN coalesce({normal}, '') = '' THEN [] ELSE list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) END"


NODE_LENSES = f"""(SELECT *, list_concat(a, list_filter(list_filter([CASE WHEN kind = 'community' THEN 'backend-runtime' END, CASE WHEN kind IN ('doc_file', 'doc_section') THEN 'docs-handoff' END,
  CASE WHEN kind = 'config_file' AND regexp_matches(lower({SHOWN}), '\\.(tf|tfvars)$') THEN 'infra' END, CASE WHEN kind = 'symbol' AND regexp_matches(lower(label), 'viewmodel|view|page|component') THEN 'frontend' END,
  CASE WHEN kind = 'symbol' AND contains(lower(label), 'test') THEN 'tests' END], lambda x: x IS NOT NULL), lambda x: NOT list_contains(a, x))) AS lenses FROM (SELECT *, {rules_sql(SHOWN, c.LENSES)} AS a FROM nodes))"""


@query(f"{G} SELECT id, array_to_string({rules_sql('path', c.LENSES)}, ',') AS lenses, array_to_string({rules_sql('path', c.SCOPES)}, ',') AS scopes FROM nodes WHERE path IS NOT NULL")
def path_lenses(spark, d):
    n = w.nodes(spark, d).filter("path IS NOT NULL")
    return n.select("id", F.array_join(c.matched(F.col("path"), c.LENSES), ",").alias("lenses"), F.array_join(c.matched(F.col("path"), c.SCOPES), ",").alias("scopes"))


@query(f"{G} SELECT id, array_to_string(list_sort(lenses), ',') AS lenses FROM {NODE_LENSES}")
def node_lenses(spark, d):
    return w.nodes(spark, d).select("id", F.array_join(F.array_sort(c.node_lenses()), ",").alias("lenses"))


@query(f"{G}, k AS (SELECT id FROM {NODE_LENSES} WHERE list_contains(lenses, 'backend-runtime')) SELECT id, src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def lens_edges(spark, d):
    return c.lens_graph(*graph(spark, d), "backend-runtime")[1].select("id", "src", "dst")


@query(f"""{G}, p AS (SELECT id, kind FROM nodes WHERE kind IN ('code_file', 'community') AND list_contains({rules_sql('path', c.SCOPES)}, 'frontend')), f AS (SELECT id FROM p WHERE kind = 'code_file')
SELECT id FROM p UNION SELECT src FROM edges JOIN nodes s ON s.id = src AND s.kind = 'symbol' WHERE edges.kind = 'belongs_to' AND dst IN (SELECT id FROM f)
UNION SELECT dst FROM edges JOIN nodes t ON t.id = dst AND t.kind = 'community' WHERE edges.kind = 'belongs_to' AND src IN (SELECT id FROM f)""")
def scope_nodes(spark, d):
    return c.scope_nodes(*graph(spark, d), "frontend")


DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"
LOWP = f"lower(replace({SHOWN}, '\\', '/'))"
TEST = f"(kind = 'test' OR regexp_matches({LOWP}, '{c.TEST_PATH}') OR regexp_matches({LOWP}, '\\.tests\\.'))"
TEXT = "lower(concat_ws(' ', label, path))"
LIKE = f"regexp_matches(lower(label), '{c.CLASS_LABEL}')"
rl = lambda p, f="lower(label)": f"regexp_matches({f}, '{p}')"
SCORE = f"""CASE kind WHEN 'symbol' THEN CASE WHEN {LIKE} AND {rl('mainviewmodel|main-view-model')} THEN 0 WHEN {LIKE} AND {rl('viewmodel|view-model')} THEN 1
  WHEN {LIKE} AND {rl('controller|entrypoint|[[:<:]]main[[:>:]]|program|startup|appdelegate'.replace('[[:<:]]', chr(92) + 'b').replace('[[:>:]]', chr(92) + 'b'))} THEN 2
  WHEN {LIKE} AND {rl('service|adapter|manager|provider|repository')} THEN 3 WHEN {LIKE} THEN 4 WHEN {rl('viewmodel|controller|entrypoint|' + chr(92) + 'bmain' + chr(92) + 'b|service|adapter')} THEN 5 ELSE 8 END
  WHEN 'code_file' THEN CASE WHEN {rl('mainviewmodel|main-view-model', TEXT)} THEN 6 WHEN {rl('viewmodel|view-model|controller|' + chr(92) + 'bmain' + chr(92) + 'b|program|startup|appdelegate', TEXT)} THEN 7
  WHEN {rl('service|adapter|manager|provider|repository', TEXT)} THEN 8 WHEN {rl(c.SOURCE_ENDINGS, SHOWN)} THEN 9 ELSE 10 END WHEN 'community' THEN 10 WHEN 'config_file' THEN 11 ELSE 12 END"""
CENTRAL = "CASE WHEN degree >= 3 AND kind IN ('symbol', 'code_file') THEN -least(3, degree // 4) ELSE 0 END"
ELIGIBLE = f"(kind IN ('symbol', 'code_file', 'community', 'config_file') AND NOT regexp_matches(replace({SHOWN}, '\\', '/'), '(?i){c.GENERATED}') AND NOT contains(lower({SHOWN}), '(external)'))"
START = "viewmodel|controller|\\bmain\\b|program|startup|appdelegate|service|adapter|repository"
BRIDGE = "(kind IN ('workspace', 'package', 'directory', 'community', 'god_node') OR (kind = 'project' AND (label = 'workspace-root' OR path IS NOT DISTINCT FROM '.')) OR (kind = 'symbol' AND regexp_matches(lower(label), '\\((namespace|external)\\)')))"
ROLES = f"roles AS (SELECT n.*, coalesce(degree, 0) AS degree, CASE WHEN {TEST} THEN 80 ELSE {SCORE} + {CENTRAL} END AS score FROM nodes n LEFT JOIN deg USING (id))"


@query(f"""{G}, {DEG}, {ROLES} SELECT id, (kind = 'test' OR {TEST} OR contains({LOWP}, 'tests/')) AS is_test, {BRIDGE} AS is_bridge, {ELIGIBLE} AS eligible, degree::BIGINT AS degree, (({BRIDGE}) OR degree >= 12) AS is_hub,
 CASE WHEN {TEST} THEN 'related_tests' WHEN kind IN ('doc_file', 'doc_section') THEN 'supporting_docs' WHEN kind = 'config_file' THEN 'operational_config' WHEN kind = 'symbol' AND contains(lower(label), '(interface)') THEN 'public_contracts'
  WHEN kind = 'symbol' AND {LIKE} AND {rl(START + '|entrypoint|manager|provider')} THEN 'start_with' WHEN kind = 'code_file' AND {rl(START, TEXT)} THEN 'start_with' ELSE 'core_implementation' END AS bucket,
 score::BIGINT AS score, CASE WHEN {TEST} THEN 80 ELSE score + CASE WHEN kind IN ('doc_file', 'doc_section') THEN 8 ELSE 0 END END::BIGINT AS code_score,
 ({SCORE} + {CENTRAL} + CASE WHEN kind IN ('doc_file', 'doc_section') THEN -2 WHEN {TEST} THEN 4 ELSE 2 END)::BIGINT AS docs_score FROM roles""")
def node_roles(spark, d):
    n = c.with_degree(*graph(spark, d))
    degree = F.col("degree")
    return n.select(
        "id", c.is_test().alias("is_test"), c.is_low_value_bridge().alias("is_bridge"), c.is_eligible().alias("eligible"), degree.cast("long").alias("degree"), (c.is_low_value_bridge() | (degree >= 12)).alias("is_hub"),
        c.guidance_bucket().alias("bucket"), c.guidance_score(degree).alias("score"), c.guidance_score(degree, "code").alias("code_score"), c.guidance_score(degree, "docs").alias("docs_score"))


@query(f"{G}, {DEG}, {ROLES} SELECT id, label, score::BIGINT AS score, row_number() OVER (ORDER BY score, {SHOWN}, label, id)::INT AS place FROM roles WHERE {ELIGIBLE} ORDER BY place LIMIT 8")
def read_first(spark, d):
    from pyspark.sql import Window

    found = c.read_first(*graph(spark, d))  # eight rows
    return found.select("id", "label", "score", F.row_number().over(Window.orderBy("score", c.shown(), "label", "id")).alias("place"))


def case_of(pairs: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


RAW = "coalesce(relation, e.kind)"
RELATION = f"coalesce({case_of(c.RELATIONS, RAW)}, {RAW})"


@query(f"""{G}, x AS (SELECT e.*, {RELATION} AS r, lower(trim(relation)) AS low FROM edges e) SELECT id, r AS relation, {case_of(c.EDGE_KINDS, f"coalesce({case_of(c.ALIASES, 'low')}, low)")} AS extracted_kind,
 provenance IN ('extracted', 'manual') AND (kind IN ('references', 'depends_on', 'implements', 'inherits', 'tests', 'declares') OR r IN ('belongs_to', 'declares')) AS semantic,
 CASE WHEN r IN ('belongs_to', 'declares', 'inherits', 'implements', 'contains', 'constructor', 'source_file', 'project_reference', 'using_directive') THEN 'structural'
  WHEN r IN ('calls', 'references', 'depends_on', 'uses', 'route_to_handler', 'tests', 'asset_references') THEN 'semantic' WHEN kind IN ('belongs_to', 'declares', 'inherits', 'implements', 'contains') THEN 'structural'
  WHEN kind IN ('calls', 'references', 'depends_on', 'uses', 'tests', 'documents') THEN 'semantic' ELSE 'structural' END AS class,
 coalesce(least(1.0, greatest(0.0, confidence)), CASE provenance WHEN 'extracted' THEN 0.92 WHEN 'inferred' THEN 0.65 WHEN 'ambiguous' THEN 0.45 WHEN 'manual' THEN 0.85 END)::DOUBLE AS confidence FROM x""")
def edge_roles(spark, d):
    e = w.edges(spark, d)
    return e.select("id", c.relation().alias("relation"), c.extracted_kind(F.col("relation")).alias("extracted_kind"), c.is_semantic_edge().alias("semantic"), c.edge_class().alias("class"), c.resolved_confidence().alias("confidence"))


SCANNER = {"typescript": "typescript", "python": "python-structural", "go": "go-structural", "dotnet": "dotnet-structural", "terraform": "terraform-structural"}


@query(f"{G} SELECT e.id, coalesce(source, {case_of(SCANNER, 's.scanner_id')}, 'generic') AS source, coalesce(least(1.0, greatest(0.0, confidence)), CASE provenance WHEN 'extracted' THEN 0.92 WHEN 'inferred' THEN 0.65 WHEN 'ambiguous' THEN 0.45 ELSE 0.85 END)::DOUBLE AS confidence FROM edges e LEFT JOIN nodes s ON s.id = src")
def finalized_edges(spark, d):
    n, e = graph(spark, d)
    rows = e.join(n.select(F.col("id").alias("src"), "scanner_id"), "src", "left")
    return c.finalized(rows, F.coalesce(c.lookup(SCANNER, F.col("scanner_id")), F.lit("generic"))).select("id", "source", "confidence")


@query(f"{G} SELECT source, count(*)::BIGINT AS edges FROM edges WHERE source IN ({names(c.SOURCES)}) GROUP BY source")
def edge_sources(spark, d):
    return c.edge_sources(w.edges(spark, d))


INNER = "inn AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE kind = 'community') AND dst NOT IN (SELECT id FROM nodes WHERE kind = 'community'))"


@query(f"{G}, {INNER} SELECT round(avg((provenance IS NOT NULL AND source IS NOT NULL AND (provenance NOT IN ('inferred', 'ambiguous') OR confidence IS NOT NULL))::INT), 9) AS coverage, count(*)::BIGINT AS edges FROM inn")
def provenance_coverage(spark, d):
    return c.provenance_coverage(*graph(spark, d)).select(F.round("coverage", 9).alias("coverage"), "edges")


@query(f"{G}, {INNER} SELECT id, 'source' AS missing FROM inn WHERE source IS NULL OR source NOT IN ({names(c.SOURCES)}) UNION ALL SELECT id, 'confidence' FROM inn WHERE provenance IN ('inferred', 'ambiguous') AND confidence IS NULL UNION ALL SELECT id, 'provenance' FROM inn WHERE provenance IS NULL")
def provenance_gate(spark, d):
    return c.provenance_gate(*graph(spark, d))


LENS_ROWS = f"l AS (SELECT kind, {SHOWN} AS shown, unnest(list_concat(['all'], lenses)) AS lens FROM {NODE_LENSES})"
LENS_COUNTS = "ct AS (SELECT lens, count(*)::BIGINT AS nodes, count(*) FILTER (kind IN ('code_file', 'config_file'))::BIGINT AS files, count(*) FILTER (kind = 'symbol')::BIGINT AS symbols, count(*) FILTER (kind = 'community')::BIGINT AS communities FROM l GROUP BY lens)"


@query(f"""{G}, {LENS_ROWS}, {LENS_COUNTS}, p AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY shown) AS k FROM (SELECT DISTINCT lens, shown FROM l WHERE kind IN ('code_file', 'config_file', 'symbol')))
SELECT ct.*, t.top_paths FROM ct LEFT JOIN (SELECT lens, string_agg(shown, '|' ORDER BY shown) AS top_paths FROM p WHERE k <= 5 GROUP BY lens) t USING (lens)""")
def lens_summaries(spark, d):
    return c.lens_summaries(w.nodes(spark, d))


@query(f"{G}, {LENS_ROWS}, {LENS_COUNTS} SELECT lens FROM ct WHERE lens <> 'all' AND files + symbols > 0 ORDER BY files + symbols DESC, lens LIMIT 1")
def recommended_lens(spark, d):
    return c.recommended_lens(w.nodes(spark, d))


@query(f"""{G} SELECT (SELECT count(*) FILTER (kind = 'symbol') FROM nodes)::BIGINT AS symbols, (SELECT count(*) FILTER (kind IN ('code_file', 'config_file')) FROM nodes)::BIGINT AS files, (SELECT count(*) FILTER (kind = 'community') FROM nodes)::BIGINT AS communities,
floor(100 * (SELECT avg((provenance = 'extracted')::INT) FROM edges) + 0.5)::BIGINT AS extracted_percent,
(SELECT count(*) FROM nodes WHERE kind IN ('code_file', 'config_file') AND id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges))::BIGINT AS orphan_files""")
def graph_health(spark, d):
    return c.graph_health(*graph(spark, d))


DOCFILE = "CASE WHEN s.kind = 'doc_file' THEN coalesce(s.path, s.label) ELSE coalesce(s.source_file, s.path, '') END"


@query(f"""{G}, s AS (SELECT coalesce(path, source_file) AS path, count(*) AS sections FROM nodes WHERE kind = 'doc_section' GROUP BY 1),
l AS (SELECT {DOCFILE} AS path, count(*) FILTER (e.kind = 'references' OR relation IN ('doc_link', 'doc_wikilink')) AS links, count(*) FILTER (e.kind = 'documents' OR relation = 'doc_code_ref') AS code_links FROM edges e JOIN nodes s ON s.id = src WHERE s.kind IN ('doc_file', 'doc_section') GROUP BY 1)
SELECT {SHOWN} AS path, label, coalesce(sections, 0)::BIGINT AS sections, coalesce(links, 0)::BIGINT AS links, coalesce(code_links, 0)::BIGINT AS code_links FROM nodes n LEFT JOIN s USING (path) LEFT JOIN l USING (path)
WHERE kind = 'doc_file' ORDER BY coalesce(sections, 0) + coalesce(links, 0) + coalesce(code_links, 0) DESC, path LIMIT 8""")
def docs_hubs(spark, d):
    return c.docs_hubs(*graph(spark, d))


@query(f"{G} SELECT e.id, s.label AS src_label, t.label AS dst_label, provenance || '/' || coalesce(source, 'docs') AS provenance FROM edges e JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE e.kind = 'documents' OR relation = 'doc_code_ref' ORDER BY src_label, dst_label, e.id LIMIT 12")
def docs_to_code(spark, d):
    return c.docs_to_code(*graph(spark, d))


@query(f"{G} SELECT DISTINCT {SHOWN} AS path FROM nodes WHERE kind = 'doc_file' AND {SHOWN} NOT IN (SELECT {DOCFILE} FROM edges e JOIN nodes s ON s.id = src WHERE s.kind IN ('doc_file', 'doc_section') AND e.kind IN ('references', 'documents'))")
def unlinked_docs(spark, d):
    return c.unlinked_docs(*graph(spark, d))


SHAPE = "CASE WHEN {code} AND {docs} THEN 'ambiguous' WHEN {docs} THEN 'docs_oriented' WHEN {code} THEN 'code_oriented' ELSE 'ambiguous' END"


def shape_sql(q: str) -> str:
    return SHAPE.format(code=f"regexp_matches({q}, '{c.CODE_QUERY}')", docs=f"(regexp_matches({q}, '{c.DOCS_QUERY}') OR regexp_matches({q}, '{c.DOCS_ASKED}'))")


@query(f"{G}, q AS (SELECT id, label, {shape_sql('label')} AS shape, CASE length(id) % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'code' ELSE 'docs' END AS requested FROM nodes) SELECT id, shape, CASE WHEN requested <> 'balanced' THEN requested WHEN shape = 'docs_oriented' THEN 'docs' WHEN shape = 'code_oriented' THEN 'code' ELSE 'balanced' END AS mode FROM q")
def query_modes(spark, d):
    """Labels as queries: their shape, and the mode that each takes if another is requested by turns."""
    requested = F.element_at(F.array(F.lit("balanced"), F.lit("code"), F.lit("docs")), (F.length("id") % 3 + 1).cast("int"))
    return w.nodes(spark, d).select("id", c.query_shape(F.col("label")).alias("shape"), c.effective_mode(F.col("label"), requested).alias("mode"))


def normal_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


HAY = normal_sql("concat_ws(' ', id, kind, label, coalesce(path, ''), coalesce(slug, ''), coalesce(parent, ''), coalesce(source_file, ''))")


def ranked_sql(text: str, requested: str) -> str:
    """CTE ``ranked``: intent scores of all nodes that hold a word."""
    asked = c.tokens(text)
    over = " + ".join(f"contains({HAY}, '{t}')::INT * {len(t)}" for t in asked)
    section = " + ".join(f"contains(lower(concat_ws(' ', label, coalesce(path, ''), coalesce(slug, ''), coalesce(parent, ''))), '{t}')::INT * {3 * len(t)}" for t in asked)
    low = "lower(concat_ws(' ', label, coalesce(path, '')))"
    only = " AND ".join(f"contains({low}, '{t}')" for t in asked) + " AND NOT regexp_matches(label, '(?i)(class|interface|service|controller|section|guide|architecture)')"
    return f"""qq AS (SELECT '{text}' AS q), md AS (SELECT q, {shape_sql('q')} AS shape, CASE WHEN '{requested}' <> 'balanced' THEN '{requested}' WHEN ({shape_sql('q')}) = 'docs_oriented' THEN 'docs' WHEN ({shape_sql('q')}) = 'code_oriented' THEN 'code' ELSE 'balanced' END AS mode FROM qq),
rw AS (SELECT n.*, mode, shape, q, CASE WHEN kind = 'doc_section' THEN greatest({over}, {section}) ELSE {over} END AS raw, kind IN ({names(c.CODE_KINDS)}) AS code, kind IN ({names(c.DOC_KINDS)}) AS doc,
  kind = 'community' AND regexp_matches(label, '(?i)\\bdocs?\\b') AS dhome, {only} AS only_words FROM nodes n, md),
ranked AS (SELECT *, CASE mode WHEN 'code' THEN CASE WHEN code THEN 0 WHEN doc THEN 1 ELSE 2 END WHEN 'docs' THEN CASE WHEN doc THEN 0 WHEN code THEN 1 ELSE 2 END ELSE 0 END AS surface,
  greatest(1, raw + CASE WHEN doc AND (mode = 'docs' OR (mode = 'balanced' AND regexp_matches(q, '{c.DOCS_ASKED}'))) THEN 40 ELSE 0 END + CASE mode
    WHEN 'code' THEN code::INT * 20 - doc::INT * 30 - dhome::INT * 15 WHEN 'docs' THEN doc::INT * 25 + code::INT * 5
    ELSE code::INT * CASE WHEN shape = 'docs_oriented' THEN 6 ELSE 12 END + doc::INT * CASE WHEN shape = 'code_oriented' THEN 2 ELSE 10 END - (shape <> 'docs_oriented' AND doc)::INT * 10 - only_words::INT * 6 END)::BIGINT AS score,
  list_filter([CASE WHEN mode = 'code' AND doc THEN 'doc_surface_penalty' END, CASE WHEN mode = 'code' AND dhome THEN 'documentation_community_penalty' END, CASE WHEN mode = 'balanced' AND shape <> 'docs_oriented' AND doc THEN 'doc_surface_balanced_penalty' END,
    CASE WHEN mode = 'balanced' AND only_words THEN 'keyword_only_penalty' END], lambda x: x IS NOT NULL) AS penalties FROM rw WHERE raw > 0)"""


RANKED = " UNION ALL ".join(f"(SELECT '{m}' AS asked, id, surface::INT AS surface, score, array_to_string(penalties, ',') AS penalties FROM (WITH {ranked_sql(t, m)} SELECT * FROM ranked))" for m, t in ASKED.items())


@query(f"{G} {RANKED}")
def intent_scores(spark, d):
    n, out = w.nodes(spark, d), None
    for mode, text in ASKED.items():
        one = c.intent_ranked(n, text, mode).select(F.lit(mode).alias("asked"), "id", "surface", "score", F.array_join("penalties", ",").alias("penalties"))
        out = one if out is None else out.unionByName(one)
    return out


def seeds_sql(text: str, requested: str, k: int = 5) -> str:
    return f"""{ranked_sql(text, requested)}, best AS (SELECT *, row_number() OVER (ORDER BY surface, score DESC, label, id) AS place FROM ranked QUALIFY place <= {k}),
dbest AS (SELECT *, row_number() OVER (ORDER BY surface, score DESC, label, id) AS place FROM ranked WHERE doc QUALIFY place <= {max(2, k // 2)}),
pl AS (SELECT (SELECT mode FROM md) IN ('code', 'balanced') AND (SELECT count(*) FROM nodes WHERE kind = 'symbol') > 3 AND coalesce((SELECT max((kind = 'symbol')::INT) FROM best), 0) = 1 AND NOT regexp_matches('{text}', '{c.DOCS_ASKED}') AS plain),
al AS (SELECT *, 0 AS turn FROM best UNION ALL SELECT *, 1 FROM dbest WHERE NOT (SELECT plain FROM pl)), un AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn) = 1),
seed AS (SELECT * EXCLUDE (place), row_number() OVER (ORDER BY turn, place) AS place FROM un QUALIFY row_number() OVER (ORDER BY turn, place) <= {k})"""


SEEDS = " UNION ALL ".join(f"(SELECT '{m}' AS asked, id, score, place::INT AS place FROM (WITH {seeds_sql(t, m)} SELECT * FROM seed))" for m, t in ASKED.items())


@query(f"{G} {SEEDS}")
def query_seeds(spark, d):
    n, out = w.nodes(spark, d), None
    for mode, text in ASKED.items():
        one = c.seeds(n, text, 5, mode).select(F.lit(mode).alias("asked"), "id", "score", "place")
        out = one if out is None else out.unionByName(one)
    return out


def summary_sql(text: str, m: str) -> str:
    fallback = {"code": "cr = 0 AND dr > 0", "docs": "dr = 0 AND cr > 0"}.get(m, "FALSE")
    return f"""(WITH {seeds_sql(text, m)}, s AS (SELECT count(*) FILTER (code) AS cr, count(*) FILTER (doc) AS dr, arg_min(kind, place) AS top, string_agg(kind, ',' ORDER BY place) AS kinds, list_distinct(flatten(list(penalties))) AS p FROM seed)
SELECT '{m}' AS asked, mode, shape, array_to_string(list_sort(CASE WHEN {fallback} THEN list_append(p, 'fallback_surface') ELSE p END), ',') AS penalties, {fallback} AS fallback,
CASE WHEN mode = 'code' AND top IN ({names(c.CODE_KINDS)}) THEN 'Code mode prioritized code symbols and source files.' WHEN mode = 'docs' AND top IN ({names(c.DOC_KINDS)}) THEN 'Docs mode prioritized documentation sections and files.'
 WHEN mode = 'balanced' AND top IS NOT NULL AND shape = 'ambiguous' THEN 'Balanced mode mixed code and documentation evidence.' WHEN mode = 'balanced' AND top IS NOT NULL THEN 'Balanced mode inferred ' || replace(shape, '_', ' ') || ' query shape.'
 ELSE 'Matched query tokens with intent-aware ranking.' END AS reason, kinds, cr::BIGINT AS code_results, dr::BIGINT AS doc_results FROM s, md)"""


@query(f"{G} " + " UNION ALL ".join(summary_sql(t, m) for m, t in ASKED.items()))
def intent_summaries(spark, d):
    n, out = w.nodes(spark, d), None
    for mode, text in ASKED.items():
        one = c.intent_summary(c.seeds(n, text, 5, mode), text, mode).select(F.lit(mode).alias("asked"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def resolution_sql(text: str) -> str:
    """A chain of steps, each a condition, what it adds, its reason and whether it is a path match."""
    asked, said, plain = c.tokens(text), text.strip().replace("\\", "/").lower(), " ".join(c.words(text).split())
    file_query = c.looks_like_file(text)
    simple = text.strip().isidentifier() and text.strip().isascii()
    stem = c.tokens(said.split("/")[-1].rsplit(".", 1)[0]) if file_query else []
    over = " + ".join(f"contains({HAY}, '{t}')::INT * {len(t)}" for t in (stem if file_query else asked)) or "0"
    sql = [f"""t0 AS (SELECT n.*, ({over})::BIGINT AS score, CASE WHEN ({over}) > 0 THEN 'token overlap' ELSE 'no match' END AS reason, FALSE AS hit, lower(label) AS low, lower(replace(coalesce(path, ''), '\\', '/')) AS pth,
lower(regexp_extract(replace({SHOWN}, '\\', '/'), '([^/]*)/*$', 1)) AS base, trim(regexp_extract(label, '^([^(]*)', 1)) AS head FROM nodes n)""",
           f"t1 AS (SELECT *, {normal_sql('regexp_extract(head, ' + chr(39) + '([^.]*)$' + chr(39) + ', 1)')} AS nam, {normal_sql('head')} AS headn, {normal_sql('label')} AS labn, {normal_sql('regexp_replace(base, ' + chr(39) + chr(92) + '.[^.]+$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} AS stm FROM t0)"]

    def step(when, add=None, why=None, hit=False, to=None, extra=""):
        score = f"CASE WHEN {when} THEN {to if to is not None else f'score + {add or 0}'} ELSE score END"
        sql.append(f"t{len(sql)} AS (SELECT * REPLACE ({score} AS score, {f'CASE WHEN {when} THEN {chr(39)}{why}{chr(39)} ELSE reason END' if why else 'reason'} AS reason, {f'(hit OR ({when}))' if hit else 'hit'} AS hit){extra} FROM t{len(sql) - 1})")

    named = f"(base = '{said}' AND base <> '')"
    step(named, 2000, "path basename", True)
    step(f"NOT {named} AND ends_with(pth, '/{said}')", 1500, "path suffix", True)
    step(f"low = '{said}'", 1200, "exact label", True)
    step(f"low <> '{said}' AND starts_with(low, '{said} ')", 1000, "label prefix", True)
    if file_query:
        by_stem = " AND ".join(f"(contains(base, '{t}') OR contains(pth, '{t}'))" for t in stem) or "FALSE"
        sql.append(f"t{len(sql)} AS (SELECT *, (hit OR pth = '{said}' OR {named} OR ends_with(pth, '/{said}') OR ({by_stem})) AS aligned FROM t{len(sql) - 1})")
        step("NOT aligned", why="no match", to="0")
        step("kind = 'code_file' AND aligned AND NOT hit AND score > 0", 0, "filename token")
    sym = "kind = 'symbol' AND "
    step(sym + "contains(low, '(namespace)')", -2500)
    if simple:
        step(sym + f"contains(low, '(namespace)') AND headn <> '{plain}'", why="namespace penalty", to="least(score, 0)")
    step(sym + f"contains(label, '(class)') AND nam = '{plain}'", 3200, "class name exact")
    step(sym + f"contains(label, '(class)') AND nam <> '{plain}' AND starts_with(labn, '{plain} ')", 900, "class symbol")
    step(sym + f"contains(label, '(interface)') AND nam = '{plain}'", 1200, "interface name")
    if simple:
        step(sym + "contains(label, '(interface)')", -1500)
        step(sym + "contains(label, '(interface)') AND score <= 0", 0, "interface penalty")
        step(sym + f"regexp_matches(low, '\\((field|property)\\)') AND {normal_sql('trim(regexp_extract(label, ' + chr(39) + '^([^.]*)' + chr(39) + ', 1))')} = '{plain}'", -2800, "field penalty")
    if file_query:
        step(sym + "regexp_matches(low, '\\((function|method)\\)')", -1800)
        step(sym + "regexp_matches(low, '\\((function|method)\\)') AND score > 0", 0, "inner callable")
    if "." not in text and "_" not in text:
        step(sym + "regexp_matches(low, '\\((field|method|property)\\)|\\.|_')", -250)
    if file_query:
        step("kind = 'code_file' AND aligned", 4500, "code file path")
    if simple:
        step(f"kind = 'code_file' AND stm <> '{plain}'", -400)
    for t in asked:
        step(f"kind = 'doc_section' AND contains({normal_sql('regexp_replace(label, ' + chr(39) + '(?i)' + chr(92) + 's*' + chr(92) + '(doc_section' + chr(92) + ')' + chr(92) + 's*$' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, '{t}')", 4 * len(t), "doc section")
    step(f"kind = 'doc_section' AND contains(pth, '{said}')", 300)
    if not file_query and asked:
        step("kind = 'doc_file' AND (" + " OR ".join(f"contains(stm, '{t}')" for t in asked) + ")", 250, "doc file")
    step("kind = 'workspace' OR (kind = 'project' AND (label = 'workspace-root' OR path IS NOT DISTINCT FROM '.'))", -500)
    exact = f"CASE WHEN lower(id) = '{text.strip().lower()}' THEN {{}} WHEN pth = '{said}' THEN {{}} ELSE {{}} END"
    return f"WITH {', '.join(sql)} SELECT id, label, {exact.format(10000, 9000, 'score')}::BIGINT AS score, {exact.format(chr(39) + 'exact node id' + chr(39), chr(39) + 'exact path' + chr(39), 'reason')} AS reason FROM t{len(sql) - 1}"


NAMED = ("OrderService56", "orderservice1.ts", "symbol:18", "user controller")


@query(f"{G} " + " UNION ALL ".join(f"(SELECT '{t}' AS asked, id, score, reason FROM ({resolution_sql(t)}) WHERE score > 0)" for t in NAMED))
def name_scores(spark, d):
    n, out = w.nodes(spark, d), None
    for text in NAMED:
        one = c.resolution(n, text).filter("score > 0").select(F.lit(text).alias("asked"), "id", "score", "reason")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{G} " + " UNION ALL ".join(f"(SELECT '{t}' AS asked, id, score, reason FROM ({resolution_sql(t)}) WHERE score > 0 ORDER BY score DESC, label, id LIMIT 3)" for t in NAMED))
def name_candidates(spark, d):
    """All names in one pass over the nodes; a node is scored only by names of which it holds a word."""
    asked = spark.createDataFrame([(text, text) for text in NAMED], "query_id string, query string")
    return c.candidates_of(w.nodes(spark, d), asked, 3).select(F.col("query_id").alias("asked"), "id", "score", "reason")


@query(f"""{G} SELECT e.id, CASE WHEN s.kind IN ({names(c.DOC_KINDS)}) AND t.kind IN ({names(c.DOC_KINDS)}) THEN 'doc_to_doc' WHEN s.kind IN ({names(c.DOC_KINDS)}) AND t.kind IN ({names(c.CODE_KINDS)}) OR s.kind IN ({names(c.CODE_KINDS)}) AND t.kind IN ({names(c.DOC_KINDS)}) THEN 'doc_to_code'
 WHEN s.kind IN ({names(c.CODE_KINDS)}) AND t.kind IN ({names(c.CODE_KINDS)}) THEN 'code_to_code' ELSE 'mixed_or_unknown' END AS intent FROM edges e JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst""")
def edge_intents(spark, d):
    n, e = graph(spark, d)
    kind = lambda end: n.select(F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"))
    return e.join(kind("src"), "src").join(kind("dst"), "dst").select("id", c.path_intent(F.col("src_kind"), F.col("dst_kind")).alias("intent"))
