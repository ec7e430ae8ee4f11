"""Registered queries over documentation, with SQL oracles: pages of Markdown made of every document's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import docs as o
from eventloom.plans.catalog import query
from eventloom.sources import workspace as w

_N = "CAST(doc_id AS VARCHAR(19))"
_L = " || chr(10) || "
#: path, body: front matter on two of three pages, headings of three levels, links of every kind, a fence.
PAGES = f"""SELECT CASE WHEN doc_id % 4 = 0 THEN 'docs/guide/p' ELSE 'notes/p' END || {_N} || '.md' AS path,
CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '---' || chr(10) || 'tags: [red, "blue", t' || {_N} || ']' || chr(10) || '---' || chr(10) ELSE '---' || chr(10) || 'tags:' || chr(10) || '- list' || chr(10) || '- red' || chr(10) || 'x: y' || chr(10) || '---' || chr(10) END
|| '# Page ' || {_N}{_L}'See [next](p' || CAST(doc_id + 1 AS VARCHAR(19)) || '.md#part-one) and `src/m' || {_N} || '.ts`.'{_L}'## Part one'{_L}'[up](../docs/guide/p' || CAST(doc_id - doc_id % 4 AS VARCHAR(19)) || '.md) [[p' || CAST(doc_id + 4 AS VARCHAR(19)) || '|there]] [web](https://example.org/x)'{_L}'### Deep !'
{_L}'```'{_L}'[fenced](gone.md)'{_L}'```'{_L}'`OrderService` and `npm run x` [[#part-one]]'{_L}'## Part one'{_L}'[out](../../../etc/x.md) [root](/docs/guide/p4.md#no-such) [lost](P' || {_N} || '.rst)'{_L}'# End' AS body FROM {{documents}}"""
PAGES_SQL = f"WITH pg AS ({w.bound(PAGES)})"
_FRONT = "'^---\\r?\\n([\\s\\S]*?)\\r?\\n---\\r?\\n?'"
LINES = f"""fm AS (SELECT path, body, regexp_extract(body, {_FRONT}) AS front FROM pg), fr AS (SELECT path, length(front) - length(replace(front, chr(10), '')) AS off, body[length(front) + 1:] AS rest FROM fm),
pl AS (SELECT path, off + i AS line, string_split(rest, chr(10))[i] AS text FROM fr, unnest(range(1, 40)) t(i) WHERE i <= len(string_split(rest, chr(10)))),
ff AS (SELECT path, off, regexp_replace(rest, '```[\\s\\S]*?```', chr(10), 'g') AS rest FROM fr), fl AS (SELECT path, off + i AS line, string_split(rest, chr(10))[i] AS text FROM ff, unnest(range(1, 40)) t(i) WHERE i <= len(string_split(rest, chr(10))))"""


def slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


SECTIONS = f"""sh AS (SELECT path, line, length(regexp_extract(text, '^(#{{1,3}})\\s+(.+?)\\s*$', 1)) AS level, trim(regexp_extract(text, '^(#{{1,3}})\\s+(.+?)\\s*$', 2)) AS heading FROM pl WHERE regexp_matches(text, '^(#{{1,3}})\\s+(.+?)\\s*$')),
sb AS (SELECT *, row_number() OVER (PARTITION BY path, {slug_sql('heading')} ORDER BY line) - 1 AS nth FROM sh), se AS (SELECT path, line, level, heading, CASE WHEN nth = 0 THEN {slug_sql('heading')} ELSE {slug_sql('heading')} || '-' || nth END AS slug FROM sb),
sx AS (SELECT *, (SELECT arg_max(p.slug, p.line) FROM se p WHERE p.path = se.path AND p.line < se.line AND p.level < se.level) AS parent FROM se)"""
IN_SECTION = "(SELECT arg_max(se.slug, se.line) FROM se WHERE se.path = x.path AND se.line <= x.line)"
LINKS = f"""lr AS (SELECT path, line, 'markdown_link' AS kind, trim(unnest(regexp_extract_all(text, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2))) AS raw, generate_subscripts(regexp_extract_all(text, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2), 1) - 1 AS n FROM fl
 UNION ALL SELECT path, line, 'wikilink', trim(regexp_extract(unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)), '^([^|]*)', 1)), generate_subscripts(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1), 1) - 1 FROM fl),
li AS (SELECT path, line, kind, n, CASE WHEN contains(raw, '#') THEN split_part(raw, '#', 1) ELSE raw END AS target, CASE WHEN contains(raw, '#') THEN raw[position('#' IN raw) + 1:] END AS anchor FROM lr WHERE NOT (kind = 'markdown_link' AND regexp_matches(raw, '(?i)^(https?:|mailto:)'))),
lk AS (SELECT x.*, {IN_SECTION} AS section FROM li x)"""
_UP = "'[^/.]+/\\.\\./'"
NORMAL = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, '//', '/'), '^/', ''), {_UP}, ''), {_UP}, ''), {_UP}, '')"
DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
RESOLVED = f"""lt AS (SELECT *, CASE WHEN target = '' THEN path WHEN starts_with(target, '/') THEN target[2:] ELSE {NORMAL(f"{DIR} || '/' || target")} END AS t0 FROM lk),
lc AS (SELECT path, line, kind, n, unnest(cands) AS file, generate_subscripts(cands, 1) AS k FROM (SELECT *, list_concat([t0], CASE WHEN regexp_matches(t0, '(?i)\\.[a-z0-9]+$') THEN [] ELSE [t0 || '.md', t0 || '/README.md'] END, CASE WHEN target <> '' AND NOT contains(target, '/') AND NOT regexp_matches(target, '(?i)\\.[a-z0-9]+$') THEN [{DIR} || '/docs/' || target, {DIR} || '/docs/' || target || '.md', 'docs/' || t0, 'docs/' || t0 || '.md'] ELSE [] END) AS cands FROM lt)),
lb AS (SELECT path, line, kind, n, arg_min(file, k) AS file FROM lc WHERE file IN (SELECT path FROM pg) GROUP BY ALL),
lz AS (SELECT lk.path, lk.line, lk.kind, lk.target, lk.anchor, lk.section, lb.file, se.slug AS to_section FROM lk LEFT JOIN lb USING (path, line, kind, n) LEFT JOIN se ON se.path = lb.file AND se.slug = {slug_sql("coalesce(anchor, '')")}),
dg AS (SELECT path, line, CASE WHEN file IS NULL THEN 'link' ELSE 'anchor' END AS what, target || coalesce('#' || anchor, '') AS target, target AS tfile FROM lz WHERE file IS NULL OR (coalesce(anchor, '') <> '' AND to_section IS NULL)),
dx AS (SELECT DISTINCT path, line::INT AS line, target, CASE WHEN tfile <> '' AND (starts_with(tfile, '/') OR starts_with({NORMAL(f"{DIR} || '/' || tfile")}, '..')) THEN 'outside_workspace' WHEN what = 'anchor' THEN 'missing_anchor' ELSE 'missing_file' END AS reason FROM dg)"""


def pages(spark, d):
    return w.of(spark, d, PAGES)


@query(f"{PAGES_SQL}, {LINES}, {SECTIONS} SELECT path, line::INT AS line, level::INT AS level, heading, slug, parent FROM sx")
def doc_sections(spark, d):
    return o.sections(pages(spark, d))


@query(f"{PAGES_SQL} SELECT path, CASE WHEN starts_with(body, '---') THEN CASE WHEN contains(body, 'tags: [') THEN 'red,blue,t' || regexp_extract(path, '([0-9]+)\\.md$', 1) ELSE 'list,red' END ELSE '' END AS tags FROM pg")
def doc_tags(spark, d):
    return pages(spark, d).select("path", F.array_join(o.tags(F.col("body")), ",").alias("tags"))


@query(f"{PAGES_SQL}, {LINES}, {SECTIONS}, {LINKS} SELECT path, line::INT AS line, kind, target, anchor, section FROM lk")
def doc_links(spark, d):
    return o.links(pages(spark, d)).drop("n")


@query(f"{PAGES_SQL}, {LINES}, {SECTIONS}, x AS (SELECT path, line, trim(unnest(regexp_extract_all(text, '`([^`]+)`', 1))) AS reference FROM fl) SELECT path, line::INT AS line, reference, CASE WHEN contains(reference, '/') THEN 'file' ELSE 'symbol' END AS kind, {IN_SECTION} AS section FROM x WHERE NOT starts_with(reference, 'npm run')")
def doc_code_references(spark, d):
    return o.code_references(pages(spark, d)).drop("n")


def found(spark, d):
    p = pages(spark, d)
    return o.resolved(o.links(p), p, o.sections(p))


@query(f"{PAGES_SQL}, {LINES}, {SECTIONS}, {LINKS}, {RESOLVED} SELECT path, line::INT AS line, kind, target, anchor, section, file, to_section FROM lz")
def resolved_doc_links(spark, d):
    return found(spark, d)


@query(f"{PAGES_SQL}, {LINES}, {SECTIONS}, {LINKS}, {RESOLVED} SELECT path, line, target, reason FROM dx")
def broken_doc_links(spark, d):
    return o.parsed_diagnostics(o.diagnostics(found(spark, d)))


@query(f"{PAGES_SQL}, {LINES}, {SECTIONS}, {LINKS}, {RESOLVED} SELECT reason, count(*)::BIGINT AS n FROM dx GROUP BY reason")
def doc_link_hygiene(spark, d):
    return o.hygiene(broken_doc_links(spark, d))


STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\\.[^.]+$', '')"


@query(f"""{PAGES_SQL}, {LINES}, {SECTIONS}, {LINKS}, {RESOLVED}, rq AS (SELECT path, line, target, lower({NORMAL("split_part(target, '#', 1)")}) AS low FROM dx WHERE reason = 'missing_file'),
ix AS (SELECT path AS file, lower(path) AS low, {STEM.format('lower(path)')} AS stem, count(*) OVER (PARTITION BY {STEM.format('lower(path)')}) AS m FROM pg) SELECT rq.path, line, target, file, CASE WHEN m = 1 THEN 0.85 ELSE 0.45 END::DOUBLE AS score, m > 1 AS ambiguous FROM rq JOIN ix ON {STEM.format('rq.low')} = ix.stem QUALIFY row_number() OVER (PARTITION BY rq.path, line, target ORDER BY score DESC, file) = 1""")
def doc_link_repairs(spark, d):
    return o.repairs(broken_doc_links(spark, d), pages(spark, d))


WORDS_OF = f"list_distinct(string_split({slug_sql('{0}')}, '-'))"


@query("WITH h AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part), s AS (SELECT p_partkey, " + slug_sql("a") + " AS x, " + slug_sql("b") + " AS y FROM h) SELECT p_partkey, CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.82 ELSE round(len(list_intersect(list_distinct(string_split(x, '-')), list_distinct(string_split(y, '-')))) / greatest(len(list_distinct(string_split(x, '-'))), len(list_distinct(string_split(y, '-')))), 6) END::DOUBLE AS similarity FROM s")
def heading_similarity(spark, d):
    """Names of parts against their types, as two headings."""
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", o.heading_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))
