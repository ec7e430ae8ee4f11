"""All registered queries of the library over the star-schema tables, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.operators import events as ev
from eventloom.operators import graph as g
from eventloom.operators import runs, vectors, versions
from eventloom.session import shared_folder
from eventloom.sources import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LENSES = {"africa": "^AFRICA/", "europe": "^EUROPE/", "customers": "/Customer#", "suppliers": "/Supplier#", "urgent": "^orders/1-URGENT/", "parts": "^part/"}
CONFIDENCE = {"extracted": 0.92, "inferred": 0.65, "ambiguous": 0.45}
STATES = {"signup": "running", "error": "paused", "purchase": "completed"}
BOUNDS = [10, 25, 50, 100, 250]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return v.nodes(spark, d), v.edges(spark, d)


WITH_GRAPH = f"WITH {v.NODES_SQL},\n{v.EDGES_SQL}"
WITH_RUN = f"WITH {v.RUN_SQL}"
WITH_PRODUCT = f"WITH {v.PRODUCT_SQL}"
DEGREE = "deg AS (SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, (sum(o) + sum(i))::BIGINT AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM v_edges UNION ALL SELECT dst, 0, 1 FROM v_edges) GROUP BY id)"
SEARCH = """hit AS (SELECT id, kind, label, path, (SELECT sum((contains(lower(label), w))::INT * 2.0 + (contains(lower(path), w))::INT * 1.0 + (contains(lower(kind), w))::INT * 0.5)
  FROM (VALUES ('asia'), ('customer'), ('japan')) AS q(w)) AS score FROM v_nodes), seed AS (SELECT * FROM hit WHERE score > 0 ORDER BY score DESC, id LIMIT 5)"""
WORDS = "asia customer japan"


@query(f"{WITH_GRAPH}, {DEGREE}, {SEARCH}, b0 AS (SELECT id, 0 AS depth FROM seed), b1 AS (SELECT DISTINCT dst AS id FROM v_edges JOIN b0 ON src = id), b2 AS (SELECT DISTINCT dst AS id FROM v_edges JOIN b1 ON src = id), a AS (SELECT id, min(depth) AS depth FROM (SELECT * FROM b0 UNION ALL SELECT id, 1 FROM b1 UNION ALL SELECT id, 2 FROM b2) GROUP BY id) SELECT n.id, n.kind, n.label, a.depth, coalesce(degree, 0)::BIGINT AS degree FROM a JOIN v_nodes n USING (id) LEFT JOIN deg USING (id)")
def search_context(spark, d):
    return g.search_context(*graph(spark, d), WORDS)


@query(f"{WITH_GRAPH}, {SEARCH} SELECT id, kind, label, path, score::DOUBLE AS score FROM hit WHERE score > 0")
def search_scores(spark, d):
    return g.search(v.nodes(spark, d), WORDS)


@query(f"{WITH_GRAPH}, {SEARCH} SELECT id, kind, label, path, score::DOUBLE AS score FROM seed")
def search_seeds(spark, d):
    return g.seeds(v.nodes(spark, d), WORDS)


@query(f"{WITH_GRAPH}, {DEGREE} SELECT * FROM deg")
def degree(spark, d):
    return g.degree(v.edges(spark, d))


@query(f"{WITH_GRAPH}, {DEGREE} SELECT id, degree FROM deg WHERE degree >= 12")
def hubs(spark, d):
    return g.hubs(v.edges(spark, d))


@query(f"{WITH_GRAPH}, {DEGREE} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 20")
def hotspots(spark, d):
    return g.degree(v.edges(spark, d)).orderBy(F.desc("degree"), "id").limit(20).select("id", "degree")


@query(f"{WITH_GRAPH} SELECT e.* FROM v_edges e WHERE src IN (SELECT id FROM v_nodes WHERE path LIKE 'ASIA/%' OR kind = 'community') AND dst IN (SELECT id FROM v_nodes WHERE path LIKE 'ASIA/%' OR kind = 'community')")
def induced_edges(spark, d):
    n, e = graph(spark, d)
    return g.induced(n.filter("path LIKE 'ASIA/%' OR kind = 'community'"), e)


@query(f"{WITH_GRAPH} SELECT * FROM v_edges WHERE src NOT IN (SELECT id FROM v_nodes WHERE id <> 's:1') OR dst NOT IN (SELECT id FROM v_nodes WHERE id <> 's:1')")
def dangling_edges(spark, d):
    n, e = graph(spark, d)
    return g.dangling(n.filter("id <> 's:1'"), e)


@query(f"{WITH_GRAPH} SELECT n.* FROM v_nodes n WHERE id NOT IN (SELECT src FROM v_edges UNION SELECT dst FROM v_edges)")
def orphan_nodes(spark, d):
    return g.orphans(*graph(spark, d)).select("id", "kind", "label", "path")


@query(f"{WITH_GRAPH} SELECT e.kind, s.kind AS src_kind, t.kind AS dst_kind, count(*)::BIGINT AS n, sum(weight)::BIGINT AS weight FROM v_edges e JOIN v_nodes s ON s.id = src JOIN v_nodes t ON t.id = dst GROUP BY ALL")
def endpoint_kinds(spark, d):
    return g.endpoint_kinds(*graph(spark, d))


@query(f"{WITH_GRAPH} SELECT kind, provenance, count(*)::BIGINT AS n, sum(weight)::BIGINT AS weight, round(avg(CASE provenance WHEN 'extracted' THEN 0.92::DOUBLE WHEN 'inferred' THEN 0.65 ELSE 0.45 END), 6) AS confidence FROM v_edges GROUP BY ALL")
def provenance_summary(spark, d):
    return g.provenance_summary(v.edges(spark, d), CONFIDENCE)


@query(f"{WITH_GRAPH} SELECT kind, count(*)::BIGINT AS n FROM v_nodes GROUP BY kind")
def nodes_by_kind(spark, d):
    return v.nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{WITH_GRAPH}, l AS (" + " UNION ALL ".join(f"SELECT kind, '{k}' AS lens FROM v_nodes WHERE regexp_matches(path, '{p}')" for k, p in LENSES.items()) + ") SELECT lens, kind, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def lens_summary(spark, d):
    return g.lens_summary(v.nodes(spark, d), LENSES)


BFS = "r AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT dst, src FROM v_edges), b0 AS (SELECT 's:1' AS id), b1 AS (SELECT DISTINCT b AS id FROM r JOIN b0 ON a = id), b2 AS (SELECT DISTINCT b AS id FROM r JOIN b1 ON a = id)"


@query(f"{WITH_GRAPH}, {BFS} SELECT id, min(depth)::INT AS depth FROM (SELECT id, 0 AS depth FROM b0 UNION ALL SELECT id, 1 FROM b1 UNION ALL SELECT id, 2 FROM b2) GROUP BY id")
def bfs_depth(spark, d):
    n, e = graph(spark, d)
    return g.bfs(e, n.filter("id = 's:1'"), 2)


@query(f"{WITH_GRAPH}, b1 AS (SELECT DISTINCT src AS id FROM v_edges WHERE dst = 's:2'), b2 AS (SELECT DISTINCT src AS id FROM v_edges JOIN b1 ON dst = id) SELECT id, min(depth)::INT AS depth FROM (SELECT 's:2' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM b1 UNION ALL SELECT id, 2 FROM b2) GROUP BY id")
def impact(spark, d):
    n, e = graph(spark, d)
    return g.impact(e, n.filter("id = 's:2'"))


COST = "CASE kind WHEN 'belongs_to' THEN 4.0 WHEN 'references' THEN 1.6 ELSE 1.0 END + CASE provenance WHEN 'inferred' THEN 0.5 WHEN 'ambiguous' THEN 1.0 ELSE 0.0 END"


@query(f"{WITH_GRAPH}, s AS (SELECT src, dst, min(({COST})::DOUBLE) AS c FROM v_edges GROUP BY src, dst), p0 AS (SELECT id, 0.0::DOUBLE AS cost, 0 AS hops FROM v_nodes WHERE label = 'order 1' OR label = 'order 2' OR label = 'order 3'), p1 AS (SELECT dst AS id, cost + c AS cost, 1 AS hops FROM p0 JOIN s ON src = id), p2 AS (SELECT dst AS id, cost + c AS cost, 2 AS hops FROM p1 JOIN s ON src = id), p3 AS (SELECT dst AS id, cost + c AS cost, 3 AS hops FROM p2 JOIN s ON src = id), a AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cost, 6), hops) AS k FROM a) SELECT id, round(cost, 6) AS cost, hops FROM m WHERE k = 1")
def cheapest_paths(spark, d):
    n, e = graph(spark, d)
    out = g.cheapest_paths(e, n.filter("label IN ('order 1', 'order 2', 'order 3')"), F.expr(COST).cast("double"), 3)
    return out.select("id", F.round("cost", 6).alias("cost"), "hops")


@query(f"{WITH_GRAPH}, m AS (SELECT src AS id, dst AS community FROM v_edges WHERE kind = 'belongs_to' AND dst LIKE 'r:%'), x AS (SELECT a.community AS ca, b.community AS cb FROM v_edges e JOIN m a ON a.id = src JOIN m b ON b.id = dst), c AS (SELECT ca AS community, count(*) FILTER (ca = cb) AS inner_edges, count(*) FILTER (ca <> cb) AS crossing_edges FROM x GROUP BY ca) SELECT m.community, count(*)::BIGINT AS members, coalesce(min(inner_edges), 0)::BIGINT AS inner_edges, coalesce(min(crossing_edges), 0)::BIGINT AS crossing_edges FROM m LEFT JOIN c USING (community) GROUP BY m.community")
def communities(spark, d):
    return g.communities(*graph(spark, d))


@query(f"{WITH_GRAPH}, t AS (SELECT src, dst FROM v_edges UNION ALL SELECT dst, src FROM v_edges WHERE kind = 'references') SELECT DISTINCT a.src, a.dst FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")
def two_cycles(spark, d):
    """The graph has none; with its references turned round as well, each of them is one."""
    e = v.edges(spark, d).select("src", "dst", "kind")
    back = e.filter("kind = 'references'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    return g.two_cycles(e.unionByName(back)).select("src", "dst")


@query(f"{WITH_GRAPH}, e AS (SELECT DISTINCT src, dst FROM v_edges WHERE kind = 'depends_on'), s AS (SELECT src, count(*) AS n FROM e GROUP BY src), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL) SELECT a, b, common::BIGINT AS common, round(common / (p.n + q.n - common), 6) AS similarity FROM c JOIN s p ON p.src = a JOIN s q ON q.src = b WHERE round(common / (p.n + q.n - common), 6) >= 0.5")
def jaccard_neighbours(spark, d):
    return g.jaccard_neighbours(v.edges(spark, d), "depends_on", 0.5)


@query(f"{WITH_PRODUCT}, l AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) AS k, min(seq) OVER (PARTITION BY node_id) AS first_seq, count(*) OVER (PARTITION BY node_id) AS n_events FROM v_product) SELECT node_id, payload, ts, first_seq::BIGINT AS first_seq, n_events::BIGINT AS n_events FROM l WHERE k = 1 AND kind = 'product.node.upserted'")
def product_projection(spark, d):
    return ev.projection(v.product_events(spark, d), "node_id", "product.node.upserted")


@query(f"{WITH_PRODUCT}, l AS (SELECT node_id, arg_max(kind, seq) AS kind FROM v_product GROUP BY node_id) SELECT kind, count(*)::BIGINT AS n FROM l GROUP BY kind")
def product_visibility(spark, d):
    last = v.product_events(spark, d).groupBy("node_id").agg(F.max_by("kind", "seq").alias("kind"))
    return last.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{WITH_RUN} SELECT * FROM v_run")
def event_log_scan(spark, d):
    return v.run_events(spark, d)


@query(f"{WITH_RUN}, t AS (SELECT graph_id, max(seq) AS top FROM v_run GROUP BY graph_id) SELECT v.event_id, v.graph_id, (top + v.seq)::BIGINT AS seq FROM v_run v JOIN t USING (graph_id)")
def event_log_append(spark, d):
    log = v.run_events(spark, d)
    batch = log.select("event_id", "graph_id", F.col("seq").alias("at"))
    return ev.append(log, batch, "graph_id", "at").select("event_id", "graph_id", F.col("seq").cast("long").alias("seq"))


@query(f"{WITH_RUN} SELECT event_id, graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY event_id % 3 = 0, seq)::BIGINT AS seq FROM v_run")
def committed_log(spark, d):
    """Two batches committed to a new log, and a third of which only the data were written."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log = v.run_events(spark, d).select("event_id", "graph_id", F.col("seq").alias("moment"))
    for batch in (log.filter("event_id % 3 <> 0"), log.filter("event_id % 3 = 0")):
        versions.append(path, batch, "graph_id", "moment")
    log.withColumn("seq", F.lit(0).cast("long")).write.parquet(f"{path}/data/batch=unfinished")
    return versions.events(spark, path).select("event_id", "graph_id", "seq")


@query(f"{WITH_RUN}, s AS (SELECT *, CASE kind WHEN 'signup' THEN 'running' WHEN 'error' THEN 'paused' WHEN 'purchase' THEN 'completed' END AS st FROM v_run) SELECT graph_id, coalesce(arg_max(st, seq) FILTER (st IS NOT NULL), 'idle') AS state, max(seq)::BIGINT AS last_seq FROM s GROUP BY graph_id")
def run_control(spark, d):
    return ev.run_control(v.run_events(spark, d), STATES)


@query(f"{WITH_RUN}, c AS (SELECT *, coalesce((lag(kind) OVER (PARTITION BY graph_id, node_id ORDER BY seq) <> kind)::INT, 0) AS ch FROM v_run) SELECT graph_id, node_id, arg_max(kind, seq) AS status, max(ts) AS last_ts, arg_max(value, seq) AS last_value, sum(ch)::BIGINT AS changes FROM c GROUP BY graph_id, node_id")
def node_status(spark, d):
    return ev.node_status(v.run_events(spark, d))


@query(f"{WITH_RUN}, i AS (SELECT graph_id, (kind = 'error')::INT AS bad, seq - sum((kind = 'error')::INT) OVER (PARTITION BY graph_id ORDER BY seq) AS island FROM v_run), r AS (SELECT graph_id, max(n) AS m FROM (SELECT graph_id, island, count(*) AS n FROM i WHERE bad = 1 GROUP BY ALL) GROUP BY graph_id) SELECT i.graph_id, count(*)::BIGINT AS n_events, sum(bad)::BIGINT AS n_bad, coalesce(min(m), 0)::BIGINT AS longest_bad_run, round(sum(bad) / count(*), 6) AS bad_share FROM i LEFT JOIN r USING (graph_id) GROUP BY i.graph_id")
def health(spark, d):
    return ev.health(v.run_events(spark, d), "error")


@query(f"{WITH_RUN}, s AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY graph_id ORDER BY seq)) > 86400000000)::INT, 0) AS nw FROM v_run), z AS (SELECT *, sum(nw) OVER (PARTITION BY graph_id ORDER BY seq) AS session FROM s) SELECT graph_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(ts) AS begin_ts, max(ts) AS end_ts FROM z GROUP BY ALL")
def sessions(spark, d):
    return ev.sessions(v.run_events(spark, d), 86400)


@query(f"{WITH_RUN}, o AS (SELECT *, lead(kind) OVER v AS nk, lead(seq) OVER v AS ns, lead(ts) OVER v AS nt FROM v_run WHERE kind IN ('view', 'click') WINDOW v AS (PARTITION BY graph_id, node_id ORDER BY seq)) SELECT graph_id, node_id, seq AS begin_seq, ns::BIGINT AS end_seq, (epoch_us(nt) - epoch_us(ts))::BIGINT AS micros FROM o WHERE kind = 'view' AND nk = 'click'")
def span_pairs(spark, d):
    return ev.spans(v.run_events(spark, d), "view", "click")


@query(f"{WITH_RUN} SELECT graph_id, count(*) FILTER (kind = 'error')::BIGINT AS n_bad, max(ts) AS last_ts, count(DISTINCT node_id)::BIGINT AS n_nodes FROM v_run GROUP BY graph_id ORDER BY n_bad DESC, last_ts DESC, graph_id LIMIT 10")
def dashboard(spark, d):
    return ev.dashboard(v.run_events(spark, d), "error", 10)


@query(f"{WITH_RUN}, h AS (SELECT kind, value FROM v_run WHERE value IS NOT NULL), c AS (" + " UNION ALL ".join(f"SELECT kind, '{b}' AS le, count(*) FILTER (value <= {b}) AS n FROM h GROUP BY kind" for b in BOUNDS) + " UNION ALL SELECT kind, '+Inf', count(*) FROM h GROUP BY kind) SELECT c.kind, le, n::BIGINT AS n, round(t.s, 4) AS sum, t.k::BIGINT AS count FROM c JOIN (SELECT kind, sum(value) AS s, count(*) AS k FROM h GROUP BY kind) t USING (kind)")
def metric_histogram(spark, d):
    return runs.histogram(v.run_events(spark, d), "value", BOUNDS, "kind").withColumn("sum", F.round("sum", 4))


@query(f"{WITH_RUN}, m AS (SELECT graph_id, seq, round(avg(value) OVER (PARTITION BY graph_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS mean_now, round(avg(value) OVER (PARTITION BY graph_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), 4) AS mean_before FROM v_run) SELECT *, CASE WHEN mean_now - mean_before > 0 THEN 'improving' WHEN mean_now - mean_before < 0 THEN 'worsening' ELSE 'stable' END AS direction FROM m")
def drift(spark, d):
    return ev.drift(v.run_events(spark, d))


@query("WITH b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 3), a AS (SELECT doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 5) SELECT doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM b FULL JOIN a USING (doc_id)")
def fingerprint_diff(spark, d):
    """Two snapshots of the files: some gone, some new, some changed (the split is the feature, all rows take part)."""
    docs = v.table(spark, d, "documents")
    before = docs.filter("doc_id % 7 <> 3").select("doc_id", F.md5("text").alias("h"))
    after = docs.filter("doc_id % 7 <> 5").select("doc_id", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return ev.snapshot_diff(before, after, "doc_id", "h")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("href"))


@query("SELECT href, count(*)::BIGINT AS n, count(DISTINCT page_id)::BIGINT AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY href")
def link_targets(spark, d):
    return page_links(spark, d).groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def page_slugs(spark, d):
    return v.table(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b', '[ipv4]', 'g'), '\\b[0-9a-f]{32,}\\b', '[hex_token]', 'g')) AS redacted_sha256 FROM documents")
def redacted_documents(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted_sha256"))


@query("SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def similar_vectors(spark, d):
    """Similar pairs within a label."""
    out = vectors.similar_pairs(v.table(spark, d, "embeddings"), "label", 0.35)
    return out.select(F.col("a").alias("query_id"), F.col("b").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


@query("WITH s AS (SELECT b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id = 5 AND b.label <> a.label) SELECT vec_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 10")
def nearest_vectors(spark, d):
    """The ten vectors of other labels most like vector 5."""
    e = v.table(spark, d, "embeddings")
    q = e.filter("vec_id = 5").first()
    return vectors.top_k(e.filter(F.col("label") != q["label"]), q["embedding"], 10)


@query("WITH c AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 = 0), s AS (SELECT a.vec_id, avg(list_cosine_similarity(a.embedding::DOUBLE[], c.e)) AS m FROM embeddings a JOIN c ON c.label = a.label AND a.label % 2 = 0 GROUP BY a.vec_id), g AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 1), d AS (SELECT a.vec_id, round(coalesce(m, CASE WHEN a.vec_id % 3 = 0 THEN NULL ELSE list_cosine_similarity(a.embedding::DOUBLE[], g.e) END, 0.7), 6) AS score FROM embeddings a LEFT JOIN s USING (vec_id), g) SELECT vec_id, score, CASE WHEN score >= 0.82 THEN 'closer' WHEN score >= 0.65 THEN 'holding' ELSE 'drifting' END AS direction FROM d")
def drift_scores(spark, d):
    """Vectors against criteria (every tenth vector, for even labels), else against a goal (vector 1; a third have none), else 0.7."""
    e = v.table(spark, d, "embeddings")
    goal = e.filter("vec_id = 1").first()["embedding"]
    criteria = e.filter("vec_id % 10 = 0 AND label % 2 = 0").select("label", F.col("embedding").alias("criterion"))
    outputs = e.withColumn("goal", F.when(F.col("vec_id") % 3 != 0, F.array(*[F.lit(float(x)) for x in goal])))
    return vectors.drift_scores(outputs, criteria, "label").select("vec_id", F.round("score", 6).alias("score"), vectors.direction(F.round("score", 6)).alias("direction"))


@query("SELECT role, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def agent_activity(spark, d):
    return v.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query("WITH x AS (SELECT source, l.quality, l.toxic FROM documents LEFT JOIN labels l USING (doc_id)) SELECT source, count(*)::BIGINT AS n, count(quality)::BIGINT AS judged, coalesce(sum(quality), 0)::BIGINT AS passed, round(CASE WHEN count(quality) > 0 THEN sum(quality) / count(quality) ELSE 0 END, 6) AS pass_rate, CASE WHEN count(quality) = 0 THEN 'not_measured' WHEN sum(quality) / count(quality) >= 0.9 THEN 'pass' ELSE 'fail' END AS gate FROM x GROUP BY source")
def quality_gate(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", "source").join(v.table(spark, d, "labels"), "doc_id", "left")
    rate = F.when(F.col("judged") > 0, F.col("passed") / F.col("judged")).otherwise(F.lit(0.0))
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.coalesce(F.sum("quality"), F.lit(0)).alias("passed"))
    return out.select("*", F.round(rate, 6).alias("pass_rate"), F.when(F.col("judged") == 0, "not_measured").when(rate >= 0.9, "pass").otherwise("fail").alias("gate"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    t = v.table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_custkey, spent, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY spent DESC, c_custkey) AS rank FROM (SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)) WHERE rank <= 3")
def top_per_segment(spark, d):
    spent = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = v.table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(spent, "c_custkey")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("spent"), "c_custkey")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("c_mktsegment", "c_custkey", "spent", "rank")
