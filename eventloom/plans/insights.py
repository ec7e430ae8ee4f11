"""Registered queries of the derived views, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.operators import insights as ins
from eventloom.operators import paths
from eventloom.plans.catalog import WITH_GRAPH, WITH_RUN, graph, query
from eventloom.sources import views as v

ROLES = {"signup": "running", "view": "pause_requested", "click": "stop_requested", "error": "paused", "purchase": "idle"}
STEPS = ["signup", "view", "purchase"]
ROLE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLES.items()) + " END"
TREND_SQL = """k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY seq DESC) AS k FROM v_run),
d AS (SELECT graph_id, arg_max(value, seq) - arg_min(value, seq) AS delta, count(*) AS n FROM k WHERE k <= 3 GROUP BY graph_id)"""
STATE_SQL = """r AS (SELECT *, {role} AS role FROM v_run), b AS (SELECT *, last_value(CASE WHEN role IN ('running', 'paused', 'idle') THEN role END IGNORE NULLS)
OVER (PARTITION BY graph_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE role IS NOT NULL)""".format(role=ROLE_SQL)
TOKENS_SQL = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]{{2,}}')"


@query(f"{WITH_RUN}, {TREND_SQL} SELECT graph_id, round(delta, 6) AS delta, CASE WHEN n < 2 THEN 'steady' WHEN delta > 0.08 THEN 'improving' WHEN delta < -0.08 THEN 'worsening' ELSE 'steady' END AS trend FROM d")
def drift_trend(spark, d):
    return ins.drift_trend(v.run_events(spark, d))


@query(f"{WITH_RUN} SELECT graph_id, kind, max(seq)::BIGINT AS seq, arg_max(node_id, seq) AS node_id, arg_max(ts, seq) AS ts FROM v_run GROUP BY ALL")
def latest_of_kind(spark, d):
    return ins.latest_of_kind(v.run_events(spark, d))


@query(f"""{WITH_RUN}, {STATE_SQL}, s AS (SELECT graph_id, arg_max(role, seq) AS state FROM b WHERE role IN ('running', 'paused', 'idle') GROUP BY graph_id),
p AS (SELECT graph_id, arg_max(role = 'pause_requested' AND before IS NOT DISTINCT FROM 'running', seq) AS hit FROM b WHERE role <> 'stop_requested' GROUP BY graph_id),
q AS (SELECT graph_id, arg_max(role = 'stop_requested' AND coalesce(before, '') IN ('running', 'paused'), seq) AS hit FROM b WHERE role IN ('running', 'idle', 'stop_requested') GROUP BY graph_id)
SELECT g.graph_id, coalesce(state, 'idle') AS state, CASE WHEN q.hit THEN 'stop' WHEN p.hit THEN 'pause' ELSE 'none' END AS pending
FROM (SELECT DISTINCT graph_id FROM b) g LEFT JOIN s USING (graph_id) LEFT JOIN p USING (graph_id) LEFT JOIN q USING (graph_id)""")
def pending_control(spark, d):
    return ins.pending_control(v.run_events(spark, d), ROLES)


@query(f"{WITH_RUN}, k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY seq DESC)::INT AS rank FROM v_run) SELECT graph_id, rank, seq, kind, node_id FROM k WHERE rank <= 5")
def recent_activity(spark, d):
    return ins.recent_activity(v.run_events(spark, d), 5)


@query(f"{WITH_RUN} SELECT graph_id, seq, seq::BIGINT AS n_events, (sum((kind = 'error')::INT) OVER w)::BIGINT AS n_bad, max(value) OVER w AS top_value FROM v_run WINDOW w AS (PARTITION BY graph_id ORDER BY seq)")
def replay_frames(spark, d):
    return ins.replay_frames(v.run_events(spark, d), "error")


@query(f"{WITH_RUN} SELECT graph_id, count(*) FILTER (seq > CASE WHEN graph_id % 3 = 0 THEN 0 ELSE 40 END)::BIGINT AS new_events, count(*) FILTER (kind = 'error' AND seq > CASE WHEN graph_id % 3 = 0 THEN 0 ELSE 40 END)::BIGINT AS new_bad FROM v_run GROUP BY graph_id")
def changes_since(spark, d):
    """A third of the graphs was never seen, the others up to their 40th event; all events take part."""
    log = v.run_events(spark, d)
    seen = log.select("graph_id").distinct().filter("graph_id % 3 <> 0").withColumn("last_seen", F.lit(40))
    return ins.changes_since(log, seen, "error")


@query(f"{WITH_RUN}, {TREND_SQL}, c AS (SELECT graph_id, count(*) AS n, count(*) FILTER (kind = 'error') AS bad, count(*) FILTER (seq > 40) AS news, arg_max(kind, seq) AS last FROM v_run GROUP BY graph_id), s AS (SELECT graph_id, (CASE WHEN last = 'error' THEN 40 ELSE 0 END + CASE WHEN bad * 4 >= c.n THEN 60 ELSE 0 END + CASE WHEN last = 'error' AND news > 0 THEN 25 ELSE 0 END + CASE WHEN d.n >= 2 AND delta < -0.08 THEN 20 ELSE 0 END + CASE WHEN news > 0 THEN 10 ELSE 0 END)::INT AS attention_score FROM c JOIN d USING (graph_id)) SELECT graph_id, attention_score, CASE WHEN attention_score >= 100 THEN 'urgent' WHEN attention_score >= 60 THEN 'high' WHEN attention_score >= 25 THEN 'medium' ELSE 'low' END AS attention_label FROM s")
def attention_scores(spark, d):
    """Signs taken from the log: blocked by a last error, review where a quarter of the events are errors, news after the 40th event."""
    log = v.run_events(spark, d)
    facts = log.groupBy("graph_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "error", 1)).alias("bad"), F.count(F.when(F.col("seq") > 40, 1)).alias("news"), F.max_by("kind", "seq").alias("last"))
    failed, news = F.col("last") == "error", F.col("news") > 0
    signs = facts.join(ins.drift_trend(log), "graph_id").select(
        "graph_id", failed.alias("blocked"), (F.col("bad") * 4 >= F.col("n")).alias("needs_review"), (failed & news).alias("paused_with_news"),
        (F.col("trend") == "worsening").alias("worsening"), news.alias("has_news"), *[F.lit(False).alias(c) for c in ("critical", "waiting_for_approval", "thin_evidence")])
    return ins.attention(signs).select("graph_id", "attention_score", "attention_label")


@query(f"{WITH_RUN}, a AS (SELECT graph_id, min(seq) AS p FROM v_run WHERE kind = 'signup' GROUP BY graph_id), b AS (SELECT graph_id, min(seq) AS p FROM v_run JOIN a USING (graph_id) WHERE kind = 'view' AND seq > a.p GROUP BY graph_id), c AS (SELECT graph_id, min(seq) AS p FROM v_run JOIN b USING (graph_id) WHERE kind = 'purchase' AND seq > b.p GROUP BY graph_id) SELECT graph_id, ((a.p IS NOT NULL)::INT + (b.p IS NOT NULL)::INT + (c.p IS NOT NULL)::INT)::BIGINT AS reached FROM (SELECT DISTINCT graph_id FROM v_run) LEFT JOIN a USING (graph_id) LEFT JOIN b USING (graph_id) LEFT JOIN c USING (graph_id)")
def ordered_steps(spark, d):
    return ins.ordered_steps(v.run_events(spark, d), STEPS)


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey < 5 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def keyed_union(spark, d):
    """Customers merged with a later scan of five nations, whose balances were cleared."""
    base = v.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    later = base.filter("c_nationkey < 5").withColumn("c_acctbal", F.lit(0.0))
    return ins.merged(base, later, "c_custkey").drop("c_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def stale_items(spark, d):
    """Orders that the last scan, of lines not returned, met no more (SE4)."""
    seen = v.table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return v.table(spark, d, "orders").select("o_orderkey").join(seen, "o_orderkey", "left_anti")


@query(f"WITH t AS (SELECT conv_id, turn, {TOKENS_SQL.format('text')} AS a, {TOKENS_SQL.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations) SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM t")
def turn_similarity(spark, d):
    """Each turn against the one before it in its conversation."""
    turns = v.table(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", ins.tokens(F.col("text")).alias("a"), ins.tokens(before).alias("b")).select("conv_id", "turn", F.round(ins.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"{WITH_GRAPH}, h AS (SELECT id, trim(regexp_replace(lower(id || ' ' || kind || ' ' || label || ' ' || path), '[^a-z0-9]+', ' ', 'g')) AS hay FROM v_nodes), s AS (SELECT id, (CASE WHEN contains(hay, 'europe') THEN 6 ELSE 0 END + CASE WHEN contains(hay, 'supplier') THEN 8 ELSE 0 END + CASE WHEN contains(hay, 'france') THEN 6 ELSE 0 END)::BIGINT AS score FROM h) SELECT * FROM s WHERE score > 0")
def token_overlap(spark, d):
    return ins.token_overlap(v.nodes(spark, d), "Europe: supplier, France")


@query(f"{WITH_GRAPH}, r AS (SELECT path AS root FROM v_nodes WHERE kind IN ('community', 'directory')) SELECT id, arg_max(root, length(root)) AS root FROM v_nodes JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY id")
def nearest_root(spark, d):
    nodes = v.nodes(spark, d)
    return ins.nearest_root(nodes, nodes.filter("kind IN ('community', 'directory')").select(F.col("path").alias("root")))


@query(f"{WITH_GRAPH}, k AS (SELECT string_split(path, '/') AS p, count(*) OVER (PARTITION BY string_split(path, '/')[1]) AS n FROM v_nodes) SELECT CASE WHEN n > 36 THEN array_to_string(p[1:2], '/') ELSE p[1] END AS community, count(*)::BIGINT AS members FROM k GROUP BY 1")
def split_communities(spark, d):
    return ins.split_oversized(v.nodes(spark, d))


@query(f"{WITH_GRAPH}, m AS (SELECT id, string_split(path, '/')[1] AS c FROM v_nodes) SELECT a.c AS from_community, b.c AS to_community, count(*)::BIGINT AS n, sum(weight)::BIGINT AS weight FROM v_edges JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.c <> b.c GROUP BY ALL")
def crossing_weights(spark, d):
    nodes, edges = graph(spark, d)
    return ins.crossing_weights(edges, nodes.select("id", F.substring_index("path", "/", 1).alias("community")))


@query(f"{WITH_GRAPH}, i AS (SELECT id FROM v_nodes WHERE kind = 'config_file') SELECT id, dst AS neighbour FROM i JOIN v_edges ON src = id WHERE v_edges.kind IN ('references', 'belongs_to') UNION SELECT id, src FROM i JOIN v_edges ON dst = id WHERE v_edges.kind IN ('references', 'belongs_to')")
def neighbours_by_kind(spark, d):
    nodes, edges = graph(spark, d)
    return ins.neighbours_by_kind(edges, nodes.filter("kind = 'config_file'"), ["references", "belongs_to"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40)")
def ready_tasks(spark, d):
    """Orders all of whose parts are done, here those of size 40 or less."""
    needs = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("needs"))
    done = v.table(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("id"))
    return ins.ready(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), needs, done)


@query(f"{WITH_GRAPH}, e AS (SELECT DISTINCT src, dst FROM v_edges), l0 AS (SELECT DISTINCT src AS id FROM e WHERE src NOT IN (SELECT dst FROM e)), l1 AS (SELECT DISTINCT dst AS id FROM e JOIN l0 ON src = id), l2 AS (SELECT DISTINCT dst AS id FROM e JOIN l1 ON src = id), l3 AS (SELECT DISTINCT dst AS id FROM e JOIN l2 ON src = id) SELECT id, max(level)::INT AS level FROM (SELECT id, 0 AS level FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) GROUP BY id")
def topological_levels(spark, d):
    return paths.levels(v.edges(spark, d))


@query(f"{WITH_RUN}, l AS (SELECT node_id, max(ts) FILTER (kind = 'view') AS scanned, max(ts) FILTER (kind = 'click') AS touched FROM v_run GROUP BY node_id) SELECT node_id, scanned, touched, CASE WHEN scanned IS NULL THEN 'missing' WHEN touched > scanned THEN 'stale' ELSE 'fresh' END AS state FROM l WHERE scanned IS NOT NULL OR touched IS NOT NULL")
def scan_freshness(spark, d):
    return ins.freshness(v.run_events(spark, d), "view", "click")


@query("WITH u AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, turn, used::BIGINT AS used FROM u WHERE used <= 600")
def budgeted_turns(spark, d):
    return ins.within_budget(v.table(spark, d, "conversations"), "conv_id", "turn", F.length("text"), 600).select("conv_id", "turn", "used")


@query("WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - 1 AS k FROM s) SELECT p_partkey, slug, CASE WHEN k > 0 THEN slug || '-' || k ELSE slug END AS unique_slug FROM n")
def unique_slugs(spark, d):
    return ins.unique_slugs(v.table(spark, d, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug")), "slug", "p_partkey")


@query(f"{WITH_GRAPH}, p AS (SELECT provenance, count(*) AS n FROM v_edges GROUP BY provenance) SELECT provenance, n::BIGINT AS n, floor(n * 100 / (SELECT sum(n) FROM p) + 0.5)::BIGINT AS percent FROM p")
def provenance_share(spark, d):
    """Whole percents, halves upward (AG8, SC20)."""
    counts = v.edges(spark, d).groupBy("provenance").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("provenance", "n", text.half_up(F.col("n") * 100 / F.col("total")).alias("percent"))


@query(f"{WITH_GRAPH}, s AS (SELECT id, path, left(trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-'), 64) AS slug FROM v_nodes) SELECT id, kind_id FROM (SELECT id, 'node:' || slug || ':' || left(sha1(path), 12) AS kind_id FROM s)")
def stable_ids(spark, d):
    """Prefix, slug of 64 characters at most, and twelve digits of the path's SHA-1 (SC3)."""
    slug = F.substring(text.slug(F.col("path")), 1, 64)
    return v.nodes(spark, d).select("id", F.concat_ws(":", F.lit("node"), slug, F.substring(F.sha1("path"), 1, 12)).alias("kind_id"))


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS copies, min(doc_id)::BIGINT AS first_id FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_contents(spark, d):
    """Contents kept more than once (PR17, SC15)."""
    docs = v.table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest"))
    return docs.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("WITH g AS (SELECT label, arg_min(embedding, vec_id) AS goal FROM embeddings GROUP BY label), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], goal::DOUBLE[]) AS s FROM embeddings JOIN g USING (label)) SELECT vec_id, round(s, 5) AS score, CASE WHEN s >= 0.82 THEN 'closer' WHEN s >= 0.65 THEN 'holding' ELSE 'drifting' END AS direction FROM s")
def drift_direction(spark, d):
    """Each vector against its label's goal, the one of the smallest id (VE2, VE3)."""
    e = v.table(spark, d, "embeddings")
    goal = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("goal"))
    s = e.join(goal, "label").select("vec_id", text.cosine(F.col("embedding"), F.col("goal")).alias("s"))
    return s.select("vec_id", F.round("s", 5).alias("score"), F.when(F.col("s") >= 0.82, "closer").when(F.col("s") >= 0.65, "holding").otherwise("drifting").alias("direction"))


@query(f"{WITH_RUN} SELECT graph_id, (max(seq) + 1)::BIGINT AS next_seq FROM v_run GROUP BY graph_id")
def next_sequence(spark, d):
    """Every graph with the number its next event gets (SR5, SR6)."""
    return v.run_events(spark, d).groupBy("graph_id").agg((F.max("seq") + 1).alias("next_seq"))
