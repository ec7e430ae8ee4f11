"""Registered queries over agent runs, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import runs as r
from eventloom.plans.catalog import query
from eventloom.session import dealt, kept
from eventloom.sources import workspace as w

R = w.RUNS_SQL
BOUNDS = [10, 50, 100, 500, 1000, 10000]
SEEN, NOW = 5000, "1998-01-01 00:00:00"


def folded(spark, d, *fields):
    """Nodes (all their fields, or graph_id and those named: only what these need of the events is sent) and graphs, written once, and the log; its events are counted and dealt in fixed shares before they are folded."""
    log = w.run_log(spark, d)
    n = log.count()
    nodes = r.fold_nodes(dealt(log, n, "graph_id", "node_id"))
    return kept(nodes.select("graph_id", *fields) if fields else nodes, "run_nodes"), kept(r.fold_graphs(dealt(log, n, "graph_id")), "run_graphs"), log


COVERAGE = "CASE WHEN tools IS NULL THEN 'none' WHEN tools > 0 AND checksums = 3 THEN 'grounded' WHEN tools > 0 OR commands > 0 OR files > 0 OR checksums > 0 THEN 'partial' ELSE 'none' END"
JUDGED = "jd AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY completed_at DESC, planned DESC) AS k FROM rn WHERE status = 'completed' AND drift IS NOT NULL)"
TREND = "tr AS (SELECT graph_id, CASE WHEN n < 2 THEN 'steady' WHEN delta > 0.08 THEN 'improving' WHEN delta < -0.08 THEN 'worsening' ELSE 'steady' END AS trend FROM (SELECT graph_id, count(*) AS n, round(arg_min(drift, k) - arg_max(drift, k), 9) AS delta FROM jd WHERE k <= 3 GROUP BY graph_id))"
HEALTH = f"""he AS (SELECT graph_id, count(*) FILTER (kind NOT IN ('revision', 'replan'))::BIGINT AS planned, count(*) FILTER (status = 'completed')::BIGINT AS completed, count(*) FILTER (status IN ('failed', 'blocked'))::BIGINT AS failed, count(*) FILTER (status = 'superseded')::BIGINT AS superseded,
count(*) FILTER (kind IN ('revision', 'replan'))::BIGINT AS revised, count(*) FILTER (status = 'completed' AND passed)::BIGINT AS passed, count(*) FILTER (status = 'completed' AND {COVERAGE} = 'grounded')::BIGINT AS grounded FROM rn GROUP BY graph_id),
hr AS (SELECT *, round(CASE WHEN completed > 0 THEN passed / completed ELSE 0 END, 6) AS pass_rate, round(CASE WHEN planned > 0 THEN revised / planned ELSE 0 END, 6) AS revision_rate, round(CASE WHEN completed > 0 THEN grounded / completed ELSE 0 END, 6) AS grounded_rate FROM he)"""
REVIEW = """rvw AS (SELECT graph_id, CASE WHEN coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM rn WHERE rn.graph_id = rg.graph_id AND kind = 'revision' GROUP BY coalesce(parent, node_id))), 0) >= 3 THEN 'revised_often'
 WHEN (SELECT count(*) FROM jd WHERE jd.graph_id = rg.graph_id AND k <= 2 AND NOT checks_ok) = 2 THEN 'checks_failed' WHEN (SELECT count(*) FROM jd WHERE jd.graph_id = rg.graph_id AND k <= 3 AND direction = 'drifting') = 3 THEN 'drifting'
 WHEN status = 'blocked' AND (SELECT count(*) FROM rn WHERE rn.graph_id = rg.graph_id AND status IN ('pending', 'ready')) = 0 THEN 'nothing_runnable' END AS reason FROM rg)"""
MARK = lambda k: f"(SELECT arg_max(ts, seq) FROM rev WHERE rev.graph_id = g.graph_id AND kind = '{k}')"
ALERTS = f"""{JUDGED}, {TREND}, {REVIEW}, un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY coalesce(completed_at, updated_at) DESC, planned DESC) AS k FROM rn WHERE NOT checks_ok) WHERE k = 1),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY coalesce(completed_at, updated_at) DESC, planned DESC) AS k FROM rn WHERE status = 'completed') WHERE k = 1),
al0 AS (SELECT g.graph_id, 'review_needed' AS type, coalesce({MARK('run.review_requested')}, g.updated_at) AS at_, un.node_id FROM rg g JOIN rvw USING (graph_id) LEFT JOIN un USING (graph_id) WHERE reason IS NOT NULL
 UNION ALL SELECT graph_id, 'run_blocked', {MARK('run.failed')}, NULL FROM rg g WHERE status = 'blocked'
 UNION ALL SELECT graph_id, 'run_paused', {MARK('run.paused')}, NULL FROM rg g WHERE (SELECT arg_max(kind, seq) FROM rev WHERE rev.graph_id = g.graph_id AND kind IN ('run.started', 'run.paused', 'run.completed', 'run.stopped', 'run.failed')) = 'run.paused'
 UNION ALL SELECT graph_id, 'run_stopped', {MARK('run.stopped')}, NULL FROM rg g WHERE status = 'stopped'
 UNION ALL SELECT g.graph_id, 'drift_worsening', coalesce(dn.completed_at, dn.updated_at, g.updated_at), dn.node_id FROM rg g JOIN tr USING (graph_id) LEFT JOIN dn USING (graph_id) WHERE trend = 'worsening'
 UNION ALL SELECT graph_id, 'deterministic_failure', coalesce(completed_at, updated_at), node_id FROM un
 UNION ALL SELECT graph_id, 'run_completed', {MARK('run.completed')}, NULL FROM rg g WHERE status = 'completed'),
al1 AS (SELECT *, CASE type WHEN 'run_completed' THEN 'info' WHEN 'run_paused' THEN 'info' WHEN 'run_blocked' THEN 'critical' ELSE 'warning' END AS severity FROM al0),
al AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, at_ DESC, type)::INT AS place FROM al1)"""
DASH = f"""{ALERTS}, {HEALTH}, da AS (SELECT rg.graph_id, rg.status, rg.updated_at, CASE WHEN planned > 0 THEN floor(completed * 100 / planned + 0.5) ELSE 0 END::BIGINT AS progress, coalesce(trend, 'steady') AS trend, reason, severity AS top_severity
FROM rg LEFT JOIN hr USING (graph_id) LEFT JOIN tr USING (graph_id) LEFT JOIN rvw USING (graph_id) LEFT JOIN al ON al.graph_id = rg.graph_id AND place = 1)"""
RANKS = "CASE top_severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"


@query(f"{R} SELECT graph_id, node_id, kind, title, parent, needs, depth::INT AS depth, created_at, status, completed_at, drift, direction, passed, superseded_by, updated_at FROM rn")
def run_nodes(spark, d):
    return r.fold_nodes(w.run_log(spark, d)).select("graph_id", "node_id", "kind", "title", "parent", "needs", "depth", "created_at", "status", "completed_at", "drift", "direction", "passed", "superseded_by", "updated_at")


@query(f"{R} SELECT graph_id, status, updated_at, last_seq::BIGINT AS last_seq, events FROM rg")
def run_graphs(spark, d):
    return r.fold_graphs(w.run_log(spark, d)).select("graph_id", "status", "updated_at", F.col("last_seq").cast("long").alias("last_seq"), "events")


@query(f"{R} SELECT graph_id, node_id, {COVERAGE} AS coverage, CASE WHEN {COVERAGE} = 'grounded' AND passed AND llm_ok AND checks_ok THEN 'high' WHEN {COVERAGE} = 'none' OR status = 'failed' OR NOT passed THEN 'low' ELSE 'medium' END AS badge FROM rn")
def node_confidence(spark, d):
    return folded(spark, d)[0].select("graph_id", "node_id", r.evidence_coverage().alias("coverage"), r.confidence_badge().alias("badge"))


@query(f"{R} SELECT DISTINCT * FROM (SELECT graph_id, unnest(string_split(needs, ',')) AS src, node_id AS dst, 'depends_on' AS kind FROM rn WHERE needs <> '' UNION ALL SELECT graph_id, node_id, parent, 'revises' FROM rn WHERE kind = 'revision' AND parent IS NOT NULL UNION ALL SELECT graph_id, superseded_by, node_id, 'supersedes' FROM rn WHERE superseded_by IS NOT NULL)")
def run_edges(spark, d):
    return r.edges(folded(spark, d)[0])


@query(f"{R}, {JUDGED}, {TREND} SELECT * FROM tr")
def run_trend(spark, d):
    return r.trend(folded(spark, d)[0])


@query(f"{R}, {HEALTH} SELECT * FROM hr")
def run_health(spark, d):
    return r.health(folded(spark, d)[0])


@query(f"{R}, {JUDGED}, {REVIEW} SELECT * FROM rvw")
def run_review(spark, d):
    return r.review(*folded(spark, d, *r.STATE_FIELDS)[:2])


@query(f"{R}, {JUDGED} SELECT graph_id, CASE WHEN rg.status = 'blocked' THEN 'blocked' WHEN direction IS NULL THEN CASE WHEN rg.status = 'failed' THEN 'drifting' ELSE 'on_track' END WHEN direction = 'drifting' THEN 'drifting' WHEN direction = 'holding' THEN 'exploring' ELSE 'on_track' END AS frontier, CASE WHEN direction IS NULL THEN CASE WHEN rg.status = 'blocked' THEN 'drifting' ELSE 'on_track' END WHEN direction = 'drifting' THEN 'drifting' WHEN direction = 'holding' THEN 'exploring' ELSE 'on_track' END AS state FROM rg LEFT JOIN (SELECT graph_id, direction FROM jd WHERE k = 1) USING (graph_id)")
def frontier_status(spark, d):
    return r.frontier_status(*folded(spark, d)[:2])


@query(f"{R}, {ALERTS} SELECT graph_id, type, at_ AS raised, node_id, severity, place FROM al")
def run_alerts(spark, d):
    return r.alerts(*folded(spark, d, *r.STATE_FIELDS)).withColumnRenamed("at", "raised")


@query(f"{R}, {ALERTS} SELECT graph_id, type FROM al WHERE type <> 'run_completed'")
def new_alerts(spark, d):
    """Alerts of all graphs against a list that held the completed ones only."""
    nodes, graphs, log = folded(spark, d, *r.STATE_FIELDS)
    before = r.alerts(nodes, graphs, log).filter("type = 'run_completed'").select("graph_id", "type")
    return r.new_alerts(nodes, graphs, log, before)


@query(f"{R}, {JUDGED}, {REVIEW} SELECT graph_id, CASE WHEN reason IS NOT NULL OR status = 'blocked' THEN 'needs_attention' WHEN status IN ('completed', 'stopped', 'failed') AND last_seq <= {SEEN} AND epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(updated_at::TIMESTAMP) >= 604800000 THEN 'archived' WHEN status = 'completed' THEN 'completed_recent' ELSE 'active' END AS bucket FROM rg JOIN rvw USING (graph_id)")
def run_lifecycle(spark, d):
    nodes, graphs, _ = folded(spark, d, *r.STATE_FIELDS)
    return r.lifecycle(graphs, r.review(nodes, graphs), NOW, SEEN)


@query(f"{R}, {DASH} SELECT * FROM da")
def dashboard_rows(spark, d):
    return r.dashboard(*folded(spark, d, *r.STATE_FIELDS))


@query(f"{R}, {DASH} SELECT graph_id, status, updated_at, progress FROM da ORDER BY {RANKS}, reason IS NULL, updated_at DESC, graph_id LIMIT 10")
def dashboard_first(spark, d):
    return r.ordered(r.dashboard(*folded(spark, d, *r.STATE_FIELDS)), 10).select("graph_id", "status", "updated_at", "progress")


@query(f"{R}, {DASH} SELECT count(*)::BIGINT AS graphs, count(*) FILTER (top_severity = 'critical')::BIGINT AS urgent, count(reason)::BIGINT AS needs_review, count(*) FILTER (status = 'blocked')::BIGINT AS blocked, count(*) FILTER (status = 'running')::BIGINT AS active FROM da")
def dashboard_summary(spark, d):
    return r.dashboard_summary(r.dashboard(*folded(spark, d, *r.STATE_FIELDS)))


@query(f"{R}, {DASH} SELECT 'needs_review' AS filter, graph_id FROM da WHERE reason IS NOT NULL UNION ALL SELECT 'blocked', graph_id FROM da WHERE status = 'blocked' UNION ALL SELECT 'active', graph_id FROM da WHERE status IN ('running', 'planned') UNION ALL SELECT 'completed', graph_id FROM da WHERE status = 'completed'")
def dashboard_filters(spark, d):
    rows, out = kept(r.dashboard(*folded(spark, d, *r.STATE_FIELDS)), "dashboard"), None
    for name in ("needs_review", "blocked", "active", "completed"):
        one = r.filtered(rows, name).select(F.lit(name).alias("filter"), "graph_id")
        out = one if out is None else out.unionByName(one)
    return out


POINTS = lambda f: " + ".join(f"CASE WHEN {f} = '{q}' THEN 6 WHEN starts_with({f}, '{q}') THEN 4 WHEN contains({f}, '{q}') THEN 2 ELSE 0 END" for q in ("step", "1"))


@query(f"{R}, m AS (SELECT graph_id, node_id, ({POINTS('lower(trim(title))')}) AS a, ({POINTS('lower(trim(node_id))')}) AS b, ({POINTS('lower(trim(status))')}) AS c FROM rn) SELECT graph_id, node_id, greatest(a, b, c)::INT AS match, CASE WHEN a = greatest(a, b, c) THEN 'title' WHEN b = greatest(a, b, c) THEN 'node_id' ELSE 'status' END AS field FROM m WHERE greatest(a, b, c) > 0")
def node_matches(spark, d):
    return r.text_match(folded(spark, d)[0], "step 1", ("title", "node_id", "status")).select("graph_id", "node_id", "match", "field")


@query(f"{R} SELECT graph_id, status, count(*)::BIGINT AS n FROM rn GROUP BY ALL")
def scheduling_summary(spark, d):
    return r.scheduling(folded(spark, d)[0])


@query(f"{R} SELECT graph_id, coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(commands), 0)::BIGINT AS commands, coalesce(sum(failed_commands), 0)::BIGINT AS failed_commands, count(tools)::BIGINT AS nodes_with_evidence FROM rn GROUP BY graph_id")
def evidence_stats(spark, d):
    return r.evidence_stats(folded(spark, d)[0])


@query(f"{R} SELECT graph_id, node_id, count(*)::BIGINT AS n, count(DISTINCT person)::BIGINT AS people, arg_max(title, seq) AS latest FROM rev WHERE kind = 'node.annotated' GROUP BY ALL")
def node_annotations(spark, d):
    return r.annotations(w.run_log(spark, d))


PROPOSALS = "pr AS (SELECT graph_id, node_id, arg_max(title, seq) FILTER (kind = 'proposal.made') AS title, max(seq) FILTER (kind = 'proposal.made')::BIGINT AS made_seq, CASE arg_max(kind, seq) FILTER (kind IN ('proposal.accepted', 'proposal.dismissed')) WHEN 'proposal.accepted' THEN 'accepted' WHEN 'proposal.dismissed' THEN 'dismissed' ELSE 'open' END AS state FROM rev WHERE kind LIKE 'proposal.%' GROUP BY ALL)"


@query(f"{R}, {PROPOSALS} SELECT * FROM pr WHERE made_seq IS NOT NULL")
def plan_proposals(spark, d):
    return r.proposals(w.run_log(spark, d)).withColumn("made_seq", F.col("made_seq").cast("long"))


@query(f"{R}, {PROPOSALS} SELECT graph_id, node_id, title, row_number() OVER (PARTITION BY graph_id ORDER BY made_seq DESC)::INT AS place FROM pr WHERE state = 'open' AND made_seq IS NOT NULL QUALIFY place <= 3")
def open_proposals(spark, d):
    return r.open_proposals(w.run_log(spark, d))


@query(f"{R} SELECT graph_id, node_id, status, row_number() OVER (PARTITION BY graph_id ORDER BY CASE status WHEN 'executing' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, updated_at DESC, node_id)::INT AS place FROM rn WHERE status NOT IN ('completed', 'superseded') QUALIFY place <= 8")
def run_frontier(spark, d):
    return r.frontier(folded(spark, d)[0])


@query(f"{R} SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY depth, created_at, planned)::INT AS place FROM rn")
def report_order(spark, d):
    return r.report_order(folded(spark, d)[0])


@query(f"{R}, wt AS (SELECT graph_id, node_id, unnest(string_split(needs, ',')) AS need FROM rn WHERE status IN ('pending', 'ready') AND needs <> ''), bl AS (SELECT DISTINCT wt.graph_id, wt.node_id FROM wt WHERE NOT EXISTS (SELECT 1 FROM rn x WHERE x.graph_id = wt.graph_id AND x.node_id = wt.need AND x.status IN ('completed', 'superseded'))) SELECT graph_id, arg_min(node_id, planned) AS next FROM rn WHERE status IN ('pending', 'ready') AND (graph_id, node_id) NOT IN (SELECT (graph_id, node_id) FROM bl) GROUP BY graph_id")
def next_nodes(spark, d):
    return r.next_nodes(folded(spark, d)[0])


@query(f"{R} SELECT graph_id, arg_max(node_id, planned) FILTER (status = 'executing') AS active, (SELECT y.node_id FROM rn y WHERE y.graph_id = rn.graph_id AND y.status IN ('completed', 'failed') ORDER BY updated_at DESC, planned DESC LIMIT 1) AS finished FROM rn GROUP BY graph_id")
def active_nodes(spark, d):
    return r.active_nodes(folded(spark, d)[0])


@query(f"{R} SELECT graph_id, seq::BIGINT AS seq, CASE WHEN kind <> 'node.completed' THEN 'other_kind' WHEN failed_commands > 0 THEN 'command_failed' WHEN duration_ms IS NULL THEN 'unknown_duration' WHEN duration_ms >= 800 THEN 'slow' WHEN confidence < 0.75 THEN 'unsure' END AS kept_for FROM rev")
def tail_sampling(spark, d):
    return w.run_log(spark, d).select("graph_id", F.col("seq").cast("long").alias("seq"), r.sampling_reason().alias("kept_for"))


@query(f"{R}, s AS (SELECT *, lead(kind) OVER v AS nk, lead(seq) OVER v AS ns FROM rev WHERE kind IN ('node.executing', 'node.completed', 'node.failed') WINDOW v AS (PARTITION BY graph_id, node_id ORDER BY seq)) SELECT graph_id, node_id, seq::BIGINT AS begin_seq, ns::BIGINT AS end_seq, CASE nk WHEN 'node.failed' THEN 'error' ELSE 'ok' END AS status FROM s WHERE kind = 'node.executing' AND nk <> 'node.executing'")
def node_spans(spark, d):
    s = r.spans(w.run_log(spark, d))
    return s.select("graph_id", "node_id", F.col("begin_seq").cast("long").alias("begin_seq"), F.col("end_seq").cast("long").alias("end_seq"), "status")


HIST = " UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (duration_ms <= {b})::BIGINT AS n FROM h" for b in BOUNDS)


@query(f"{R}, h AS (SELECT duration_ms FROM rev WHERE duration_ms IS NOT NULL), c AS ({HIST} UNION ALL SELECT '+Inf', count(*) FROM h) SELECT le, n::BIGINT AS n, (SELECT sum(duration_ms) FROM h)::BIGINT AS sum, (SELECT count(*) FROM h)::BIGINT AS count FROM c")
def duration_histogram(spark, d):
    return r.histogram(w.run_log(spark, d), "duration_ms", BOUNDS)


@query(f"{R} SELECT graph_id, sum(duration_ms)::BIGINT AS counter, arg_max(duration_ms, seq) AS gauge FROM rev WHERE duration_ms IS NOT NULL GROUP BY graph_id")
def run_gauges(spark, d):
    return r.gauges(w.run_log(spark, d), "duration_ms", "graph_id")


@query(f"{R} SELECT graph_id, value FROM (SELECT graph_id, direction AS value, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, direction) AS k FROM rn WHERE coalesce(direction, '') <> '' GROUP BY graph_id, direction) WHERE k = 1")
def usual_direction(spark, d):
    return r.mode_of(folded(spark, d)[0], "direction", "graph_id")


GSTATE = "CASE kind WHEN 'run.started' THEN 'running' WHEN 'run.completed' THEN 'completed' WHEN 'run.failed' THEN 'blocked' WHEN 'run.stopped' THEN 'stopped' END"


@query(f"{R} SELECT graph_id, coalesce(arg_max({GSTATE}, seq) FILTER (({GSTATE}) IS NOT NULL AND seq <= {SEEN}), 'planned') AS before, coalesce(arg_max({GSTATE}, seq) FILTER (({GSTATE}) IS NOT NULL), 'planned') AS after, count(*) FILTER (seq > {SEEN})::BIGINT AS new_events, count(*) FILTER (kind = 'node.completed' AND seq > {SEEN})::BIGINT AS newly_completed, count(*) FILTER (kind = 'node.failed' AND seq > {SEEN})::BIGINT AS newly_failed FROM rev GROUP BY graph_id")
def run_delta(spark, d):
    return r.delta(w.run_log(spark, d), SEEN)


@query(f"{R}, {HEALTH} SELECT l.graph_id AS left_graph_id, l.planned AS left_planned, l.completed AS left_completed, l.pass_rate AS left_pass_rate, x.graph_id AS right_graph_id, x.planned AS right_planned, x.completed AS right_completed, x.pass_rate AS right_pass_rate FROM hr l, hr x WHERE l.graph_id = 'g1' AND x.graph_id = 'g2'")
def run_comparison(spark, d):
    return r.comparison(r.health(folded(spark, d)[0]), "g1", "g2")


@query(f"{R}, c AS (SELECT a.graph_id, a.node_id, b.node_id AS found, row_number() OVER (PARTITION BY a.graph_id, a.node_id ORDER BY abs(b.depth - a.depth), b.completed_at DESC, b.planned DESC)::INT AS place FROM rn a JOIN rn b ON a.graph_id = b.graph_id AND b.status = 'completed' WHERE a.status = 'pending') SELECT * FROM c WHERE place <= 3")
def fallback_outputs(spark, d):
    return r.fallback_outputs(folded(spark, d)[0])


def shapes_sql(rounds: int) -> str:
    """Faults of the plans in nd (g, n, title, needs list), whose chains are shorter than rounds, step by step."""
    ctes = ["ne AS (SELECT DISTINCT g, n, unnest(needs) AS need FROM nd)", "o0 AS (SELECT g, n FROM nd WHERE len(needs) = 0)", "r0 AS (SELECT * FROM o0)"]
    for k in range(1, rounds + 1):
        ctes.append(f"o{k} AS MATERIALIZED (SELECT g, n FROM nd WHERE NOT EXISTS (SELECT 1 FROM ne LEFT JOIN o{k - 1} o ON o.g = ne.g AND o.n = need WHERE ne.g = nd.g AND ne.n = nd.n AND o.n IS NULL))")
        ctes.append(f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION SELECT ne.g, ne.n FROM ne JOIN r{k - 1} r ON r.g = ne.g AND r.n = need)")
    return ", ".join(ctes) + f""", fa AS (SELECT g AS graph_id, 'cyclic' AS fault FROM (SELECT g, n FROM nd EXCEPT SELECT * FROM o{rounds}) UNION SELECT g, 'unreachable' FROM (SELECT g, n FROM nd EXCEPT SELECT * FROM r{rounds})
 UNION SELECT g, 'titles_repeat' FROM nd GROUP BY g HAVING count(DISTINCT title) < count(*) UNION SELECT g, 'no_root' FROM nd GROUP BY g HAVING count(*) FILTER (len(needs) = 0) = 0)"""


NEEDS = "list_filter(string_split(needs, ','), lambda x: x <> '')"


@query(f"{R}, nd AS (SELECT graph_id AS g, node_id AS n, title, {NEEDS} AS needs FROM rn), {shapes_sql(3)} SELECT * FROM fa UNION ALL SELECT g, 'too_many_nodes' FROM nd GROUP BY g HAVING count(*) > 12")
def plan_faults(spark, d):
    return r.plan_faults(folded(spark, d)[0])


#: Plans of the lines of each order: chains, with cycles among the first two and the fourth and fifth, and needs that aren't there.
SHAPES = """SELECT 'o' || CAST(l_orderkey AS VARCHAR(19)) AS graph_id, 'n' || CAST(l_linenumber AS VARCHAR(9)) AS node_id, 'Step ' || CAST(CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE l_linenumber END AS VARCHAR(9)) AS title,
CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN '  short ' ELSE 'Deliver part ' || CAST(min(l_partkey) AS VARCHAR(19)) END AS intent, CASE WHEN min(l_partkey) % 29 = 0 THEN CAST(NULL AS VARCHAR(9)) ELSE 'parcel' END AS artifact, CASE WHEN min(l_suppkey) % 31 = 0 THEN 0 ELSE 2 END AS criteria,
CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN 'n2' WHEN l_linenumber = 1 THEN '' WHEN l_linenumber IN (4, 5) AND l_orderkey % 7 = 0 THEN 'n' || CAST(9 - l_linenumber AS VARCHAR(9)) ELSE 'n' || CAST(l_linenumber - 1 AS VARCHAR(9)) || CASE WHEN l_linenumber % 3 = 0 THEN ',n1' ELSE '' END END AS needs
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


@query(f"""WITH sh AS ({w.bound(SHAPES)}), nd AS (SELECT graph_id AS g, node_id AS n, title, {NEEDS} AS needs FROM sh), {shapes_sql(8)} SELECT * FROM fa UNION ALL SELECT g, 'too_many_nodes' FROM nd GROUP BY g HAVING count(*) > 6
UNION ALL SELECT graph_id, 'vague_intent' FROM sh GROUP BY ALL HAVING count(*) FILTER (length(trim(intent)) < 8) > 0 UNION ALL SELECT graph_id, 'invalid_contract' FROM sh GROUP BY ALL HAVING count(*) FILTER (artifact IS NULL OR criteria = 0) > 0""")
def plan_shapes(spark, d):
    return r.plan_faults(w.of(spark, d, SHAPES), 6)


WORDS = "list_distinct(regexp_extract_all(lower(coalesce(t.text, '')), '[a-z0-9]{2,}'))"


@query(f"WITH e AS (SELECT vec_id AS id, embedding AS vector, {WORDS} AS words FROM embeddings LEFT JOIN documents t ON doc_id = vec_id), s AS (SELECT a.id, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS c, len(list_intersect(a.words, b.words)) / nullif(len(list_distinct(list_concat(a.words, b.words))), 0) AS j FROM e a, e b WHERE b.id = 0 AND a.id <> 0) SELECT id, round(CASE WHEN c > 0 THEN c ELSE coalesce(j, 0) END, 6) AS score FROM s WHERE round(CASE WHEN c > 0 THEN c ELSE coalesce(j, 0) END, 6) > 0 ORDER BY score DESC, id LIMIT 5")
def similar_runs(spark, d):
    """Vectors and texts of one id as runs; the target is run 0."""
    e, t = spark.read.parquet(f"{d}/embeddings.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]{2,})"), F.lit(1)))
    rows = e.join(t.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), words.alias("words"))
    return r.similar_runs(rows.filter("id = 0"), rows)
