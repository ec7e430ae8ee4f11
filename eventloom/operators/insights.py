"""Derived views of event logs and graphs: trends, control states, attention, versions, resolution joins, readiness, levels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that each sign of trouble adds to a run's attention, and the labels by least score.
ATTENTION = {"critical": 100, "needs_review": 60, "waiting_for_approval": 55, "blocked": 40, "paused_with_news": 25, "worsening": 20, "has_news": 10, "thin_evidence": 5}
ATTENTION_LABELS = {"urgent": 100, "high": 60, "medium": 25}


def drift_trend(events: DataFrame, n: int = 3, step: float = 0.08) -> DataFrame:
    """graph_id, delta, trend: the last of the n latest values against the first of them; higher is better, a single row is steady (WI1)."""
    w = Window.partitionBy("graph_id").orderBy(F.desc("seq"))
    ends = events.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).groupBy("graph_id").agg(
        F.max_by("value", "seq").alias("last"), F.min_by("value", "seq").alias("first"), F.count("*").alias("n"))
    delta = F.col("last") - F.col("first")
    trend = F.when(F.col("n") < 2, "steady").when(delta > step, "improving").when(delta < -step, "worsening").otherwise("steady")
    return ends.select("graph_id", F.round(delta, 6).alias("delta"), trend.alias("trend"))


def latest_of_kind(events: DataFrame) -> DataFrame:
    """The latest event of each kind of each graph (WI3)."""
    return events.groupBy("graph_id", "kind").agg(F.max("seq").alias("seq"), F.max_by("node_id", "seq").alias("node_id"), F.max_by("ts", "seq").alias("ts"))


def pending_control(events: DataFrame, roles: dict[str, str]) -> DataFrame:
    """graph_id, state, pending: state by the last state event; a pause request counts while running, a stop request while running or paused (EV4, EV5).

    roles maps event kinds to running, paused, idle, pause_requested or stop_requested. A pause clears a pending pause, not a pending stop.
    """
    role = F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), F.col("kind"))
    known = events.withColumn("role", role).filter("role IS NOT NULL")
    is_state = F.col("role").isin("running", "paused", "idle")
    before = F.last(F.when(is_state, F.col("role")), ignorenulls=True).over(Window.partitionBy("graph_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    counted = known.withColumn("before", before)
    last = lambda test: F.max_by(F.struct("role", "before"), F.when(test, F.col("seq")))
    out = counted.groupBy("graph_id").agg(
        F.coalesce(F.max_by("role", F.when(is_state, F.col("seq"))), F.lit("idle")).alias("state"),
        last(is_state | (F.col("role") == "pause_requested")).alias("p"), last(F.col("role").isin("running", "idle", "stop_requested")).alias("s"))
    pause = (F.col("p.role") == "pause_requested") & (F.col("p.before") == "running")
    stop = (F.col("s.role") == "stop_requested") & F.col("s.before").isin("running", "paused")
    return out.select("graph_id", "state", F.when(stop, "stop").when(pause, "pause").otherwise("none").alias("pending"))


def recent_activity(events: DataFrame, n: int) -> DataFrame:
    """The n newest events of each graph, newest first (WI6)."""
    w = Window.partitionBy("graph_id").orderBy(F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("graph_id", "rank", "seq", "kind", "node_id")


def replay_frames(events: DataFrame, bad: str) -> DataFrame:
    """The state after each event: events so far, bad ones so far, largest value so far (WI9)."""
    w = Window.partitionBy("graph_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("graph_id", "seq", F.count("*").over(w).alias("n_events"), F.sum((F.col("kind") == bad).cast("long")).over(w).alias("n_bad"), F.max("value").over(w).alias("top_value"))


def changes_since(events: DataFrame, seen: DataFrame, bad: str) -> DataFrame:
    """Events and bad events after the sequence number last seen, by graph; a graph never seen is new altogether (WI13)."""
    new = F.col("seq") > F.coalesce("last_seen", F.lit(0))
    return events.join(seen, "graph_id", "left").groupBy("graph_id").agg(F.count(F.when(new, 1)).alias("new_events"), F.count(F.when(new & (F.col("kind") == bad), 1)).alias("new_bad"))


def attention(signs: DataFrame) -> DataFrame:
    """Adds attention_score, the points of the signs that hold, from 0 to 200, and its label (EV13); null signs don't hold."""
    score = F.lit(0)
    for name, points in ATTENTION.items():
        score = score + F.when(F.col(name), points).otherwise(0)
    score = F.least(F.greatest(score, F.lit(0)), F.lit(200))
    label = F.lit("low")
    for name, least in sorted(ATTENTION_LABELS.items(), key=lambda kv: kv[1]):
        label = F.when(score >= least, F.lit(name)).otherwise(label)
    return signs.withColumn("attention_score", score).withColumn("attention_label", label)


def ordered_steps(events: DataFrame, steps: list[str]) -> DataFrame:
    """graph_id, reached: how many of the steps each graph went through in this order, as a subsequence (GR22). Earliest matches suffice, so no list is gathered."""
    at = events.groupBy("graph_id").agg(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("reached"))
    for i, kind in enumerate(steps, 1):
        step = events.filter(F.col("kind") == kind).select("graph_id", "seq")
        later = step.join(at.filter(F.col("reached") == i - 1), "graph_id").filter("seq > pos").groupBy("graph_id").agg(F.min("seq").alias("next"))
        at = at.join(later, "graph_id", "left").select("graph_id", F.coalesce("next", "pos").alias("pos"), F.when(F.col("next").isNotNull(), F.lit(i).cast("long")).otherwise(F.col("reached")).alias("reached"))
    return at.select("graph_id", "reached")


def merged(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Union by key where the incoming row wins (SE2): the base without the incoming keys, and the incoming rows."""
    return base.join(incoming.select(key), key, "left_anti").select(base.columns).unionByName(incoming.select(base.columns))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; zero where either is empty (SE8)."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits of two characters or more (SEA1)."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def token_overlap(nodes: DataFrame, query: str) -> DataFrame:
    """id, score: the summed length of the query's tokens that a node's fields hold as substrings; repeated tokens count again (SEA2)."""
    words = re.findall("[a-z0-9]{2,}", query.lower())
    hay = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "id", "kind", "label", "path")), "[^a-z0-9]+", " "))
    score = F.lit(0)
    for w in words:
        score = score + F.when(F.contains(hay, F.lit(w)), len(w)).otherwise(0)
    return nodes.select("id", score.cast("long").alias("score")).filter("score > 0")


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root: the longest root that is a prefix of a path by whole segments (JO9): an equality join on the path's own prefixes, no range join."""
    parts = F.split("path", "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return paths.select("id", prefix.alias("root")).join(roots.select("root").distinct(), "root").groupBy("id").agg(F.max_by("root", F.length("root")).alias("root"))


def split_oversized(nodes: DataFrame, most: int = 36) -> DataFrame:
    """Communities by first path segment; those above the given size go by two segments (CO3). Sizes are joined, so a large one isn't gathered."""
    keyed = nodes.select("id", F.substring_index("path", "/", 1).alias("top"), F.substring_index("path", "/", 2).alias("two"))
    size = keyed.groupBy("top").agg(F.count("*").alias("size"))
    key = F.when(F.col("size") > most, F.col("two")).otherwise(F.col("top"))
    return keyed.join(size, "top").groupBy(key.alias("community")).agg(F.count("*").alias("members"))


def crossing_weights(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges between members of different communities, summed by the pair of communities (AG4). member: id, community."""
    end = lambda c, name: member.select(F.col("id").alias(c), F.col("community").alias(name))
    pair = edges.join(end("src", "from_community"), "src").join(end("dst", "to_community"), "dst").filter("from_community <> to_community")
    return pair.groupBy("from_community", "to_community").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def neighbours_by_kind(edges: DataFrame, ids: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct neighbours of the ids in either direction through edges of the kinds (JO12, GR20)."""
    e = edges.filter(F.col("kind").isin(kinds))
    out = lambda a, b: e.select(F.col(a).alias("id"), F.col(b).alias("neighbour")).join(ids.select("id"), "id", "left_semi")
    return out("src", "dst").unionByName(out("dst", "src")).distinct()


def ready(tasks: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks with no need left undone (JO15, PR8). needs: id, needs; done: id."""
    open_needs = needs.join(done.select(F.col("id").alias("needs")), "needs", "left_anti")
    return tasks.join(open_needs.select("id"), "id", "left_anti")


def freshness(events: DataFrame, scan: str, touch: str) -> DataFrame:
    """Each node's last scan against its last touch: missing, stale or fresh (PR11); a node of neither kind is left out."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    out = events.groupBy("node_id").agg(last(scan).alias("scanned"), last(touch).alias("touched")).filter("scanned IS NOT NULL OR touched IS NOT NULL")
    return out.withColumn("state", F.when(F.col("scanned").isNull(), "missing").when(F.col("touched") > F.col("scanned"), "stale").otherwise("fresh"))


def within_budget(rows: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """The first rows of each group whose sizes together stay within the budget (TK12)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def unique_slugs(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """Repeated slugs get -1, -2 and so on in order (WI10)."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order)) - 1
    return rows.withColumn("unique_slug", F.when(n > 0, F.concat_ws("-", slug, n.cast("string"))).otherwise(F.col(slug)))
