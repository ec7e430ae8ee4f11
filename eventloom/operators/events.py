"""Folds of append-only event logs into projections, without a sequential pass: last events by sequence, windows, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import versions


def projection(events: DataFrame, key: str, upsert: str) -> DataFrame:
    """Visible items: those whose last event is an upsert, with its payload and the sequence number first seen."""
    last = events.groupBy(key).agg(F.max_by(F.struct("kind", "payload", "ts"), "seq").alias("last"), F.min("seq").alias("first_seq"), F.count("*").alias("n_events"))
    return last.filter(F.col("last.kind") == upsert).select(key, "last.payload", "last.ts", "first_seq", "n_events")


def append(log: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The batch with sequence numbers that follow each log's largest one (SR1, SR2); ``versions.append`` commits a batch."""
    top = log.groupBy(key).agg(F.max("seq").alias("top"))
    return versions.numbered(batch, [order], [key]).join(top, key, "left").withColumn("seq", F.coalesce("top", F.lit(0)) + F.col("seq")).drop("top")


def run_control(events: DataFrame, states: dict[str, str]) -> DataFrame:
    """State of each graph by its last state event; idle without one."""
    to = F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), F.col("kind"))
    return events.groupBy("graph_id").agg(F.coalesce(F.max_by(F.when(to.isNotNull(), to), F.when(to.isNotNull(), F.col("seq"))), F.lit("idle")).alias("state"), F.max("seq").alias("last_seq"))


def node_status(events: DataFrame) -> DataFrame:
    """Last kind, time and value of each node of each graph, and how often it changed kind."""
    w = Window.partitionBy("graph_id", "node_id").orderBy("seq")
    changed = F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(0))
    return events.withColumn("changed", changed).groupBy("graph_id", "node_id").agg(
        F.max_by("kind", "seq").alias("status"), F.max("ts").alias("last_ts"), F.max_by("value", "seq").alias("last_value"), F.sum("changed").alias("changes"))


def health(events: DataFrame, bad: str) -> DataFrame:
    """Share of bad events by graph, with the longest run of them; zero denominators give zero."""
    w = Window.partitionBy("graph_id").orderBy("seq")
    is_bad = (F.col("kind") == bad).cast("int")
    island = F.col("seq") - F.sum(is_bad).over(w)  # equal within a run of bad events
    runs = events.select("graph_id", is_bad.alias("bad"), island.alias("island"))
    longest = runs.filter("bad = 1").groupBy("graph_id", "island").agg(F.count("*").alias("n")).groupBy("graph_id").agg(F.max("n").alias("longest_bad_run"))
    total = events.groupBy("graph_id").agg(F.count("*").alias("n_events"), F.sum(is_bad).alias("n_bad"))
    return total.join(longest, "graph_id", "left").select(
        "graph_id", "n_events", "n_bad", F.coalesce("longest_bad_run", F.lit(0)).cast("long").alias("longest_bad_run"),
        F.round(F.when(F.col("n_events") > 0, F.col("n_bad") / F.col("n_events")).otherwise(0.0), 6).alias("bad_share"))


def drift(events: DataFrame, window: int = 5) -> DataFrame:
    """Moving mean of the values against the mean before it, with a direction; higher values are better."""
    w = Window.partitionBy("graph_id").orderBy("seq")
    now = F.avg("value").over(w.rowsBetween(-(window - 1), 0))
    before = F.avg("value").over(w.rowsBetween(-(2 * window - 1), -window))
    out = events.select("graph_id", "seq", F.round(now, 4).alias("mean_now"), F.round(before, 4).alias("mean_before"))
    gap = F.col("mean_now") - F.col("mean_before")
    return out.withColumn("direction", F.when(gap > 0, "improving").when(gap < 0, "worsening").otherwise("stable"))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Sessions of each graph: a gap of more than gap_seconds begins a new one."""
    w = Window.partitionBy("graph_id").orderBy("seq")
    new = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("graph_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts"))


def spans(events: DataFrame, begin: str, end: str) -> DataFrame:
    """Pairs each begin event with the first end event of its graph and node after it and before the next begin (SR22)."""
    w = Window.partitionBy("graph_id", "node_id").orderBy("seq")
    e = events.filter(F.col("kind").isin(begin, end)).withColumn("next", F.lead(F.struct("kind", "seq", "ts")).over(w))
    out = e.filter((F.col("kind") == begin) & (F.col("next.kind") == end))
    return out.select("graph_id", "node_id", F.col("seq").alias("begin_seq"), F.col("next.seq").alias("end_seq"), (F.unix_micros(F.col("next.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros"))


def dashboard(events: DataFrame, bad: str, k: int) -> DataFrame:
    """The k graphs that need most attention: bad events, then latest activity, then id."""
    rows = events.groupBy("graph_id").agg(F.count(F.when(F.col("kind") == bad, 1)).alias("n_bad"), F.max("ts").alias("last_ts"), F.countDistinct("node_id").alias("n_nodes"))
    return rows.orderBy(F.desc("n_bad"), F.desc("last_ts"), "graph_id").limit(k)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """added, removed, changed or same for every key of two snapshots: one full outer join on the key."""
    a, b = before.select(key, F.col(digest).alias("old")), after.select(key, F.col(digest).alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
