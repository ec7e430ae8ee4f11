"""Small graphs and logs with results worked out by hand, and the registered queries against their SQL."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.functions import text
from eventloom.operators import events as ev
from eventloom.operators import graph as g
from eventloom.operators import insights as ins
from eventloom.operators import paths as p
from eventloom.plans import catalog
from eventloom.streaming import replay

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(x, "code_file", f"label {x}", f"src/{x}.py") for x in "abcd"], "id string, kind string, label string, path string")
    rows = [("a", "b", "calls", "extracted", 1), ("b", "c", "calls", "inferred", 2), ("c", "b", "calls", "extracted", 1), ("a", "x", "calls", "extracted", 1)]
    return nodes, spark.createDataFrame(rows, "src string, dst string, kind string, provenance string, weight long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_traversal_and_degree(graph):
    nodes, edges = graph
    assert rows(g.bfs(edges, nodes.filter("id = 'a'"), 2)) == [("a", 0), ("b", 1), ("c", 2), ("x", 1)]
    assert rows(g.degree(edges).filter("id = 'b'")) == [("b", 1, 2, 3)]
    assert rows(g.two_cycles(edges)) == [("b", "c")]
    assert rows(g.impact(edges, nodes.filter("id = 'c'"), 5)) == [("a", 2), ("b", 1), ("c", 0)]


def test_edge_sets(graph):
    nodes, edges = graph
    assert [r[1] for r in rows(g.dangling(nodes, edges))] == ["x"]
    assert len(rows(g.induced(nodes, edges))) == 3
    assert [r[0] for r in rows(g.orphans(nodes, edges))] == ["d"]


def test_paths_take_the_cheapest(graph):
    nodes, edges = graph
    found = rows(g.cheapest_paths(edges, nodes.filter("id = 'a'"), F.col("weight").cast("double"), 3))
    assert found == [("a", 0.0, 0), ("b", 1.0, 1), ("c", 3.0, 2), ("x", 1.0, 1)]


def test_projection_by_last_event(spark):
    log = spark.createDataFrame([("n", "up", "1", 1), ("n", "up", "2", 2), ("m", "up", "1", 1), ("m", "gone", None, 2)], "k string, kind string, payload string, seq int").withColumn("ts", F.lit(0))
    assert [(r["k"], r["payload"], r["first_seq"]) for r in ev.projection(log, "k", "up").collect()] == [("n", "2", 1)]


def test_health_counts_the_longest_run(spark):
    log = spark.createDataFrame([("g", i, k) for i, k in enumerate("ok bad bad ok bad".split(), 1)], "graph_id string, seq int, kind string")
    assert rows(ev.health(log, "bad")) == [("g", 5, 3, 2, 0.6)]


def test_rounding_and_cosine(spark):
    row = spark.range(1).select(text.half_up(F.lit(-2.5)).alias("a"), text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("b"), text.slug(F.lit(" A b--C! ")).alias("c")).first()
    assert tuple(row) == (-2, 0.0, "a-b-c")


def test_stream_replays_all_events(spark, tmp_path):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "view", 1.0) for h in (0, 0, 1, 9)], "ts timestamp, event_type string, value double")
    log.write.parquet(str(tmp_path / "log"))
    out = replay.drained(replay.windowed_counts(replay.event_stream(spark, str(tmp_path / "log"), "*.parquet")), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r["begin_ts"].hour, r["n"]) for r in out.collect()) == [(0, 2), (1, 1)]  # the last hour is still open


def normal(frame):
    cell = lambda y: None if y is None or y is pd.NA or y is pd.NaT or y != y else round(float(y), 5) if isinstance(y, (int, float)) and not isinstance(y, bool) else str(y)
    return sorted((tuple(str(cell(y)) for y in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()))


@pytest.fixture(scope="module")
def answers(spark):
    """The registered queries' results, several at a time: planning many small queries takes longer than running them."""
    queries = entry.queries()
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(lambda q: q(spark, SF).toPandas(), queries[n]) for n in sorted(catalog.ORACLES)}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(answers, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = answers[name].result(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_pending_controls_and_steps(spark):
    log = [("a", "up"), ("a", "wait"), ("b", "up"), ("b", "halt"), ("b", "hold"), ("c", "wait"), ("d", "up"), ("d", "wait"), ("d", "hold")]
    events = spark.createDataFrame([(g_, i, k) for i, (g_, k) in enumerate(log)], "graph_id string, seq long, kind string")
    roles = {"up": "running", "hold": "paused", "wait": "pause_requested", "halt": "stop_requested"}
    assert rows(ins.pending_control(events, roles)) == [("a", "running", "pause"), ("b", "paused", "stop"), ("c", "idle", "none"), ("d", "paused", "none")]
    assert rows(ins.ordered_steps(events.withColumn("seq", F.col("seq") + 1), ["up", "hold", "wait"])) == [("a", 1), ("b", 2), ("c", 0), ("d", 2)]


def test_levels_roots_and_tokens(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert rows(p.levels(edges)) == [("a", 0), ("b", 1), ("c", 2)]
    paths = spark.createDataFrame([("1", "x/y/z"), ("2", "x/yy"), ("3", "q")], "id string, path string")
    assert rows(ins.nearest_root(paths, spark.createDataFrame([("x",), ("x/y",)], "root string"))) == [("1", "x/y"), ("2", "x")]
    assert spark.range(1).select(ins.tokens(F.lit("A bc, D-ef9")).alias("t"), ins.tokens(F.lit(None).cast("string")).alias("n")).first() == (["bc", "ef9"], [])
