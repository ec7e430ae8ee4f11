"""Graph and event views over the star-schema tables, and their SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, label, path: regions as communities, nations as directories, customers, suppliers, parts and orders below."""
    t = lambda name: table(spark, sf_dir, name)
    region, nation = t("region"), t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda df, prefix, key, kind, label, path: df.select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), path.alias("path"))
    under = lambda name: F.concat_ws("/", "r_name", "n_name", name)
    places = nation.select("n_nationkey", "n_name", "r_name")  # 25 rows by the schema
    customer = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        row(region, "r:", "r_regionkey", "community", "r_name", F.col("r_name")),
        row(nation, "n:", "n_nationkey", "directory", "n_name", F.concat_ws("/", "r_name", "n_name")),
        row(customer, "c:", "c_custkey", "code_file", "c_name", under("c_name")),
        row(supplier, "s:", "s_suppkey", "config_file", "s_name", under("s_name")),
        row(t("part"), "p:", "p_partkey", "symbol", "p_name", F.concat_ws("/", F.lit("part"), "p_brand", "p_name")),
        row(t("orders").withColumn("label", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))), "o:", "o_orderkey", "test", "label",
            F.concat_ws("/", F.lit("orders"), "o_orderpriority", F.col("o_orderkey").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, provenance, weight."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation = F.broadcast(t("nation").select("n_nationkey", "n_regionkey"))
    one = lambda src, dst, kind: [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit("extracted").alias("provenance"), F.lit(1).cast("long").alias("weight")]
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*one(key("c:", "c_custkey"), key("r:", "n_regionkey"), "belongs_to"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*one(key("s:", "s_suppkey"), key("r:", "n_regionkey"), "belongs_to"))
    order = t("orders").select(*one(key("o:", "o_orderkey"), key("c:", "o_custkey"), "belongs_to"))
    provenance = F.element_at(F.create_map(*[F.lit(x) for x in ("N", "extracted", "R", "inferred", "A", "ambiguous")]), F.min("l_returnflag"))
    lines = t("lineitem")
    n = lines.count()  # by the files' footers
    # dealt by one key, the pairs are grouped where they lie, in shares of a fixed size
    depends = dealt(lines.select("l_orderkey", "l_partkey", "l_returnflag"), n, "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(provenance.alias("provenance"), F.count("*").alias("weight")).select(
        key("o:", "l_orderkey").alias("src"), key("p:", "l_partkey").alias("dst"), F.lit("depends_on").alias("kind"), "provenance", "weight")
    refers = dealt(lines.select("l_partkey", "l_suppkey"), n, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight")).select(
        key("p:", "l_partkey").alias("src"), key("s:", "l_suppkey").alias("dst"), F.lit("references").alias("kind"), F.lit("extracted").alias("provenance"), "weight")
    return customer.unionByName(supplier).unionByName(order).unionByName(depends).unionByName(refers)


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, seq, kind, node_id, ts, value, event_id; seq numbers the events of a graph by time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("graph_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").alias("node_id"), "ts", "value", "event_id")


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, kind, ts, payload, seq: an upsert for each order, an archive for each returned line."""
    up = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("product.node.upserted").alias("kind"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("payload"), F.lit(0).alias("line"))
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("node_id"), F.lit("product.node.archived").alias("kind"),
        F.col("l_shipdate").alias("ts"), F.lit(None).cast("string").alias("payload"), F.col("l_linenumber").alias("line"))
    order = Window.partitionBy("node_id").orderBy("ts", F.desc("kind"), "line")
    return up.unionByName(gone).withColumn("seq", F.row_number().over(order).cast("long")).drop("line")


NODES_SQL = """v_nodes AS (
SELECT 'r:' || r_regionkey AS id, 'community' AS kind, r_name AS label, r_name AS path FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'directory', n_name, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c:' || c_custkey, 'code_file', c_name, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's:' || s_suppkey, 'config_file', s_name, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'p:' || p_partkey, 'symbol', p_name, 'part/' || p_brand || '/' || p_name FROM part
UNION ALL SELECT 'o:' || o_orderkey, 'test', 'order ' || o_orderkey, 'orders/' || o_orderpriority || '/' || o_orderkey FROM orders)"""
EDGES_SQL = """v_edges AS (
SELECT 'c:' || c_custkey AS src, 'r:' || n_regionkey AS dst, 'belongs_to' AS kind, 'extracted' AS provenance, 1::BIGINT AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 's:' || s_suppkey, 'r:' || n_regionkey, 'belongs_to', 'extracted', 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'belongs_to', 'extracted', 1 FROM orders
UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'depends_on', CASE min(l_returnflag) WHEN 'N' THEN 'extracted' WHEN 'R' THEN 'inferred' ELSE 'ambiguous' END, count(*) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'references', 'extracted', count(*) FROM lineitem GROUP BY l_partkey, l_suppkey)"""
RUN_SQL = """v_run AS (SELECT user_id AS graph_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq, event_type AS kind,
json_extract_string(props, '$.k') AS node_id, ts, value, event_id FROM events)"""
PRODUCT_SQL = """v_raw AS (SELECT 'o:' || o_orderkey AS node_id, 'product.node.upserted' AS kind, o_orderdate AS ts, o_orderpriority AS payload, 0 AS line FROM orders
UNION ALL SELECT 'o:' || l_orderkey, 'product.node.archived', l_shipdate, NULL, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
v_product AS (SELECT node_id, kind, ts, payload, row_number() OVER (PARTITION BY node_id ORDER BY ts, kind DESC, line)::BIGINT AS seq FROM v_raw)"""
