"""Logs and graphs that change as a whole: numbers without a single task, batches and versions that are there once committed.

A batch or version is written beside what is there, under a number of its own; a one-row table of that number is its commit,
written last. Readers go by the commits, so what a failed job left behind is never seen, and the next job writes under another
name. Two jobs that commit the same number at once: the second fails, as its commit is there already.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators import workspace as w
from eventloom.session import kept


def numbered(rows: DataFrame, order: list[str], keys: list[str] = ()) -> DataFrame:
    """rows with seq: their place from 1 on in the given order, of each key for itself (SR2, SR19).

    Ranges of keys and order are sorted apart and written with the place of each row in its range; what a range adds to those
    before it is a prefix sum over one row a range and key. A key with very many rows has several ranges.
    """
    keys = list(keys)
    parts = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id()  # the number of the range in the upper bits, the place in it in the lower 33
    placed = kept(parts.withColumns({"part_": F.shiftright(at, 33), "at_": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    ends = placed.groupBy(*keys, "part_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base_", F.coalesce(F.sum("n_").over(before), F.lit(0))).select(F.col("part_").alias("of_"), *[F.col(k).alias(f"of_{k}") for k in keys], "base_", "first_")
    same = F.col("part_") == F.col("of_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return placed.join(ends, same).select(*rows.columns, (F.col("base_") + F.col("at_") - F.col("first_") + 1).cast("long").alias("seq"))


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """number, name of what is committed below a path."""
    try:
        return spark.read.schema("number long, name string").parquet(f"{path}/commits/*")
    except AnalysisException:
        return None


def _commit(spark: SparkSession, path: str, number: int, name: str) -> None:
    spark.createDataFrame([(number, name)], "number long, name string").coalesce(1).write.mode("error").parquet(f"{path}/commits/{number:012}")


def append(path: str, batch: DataFrame, key: str, order: str) -> int:
    """Adds a batch to the log below a path as a whole, numbered on from each key's last event; its number (SR1, SR2)."""
    spark = batch.sparkSession
    done = _commits(spark, path)
    number = 1 + (done.agg(F.max("number")).first()[0] or 0 if done is not None else 0)
    rows = numbered(batch, [order], [key])
    log = events(spark, path)
    if log is not None:
        top = log.groupBy(key).agg(F.max("seq").alias("top_"))
        rows = rows.join(top, key, "left").withColumn("seq", F.col("seq") + F.coalesce("top_", F.lit(0))).drop("top_")
    name = uuid.uuid4().hex
    rows.write.mode("error").parquet(f"{path}/data/batch={name}")
    _commit(spark, path, number, name)
    return number


def events(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed events of the log below a path; None before the first commit."""
    done = _commits(spark, path)
    if done is None:
        return None
    return spark.read.parquet(f"{path}/data").join(done.select(F.col("name").alias("batch")), "batch", "left_semi").drop("batch")


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame] | None:
    """version, nodes, edges and manifest of a graph's last version, or of one that is asked for; None where there is none (IN4)."""
    done = _commits(spark, path)
    row = None if done is None else (done if version is None else done.filter(F.col("number") == version)).orderBy(F.desc("number")).first()
    if row is None:
        return None
    return {"version": row["number"]} | {t: spark.read.parquet(f"{path}/versions/{row['name']}/{t}") for t in ("nodes", "edges", "manifest")}


def publish(path: str, nodes: DataFrame, edges: DataFrame, manifest: DataFrame) -> int:
    """Writes a graph with its manifest as a new version, which is there for readers once all of it is."""
    spark = nodes.sparkSession
    now = snapshot(spark, path)
    number, name = 1 + (now["version"] if now else 0), uuid.uuid4().hex
    for table, rows in (("nodes", nodes), ("edges", edges), ("manifest", manifest)):
        rows.write.mode("error").parquet(f"{path}/versions/{name}/{table}")
    _commit(spark, path, number, name)
    return number


def update(path: str, fingerprints: DataFrame, scan: Callable[[DataFrame | None], tuple[DataFrame, DataFrame]]) -> tuple[str, int]:
    """Brings the graph below a path up to a workspace's fingerprints (path, size, hash, rules): mode and version (IN2, IN4).

    scan(paths) gives the nodes and edges of a table of paths, of the whole workspace without one. Nothing changed: the version
    stays. Few files changed: they and what may depend on them are taken out, scanned and merged in. Else all is scanned.
    A job that fails leaves the last version as it was.
    """
    spark = fingerprints.sparkSession
    now = snapshot(spark, path)
    mode = "full"
    if now:
        diff = kept(w.changes(now["manifest"], fingerprints), "update_diff")
        touched = diff.filter("change <> 'unchanged'").select("path")
        near = kept(w.neighbour_paths(now["nodes"], now["edges"], touched), "update_near")
        rules = {r["rules"] for r in now["manifest"].select("rules").union(fingerprints.select("rules")).distinct().limit(2).collect()}
        mode, _ = w.plan(diff, near, same_rules=len(rules) <= 1)
    if mode == "noop":
        return mode, now["version"]
    if mode == "full":
        nodes, edges = scan(None)
    else:
        gone = diff.filter("change IN ('changed', 'deleted')").select("path").union(near).distinct()
        again = diff.filter("change IN ('added', 'changed')").select("path").union(near.join(fingerprints.select("path"), "path", "left_semi")).distinct()
        nodes, edges = w.updated(now["nodes"], now["edges"], *scan(kept(again, "update_paths")), kept(gone, "update_gone"))
    return mode, publish(path, nodes, edges, fingerprints)
