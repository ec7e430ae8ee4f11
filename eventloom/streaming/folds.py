"""Run events as streams with state: the fold of nodes, open spans, sampling and histograms.

State is kept by graph and node; events of a node come in order of seq within a batch and after its earlier batches, as the
log appends them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.operators.runs import STATES, sampling_reason

NODE = "graph_id string, node_id string, status string, seq long"
SPAN = "graph_id string, node_id string, begin_seq long, end_seq long, status string"


def node_states(events: DataFrame) -> DataFrame:
    """The status of each node after each batch that touches it: a new plan starts it anew, events before one don't count (ST2)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seq = state.get if state.exists else (None, -1)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.kind == "node.planned":
                status, seq = "pending", r.seq
            elif status is not None and r.kind in STATES:
                status, seq = STATES[r.kind], r.seq
        if status is not None:
            state.update((status, int(seq)))
            yield pd.DataFrame([(*key, status, int(seq))], columns=["graph_id", "node_id", "status", "seq"])

    few = events.filter("node_id IS NOT NULL").select("graph_id", "node_id", "kind", "seq")
    return few.groupBy("graph_id", "node_id").applyInPandasWithState(fold, NODE, "status string, seq long", "update", GroupStateTimeout.NoTimeout)


def spans(events: DataFrame, timeout: str | None = None) -> DataFrame:
    """Spans as they close: an executing event opens one, the first completed or failed event closes it (ST4).

    A new executing event replaces an open span. With a timeout (milliseconds of processing time) forgotten ones are dropped.
    """

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, out = state.get[0] if state.exists else None, []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.kind == "node.executing":
                begin = r.seq
            elif begin is not None:
                out.append((*key, int(begin), int(r.seq), "error" if r.kind == "node.failed" else "ok"))
                begin = None
        if begin is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(begin),))
            if timeout is not None:
                state.setTimeoutDuration(int(timeout))
        yield pd.DataFrame(out, columns=["graph_id", "node_id", "begin_seq", "end_seq", "status"])

    few = events.filter("kind IN ('node.executing', 'node.completed', 'node.failed')").select("graph_id", "node_id", "kind", "seq")
    kind = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout
    return few.groupBy("graph_id", "node_id").applyInPandasWithState(pair, SPAN, "begin long", "append", kind)


def sampled(events: DataFrame) -> DataFrame:
    """Events with why their payload is kept whole; healthy, fast and sure ones lose theirs (ST5)."""
    rows = events.withColumn("kept_for", sampling_reason())
    small = F.col("kept_for").isNull()
    return rows.select(*[c if c not in ("tools", "commands", "files", "checksums") else F.when(~small, F.col(c)).alias(c) for c in events.columns], "kept_for")


def duration_counts(events: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts since the stream's start, with sum and count, for complete output (ST7)."""
    v = F.col(value)
    return events.filter(v.isNotNull()).groupBy().agg(*[F.count(F.when(v <= b, 1)).alias(f"le_{b}") for b in bounds], F.count("*").alias("count"), F.sum(v).alias("sum"))
