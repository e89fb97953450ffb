"""Structured Streaming forms of the counters and filters: the graph's nodes and edges, shown cards, error counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemoframe.operators import graph


def node_counts(led: DataFrame) -> DataFrame:
    """Running (persona_id, node, cards) of a ledger stream with one row per card and node."""
    return led.groupBy("persona_id", "node").agg(F.count("*").alias("cards"))


def merge_graph(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch step: a batch's node and edge counts are written under its number, so a batch that is retried counts once."""
    graph.nodes(batch).write.mode("overwrite").parquet(f"{path}/nodes/batch={batch_id}")
    graph.edges(batch).write.mode("overwrite").parquet(f"{path}/edges/batch={batch_id}")


def merged_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(persona_id, name, df, last_seen) of all batches."""
    return spark.read.parquet(f"{path}/nodes").groupBy("persona_id", "name").agg(F.sum("df").alias("df"), F.max("last_seen").alias("last_seen"))


def merged_edges(spark: SparkSession, path: str) -> DataFrame:
    """(persona_id, a, b, weight, last_seen) of all batches."""
    return spark.read.parquet(f"{path}/edges").groupBy("persona_id", "a", "b").agg(F.sum("weight").alias("weight"), F.max("last_seen").alias("last_seen"))


def first_shown(shown: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each (session_id, card_id) of a stream once: drawing without putting back."""
    return shown.withWatermark(ts, late).dropDuplicatesWithinWatermark(["session_id", "card_id"])


def errors_per_window(events: DataFrame, ts: str = "ts", seconds: int = 300, late: str = "10 minutes", slide: int | None = None) -> DataFrame:
    """(window_start, errors) by event time; with ``slide`` a window begins every so many seconds, so each error counts in several."""
    window = F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds")
    return events.filter("event_type = 'error'").withWatermark(ts, late).groupBy(window.alias("w")).agg(F.count("*").alias("errors")).select(F.col("w.start").alias("window_start"), "errors")


def summaries_due(led: DataFrame, min_new: int = 3) -> DataFrame:
    """(persona_id, node, times, left) of a ledger stream: how often a node has got ``min_new`` new cards, and how many are left over.

    The counter of each node is kept state. times adds up to the node's cards over min_new, rounded down, in whatever order and batches
    they come, also across restarts from a checkpoint.
    """

    def count(key: tuple[str, str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(r) for r in rows)
        state.update((n % min_new,))
        if n >= min_new:
            yield pd.DataFrame({"persona_id": [key[0]], "node": [key[1]], "times": [n // min_new], "left": [n % min_new]})

    kinds = "persona_id string, node string, times long, left long"
    return led.select("persona_id", "node", "card_id").groupBy("persona_id", "node").applyInPandasWithState(count, kinds, "new long", "append", GroupStateTimeout.NoTimeout)
