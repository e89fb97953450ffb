"""Feature log: structured events as JSON lines, read back by module; counts of recent errors."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Events kept in memory, bytes of a file and files kept, seconds in which errors count as recent.
RECENT, MOST, KEEP, SECONDS = 200, 5_000_000, 3, 300
SCHEMA = "ts double, module string, event string, trace_id string, data string"
_TRACE: ContextVar[str] = ContextVar("trace", default="")


def new_trace_id() -> str:
    _TRACE.set(out := uuid.uuid4().hex[:12])
    return out


class FeatureLog:
    """The last ``size`` events in memory, and all in files of at most ``most`` bytes, ``keep`` of them."""

    def __init__(self, path: str | None = None, size: int = RECENT, most: int = MOST, keep: int = KEEP):
        self.recent, self.path, self.most, self.keep = deque(maxlen=size), Path(path) if path else None, most, keep

    def add(self, module: str, event: str, **data) -> None:
        row = {"ts": time.time(), "module": module, "event": event, "trace_id": _TRACE.get(), "data": json.dumps(data, ensure_ascii=False)}
        self.recent.append(row)
        if self.path:
            if self.path.exists() and self.path.stat().st_size > self.most:
                for k in range(self.keep - 1, 0, -1):
                    older = self.path.with_suffix(f".{k}.jsonl")
                    if older.exists():
                        older.replace(self.path.with_suffix(f".{k + 1}.jsonl"))
                self.path.replace(self.path.with_suffix(".1.jsonl"))
                old = self.path.with_suffix(f".{self.keep + 1}.jsonl")
                old.unlink(missing_ok=True)
            with self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps(row, ensure_ascii=False) + "\n")

    def tail(self, n: int = 50, module: str | None = None) -> list[dict]:
        return [r for r in self.recent if module is None or r["module"] == module][-n:]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def error_rate(events: DataFrame, ts: str = "ts", seconds: int = SECONDS) -> DataFrame:
    """Errors per window of ``seconds``; for batches and streams."""
    return events.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("errors")).select(F.col("w.start").alias("window_start"), "errors")


def recent_errors(errors: DataFrame, ts: str = "ts", seconds: int = SECONDS) -> DataFrame:
    """errors plus ``recent``: how many of them, itself included, came in the ``seconds`` up to it.

    Each error is put into the bucket of its time and, as context, into the next one, so buckets are counted side by side.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = F.floor(at / (seconds * 1_000_000))
    rows = errors.withColumn("_at", at).withColumn("_own", bucket).withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    window = Window.partitionBy("_bucket").orderBy("_at").rangeBetween(1 - seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.count("*").over(window)).filter("_own = _bucket").drop("_at", "_own", "_bucket")
