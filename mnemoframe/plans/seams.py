"""What a host plugs in: language models, encoder, reranker, context. Each is a plain callable; the defaults are deterministic."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (prompts, persona ids) -> replies; null for none.
Model = Callable[[list[str], list[str]], list[str | None]]


def silent(prompts: list[str], personas: list[str]) -> list[str | None]:
    """A model that says nothing."""
    return [None] * len(prompts)


def hashed_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Encoder stub: word counts hashed into ``size`` places."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                out[i, int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") % size] += 1
        return out

    return encode


@dataclass
class Seams:
    subbrain: Model = silent
    main_brain: Model = silent
    encode: Callable[[list[str]], np.ndarray] = field(default_factory=hashed_encoder)
    #: (query texts, card texts) -> scores; None keeps the order by energy.
    rerank: Callable[[list[str], list[str]], list[float]] | None = None
    #: session id -> card ids already shown.
    injected: Callable[[str], set[str]] = lambda session_id: set()


def ask(rows: DataFrame, model: Model, prompt: str = "prompt", persona: str = "persona_id", reply: str = "raw") -> DataFrame:
    """rows plus the model's replies, asked for in the workers, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = model(b[prompt].to_pylist(), b[persona].to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, reply])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{reply}` string")


def rerank(hits: DataFrame, score: Callable[[list[str], list[str]], list[float]] | None, k: int) -> DataFrame:
    """hits (query_id, text, content, card_id, energy) by the cross-encoder's score, or by energy without one; the first k of each query."""
    from pyspark.sql import Window

    if score is None:
        out = hits.withColumn("rerank_score", F.col("energy"))
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = score(b["text"].to_pylist(), b["content"].to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(x) for x in s])], names=[*b.schema.names, "rerank_score"])

        out = hits.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", rerank_score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "card_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
