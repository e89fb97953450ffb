"""From raw documents to shards: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import decontaminate, langid, mixing, sharding, simhash
from mnemoframe.llm._common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null texts included), whose language can't be told; all others stay, those without a lang with the one found.

    Where no row that may be learned from has a lang, no language can be told: all documents with a letter stay as they are. Repeated
    rows all stay, an empty table gives an empty one, and columns of any name are passed on.
    """
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    told = F.col("lang_pred") != langid.UNDETERMINED
    if not model.languages:
        told = F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))
    told = langid.identify(docs, model).filter(told)
    lang = F.coalesce(F.col("row.lang"), F.nullif(F.col("lang_pred"), F.lit(langid.UNDETERMINED))).alias("lang")
    return told.select(*[lang if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles shared) stays: the first by doc_id.

    Repeated rows are near copies of each other; rows without a doc_id come last. An empty table gives an empty one.
    """
    return simhash.deduplicate(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all of a shorter one) go; an empty benchmark takes none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go by their source's rate; a null source is a source. Repeated rows of one doc_id fare alike."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ``size`` and their ``shard`` of 16 (columns of these names are replaced); equal texts share a shard."""
    return sharding.assign(docs, 16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", shards),
]

#: Language ID has no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
