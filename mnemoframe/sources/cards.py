"""Memory cards: schema, normalisation on read, JSON and JSONL files, and the mapping from document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions.text import normalize_level

LINK = "struct<target_id:string,relation:string,weight:double>"
EDIT = "struct<timestamp:string,old_content:string,reason:string>"
BUFFER = "struct<date:string,summary:string>"

_TEXT, _LONG, _BOOL, _DOUBLE, _TIME = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _records(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


_BUFFER = _records(date=_TEXT, summary=_TEXT)
#: A card. seq is the order of arrival within its persona.
CARD = T.StructType([
    T.StructField(name, kind)
    for name, kind in {
        "persona_id": _TEXT, "seq": _LONG, "id": _TEXT, "level": T.IntegerType(), "content": _TEXT, "keywords": T.ArrayType(_TEXT), "tags": T.ArrayType(_TEXT),
        "links": _records(target_id=_TEXT, relation=_TEXT, weight=_DOUBLE), "created_at": _TIME, "last_updated": _TIME, "last_referenced": _TIME, "reference_count": _LONG,
        "source": _TEXT, "session_id": _TEXT, "source_time": _TEXT, "subject": _TEXT, "topic": _TEXT, "annotations": T.ArrayType(_TEXT),
        "edit_history": _records(timestamp=_TEXT, old_content=_TEXT, reason=_TEXT), "card_type": _TEXT, "retention": _DOUBLE, "last_decay_at": _TIME, "needs_review": _BOOL,
        "legacy": _BOOL, "is_portrait": _BOOL, "portrait_type": _TEXT, "stable": _TEXT, "mid_term": _TEXT, "recent_buffer": _BUFFER, "staging_pool": _BUFFER,
    }.items()
])
# States of old cards, fields and link relations that are no longer part of a card.
GONE_STATES = ("deleted", "superseded", "merged")
LEGACY_STATES = ("legacy", "archived")
DEAD_FIELDS = ("clarity", "significance", "status", "draft_id", "fatigue", "_wake_signal", "_collision_report", "confidence", "context", "continues_from", "source_seq")
#: Folders beside the personas' own.
RESERVED = ("exports", "summaries", "mem0", "episodic")
DEAD_RELATIONS = ("related", "extends", "extended_by", "contradicts")


def conform(df: DataFrame) -> DataFrame:
    """df with all columns of a card in order and of its types; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CARD.fields])


def normalize(df: DataFrame) -> DataFrame:
    """Cards as stored, in today's schema.

    Rows without an id are dropped (unreadable rows). A ``status`` of a gone state drops the card and a legacy state marks
    it. Level is brought to a whole number; experience cards of level 0 get their type and retention, every card an update
    time. Dead fields go, and so do links of dead relations or to cards that aren't there.
    """
    df = df.filter("id IS NOT NULL")
    if "status" in df.columns:
        state = F.lower(F.coalesce("status", F.lit("")))
        legacy = F.coalesce(F.col("legacy"), F.lit(False)) if "legacy" in df.columns else F.lit(False)
        df = df.filter(~state.isin(*GONE_STATES)).withColumn("legacy", legacy | state.isin(*LEGACY_STATES))
    if "level" in df.columns:
        df = df.withColumn("level", normalize_level(F.col("level")))
    df = conform(df.drop(*DEAD_FIELDS))
    df = df.withColumn("level", F.coalesce("level", F.lit(0)))
    df = df.withColumn("card_type", F.when(F.col("level") == 0, F.coalesce("card_type", F.lit("experience"))).otherwise(F.col("card_type")))
    experience = (F.col("level") == 0) & (F.col("card_type") == "experience")
    df = df.withColumn("retention", F.when(experience, F.coalesce("retention", F.lit(8.0))).otherwise(F.col("retention")))
    df = df.withColumn("last_updated", F.coalesce("last_updated", "created_at")).withColumn("legacy", F.coalesce("legacy", F.lit(False)))
    return prune_links(df)


def prune_links(cards: DataFrame) -> DataFrame:
    """Cards without links of dead relations and without links to missing cards of their persona."""
    each = cards.select("persona_id", "id", F.posexplode("links").alias("pos", "link")).filter(~F.coalesce(F.col("link.relation"), F.lit("")).isin(*DEAD_RELATIONS))
    there = cards.select(F.col("persona_id").alias("p"), F.col("id").alias("target"))
    live = each.join(there, (F.col("persona_id") == F.col("p")) & (F.col("link.target_id") == F.col("target")), "left_semi")
    kept = live.groupBy("persona_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("_links"))
    return cards.join(kept, ["persona_id", "id"], "left").withColumn("links", F.coalesce("_links", F.array().cast(f"array<{LINK}>"))).select(*CARD.names)


def from_json_rows(df: DataFrame, json: str = "data") -> DataFrame:
    """Cards from rows that hold one JSON object each; objects that can't be read are skipped."""
    fields = T.StructType([f for f in CARD.fields if f.name not in ("persona_id", "seq", "level")])
    schema = fields.add("level", T.StringType()).add("status", T.StringType())
    return normalize(df.select("persona_id", "seq", F.from_json(json, schema, {"mode": "PERMISSIVE"}).alias("c")).select("persona_id", "seq", "c.*"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def active(cards: DataFrame) -> DataFrame:
    return cards.filter(~F.coalesce("legacy", F.lit(False)))


def searchable(cards: DataFrame) -> DataFrame:
    """Active cards, then legacy ones of more than 50 characters (ord 0 and 1), both without portraits."""
    legacy, portrait = F.coalesce("legacy", F.lit(False)), F.coalesce("is_portrait", F.lit(False))
    return cards.filter(~portrait & (~legacy | (F.length("content") > 50))).withColumn("ord", legacy.cast("int"))


def of_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Cards made of a documents table (and its labels): a persona for each source, an hour between cards."""
    number = F.col("doc_id")
    rows = docs.select(
        F.col("source").alias("persona_id"), number.alias("seq"), F.concat(F.lit("c_"), F.lpad(number.cast("string"), 8, "0")).alias("id"),
        F.lit(0).alias("level"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("topic"),
        F.concat(F.lit("s_"), F.floor(number / 10).cast("string")).alias("session_id"),
        F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + number * F.lit(3_600_000_000)).alias("created_at"),
    )
    if labels is None:
        return conform(rows.withColumn("retention", F.lit(8.0)).withColumn("legacy", F.lit(False)))
    marks = labels.select(F.col("doc_id").alias("seq"), "quality", "toxic")
    rows = rows.join(marks, "seq", "left")
    retention = F.when(F.col("quality") == 1, 60.0).when(F.col("quality") == 0, 1.0).otherwise(8.0)
    return conform(rows.withColumn("retention", retention).withColumn("legacy", F.coalesce(F.col("toxic"), F.lit(0)) == 1))


def upsert_personas(old: DataFrame, new: DataFrame) -> DataFrame:
    """old personas with new ones put in; empty and null values leave what is there."""
    both = old.alias("o").join(new.alias("n"), "persona_id", "full")
    return both.select("persona_id", *[F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c) for c in old.columns if c != "persona_id"])
