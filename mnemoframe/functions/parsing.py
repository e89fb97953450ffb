"""Parsers of model replies as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import DEFAULT_MONTHS, RETENTION_MONTHS, retention_months, strip, strip_think

# Markers and field names of the reply formats.
MEMORY_MARK = r"===\s*回忆\s*[0-9]+\s*==="
CORRECTION_MARK = r"===\s*纠正\s*[0-9]+\s*==="
FACT_MARK = r"===\s*事实\s*[0-9]+\s*==="
MEMORY_FIELDS = (("内容", "record"), ("主体", "subject"), ("话题", "topic"), ("留存度", "retention_raw"), ("情绪强度", "retention_raw"), ("重要性", "importance"))
CORRECTION_FIELDS = (("原信息", "original"), ("U 的说法", "user_said"), ("U的说法", "user_said"), ("她的说法", "user_said"), ("性质", "nature"), ("涉及楼层", "seq_ref"))
NOTHING = ("无", "无。", "—", "-", "")
KEEP_NOTHING = ("无", "空", "[]", "无相关记忆")
REPLY_NOTHING = ("无", "无关", "没有", "没有相关记忆", "无相关记忆", "不需要")
PORTRAITS = ("persona", "user", "relationship")


def fields(block: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """map<string,string> of "name: value" lines.

    Lines after it that name nothing go on with the value; blank ones are skipped. Both colons count; of repeated names
    the last stays.
    """
    state = "struct<key:string,text:string,out:map<string,string>>"

    def put(s: Column) -> Column:
        out, key = s["out"], s["key"]
        return F.when(key.isNull(), out).otherwise(F.map_concat(F.map_filter(out, lambda k, _: k != key), F.create_map(F.coalesce(key, F.lit("")), strip(s["text"]))))

    def step(s: Column, line: Column) -> Column:
        row = strip(line)
        key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
        for shown, name in reversed(names):
            hit = row.startswith(shown + ":") | row.startswith(shown + "：")
            after = F.substr(row, F.lit(len(shown) + 1))
            sep = F.when(F.contains(F.substring(after, 1, 2), F.lit(":")), ":").otherwise("：")
            key = F.when(hit, name).otherwise(key)
            value = F.when(hit, strip(F.substr(row, F.call_function("locate", sep, row) + 1))).otherwise(value)
        begun = F.struct(key.alias("key"), value.alias("text"), put(s).alias("out"))
        goes_on = F.struct(s["key"].alias("key"), F.concat(s["text"], F.lit("\n"), row).alias("text"), s["out"].alias("out"))
        return F.when(key.isNotNull(), begun).when(s["key"].isNotNull() & (row != ""), goes_on).otherwise(s).cast(state)

    start = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"), F.create_map().cast("map<string,string>").alias("out")).cast(state)
    return F.aggregate(F.split(block, "\n"), start, step, put)


def _blocks(text: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(text, mark), strip), lambda b: b != "")


def _none(reply: Column) -> Column:
    """The whole reply says that there is nothing."""
    return ~F.contains(reply, F.lit("===")) & (F.contains(reply, F.lit("无回忆")) | F.contains(reply, F.lit("无事件")))


def memories(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df's other columns plus, a row per remembered event, pos, record, subject, topic, retention."""
    reply = strip_think(F.col(raw))
    cut = F.element_at(F.split(F.element_at(F.split(reply, CORRECTION_MARK), 1), FACT_MARK), 1)
    found = F.when(_none(reply), F.array().cast("array<string>")).otherwise(_blocks(cut, MEMORY_MARK))
    rows = df.select("*", F.posexplode(found).alias("pos", "_block"))
    f = rows.withColumn("_f", fields(F.col("_block"), MEMORY_FIELDS))
    importance = F.coalesce(F.col("_f")["importance"].try_cast("double"), F.lit(0.5))
    retention = (
        F.when(F.col("_f")["retention_raw"].isNotNull(), retention_months(F.col("_f")["retention_raw"]))
        .when(F.col("_f")["importance"].isNull(), 8.0).when(importance >= 0.8, 60.0).when(importance >= 0.4, 8.0).otherwise(1.0)
    )
    out = f.select(*[c for c in df.columns if c != raw], "pos", F.col("_f")["record"].alias("record"), F.col("_f")["subject"].alias("subject"), F.col("_f")["topic"].alias("topic"), retention.alias("retention"))
    return out.filter("record IS NOT NULL AND record <> ''")


def corrections(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df's other columns plus, a row per correction, pos, original, user_said, nature, seq_ref."""
    reply = strip_think(F.col(raw))
    cut = F.element_at(F.split(reply, FACT_MARK), 1)
    skip = _none(reply) | (F.contains(reply, F.lit("无纠正")) & ~F.contains(reply, F.lit("===")))
    found = F.when(skip, F.array().cast("array<string>")).otherwise(_blocks(cut, CORRECTION_MARK))
    rows = df.select("*", F.posexplode(found).alias("pos", "_block")).withColumn("_f", fields(F.col("_block"), CORRECTION_FIELDS))
    out = rows.select(*[c for c in df.columns if c != raw], "pos", *[F.col("_f")[k].alias(k) for k in ("original", "user_said", "nature", "seq_ref")])
    return out.filter("coalesce(original, '') <> '' OR coalesce(user_said, '') <> ''")


def is_yes(c: Column) -> Column:
    return c.startswith("是") | F.lower(c).startswith("yes")


def is_nothing(c: Column) -> Column:
    return c.isin(*NOTHING)


def _after(reply: Column, mark: str) -> Column:
    return F.element_at(F.split(reply, mark), -1)


def staging_judge(raw: Column) -> Column:
    """struct<should_rewrite, reasoning>."""
    f = fields(_after(strip_think(raw), r"===\s*暂存池判断\s*==="), (("需要吸收", "should_rewrite"), ("理由", "reasoning")))
    return F.struct(is_yes(F.coalesce(f["should_rewrite"], F.lit("否"))).alias("should_rewrite"), F.coalesce(f["reasoning"], F.lit("")).alias("reasoning"))


def stable_review(raw: Column) -> Column:
    """struct<should_update, new_stable, reasoning>."""
    f = fields(_after(strip_think(raw), r"===\s*长期画像审查\s*==="), (("需要更新", "should_update"), ("新画像", "new_stable"), ("理由", "reasoning")))
    new = F.coalesce(f["new_stable"], F.lit(""))
    return F.struct(
        is_yes(F.coalesce(f["should_update"], F.lit("否"))).alias("should_update"), F.when(is_nothing(new), "").otherwise(new).alias("new_stable"),
        F.coalesce(f["reasoning"], F.lit("")).alias("reasoning"),
    )


def portrait_split(raw: Column) -> Column:
    """struct of the sections persona, user and relationship; null where missing or empty."""

    def section(name: str) -> Column:
        text = strip(F.regexp_extract(raw, rf"(?s)==={name}===\s*\n(.*?)(?=\n===|\z)", 1))
        return F.when(~text.isin("", "无", "（无）"), text).alias(name)

    return F.struct(*[section(p) for p in PORTRAITS])


def filter_reply(raw: Column, candidates: Column) -> Column:
    """struct<type, ids, keywords> of a candidate filter's reply; candidates: array of ids. Types: keep, search, unknown.

    A keep line comes first, then a search line, then bare ids, then a reply that says there is nothing. Ids come in
    the candidates' order and only count as whole words.
    """
    text = strip_think(raw)
    named = lambda where: F.filter(candidates, lambda c: F.rlike(where, F.concat(F.lit("(?<![a-z0-9_])\\Q"), c, F.lit("\\E(?![a-z0-9_])"))))
    keep = strip(F.regexp_extract(text, r"(?s)\[保留\]\s*(.+)", 1))
    words = strip(F.regexp_extract(text, r"\[搜索\]\s*(.+)", 1))
    none = F.array().cast("array<string>")
    out = lambda kind, ids, keywords=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("type"), ids.alias("ids"), keywords.alias("keywords"))
    return (
        F.when(keep != "", out("keep", F.when(keep.isin(*KEEP_NOTHING), none).otherwise(named(keep))))
        .when(words != "", out("search", none, words)).when(F.size(named(text)) > 0, out("keep", named(text)))
        .when(text.isin(*REPLY_NOTHING), out("keep", none)).otherwise(out("unknown", none))
    )


def read_fields(block: str, names: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """fields() of one block, for table functions."""
    out: dict[str, str] = {}
    key = None
    for line in map(str.strip, block.split("\n")):
        hit = next(((shown, name) for shown, name in names if line[len(shown) : len(shown) + 1] in (":", "：") and line.startswith(shown)), None)
        if hit:
            key = hit[1]
            out[key] = line[len(hit[0]) + 1 :].strip()
        elif key and line:
            out[key] += "\n" + line
    return {k: v.strip() for k, v in out.items()}


def _reply_blocks(raw: str | None, keep: str, drop: tuple[str, ...], none: tuple[str, ...]) -> list[str]:
    reply = re.sub(r"(?s)<think>.*?</think>", "", raw or "").strip()
    if "===" not in reply and any(n in reply for n in none):
        return []
    for mark in drop:
        reply = re.split(mark, reply)[0]
    return [b for b in map(str.strip, re.split(keep, reply)) if b]


class Harvest:
    """Table function: the memories of a reply; the same rows as memories()."""

    def eval(self, raw: str) -> Iterator[tuple]:
        for pos, block in enumerate(_reply_blocks(raw, MEMORY_MARK, (CORRECTION_MARK, FACT_MARK), ("无回忆", "无事件"))):
            f = read_fields(block, MEMORY_FIELDS)
            if f.get("record"):
                yield pos, f["record"], f.get("subject"), f.get("topic"), self.months(f)

    @staticmethod
    def months(f: dict[str, str]) -> float:
        def number(text: str, other: float) -> float:
            try:
                return float(text)
            except ValueError:
                return other

        if "retention_raw" in f:
            return next((m for label, m in RETENTION_MONTHS if label in f["retention_raw"].lower()), number(f["retention_raw"], DEFAULT_MONTHS))
        weight = number(f.get("importance", "0.5"), 0.5)
        return DEFAULT_MONTHS if "importance" not in f or 0.4 <= weight < 0.8 else 60.0 if weight >= 0.8 else 1.0


class HarvestCorrections:
    """Table function: the corrections of a reply; the same rows as corrections()."""

    def eval(self, raw: str) -> Iterator[tuple]:
        for pos, block in enumerate(_reply_blocks(raw, CORRECTION_MARK, (FACT_MARK,), ("无回忆", "无事件", "无纠正"))):
            f = read_fields(block, CORRECTION_FIELDS)
            if f.get("original") or f.get("user_said"):
                yield pos, *(f.get(k) for k in ("original", "user_said", "nature", "seq_ref"))


def register(spark: SparkSession) -> None:
    """SQL table functions of one reply: harvest(raw) and harvest_corrections(raw)."""
    spark.udtf.register("harvest", F.udtf(Harvest, returnType="pos int, record string, subject string, topic string, retention double"))
    spark.udtf.register("harvest_corrections", F.udtf(HarvestCorrections, returnType="pos int, original string, user_said string, nature string, seq_ref string"))
