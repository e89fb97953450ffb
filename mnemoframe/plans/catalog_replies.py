"""Queries of the reply parsers, over replies put together from ``conversations``; the SQL says what went into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import parsing, text
from mnemoframe.operators import maintain

from .catalog import query

# what the parsers make of a message: its lines without outer white space, blank ones left out; a table of them with Spark's own texts beside
SAID = r"""said AS (SELECT conv_id AS id, turn, role, coalesce(text, '') AS raw, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM conversations)"""


def _messages(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _joined(rows: DataFrame, part: Column, first: Column | None = None, sep: str = "\n") -> DataFrame:
    """(id, raw): the parts of each conversation, by ``first`` and then by turn."""
    each = F.struct((F.lit(0) if first is None else first).alias("first"), "turn", "role", part.alias("part"))
    return rows.select("id", each.alias("e")).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["part"]), sep).alias("raw"))


def _pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def harvests(spark, d: str) -> DataFrame:
    """(id, raw): users' messages as memories, then assistants' as corrections, then systems' as facts, after a thought that holds a memory of its own."""
    m = _messages(spark, d)
    kept = _pick(F.col("turn"), "留存度: core", "留存度：Lasting memory", "情绪强度: passing", "留存度: fleeting", "留存度: 12.5", "重要性: 0.9")
    memory = F.concat(F.lit("===回忆 "), "turn", F.lit(" ===\n主体: u"), "turn", F.lit("\n"), kept, F.lit("\n话题："), "role", F.lit("\n内容: "), "text")
    correction = F.concat(F.lit("===纠正 "), "turn", F.lit("===\n原信息: "), "text", F.lit("\n她的说法: no, "), "turn", F.lit("\n性质: update\n涉及楼层: "), "turn")
    fact = F.concat(F.lit("===事实 "), "turn", F.lit("===\n内容: "), "text")
    kind = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    raw = _joined(m, F.when(kind == 1, memory).when(kind == 2, correction).otherwise(fact), kind)
    return raw.withColumn("raw", F.concat(F.lit("<think>===回忆 0===\n内容: not this</think>\n"), "raw"))


@query("harvest_parse", "SELECT id, text AS record, 'u' || turn AS subject, role AS topic, CAST(CASE turn % 6 WHEN 0 THEN -1 WHEN 1 THEN 60 WHEN 2 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN 12.5 ELSE 60 END AS DOUBLE) AS retention FROM said WHERE role = 'user' AND text <> ''", SAID)
def harvest_parse(spark, d):
    return parsing.memories(harvests(spark, d)).drop("pos")


@query("corrections_parse", "SELECT id, text AS original, 'no, ' || turn AS user_said, 'update' AS nature, CAST(turn AS VARCHAR) AS seq_ref FROM said WHERE role = 'assistant'", SAID)
def corrections_parse(spark, d):
    return parsing.corrections(harvests(spark, d)).drop("pos")


@query("harvest_table", "SELECT role AS topic, count(*) AS events, sum(length(text)) AS chars FROM said WHERE role = 'user' AND text <> '' GROUP BY ALL", SAID)
def harvest_table(spark, d):
    """The table function harvest() in SQL, beside the other columns of the table that it reads."""
    parsing.register(spark)
    harvests(spark, d).createOrReplaceTempView("_replies")
    return spark.sql("SELECT h.topic, count(*) AS events, sum(length(h.record)) AS chars FROM _replies r, LATERAL harvest(r.raw) h GROUP BY h.topic")


@query("corrections_matched", """, e AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS event, 'u' || turn AS subject, text AS record FROM said WHERE role = 'user' AND text <> ''),
c AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS correction, CASE WHEN turn % 3 = 0 THEN 'as u0 said' ELSE coalesce((SELECT substr(max_by(record, event), 1, 30) FROM e WHERE e.id = said.id), 'none') END AS original, 'so' AS user_said FROM said WHERE role = 'assistant')
SELECT id AS batch, correction, event FROM (SELECT c.id, correction, event, row_number() OVER (PARTITION BY c.id, correction ORDER BY CASE WHEN contains(original || ' ' || user_said, subject) THEN 2 ELSE 0 END + CASE WHEN length(original) > 5 AND contains(record, substr(original, 1, 20)) THEN 3 ELSE 0 END DESC, event) AS n FROM c JOIN e USING (id)) WHERE n = 1""", SAID)
def corrections_matched(spark, d):
    events = parsing.memories(harvests(spark, d)).select(F.col("id").alias("batch"), F.row_number().over(_by_pos("id")).alias("pos"), "subject", "record").withColumn("pos", F.col("pos") - 1)
    last = events.groupBy("batch").agg(F.substring(F.max_by("record", "pos"), 1, 30).alias("end"))
    fixes = parsing.corrections(harvests(spark, d)).join(last, F.col("id") == F.col("batch"), "left")
    original = F.when(F.col("seq_ref").cast("int") % 3 == 0, "as u0 said").otherwise(F.coalesce("end", F.lit("none")))
    fixes = fixes.select(F.col("id").alias("batch"), (F.row_number().over(_by_pos("id")) - 1).alias("pos"), original.alias("original"), F.lit("so").alias("user_said"))
    return maintain.match_corrections(events, fixes)


def _by_pos(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("pos")


@query("retention_parse", "SELECT doc_id AS id, CAST(CASE doc_id % 7 WHEN 0 THEN -1 WHEN 1 THEN 60 WHEN 2 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN coalesce(n_chars, 8) WHEN 5 THEN coalesce(n_chars / 8, 8) ELSE 8 END AS DOUBLE) AS months FROM documents")
def retention_parse(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    k = F.col("doc_id") % 7
    said = F.when(k == 0, "core").when(k == 1, " Lasting memory").when(k == 2, "passing").when(k == 3, "FLEETING").when(k == 4, F.col("n_chars").cast("string")).when(k == 5, F.concat(F.lit(" "), (F.col("n_chars") / 8).cast("string"))).otherwise(F.col("source"))
    return docs.select(F.col("doc_id").alias("id"), text.retention_months(said).alias("months"))


_SECTION = "nullif(regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY turn, raw) FILTER (role = '{}'), ''), '^\\s+|\\s+$', '', 'g'), '') AS {}"


@query("portrait_split_parse", "SELECT id, " + ", ".join(_SECTION.format(r, p) for r, p in (("system", "persona"), ("user", "user"), ("assistant", "relationship"))) + " FROM said GROUP BY id", SAID)
def portrait_split_parse(spark, d):
    """A section holds what one role said; where it said nothing, the word for nothing."""
    m = _messages(spark, d)
    told = lambda role: F.array_join(F.transform(F.sort_array(F.filter("m", lambda x: x["role"] == role)), lambda x: x["text"]), "\n")
    rows = m.groupBy("id").agg(F.collect_list(F.struct("turn", "text", "role")).alias("m"))
    section = lambda name, role: F.concat(F.lit(f"==={name}===\n"), F.when(F.trim(told(role)) == "", "无").otherwise(told(role)))
    raw = F.concat_ws("\n", section("persona", "system"), section("user", "user"), section("relationship", "assistant"))
    return rows.select("id", parsing.portrait_split(raw).alias("s")).select("id", "s.*")


@query("review_parse", "SELECT id, turn, id % 2 = 0 AS absorb, text AS reasoning, turn % 3 = 0 AS should_update, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS new_stable FROM said", SAID)
def review_parse(spark, d):
    m = _messages(spark, d)
    judged = F.concat(F.lit("===暂存池判断===\n需要吸收: "), _pick(F.col("id"), "是", "否"), F.lit("\n理由: "), "text")
    reviewed = F.concat(F.lit("so\n===长期画像审查===\n需要更新："), _pick(F.col("turn"), "Yes", "no", "否"), F.lit("\n新画像: "), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("无"), F.lit("\n理由: steady"))
    rows = m.select("id", "turn", parsing.staging_judge(judged).alias("a"), parsing.stable_review(reviewed).alias("b"))
    return rows.select("id", "turn", F.col("a.should_rewrite").alias("absorb"), "a.reasoning", "b.should_update", "b.new_stable")


@query("filter_reply_parse", """, c AS (SELECT id, list_sort(list_distinct(list(turn))) AS turns FROM said GROUP BY id)
SELECT id, CASE id % 6 WHEN 2 THEN 'search' WHEN 5 THEN 'unknown' ELSE 'keep' END AS type, CASE id % 6 WHEN 0 THEN array_to_string(list_transform(list_filter(turns, lambda x: x % 2 = 0), lambda x: 'c_' || x), ',') WHEN 3 THEN 'c_' || turns[1] ELSE '' END AS ids, CASE WHEN id % 6 = 2 THEN 'about turn ' || turns[-1] END AS keywords FROM c""", SAID)
def filter_reply_parse(spark, d):
    turns = _messages(spark, d).groupBy("id").agg(F.sort_array(F.collect_set("turn")).alias("t"))
    name = lambda a: F.transform(a, lambda x: F.concat(F.lit("c_"), x.cast("string")))
    k, last = F.col("id") % 6, F.element_at("t", -1).cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("<think>c_1?</think>[保留] "), F.array_join(F.reverse(name(F.filter("t", lambda x: x % 2 == 0))), ", "))).when(k == 1, "[保留] 无")
        .when(k == 2, F.concat(F.lit("[搜索] about turn "), last, F.lit("\nand more"))).when(k == 3, F.concat(F.element_at(name(F.col("t")), 1), F.lit(" fits, xc_1 and c_99 don't"))).when(k == 4, "没有").otherwise("who knows")
    )
    return turns.select("id", parsing.filter_reply(raw, name(F.col("t"))).alias("a")).select("id", "a.type", F.array_join("a.ids", ",").alias("ids"), "a.keywords")


@query("level_normalize", "SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN doc_id % 100 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN floor(coalesce(n_chars, 0) / 4) ELSE 0 END AS INTEGER) AS level FROM documents")
def level_normalize(spark, d):
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, (F.col("doc_id") % 100).cast("string")).when(k == 1, "m2").when(k == 2, " M4 ").when(k == 3, (F.col("n_chars") / 4).cast("string")).when(k == 4, F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.col("source"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.normalize_level(raw).alias("level"))


@query("think_stripped", "SELECT conv_id AS id, turn, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM conversations")
def think_stripped(spark, d):
    """Thoughts before, inside and after a reply go; what is left is the reply."""
    m = _messages(spark, d)
    half = F.floor(F.length("text") / 2).cast("int")
    raw = F.concat(F.lit("<think>first\nlines</think> "), F.substring("text", F.lit(1), half), F.lit("<think></think>"), F.substr("text", half + 1), F.lit("\n<think>last</think>"))
    return m.select("id", "turn", F.md5(text.strip_think(raw)).alias("text_md5"))
