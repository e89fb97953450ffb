"""Nightly maintenance: decay, corrections, daily texts, and the deterministic part of portraits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import strip
from mnemoframe.sources.cards import BUFFER, CARD, EDIT

# Days of a month of retention; shortest text a correction may look for, and how much of it; sizes of buffers and texts.
MONTH_DAYS, SHORTEST, LOOKED_FOR = 30.0, 4, 60
BUFFER_SIZE, STAGING_TRIGGER, SESSION_CHARS, SEPARATOR = 5, 10, 2000, "\n---\n"
ERROR_MARK = "[BFF_ERROR]"


def decay(cards: DataFrame, now: Column) -> DataFrame:
    """cards plus ``decayed`` and ``zeroed``: retention of active cards of level 0 with something left, less a month in 30 days, not under 0."""
    base = F.coalesce("last_decay_at", "created_at")
    days = (F.unix_micros(now) - F.unix_micros(base)) / F.lit(86400e6)
    due = ~F.coalesce("legacy", F.lit(False)) & (F.col("level") == 0) & (F.coalesce("retention", F.lit(0.0)) > 0) & (F.coalesce(days, F.lit(0.0)) > 0)
    left = F.greatest(F.lit(0.0), F.round(F.col("retention") - days / MONTH_DAYS, 4))
    return cards.withColumn("decayed", due).withColumn("zeroed", due & (left == 0)).withColumn("retention", F.when(due, left).otherwise(F.col("retention"))).withColumn("last_decay_at", F.when(due, now).otherwise(F.col("last_decay_at")))


def find_corrected(cards: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections (persona_id, pos, original, user_said, nature) plus the id of the first active card, portraits apart, whose content holds the original's beginning."""
    asked = corrections.withColumn("original", strip(F.coalesce("original", F.lit("")))).withColumn("user_said", strip(F.coalesce("user_said", F.lit(""))))
    asked = asked.filter((F.length("original") >= SHORTEST) & (F.col("user_said") != ""))
    live = cards.filter("NOT coalesce(legacy, false) AND NOT coalesce(is_portrait, false)").select(F.col("persona_id").alias("p"), "seq", "id", "content")
    hits = asked.join(live, (F.col("persona_id") == F.col("p")) & F.contains("content", F.substring("original", 1, LOOKED_FOR)))
    return hits.groupBy("persona_id", "pos", "original", "user_said", "nature").agg(F.min_by("id", "seq").alias("id"))


def apply_corrections(cards: DataFrame, corrections: DataFrame, now: str) -> DataFrame:
    """cards with the corrections made, in order of pos: the original is replaced, or the correction added below; old texts go to the history."""
    found = find_corrected(cards, corrections).groupBy("persona_id", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "original", "user_said", "nature"))).alias("_todo"))
    rows = cards.join(found, ["persona_id", "id"], "left")
    state = f"struct<content:string,history:array<{EDIT}>>"

    def step(s: Column, c: Column) -> Column:
        swapped = F.replace(s["content"], c["original"], c["user_said"])
        text = F.when(swapped == s["content"], F.concat(s["content"], F.lit("\n[纠正] "), c["user_said"])).otherwise(swapped)
        edit = F.struct(F.lit(now).alias("timestamp"), s["content"].alias("old_content"), F.concat(F.lit("correction: "), F.coalesce(c["nature"], F.lit("fix"))).alias("reason"))
        return F.struct(text.alias("content"), F.concat(s["history"], F.array(edit)).alias("history")).cast(state)

    start = F.struct(F.coalesce("content", F.lit("")).alias("content"), F.coalesce("edit_history", F.array().cast(f"array<{EDIT}>")).alias("history")).cast(state)
    rows = rows.withColumn("_s", F.aggregate("_todo", start, step))
    done = F.col("_s").isNotNull()
    return rows.withColumns({
        "content": F.when(done, F.col("_s.content")).otherwise(F.col("content")), "edit_history": F.when(done, F.col("_s.history")).otherwise(F.col("edit_history")),
        "last_updated": F.when(done, F.lit(now).cast("timestamp")).otherwise(F.col("last_updated")),
    }).select(*CARD.names)


def match_corrections(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """(batch, correction, event): the event each correction of a batch belongs to.

    A subject named in it counts 2, its beginning found in the record 3; the first event with the best score, or the first.
    events: (batch, pos, subject, record); corrections: (batch, pos, original, user_said).
    """
    e = events.select("batch", F.col("pos").alias("event"), "subject", "record")
    c = corrections.select("batch", F.col("pos").alias("correction"), F.coalesce("original", F.lit("")).alias("original"), F.coalesce("user_said", F.lit("")).alias("user_said"))
    both = c.join(e, "batch")
    subject = F.trim(F.coalesce("subject", F.lit("")))
    named = (subject != "") & F.contains(F.concat_ws(" ", "original", "user_said"), subject)
    quoted = (F.length("original") > 5) & F.contains(F.coalesce("record", F.lit("")), F.substring("original", 1, 20))
    both = both.withColumn("score", F.when(named, 2).otherwise(0) + F.when(quoted, 3).otherwise(0))
    order = Window.partitionBy("batch", "correction").orderBy(F.desc("score"), "event")
    return both.withColumn("n", F.row_number().over(order)).filter("n = 1").select("batch", "correction", "event")


def real_messages(messages: DataFrame) -> DataFrame:
    """Messages that aren't error notes."""
    return messages.filter(~F.coalesce("content", F.lit("")).startswith(ERROR_MARK))


def session_prompt(messages: DataFrame, each: int = 200, most: int = 1000) -> DataFrame:
    """(session_id, text): what the user said, in order, each message and the whole cut."""
    said = real_messages(messages).filter("role = 'user'")
    rows = said.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.substring("content", 1, each).alias("t")))).alias("r"))
    return rows.select("session_id", F.substring(F.array_join(F.transform("r", lambda x: x["t"]), "\n"), 1, most).alias("text"))


def session_summary(events: DataFrame, most: int = SESSION_CHARS, previous: DataFrame | None = None) -> DataFrame:
    """(session_id, summary): "[topic] record" of a session's events (pos, topic, record), the oldest dropped until the whole fits.

    previous: (session_id, summary) of earlier rounds, whose parts come before the events.
    """
    record = strip(F.regexp_replace(strip(F.coalesce("record", F.lit(""))), r"(?s)===.*", ""))
    items = events.withColumn("record", record).filter("record <> ''").withColumn("item", F.when(F.coalesce("topic", F.lit("")) != "", F.concat(F.lit("["), "topic", F.lit("] "), "record")).otherwise(F.col("record")))
    items = items.select("session_id", F.col("pos").cast("long").alias("pos"), "item")
    sessions = events.select("session_id")
    if previous is not None:
        old = previous.select("session_id", F.posexplode(F.split("summary", SEPARATOR)).alias("at", "item")).withColumn("item", strip(F.col("item"))).filter("item <> ''")
        items = items.unionByName(old.select("session_id", (F.col("at") - 1_000_000).cast("long").alias("pos"), "item"))
        sessions = sessions.unionByName(previous.select("session_id"))
    order = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    kept = items.withColumn("upto", F.sum(F.length("item") + len(SEPARATOR)).over(order) - len(SEPARATOR)).filter(F.col("upto") <= most)
    rows = kept.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("r"))
    every = sessions.distinct().join(rows, "session_id", "left")
    return every.select("session_id", F.coalesce(F.array_join(F.transform("r", lambda x: x["item"]), SEPARATOR), F.lit("")).alias("summary"))


def daily_drafts(cards: DataFrame, chars: int = 200) -> DataFrame:
    """(persona_id, text): a line "- [subject/topic] content" for each card of the day."""
    line = F.concat(F.lit("- ["), F.coalesce("subject", F.lit("")), F.lit("/"), F.coalesce("topic", F.lit("")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    return cards.groupBy("persona_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("r")).select("persona_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


def roll_buffers(portraits: DataFrame, today: DataFrame, size: int = BUFFER_SIZE, trigger: int = STAGING_TRIGGER) -> DataFrame:
    """portraits with (persona_id, portrait_type, date, summary) of the day put in, plus ``due``: whether the staging pool asks for a rewrite.

    An entry of the same day is replaced. What is over the recent buffer goes to the staging pool, which keeps three times its
    trigger.
    """
    none = F.array().cast(f"array<{BUFFER}>")
    rows = portraits.join(today.select("persona_id", "portrait_type", F.col("date").alias("_d"), F.col("summary").alias("_s")), ["persona_id", "portrait_type"], "left")
    has = F.coalesce(F.trim("_s"), F.lit("")) != ""
    recent, pool = F.coalesce("recent_buffer", none), F.coalesce("staging_pool", none)
    entry = F.array(F.struct(F.col("_d").alias("date"), F.trim("_s").alias("summary")))
    rows = rows.withColumn("_r", F.when(has, F.concat(F.filter(recent, lambda e: ~e["date"].eqNullSafe(F.col("_d"))), entry)).otherwise(recent))
    last = lambda c, n: F.slice(c, F.greatest(F.lit(1), F.size(c) - (n - 1)), F.lit(n))
    over = F.slice("_r", F.lit(1), F.greatest(F.size("_r") - size, F.lit(0)))
    rows = rows.withColumn("_p", F.when(has, F.concat(pool, over)).otherwise(pool))
    return rows.withColumns({
        "recent_buffer": F.when(has, last(F.col("_r"), size)).otherwise(recent), "staging_pool": F.when(has, last(F.col("_p"), trigger * 3)).otherwise(pool),
        "due": has & (F.least(F.size("_p"), F.lit(trigger * 3)) >= trigger),
    }).drop("_d", "_s", "_r", "_p")


def start_portraits(personas: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """The portrait cards that personas lack, empty, and existing ones without a stable text, which takes over their content."""
    from mnemoframe.functions.parsing import PORTRAITS
    from mnemoframe.sources.cards import conform

    have = cards.filter("is_portrait AND NOT coalesce(legacy, false)")
    wanted = personas.select("persona_id", F.explode(F.array(*[F.lit(p) for p in PORTRAITS])).alias("portrait_type"))
    missing = wanted.join(have.select("persona_id", "portrait_type"), ["persona_id", "portrait_type"], "left_anti")
    new = conform(
        missing.select(
            "persona_id", F.lit(0).cast("long").alias("seq"), F.concat(F.lit("p_"), "portrait_type").alias("id"), F.lit(2).alias("level"), F.concat(F.lit("["), "portrait_type", F.lit(" portrait — initializing]")).alias("content"),
            F.array(F.lit("portrait"), "portrait_type").alias("tags"), F.lit("nightly_review").alias("source"), now.alias("created_at"), now.alias("last_updated"), F.lit(True).alias("is_portrait"), "portrait_type",
            F.lit("").alias("stable"), F.lit("").alias("mid_term"), F.lit(False).alias("legacy"),
        )
    )
    text = F.trim(F.coalesce("content", F.lit("")))
    moved = have.withColumn("stable", F.when((F.trim(F.coalesce("stable", F.lit(""))) == "") & (text != "") & ~F.contains(text, F.lit("initializing")), text).otherwise(F.col("stable")))
    return moved.select(*CARD.names).unionByName(new)


def rewrite_portraits(portraits: DataFrame, texts: DataFrame, now: str) -> DataFrame:
    """portraits with (persona_id, portrait_type, new_mid, new_stable, reasoning): a new mid-term text empties the pool, both go to the history, content follows."""
    rows = portraits.join(texts, ["persona_id", "portrait_type"], "left")
    history = F.coalesce("edit_history", F.array().cast(f"array<{EDIT}>"))
    mid, stable = F.coalesce("new_mid", F.lit("")) != "", (F.coalesce("new_mid", F.lit("")) != "") & (F.coalesce("new_stable", F.lit("")) != "")
    edit = lambda old, reason: F.array(F.struct(F.lit(now).alias("timestamp"), old.alias("old_content"), reason.alias("reason"))).cast(f"array<{EDIT}>")
    none = F.array().cast(f"array<{EDIT}>")
    added = F.concat(F.when(mid, edit(F.col("mid_term"), F.lit("midterm_rewrite"))).otherwise(none), F.when(stable, edit(F.col("stable"), F.concat(F.lit("stable_update: "), F.substring(F.coalesce("reasoning", F.lit("")), 1, 50)))).otherwise(none))
    rows = rows.withColumns({
        "edit_history": F.concat(history, added), "staging_pool": F.when(mid, F.array().cast(f"array<{BUFFER}>")).otherwise(F.col("staging_pool")),
        "mid_term": F.when(mid, F.col("new_mid")).otherwise(F.col("mid_term")), "stable": F.when(stable, F.col("new_stable")).otherwise(F.col("stable")),
    })
    parts = F.array_join(F.filter(F.array("stable", "mid_term"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    return rows.withColumn("content", F.when(parts != "", parts).otherwise(F.col("content"))).select(*CARD.names)


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """hit@1, hit@3, hit@5 and mean reciprocal rank of (query, rank), rank 0 for a miss."""
    hit = lambda k: F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0))
    return ranks.agg(F.count("*").alias("queries"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(5).alias("hit_5"), F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"))
