"""Hybrid retrieval: merged channels, thresholds, keyword fallback, and spreading activation over cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import card_text, keyword_tokens, overlap_score, recency

from . import names

# Fixed values of spreading activation: weights of shared sessions and entities, decay, least energy, steepest drop.
SESSION, ENTITY, DECAY, LEAST, DROP, DORMANT = 0.3, 0.5, 0.5, 0.05, 0.3, 0.6


def merge_channels(*channels: DataFrame) -> DataFrame:
    """(query_id, persona_id, card_id, score): the best score of each card over all channels of the same columns."""
    out = channels[0].select("query_id", "persona_id", "card_id", "score")
    for c in channels[1:]:
        out = out.unionByName(c.select("query_id", "persona_id", "card_id", "score"))
    return out.groupBy("query_id", "persona_id", "card_id").agg(F.max("score").alias("score"))


def live_hits(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """Full-text hits without legacy cards, which only vectors may bring up."""
    return hits.join(cards.filter("NOT coalesce(legacy, false)").select("persona_id", F.col("id").alias("card_id")), ["persona_id", "card_id"], "left_semi")


def gate(hits: DataFrame, cards: DataFrame, excluded: DataFrame | None = None, least: float | Column = 0.35, legacy_least: float | Column = 0.55) -> DataFrame:
    """hits whose card is there and whose score passes its threshold, without (query_id, card_id) excluded."""
    info = cards.select("persona_id", F.col("id").alias("card_id"), F.coalesce("legacy", F.lit(False)).alias("legacy"))
    out = hits.join(info, ["persona_id", "card_id"]).filter(F.col("score") >= F.when(F.col("legacy"), legacy_least).otherwise(least))
    return out if excluded is None else out.join(excluded.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")


def keyword_fallback(cards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, persona_id, card_id, score, rank): active cards by shared tokens."""
    q = queries.select("query_id", "persona_id", keyword_tokens(F.col("text")).alias("_q"))
    asked = cards.filter("NOT coalesce(legacy, false)").join(q.select("persona_id"), "persona_id", "left_semi")  # other personas' texts aren't cut into tokens
    rows = asked.select("persona_id", F.col("id").alias("card_id"), "seq", keyword_tokens(card_text(F.coalesce("content", F.lit("")), F.col("keywords"), F.col("tags"))).alias("_t"))
    hits = rows.join(q, "persona_id").withColumn("score", overlap_score(F.col("_q"), F.col("_t"))).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "seq")
    return hits.select("query_id", "persona_id", "card_id", "seq", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("seq")


def energies(seeds: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """seeds (query_id, persona_id, card_id, sim) plus what spreading needs; dormant cards with a weak match are left out."""
    info = cards.select("persona_id", F.col("id").alias("card_id"), "seq", "content", "created_at", "session_id", "source_time", (F.coalesce("retention", F.lit(8.0)) == 0).alias("dormant"))
    rows = seeds.join(info, ["persona_id", "card_id"]).filter(~F.col("dormant") | (F.col("sim") >= DORMANT))
    fresh = F.when(F.col("created_at").isNull(), 1.0).otherwise(recency(F.col("created_at"), now))
    link = F.when(F.coalesce("session_id", F.lit("")) != "", F.concat(F.lit("s:"), "session_id")).when(F.coalesce("source_time", F.lit("")) != "", F.concat(F.lit("d:"), F.substring("source_time", 1, 10)))
    return rows.withColumn("e0", F.col("sim") * (0.7 + 0.3 * fresh)).withColumn("moment", link)


def spread(pool: DataFrame, entities: DataFrame | None = None, rounds: int = 2, most: int | None = None) -> DataFrame:
    """(query_id, persona_id, card_id, energy, rank) from energies().

    Cards of a query's pool are linked by the same session (or day) and by entity names both contain; weights are normalised
    by row, and energy flows along them ``rounds`` times. Dormant cards neither give nor get. A single card keeps its energy; else
    what is under LEAST goes, and with three and more all after the first steep drop.
    """
    on = ["query_id", "persona_id"]
    awake = pool.filter(~F.col("dormant"))
    key = awake.select(*on, "card_id", F.col("moment").alias("k")).filter("k IS NOT NULL").withColumn("w", F.lit(SESSION))
    if entities is not None:
        held = names.occurrences(awake, entities, ["query_id", "card_id"], "content")
        key = key.unionByName(held.select(*on, "card_id", F.concat(F.lit("e:"), "name").alias("k"), F.lit(ENTITY).alias("w")))
    other = key.select(*on, "k", F.col("card_id").alias("to"))
    links = key.join(other, [*on, "k"]).filter("card_id <> to").groupBy(*on, "card_id", "to").agg(F.max("w").alias("w"))
    links = links.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(*on, "card_id")))
    base = pool.select(*on, "card_id", "seq", "e0", F.count("*").over(Window.partitionBy("query_id")).alias("pool"))
    now = base.select(*on, "card_id", F.col("e0").alias("e"))
    for _ in range(rounds):
        flow = links.join(now, [*on, "card_id"]).groupBy(*on, F.col("to").alias("card_id")).agg(F.sum(F.col("p") * F.col("e")).alias("got"))
        now = base.join(flow, [*on, "card_id"], "left").select(*on, "card_id", (F.col("e0") + DECAY * F.coalesce("got", F.lit(0.0))).alias("e"))
    out = base.join(now, [*on, "card_id"]).withColumn("energy", F.when(F.col("pool") <= 1, F.col("e0")).otherwise(F.col("e"))).filter((F.col("pool") <= 1) | (F.col("energy") >= LEAST))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("energy", 9)), "seq")
    out = out.withColumn("rank", F.row_number().over(order)).withColumn("before", F.lag("energy").over(order)).withColumn("left", F.count("*").over(Window.partitionBy("query_id")))
    steep = (F.col("left") > 2) & (F.col("before") > 0) & (F.col("energy") / F.col("before") < DROP)
    out = out.withColumn("cut", F.max(F.coalesce(steep, F.lit(False)).cast("int")).over(order)).filter("cut = 0")
    return (out if most is None else out.filter(F.col("rank") <= most)).select(*on, "card_id", "energy", "rank")


def entity_names(cards: DataFrame) -> DataFrame:
    """(persona_id, name): distinct subjects of two characters and more."""
    return cards.filter(F.length("subject") >= 2).select("persona_id", F.col("subject").alias("name")).distinct()


def above(hits: DataFrame, least: float = 0.5) -> DataFrame:
    """Fallback of a candidate filter that failed: hits with enough energy."""
    return hits.filter(F.col("energy") >= least)


def candidate_line() -> Column:
    """How a candidate card is shown to the model that chooses."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(F.lit("  id="), "id", F.lit(" (L"), F.coalesce("level", F.lit(0)), F.lit(") ["), some("subject"), F.lit("/"), some("topic"), F.lit("] "), some("content"))
