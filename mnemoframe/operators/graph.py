"""Term co-occurrence graph: nodes, edges and the card ledger, and what is read from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import ENGLISH_STOP_WORDS, norm_term, split_terms, term_counts, topic_words

from .asked import asked_for

# Terms taken from a card's content, nodes a card has at most, bounds of summaries and generic words.
CONTENT_TERMS, CARD_NODES, NAME_FREQUENCY, SUMMARY_FREQUENCY = 12, 16, 100, 500
#: The most frequent terms, whose weights the tasks are told; those of others are bounded by them. Changes no result.
KNOWN = 200_000


def idf_table(cards: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(term, idf): ln((n + 1) / (df + 1)) over all cards of all personas; the row with a null term is for terms that aren't there."""
    tokens = topic_words(F.col("content")) if tokens is None else tokens
    n = cards.agg(F.count("*").alias("n"))
    df = topic_counts(cards, tokens).groupBy("term").agg(F.count("*").alias("df"))
    df = df.unionByName(cards.sparkSession.createDataFrame([(None, 0)], "term string, df long"))
    return df.join(F.broadcast(n)).select("term", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)), 9).alias("idf"))


def topic_counts(cards: DataFrame, tokens: Column | None = None, keep: Callable | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(persona_id, card_id, seq, term, tf) and ``more`` columns of the cards: the topic words of each card's content. keep: see term_counts()."""
    tokens = topic_words(F.col("content")) if tokens is None else tokens
    return term_counts(cards.select("*", F.col("id").alias("card_id")), tokens, ["persona_id", "card_id", "seq", *more], keep).drop("dl")


def term_cards(cards: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(persona_id, term, df): how many of a persona's cards hold each topic word."""
    return topic_counts(cards, tokens).groupBy("persona_id", "term").agg(F.count("*").alias("df"))


def _contenders(k: int, known: pa.Table, bounds: Callable) -> Callable:
    """For term_counts(): which terms may be among the k heaviest of their row.

    known: (persona_id, term, value), or (term, value) if that holds for all personas. bounds: (value, found, n) to the least and the largest idf that
    each may have. A term goes only if k others of its row weigh more for certain, so what is chosen of the rest is chosen of all.
    """
    terms, value = pc.unique(known["term"]), known["value"].to_numpy()
    personas = pc.unique(known["persona_id"]) if "persona_id" in known.column_names else None
    number = lambda values, of: pc.fill_null(pc.index_in(values, value_set=of.cast(values.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = number(known["term"], terms) + (0 if personas is None else number(known["persona_id"], personas) * len(terms))
    order = np.argsort(codes)
    codes, value = np.append(codes[order], -1), np.append(value[order], 0)

    def keep(rows: pa.RecordBatch, words: pa.Array, row: np.ndarray, word: np.ndarray, tf: np.ndarray) -> np.ndarray:
        term = number(words, terms)[word]
        whose = np.zeros(len(row), np.int64) if personas is None else number(rows.column("persona_id"), personas)[row]
        code = np.where((term < 0) | (whose < 0), -2, term + whose * len(terms))
        at = np.searchsorted(codes[:-1], code)
        n = rows.column("_n").to_numpy(zero_copy_only=False)[row] if "_n" in rows.schema.names else None
        low, high = bounds(value[at], codes[at] == code, n)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(row)))
        falling = (low * tf)[np.lexsort((-low * tf, row))]
        least = np.where(size < k, -np.inf, falling[np.minimum(first + k - 1, len(row) - 1)])
        return high * tf >= np.repeat(least, size) - 1e-5  # weights are rounded to 6 decimals

    return keep


def content_terms(cards: DataFrame, k: int = CONTENT_TERMS, tokens: Column | None = None, idf: DataFrame | None = None, dfs: DataFrame | None = None) -> DataFrame:
    """(persona_id, card_id, seq, term, rank): each card's k terms of highest tf * idf; ties by term.

    idf: (term, idf) with a row of a null term for all others. A card's terms then depend on nothing but itself and the table.
    Without one, a term's weight is its rarity within its persona's cards, which is counted where the term's rows meet: texts are read once.
    dfs: a stored term_cards() of the cards. With it or idf, terms that can't be among a card's k heaviest are left out before anything is shuffled.
    """
    if idf is None:
        n = cards.groupBy("persona_id").agg(F.count("*").alias("_n"))
        if dfs is None:
            tf = topic_counts(cards, tokens).withColumn("df", F.count("*").over(Window.partitionBy("persona_id", "term"))).join(n, "persona_id")
        else:
            known = dfs.select("persona_id", "term", F.col("df").alias("value")).orderBy(F.desc("df")).limit(KNOWN).toArrow()
            rest = 0 if known.num_rows < KNOWN else pc.min(known["value"]).as_py()
            rarity = lambda n, df: np.log((n + 1) / (df + 1))
            likely = _contenders(k, known, lambda df, found, n: (rarity(n, np.where(found, df, max(rest, 1))), rarity(n, np.where(found, df, 1))))
            tf = topic_counts(cards.join(F.broadcast(n), "persona_id"), tokens, likely, ("_n",)).join(dfs, ["persona_id", "term"])
        scored = tf.withColumn("weight", F.round(F.col("tf") * F.log((F.col("_n") + 1) / (F.col("df") + 1)), 6))
    else:
        known = idf.filter("term IS NOT NULL AND idf IS NOT NULL").select("term", F.col("idf").cast("double").alias("value")).orderBy("idf").limit(KNOWN).toArrow()
        there = idf.filter("term IS NOT NULL").agg(F.max("idf").cast("double")).first()[0] or 0.0
        other = idf.filter("term IS NULL").agg(F.coalesce(F.max("idf").cast("double"), F.lit(0.0)).alias("_other"))
        new = other.first()[0]
        least, most = (new, new) if known.num_rows < KNOWN else (min(new, pc.max(known["value"]).as_py()), max(new, there))
        likely = _contenders(k, known, lambda value, found, n: (np.where(found, value, least), np.where(found, value, most)))
        tf = topic_counts(cards, tokens, likely)
        scored = tf.join(idf.filter("term IS NOT NULL"), "term", "left").join(F.broadcast(other)).withColumn("weight", F.round(F.col("tf") * F.coalesce("idf", "_other", F.lit(0.0)), 6))
    order = Window.partitionBy("persona_id", "card_id").orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("persona_id", "card_id", "seq", "term", "rank")


def ledger(cards: DataFrame, terms: DataFrame | None = None, stop: list[str] | None = None, most: int = CARD_NODES) -> DataFrame:
    """(persona_id, card_id, seq, pos, node, when): distinct nodes of each card in order; first its subject's parts, then keywords, then content terms. when: the card's time."""
    stop = ENGLISH_STOP_WORDS if stop is None else stop
    terms = content_terms(cards) if terms is None else terms
    named = F.concat(split_terms(F.col("subject")), F.flatten(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), split_terms)))
    given = cards.select("persona_id", F.col("id").alias("card_id"), "seq", F.posexplode(named).alias("at", "raw")).withColumn("phase", F.lit(0))
    found = terms.select("persona_id", "card_id", "seq", F.col("rank").alias("at"), F.col("term").alias("raw"), F.lit(1).alias("phase"))
    each = given.unionByName(found).withColumn("node", norm_term(F.col("raw"))).filter((F.length("node") >= 2) & ~F.col("node").isin(*stop))
    first = each.groupBy("persona_id", "card_id", "seq", "node").agg(F.min(F.struct("phase", "at")).alias("first"))
    order = Window.partitionBy("persona_id", "card_id").orderBy("first", "node")
    rows = first.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
    times = cards.select("persona_id", F.col("id").alias("card_id"), F.col("created_at").alias("when"))
    return rows.join(times, ["persona_id", "card_id"]).select("persona_id", "card_id", "seq", "pos", "node", "when")


def _seen(led: DataFrame) -> Column:
    return F.max("when" if "when" in led.columns else F.lit(None).cast("timestamp")).alias("last_seen")


def nodes(led: DataFrame) -> DataFrame:
    """(persona_id, name, df, last_seen)."""
    return led.groupBy("persona_id", F.col("node").alias("name")).agg(F.count_distinct("card_id").alias("df"), _seen(led))


def edges(led: DataFrame) -> DataFrame:
    """(persona_id, a, b, weight, last_seen), a < b: cards that hold both. A card's few nodes are paired in place, without a join."""
    per_card = led.groupBy("persona_id", "card_id").agg(F.array_sort(F.collect_set("node")).alias("ns"), _seen(led))
    pairs = F.flatten(F.transform("ns", lambda a, i: F.transform(F.slice("ns", i + 2, F.size("ns")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per_card.select("persona_id", "last_seen", F.explode(pairs).alias("e")).groupBy("persona_id", F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count("*").alias("weight"), F.max("last_seen").alias("last_seen"))


def adjacency(e: DataFrame) -> DataFrame:
    """(persona_id, src, dst, w): each edge both ways."""
    return e.select("persona_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").alias("w")).unionByName(e.select("persona_id", F.col("b").alias("src"), F.col("a").alias("dst"), F.col("weight").alias("w")))


def corpus_size(led: DataFrame) -> DataFrame:
    """(persona_id, n): distinct cards, at least 1."""
    return led.groupBy("persona_id").agg(F.greatest(F.lit(1), F.count_distinct("card_id")).alias("n"))


def top_nodes(n: DataFrame, k: int) -> DataFrame:
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("persona_id").orderBy(F.desc("df"), "name"))).filter(F.col("rank") <= k)


def top_edges(e: DataFrame, k: int) -> DataFrame:
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("persona_id").orderBy(F.desc("weight"), "a", "b"))).filter(F.col("rank") <= k)


def neighbors(adj: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(persona_id, src, dst, w, rank): the k heaviest neighbours of the wanted (persona_id, src)."""
    wanted = sources.select("persona_id", "src").distinct()
    near = asked_for(adj, wanted, ["persona_id", "src"]).join(wanted, ["persona_id", "src"], "left_semi")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("persona_id", "src").orderBy(F.desc("w"), "dst"))).filter(F.col("rank") <= k)


def node_dfs(n: DataFrame, names: DataFrame) -> DataFrame:
    return n.join(names.select("persona_id", "name").distinct(), ["persona_id", "name"], "left_semi")


def nodes_for_cards(led: DataFrame, cards: DataFrame) -> DataFrame:
    """(persona_id, card_id, nodes): the nodes of the wanted cards in order."""
    wanted = led.join(cards.select("persona_id", "card_id").distinct(), ["persona_id", "card_id"], "left_semi")
    return wanted.groupBy("persona_id", "card_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes"))


def cards_for_nodes(led: DataFrame, lit: DataFrame, by: tuple[str, ...] = ("query_id", "persona_id")) -> DataFrame:
    """(query_id, persona_id, card_id, score): summed weights of the lit (query_id, persona_id, node, weight)."""
    return led.join(lit, ["persona_id", "node"]).groupBy(*by, "card_id").agg(F.sum("weight").alias("score"))


def cards_for_node(led: DataFrame, names: DataFrame, k: int | Column) -> DataFrame:
    """The newest k cards of each wanted (persona_id, node)."""
    found = led.join(names.select("persona_id", "node").distinct(), ["persona_id", "node"], "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("persona_id", "node").orderBy(F.desc("seq"), "card_id"))).filter(F.col("rank") <= k)


def _pmi(w: Column, n: Column, a: Column, b: Column) -> Column:
    return F.log(w * n / (a * b))


def strong_partners(adj: DataFrame, n: DataFrame, size: DataFrame, sources: DataFrame, k: int = 5, least: float = 0.0, most_ratio: float = 0.5, scan: int = 15) -> DataFrame:
    """(persona_id, src, dst, pmi, rank): of the ``scan`` heaviest neighbours, those that aren't everywhere, by PMI."""
    df = lambda name, out: n.select("persona_id", F.col("name").alias(name), F.col("df").alias(out))
    near = neighbors(adj, sources, scan).drop("rank").join(df("src", "df_a"), ["persona_id", "src"]).join(df("dst", "df_b"), ["persona_id", "dst"]).join(size, "persona_id")
    near = near.filter(F.col("df_b") <= most_ratio * F.col("n")).withColumn("pmi", _pmi(F.col("w"), F.col("n"), F.col("df_a"), F.col("df_b"))).filter(F.col("pmi") >= least)
    order = Window.partitionBy("persona_id", "src").orderBy(F.desc(F.round("pmi", 9)), F.desc("w"), "dst")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("persona_id", "src", "dst", "w", "pmi", "rank")


def topic_sharpness(adj: DataFrame, n: DataFrame, size: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """(persona_id, src, sharpness): mean PMI of the k heaviest neighbours; a neighbour that isn't a node counts as rare (1)."""
    df = lambda name, out: n.select("persona_id", F.col("name").alias(name), F.col("df").alias(out))
    near = neighbors(adj, sources, k).join(df("src", "df_a"), ["persona_id", "src"]).join(df("dst", "df_b"), ["persona_id", "dst"], "left").join(size, "persona_id")
    return near.groupBy("persona_id", "src").agg(F.avg(_pmi(F.col("w"), F.col("n"), F.col("df_a"), F.coalesce("df_b", F.lit(1)))).alias("sharpness"))


def stats(n: DataFrame, e: DataFrame, led: DataFrame) -> DataFrame:
    """(persona_id, nodes, edges, postings, cards)."""
    count = lambda df, name: df.groupBy("persona_id").agg(F.count("*").alias(name))
    out = count(n, "nodes").join(count(e, "edges"), "persona_id", "full").join(led.groupBy("persona_id").agg(F.count("*").alias("postings"), F.count_distinct("card_id").alias("cards")), "persona_id", "full")
    return out.na.fill(0)


def summary_gate(names: DataFrame, frequency: DataFrame, name: str = "name", most: int = SUMMARY_FREQUENCY) -> DataFrame:
    """names plus gf (general frequency, 0 if absent) and passes: whether a node may have a summary."""
    out = names.join(frequency.select(F.col("word").alias(name), "gf"), name, "left").withColumn("gf", F.coalesce("gf", F.lit(0)))
    bad = F.col(name).rlike("[:：]") | F.col(name).isin(*ENGLISH_STOP_WORDS) | F.col(name).rlike("^[0-9.]+$")
    return out.withColumn("passes", ~bad & (F.col("gf") < most))


def summary_candidates(n: DataFrame, summaries: DataFrame, frequency: DataFrame, min_df: int | Column = 5, min_new: int | Column = 3) -> DataFrame:
    """(persona_id, name, df, new, action) of nodes with enough cards and news.

    write: the gate lets it pass. Others aren't asked for again: reset (a summary is there, its counter restarts) or shell (an
    empty one is put down).
    """
    s = summaries.select("persona_id", F.col("node_name").alias("name"), "content", "new_since_write")
    due = n.join(s, ["persona_id", "name"], "left").withColumn("new", F.coalesce("new_since_write", "df")).filter((F.col("df") >= min_df) & (F.col("new") >= min_new))
    gated = summary_gate(due, frequency)
    action = F.when(F.col("passes"), "write").when(F.coalesce("content", F.lit("")) != "", "reset").otherwise("shell")
    return gated.select("persona_id", "name", "df", "new", action.alias("action"))


def add_news(summaries: DataFrame, led: DataFrame, touched: bool = False) -> DataFrame:
    """summaries whose counters are raised by the cards of new cards' ledger rows; nodes without a summary are counted by their df. touched: only those that are raised."""
    news = led.groupBy("persona_id", F.col("node").alias("node_name")).agg(F.count_distinct("card_id").alias("_news"))
    out = summaries.join(news, ["persona_id", "node_name"], "inner" if touched else "left")
    return out.withColumn("new_since_write", (F.coalesce("new_since_write", F.lit(0)) + F.coalesce("_news", F.lit(0))).cast("long")).select(*summaries.columns)


def settle(summaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """summaries after the candidates that the gate rejects: counters restart, and an empty one is put down where there is none."""
    done = candidates.filter("action <> 'write'").select("persona_id", F.col("name").alias("node_name"), F.lit(True).alias("_done"))
    both = summaries.join(done, ["persona_id", "node_name"], "full")
    fresh = F.when(F.col("_done"), 0).otherwise(F.col("new_since_write")).cast("long")
    return both.withColumn("new_since_write", fresh).withColumn("content", F.coalesce("content", F.lit(""))).withColumn("card_count", F.coalesce("card_count", F.lit(0).cast("long"))).select(*summaries.columns)


def summary_contents(summaries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(persona_id, node_name, content) of the summaries with text; names: only of these (persona_id, node_name)."""
    some = summaries.filter("coalesce(content, '') <> ''").select("persona_id", "node_name", "content")
    return some if names is None else some.join(names.select("persona_id", "node_name").distinct(), ["persona_id", "node_name"], "left_semi")


def save_summaries(summaries: DataFrame, written: DataFrame, now: str) -> DataFrame:
    """summaries with (persona_id, node_name, content, card_count) written: old texts go to the history, counters restart."""
    new = written.select("persona_id", "node_name", F.col("content").alias("_c"), F.col("card_count").alias("_n"), F.lit(True).alias("_w"))
    both = summaries.join(new, ["persona_id", "node_name"], "full")
    history = F.coalesce("edit_history", F.array().cast("array<struct<content:string,replaced_at:string>>"))
    old = F.array(F.struct(F.col("content").alias("content"), F.lit(now).alias("replaced_at")))
    w = F.col("_w").isNotNull()
    return both.select(
        "persona_id", "node_name", F.when(w, F.col("_c")).otherwise(F.col("content")).alias("content"), F.when(w, F.col("_n")).otherwise(F.col("card_count")).alias("card_count"),
        F.when(w, 0).otherwise(F.col("new_since_write")).cast("long").alias("new_since_write"), F.when(w, F.lit(now).cast("timestamp")).otherwise(F.col("last_rewrite")).alias("last_rewrite"),
        F.when(w & (F.coalesce("content", F.lit("")) != ""), F.concat(history, old)).otherwise(history).alias("edit_history"),
    )


def prune_summaries(summaries: DataFrame, n: DataFrame) -> DataFrame:
    """Summaries whose node is there; all of them for a persona without any nodes."""
    there = summaries.join(n.select("persona_id", F.col("name").alias("node_name")), ["persona_id", "node_name"], "left_semi")
    empty = summaries.join(n.select("persona_id").distinct(), "persona_id", "left_anti")
    return there.unionByName(empty.select(there.columns))


def migrate_summaries(summaries: DataFrame, frequency: DataFrame) -> DataFrame:
    """(persona_id, node_name, content, passes): texts that today's gate rejects are to be deleted; empty shells stay."""
    some = summaries.filter("coalesce(content, '') <> ''").select("persona_id", "node_name", "content")
    return summary_gate(some, frequency, "node_name").select("persona_id", "node_name", "content", "passes")


def summary_inputs(led: DataFrame, cards: DataFrame, names: DataFrame, last: int | Column = 50) -> DataFrame:
    """(persona_id, node, n_cards, cards_text): the newest cards of each node, active ones only, as one text for a writer."""
    recent = cards_for_node(led, names, last)
    live = cards.filter("NOT coalesce(legacy, false)").select("persona_id", F.col("id").alias("card_id"), "content", "source_time")
    each = recent.join(live, ["persona_id", "card_id"]).withColumn("line", F.concat(F.lit("["), F.coalesce("source_time", F.lit("")), F.lit("] "), F.coalesce("content", F.lit(""))))
    return each.groupBy("persona_id", "node").agg(F.count("*").alias("n_cards"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n---\n").alias("cards_text"))
