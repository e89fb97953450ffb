"""Query expansion and hub-first retrieval over the term graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import ENGLISH_STOP_WORDS, topic_words

from . import graph


def extract_keywords(queries: DataFrame, n: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, persona_id, word, pos): words of a query's text; those the graph knows come first, rare before common."""
    each = queries.select("query_id", "persona_id", F.posexplode(F.array_distinct(topic_words(F.col("text")))).alias("at", "word"))
    known = each.join(n.select("persona_id", F.col("name").alias("word"), "df"), ["persona_id", "word"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("df").isNull(), F.coalesce("df", F.lit(0)), "at")
    return known.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k).select("query_id", "persona_id", "word", "pos")


def expand_keywords(
    words: DataFrame, adj: DataFrame, n: DataFrame, size: DataFrame, most: int = 5, min_weight: int = 4, min_df: int = 8, most_fraction: float = 0.15, pool: int = 80
) -> DataFrame:
    """(query_id, persona_id, word, score, rank): neighbours that say something about the query's words.

    Words in too many cards aren't asked; neighbours must be linked and known well enough, be new, and have positive PMI; their
    score is PMI times the log of the weight, the best over all words.
    """
    df = lambda name, out: n.select("persona_id", F.col("name").alias(name), F.col("df").alias(out))
    src = words.select("query_id", "persona_id", F.col("word").alias("src")).join(df("src", "df_a"), ["persona_id", "src"]).join(size, "persona_id")
    src = src.filter((F.col("df_a") > 0) & (F.col("df_a") <= F.greatest(F.lit(8), F.floor(F.col("n") * most_fraction))))
    near = graph.neighbors(adj, src, pool).drop("rank").filter((F.col("w") >= min_weight) & (F.length("dst") >= 2) & ~F.col("dst").isin(*ENGLISH_STOP_WORDS))
    hits = src.join(near, ["persona_id", "src"]).join(df("dst", "df_b"), ["persona_id", "dst"]).filter(F.col("df_b") >= min_df)
    hits = hits.join(words.select("query_id", F.col("word").alias("dst")), ["query_id", "dst"], "left_anti")
    pmi = F.log(F.col("w") * F.col("n") / (F.col("df_a") * F.col("df_b")))
    best = hits.withColumn("pmi", pmi).filter("pmi > 0").groupBy("query_id", "persona_id", F.col("dst").alias("word")).agg(F.max(F.col("pmi") * F.log("w")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "word")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def build_queries(queries: DataFrame, adj: DataFrame, n: DataFrame, size: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, persona_id, word, pos): a query's keywords, then their expansion."""
    words = extract_keywords(queries, n, k)
    more = expand_keywords(words, adj, n, size).select("query_id", "persona_id", "word", (F.col("rank") + k).alias("pos"))
    return words.unionByName(more)


def hub_retrieve(
    queries: DataFrame, sims: DataFrame, led: DataFrame, adj: DataFrame, n: DataFrame, size: DataFrame, k: int = 3, alpha: float = 0.6, hops: int = 1, excluded: DataFrame | None = None
) -> DataFrame:
    """(query_id, persona_id, card_id, energy, source, rank): cards near the query's nodes, blended with similarity.

    sims: (query_id, persona_id, card_id, sim, rank). Seeds are the query's words in the graph at 1 and the nodes of the first
    eight similar cards at their similarity. Each hop lights the twelve heaviest neighbours of the last layer with half its
    energy, by weight. Node energies are weighted by rarity and summed per card; both scores are scaled by their
    maximum. source: hub, or backstop for cards that only similarity found.
    """
    on = ["query_id", "persona_id"]
    names = n.select("persona_id", F.col("name").alias("node"), "df")
    words = queries.select(*on, F.explode(F.array_distinct(topic_words(F.col("text")))).alias("node")).join(names.drop("df"), ["persona_id", "node"], "left_semi").withColumn("e", F.lit(1.0))
    near = led.join(sims.filter("rank <= 8").select(*on, "card_id", "sim"), ["persona_id", "card_id"]).select(*on, "node", F.col("sim").alias("e"))
    layer = words.select(*on, "node", "e").unionByName(near).groupBy(*on, "node").agg(F.max("e").alias("e"))
    lit = layer
    for _ in range(hops):
        top = graph.neighbors(adj, layer.select("persona_id", F.col("node").alias("src")), 12)
        top = top.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("persona_id", "src")))
        layer = layer.withColumnRenamed("node", "src").join(top, ["persona_id", "src"]).groupBy(*on, F.col("dst").alias("node")).agg(F.sum(F.col("e") * 0.5 * F.col("share")).alias("e"))
        lit = lit.unionByName(layer)
    lit = lit.groupBy(*on, "node").agg(F.sum("e").alias("e")).join(names, ["persona_id", "node"], "left").join(size, "persona_id")
    rarity = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(1)) + 1)) + 1
    hub = graph.cards_for_nodes(led, lit.select(*on, "node", (F.col("e") * rarity).alias("weight")))
    both = hub.join(sims.select(*on, "card_id", "sim"), [*on, "card_id"], "full")
    w = Window.partitionBy("query_id")
    scaled = lambda c: F.when(F.max(c).over(w) > 0, F.coalesce(c, F.lit(0.0)) / F.max(c).over(w)).otherwise(0.0)
    both = both.withColumn("energy", alpha * scaled(F.col("score")) + (1 - alpha) * scaled(F.col("sim"))).withColumn("source", F.when(F.col("score").isNull(), "backstop").otherwise("hub"))
    if excluded is not None:
        both = both.join(excluded.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")
    order = w.orderBy(F.desc(F.round("energy", 9)), "card_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*on, "card_id", "energy", "source", "rank")
