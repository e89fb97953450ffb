"""Region retrieval: summaries of the nodes a question names, then cards by full text; and its rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import time_prefix, topic_words

from . import fts, graph, names as known

# Cards per term, rows looked at per term, associated names, partners scanned for them and their least PMI.
PER_TERM, SCAN, ASSOCIATED, PARTNERS, LEAST_PMI = 3, 20, 2, 5, 1.0
REVIEW_NOTE = "（⚠ 这条记忆可能不完整，需要确认）"
PORTRAIT_ORDER = ("persona", "user", "relationship")


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, persona_id, token, at)."""
    return queries.select("query_id", "persona_id", F.posexplode(F.array_distinct(topic_words(F.col("text")))).alias("at", "token"))


def match_names(queries: DataFrame, names: DataFrame, frequency: DataFrame) -> DataFrame:
    """(query_id, persona_id, name, phase, at, pos): names of summaries that a question touches, distinct and in order.

    (a) a token is the name; (b) a rare name that isn't all ASCII occurs in the text, however that is cut into words (an ASCII one must
    be a token, so it's among (a)); (c) a token is the end of a longer name. Suffixes of names are spread out, so (c) is an equi-join.
    """
    tokens = query_tokens(queries)
    names = names.select("persona_id", "name").distinct()
    a = tokens.join(names, (tokens["persona_id"] == names["persona_id"]) & (tokens["token"] == names["name"])).select("query_id", tokens["persona_id"], "name", F.lit(0).alias("phase"), F.col("at").cast("long").alias("at"))
    rare = graph.summary_gate(names.filter(~F.col("name").rlike(r"^[\x00-\x7F]+$")), frequency).filter((F.col("gf") < graph.NAME_FREQUENCY) & (F.length("name") >= 2)).select("persona_id", "name")
    low = queries.select("query_id", "persona_id", F.lower("text").alias("text"))
    b = known.occurrences(low, rare, ["query_id"]).select("query_id", "persona_id", "name", F.lit(1).alias("phase"), F.lit(0).cast("long").alias("at"))
    ends = names.select("persona_id", "name", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("name"), F.lit(2))), lambda i: F.substr("name", i))).alias("token")).filter("token <> '' AND token <> name")
    c = tokens.join(ends, ["persona_id", "token"]).select("query_id", "persona_id", "name", F.lit(2).alias("phase"), F.col("at").cast("long").alias("at"))
    first = a.unionByName(b).unionByName(c).groupBy("query_id", "persona_id", "name").agg(F.min(F.struct("phase", "at")).alias("f"))
    return first.select("query_id", "persona_id", "name", "f.phase", "f.at").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("phase", "at", "name")))


def associate(queries: DataFrame, matched: DataFrame, names: DataFrame, adj: DataFrame, n: DataFrame, size: DataFrame) -> DataFrame:
    """(query_id, persona_id, name, pmi, pos): up to two strong partners of the question's tokens that have a summary and aren't matched."""
    tokens = query_tokens(queries)
    partners = graph.strong_partners(adj, n, size, tokens.select("persona_id", F.col("token").alias("src")), PARTNERS, LEAST_PMI)
    hits = tokens.withColumnRenamed("token", "src").join(partners, ["persona_id", "src"]).withColumnRenamed("dst", "name")
    hits = hits.join(names.select("persona_id", "name").distinct(), ["persona_id", "name"], "left_semi").join(matched.select("query_id", "name"), ["query_id", "name"], "left_anti")
    best = hits.groupBy("query_id", "persona_id", "name").agg(F.max("pmi").alias("pmi"), F.min(F.struct("at", "rank")).alias("f"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("pmi", 9)), "f", "name")
    return best.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= ASSOCIATED).select("query_id", "persona_id", "name", "pmi", "pos")


def region(
    queries: DataFrame, cards: DataFrame, summaries: DataFrame, adj: DataFrame, n: DataFrame, size: DataFrame, frequency: DataFrame, budget: int | Column = 5, excluded: DataFrame | None = None, portraits: bool = False,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(query_id, persona_id, rank, card_id, source, content): node summaries first, then cards term by term, within the budget.

    budget: a number, or a Column of persona_id. A term gives up to three live cards that no earlier term gave, of its 20 best by BM25. excluded: (query_id, card_id) not to show again,
    "summary_<name>" for summaries. Portraits take part only if asked for. index: stored postings and sizes of the cards.
    """
    some = summaries.filter("coalesce(content, '') <> ''").select("persona_id", F.col("node_name").alias("name"), F.col("content").alias("text"))
    matched = match_names(queries, some, frequency)
    assoc = associate(queries, matched, some, adj, n, size)
    named = matched.select("query_id", "persona_id", "name", F.lit(0).alias("g"), "pos").unionByName(assoc.select("query_id", "persona_id", "name", F.lit(1).alias("g"), "pos"))
    pages = named.join(some, ["persona_id", "name"]).select("query_id", "persona_id", F.concat(F.lit("summary_"), "name").alias("card_id"), F.concat(F.lit("["), "name", F.lit("] "), "text").alias("content"), "g", "pos")
    if excluded is not None:
        pages = pages.join(excluded.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")
    # terms: matched names, then tokens that aren't among them or the associated
    tokens = query_tokens(queries).join(named.select("query_id", F.col("name").alias("token")), ["query_id", "token"], "left_anti")
    terms = matched.select("query_id", "persona_id", F.col("name").alias("term"), F.lit(0).alias("g"), F.col("pos").cast("long").alias("at")).unionByName(tokens.select("query_id", "persona_id", F.col("token").alias("term"), F.lit(1).alias("g"), F.col("at").cast("long")))
    terms = terms.withColumn("t", F.row_number().over(Window.partitionBy("query_id").orderBy("g", "at", "term")))
    asked = terms.select(F.struct("query_id", "t").alias("query_id"), "persona_id", topic_words(F.col("term"), stop=[""]).alias("terms")).filter(F.size("terms") > 0)
    postings, sizes = index or (fts.postings(cards), fts.sizes(cards))
    shown = fts.ranked(fts.bm25(postings, sizes, asked), SCAN)
    live = cards.filter("NOT coalesce(legacy, false) AND trim(coalesce(content, '')) <> ''")
    live = (live if portraits else live.filter("NOT coalesce(is_portrait, false)")).select("persona_id", F.col("id").alias("card_id"), "content")
    hits = shown.join(live, ["persona_id", "card_id"]).select("query_id.query_id", "persona_id", "card_id", "content", "query_id.t", "rank")
    if excluded is not None:
        hits = hits.join(excluded.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")
    rows = pages.select("query_id", "persona_id", "card_id", "content", F.lit(0).alias("t"), (F.col("g") * 1000 + F.col("pos")).cast("int").alias("rank"))
    rows = rows.unionByName(hits.select("query_id", "persona_id", "card_id", "content", "t", F.col("rank").cast("int")))

    # a question has some tens of rows at most, SCAN per term: one fold over them in order
    each = F.struct("t", "rank", "card_id", "content")
    state = "struct<seen:array<string>,t:int,taken:int,out:array<struct<card_id:string,source:string,content:string>>>"

    def choose(s: Column, row: Column) -> Column:
        taken = F.when(s["t"] == row["t"], s["taken"]).otherwise(0)
        fits = (F.size(s["out"]) < F.col("_budget")) & ~F.array_contains(s["seen"], row["card_id"]) & ((row["t"] == 0) | (taken < PER_TERM))
        more = F.array(F.struct(row["card_id"].alias("card_id"), F.when(row["t"] == 0, "summary").otherwise("fts").alias("source"), row["content"].alias("content")))
        with_it = F.struct(F.concat(s["seen"], F.array(row["card_id"])).alias("seen"), row["t"].alias("t"), (taken + 1).alias("taken"), F.concat(s["out"], more).alias("out"))
        without = F.struct(s["seen"].alias("seen"), row["t"].alias("t"), taken.alias("taken"), s["out"].alias("out"))
        return F.when(fits, with_it.cast(state)).otherwise(without.cast(state))

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(-1).alias("t"), F.lit(0).alias("taken"), F.array().cast("array<struct<card_id:string,source:string,content:string>>").alias("out")).cast(state)
    offered = rows.groupBy("query_id", "persona_id").agg(F.sort_array(F.collect_list(each)).alias("r")).withColumn("_budget", F.lit(budget) if isinstance(budget, int) else budget)
    chosen = offered.select("query_id", "persona_id", F.posexplode(F.aggregate("r", start, choose, lambda s: s["out"])).alias("at", "c"))
    return chosen.select("query_id", "persona_id", (F.col("at") + 1).alias("rank"), "c.card_id", "c.source", "c.content")


def prompt(chosen: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """(query_id, prompt_text, card_ids) of chosen rows: summaries verbatim, then cards as lines with time and notes."""
    info = cards.select("persona_id", F.col("id").alias("card_id"), "created_at", "source_time", "needs_review", "annotations")
    rows = chosen.join(info, ["persona_id", "card_id"], "left")
    notes = F.concat_ws("\n", F.transform(F.filter(F.coalesce("annotations", F.array().cast("array<string>")), lambda a: a != ""), lambda a: F.concat(F.lit("  ※ "), a)))
    line = F.concat(F.lit("- "), time_prefix(F.col("created_at"), F.col("source_time"), F.col("card_id"), now), F.coalesce("content", F.lit("")), F.when(F.coalesce("needs_review", F.lit(False)), REVIEW_NOTE).otherwise(""))
    text = F.when(F.col("source") == "summary", F.col("content")).otherwise(F.when(notes == "", line).otherwise(F.concat(line, F.lit("\n"), notes)))
    every = F.sort_array(F.collect_list(F.struct("rank", text.alias("text"), "card_id")))
    return rows.groupBy("query_id").agg(every.alias("r")).select("query_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("prompt_text"), F.transform("r", lambda x: x["card_id"]).alias("card_ids"))


def portraits(cards: DataFrame) -> DataFrame:
    """(persona_id, portrait_type, card_id, content, tokens, at): the first active portrait of each type, in the order of injection."""
    rows = cards.filter("is_portrait AND NOT coalesce(legacy, false)").filter(F.col("portrait_type").isin(*PORTRAIT_ORDER))
    first = rows.groupBy("persona_id", "portrait_type").agg(F.min_by(F.struct(F.col("id").alias("card_id"), "content"), "seq").alias("c"))
    at = F.array_position(F.array(*[F.lit(p) for p in PORTRAIT_ORDER]), F.col("portrait_type"))
    return first.select("persona_id", "portrait_type", "c.card_id", "c.content", F.floor(F.length("c.content") / 2).alias("tokens"), at.alias("at"))
