"""Benchmark decontamination by a positional inverted index over the training tokens.

DataFrame functions only. The index holds postings (term, document, position) of the terms that lead a window: of each
window's terms the one with the fewest training tokens. The leading list, shifted by the term's offset in the window,
gives the candidate starts; a posting carries its positional neighbourhood, so the other terms' offset-adjusted lists
are intersected with it where it lies instead of by one more shuffle for each term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, stored, without

#: All ASCII characters outside words; upper case is mapped to lower case and the rest to blanks.
OUTSIDE = "".join(chr(i) for i in range(1, 128) if not chr(i).isalnum())
#: A broadcast table has at most so many rows of a few hundred bytes.
SMALL_ROWS = 100_000
#: Terms with over 1/HOT of all tokens (of which there are at most HOT) don't go through a shuffle by term.
HOT = 2000


def words(text: Column) -> Column:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in order (null: none)."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", " "), UPPER + OUTSIDE, LOWER + " " * len(OUTSIDE))
    return F.array_remove(F.split(plain, " "), "")


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows of each item: item_id, terms (size consecutive words; all of a shorter item)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("terms")).distinct()


def few(df: DataFrame) -> bool:
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): training tokens of each wanted term; terms without any are absent. Where the terms are too many to broadcast, of all terms."""
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if few(terms):
        tokens = tokens.join(F.broadcast(terms), "term", "left_semi")
    return tokens.groupBy("term").agg(F.count("*").alias("n"))


def leads(wins: DataFrame, freq: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, plus their rarest term and its offset."""
    each = wins.select("wid", "terms", F.posexplode("terms").alias("offset", "term")).join(freq, "term")
    best = each.groupBy("wid").agg(F.min(F.struct("n", "offset", "term")).alias("m"), F.count("*").alias("have"))
    return wins.join(best.filter("m is not null"), "wid").filter(F.col("have") == F.size("terms")).select("wid", "terms", F.col("m.term").alias("term"), F.col("m.offset").alias("offset"))


def postings(docs: DataFrame, terms: DataFrame, reach: int, freq: DataFrame) -> DataFrame:
    """The index: (term, doc_id, key, pos, near, at) for each token that is a wanted term.

    near: the words from ``reach`` before it to ``reach`` after it; at: the token's place in near. key tells apart rows
    that share a doc_id. Terms too many to broadcast are met by shuffle: a token then carries its neighbourhood, never
    its text, and hot terms are kept or dropped where they lie.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    each = rows.select("doc_id", "key", "w", F.posexplode("w").alias("pos", "term"))
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    near = ["term", "doc_id", "key", "pos", F.slice("w", start + 1, F.col("pos") - start + reach + 1).alias("near"), (F.col("pos") - start).alias("at")]
    if few(terms):
        return each.join(F.broadcast(terms), "term", "left_semi").select(*near)
    hot = _hot(freq).join(terms.withColumn("wanted", F.lit(True)), "term", "left").select("term", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    each = each.select(*near).join(F.broadcast(hot), "term", "left")
    return each.filter("wanted").drop("wanted").unionByName(each.filter("wanted IS NULL").drop("wanted").join(terms, "term", "left_semi"))


def _hot(freq: DataFrame) -> DataFrame:
    """(term, parts): the terms with over 1/HOT of all counted tokens, and by how much; at most HOT rows."""
    total = freq.agg(F.sum("n")).first()[0] or 0
    return freq.filter(F.col("n") * HOT > total).select("term", F.ceil(F.col("n") * HOT / total).cast("int").alias("parts"))


def meet(index: DataFrame, lead: DataFrame, freq: DataFrame) -> DataFrame:
    """Postings beside each window that their term leads. Windows too many to broadcast are met by shuffle, hot terms in parts."""
    if few(lead):
        return index.join(F.broadcast(lead), "term")
    hot = F.broadcast(_hot(freq.join(lead.select("term").distinct(), "term", "left_semi")))
    parts = F.coalesce("parts", F.lit(1))
    left = index.join(hot, "term", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "pos"), parts).cast("int")).drop("parts")
    right = lead.join(hot, "term", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["term", "part"]).drop("part")


def phrases(index: DataFrame, lead: DataFrame, freq: DataFrame) -> DataFrame:
    """Exact phrase matches: doc_id, key, wid, start, length."""
    first = F.col("at") - F.col("offset")
    found = (first >= 0) & (F.slice("near", F.greatest(first, F.lit(0)) + 1, F.size("terms")) == F.col("terms"))
    return meet(index, lead, freq).filter(found).select("doc_id", "key", "wid", (F.col("pos") - F.col("offset")).alias("start"), F.size("terms").alias("length"))


def proximity(docs: DataFrame, benchmark: DataFrame, size: int = 10, reach: int = 20) -> DataFrame:
    """Looser matches: doc_id, item_id (as text), pos where all terms of a window lie within ``reach`` words of its rarest term."""
    wins, lead, freq = _plan(docs, benchmark, size)
    index = postings(docs, lead.select("term").distinct(), reach, freq)
    hit = meet(index, lead, freq).filter(F.size(F.array_except("terms", "near")) == 0)
    return hit.join(wins.select("wid", F.explode("items").alias("item_id")), "wid").select("doc_id", "item_id", "pos").distinct()


def _plan(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    wins = windows(benchmark, size).groupBy("terms").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    wins = stored(wins.withColumn("wid", F.monotonically_increasing_id()), "windows")
    terms = wins.select(F.explode("terms").alias("term")).distinct()
    freq = stored(frequencies(docs, terms), "frequencies")
    return wins, stored(leads(wins, freq), "leads"), freq


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``size`` consecutive words of an item (a shorter item with words is one window). A document word inside
    any occurrence of a window is hit, once. Null and empty texts have no words; items without words have no windows. An empty
    benchmark hits nothing; an empty docs table gives an empty result. Rows that share doc_id and text agree; benchmark rows
    that share an item_id count as one item. Other columns are ignored.
    """
    wins, lead, freq = _plan(docs, benchmark, size)
    index = postings(docs, lead.select("term").distinct(), size - 1, freq)
    found = stored(phrases(index, lead, freq).distinct(), "phrases")
    # n_hit: the union of the intervals of a document, in order of their starts
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    spans = found.select("doc_id", "key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0))).groupBy("doc_id", "key").agg(F.sum("new").cast("long").alias("n_hit"))
    items = (
        found.select("doc_id", "key", "wid").distinct().join(wins.select("wid", F.explode("items").alias("item")), "wid")
        .groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    marks = hits.join(items.withColumnsRenamed({"doc_id": "i_doc", "key": "i_key"}), F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("key") == F.col("i_key"))).select(
        F.col("doc_id").alias("m_doc"), F.col("key").alias("m_key"), "n_hit", "items"
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("key") == F.col("m_key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without those that hold a window of the benchmark; same columns."""
    _, lead, freq = _plan(docs, benchmark, size)
    index = postings(docs, lead.select("term").distinct(), size - 1, freq)
    return without(docs, stored(phrases(index, lead, freq).select("doc_id", "key").distinct(), "contaminated"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.s, g.n, wins.item_id FROM grams g JOIN wins ON g.n = wins.n AND g.g = wins.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
