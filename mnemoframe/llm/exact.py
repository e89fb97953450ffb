"""Exact dedup by content-defined chunk recipes.

DataFrame functions only. Each text is read once, where it lies: it is normalised, cut into content-defined chunks and
described by its recipe, the ordered list of its chunks' identifiers. Texts and chunks themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import look_up, stored

#: A chunk ends after a sentence end that follows one of these letters, not before ``least`` and not after ``most`` characters.
TRIGGER = r"(?<=[adehilnorstuy][.!?,;:] )"
#: Where there is no such place, which is so in many scripts and in code, it ends after two characters that repeat the two before
#: them (with one between them or none), else after a character that is also the last but one.
ECHOES = (r"(..).?\1", r"(.).\2")


def chunks(text, least: int = 512, most: int = 4096):
    """Column of the content-defined chunks of a text; joined they are the text again."""
    echoes = "".join(f"|.{{{least},{most - 5}}}?{e}" for e in ECHOES)
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 1}}}?{TRIGGER}{echoes}|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, least: int = 512, most: int = 4096) -> DataFrame:
    """Stored table, a row per row of docs: rid, doc_id, text_sha256, recipe (64-bit chunk ids in order), proofs (their SHA-256)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", F.sha2("t", 256).alias("text_sha256"), chunks(F.col("t"), least, most).alias("c"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "text_sha256",
        F.transform("c", lambda x: F.xxhash64(x)).alias("recipe"), F.transform("c", lambda x: F.unhex(F.sha2(x, 256))).alias("proofs"),
    )
    return stored(rows, "recipes")


def verified(rows: DataFrame) -> DataFrame:
    """recipes() plus ``fix``: for chunks whose 64-bit id also belongs to another content, (position, rank of its SHA-256).

    All chunks' (id, SHA-256) pairs are deduplicated, with partial aggregation before the shuffle. An id with one
    SHA-256 is verified. Of an id with several, the contents are ranked; rank 0 keeps the bare id and the others are
    told apart by their rank. So equal (recipe, fix) means equal lists of verified identifiers.
    """
    each = rows.select("rid", F.posexplode(F.arrays_zip("recipe", "proofs")).alias("pos", "c")).select("rid", "pos", F.col("c.recipe").alias("id"), F.col("c.proofs").alias("proof"))
    pairs = each.groupBy("id", "proof").agg(F.count("*").alias("n"))
    clashes = pairs.groupBy("id").agg(F.count("*").alias("contents"), F.min("proof").alias("first")).filter("contents > 1")
    clashes = stored(clashes.select("id", F.col("first")), "clashes")
    if clashes.isEmpty():
        return rows.withColumn("fix", F.array().cast("array<struct<pos:int,rank:binary>>"))
    other = each.join(clashes, "id").filter(F.col("proof") != F.col("first"))
    fixes = other.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("proof").alias("rank")))).alias("fix"))
    return rows.join(fixes, "rid", "left").withColumn("fix", F.coalesce("fix", F.array().cast("array<struct<pos:int,rank:binary>>")))


def dedup(docs: DataFrame, least: int = 512, most: int = 4096) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. Of equal
    texts the row with the smallest doc_id stays (null ids last); of several rows with that id, one. An empty table gives an empty
    result; other columns are ignored. Recipes with thousands or millions of rows are handled by look_up().
    """
    rows = recipes(docs, least, most)
    rows = stored(verified(rows).select("rid", "doc_id", "text_sha256", "recipe", "fix", F.xxhash64("recipe", F.to_json("fix")).alias("key")), "verified")
    # the same lists of identifiers: compared as lists, the hash only leads
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = rows.groupBy("key", "recipe", "fix").agg(first.alias("first"), F.count("*").alias("group_size"))
    groups = groups.filter("group_size > 1").select("key", "recipe", "fix", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size")
    groups = stored(groups, "copies")
    total = rows.count()
    out = look_up(rows, groups, ["key", "recipe", "fix"], "group_size", total)
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256",
    )


SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
