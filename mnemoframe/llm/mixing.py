"""Mixing sources to target weights: water-filled token targets, repetition rates, seeded Bernoulli copies.

DataFrame functions only. One pass over the texts counts words; what is shuffled after it is one short row
per document, and only until the per-source totals (one row per source) are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, stored

#: Draws are 48-bit: the first 12 hex digits of an MD5.
DRAW = 2.0**48


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1), the same on every run: from the MD5 of "seed:doc_id"."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(DRAW)


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> plus ``target`` and ``rate``.

    Sources in code-point order, null last, get the weights in turn. The targets share the sum of all sizes
    by weight; none exceeds ``most`` times its source's size, and what is over is shared anew by weight. The
    fixed point of that resharing is min(cap, level * weight), with the capped sources being those of the
    smallest cap per weight; so one ordered pass over the source totals finds the level.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = totals.withColumn("turn", turn).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "turn")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    w = w.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    # the first source (by cap per weight) that isn't capped sets the level for itself and all after it
    w = w.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "turn", F.col("level").alias("v")))).over(whole)["v"])
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    return w.withColumn("target", target).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, rate, copies.

    size: words of the text (null or empty: 0). copies: floor(rate), plus one with probability rate - floor(rate),
    drawn from a hash of seed and doc_id. Rows with equal doc_id (repeated rows, or null ids) draw alike. Null is a
    source of its own. An empty table gives an empty result. Other columns of docs are ignored.
    """
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = stored(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = stored(targets(totals, weights, most), "mix-rates")
    # one row per source; AQE broadcasts it while it is under its threshold and splits hot partitions beyond it
    joined = sized.join(rates.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as its plan says: same columns, copies as repeated rows.

    The text isn't shuffled: sizes and rates come first, then every row is repeated where it is read. Columns of any name
    pass unchanged.
    """
    sized = docs.select("source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    weights, most, seed = options.get("weights", (1, 2, 3)), options.get("most", 3.0), options.get("seed", 17)
    rates = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-rates")
    keyed = rates.select(F.col("source").alias("_src"), F.col("rate").alias("_rate"))
    joined = docs.select(F.struct("*").alias("row")).join(keyed, F.col("row.source").eqNullSafe(F.col("_src")))
    whole = F.floor("_rate")
    n = (whole + F.when(draw(F.col("row.doc_id"), seed) < F.col("_rate") - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn("_n", n).filter("_n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("row.*")


SQL_PLAN = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM totals),
w AS (SELECT *, CAST(turn % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM turns),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
one AS (SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, turn LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, coalesce((SELECT level FROM one) * w, cap)) END AS target FROM w),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
mixed AS (SELECT d.*, r.source_size, r.target, CAST(floor(rate) AS BIGINT)
      + CASE WHEN CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
      FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
"""
