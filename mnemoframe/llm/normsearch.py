"""Hard negatives by norm-bucketed exact inner-product search.

Vectors are sorted by norm and cut into buckets. An inner product is at most the product of both norms (Cauchy-Schwarz), so an anchor
needs a bucket only while its own norm times the bucket's largest reaches the lower limit of one of its windows and the score of the
k-th row found so far. Anchors are a stated query set; blocks of them meet spans of buckets, and no pair leaves a task that isn't among
the first k of its span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored, unstore

#: Rows of a bucket and of a span of buckets (about), and anchors of a block.
BUCKET, SPAN, BLOCK = 1024, 8192, 512
#: Positives of an anchor, negatives of a positive, and the window of negative scores in per cent of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Squared norms from which products could leave 64 bits; and under which float64 sums of integers are exact.
TOO_LONG, EXACT = 1 << 62, 1 << 53


def quantised(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, norm) of the rows that take part, v: array<double> of floor(scale * component)."""
    x = rows.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.filter(F.coalesce(fine, F.lit(False))).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))
    return x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).filter(F.col("norm") < float(TOO_LONG) ** 0.5)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, shorter ones filled up with zeros."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Integer inner products of all rows of a and b; ``longest``: no product of norms is larger."""
    if longest < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class First:
    """The first k (score, then id) of what has been offered, and the k-th score."""

    def __init__(self, k: int, least: int):
        self.k, self.score, self.ids, self.limit = k, np.zeros(0, np.int64), np.zeros(0, np.int64), least

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.ids, ids))
        by = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[by], ids[by]
        if len(by) == self.k:
            self.limit = max(self.limit, int(self.score[-1]))


def _spans(rows: DataFrame, count: int, span: int) -> DataFrame:
    """Stored rows with ``span``: numbers of ranges of falling norm, ties by id."""
    cut = rows.repartitionByRange(max(1, -(-count // span)), F.desc("norm"), "vec_id")
    return stored(cut.withColumn("span", F.spark_partition_id()), "spans")


def _search(asked: DataFrame, spans: DataFrame, same: bool, k: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(anchor_id, part, id, score): per anchor and window the first k rows of each span; and a stored table to drop when done.

    asked: (block, anchor_id, label, v, norm, parts array<struct<part, low, high, limit>>). same: rows of the anchor's label, else of others.
    """
    tops = spans.groupBy("span").agg(F.max("norm").alias("top"))  # a number for each of Spark's partitions, so never large
    need = F.min(F.expr("array_min(transform(parts, p -> greatest(p.low, p.limit)))") / F.greatest("norm", F.lit(1e-300)))
    # (block, span) that can hold anything at all: some anchor's norm times the span's largest reaches that anchor's limit
    live = stored(asked.groupBy("block").agg(need.alias("need")).join(F.broadcast(tops), F.col("top") * (1 + 1e-9) >= F.col("need")).select("block", "span"), "live")
    left, right = asked.join(live, "block"), spans.join(live, "span")

    def compare(key, a: pa.Table, c: pa.Table) -> pa.Table:
        anchor, part, ids, scores = [], [], [], []
        if a.num_rows and c.num_rows:
            chunk = lambda t, col: t[col].combine_chunks().chunk(0) if isinstance(t[col].combine_chunks(), pa.ChunkedArray) else t[col].combine_chunks()
            by = np.lexsort((c["vec_id"].to_numpy(), -c["norm"].to_numpy()))
            width = max(*(int(chunk(t, "v").value_lengths().to_numpy(zero_copy_only=False).max()) for t in (a, c)), 1)
            av, cv = _matrix(chunk(a, "v"), width), _matrix(chunk(c, "v"), width)[by]
            a_id, a_label, a_norm = (a[x].to_numpy() for x in ("anchor_id", "label", "norm"))
            c_id, c_label, c_norm = (c[x].to_numpy()[by] for x in ("vec_id", "label", "norm"))
            wants = [[(p["part"], p["low"], p["high"], First(k, p["limit"])) for p in row] for row in a["parts"].to_pylist()]
            for s in range(0, len(c_id), bucket):
                e, top = s + bucket, c_norm[s] * (1 + 1e-9)
                on = [i for i, w in enumerate(wants) if any(a_norm[i] * top >= max(low, first.limit) for _, low, _, first in w)]
                if not on:
                    continue
                score = products(av[on], cv[s:e], float(a_norm[on].max() * top))
                for x, i in enumerate(on):
                    fits = (c_label[s:e] == a_label[i]) == same
                    if same:
                        fits &= c_id[s:e] != a_id[i]
                    for _, low, high, first in wants[i]:
                        if a_norm[i] * top >= max(low, first.limit):
                            good = np.flatnonzero(fits & (score[x] >= max(low, first.limit)) & (score[x] <= high))
                            if len(good):
                                first.offer(score[x][good], c_id[s:e][good])
            for i, w in enumerate(wants):
                for p, _, _, first in w:
                    anchor += [a_id[i]] * len(first.ids)
                    part += [p] * len(first.ids)
                    ids += first.ids.tolist()
                    scores += first.score.tolist()
        return pa.table({"anchor_id": pa.array(anchor, pa.int64()), "part": pa.array(part, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return left.groupBy("block", "span").cogroup(right.groupBy("block", "span")).applyInArrow(compare, "anchor_id long, part long, id long, score long"), live


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "part").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


_PARTS = "array<struct<part:bigint,low:bigint,high:bigint,limit:bigint>>"


def _in_two_rounds(asked: DataFrame, spans: DataFrame, same: bool, k: int, bucket: int, count: int) -> DataFrame:
    """Stored: the first k per anchor and window over all spans. The longest vectors come first; the k-th scores they give prune the rest."""
    head = max(1, count // 8)
    found, live = _search(asked, spans.filter(F.col("span") < head), same, k, bucket)
    first = stored(_first(found, k), "first")
    unstore(live)
    if count <= head:
        return first
    reached = first.groupBy("anchor_id", "part").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    each = asked.select("anchor_id", F.inline("parts")).join(reached, ["anchor_id", "part"], "left")
    each = each.withColumn("limit", F.greatest("limit", F.coalesce("kth", F.lit(-TOO_LONG))))
    parts = each.groupBy("anchor_id").agg(F.collect_list(F.struct("part", "low", "high", "limit")).cast(_PARTS).alias("parts"))
    again = stored(asked.drop("parts").join(parts, "anchor_id"), "asked")
    rest, live = _search(again, spans.filter(F.col("span") >= head), same, k, bucket)
    out = stored(_first(first.drop("rank").unionByName(rest), k), "found")
    for t in (first, again, live):
        unstore(t)
    return out


def hard_negatives(
    rows: DataFrame, label: Column, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, span: int = SPAN, bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: (vec_id long, embedding, ...); ``label``: each row's label, ``anchors``: which rows ask. Scores are inner products of components
    floor(256 x); higher ones come first, ties by the smaller vec_id. An anchor's positives are its first other rows of the same label; for
    each, the first rows of other labels with least * positive <= 100 * negative <= most * positive are returned.

    Rows with a null vec_id, label or vector or any null or non-finite component take no part, nor do vectors whose quantised length is 2^31 and
    more (their products don't fit in a long). A missing component of a shorter vector is zero. A row that is repeated whole, vec_id
    included, counts once; rows of one vec_id that differ are one anchor each, not told apart in the result. Empty tables give an empty
    result; other columns are ignored.
    """
    base = stored(quantised(rows, label).distinct(), "vectors")
    spans = _spans(base, base.count(), span)
    n = spans.select("span").distinct().count()
    asking = base.filter(anchors).withColumnRenamed("vec_id", "anchor_id")
    blocks = max(1, -(-asking.count() // block))
    asking = stored(asking.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks))), "anchors")
    every = F.array(F.struct(*[F.lit(v).cast("long").alias(c) for c, v in (("part", 0), ("low", -TOO_LONG), ("high", TOO_LONG), ("limit", -TOO_LONG))])).cast(_PARTS)
    good = _in_two_rounds(asking.withColumn("parts", every), spans, True, positives, bucket, n)
    # integers: 100 * negative >= least * positive, so negative >= ceil(least * positive / 100)
    score = F.col("score").cast("decimal(30,0)")
    low, high = F.ceil(least * score / 100).cast("long"), F.floor(most * score / 100).cast("long")
    windows = good.select("anchor_id", F.col("rank").cast("long").alias("part"), low.alias("low"), high.alias("high"), F.lit(-TOO_LONG).alias("limit")).filter("low <= high")
    parts = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("part", "low", "high", "limit")).cast(_PARTS).alias("parts"))
    asked = stored(asking.join(parts, "anchor_id"), "asked")
    bad = _in_two_rounds(asked, spans, False, negatives, bucket, n)
    for t in (base, spans, asking, asked):
        unstore(t)
    pos = good.select("anchor_id", F.col("rank").cast("long").alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(pos, ["anchor_id", "part"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB: the same rows from ``embeddings``, by comparing each anchor with all rows.
SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
