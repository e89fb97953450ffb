"""Exact cosine search, pairs over a threshold, and dedup by vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one part when all pairs of a persona are compared: some parts of PART keep tasks busy, many are of MOST, as each vector goes to every part.
PART, FEW_PARTS, MOST = 2000, 8, 16384
#: Queries of a block and vectors of a span, about, that a task compares.
BLOCK, SPAN = 256, 8192


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))


def _array(t: pa.Table, column: str) -> pa.Array:
    c = t[column].combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    return _array(t, column).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(float)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, only: DataFrame | None = None, block: int = BLOCK, span: int = SPAN, same: str | None = None) -> DataFrame:
    """(query_id, persona_id, card_id, sim, rank): nearest unit vectors of the query's persona.

    Blocks of queries meet spans of vectors, which are multiplied as matrices; a task keeps the first k of each query.
    only: (query_id, card_id) to which a query is limited; the limit comes before the top k, so k are found if there are k, and
    only these pairs are compared. same: a column that a query and its vectors must share; it cuts the tiles, so no pair is stored.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "card_id")
    keys = ["persona_id", *([same] if same else [])]
    q = queries.select("query_id", *keys, F.col("embedding").alias("_q"))
    if only is not None:
        found = only.select("query_id", "card_id").distinct().join(q, "query_id").join(vectors.select("persona_id", "card_id", "embedding"), ["persona_id", "card_id"])
        found = found.withColumn("sim", dot(F.col("embedding"), F.col("_q"))).select("query_id", "persona_id", "card_id", "sim")
    else:
        parts = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        counts = parts(vectors, span, "spans").join(parts(q, block, "blocks"), keys)
        number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        on = [*keys, "block", "span"]
        left = q.join(counts, keys).withColumn("block", number("query_id", "blocks")).withColumn("span", every("spans")).select(*on, "query_id", "_q")
        right = vectors.join(counts, keys).withColumn("span", number("card_id", "spans")).withColumn("block", every("blocks")).select(*[F.col(c).alias(f"_{c}") for c in on], "card_id", "embedding")

        def compare(a: pa.Table, v: pa.Table) -> pa.Table:
            which, cards, sims = [], [], []
            if a.num_rows and v.num_rows:
                ids = np.argsort(np.array(v["card_id"].to_pylist(), object), kind="stable")
                sim = (_matrix(a, "_q") @ _matrix(v, "embedding").T)[:, ids]
                shown = np.round(sim, 9)
                for i in range(a.num_rows):
                    first = np.argsort(-shown[i], kind="stable")[:k]
                    which += [i] * len(first)
                    cards += ids[first].tolist()
                    sims += sim[i, first].tolist()
            take = lambda t, c, at: _array(t, c).take(pa.array(at, pa.int64())) if t.num_rows else pa.nulls(0, t.schema.field(c).type)
            return pa.table({"query_id": take(a, "query_id", which), "persona_id": take(a, "persona_id", which), "card_id": take(v, "card_id", cards), "sim": pa.array(sims, pa.float64())})

        kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, persona_id string, card_id string, sim double"
        found = left.groupBy(*on).cogroup(right.groupBy(*[f"_{c}" for c in on])).applyInArrow(compare, kinds)
    if least is not None:
        found = found.filter(F.col("sim") >= least)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def part_count(n: Column, part: int = PART) -> Column:
    """Parts that n vectors are dealt to: of ``part`` vectors while they are few, then so few that each vector isn't sent more often than needed."""
    return F.least(F.ceil(n / part), F.greatest(F.lit(FEW_PARTS), F.ceil(n / MOST))).cast("int")


def pairs_over(vectors: DataFrame, least: float | Column, part: int = PART) -> DataFrame:
    """(persona_id, seq_a, seq_b, sim), seq_a < seq_b: pairs of unit vectors of a persona with sim >= least, a number or a Column of persona_id.

    A persona's vectors are dealt to parts by hash, and every two parts meet in a tile of their own, multiplied as matrices;
    only pairs over the threshold leave a tile.
    """
    own = F.lit(float(least)) if isinstance(least, (int, float)) else least.cast("double")
    n = vectors.groupBy("persona_id").agg(F.count("*").alias("n")).withColumn("_least", own)
    rows = vectors.select("persona_id", "seq", "embedding").join(n, "persona_id").withColumn("parts", part_count(F.col("n"), part))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = rows.select("persona_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "_least", "seq", F.col("embedding").alias("v"))

    def compare(t: pa.Table) -> pa.Table:
        v = _matrix(t, "v")
        own, seq = t["own"].to_numpy(), t["seq"].to_numpy()
        cross = t["i"][0].as_py() != t["j"][0].as_py()
        left = np.flatnonzero(own == t["i"][0].as_py()) if cross else np.arange(t.num_rows)
        right = np.flatnonzero(own == t["j"][0].as_py()) if cross else left
        a, b, s = [], [], []
        floor = t["_least"][0].as_py()
        for k in range(0, len(left), 500):
            sim = v[left[k : k + 500]] @ v[right].T
            x, y = np.nonzero(sim >= floor - 1e-9)
            p, q = seq[left[k + x]], seq[right[y]]
            keep = p != q if cross else p < q
            a.append(np.minimum(p, q)[keep])
            b.append(np.maximum(p, q)[keep])
            s.append(sim[x, y][keep])
        cat = lambda z, kind: np.concatenate(z) if z else np.zeros(0, kind)
        a, b, s = cat(a, np.int64), cat(b, np.int64), cat(s, float)
        return pa.table({"persona_id": pa.array([t["persona_id"][0].as_py()] * len(a), pa.string()), "seq_a": a, "seq_b": b, "sim": s})

    return tiles.groupBy("persona_id", "i", "j").applyInArrow(compare, "persona_id string, seq_a long, seq_b long, sim double").filter(F.round("sim", 9) >= own)


def superseded(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """(persona_id, seq) of cards that a near copy supersedes.

    In a persona whose cards' times never go back with seq, each card with a later near copy goes. Elsewhere the greedy
    pass of the nightly review is replayed over the pairs alone, in order of seq: of each pair that still stands, the older by
    time goes (of equal times, the one that came first).
    """
    times = cards.select("persona_id", "seq", "created_at")
    step = F.lag("created_at").over(Window.partitionBy("persona_id").orderBy("seq"))
    odd = times.withColumn("back", F.col("created_at") < step).groupBy("persona_id").agg(F.max("back").alias("odd")).filter("odd").select("persona_id")
    plain = pairs.join(odd, "persona_id", "left_anti").select("persona_id", F.col("seq_a").alias("seq")).distinct()
    at = lambda name: times.select("persona_id", F.col("seq").alias(f"seq_{name}"), F.col("created_at").alias(f"time_{name}"))
    timed = pairs.join(odd, "persona_id", "left_semi").join(at("a"), ["persona_id", "seq_a"]).join(at("b"), ["persona_id", "seq_b"])

    def replay(t: pa.Table) -> pa.Table:
        gone: set[int] = set()
        for a, b, x, y in sorted(zip(*(t[c].to_pylist() for c in ("seq_a", "seq_b", "time_a", "time_b")))):
            if a not in gone and b not in gone:
                gone.add(a if x <= y else b)
        return pa.table({"persona_id": pa.array([t["persona_id"][0].as_py()] * len(gone), pa.string()), "seq": pa.array(sorted(gone), pa.int64())})

    return plain.unionByName(timed.select("persona_id", "seq_a", "seq_b", "time_a", "time_b").groupBy("persona_id").applyInArrow(replay, "persona_id string, seq long"))


def embed(cards: DataFrame, encode, column: str = "text", size: int | None = None) -> DataFrame:
    """cards plus ``embedding`` from encode(list of texts) -> array (n, d), normalised; batch by batch in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(encode(b[column].to_pylist()), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(norm == 0, 1, norm)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return cards.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cards.schema) + ", embedding array<float>")
