"""SimHash near-dedup with pivot distance tables.

Fingerprints are made where the texts lie. Two fingerprints within ``most`` bits agree on all but ``most`` of the blocks of
bits, so each is dealt to one bucket for each choice of that many blocks (exact: no link is lost); the number of blocks
follows the number of fingerprints, so that buckets stay small. In a bucket,
a table of Hamming distances to reference fingerprints (pivots) discards pairs: by the triangle inequality a pair within
``most`` bits differs by at most ``most`` in every coordinate. Survivors are verified by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from ._common import bound_batches, look_up, stored, without
from .components import connected

SEED = 42
PIVOTS = 24
#: Fingerprints that a bucket holds on average, at most; more of them are cut into more blocks.
BUCKET = 64
#: A bucket with more distinct fingerprints is compared in tiles of two parts of this size.
PART = 2000
#: Parts of the texts of one fingerprint; each text is proposed with its part's first, and the parts' firsts with that of all.
SALT = 1024
#: Words hashed at once.
STRETCH = 1 << 16


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the size-word shingles (repeats included) of lower-cased words; none: 0."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    n, ones, h64 = len(words) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STRETCH):
        part = words[at : min(at + STRETCH, n) + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)))) if size > 1 else part
        h = np.fromiter((h64(x, SEED) for x in shingles), np.uint64)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Stored (doc_id, key, fp): a row per row of docs; fp is the fingerprint's bits as a signed long, key a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b["text"]], np.uint64)
            yield pa.record_batch([b["doc_id"], b["key"], pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp long"), "fingerprints")


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Distances (n x pivots) of fingerprints to fixed pseudo-random reference fingerprints."""
    refs = np.random.default_rng(SEED).integers(0, 1 << 64, pivots, np.uint64)
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning forests (index pairs) of the links within each group; side 0 marks groups compared whole, sides 1 and 2 are compared crosswise."""
    table = pivot_table(fps)
    order = np.lexsort((table[:, 0], group))
    fps, group, side, table = fps[order], group[order], side[order], table[order]
    parent, out = np.arange(len(fps)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at, lag = np.arange(len(fps)), 0
    while True:
        lag += 1
        at = at[at + lag < len(fps)]
        # sorted by the first coordinate: what is too far apart at this lag stays so at the next ones
        at = at[(group[at] == group[at + lag]) & (table[at + lag, 0] - table[at, 0] <= most)]
        if not len(at):
            break
        pair = at[(side[at] == 0) | (side[at] != side[at + lag])]
        for k in range(1, table.shape[1], 8):
            pair = pair[np.abs(table[pair, k : k + 8] - table[pair + lag, k : k + 8]).max(axis=1, initial=0) <= most]
        pair = pair[np.bitwise_count(fps[pair] ^ fps[pair + lag]) <= most]
        if len(pair):
            parent = parent[parent]
            pair = pair[parent[pair] != parent[pair + lag]]
            for i in pair.tolist():
                a, b = root(i), root(i + lag)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(order[i]), int(order[i + lag])))
    return out


def block_widths(n: int, most: int) -> list[int]:
    """Bits of the blocks that ``n`` 64-bit fingerprints are cut into: the fewest blocks, most + 2 at least, with which buckets are small."""
    blocks = most + 2
    while blocks < 64 and n >> (64 * (blocks - most) // blocks) > BUCKET:
        blocks += 1
    return [64 // blocks + (k < 64 % blocks) for k in range(blocks)]


def block_masks(most: int, n: int = 0) -> list[int]:
    """Masks of all choices of the blocks of which one choice agrees if at most ``most`` bits differ."""
    widths = block_widths(n, most)
    masks = [((1 << w) - 1) << a for a, w in zip(accumulate(widths, initial=0), widths)]
    return [sum(masks[i] for i in blocks) for blocks in combinations(range(len(widths)), len(widths) - most)]


def neighbours(nodes: DataFrame, most: int = 3, part: int = PART) -> DataFrame:
    """(fp) distinct -> edges (u, v) that connect just what links of at most ``most`` differing bits connect.

    Pairs are looked for among fingerprints that agree on all bits of a mask; block_masks() miss none. Buckets of over
    ``part`` fingerprints are split in parts, and every two parts meet in a tile of their own, so a hot bucket is spread over
    many tasks and no task holds more than two parts of a bucket.
    """
    keys = []
    for k, mask in enumerate(block_masks(most, nodes.count())):
        keys.append(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(int(np.uint64(mask).view(np.int64)))).alias("bits")))
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = dealt.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stored(sizes, "buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    dealt = look_up(dealt, sizes, ["choice", "bits"], "n", total).filter("n IS NOT NULL")
    parts = F.ceil(F.col("n") / part).cast("int")
    dealt = dealt.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "fp", "choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(kept).combine_chunks()
            cols = [t[c].to_numpy() for c in ("choice", "bits", "i", "j")]
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new)
            upto = t.num_rows if last else int(np.flatnonzero(new)[-1])  # the last tile may go on in the next batch
            fps = t["fp"].to_numpy()[:upto]
            got = links(fps.view(np.uint64), group[:upto], t["side"].to_numpy()[:upto], most) if upto else []
            kept[:] = [] if last else t.slice(upto).to_batches()
            if got:
                a, b = np.array(got).T
                yield pa.record_batch([pa.array(fps[a]), pa.array(fps[b])], names=["u", "v"])

        for b in batches:
            kept.append(b)
            if sum(x.num_rows for x in kept) >= 50_000:
                yield from done(False)
        if kept and sum(x.num_rows for x in kept):
            yield from done(True)

    by = ["choice", "bits", "i", "j"]
    return tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def proposed(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(fp, sim) of different texts, sim being their fingerprints -> edges (u, v) between texts whose fingerprints are equal or linked.

    About as many as texts: they connect what fingerprints connect, and each is to be verified by itself.
    """
    rows = nodes.select("fp", "sim", F.pmod(F.xxhash64("fp"), F.lit(SALT)).alias("part"))
    parts = stored(rows.groupBy("sim", "part").agg(F.min("fp").alias("first_of_part")), "parts")
    heads = stored(parts.groupBy("sim").agg(F.min("first_of_part").alias("head")), "heads")
    near = neighbours(heads.select(F.col("sim").alias("fp")), most)
    end = lambda c, name: heads.select(F.col("sim").alias(c), F.col("head").alias(name))
    edges = rows.join(parts, ["sim", "part"]).select(F.col("fp").alias("u"), F.col("first_of_part").alias("v"))
    edges = edges.unionByName(parts.join(heads, "sim").select(F.col("first_of_part").alias("u"), F.col("head").alias("v")))
    edges = edges.unionByName(near.join(end("u", "a"), "u").join(end("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(docs: DataFrame, size: int = 3, most: int = 3, similarity: float | None = None, words: int = 5) -> DataFrame:
    """Per row of docs: doc_id, key, fp and best, the (none, doc_id, key) of the first row of its component; null ids come last.

    With ``similarity``, fp stands for the set of the text's ``words``-word shingles, and links are those of texts that share so much of
    them. Texts whose fingerprints are linked are verified first; what fingerprints miss, jaccard.alike() finds, so no link is lost.
    """
    # sets of shingles are wider than texts, two of them go with a pair
    bound_batches(docs.sparkSession, size=(16 if similarity is None else 4) << 20)
    rows = fingerprints(docs, size) if similarity is None else jaccard.sets(docs, words, lambda t: fingerprint(t, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    if similarity is None:
        nodes = stored(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "nodes")
        roots = connected(neighbours(nodes.select("fp"), most))
    else:
        held, rows = rows, rows.filter("chunk IS NULL")
        nodes = stored(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n"), F.first("bits").alias("bits"), F.min("sim").alias("sim")), "nodes")
        told = stored(proposed(nodes, most), "proposed")
        found = jaccard.verified(docs, nodes, told, similarity, words)
        roots, rows = jaccard.alike(docs, held, nodes, similarity, words, found), rows.select("doc_id", "key", "fp")
        nodes = nodes.drop("bits", "sim")
    roots = roots.withColumnRenamed("v", "fp")
    named = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    firsts = stored(named.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("parts")), "firsts")
    n_nodes, n_rows = (x or 0 for x in named.agg(F.count("*"), F.sum("n")).first())
    named = stored(look_up(named, firsts, ["root"], "parts", n_nodes).select("fp", "n", "best"), "named")
    return look_up(rows, named, ["fp"], "n", n_rows).drop("n")


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable through links).

    Null and wordless texts have fingerprint zero and are linked like any other; a text of fewer than ``size`` words is one
    shingle. A null doc_id names a component only if it has no other. Repeated rows agree. An empty table gives an
    empty result. Copies collapse to one fingerprint before anything is compared; other columns are ignored.
    """
    return components(docs, size, most).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, size: int = 3, most: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; same columns. See components() for the options."""
    rows = stored(components(docs, size, most, similarity), "components")
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    drop = rows.filter(~best).select("doc_id", "key").distinct()
    out = without(docs, drop)
    again = stored(rows.filter(best).groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key"), "repeats")
    if again.isEmpty():
        return out
    # repeated rows of one document that stays: one of them does
    return without(out, again).unionByName(without(out, again, "left_semi").dropDuplicates(["doc_id", "text"]))
