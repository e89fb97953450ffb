"""All pairs of texts whose sets of word shingles have a Jaccard similarity of at least ``least``; no pair is lost.

Prefix filter: with all shingles in one order, rare ones first, two such sets share a shingle among the first
n - ceil(least * n) + 1 of each, so sets are dealt to one bucket for each of those. In a bucket, pairs go by their sizes, by
the positions of the shared shingle and by parity bitmaps: an element more or less turns one bit, so the bitmaps differ in
at most as many bits as the sets differ in elements. Survivors are verified by their sets, and only verified links connect.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import look_up, stored, unstore
from .components import connected

SEED = 42
#: Words of 64 bits in a parity bitmap.
BITS = 8
#: Counters of shingles, by the top bits of their hashes, in chunks. They only set the order, so shared ones cost time, not pairs.
COUNTERS, CHUNK = 1 << 22, 1 << 16
#: Tasks that share the adding up of a chunk.
SHARES = 64
#: Neighbours in a bucket (by size) that are tried first; in larger buckets the rest is tried across what these connect.
LAGS = 8
#: A bucket of more sets is compared in tiles of two parts of this size.
PART = 2000
SLACK = 1e-9
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the different size-word shingles of lower-cased words; a shorter text is one shingle, no words are none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h += w[k : k + len(h)] * FACTORS[k]
    h = (h ^ (h >> np.uint64(32))) * FACTORS[-1]
    return np.unique(h ^ (h >> np.uint64(29)))


def name(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def parity(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def sets(docs: DataFrame, words: int, mark: Callable[[bytes | None], int]) -> DataFrame:
    """Stored (doc_id, key, fp, bits, sim, chunk, counts): a row per row of docs, whose fp names its shingle set, sim being its mark; rows with a chunk hold counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        total = np.zeros(COUNTERS, np.uint8)
        ids = None
        for b in batches:
            fps, bits, sims = [], [], []
            for t in b["text"]:
                h = shingle_set(t.as_py(), words)
                sims.append(mark(t.as_py()))
                fps.append(name(h))
                bits.append(parity(h).tobytes())
                if fps[-1] not in seen:
                    seen.add(fps[-1])
                    at, n = np.unique(counter(h), return_counts=True)
                    total[at] = np.minimum(255, total[at] + n.astype(np.int64))
            ids, n = b["doc_id"].type, b.num_rows
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.record_batch([b["doc_id"], b["key"], fp, pa.array(bits, pa.binary()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if seen:
            at = [i for i in range(COUNTERS // CHUNK) if total[i * CHUNK : (i + 1) * CHUNK].any()]
            n, zero = len(at), pa.array([0] * len(at), pa.int64())
            counts = pa.array([total[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in at], pa.binary())
            yield pa.record_batch([pa.nulls(n, ids), zero, zero, pa.nulls(n, pa.binary()), zero, pa.array(at, pa.int32()), counts], names=names)

    names = ["doc_id", "key", "fp", "bits", "sim", "chunk", "counts"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp long, bits binary, sim long, chunk int, counts binary"), "sets")


def ranks(held: DataFrame) -> np.ndarray:
    """For each counter, a byte that grows with the logarithm of its count."""

    def add(kind: type, out):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for c, x in zip(b["chunk"].to_pylist(), b["counts"]):
                    total[c] = total.get(c, 0) + np.frombuffer(x.as_py(), kind).astype(np.int64)
            if total:
                yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([out(x).tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

        return run

    def rank(x: np.ndarray) -> np.ndarray:
        return np.minimum(255, 10 * np.log2(1 + x)).astype(np.uint8)

    # added up in a tree: tasks stream over their share of a chunk's counts, then over the sums of the shares
    counts = held.filter("chunk IS NOT NULL").select("chunk", "counts").repartition(F.col("chunk"), F.pmod(F.xxhash64("counts"), F.lit(SHARES)))
    sums = counts.mapInArrow(add(np.uint8, lambda x: x), "chunk int, counts binary").repartition("chunk").mapInArrow(add(np.int64, rank), "chunk int, counts binary")
    out = np.zeros(COUNTERS, np.uint8)
    for r in sums.collect():  # COUNTERS / CHUNK rows
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint8)
    return out


def shared(docs: DataFrame, held: DataFrame, least: float, words: int) -> DataFrame:
    """Stored (h, fp, size, pos, n): the prefix shingles of sets that n > 1 sets have in their prefixes."""
    rank = docs.sparkSession.sparkContext.broadcast(ranks(held))
    schema = "h long, fp long, size int, pos int"

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            out, fps, sizes = [], [], []
            for t in b["text"]:
                h = shingle_set(t.as_py(), words)
                fp = name(h)
                if fp not in seen and len(h):
                    seen.add(fp)
                    out.append(h[np.lexsort((h, rank.value[counter(h)]))][: len(h) - math.ceil(least * len(h) - SLACK) + 1])
                    fps.append(fp)
                    sizes.append(len(h))
            if out:
                n = [len(x) for x in out]
                cols = [np.concatenate(out).view(np.int64), np.repeat(np.array(fps, np.uint64).view(np.int64), n), np.repeat(np.array(sizes, np.int32), n), np.concatenate([np.arange(k, dtype=np.int32) for k in n])]
                yield pa.record_batch([pa.array(c) for c in cols], names=["h", "fp", "size", "pos"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches, ["h"]):
            h, fp = t["h"].to_numpy(), t["fp"].to_numpy()
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])  # tasks repeat sets that others have
            t = t.filter(pa.array(first))
            _, which, n = np.unique(t["h"].to_numpy(), return_inverse=True, return_counts=True)
            t = t.append_column("n", pa.array(n[which]))
            yield from t.filter(pa.array(n[which] > 1)).to_batches()

    text = docs.select(F.col("text").cast("binary").alias("text"))
    dealt = text.mapInArrow(prefixes, schema).repartition("h").sortWithinPartitions("h", "fp")
    return stored(dealt.mapInArrow(met, schema + ", n long"), "shared")


def whole(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of sorted rows that split no group of equal ``by``."""
    kept: list[pa.RecordBatch] = []
    held, least = 0, rows
    for b in batches:
        kept.append(b)
        held += b.num_rows
        if held >= least:
            t = pa.Table.from_batches(kept).combine_chunks()
            new = np.zeros(held, bool)
            for c in by:
                v = t[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            at = np.flatnonzero(new)
            upto = int(at[-1]) if len(at) else 0  # the last group may go on
            if upto:
                yield t.slice(0, upto)
            kept, held = t.slice(upto).to_batches(), held - upto
            least = max(rows, 2 * held)
    if held:
        yield pa.Table.from_batches(kept).combine_chunks()


def pairs(rows: DataFrame, least: float, lags: int | None = None, part: int = PART) -> DataFrame:
    """(h, fp, size, pos, n, bits, root) -> distinct (u, v): pairs of a bucket and of different roots that may be similar enough.

    With ``lags``, only rows so near to each other in a bucket, ordered by size.
    """
    rows = rows.withColumn("parts", F.ceil(F.col("n") / part).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.array("own") if lags else F.sequence(F.lit(0), F.col("parts") - 1)
    tiles = rows.withColumn("other", F.explode(others)).select(
        "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "size", "fp", "pos", "bits", "root",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    share, apart = least / (1 + least), (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches, by):
            group = np.zeros(t.num_rows, np.int64)
            for c in by:
                v = t[c].to_numpy()
                group[1:] += v[1:] != v[:-1]
            group = np.cumsum(group > 0)
            fp, root, size, pos, side = (t[c].to_numpy() for c in ("fp", "root", "size", "pos", "side"))
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, BITS)
            us, vs, n = [], [], 0
            at, lag = np.arange(len(fp)), 0
            while lags is None or lag < lags:
                lag += 1
                at = at[at + lag < len(fp)]
                # sorted by size: what is too far apart at this lag stays so at the next ones
                at = at[(group[at] == group[at + lag]) & (size[at] >= least * size[at + lag] - SLACK)]
                if not len(at):
                    break
                a = at[((side[at] == 0) | (side[at] != side[at + lag])) & (root[at] != root[at + lag])]
                b = a + lag
                both = size[a] + size[b].astype(np.int64)
                ok = np.minimum(size[a] - pos[a], size[b] - pos[b]) >= share * both - SLACK
                a, b, both = a[ok], b[ok], both[ok]
                ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= apart * both + SLACK
                us.append(np.minimum(fp[a[ok]], fp[b[ok]]))
                vs.append(np.maximum(fp[a[ok]], fp[b[ok]]))
                n += len(us[-1])
                if n > 100_000:
                    yield pa.record_batch([pa.array(x) for x in np.unique([np.concatenate(us), np.concatenate(vs)], axis=1)], names=["u", "v"])
                    us, vs, n = [], [], 0
            if n:
                yield pa.record_batch([pa.array(x) for x in np.unique([np.concatenate(us), np.concatenate(vs)], axis=1)], names=["u", "v"])

    by = ["h", "i", "j"]
    return tiles.repartition(*by).sortWithinPartitions(*by, "size", "fp").mapInArrow(run, "u long, v long").distinct()


def verified(docs: DataFrame, nodes: DataFrame, edges: DataFrame, least: float, words: int) -> DataFrame:
    """Stored edges (u, v) of those whose sets are at least ``least`` similar."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    asked = nodes.join(ends, "fp", "left_semi").select("fp", F.col("first.doc_id").alias("d"), F.col("first.key").alias("k"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["fp"], pa.array([shingle_set(t.as_py(), words).tobytes() for t in b["text"]], pa.binary())], names=["fp", "s"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["a"], b["b"]):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    found = rows.join(asked, rows["doc_id"].eqNullSafe(asked["d"]) & (rows["key"] == asked["k"])).dropDuplicates(["fp"]).select("fp", "text")
    held = stored(found.mapInArrow(hashes, "fp long, s binary"), "shingles")
    a, b = held.select(F.col("fp").alias("u"), F.col("s").alias("a")), held.select(F.col("fp").alias("v"), F.col("s").alias("b"))
    out = stored(edges.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(judge, "u long, v long"), "verified")
    unstore(held)
    return out


def alike(docs: DataFrame, held: DataFrame, nodes: DataFrame, least: float, words: int, found: DataFrame) -> DataFrame:
    """Stored (v, root) of the components that links of at least ``least`` make of nodes (fp, first, n, bits); see sets() for held.

    found: verified links (u, v) that are known; only pairs that these leave apart are looked for.
    """
    met = shared(docs, held, least, words)
    met = met.join(nodes.select("fp", "bits"), "fp")
    named = lambda rows, roots: rows.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    near = stored(pairs(named(met, connected(found)), least, LAGS), "pairs")
    links = found.unionByName(verified(docs, nodes, near, least, words))
    unstore(near)
    roots = connected(links)
    rest = met.filter(F.col("n") > LAGS + 1)
    if rest.isEmpty():
        return roots
    near = stored(pairs(named(rest, roots), least), "pairs")
    if near.isEmpty():
        return roots
    more = verified(docs, nodes, near, least, words)
    unstore(near)
    return connected(links.unionByName(more))
