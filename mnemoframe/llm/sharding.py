"""Sharding by minimax contiguous partition of ordered atomic groups.

DataFrame functions only. Groups of equal texts are ordered by the SHA-256 of their text, which is uniform, so a
prefix of it is an even range partition at any size. The smallest feasible capacity is found by binary search with a
greedy check; the group sizes are looked at through a bounded index that is refined only where a cut can lie.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

#: Index entries held at once.
ENTRIES = 60_000
#: Rows that one task numbers.
PART = 200_000


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Indexes after which a left-to-right fill cuts, or None if the groups don't fit. ends: running sums."""
    cuts, start, at = [], 0, 0
    for _ in range(shards):
        if at == len(ends):
            break
        nxt = bisect_right(ends, start + capacity, lo=at)
        if nxt == at:
            return None
        at, start = nxt, ends[nxt - 1]
        cuts.append(at)
    return cuts if at == len(ends) else None


def least_capacity(ends: list[int], lo: int, hi: int, shards: int) -> int:
    """The smallest capacity in [lo, hi] that greedy() accepts; hi must be feasible."""
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(ends, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def find_cuts(groups: DataFrame, shards: int, entries: int = ENTRIES) -> tuple[list[str], int]:
    """(digest, bytes) of each group -> the last digest of each shard but the final one, and the capacity.

    Round by round: an index of (digest prefix, bytes) is summed by Spark; cuts at its entries' ends give a feasible
    capacity ``hi``; no capacity under ``lo`` = max(largest group, ceil(total / shards)) can do. A cut of any capacity
    in between lies between the greedy positions for lo (rounded down) and hi (rounded up); only entries there are
    split further. The index stays under ``entries`` rows unless single groups are all that is left of it, and then it
    holds as many groups as lie where cuts can be.
    """
    groups = stored(groups, "shard-groups")
    top = groups.agg(F.sum("bytes"), F.max("bytes"), F.count("*")).first()
    total, largest, n = top[0] or 0, top[1] or 0, top[2]
    if not n:
        return [], 0
    lo = max(largest, -(-total // shards))
    width = 1
    while 16 ** (width + 1) <= entries // 4 and 16**width < n:
        width += 1
    fetch = lambda df, w: [tuple(r) for r in df.groupBy(F.substring("digest", 1, w).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("digest").alias("last")).orderBy("p").collect()]
    index = fetch(groups, width)
    while True:
        ends, run = [], 0
        for r in index:
            run += r[1]
            ends.append(run)
        coarse = max(r[1] for r in index)
        hi = least_capacity(ends, lo, max(lo + coarse, lo), shards)
        # where cuts can be: entry indexes [a, b] for each cut
        split, low, high = set(), 0, 0
        for _ in range(shards - 1):
            a = bisect_right(ends, low + lo)
            low = ends[a - 1] if a else 0
            b = bisect_right(ends, high + hi)
            high = ends[min(b, len(ends) - 1)]
            split.update(i for i in range(a, min(b, len(ends) - 1) + 1) if index[i][2] > 1)
        if not split:
            # lo may be below the first feasible capacity; all cuts for capacities in [lo, hi] are at entries' ends
            best = least_capacity(ends, lo, hi, shards)
            return [index[i - 1][3] for i in greedy(ends, best, shards)[:-1]], best
        finer = width
        groups_there = sum(index[i][2] for i in split)
        if groups_there <= entries:
            finer = 64
        else:
            finer += max(1, next((k for k in range(4, 0, -1) if len(split) * 16**k <= entries), 1))
        parts = sorted(index[i][0] for i in split)
        keep = [r for i, r in enumerate(index) if i not in split]
        by_width: dict[int, list[str]] = {}
        for p in parts:
            by_width.setdefault(len(p), []).append(p)
        found = []
        for w, ps in by_width.items():
            found += fetch(groups.filter(F.substring("digest", 1, w).isin(ps)), finer)
        index = sorted(keep + found)
        width = finer


def _number(cuts: list[str], digest):
    number = F.lit(0)
    for c in cuts:
        number = number + (digest > F.lit(c)).cast("int")
    return number


def measured(docs: DataFrame) -> DataFrame:
    """Stored doc_id, size, text_crc32, digest of each row of docs."""
    text = F.coalesce("text", F.lit(""))
    return stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("digest")), "shard-rows")


def assign(docs: DataFrame, shards: int = 16, entries: int = ENTRIES) -> DataFrame:
    """docs plus ``size`` and ``shard`` (columns of these names are replaced); no text is shuffled."""
    text = F.coalesce("text", F.lit(""))
    sizes = stored(docs.select((F.octet_length(text) + 1).cast("long").alias("size"), F.sha2(text, 256).alias("digest")), "shard-rows")
    cuts, _ = find_cuts(sizes.groupBy("digest").agg(F.sum("size").alias("bytes")), shards, entries)
    return docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "shard": _number(cuts, F.sha2(text, 256))})


def shard(docs: DataFrame, shards: int = 16, part: int = PART, entries: int = ENTRIES) -> DataFrame:
    """Per row of docs: doc_id, size (UTF-8 bytes of text + 1), text_crc32, digest, shard, slot.

    Equal texts are one group and share a shard (null counts as the empty text). Slots run from 0 without gaps in each
    shard. They are dealt in parts of each shard (by a hash of the row), as many as keep ``part`` rows in a part even if one
    shard had all rows, so a hot group of copies is numbered by many tasks; the parts' counts give the offsets. Repeated rows
    get slots of their own.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = measured(docs)
    cuts, _ = find_cuts(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), shards, entries)
    salts = max(16, -(-rows.count() // part))
    rows = rows.withColumn("shard", _number(cuts, F.col("digest"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "digest")) - 1
    numbered = rows.withColumn("nth", nth)
    # offsets grow with the rows (one for ``part`` of them): no hint, the numbered rows lie by shard and salt already
    return numbered.join(offsets, ["shard", "salt"]).withColumn("slot", (F.col("offset") + F.col("nth")).cast("long")).drop("salt", "nth", "offset")
