"""Suffix-array dedup of repeated byte strings, with deep-shallow sorting.

Every window of ``length`` bytes is represented by its anchor, the place of its least k-gram hash; equal windows have
their anchors at equal places. Anchors of equal k-gram and equal surroundings (all bytes of their windows) are settled by
counting. The few others, at the ends of repeats, are compared byte by byte: the suffixes at the anchors of one k-gram, and the
reversed prefixes before them, are sorted by multikey quicksort to a shallow depth and by blind tries beyond it, and the
common lengths of neighbours in that order give every pair's match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, look_up, stored, unstore

LENGTH, GRAM = 400, 100
#: Bytes of text that are hashed at once. Depth at which blind tries take over. Rows of one k-gram compared in one task; larger groups are compared by their windows' hashes.
STRETCH, SHALLOW, GROUP = 1 << 20, 16, 2000
#: Bytes that stand for a word where passages are counted in words, and words of a k-gram then.
CODE, WORD_GRAM = 4, 12
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class Anchors:
    """Finds anchors in stretches of bytes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        n = STRETCH + 2 * length + 1
        self.power, self.inverse = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        self.random = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k-gram at each place; for each window start, the place of its anchor (the first of equal ones)."""
        n = len(text)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.random[text] * self.power[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least, s = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1
        count = len(h) - self.span + 1
        while s * 2 <= self.span:
            least = np.minimum(least[:-s], least[s:])
            s *= 2
        least = np.minimum(least[:count], least[self.span - s : self.span - s + count])
        return h.view(np.int64), (least & PLACE).astype(np.int64)

    def runs(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, anchor, first and last window start, hash) of the anchors of texts of at least ``length`` bytes, by stretch."""
        held, numbers, size = [], [], 0
        for i, t in enumerate(texts):
            if len(t) > STRETCH:
                yield self._long(i, t)
                continue
            if size + len(t) > STRETCH:
                yield self._stretch(held, numbers)
                held, numbers, size = [], [], 0
            held.append(t)
            numbers.append(i)
            size += len(t)
        if held:
            yield self._stretch(held, numbers)

    def _stretch(self, texts: list[bytes], numbers: list[int]) -> tuple[np.ndarray, ...]:
        h, place = self.places(np.frombuffer(b"".join(texts), np.uint8))
        n = np.array([len(t) for t in texts])
        begin = np.cumsum(n) - n
        own = np.repeat(np.arange(len(n)), n - self.length + 1)
        count = n - self.length + 1
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[own]
        at = place[start]
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]))))
        last = np.append(first[1:], len(at)) - 1
        own = own[first]
        return np.array(numbers)[own], at[first] - begin[own], start[first] - begin[own], start[last] - begin[own], h[at[first]]

    def _long(self, number: int, text: bytes) -> tuple[np.ndarray, ...]:
        parts = []
        for c in range(0, len(text) - self.length + 1, STRETCH):
            _, at, lo, hi, h = self._stretch([text[c : c + STRETCH + self.length - 1]], [0])
            part = [at + c, lo + c, hi + c, h]
            if parts and parts[-1][0][-1] == part[0][0]:  # the same anchor goes on
                parts[-1][2][-1] = part[2][0]
                part = [x[1:] for x in part]
            if len(part[0]):
                parts.append(part)
        at, lo, hi, h = (np.concatenate(x) for x in zip(*parts))
        return np.full(len(at), number), at, lo, hi, h


def common(a: bytes, b: bytes, least: int = 0) -> int:
    """Length of the common prefix of a and b, known to be at least ``least``."""
    lo, hi = least, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def blind(strings: list[bytes], rows: list[int]) -> tuple[list[int], list[int]]:
    """Order of rows by blind trie, and the common prefix of each with the one before it.

    Inner nodes are [depth, {byte or -1 at the end: child}], leaves lists of rows of one string. A search looks at branching
    bytes only; one comparison with the leaf it ends in tells where the new string leaves the trie.
    """
    root: list = [rows[0]]
    leaf = lambda node: node if isinstance(node[0], int) and not isinstance(node[-1], dict) else None
    for r in rows[1:]:
        s, node = strings[r], root
        while leaf(node) is None:
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node.append(r)
            continue
        above, key, node = None, None, root
        while leaf(node) is None and node[0] < depth:
            c = s[node[0]] if node[0] < len(s) else -1
            above, key, node = node, c, node[1][c]
        c = s[depth] if depth < len(s) else -1
        if leaf(node) is None and node[0] == depth:
            node[1][c] = [r]
            continue
        split = [depth, {(other[depth] if depth < len(other) else -1): node, c: [r]}]
        if above is None:
            root = split
        else:
            above[1][key] = split
    out, lcp, todo = [], [], [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if leaf(node) is not None:
            for k, r in enumerate(node):
                out.append(r)
                lcp.append(len(strings[r]) if k else shared)
        else:
            children = sorted(node[1].items())
            todo += [(child, node[0] if k else shared) for k, (_, child) in reversed(list(enumerate(children)))]
    return out, lcp


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of the strings, and each one's common prefix with the one before it (the first: 0)."""
    out: list[int] = []
    lcp: list[int] = []
    todo = [(list(range(len(strings))), 0, 0)]  # rows that agree up to depth; what the first shares with the row before
    while todo:
        rows, depth, shared = todo.pop()
        if not rows:
            continue
        if len(rows) == 1:
            out += rows
            lcp.append(shared)
        elif depth >= SHALLOW:
            order, own = blind(strings, rows)
            out += order
            lcp += [shared, *own[1:]]
        else:
            byte = lambda r: strings[r][depth] if depth < len(strings[r]) else -1  # noqa: B023, E731
            pivot = byte(rows[len(rows) // 2])
            less, same, more = [], [], []
            for r in rows:
                c = byte(r)
                (less if c < pivot else more if c > pivot else same).append(r)
            if pivot < 0:  # equal strings that end here; they come first
                out += same
                lcp += [shared, *[depth] * (len(same) - 1)]
                todo.append((more, depth, depth))
            else:
                todo += [(more, depth, depth), (same, depth + 1, depth if less else shared), (less, depth, shared)]
    return out, lcp


def extents(before: list[bytes], after: list[bytes], length: int) -> list[tuple[int, int] | None]:
    """For strings around anchors (before: reversed), how far left and right of each anchor its repeats reach, or None.

    A pair matches l bytes before and r bytes from the anchor on; it holds windows of ``length`` bytes if l + r reaches that.
    """
    m = len(after)
    if m == 2:
        left, right = common(before[0], before[1]), common(after[0], after[1])
        return [(left, right)] * 2 if left + right >= length else [None, None]

    def pairs(strings: list[bytes]) -> np.ndarray:
        order, lcp = deep_shallow(strings)
        out, lcp, order = np.zeros((m, m), np.int32), np.array(lcp, np.int32), np.array(order)
        for i in range(m - 1):
            out[order[i], order[i + 1 :]] = np.minimum.accumulate(lcp[i + 1 :])
        return np.maximum(out, out.T)

    left, right = pairs(before), pairs(after)
    good = left + right >= length
    np.fill_diagonal(good, False)
    far_left, far_right = np.where(good, left, -1).max(axis=1), np.where(good, right, -1).max(axis=1)
    return [(int(a), int(b)) if a >= 0 else None for a, b in zip(far_left, far_right)]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Stored (h, g, doc_id, key, p, lo, hi) of all anchors: k-gram hash, digest of all bytes of its windows and its place in them, document, anchor, first and last window start."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        find, digest = Anchors(length, gram), xxhash.xxh3_128_digest
        for b in batches:
            texts = b["text"].to_pylist()
            for own, at, lo, hi, h in find.runs(texts):
                g = [digest(texts[i][a : z + length], seed=q - a) for i, q, a, z in zip(own.tolist(), at.tolist(), lo.tolist(), hi.tolist())]
                take = pa.array(own)
                yield pa.record_batch([pa.array(h), pa.array(g, pa.binary()), b["doc_id"].take(take), b["key"].take(take), *[pa.array(x) for x in (at, lo, hi)]], names=["h", "g", "doc_id", "key", "p", "lo", "hi"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") >= length)
    return stored(rows.mapInArrow(run, f"h long, g binary, doc_id {kind}, key long, p long, lo long, hi long"), "anchors")


def _with_text(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, key, text as bytes) joined with per_doc (d, k, ...)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["d"]) & (rows["key"] == per_doc["k"]), how).drop("d", "k")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Stored (doc_id, key, start, end): byte ranges whose union are all bytes in windows that start anywhere else too. key: a hash of the text."""
    every = anchors(docs, length, gram)
    total = every.count()
    kinds = stored(every.groupBy("h", "g").agg(F.count("*").alias("n")), "surroundings")
    grams = kinds.groupBy("h").agg(F.sum("n").alias("nh"), F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("single")).filter("nh > 1")
    grams = stored(grams, "grams")
    twice = stored(look_up(every, grams, ["h"], "nh", total).filter("nh IS NOT NULL"), "twice")
    seen = stored(look_up(twice, kinds.filter("n > 1"), ["h", "g"], "n", total), "seen")
    for t in (every, kinds, twice):
        unstore(t)
    settled = seen.filter("n IS NOT NULL").select("doc_id", "key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    # what is left: anchors with surroundings of their own, and one anchor of each of the settled surroundings of their k-gram
    fields = ["doc_id", "key", "p", "lo", "hi", "kinds"]
    open_ = seen.filter("n IS NULL").select("h", *fields, F.lit(True).alias("open"))
    shown = seen.filter("n IS NOT NULL AND single > 0").groupBy("h", "g").agg(F.min(F.struct(*fields)).alias("f")).select("h", "f.*", F.lit(False).alias("open"))
    wanted = open_.unionByName(shown).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("h", "p", "lo", "hi", "kinds", "open")).alias("wanted"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["wanted"].flatten()
            own = pa.array(np.repeat(np.arange(b.num_rows), b["wanted"].value_lengths().to_numpy()))
            texts = b["text"].to_pylist()
            bytes_ = [texts[i][a : z + length] for i, a, z in zip(own.to_pylist(), flat.field("lo").to_pylist(), flat.field("hi").to_pylist())]
            for at in range(0, len(bytes_), 20_000):
                f, o = flat.slice(at, 20_000), own.slice(at, 20_000)
                yield pa.record_batch([*[f.field(c) for c in ("h", "kinds", "open", "p", "lo")], b["doc_id"].take(o), b["key"].take(o), pa.array(bytes_[at : at + 20_000], pa.binary())], names=["h", "kinds", "open", "p", "lo", "doc_id", "key", "bytes"])

    context = _with_text(docs, wanted, "inner").mapInArrow(cut, f"h long, kinds long, open boolean, p long, lo long, doc_id {kind}, key long, bytes binary")
    context = stored(context, "contexts")
    found = f"doc_id {kind}, key long, start long, end long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            h = t["h"].to_numpy()
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            upto = len(h) if last else int(ends[-2]) if len(ends) > 1 else 0
            p, lo, bytes_, is_open = t["p"].to_pylist(), t["lo"].to_pylist(), t["bytes"].to_pylist(), t["open"].to_pylist()
            rows, start, end, a = [], [], [], 0
            for z in ends.tolist():
                if z > upto:
                    break
                if z - a > 1:
                    cuts = [q - x for q, x in zip(p[a:z], lo[a:z])]
                    reach = extents([s[:c][::-1] for s, c in zip(bytes_[a:z], cuts)], [s[c:] for s, c in zip(bytes_[a:z], cuts)], length)
                    for i, x in enumerate(reach, a):
                        if x and is_open[i]:
                            rows.append(i)
                            start.append(p[i] - x[0])
                            end.append(p[i] + x[1])
                a = z
            held[:] = [] if last else t.slice(upto).to_batches()
            if rows:
                yield pa.record_batch([t[c].combine_chunks().take(pa.array(rows)) if not isinstance(t[c], pa.Array) else t[c].take(pa.array(rows)) for c in ("doc_id", "key")] + [pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "key", "start", "end"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 20_000:
                yield from done(False)
        if sum(x.num_rows for x in held):
            yield from done(True)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for i in range(b.num_rows):
                s = b["bytes"][i].as_py()
                n = len(s) - length + 1
                same = pa.array(np.full(n, i))
                start = np.arange(n) + b["lo"][i].as_py()
                hashes = [xxhash.xxh3_128_digest(s[k : k + length]) for k in range(n)]
                yield pa.record_batch([pa.array(hashes, pa.binary()), b["open"].take(same), b["doc_id"].take(same), b["key"].take(same), b["p"].take(same), pa.array(start)], names=["w", "open", "doc_id", "key", "p", "s"])

    few = context.filter(F.col("kinds") <= group).repartition("h").sortWithinPartitions("h").mapInArrow(compare, found)
    spans = settled.unionByName(few)
    hot = grams.filter((F.col("kinds") > group) & (F.col("single") > 0))
    used = [grams, seen, context]
    if not hot.isEmpty():
        # k-grams with too many different surroundings for one task: their windows are counted by digest, in all tasks
        each = stored(context.filter(F.col("kinds") > group).mapInArrow(windows, f"w binary, open boolean, doc_id {kind}, key long, p long, s long"), "windows")
        counts = stored(each.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1"), "window-counts")
        again = look_up(each, counts, ["w"], "n", each.count()).filter("n IS NOT NULL AND open")
        spans = spans.unionByName(again.groupBy("doc_id", "key", "p").agg(F.min("s").alias("start"), (F.max("s") + length).alias("end")).drop("p"))
        used += [each, counts]
    spans = stored(spans, "spans")
    for t in used:
        unstore(t)
    return spans


def _per_doc(spans: DataFrame, name: str) -> DataFrame:
    return spans.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("start", "end")).alias(name))


def passages(docs: DataFrame, words: int) -> DataFrame:
    """(d, k, passages): per document and hash of its text, ranges of word codes in runs of ``words`` words that start anywhere else too.

    The same search over texts whose words (between ASCII white space) are hashed to CODE bytes each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            codes = [b"".join(map(xxhash.xxh32_digest, (t.as_py() or b"").split())) for t in b["text"]]
            yield pa.record_batch([b["doc_id"], b["own"], pa.array(codes, pa.binary())], names=["doc_id", "own", "text"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("own"), F.col("text").cast("binary").alias("text"))
    coded = stored(rows.mapInArrow(run, f"doc_id {kind}, own long, text binary").filter(F.octet_length("text") >= CODE * words), "codes")
    found = _per_doc(repeats(coded, CODE * words, CODE * WORD_GRAM), "passages")
    texts = coded.select("doc_id", "own", F.xxhash64("text").alias("key")).distinct()
    out = texts.join(found, texts["doc_id"].eqNullSafe(found["d"]) & (texts["key"] == found["k"])).groupBy(F.col("doc_id").alias("d"), F.col("own").alias("k")).agg(F.first("passages").alias("passages"))
    out = stored(out, "passages")
    unstore(coded)
    return out


def _merged(spans: list[dict] | None) -> list[list[int]]:
    merged: list[list[int]] = []
    for x in sorted((x["start"], x["end"]) for x in spans or ()):
        if merged and x[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], x[1])
        else:
            merged.append(list(x))
    return merged


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, in order) and n_passage_words.

    With ``words``, n_passage_words counts the document's words in runs of so many words that start anywhere else too; such a passage
    may be shorter than ``length`` bytes, and it is only counted. Without, it is null.

    Texts are UTF-8 bytes; null counts as empty. Each byte covered by a ``length``-byte string that also starts anywhere
    else goes, same document and overlaps included; matches never cross documents. Repeated rows are each other's repeats. An empty table
    gives an empty result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    counted = passages(docs, words) if words else None
    per_doc = _per_doc(repeats(docs, length, gram, group), "spans")
    if words:
        same = per_doc["d"].eqNullSafe(counted["d"]) & (per_doc["k"] == counted["k"])
        per_doc = per_doc.join(counted, same, "full").select(F.coalesce(per_doc["d"], counted["d"]).alias("d"), F.coalesce(per_doc["k"], counted["k"]).alias("k"), "spans", "passages")
    else:
        per_doc = per_doc.withColumn("passages", F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, runs, kept, counts = [], [], [], [], []
            for t, s, p in zip(b["text"], b["spans"].to_pylist(), b["passages"].to_pylist()):
                t = t.as_py() or b""
                merged = _merged(s)
                counts.append(sum(z // CODE - -(-a // CODE) for a, z in _merged(p)) if words else None)
                at, parts = 0, []
                for a, z in merged:
                    parts.append(t[at:a])
                    at = z
                parts.append(t[at:])
                sizes.append(len(t))
                gone.append(sum(z - a for a, z in merged))
                runs.append(len(merged))
                kept.append(b"".join(parts))
            yield pa.record_batch([b["doc_id"], *[pa.array(x, pa.int64()) for x in (sizes, gone, runs)], pa.array(kept, pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    return _with_text(docs, per_doc, "left").select("doc_id", "text", "spans", "passages").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")
