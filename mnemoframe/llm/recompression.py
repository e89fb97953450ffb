"""Substring dedup by recompression: equal word sequences get equal symbols, and shared symbols reveal repeats.

A round of recompression replaces each run of one symbol by a symbol of its own, and then each pair of neighbours whose left one is of
class 0 and whose right one is of class 1. Names are hashes of what a symbol stands for, classes are bits of names, so all tasks name
alike. Whether a symbol ends at some place depends on few words around it; where these lie inside a window of ``length`` words, all
equal windows have the same symbols there. Each window is thus filed under the pair of symbols at one of its determined ends: of the
highest round, then of the least hash. Windows under one name are verified by a digest of all their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, stored

LENGTH, ROUNDS = 13, 2
#: Bytes of text that are named at once, and words that are parsed at once.
STRETCH, BLOCK = 1 << 20, 1 << 18
#: Documents that are looked at for hot names, and the share of all windows' names above which a name is hot. Neither changes any result.
SAMPLE, HOT = 50_000, 5_000
_EDGE = 1 << 40
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers_of: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; n is rounded up to a power of two."""
    size = 1 << max(1, (n - 1).bit_length())
    if (base, size) not in _powers_of:
        out, k = np.ones(size, np.uint64), 1
        while k < size:
            out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        _powers_of[base, size] = out
    return _powers_of[base, size][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((salt * _A + _B) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Name of a pair of names, or of a name and a number."""
    return mix(mix(a, salt) + b * np.uint64(_A), salt + 1)


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[begin:end]."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return (total[end] - total[begin]) * powers(pow(base, -1, 1 << 64), n + 1)[begin]


def _named(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words between ASCII white space, and where each begins."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    return mix(_sums(_BYTES[raw], begin, end, _A)), begin


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """Names of a long text's words, stretch by stretch; cuts lie in white space. A word of STRETCH bytes and more is hashed by itself."""
    import xxhash

    white = re.compile(rb"[\x20\x09-\x0D]")
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            end = max(text.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if end < 0:
                found = white.search(text, at + STRETCH)
                end = found.start() if found else len(text)
                yield mix(np.array([xxhash.xxh3_64_intdigest(text[at:end])], np.uint64))
                at = end + 1
                continue
        yield _named(text[at:end])[0]
        at = end + 1


def word_names(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, name) of each word, texts in order and none cut."""
    held, first, size = [], 0, 0

    def short() -> tuple[np.ndarray, np.ndarray]:
        names, begin = _named(b"\n".join(held))
        starts = np.cumsum([0, *[len(t) + 1 for t in held[:-1]]])
        return np.searchsorted(starts, begin, "right") - 1 + first, names

    for i, t in enumerate(texts):
        if held and (size + len(t) > STRETCH):
            yield short()
            held, size = [], 0
        if len(t) > STRETCH:
            names = np.concatenate([np.zeros(0, np.uint64), *_pieces(t)])
            yield np.full(len(names), i), names
            continue
        if not held:
            first = i
        held.append(t)
        size += len(t) + 1
    if held:
        yield short()


def rounds(names: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per round: places where symbols end and begin, first and last word on which each place depends, name of the symbols around it."""
    sym, at = names, np.arange(len(names) + 1)
    left, right = at.copy(), at - 1
    for r in range(1, count + 1):
        m = len(sym)
        if m < 3:
            return
        kind = mix(sym, 100 + r) & np.uint64(1)
        same = sym[1:] == sym[:-1]
        ends = np.flatnonzero(~(same | ((kind[:-1] == 0) & (kind[1:] == 1)))) + 1
        new_left, new_right = left[ends - 1], right[ends + 1]
        yield at[ends], new_left, new_right, joined(sym[ends - 1], sym[ends], 10 * r)
        # the next round's symbols: one run or a pair of runs between two ends
        run = np.concatenate(([0], np.flatnonzero(~same) + 1))
        long = np.diff(np.append(run, m))
        of_run = np.where(long > 1, joined(sym[run], long.astype(np.uint64), 10 * r + 2), sym[run])
        begin = np.concatenate(([0], ends))
        k = np.searchsorted(run, begin)
        two = np.append(k[1:], len(run)) - k == 2
        sym = np.where(two, joined(of_run[k], of_run[np.minimum(k + 1, len(run) - 1)], 10 * r + 4), of_run[k])
        at = np.concatenate((at[begin], [at[m]]))
        left = np.concatenate(([-_EDGE], new_left, [-_EDGE]))
        right = np.concatenate(([_EDGE], new_right, [_EDGE]))


def filed(names: np.ndarray, valid: np.ndarray, length: int, count: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each valid window start: the name it is filed under, a number of the place whose name that is (its own if there is none), its digest."""
    n = len(names)
    digest = mix(_sums(mix(names, 7), valid, valid + length, _B), 9)
    name, place = mix(digest, 3), -1 - valid
    todo = np.arange(len(valid))
    for r, (at, left, right, h) in reversed(list(enumerate(rounds(names, count), 1))):
        if not len(todo) or not len(at):
            continue
        inside = (left >= 0) & (right < n)
        at, left, right, h = at[inside], left[inside], right[inside], h[inside]
        start = valid[todo]
        low = np.concatenate(([0], np.cumsum(np.bincount(left, minlength=n))))[start]
        high = np.cumsum(np.bincount(right, minlength=n))[start + length - 1]
        some = high > low
        low, high, own = low[some], high[some], todo[some]
        if len(own):
            least = [(h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)]
            while 2 << (len(least) - 1) <= int((high - low).max()):
                s = 1 << (len(least) - 1)
                least.append(np.minimum(least[-1][:-s], least[-1][s:]))
            k = np.frexp((high - low).astype(float))[1] - 1
            best = np.empty(len(own), np.uint64)
            for level in np.unique(k):
                x = k == level
                best[x] = np.minimum(least[level][low[x]], least[level][high[x] - (1 << int(level))])
            j = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
            name[own], place[own] = h[j], at[j] * (count + 1) + r
        todo = todo[~some]
    return name, place, digest


class Finder:
    """Files the windows of batches of texts."""

    def __init__(self, length: int, count: int = ROUNDS, hot: np.ndarray | None = None):
        self.length, self.count, self.hot = length, count, np.zeros(0, np.uint64) if hot is None else hot

    def runs(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, first window start, name, windows, their digests in a row) of windows of one place."""
        for own, names in word_names(texts):
            at = np.arange(len(own)) - np.searchsorted(own, own)  # word number in its text
            for a in range(0, max(1, len(names) - self.length + 1), BLOCK):
                part, who = names[a : a + BLOCK + self.length - 1], own[a : a + BLOCK + self.length - 1]
                if len(part) < self.length:
                    continue
                valid = np.flatnonzero(who[self.length - 1 :] == who[: len(who) - self.length + 1])
                if not len(valid):
                    continue
                name, place, digest = filed(part, valid, self.length, self.count)
                if len(self.hot):
                    single = np.isin(name, self.hot)
                    name, place = np.where(single, mix(digest, 5), name), np.where(single, -1 - valid, place)
                first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (who[valid][1:] != who[valid][:-1]))))
                yield who[valid[first]], at[a + valid[first]], name[first], np.diff(np.append(first, len(valid))), digest


def _hot(docs: DataFrame, length: int, sample: int, share: int) -> np.ndarray:
    """Names of over 1/share of the runs of a sample of documents, at most ``share`` of them."""
    rows = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // sample))) == 0).select(F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(length)
        for b in batches:
            found = [name for _, _, name, _, _ in find.runs(b["text"].to_pylist())]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                often = n >= 4
                yield pa.record_batch([pa.array([None, *h[often].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[often].tolist()], pa.int64())], names=["h", "n"])

    counts = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = counts.filter("h IS NULL").agg(F.max("n").alias("total"))
    often = counts.filter("h IS NOT NULL").join(F.broadcast(total), F.col("n") * share > F.col("total")).select("h")
    return np.sort(np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64))


def repeats(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, share: int = HOT) -> DataFrame:
    """(doc_id, key, start, stop): word ranges whose union is all words in windows that also start in a document of a smaller id. key: a hash of the text.

    Of the windows that a task reads under one name with one content, only those of the least document travel on; the others are
    settled. The windows of hot names are filed under their own digests, each for itself.
    """
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    hot = _hot(texts, length, sample, share)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"h long, doc_id {kind}, key long, start long, n long, w binary"

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(length, hot=hot)
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            order = np.unique(ids, return_inverse=True)[1]
            for own, start, name, n, digest in find.runs(b["text"].to_pylist()):
                begin = np.cumsum(n) - n
                at = np.arange(len(digest)) - np.repeat(begin, n)
                content = np.add.reduceat(joined(digest, at.astype(np.uint64), 20), begin)
                by = np.lexsort((order[own], content, name))
                new = np.concatenate(([True], (name[by][1:] != name[by][:-1]) | (content[by][1:] != content[by][:-1])))
                least = order[own[by]][np.flatnonzero(new)][np.cumsum(new) - 1]
                settled = np.empty(len(by), bool)
                settled[by] = order[own[by]] > least
                go = np.flatnonzero(~settled)
                w = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(begin, len(digest)).astype(np.int32) * 8), pa.py_buffer(digest)])
                yield self_batch(b, own[go], name[go], start[go], n[go], w.take(pa.array(go)))
                gone = np.flatnonzero(settled)
                if len(gone):  # neighbours in one text become one range
                    stop = start[gone] + n[gone] + length - 1
                    cut = np.concatenate(([True], (own[gone][1:] != own[gone][:-1]) | (start[gone][1:] > stop[:-1])))
                    a = np.flatnonzero(cut)
                    z = np.append(a[1:], len(gone)) - 1
                    yield self_batch(b, own[gone[a]], joined(name[gone[a]], a.astype(np.uint64), 30), start[gone[a]], stop[z] - start[gone[a]], pa.nulls(len(a), pa.binary()))

    def self_batch(b: pa.RecordBatch, own: np.ndarray, h: np.ndarray, start: np.ndarray, n: np.ndarray, w: pa.Array) -> pa.RecordBatch:
        take = pa.array(own)
        return pa.record_batch([pa.array(h.view(np.int64)), b["doc_id"].take(take), b["key"].take(take), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), w], names=["h", "doc_id", "key", "start", "n", "w"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["doc_id", "key", "start", "stop"]

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            h = t["h"].to_numpy()
            cut = len(h) if last else int(np.searchsorted(h, h[-1]))
            held[:] = t.slice(cut).to_batches()
            t, h = t.slice(0, cut).combine_chunks(), h[:cut]
            if not cut:
                return
            w = t["w"].combine_chunks()
            w = w.chunk(0) if isinstance(w, pa.ChunkedArray) else w
            windows = w.is_valid().to_numpy(zero_copy_only=False)
            n = np.where(windows, t["n"].to_numpy(), 0)
            row = np.repeat(np.arange(cut), n)
            digest = np.frombuffer(b"".join(x for x in w.to_pylist() if x is not None), np.uint64)
            order = np.unique(t["doc_id"].to_numpy(), return_inverse=True)[1][row]
            by = np.lexsort((order, digest, h[row]))
            x, y = digest[by], h[row][by]
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(by) else np.zeros(0, bool)
            gone = np.zeros(len(by), bool)
            gone[by] = order[by] > order[by][np.flatnonzero(new)][np.cumsum(new) - 1]
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(gone)
            if len(hit):  # neighbouring windows of a row become one range
                cuts = np.concatenate(([True], (row[hit][1:] != row[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)))
                a = np.flatnonzero(cuts)
                z = np.append(a[1:], len(hit)) - 1
                take, start = pa.array(row[hit[a]]), t["start"].to_numpy()[row[hit[a]]]
                yield pa.record_batch([one(t, "doc_id").take(take), one(t, "key").take(take), pa.array(start + at[hit[a]]), pa.array(start + at[hit[z]] + length)], names=names)
            known = np.flatnonzero(~windows)
            if len(known):
                take, start = pa.array(known), t["start"].to_numpy()[known]
                yield pa.record_batch([one(t, "doc_id").take(take), one(t, "key").take(take), pa.array(start), pa.array(start + t["n"].to_numpy()[known])], names=names)

        def one(t: pa.Table, c: str) -> pa.Array:
            x = t[c].combine_chunks()
            return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 100_000:
                yield from done(False)
        if sum(x.num_rows for x in held):
            yield from done(True)

    rows = texts.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(file, out).repartition("h").sortWithinPartitions("h").mapInArrow(verify, f"doc_id {kind}, key long, start long, stop long")


def remove(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, share: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words lie between ASCII white space. Each word goes that a window of ``length`` words covers whose sequence also starts in a document
    of a smaller doc_id. A null text has no words. A row without doc_id loses nothing and takes nothing from others, as a null is
    neither smaller nor larger; rows of one doc_id (repeated rows too) take nothing from each other. An empty table gives an empty
    result, and other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(repeats(docs, length, sample, share), "spans")
    per_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    both = rows.join(per_doc, (rows["doc_id"] == per_doc["d"]) & (rows["key"] == per_doc["k"]), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, kept = [], [], []
            for text, spans in zip(b["text"], b["spans"]):
                words = (text.as_py() or b"").split()
                sizes.append(len(words))
                if spans.is_valid:
                    flat = spans.values
                    change = np.bincount(flat.field("start").to_numpy(), minlength=len(words) + 1) - np.bincount(flat.field("stop").to_numpy(), minlength=len(words) + 1)
                    covered = np.cumsum(change)[: len(words)] > 0
                    gone.append(int(covered.sum()))
                    words = [words[i] for i in np.flatnonzero(~covered)]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.record_batch([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


#: DuckDB: the same rows from ``documents``, by comparing all windows.
SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN least USING (s) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""
