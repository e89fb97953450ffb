"""Collocations by pivot partitioning: each phrase is counted where its rarest word is.

Words are numbered by falling frequency, and words under the least count end a fragment. Each occurrence of a word becomes the pivot of a
fragment: the words around it, at most four on each side, up to the first that is rarer (to its left: or the same word again). A phrase
is counted once per occurrence, at the leftmost of its rarest words. Equal fragments are added up before they travel, and go to the part
of their pivot, where phrases grow word by word and only while they are frequent. Pivots that are too frequent for one part are split by
fragment; their counts are added up afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, look_up, stored, unstore

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words that are counted before counts are passed on, and words that are cut into fragments at once.
HELD, BLOCK = 400_000, 1 << 19
#: Frequent words that may be broadcast; more are joined. Occurrences from which a pivot is split. Occurrences of a part, about.
BROADCAST, SPLIT, PART = 500_000, 2_000_000, 1_000_000
_SIDE = LONGEST - 1
#: One byte for one: A-Z to a-z, tabs to blanks, what ends a piece to line feeds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
STRETCH = 1 << 20


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Folded words in order, in lists; a line feed stands where a piece ends, and empty strings are to be skipped. Cuts lie at blanks."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= STRETCH else max(text.find(b" ", at + STRETCH), -1)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n); the row with a null word holds the count of all words of its lang. Languages that are null count as ``und``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items() if w not in (b"", b"\n")]
            rows += [(lang, None, sum(n for w, n in c.items() if w not in (b"", b"\n"))) for lang, c in held.items()]
            held.clear()
            lang, word, n = zip(*rows)
            return pa.record_batch([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                c = held.setdefault(lang, Counter())
                for t in tokens(text.as_py()):
                    c.update(t)
                if sum(map(len, held.values())) > HELD:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(counts: DataFrame) -> DataFrame:
    """Stored (code, lang, word, n): words by falling count from 0 on, all languages together. The order is cut into ranges, so no task holds it all."""
    cut = stored(counts.repartitionByRange(F.desc("n"), "lang", "word").sortWithinPartitions(F.desc("n"), "lang", "word").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33)), "ranges")
    sizes = cut.groupBy("part").agg(F.count("*").alias("c")).orderBy("part").collect()  # one row for each of Spark's partitions
    begin, rows = 0, []
    for r in sizes:
        rows.append((r["part"], begin))
        begin += r["c"]
    offsets = counts.sparkSession.createDataFrame(rows, "part int, begin long")
    out = stored(cut.join(F.broadcast(offsets), "part").select((F.col("begin") + F.col("at")).alias("code"), "lang", "word", "n"), "words")
    unstore(cut)
    return out


def _by_dictionary(docs: DataFrame, words: DataFrame):
    """A function from batches of documents to batches of ``codes``: per document the numbers of its words, -1 where a fragment ends. The words are broadcast."""
    known: dict[str, dict[bytes, int]] = {}
    for r in words.collect():
        known.setdefault(r["lang"], {b"": -2})[r["word"].encode()] = r["code"]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, sizes = [], []
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                get, n = shared.value.get(lang, {b"": -2}).get, 0
                for t in tokens(text.as_py()):
                    c = np.fromiter(map(get, t, repeat(-1)), np.int64, len(t))
                    values.append(c[c != -2])
                    n += len(values[-1])
                sizes.append(n)
            flat = np.concatenate([np.zeros(0, np.int64), *values])
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))], names=["codes"])

    return run


def _by_join(docs: DataFrame, words: DataFrame, sizes: DataFrame, total: int, block: int = 4096) -> DataFrame:
    """The same for any number of words: tokens are joined with them. A row holds a block of a document, its first and last words also in its neighbours'.

    core: where in the row the block itself begins and ends.
    """
    # a line feed in the text of a piece's end is a token of its own, as in tokens()
    ends = F.translate(F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), ".,;:!?\x0b\x0c\r", "\n" * 9)
    each = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", F.posexplode(F.regexp_extract_all(ends, F.lit(r"\n|[^\x20\x09\n]+"), F.lit(0))).alias("pos", "word"))
    each = stored(each, "tokens")
    known = words.select("lang", "word", "n", "code").unionByName(sizes.select("lang", F.lit("\n").alias("word"), F.col("total").alias("n"), F.lit(-1).cast("long").alias("code")))
    found = look_up(each, known, ["lang", "word"], "n", total).select("row", "pos", F.coalesce("code", F.lit(-1)).alias("code"))
    own = F.floor(F.col("pos") / block)
    near = F.array_distinct(F.array(own, F.floor((F.col("pos") - _SIDE) / block), F.floor((F.col("pos") + _SIDE) / block)))
    rows = found.withColumn("block", F.explode(near)).filter("block >= 0").groupBy("row", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("t"))
    inside = lambda x: x["pos"] < (F.col("block") + 1) * block
    rows = rows.withColumn("skip", F.size(F.filter("t", lambda x: x["pos"] < F.col("block") * block))).withColumn("upto", F.size(F.filter("t", inside)))
    return rows.filter("upto > skip").select(F.transform("t", lambda x: x["code"]).alias("codes"), F.struct(F.col("skip").alias("begin"), F.col("upto").alias("end")).alias("core"))


def fragments(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of 2 * _SIDE + 1 numbers for the pivots codes[at] that own any phrase: the pivot in the middle, -1 beyond the fragment's ends."""
    padded = np.concatenate((np.full(_SIDE, -1), codes, np.full(_SIDE, -1)))
    at = at[codes[at] >= 0]
    out = np.full((len(at), 2 * _SIDE + 1), -1, np.int64)
    pivot = codes[at]
    out[:, _SIDE] = pivot
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    for d in range(1, _SIDE + 1):
        x, y = padded[at + _SIDE - d], padded[at + _SIDE + d]
        left &= (x >= 0) & (x < pivot)
        right &= (y >= 0) & (y <= pivot)
        out[left, _SIDE - d] = x[left]
        out[right, _SIDE + d] = y[right]
    return out[(out[:, _SIDE - 1] >= 0) | (out[:, _SIDE + 1] >= 0)]


def summed(rows: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their n (None: 1 each)."""
    n = np.ones(len(rows), np.int64) if n is None else n
    if not len(rows):
        return rows, n
    key = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        key = (key ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    if not (rows == rows[first[back]]).all():  # two rows with one hash
        distinct, back = np.unique(rows, axis=0, return_inverse=True)
        return distinct, np.bincount(back.ravel(), n).astype(np.int64)
    return rows[first], np.bincount(back, n).astype(np.int64)


def phrases(rows: np.ndarray, n: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of words, counts) of fragments that occur n times; only phrases counted at least as often as their pivot asks for.

    Phrases grow from the pivot to the right and then to the left. Each is known by the number of the shorter phrase and the next word,
    so equal numbers are equal phrases; what isn't frequent doesn't grow.
    """

    def step(keep: np.ndarray, name: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fragments of which name + word is frequent, the new names, and per name an example and its count."""
        sub = np.flatnonzero(word >= 0)
        words = np.unique(word[sub], return_inverse=True)[1]
        _, first, new = np.unique(name[sub] * np.int64(len(sub) + 1) + words, return_index=True, return_inverse=True)
        count = np.bincount(new, n[keep[sub]]).astype(np.int64)
        good = count >= least[keep[sub[first]]]
        stay = good[new]
        return keep[sub[stay]], new[stay], keep[sub[first[good]]], count[good]

    keep = np.arange(len(rows))
    name = np.unique(rows[:, _SIDE], return_inverse=True)[1]
    for y in range(LONGEST):
        if y:
            keep, name, example, count = step(keep, name, rows[keep, _SIDE + y])
            if len(example):
                yield rows[example, _SIDE : _SIDE + y + 1], count
        k, m = keep, name
        for x in range(1, LONGEST - y):
            if not len(k):
                break
            k, m, example, count = step(k, m, rows[k, _SIDE - x])
            if len(example):
                yield rows[example, _SIDE - x : _SIDE + y + 1], count
        if not len(keep):
            break


def frequent(rows: DataFrame, read, words: DataFrame, least: int, split: int, part: int, total: int) -> DataFrame:
    """Stored (codes array<long>, f): phrases of 2 to LONGEST words of one language that occur ``least`` times and more.

    read: from batches of rows to batches of ``codes``, and of ``core`` where only some places of a row are its own.
    """
    heavy = words.filter(F.col("n") > split).select("code", "n").collect()  # at most total / split words
    salted = np.array(sorted((r["code"], -(-r["n"] // split)) for r in heavy), np.int64).reshape(-1, 2)
    parts = max(1, -(-total // part))
    kind = np.dtype("<i4") if words.count() < 1 << 31 else np.dtype("<i8")
    width = 2 * _SIDE + 2

    def packed(codes: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, n = summed(fragments(codes, at), None)
        if not len(found):
            return
        pivot = found[:, _SIDE]
        p = (pivot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
        if len(salted):
            k = np.searchsorted(salted[:, 0], pivot).clip(max=len(salted) - 1)
            hot = salted[k, 0] == pivot
            p[hot] += (found[hot] * np.arange(3, 3 + 2 * found.shape[1], 2)).sum(axis=1) % salted[k[hot], 1]
        p %= parts
        by = np.argsort(p, kind="stable")
        p, table = p[by], np.concatenate((found, n[:, None]), axis=1)[by].astype(kind)
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        # what this block has for a part travels as one row, column by column
        data = [np.ascontiguousarray(table[i:z].T).tobytes() for i, z in zip(first, np.append(first[1:], len(p)))]
        yield pa.record_batch([pa.array(p[first]), pa.array(data, pa.binary())], names=["part", "rows"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read(batches):
            size = b["codes"].value_lengths().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            core = b["core"] if "core" in b.schema.names else None
            own, end = (core.field("begin").to_numpy(), core.field("end").to_numpy()) if core is not None else (np.zeros(len(size), np.int64), size)
            # rows are parted by an end of a fragment
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - begin[row]
            stream = np.full(len(row) + len(size), -1, np.int64)
            stream[np.arange(len(row)) + row] = b["codes"].flatten().to_numpy(zero_copy_only=False)
            mine = (np.arange(len(row)) + row)[(at >= own[row]) & (at < end[row])]
            for a in range(0, len(stream), BLOCK):
                lo = max(0, a - _SIDE)
                yield from packed(stream[lo : a + BLOCK + _SIDE], mine[np.searchsorted(mine, a) : np.searchsorted(mine, a + BLOCK)] - lo)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            table = np.concatenate(held)
            held.clear()
            found, n = summed(table[:, :-1], table[:, -1])
            ask = np.where(np.isin(found[:, _SIDE], salted[:, 0]), 1, least)  # those of split pivots are counted in several parts
            for words, f in phrases(found, n, ask):
                m = words.shape[1]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, m), pa.int32()), pa.array(words.ravel())), pa.array(f)], names=["codes", "f"])

        for b in batches:
            for p, data in zip(b["part"].to_pylist(), b["rows"].to_pylist()):
                if p != now and held:
                    yield from done()
                now = p
                held.append(np.frombuffer(data, kind).reshape(width, -1).T.astype(np.int64))
        if held:
            yield from done()

    found = rows.mapInArrow(cut, "part long, rows binary").repartition("part").sortWithinPartitions("part").mapInArrow(count, "codes array<long>, f long")
    if len(salted):
        found = found.groupBy("codes").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(found, "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, broadcast: int = BROADCAST, split: int = SPLIT, part: int = PART) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score.

    Texts are lower-cased (A-Z), split at .,;:!? and line ends into pieces, and these at blanks and tabs into words. A phrase of 2 to
    LONGEST words within a piece that occurs a >= least times is a candidate. l and r are the counts of its two parts at the cut with the least
    score, floor(1000 * a * n / (l * r)) with n the language's words; of equal cuts the first counts. A candidate inside a longer phrase
    that occurs as often is dropped. Order: score and a falling, then phrase.

    A null text is empty and a null lang ``und``. Repeated rows count again, ties are settled by the phrase, an empty table gives an empty
    result, and other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = stored(word_counts(rows).filter(F.col("word").isNull() | (F.col("n") >= least)), "counts")
    sizes = counts.filter("word IS NULL").select("lang", F.col("n").alias("total"))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    words = numbered(counts.filter("word IS NOT NULL"))
    if words.count() <= broadcast:
        found = frequent(rows, _by_dictionary(rows, words), words, least, split, part, total)
    else:
        found = frequent(_by_join(rows, words, sizes, total), lambda batches: batches, words, least, split, part, total)
    # words and counts of the phrases' words
    each = stored(found.withColumn("id", F.monotonically_increasing_id()).select("id", "f", "codes", F.posexplode("codes").alias("pos", "code")), "codes")
    used = words.join(each.groupBy("code").agg(F.count("*").alias("uses")), "code")
    named = look_up(each, used, ["code"], "uses", each.count())
    whole = named.groupBy("id").agg(F.first("f").alias("f"), F.first("codes").alias("codes"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word", "n"))).alias("t"))
    whole = stored(whole.select("id", "f", "codes", "lang", F.array_join(F.transform("t", lambda x: x["word"]), " ").alias("phrase"), F.transform("t", lambda x: x["n"]).alias("ones")), "named")
    # phrases that a longer one covers: it is enough to look at those with one word more
    longer = whole.filter(F.size("codes") > 2).select("f", F.explode(F.array(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1))).alias("codes"))
    covered = longer.groupBy("codes").agg(F.max("f").alias("most"))
    left = whole.join(covered, "codes", "left").filter(F.coalesce("most", F.lit(0)) < F.col("f")).drop("most")
    # both parts of each cut; parts of one word are counted already
    m = F.size("codes")
    sides = F.flatten(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), F.slice("codes", F.lit(1), k).alias("codes")), F.struct(k.alias("k"), F.lit(1).alias("side"), F.slice("codes", k + 1, m - k).alias("codes")))))
    cuts = stored(left.select("id", "ones", F.size("codes").alias("m"), F.explode(sides).alias("c")).select("id", "c.k", "c.side", "c.codes", F.when(F.size("c.codes") == 1, F.when(F.col("c.side") == 0, F.element_at("ones", 1)).otherwise(F.element_at("ones", -1))).alias("one")), "cuts")
    many = stored(cuts.filter("one IS NULL"), "parts")
    asked = whole.select("codes", F.col("f").alias("fp")).join(many.groupBy("codes").agg(F.count("*").alias("uses")), "codes")
    joined = look_up(many, asked, ["codes"], "uses", many.count()).select("id", "k", "side", F.col("fp").alias("one"))
    both = cuts.filter("one IS NOT NULL").select("id", "k", "side", "one").unionByName(joined)
    pairs = both.groupBy("id", "k").agg(F.max(F.when(F.col("side") == 0, F.col("one"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("one"))).alias("r"))
    scored = left.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").join(pairs, "id")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    scored = scored.withColumn("score", F.call_function("div", (big("f") * F.lit(1000) * big("total")).cast("decimal(38,0)"), (big("l") * big("r")).cast("decimal(38,0)")))
    best = scored.groupBy("id").agg(F.min(F.struct("score", "k", "l", "r", "lang", "phrase", F.col("f").alias("a"), F.col("total").alias("n"))).alias("b")).select("b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = stored(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for t in (counts, words, found, each, whole, cuts, many):
        unstore(t)
    return out


#: DuckDB: the same rows from ``documents``, by counting all phrases.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) s(k))),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, unnest([g[1 : k - 1], g[2 : k]]) AS g, f FROM f WHERE k > 2),
c AS (SELECT f.* FROM f LEFT JOIN (SELECT lang, g, max(f) AS most FROM inner_ GROUP BY ALL) x ON x.lang = f.lang AND x.g = f.g WHERE f.k > 1 AND coalesce(most, 0) < f.f),
cuts AS (SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, n.n, CAST(1000 AS HUGEINT) * c.f * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1 : c.k]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS x FROM cuts),
out AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best WHERE x = 1)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM out WHERE rank <= 2000"""
