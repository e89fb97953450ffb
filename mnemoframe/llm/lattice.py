"""Subword lattice likelihood.

An existing vocabulary's pieces span a lattice over the bytes of each word. Piece scores weight every segmentation, and a
log-space forward recursion sums them to the marginal probability of the word. The vocabulary's own scores are the prior;
expected piece counts over all segmentations of all training words, gathered in Spark, update them for each label of the training
text (its language). A word that training text holds has one more arc, over the whole word, from its discounted count; the
discounted mass goes to the lattice.

A document's probability is a mixture over labels and two ways to draw its words: independently, or from an urn that returns each
word with one more of its kind (CONCENTRATION words of the model are in it at first), as words recur within a document. Both
don't depend on the words' order, so sums over a document's different words give the marginal. All of it is a proper
distribution over sequences of words that finish with an end.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, stored

#: Words whose scores every worker holds (the most frequent of the documents to score); the rest are looked up by shuffle.
HEAD_WORDS = 100_000
#: Labels with scores and counts of their own; rarer ones share theirs.
LABELS = 30
#: Taken from each whole-word count; weight of the vocabulary's own scores against expected counts; rounds of updating.
DISCOUNT, PRIOR, ROUNDS = 0.7, 300.0, 2
CONCENTRATION = 100.0
#: Different words a task counts before it passes them on.
HELD_WORDS = 300_000
#: Words longer than this are parsed one by one.
LONG = 256
BASE = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xD6E8FEB86659FD93)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies -> bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[tuple[bytes, bool, float]]:
    """(bytes, ends a word, log score) of a byte-level tokenizer file with word ends.

    The file's scores are its pieces' ranks; by Zipf's law rank r stands for a weight of 1 / (r + 10), normalised. All single
    bytes, inside and at the end of words, are there, so each word has a segmentation.
    """
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    symbols, found = byte_symbols(), {}
    for piece, rank in ids.items():
        final = piece.endswith("</w>")
        text = piece.removesuffix("</w>")
        if text and all(c in symbols for c in text):
            found.setdefault((bytes(symbols[c] for c in text), final), rank)
    for b in range(256):
        for final in (False, True):
            found.setdefault((bytes([b]), final), len(ids))
    total = sum(1 / (r + 10) for r in found.values())
    return [(p, f, math.log(1 / (r + 10) / total)) for (p, f), r in sorted(found.items(), key=lambda x: (x[1], x[0]))]


def _hashes(words: np.ndarray) -> np.ndarray:
    """Prefix hashes (n + 1 columns) of the rows of a byte matrix; the hash of [i, j) is H[j] - H[i] * BASE ** (j - i)."""
    h = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for j in range(words.shape[1]):
        h[:, j + 1] = h[:, j] * BASE + words[:, j] + np.uint64(1)
    return h


class Lattice:
    """Piece scores for K labels; forward and backward recursions over many words of one length at once."""

    def __init__(self, pieces: list[tuple[bytes, bool, float]], labels: int):
        keys = []
        for p, final, _ in pieces:
            h = int(_hashes(np.frombuffer(p, np.uint8)[None, :])[0, -1])
            keys.append(h ^ (int(FINAL) if final else 0))
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.prior = np.array([s for _, _, s in pieces])[order]
        self.scores = np.repeat(self.prior[:, None], labels, axis=1)
        self.longest = max(len(p) for p, _, _ in pieces)
        self.power = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and which pieces these are."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        return hit, at[hit]

    def arcs(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each position j from 1 on, (i, rows, pieces) of the arcs from i to j."""
        n, h, out = words.shape[1], _hashes(words), []
        for j in range(1, n + 1):
            here = []
            for i in range(max(0, j - self.longest), j):
                key = h[:, j] - h[:, i] * self.power[j - i]
                rows, at = self._find(key ^ FINAL if j == n else key)
                if len(rows):
                    here.append((i, rows, at))
            out.append(here)
        return out

    def forward(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """Log probabilities (n + 1, rows, labels) of the prefixes, and the arcs; words: a byte matrix."""
        m, n = words.shape
        arcs, alpha = self.arcs(words), np.full((n + 1, m, self.scores.shape[1]), -np.inf)
        alpha[0] = 0
        for j, here in enumerate(arcs, 1):
            for i, rows, at in here:
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.scores[at])
        return alpha, arcs

    def long_arcs(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(j, i, piece) of all arcs of one word, by j."""
        n, x = len(word), np.frombuffer(word, np.uint8)
        h = [0]
        for c in x.tolist():
            h.append((h[-1] * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF)
        h, js, is_, at = np.array(h, np.uint64), [], [], []
        for d in range(1, min(self.longest, n) + 1):
            key = h[d:] - h[:-d] * self.power[d]
            key[-1] ^= FINAL
            hit, piece = self._find(key)
            js.append(hit + d)
            is_.append(hit)
            at.append(piece)
        js, is_, at = np.concatenate(js), np.concatenate(is_), np.concatenate(at)
        order = np.argsort(js, kind="stable")
        return js[order], is_[order], at[order]

    def long_forward(self, word: bytes) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Log probabilities (n + 1, labels) of one word's prefixes, its arcs, and where the arcs of each position begin."""
        js, is_, at = arcs = self.long_arcs(word)
        cut = np.searchsorted(js, np.arange(1, len(word) + 2))
        alpha = np.full((len(word) + 1, self.scores.shape[1]), -np.inf)
        alpha[0] = 0
        for j in range(1, len(word) + 1):
            a, z = cut[j - 1], cut[j]
            x = alpha[is_[a:z]] + self.scores[at[a:z]]
            top = x.max(axis=0)
            alpha[j] = top + np.log(np.exp(x - top).sum(axis=0))
        return alpha, arcs, cut

    def marginal(self, words: list[bytes]) -> np.ndarray:
        """Natural log probabilities (words, labels) over all segmentations."""
        out = np.empty((len(words), self.scores.shape[1]))
        for rows, matrix in by_length(words):
            if matrix.shape[1] > LONG:
                for r in rows:
                    out[r] = self.long_forward(words[r])[0][-1]
            else:
                out[rows] = self.forward(matrix)[0][-1]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Expected counts (pieces, labels) over all segmentations of words; weights: (words, labels). Scores may be for one label, which stands for all."""
        counts = np.zeros((len(self.keys), weights.shape[1]))

        def add(at: np.ndarray, share: np.ndarray) -> None:
            for k in range(share.shape[1]):
                counts[:, k] += np.bincount(at, share[:, k], len(counts))

        for rows, matrix in by_length(words):
            if matrix.shape[1] > LONG:
                for r in rows:
                    alpha, (js, is_, at), cut = self.long_forward(words[r])
                    beta = np.full_like(alpha, -np.inf)
                    beta[-1] = 0
                    through = np.empty((len(js), alpha.shape[1]))
                    for j in range(len(words[r]), 0, -1):
                        part = slice(cut[j - 1], cut[j])
                        through[part] = self.scores[at[part]] + beta[j]
                        beta[is_[part]] = np.logaddexp(beta[is_[part]], through[part])
                    add(at, np.exp(alpha[is_] + through - alpha[-1]) * weights[r])
                continue
            alpha, arcs = self.forward(matrix)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            ats, shares = [], []
            for j in range(matrix.shape[1], 0, -1):
                for i, r, at in arcs[j - 1]:
                    through = self.scores[at] + beta[j, r]
                    beta[i, r] = np.logaddexp(beta[i, r], through)
                    ats.append(at)
                    shares.append(np.exp(alpha[i, r] + through - alpha[-1, r]) * weights[rows[r]])
            add(np.concatenate(ats), np.concatenate(shares))
        return counts

    def update(self, counts: np.ndarray) -> None:
        """Scores from expected counts, with the vocabulary's own as the prior."""
        counts = counts + np.exp(self.prior)[:, None] * PRIOR
        self.scores = np.log(counts / counts.sum(axis=0))


def by_length(words: list[bytes], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, byte matrix) of the words of each length, some thousands at a time."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            n = int(lengths[part[0]])
            for at in range(0, len(part), max(1, most // n)):
                rows = part[at : at + max(1, most // n)]
                yield rows, np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), n)


class Model:
    """Lattice and totals: tokens (ends included), ends and different words by label; n and v of all training tokens."""

    def __init__(self, lattice: Lattice, tokens: list[int], ends: list[int], types: list[int], distinct: int):
        self.lattice, self.tokens, self.ends, self.types = lattice, np.array(tokens, float), np.array(ends, float), np.array(types, float)
        self.n, self.v, self.docs = int(sum(tokens)), distinct, int(sum(ends))

    def base(self, c):
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def words(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Natural log probabilities (words, labels)."""
        rest = np.log(DISCOUNT * self.types + 0.5) + self.lattice.marginal(words)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - DISCOUNT, 0))
        return np.logaddexp(whole, rest) - np.log(self.tokens + 1)

    def end(self) -> np.ndarray:
        return np.log((self.ends + 0.5) / (self.tokens + 1))

    def prior(self) -> np.ndarray:
        """Natural log weights of the labels."""
        return np.log((self.ends + 1) / (self.docs + len(self.ends)))


def urn(n: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """ln of q (q + 1) ... (q + n - 1) for q = CONCENTRATION * exp(logs): n draws of one word from the urn, the urn's size aside."""
    out = logs + math.log(CONCENTRATION)
    many = np.flatnonzero(n > 1)
    if len(many):
        q = CONCENTRATION * np.exp(logs[many])
        add = [[math.lgamma(k + x) - math.lgamma(1 + x) for x in row] for k, row in zip(n[many].tolist(), q.tolist())]
        out[many] += np.array(add)
    return out


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series seven places on."""
    z, down = x + 7, x
    for k in range(1, 7):
        down = down * (x + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.ln(down)


def word_counts(docs: DataFrame, labels: list[str | None], more: bool, trains: Column | None) -> DataFrame:
    """(word, c0, c1, ..., total, n): occurrences in training text by label (with ``more``, the last is for labels that aren't listed), and in all.

    Counted by task, then summed by word.
    """
    index, size = {x: i for i, x in enumerate(labels)}, len(labels) + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, c in held.items():
                words, n = list(c), list(c.values())
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.record_batch([pa.array(part, pa.binary()), pa.array([k] * len(part), pa.int32()), pa.array(n[at : at + 50_000], pa.int64())], names=["word", "k", "n"])
            held.clear()

        for b in batches:
            for t, lang, trained in zip(b["text"], b["lang"].to_pylist(), b["trains"].to_pylist()):
                held.setdefault(index.get(lang, size - 1) if trained else size, Counter()).update((t.as_py() or b"").lower().split())
                if sum(map(len, held.values())) >= HELD_WORDS:
                    yield from out()
        yield from out()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("binary").alias("text"), "lang", (F.lit(True) if trains is None else trains).alias("trains")).mapInArrow(run, "word binary, k int, n long")
    cols = [F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(size)]
    total = F.sum(F.when(F.col("k") < size, F.col("n")).otherwise(0)).alias("total")
    return rows.groupBy("word").agg(*cols, total, F.sum("n").alias("n"))


def _expected(counts: DataFrame, lattice: Lattice, labels: int) -> np.ndarray:
    """Expected piece counts over all segmentations of all training words; each counts once for each label that has it."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)
    cols = [f"c{i}" for i in range(labels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value.keys), labels))
        for b in batches:
            weights = np.stack([b[c].to_numpy() > 0 for c in cols], axis=1).astype(float)
            total += shared.value.expected(b["word"].to_pylist(), weights)
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch([pa.array(rows), *[pa.array(total[rows, i]) for i in range(labels)]], names=["piece", *cols])

    bound_batches(counts.sparkSession, 10_000)
    found = counts.filter("total > 0").select("word", *cols).mapInArrow(run, "piece long, " + ", ".join(f"{c} double" for c in cols))
    found = found.groupBy("piece").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # a row for each piece of the vocabulary at most
    out = np.zeros((len(lattice.keys), labels))
    out[found["piece"].to_numpy()] = found[cols].to_numpy()
    return out


def learn(docs: DataFrame, pieces: list[tuple[bytes, bool, float]], trains: Column | None = None) -> tuple[Model, DataFrame]:
    """Model and the stored word counts, from (text, lang) rows.

    Where ``trains`` is false a row teaches nothing; its words are listed (with the counts that training rows have), which spares
    score() a pass.
    """
    taught = docs if trains is None else docs.filter(trains)
    ranked = taught.groupBy("lang").count().orderBy(F.desc("count"), F.col("lang").asc_nulls_last())
    labels, more = ranked.limit(LABELS).collect(), taught.count()
    ends = [r[1] for r in labels]
    if more := more - sum(ends):
        ends.append(more)
    ends = ends or [0]
    cols = [f"c{i}" for i in range(len(ends))]
    counts = stored(word_counts(docs, [r[0] for r in labels], bool(more) or not labels, trains), "word-counts")
    sums = counts.agg(F.sum((F.col("total") > 0).cast("long")), *[F.sum(c) for c in cols], *[F.sum((F.col(c) > 0).cast("long")) for c in cols]).first()
    types, tokens = [t or 0 for t in sums[1 + len(cols) :]], [n or 0 for n in sums[1 : 1 + len(cols)]]
    tokens = [n + e for n, e in zip(tokens, ends)]
    lattice = Lattice(pieces, 1)  # at first all labels have the vocabulary's scores
    for _ in range(ROUNDS):
        lattice.update(_expected(counts, lattice, len(ends)))
    return Model(lattice, tokens, ends, types, (sums[0] or 0) + (1 if sum(ends) else 0)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, listed: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs (null text: empty; repeated rows agree).

    Each different word is scored once. Frequent words are summed up where the text lies; of the others a row for each word and
    document is joined with the word's scores, so no key of that join is hot. ``listed``: counts hold all words of docs. An empty
    table gives an empty result; other columns are ignored.
    """
    spark, labels = docs.sparkSession, len(model.ends)
    cols, logs = [f"c{i}" for i in range(labels)], [f"l{i}" for i in range(labels)]
    if not listed:
        own = word_counts(docs.withColumn("lang", F.lit(None).cast("string")), [], True, F.lit(False)).select("word", "n")
        counts = own.join(counts.drop("n"), "word", "left").fillna(0)
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.stack([b[x].to_numpy() for x in cols], axis=1).astype(float)
            total = b["total"].to_numpy()
            per = shared.value.words(b["word"].to_pylist(), c)
            yield pa.record_batch([b["word"], b["n"], pa.array(total > 0), pa.array(shared.value.base(total)), *[pa.array(per[:, i]) for i in range(labels)]], names=["word", "n", "known", "base", *logs])

    bound_batches(spark, 10_000)
    scored = counts.select("word", "n", "total", *cols).mapInArrow(weigh, "word binary, n long, known boolean, base double, " + ", ".join(f"{x} double" for x in logs))
    scored = stored(scored, "word-scores")
    # the count from which words are frequent: at most HEAD_WORDS have it
    least, seen = 1 << 62, 0
    for n, words in scored.groupBy("n").agg(F.count("*").alias("w")).orderBy(F.desc("n")).limit(HEAD_WORDS).collect():
        if seen + words > HEAD_WORDS:
            break
        least, seen = n, seen + words
    top = scored.filter(F.col("n") >= least).toArrow()
    frequent = spark.sparkContext.broadcast(
        (top["word"].to_pylist(), np.stack([top[x].to_numpy() for x in logs], axis=1), top["base"].to_numpy(), top["known"].to_numpy().astype(float))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = 3 + 2 * labels

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, logs_of, base, known = frequent.value
        index = _index(words_of)
        m = shared.value
        end, end_base, end_known = m.end(), float(m.base(m.docs)), int(m.docs > 0)
        row = TaskContext.get().partitionId() << 36
        words, rids, of, ns, sums = [], [], [], [], []

        def out() -> pa.RecordBatch:
            arrays = [pa.array(words, pa.binary()), pa.array(rids, pa.int64()), pa.array(of, doc_type), pa.array(ns, pa.int64()), pa.array(sums, pa.list_(pa.float64()))]
            b = pa.record_batch(arrays, names=["word", "rid", "doc_id", "times", "sums"])
            for x in (words, rids, of, ns, sums):
                x.clear()
            return b

        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                row += 1
                tokens = (text.as_py() or b"").lower().split()
                at, times = [], []
                for w, n in Counter(tokens).items():
                    i = index.get(w)
                    if i is None:
                        words.append(w)
                        rids.append(row)
                        of.append(None)
                        ns.append(n)
                        sums.append(None)
                    else:
                        at.append(i)
                        times.append(n)
                t, size = np.array(times, float), len(tokens) + 1
                free = t @ logs_of[at] + end
                drawn = urn(t, logs_of[at]).sum(axis=0) + end + math.log(CONCENTRATION) - math.lgamma(size + CONCENTRATION) + math.lgamma(CONCENTRATION)
                # a row of the document itself; blanks are in no word, so it meets no scores
                words.append(b" %d" % row)
                rids.append(row)
                of.append(doc_id)
                ns.append(0)
                sums.append([float(size), float(t @ known[at]) + end_known, float(t @ base[at]) + end_base, *free.tolist(), *drawn.tolist()])
                if len(words) >= 20_000:
                    yield out()
        if words:
            yield out()

    bound_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    dealt = rows.mapInArrow(spread, f"word binary, rid long, doc_id {kind}, times long, sums array<double>")
    joined = dealt.join(scored.filter(F.col("n") < least).drop("n").hint("shuffle_hash"), "word", "left")
    times = F.col("times").cast("double")

    def drawn(x: Column) -> Column:
        q = F.exp(x) * CONCENTRATION
        return x + math.log(CONCENTRATION) + F.when(F.col("times") > 1, _log_gamma(times + q) - _log_gamma(1 + q)).otherwise(0.0)

    own = [F.lit(0.0), times * F.col("known").cast("double"), times * F.col("base"), *[times * F.col(x) for x in logs], *[drawn(F.col(x)) for x in logs]]
    parts = joined.select("rid", "doc_id", *[F.coalesce(F.when(F.col("sums").isNull(), x).otherwise(F.col("sums")[i]), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(own)])
    sums = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    prior = (model.prior() - math.log(2)).tolist() * 2
    each = F.array(*[F.col(f"s{3 + i}") + F.lit(p) for i, p in enumerate(prior)])
    best = F.array_max(each)
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return sums.select(
        "doc_id", F.round("s0").cast("long").alias("n_tokens"), F.round("s1").cast("long").alias("n_known"), F.col("s2").alias("base_score"), ((best + F.ln(total)) / math.log(10)).alias("score")
    )


_INDEX: list[tuple[list[bytes], dict[bytes, int]]] = []


def _index(words: list[bytes]) -> dict[bytes, int]:
    """Places of the frequent words; a worker holds one such index."""
    if not _INDEX or _INDEX[0][0] is not words:
        _INDEX[:] = [(words, {w: i for i, w in enumerate(words)})]
    return _INDEX[0][1]
