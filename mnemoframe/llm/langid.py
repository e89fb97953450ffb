"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built on the driver from a bounded sample. A text is parsed
greedily into the longest substrings of a language's sample; the language that needs the fewest phrases, relative to
what held-back text of its own needs, wins. Many stretches of text are parsed in lockstep with numpy; where one was begun in
the wrong state it is parsed anew until both agree, so the phrases are those of whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches

#: Bounds of the training sample: documents a language (in expectation), characters of a passage taken from one (its place is
#: drawn by a hash), characters a language, characters in all.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGE_CHARS, ALL_CHARS = 400, 2_000, 60_000, 1_000_000
#: Symbols: 0 is a break, the next 32 are digits, the others the most frequent letters of the sample. Any other letter is its code
#: point in DIGITS digits, so all letters of all scripts are told apart.
SYMBOLS, DIGITS = 80, 4
#: Stretches of text parsed side by side.
STRETCH = 1024
#: Bytes of an Arrow batch, about: its texts are held as characters, symbols and steps too.
BATCH_BYTES = 4 << 20
#: A language with less held-back text than this has no rate of its own.
HELD_SYMBOLS = 100
UNDETERMINED = "und"
FAIL = 1 << 30


class Automaton:
    """Suffix automaton over symbols: its arcs (state * width + symbol, next state)."""

    def __init__(self, symbols: np.ndarray, width: int):
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in symbols.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.states, self.width = len(nxt), width
        self.arcs = np.array([(s * width + c, t) for s, row in enumerate(nxt) for c, t in row.items()], np.int32).reshape(-1, 2)

    def steps(self, room: np.ndarray | None = None) -> np.ndarray:
        """Flat table for parsing: the next state times width, plus FAIL where a phrase starts: at the root, and where none goes on.

        A symbol that the text lacks is a phrase of its own and leads back to the root. The table lies in ``room`` if that is given.
        """
        first = self.arcs[self.arcs[:, 0] < self.width]
        anew = np.full(self.width, FAIL, np.int32)
        anew[first[:, 0]] += first[:, 1] * self.width
        out = np.empty(self.states * self.width, np.int32) if room is None else room[: self.states * self.width]
        out.reshape(-1, self.width)[:] = anew
        later = self.arcs[self.arcs[:, 0] >= self.width]
        out[later[:, 0]] = later[:, 1] * self.width
        return out


def letters() -> np.ndarray:
    """For every code point, the code point of its lower-case letter, or 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_LETTERS: list[np.ndarray] = []


def plain(text: str) -> np.ndarray:
    """Lower-case letters as code points; runs of anything else become one 0."""
    if not _LETTERS:
        _LETTERS.append(letters())
    codes = _LETTERS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))] if len(codes) else codes


def distinct(texts: list[np.ndarray]) -> list[np.ndarray]:
    return list({t.tobytes(): t for t in texts}.values())


def divided(texts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different texts to learn, and others (of under five texts, the last fifth of each) to hold back."""
    if len(texts) >= 5:
        return [t for i, t in enumerate(texts) if i % 5], texts[::5]
    if sum(len(t) // 5 for t in texts) < HELD_SYMBOLS:
        return texts, []
    return [t[: len(t) - len(t) // 5] for t in texts], [t[len(t) - len(t) // 5 :] for t in texts]


class Model:
    """Per language: its automaton and the phrases a symbol that its own held-back text needs."""

    def __init__(self, samples: dict[str, list[str]]):
        texts = {k: distinct([plain(t) for t in v]) for k, v in samples.items()}
        count = Counter()
        for v in texts.values():
            for t in v:
                count.update(t[t > 0].tolist())
        self.symbols = {c: i + 33 for i, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 33])}
        most = min(LANGUAGE_CHARS, ALL_CHARS // max(1, len(texts)))
        self.languages = sorted(texts)
        self.automata, self.own = [], []
        for k in self.languages:
            learn, held = ([self.encode(t) for t in part] for part in divided(texts[k]))
            self.automata.append(Automaton(np.concatenate([np.append(t, 0) for t in learn] or [np.zeros(0, np.uint8)])[:most], SYMBOLS))
            n = sum(len(t) for t in held)
            self.own.append(max(parse(self.automata[-1].steps(), held).sum() / n, 1e-3) if n >= HELD_SYMBOLS else None)
        # too little text to tell: as dear as the dearest of the others
        dearest = max((x for x in self.own if x is not None), default=1.0)
        self.own = [dearest if x is None else x for x in self.own]

    def encode(self, codes: np.ndarray) -> np.ndarray:
        table = getattr(self, "_table", None)
        if table is None:
            table = np.full(0x110000, 255, np.uint8)
            table[0] = 0
            for c, i in self.symbols.items():
                table[c] = i
            self._table = table
        out = table[codes]
        rare = out == 255
        if not rare.any():
            return out
        size = np.where(rare, DIGITS, 1)
        first = np.cumsum(size) - size
        long = np.repeat(out, size)
        for k in range(DIGITS):
            long[first[rare] + k] = 1 + (codes[rare] >> np.uint32(5 * (DIGITS - 1 - k)) & np.uint32(31))
        return long

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_table", "_room")}

    def steps(self) -> Iterator[np.ndarray]:
        """Each language's dense table, made where it is used, in the room of the one before; only the arcs travel."""
        if not hasattr(self, "_room"):
            self._room = np.empty(max((a.states * a.width for a in self.automata), default=0), np.int32)
        return (a.steps(self._room) for a in self.automata)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [plain(t or "") for t in texts]
        known = np.array([bool((c > 0).any()) for c in codes], bool)
        coded = [self.encode(c) for c in codes]
        need = np.array([parse(s, coded) / own for s, own in zip(self.steps(), self.own)]) if self.languages else np.zeros((0, len(texts)))
        names, scores = [], []
        for i in range(len(texts)):
            if not known[i] or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(need[:, i]))
            names.append(self.languages[best])
            scores.append(1 / sum(math.exp(-min(700.0, x - need[best, i])) for x in need[:, i].tolist()))
        return names, scores


def parse(steps: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases that each coded text needs.

    All stretches of all texts advance together, one symbol a step, each as if its text began there. Then those that a text enters
    in another state go on from that, until they are in the state they were in before; from there on all is as it was.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return np.zeros(len(texts))
    flat = np.concatenate(texts)
    per = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(texts)), per)
    begins = np.cumsum(lengths) - lengths
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = begins[owner] + nth * STRETCH
    size = np.minimum(lengths[owner] - nth * STRETCH, STRETCH)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at, left = start[order], size[order]
    live = len(order) - np.searchsorted(left[::-1], np.arange(1, left[0] + 1))
    base = np.concatenate(([0], np.cumsum(live)))  # the steps of all stretches, step by step
    taken = np.empty(len(flat), np.int32)
    state, phrases = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
    for t in range(int(left[0])):
        n = live[t]
        v = steps[state[:n] + flat[at[:n]]]
        taken[base[t] : base[t] + n] = v
        phrases[:n] += v >> 30
        state = v & (FAIL - 1)
        at = at[:n] + 1
    todo = np.flatnonzero(nth > 0)
    while len(todo):
        state = taken[base[size[todo - 1] - 1] + rank[todo - 1]] & (FAIL - 1)
        which, t, changed = todo, 0, []
        while len(which):
            v = steps[state + flat[start[which] + t]]
            place = base[t] + rank[which]
            old = taken[place]
            taken[place] = v
            phrases[rank[which]] += (v >> 30) - (old >> 30)
            state = v & (FAIL - 1)
            go = state != old & (FAIL - 1)
            which, state, t = which[go], state[go], t + 1
            done = size[which] == t
            changed.append(which[done] + 1)
            which, state = which[~done], state[~done]
        todo = np.concatenate(changed)
        todo = todo[todo < len(nth)]
        todo = todo[nth[todo] > 0]
    return np.bincount(owner[order], weights=phrases, minlength=len(texts))


def fit(rows: DataFrame) -> Model:
    """Model from (doc_id, text, lang) rows with labels; see the bounds above.

    Texts are sampled by a hash of what is taken of them, so copies count once, at a rate of its own for each language so that
    rare languages have as much text as common ones. Only the sample reaches the driver.
    """
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\\\p{L}'")
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("lang", F.substring("text", place, SAMPLE_CHARS).alias("t")).withColumn("key", F.xxhash64("t"))
    counts = {r[0]: r[1] for r in rows.select("lang", "key").distinct().groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    share = F.pmod("key", F.lit(1 << 40)) / float(1 << 40)
    rate = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    found = rows.filter(share < rate[F.col("lang")]).groupBy("lang", "key").agg(F.min("t").alias("t")).select("lang", "t", share.alias("s")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["s"], r["t"])):
        if sum(map(len, samples.setdefault(r["lang"], []))) < min(LANGUAGE_CHARS, ALL_CHARS // len(counts)) * 5 // 4:
            samples[r["lang"]].append(r["t"])
    return Model({k: v for k, v in samples.items() if v})


def held_out(doc_id, remainder: int = 1, of: int = 3):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % of == remainder, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of a row of docs, as a struct), lang_pred and score.

    Whole texts are parsed. A null text, or one without a letter, is ``und`` with score 0; so is everything for a model
    without languages. score is the winner's share if each phrase more (relative to a language's own text) costs a factor e. Ties
    go to the first language by name. Repeated rows agree; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                names, scores = shared.value.predict(part["row"].field("text").to_pylist())
                yield pa.record_batch([part["row"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    bound_batches(docs.sparkSession, size=BATCH_BYTES)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
