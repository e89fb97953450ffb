"""Words of texts in scripts without spaces: the most probable path through a word graph, and a character model where the dictionary ends.

The word graph of a run comes from looking its short substrings up in the dictionary. One of up to BROADCAST words travels to the tasks, so
that no substring is moved; a larger one is met by a join, with equal results, over the different runs only. The character model, whose size is
bounded by the number of Han characters, travels always. Weights are whole millionths of natural logarithms, so sums are exact and ties are
settled alike everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = r"\p{IsHan}"
#: Pieces of a text: runs of Han characters, and runs of other letters and digits.
PIECES = rf"{HAN}+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"
#: Flags of words that say what a text is about, besides all that begin with n.
TOPICAL = ("vn", "an", "eng", "j")
STATES = "BMES"
#: Words of a dictionary that every task may hold; runs whose cuts a task remembers, and how long they are at most.
BROADCAST, REMEMBERED, SHORT = 500_000, 200_000, 32


def weighted(dictionary: DataFrame) -> DataFrame:
    """(word, flag, w) of a dictionary (word, freq, flag): w is the logarithm of the word's share. The row with a null word is for single characters that aren't there."""
    total = dictionary.agg(F.greatest(F.sum("freq"), F.lit(1)).alias("total"))
    rows = dictionary.select("word", "flag", "freq").unionByName(dictionary.sparkSession.createDataFrame([(None, "x", 1)], "word string, flag string, freq long"))
    return rows.join(F.broadcast(total)).select("word", "flag", F.round(F.log(F.col("freq") / F.col("total")) * 1_000_000).cast("long").alias("w"))


def character_model(dictionary: DataFrame) -> dict:
    """Where in words characters stand, from the dictionary: {"emit": {state: {char: logarithm}}, "move": {state: {state: logarithm}}, "start": {...}, "rare": {state: logarithm}}.

    States: begin, middle and end of a word, and single. Counts go up by one, so nothing is impossible that a word could be.
    """
    chars = dictionary.filter(F.col("word").rlike(f"^{HAN}+$")).select("freq", F.posexplode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("at", "c"), F.length("word").alias("n"))
    state = F.when(F.col("n") == 1, "S").when(F.col("at") == 0, "B").when(F.col("at") == F.col("n") - 1, "E").otherwise("M")
    counts = {(r["s"], r["c"]): r["f"] for r in chars.groupBy(state.alias("s"), "c").agg(F.sum("freq").alias("f")).collect()}  # four rows for each Han character at most
    total = {s: sum(f for (x, _), f in counts.items() if x == s) for s in STATES}
    kinds = len({c for _, c in counts}) + 1
    log = lambda a, b: math.log((a + 1) / (b + 2))
    inner, words = total["M"], total["B"]
    return {
        "emit": {s: {c: math.log((f + 1) / (total[s] + kinds)) for (x, c), f in counts.items() if x == s} for s in STATES},
        "rare": {s: math.log(1 / (total[s] + kinds)) for s in STATES},
        "start": {"B": log(words, words + total["S"]), "S": log(total["S"], words + total["S"])},
        "move": {"B": {"E": log(words, words + inner), "M": log(inner, words + inner)}, "M": {"E": log(words, words + inner), "M": log(inner, words + inner)}, **{s: {"B": log(words, words + total["S"]), "S": log(total["S"], words + total["S"])} for s in "ES"}},
    }


def cut_unknown(text: str, model: dict) -> list[str]:
    """Most probable words of a run that the dictionary doesn't know, by the character model."""
    emit = lambda s, c: model["emit"][s].get(c, model["rare"][s])
    best = {s: (model["start"][s] + emit(s, text[0]), s) for s in "BS"}
    for c in text[1:]:
        step: dict[str, tuple[float, str]] = {}
        for s, (score, path) in best.items():
            for t, move in model["move"][s].items():
                found = (score + move + emit(t, c), path + t)
                if t not in step or found > step[t]:
                    step[t] = found
        best = step
    path = max(v for s, v in best.items() if s in "ES")[1] if any(s in "ES" for s in best) else "S" * len(text)
    out = [""]
    for c, s in zip(text, path):
        out[-1] += c
        if s in "ES":
            out.append("")
    return out[:-1]


def graph_of(words: list[dict]) -> dict[int, list[tuple[int, int, str]]]:
    """Words of a run, by where they begin, as (length, weight, flag)."""
    at: dict[int, list[tuple[int, int, str]]] = {}
    for x in words:
        at.setdefault(x["begin"], []).append((x["n"], x["w"], x["flag"]))
    return at


def walked(score: list[tuple[int, int, str | None]]) -> tuple[list[tuple[int, int, str | None]], int]:
    path, i = [], 0
    while i < len(score) - 1:
        path.append((i, score[i][1], score[i][2]))
        i += score[i][1]
    return path, score[0][0]


def best_path(n: int, at: dict[int, list[tuple[int, int, str]]], other: int) -> tuple[list[tuple[int, int, str | None]], int]:
    """((begin, length, flag) of the words on the best path through n characters, its weight); of equal ones the path whose words are longer from the left."""
    score: list[tuple[int, int, str | None]] = [(0, 0, None)] * (n + 1)
    for i in range(n - 1, -1, -1):
        options = at.get(i, [])
        if all(m != 1 for m, _, _ in options):
            options = [*options, (1, other, None)]
        score[i] = max(((w + score[i + m][0], m, flag) for m, w, flag in options), key=lambda x: (*x[:2], x[2] or ""))
    return walked(score)


def best_path_of(piece: str, known: dict[str, tuple[int, str]], longest: int, other: int) -> tuple[list[tuple[int, int, str | None]], int]:
    """The same of a run, with the words (weight, flag) of a dictionary."""
    n, get = len(piece), known.get
    score: list[tuple[int, int, str | None]] = [(0, 0, None)] * (n + 1)
    for i in range(n - 1, -1, -1):
        w, flag = get(piece[i], (other, None))
        best, m = w + score[i + 1][0], 1
        for j in range(i + 2, min(i + longest, n) + 1):
            x = get(piece[i:j])
            if x is not None and x[0] + score[j][0] >= best:
                best, m, flag = x[0] + score[j][0], j - i, x[1]
        score[i] = (best, m, flag)
    return walked(score)


def segment(rows: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "text", unknown: bool = True, most: int = BROADCAST) -> DataFrame:
    """(key, run, words array<struct<word, flag>>, weight) of the runs of each text, in order of run.

    rows: (key, text) with one row per key; dictionary: (word, freq, flag). Han runs are cut along the most probable path; neighbouring single
    characters of it that form no word are cut again by the character model (``unknown``), flag x. Other runs stay whole and are
    lower-cased: flag m for digits, else eng. Texts that are null or hold no letter or digit give no rows. A dictionary of over ``most`` words is joined.
    """
    weights = weighted(dictionary)
    size, longest = dictionary.agg(F.count("*"), F.max(F.length("word"))).first()
    longest = longest or 1
    other = weights.filter("word IS NULL").first()["w"]
    model = rows.sparkSession.sparkContext.broadcast(character_model(dictionary) if unknown else None)
    pieces = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PIECES), F.lit(0))
    words = weights.filter("word IS NOT NULL")
    kind = f"{rows.schema[key].dataType.simpleString()}, run int, words array<struct<word:string,flag:string>>, weight long"
    known: dict[str, tuple[int, str]] = {}
    if size <= most:
        for r in words.collect():  # BROADCAST rows at most
            if (r["w"], r["flag"]) > known.get(r["word"], (-math.inf, "")):
                known[r["word"]] = (r["w"], r["flag"])
    table = rows.sparkSession.sparkContext.broadcast(known)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts; the cuts of short runs are remembered."""
        done: dict[str, tuple[list[str], list[str], int]] = {}
        for b in batches:
            at, nth = [], []
            out = Cuts()
            for i, text_pieces in enumerate(b["pieces"]):
                for k, (piece, flag) in enumerate(zip(text_pieces.values.field(0).to_pylist(), text_pieces.values.field(1).to_pylist()) if text_pieces.is_valid else ()):
                    at.append(i)
                    nth.append(k)
                    got = done.get(piece)
                    if got is None:
                        path, weight = best_path_of(piece, table.value, longest, other) if flag is None else ([], 0)
                        cut = list(named(piece, path)) if flag is None else [{"word": piece, "flag": flag}]
                        got = [x["word"] for x in cut], [x["flag"] for x in cut], weight
                        if len(done) < REMEMBERED and len(piece) <= SHORT:
                            done[piece] = got
                    out.add(*got)
                if len(at) > 20_000:
                    yield out.batch(b[key].take(pa.array(at)), pa.array(nth, pa.int32()), key)
                    at, nth, out = [], [], Cuts()
            yield out.batch(b[key].take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), key)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = Cuts()
            for piece, graph in zip(b["piece"].to_pylist(), b["words"].to_pylist()):
                path, weight = best_path(len(piece), graph_of(graph or []), other)
                cut = list(named(piece, path))
                out.add([x["word"] for x in cut], [x["flag"] for x in cut], weight)
            yield out.batch(b[key], b["run"], key)

    def named(piece: str, path: list[tuple[int, int, str | None]]) -> Iterator[dict]:
        singles = ""
        for begin, n, flag in [*path, (0, 0, None)]:
            if n == 1 and unknown:
                singles += piece[begin]
                continue
            if len(singles) > 1:
                yield from ({"word": w, "flag": "x"} for w in cut_unknown(singles, model.value))
            elif singles:
                yield {"word": singles, "flag": flag_of(piece, path, begin)}
            singles = ""
            if n:
                yield {"word": piece[begin : begin + n], "flag": flag or "x"}

    def flag_of(piece: str, path: list[tuple[int, int, str | None]], upto: int) -> str:
        return next((f or "x" for i, n, f in path if n == 1 and (i + 1 == upto or upto == 0 and i + 1 == len(piece))), "x")

    if size <= most:
        told = F.transform(pieces, lambda x: F.struct(x.alias("piece"), F.when(x.rlike(f"^{HAN}"), None).when(x.rlike("^[0-9]+$"), "m").otherwise("eng").alias("flag")))
        return rows.select(key, told.alias("pieces")).mapInArrow(here, f"{key} {kind}")
    runs = rows.select(key, F.posexplode(pieces).alias("run", "piece"))
    han = runs.filter(F.col("piece").rlike(f"^{HAN}"))
    begins = F.sequence(F.lit(0), F.length("piece") - 1)
    parts = F.flatten(F.transform(begins, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("piece") - i)), lambda n: F.struct(i.alias("begin"), n.alias("n"), F.substr("piece", i + 1, n).alias("word")))))
    found = han.select("piece").distinct().select("piece", F.explode(parts).alias("p")).select("piece", "p.*").join(words, "word")
    graph = found.groupBy("piece").agg(F.collect_list(F.struct("begin", "n", "w", "flag")).alias("words"))
    cut = han.join(graph, "piece", "left").select(key, "run", "piece", "words").mapInArrow(walk, f"{key} {kind}")
    flag = F.when(F.col("piece").rlike("^[0-9]+$"), "m").otherwise("eng")
    plain = runs.filter(~F.col("piece").rlike(f"^{HAN}")).select(key, "run", F.array(F.struct(F.col("piece").alias("word"), flag.alias("flag"))).alias("words"), F.lit(0).cast("long").alias("weight"))
    return cut.unionByName(plain)


class Cuts:
    """Cut runs, on their way to a batch."""

    def __init__(self):
        self.words, self.flags, self.upto, self.weights = [], [], [0], []

    def add(self, words: list[str], flags: list[str], weight: int) -> None:
        self.words += words
        self.flags += flags
        self.upto.append(len(self.words))
        self.weights.append(weight)

    def batch(self, keys: pa.Array, runs: pa.Array, key: str) -> pa.RecordBatch:
        items = pa.StructArray.from_arrays([pa.array(self.words, pa.string()), pa.array(self.flags, pa.string())], ["word", "flag"])
        return pa.record_batch([keys, runs, pa.ListArray.from_arrays(pa.array(self.upto, pa.int32()), items), pa.array(self.weights, pa.int64())], names=[key, "run", "words", "weight"])


def tokens(cut: DataFrame, key: str = "id") -> DataFrame:
    """(key, words array<struct<word, flag>>): the words of a text in order."""
    return cut.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "words"))), lambda r: r["words"])).alias("words"))


def topical(words: Column, stop: list[str] = ()) -> Column:
    """The words of a question that say what it is about: nouns, names and foreign words, each once, without stop words and numbers."""
    some = F.filter(words, lambda w: (w["flag"].startswith("n") | w["flag"].isin(*TOPICAL)) & ~w["word"].rlike("^[0-9]+$") & (~w["word"].isin(*stop) if stop else F.lit(True)))
    return F.array_distinct(F.transform(some, lambda w: w["word"]))


def with_words(rows: DataFrame, dictionary: DataFrame, keys: list[str], text: Column, name: str = "words") -> DataFrame:
    """rows plus the words of ``text`` in order, as array<string>: what the full-text index takes for ``tokens``."""
    keyed = rows.withColumn("_key", F.struct(*keys))
    cut = tokens(segment(keyed.select("_key", text.alias("text")), dictionary, "_key"), "_key").select("_key", F.transform("words", lambda w: w["word"]).alias(name))
    return keyed.join(cut, "_key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("_key")
