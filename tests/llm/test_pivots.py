import random
import re
from collections import Counter

import numpy as np
import pytest

from mnemoframe.llm import pivots


def brute(rows, least, top=2000):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            c.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        rank = []
        for g, a in c.items():
            if len(g) < 2 or a < least or any(100 * b >= 100 * a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in c.items() if b >= least):
                continue
            score, k = min((1000 * a * total[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rank.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture()
def table(spark):
    rng = random.Random(8)
    vocabulary = ["the", "OF", "a", "é", "x-y", "tea", "time", "Ünder", "zz", "q"]
    text = lambda n: "".join(rng.choices(vocabulary, range(10, 0, -1))[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "]) for _ in range(n))
    rows = [(text(rng.randint(0, 80)), rng.choice(["en", "en", "fr", None])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" \t", "de"), ("ha " * 300, "en"), ("tea time of the zz " * 12, "fr")] + [("Tea Time; tea time", "fr")] * 9
    return rows, spark.createDataFrame([(i, *r, "x", 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, word string, code int").repartition(3)


@pytest.mark.parametrize("how", ["dictionary", "join", "split", "split and join", "small blocks"])
def test_equals_brute_force(table, how, monkeypatch):
    rows, df = table
    if how == "small blocks":
        monkeypatch.setattr(pivots, "BLOCK", 37)
        monkeypatch.setattr(pivots, "STRETCH", 50)
        monkeypatch.setattr(pivots, "HELD", 3)
    out = pivots.collocations(df, least=6, broadcast=0 if "join" in how else 1000, split=20 if "split" in how else 1 << 40, part=100)
    assert got(out) == brute(rows, 6)


def test_top_ties_and_empty_tables(spark, nothing):
    df = spark.createDataFrame([("b c. a b. c d. b a", "en")] * 5, "text string, lang string")
    assert got(pivots.collocations(df, least=5, top=2)) == brute([("b c. a b. c d. b a", "en")] * 5, 5, 2)
    assert pivots.collocations(nothing).collect() == []


def test_arithmetic_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, x, y = 10**13 + 7, 10**15 + 11, 10**13 + 9, 10**14 + 3
    big = lambda c: F.col(c).cast("decimal(38,0)")
    df = spark.createDataFrame([(a, n, x, y)], "f long, total long, l long, r long")
    out = df.select(F.call_function("div", (big("f") * F.lit(1000) * big("total")).cast("decimal(38,0)"), (big("l") * big("r")).cast("decimal(38,0)")).alias("s")).first()["s"]
    assert out == 1000 * a * n // (x * y)


def test_fragments_hold_what_is_more_frequent_than_their_pivot():
    codes = np.array([0, 3, 1, 3, -1, 2])
    assert pivots.fragments(codes, np.arange(6)).tolist() == [[-1, -1, -1, 0, 3, 1, 3, -1, -1], [-1, -1, -1, 1, 3, -1, -1, -1, -1]]
    rows, n = pivots.summed(np.array([[1, 2], [3, 4], [1, 2]]), None)
    assert sorted(zip(map(tuple, rows.tolist()), n.tolist())) == [((1, 2), 2), ((3, 4), 1)]
