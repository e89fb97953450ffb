import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import recompression


def brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    least = {}
    for (doc, *_), w in zip(rows, words):
        for i in range(len(w) - length + 1) if doc is not None else ():
            key = tuple(w[i : i + length])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1) if doc is not None else ():
            if least[tuple(w[i : i + length])] < doc:
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    rows = df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("length,share", [(13, 5000), (5, 5000), (5, 1_000_000_000)])
def test_equals_brute_force(spark, docs, length, share):
    """A share that no count reaches makes all names hot: windows are then filed one by one."""
    rng = random.Random(2)
    word = lambda: rng.choice(["la", "li", "lo", "é", "x" * 30, "na"])
    passage = [word() for _ in range(40)]
    more = []
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 60))]
        a, b = sorted((rng.randint(0, 40), rng.randint(0, 40)))
        more.append((300 + i, " ".join(own[:20] + passage[a:b] + own[20:]), "en", "a", 1))
    more += [(400, "ha " * 100, "en", "a", 1), (401, "ho\t" * 7 + "ha\n" * 60, "en", "a", 1), (402, " ".join(passage * 3), "en", "a", 1), (402, " ".join(passage), "en", "b", 1)]
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows = [tuple(r) for r in every.collect()]
    assert got(recompression.remove(every, length, share=share)) == brute(rows, length)


def test_long_texts_are_cut_at_white_space_and_parsed_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.choice("abcd") * rng.randint(1, 3) for _ in range(700)]
    rows = [(1, " ".join(base)), (2, " ".join(base[100:400]) + "\n" + "y" * 900 + " " + " ".join(base[300:])), (3, "z" * 2000 + " " + " ".join(base[50:80])), (4, None), (5, "")]
    monkeypatch.setattr(recompression, "STRETCH", 256)
    monkeypatch.setattr(recompression, "BLOCK", 50)
    texts = [(t or "").encode() for _, t in rows]
    for own, names in recompression.word_names(texts):
        for i in np.unique(own):
            assert (own == i).sum() == len(texts[i].split())
    # equal windows are filed alike, wherever stretches and blocks end
    filed = {}
    for own, start, name, n, digest in recompression.Finder(13).runs(texts):
        k = 0
        for o, s, h, m in zip(own, start, name, n):
            for j in range(m):
                filed.setdefault(tuple(texts[o].split()[s + j : s + j + 13]), set()).add((int(h), int(digest[k])))
                k += 1
    assert sum(len(v) for v in filed.values()) == len(filed)
    assert len(filed) == len({tuple(w[i : i + 13]) for w in map(bytes.split, texts) for i in range(len(w) - 12)})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(recompression.remove(df)) == brute(rows, 13)


def test_runs_of_one_word_and_equal_rows(spark):
    rows = [(1, "a " * 50), (2, "a " * 30 + "b " * 30), (3, "b " * 40), (3, "b " * 40), (None, "a " * 50), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("spans", F.lit(1))
    assert got(recompression.remove(df)) == brute(rows, 13)


def test_empty_table_and_ids_of_text(spark, nothing):
    assert recompression.remove(nothing).collect() == []
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in recompression.remove(df).collect()} == {"a": 0, "b": 20}
