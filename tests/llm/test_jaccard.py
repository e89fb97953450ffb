"""The similarity join of the pipeline's near-dedup against all pairs."""

import random

from mnemoframe.llm import jaccard, simhash


def survivors(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"] for r in simhash.deduplicate(rows, similarity=0.8).collect()}


def brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    return {up.index(c) for c in set(up)}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = [list(base) for _ in range(n)]
    for t in out:
        for _ in range(rng.randint(*edits)):
            t[rng.randrange(words)] = f"w{rng.randrange(3000)}"
    return [" ".join(t) for t in out]


def test_links_of_large_families_are_verified_before_they_are_joined(spark):
    rng = random.Random(3)
    texts = family(rng, 150, 120, (1, 5)) + family(rng, 60, 40, (0, 2))
    assert survivors(spark, texts) == brute(texts)


def test_short_copies_are_found_whatever_their_fingerprints(spark):
    rng = random.Random(4)
    texts = []
    for i in range(100):
        words = [f"w{rng.randrange(3000)}" for _ in range(14)]
        texts += [" ".join(words[:12]), " ".join(words)]
    assert survivors(spark, texts) == brute(texts) == {2 * i for i in range(100)}


def test_texts_of_one_fingerprint_are_told_apart(spark):
    rng = random.Random(6)
    texts = ["ha " * 60 + " ".join(f"w{rng.randrange(3000)}" for _ in range(18)) for _ in range(8)]
    texts += [texts[5] + " more", texts[5].upper()]
    assert len({simhash.fingerprint(t.encode()) for t in texts}) == 1
    assert survivors(spark, texts) == brute(texts) == set(range(8))


def test_links_of_fingerprints_come_first_and_the_rest_is_found_all_the_same(spark, monkeypatch):
    rng, seen, real = random.Random(8), [], jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda *a: seen.append(a[-1].count()) or real(*a))
    texts = family(rng, 30, 400, (0, 2)) + family(rng, 20, 30, (0, 1)) + ["", " ", "!!", "one two", "One  two"]
    assert survivors(spark, texts) == brute(texts)
    assert seen[0] >= 15  # most of the long family, without any shared shingle looked for
