"""Language ID where the labelled sample has many copies or few texts."""

import random

import pytest

from mnemoframe.llm import langid


def speaker(language):
    rng = random.Random(language)
    pieces = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))) for _ in range(600)]
    return lambda seed, n=150: " ".join(random.Random(f"{language}{seed}").choices(words, k=n))


A, B, C = (speaker(x) for x in "abc")
TEXTS = {"a": [A(i) for i in range(60)], "b": [B(i) for i in range(60)]}


@pytest.mark.parametrize("rare", [[C(i) for i in range(30)] + [C(0)] * 30, [C(0)] * 90 + [C(i) for i in range(1, 11)], [C(i) for i in range(4)], [C(0)]])
def test_copies_and_few_texts(rare):
    names, _ = langid.Model({**TEXTS, "c": rare}).predict([f(k) for f in (A, B, C) for k in range(1000, 1020)])
    assert names == ["a"] * 20 + ["b"] * 20 + ["c"] * 20


def test_fit_samples_distinct_texts(spark):
    rows = [(i, t, k) for k, v in TEXTS.items() for i, t in enumerate(v)]
    rows += [(1000 + i, C(0), "c") for i in range(1500)] + [(9000 + i, C(i), "c") for i in range(1, 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict([C(k) for k in range(1000, 1020)])[0] == ["c"] * 20
