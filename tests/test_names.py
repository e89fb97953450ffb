import random

import pytest

from mnemoframe.operators import names


@pytest.mark.parametrize("most", [2, 4])
def test_occurrences_equal_brute_force(spark, most):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("ab猫茶é ") for _ in range(n))
    texts = [(rng.choice("pq"), i, some(rng.randint(0, 40))) for i in range(60)] + [("p", 100, None), ("q", 101, ""), ("p", 102, "𝒜猫𝒜猫茶")]
    known = [(rng.choice("pq"), some(rng.randint(1, 7))) for _ in range(120)] + [("p", None), ("p", "猫"), ("p", "𝒜猫"), ("p", "𝒜猫")]
    got = names.occurrences(spark.createDataFrame(texts, "persona_id string, id long, text string"), spark.createDataFrame(known, "persona_id string, name string"), ["id"], most=most)
    want = {(p, i, n) for p, i, t in texts for q, n in known if p == q and n and len(n) >= 2 and t and n in t}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
