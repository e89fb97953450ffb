import random

import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, copies, near copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", "c", None])) for i in range(60)]
    rows += [(100 + i, rows[0][1], "en", "a") for i in range(20)]
    rows += [(130, rows[0][1].replace(" ", "\t\n"), "en", "b"), (131, rows[1][1] + " x", "en", "b"), (132, None, None, None), (133, "", "en", "a"), (134, " \n", "fr", None), (135, text(5000), "en", "a")]
    rows += [(None, rows[2][1], "en", "a"), (136, "!!! 123", "en", "c"), (7, rows[7][1], rows[7][2], rows[7][3])]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], TEXT).repartition(3)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], TEXT)
