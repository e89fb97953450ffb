import math
import random

from mnemoframe.functions import segment


def paths(text, weight, other):
    """All ways to cut a text, with their weights."""
    if not text:
        return [(0, ())]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in weight or n == 1:
            out += [(weight.get(text[:n], other) + w, (text[:n], *p)) for w, p in paths(text[n:], weight, other)]
    return out


def test_best_path_equals_all_segmentations(spark):
    rng = random.Random(3)
    freq = {"天气": 50, "今天": 80, "天": 30, "今天天气": 3, "气": 10, "很好": 40, "好": 60, "很": 50, "北京": 70, "京城": 8, "北": 5}
    flags = {w: "n" if i % 2 else "v" for i, w in enumerate(freq)}
    words = spark.createDataFrame([(w, f, flags[w]) for w, f in freq.items()], "word string, freq long, flag string")
    texts = ["今天天气很好", "北京城好", "天天天气气"] + ["".join(rng.choices("今天气很好北京城x", k=rng.randint(1, 9))) for _ in range(30)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {(r["id"], r["run"]): r for r in segment.segment(rows, words, unknown=False).collect()}
    total = sum(freq.values())
    weight = {w: round(math.log(f / total) * 1e6) for w, f in freq.items()}
    other = round(math.log(1 / total) * 1e6)
    for i, t in enumerate(texts):
        for run, piece in enumerate(p for p in __import__("re").findall("x+|[^x]+", t)):
            r = got[i, run]
            if "x" in piece:
                assert [tuple(w) for w in r["words"]] == [(piece, "eng")]
                continue
            every = paths(piece, weight, other)
            best = max(w for w, _ in every)
            cut = tuple(w["word"] for w in r["words"])
            assert r["weight"] == best and cut == max((tuple(map(len, p)), p) for w, p in every if w == best)[1]
            assert all(w["flag"] == flags.get(w["word"], "x") for w in r["words"])


def test_small_dictionaries_travel_and_large_ones_are_joined(spark, capsys):
    rng = random.Random(5)
    words = spark.createDataFrame([("".join(w), 1 + i % 7, "nva"[i % 3]) for i, w in enumerate({tuple(rng.choices("天气很好北", k=rng.randint(1, 4))) for _ in range(60)})], "word string, freq long, flag string")
    texts = ["".join(rng.choices("天气很好北京 x7", k=rng.randint(0, 30))) for _ in range(80)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for unknown in (False, True):
        here, met = segment.segment(rows, words, unknown=unknown), segment.segment(rows, words, unknown=unknown, most=0)
        assert sorted(map(str, here.collect())) == sorted(map(str, met.collect()))
        here.explain()
        plan = capsys.readouterr().out
        assert "Join" not in plan and "Exchange" not in plan  # no substring is moved


def test_unknown_runs_and_topical_words(spark):
    words = spark.createDataFrame([("老师", 50, "n"), ("学生", 40, "n"), ("老", 3, "a"), ("生活", 20, "vn"), ("的", 90, "uj"), ("师傅", 9, "n"), ("学校", 30, "n"), ("了", 70, "ul")], "word string, freq long, flag string")
    rows = spark.createDataFrame([(1, "老师的Tea 2024 学生"), (2, None), (3, ""), (4, "莉娜"), (5, "的")], "id long, text string")
    cut = segment.tokens(segment.segment(rows, words))
    got = {r["id"]: r for r in cut.withColumn("topics", segment.topical(cut["words"], ["学生"])).collect()}
    assert [tuple(w) for w in got[1]["words"]] == [("老师", "n"), ("的", "uj"), ("tea", "eng"), ("2024", "m"), ("学生", "n")]
    assert got[1]["topics"] == ["老师", "tea"] and set(got) == {1, 4, 5}
    assert "".join(w["word"] for w in got[4]["words"]) == "莉娜"


def test_character_model_equals_all_state_paths(spark):
    words = spark.createDataFrame([("老师", 5, "n"), ("师", 3, "n"), ("图书馆", 4, "n"), ("书", 2, "n")], "word string, freq long, flag string")
    model = segment.character_model(words)
    emit = lambda s, c: model["emit"][s].get(c, model["rare"][s])

    def score(cut):
        total, before = 0.0, None
        for w in cut:
            for i, c in enumerate(w):
                s = "S" if len(w) == 1 else "B" if i == 0 else "E" if i == len(w) - 1 else "M"
                total += (model["start"][s] if before is None else model["move"][before][s]) + emit(s, c)
                before = s
        return total

    def cuts(text):
        return [(text[:n], *rest) for n in range(1, len(text) + 1) for rest in (cuts(text[n:]) if text[n:] else [()])]

    for text in ("老师书", "馆图书", "书书书书", "新图馆", "师"):
        assert abs(score(segment.cut_unknown(text, model)) - max(map(score, cuts(text)))) < 1e-9
