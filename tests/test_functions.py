from pyspark.sql import functions as F

from mnemoframe.functions import parsing, text
from mnemoframe.sources.config import Settings, flatten, merge


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*[F.col(n) for n in names])).first()[0]


def test_tokens_and_clamp(spark):
    assert [one(spark, text.estimate_tokens, v) for v in (None, "", "a", "abcdef", "日本語")] == [0, 0, 1, 2, 3]
    long = "日" * 700
    cut = one(spark, lambda c: text.clamp(c, 500), long)
    assert cut.endswith(text.CUT_MARK) and len(cut.encode()) // 3 <= 500 and set(cut.removesuffix(text.CUT_MARK)) == {"日"}
    assert one(spark, lambda c: text.clamp(c, 500), "short") == "short"


def test_terms(spark):
    assert one(spark, text.split_terms, "Ann、Bob / C|d　e") == ["Ann", "Bob", "C", "d", "e"]
    assert one(spark, text.norm_term, " LoRA　") == "lora"
    assert one(spark, text.topic_words, "The cat is 42 Katzen, a É.") == ["cat", "katzen"]
    assert sorted(one(spark, text.keyword_tokens, "I like 喝茶吧 Tea")) == sorted(["like", "tea", "喝", "茶", "吧", "喝茶", "茶吧"])
    assert one(spark, text.keyword_tokens, "x") == []


def test_labels_and_names(spark):
    assert [one(spark, text.retention_months, v) for v in ("core", "Lasting!", "3.5", "?", None)] == [-1.0, 60.0, 3.5, 8.0, 8.0]
    assert [one(spark, text.normalize_level, v) for v in ("2", "m3", "x", None, "-1")] == [2, 3, 0, 0, 0]
    assert one(spark, text.safe_session_id, "a b/c") == "a_b_c" and one(spark, text.safe_session_id, None) == "default"
    assert one(spark, text.safe_filename, "../x y..") == "x_y"
    assert one(spark, text.strip_think, "<think>a\nb</think> yes ") == "yes"


def test_time_prefix(spark):
    now = "2024-06-10 12:00:00"
    rows = [("2024-06-10 11:00:00", None), ("2024-06-10 02:00:00", "2024-06-10 上午"), ("2024-06-09 11:00:00", "晚上"), ("2024-06-08 11:00:00", None), ("2024-06-04 10:00:00", None), (None, None), ("2024-06-11 12:00:00", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string")
    got = [r[0] for r in df.orderBy("i").select(text.time_prefix(F.col("t").cast("timestamp"), F.col("s"), F.lit("b"), F.lit(now).cast("timestamp"))).collect()]
    # the id "b" is code point 98: even, and 2 modulo 3
    assert got == ["刚才，", "今天早上，", "昨晚，", "前天，", "前几天，", "", "前几天，"]


def test_fields(spark):
    block = "noise\n内容: a\n b \n\n话题：t: u\n内容: last"
    got = one(spark, lambda c: parsing.fields(c, parsing.MEMORY_FIELDS), block)
    assert got == {"topic": "t: u", "record": "last"}
    assert one(spark, lambda c: parsing.fields(c, parsing.MEMORY_FIELDS), "内容: a\n b \n\nc") == {"record": "a\nb\nc"}


def test_harvest_edges(spark):
    df = spark.createDataFrame([(1, "===回忆 1===\n内容: x\n===纠正 1===\n原信息: o\n===事实 1===\n内容: stray"), (2, None), (3, "无事件")], "id int, raw string")
    assert [(r["id"], r["record"], r["retention"]) for r in parsing.memories(df).collect()] == [(1, "x", 8.0)]
    assert [(r["id"], r["original"], r["user_said"]) for r in parsing.corrections(df).collect()] == [(1, "o", None)]


def test_sql_functions(spark):
    text.register(spark)
    row = spark.sql("SELECT estimate_tokens('abcdef') a, topic_words('The Cat') b, strip_think('<think>x</think> y') c, retention_months('core') d").first()
    assert tuple(row) == (2, ["the", "cat"], "y", -1.0)


def test_settings():
    s = Settings({"card": {"max_tokens": {"_label": "x", "value": 7}}}, {"p": {"card.max_tokens": 9, "review.buffer_max": 1}}, {"card.max_tokens"})
    assert s.get("card.max_tokens") == 7 and s.get("card.max_tokens", "p") == 9 and s.get("review.buffer_max", "p") == 5
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and flatten({"a": {"b": 1}}) == {"a.b": 1}
    try:
        s.get("none")
    except KeyError:
        pass
    else:
        raise AssertionError


def test_known_names_stay_whole(spark):
    df = spark.createDataFrame([("我和小明去New York, in (a) inn; new yorker C++",)], "t string")
    assert df.select(text.words(F.col("t"), ["小明", "New York", "in", "C++", " "]).alias("w")).first()["w"] == ["我和", "小明", "去", "new york", "in", "a", "inn", "new", "yorker", "c++"]
    assert df.select(text.topic_words(F.col("t"), names=["小明"]).alias("w")).first()["w"] == ["我和", "小明", "去new", "york", "inn", "new", "yorker"]


def test_character_pairs_come_from_one_pass(spark):
    texts = ["", "a", "ab", "aab", "A b\n\nC", "\U0001f600x\U0001f600x", "日本語日本", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.bigrams(F.col("t")).alias("b"))
    for r in df.collect():
        low = r["t"].lower()
        assert sorted(r["b"]) == sorted({low[i : i + 2] for i in range(len(low) - 1)} or {low})
    assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_safe_names_are_written_once_and_take_any_default(spark):
    c = F.col("t")
    df = spark.createDataFrame([("a b..c ",), ("",), (None,), ("._ ",), ("é\n",)], "t string").select(text.safe_session_id(c).alias("a"), text.safe_filename(c).alias("b"), text.safe_filename(c, "a\\b$1").alias("d"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-zA-Z0-9_.-]+") == 1 and plan.count("^[_. ]+|[_. ]+$") == 2
    assert [tuple(r)[:2] for r in df.collect()] == [("a_b..c", "a_b_c"), ("default", "default"), ("default", "default"), ("._", "default"), ("_", "é")]
    assert [r[2] for r in df.collect()] == ["a_b_c", "a_b_1", "a_b_1", "a\\b$1", "é"]
