from pyspark.sql import functions as F

from mnemoframe.operators import graph, store
from mnemoframe.plans.engine import MemoryEngine
from mnemoframe.plans.seams import Seams, ask, hashed_encoder, rerank
from mnemoframe.sources.config import Settings
from mnemoframe.streaming import incremental

NOW = "2024-06-01T10:00:00"
REPLY = "===回忆 1===\n主体: Miso\n话题: pets\n留存度: lasting\n内容: Miso is a grey cat\n===回忆 2===\n内容: She lives in Paris\n===纠正 1===\n原信息: lives in Paris\n她的说法: lives in Lyon"


def test_engine_end_to_end(spark, tmp_path):
    said = []

    def sub(prompts, personas):
        return ["===user===\nlikes cats" if p.startswith("- [") else "Summary." for p in prompts]

    e = MemoryEngine(spark, str(tmp_path), Seams(main_brain=lambda p, _: [REPLY] * len(p), subbrain=sub))
    e.register_persona("p", "Pia", "Uwe")
    assert [tuple(r) for r in e.register_persona("p", "", "Udo").collect()] == [("p", "Pia", "Udo", None)]
    assert [tuple(r) for r in e.names().collect()] == [("p", "Pia", "Udo")]
    messages = spark.createDataFrame([("p", "s", 0, "user", "hi"), ("p", "s", 1, "assistant", "[BFF_ERROR] x")], "persona_id string, session_id string, turn long, role string, content string")
    out = e.ingest(messages, NOW)
    assert len(out["card_ids"]) == 2 and out["corrections"] == 1
    content = sorted(r["content"] for r in e.store("p").collect())
    assert content == ["Miso is a grey cat", "She lives in Lyon"]
    got = e.retrieve("p", "tell me about Miso", NOW)
    assert got["search_mode"] == "region" and "Miso is a grey cat" in got["prompt_text"] and len(got["card_ids"]) == 1
    e.seams.injected = lambda s: set(got["card_ids"])
    assert e.retrieve("p", "tell me about Miso", NOW, "s")["cards"] == []
    q = spark.createDataFrame([(1, "p", "grey cat Miso")], "query_id long, persona_id string, text string")
    assert e.hybrid_many(q, NOW).first()["card_id"] == got["card_ids"][0]
    assert e.hub_many(q).count() >= 1
    found = e.search("p", ["grey cat Miso"], NOW)
    assert found["search_mode"] == "hybrid" and found["cards"][0]["card_id"] == got["card_ids"][0] and found["total_raw"] >= len(found["activated"]) >= 1
    assert e.search("p", ["grey cat", "x"], NOW)["search_mode"].startswith("multi_") and e.search("p", [], NOW)["search_mode"] == "no_query"
    assert e.search("p", ["x"], NOW, 0)["search_mode"] == "disabled" and e.search("p", ["grey cat Miso"], NOW, excluded={got["card_ids"][0]})["cards"] != found["cards"]
    assert e.get("p", got["card_ids"][0])["content"] == "Miso is a grey cat" and e.get("p", "none") is None
    e.seams.rerank = lambda queries, texts: [float("Lyon" in t) for t in texts]
    assert e.hybrid_many(q, NOW, 1).count() == 1
    e.seams.rerank = None
    e.seams.subbrain = lambda p, _: [f"[保留] {got['card_ids'][0]}"]
    assert e.review_and_filter("p", "grey cat Miso", NOW) == got["card_ids"]
    assert e.store("p").filter("reference_count = 1").count() == 1
    e.seams.subbrain = sub
    report = e.review("2024-07-01T10:00:00", today=e.store("p"))
    assert report["errors"] == [] and report["retention_decayed"] == 2 and report["dedup"] == 0
    assert e.portrait("p")["cards"] and e.portrait("p")["tokens"] > 0
    assert e.migrate() == {"pruned": 0, "kept": report["summaries_written"]}
    assert not said


def test_summaries_are_due_again_and_legacy_cards_stay_out(spark, tmp_path):
    prompts = []
    ask_log = str(tmp_path / "asked")

    def sub(p, _):
        with open(ask_log, "a") as f:
            f.write("\\x00".join(p))
        return ["about tea"] * len(p)

    e = MemoryEngine(spark, str(tmp_path / "m"), Seams(subbrain=sub), frequency=spark.createDataFrame([("zzz", 1)], "word string, gf long"))
    cards = lambda a, b, **more: spark.createDataFrame([("p", f"k{i}", i, f"we had teapot number {i}", "teapot", more.get("legacy", False)) for i in range(a, b)], "persona_id string, id string, seq long, content string, subject string, legacy boolean").withColumn("created_at", F.timestamp_seconds(F.col("seq") * 86400))
    e.settings.general["review.dedup_threshold"] = 2.0
    e.put(cards(0, 6))
    assert e.review("2024-07-01T10:00:00")["summaries_written"] >= 1 and not prompts
    count = lambda: e.summaries.load().filter("node_name = 'teapot'").first()["new_since_write"]
    assert count() == 0 and e.review("2024-07-02T10:00:00")["summaries_written"] == 0
    e.put(cards(6, 10))
    assert count() == 4 and e.review("2024-07-03T10:00:00")["summaries_written"] >= 1 and count() == 0
    assert "Rewrite the summary of teapot:\nabout tea" in open(ask_log).read()
    e.put(cards(20, 21, legacy=True))
    q = spark.createDataFrame([(1, "p", "teapot number 20")], "query_id long, persona_id string, text string")
    assert e._channels(q, 3)[1].isEmpty()  # the only card with all words is legacy


def test_judged_pools_are_rewritten_and_personas_have_caps(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path), settings=Settings(personas={"tight": {"card.max_tokens": 20}}))

    def sub(prompts, personas):
        def reply(p):
            if p.startswith("Do these notes"):
                return "===暂存池判断===\n需要吸收: " + ("是" if "matters" in p else "否")
            if p.startswith("Shorten"):
                return "short text"
            return "===user===\ntoday" if p.startswith("- [") or p.startswith("said") else "rewritten"

        return [reply(p) for p in prompts]

    e.seams.subbrain = sub
    e.seams.main_brain = lambda prompts, _: ["===回忆 1===\n内容: " + "long words " * 12] * len(prompts)
    said = "persona_id string, session_id string, turn long, role string, content string"
    e.ingest(spark.createDataFrame([("tight", "a", 0, "user", "hi"), ("wide", "b", 0, "user", "hi")], said), NOW)
    assert {r["persona_id"]: r["content"] for r in e.store().collect()} == {"tight": "short text", "wide": ("long words " * 12).strip()}
    for p in ("tight", "wide"):
        e.register_persona(p)
    pool = lambda text: [("2024-06-01", text)]
    kept = spark.createDataFrame([(p, f"p_{p}", 0, 2, "x", True, "user", "old", "mid", [(f"2024-06-0{i}", "s") for i in range(2, 7)], pool(t)) for p, t in (("tight", "it matters"), ("wide", "trifle"))], "persona_id string, id string, seq long, level int, content string, is_portrait boolean, portrait_type string, stable string, mid_term string, recent_buffer array<struct<date:string,summary:string>>, staging_pool array<struct<date:string,summary:string>>")
    e.put(kept)
    assert e.review("2024-07-01T10:00:00", today=e.store().filter("NOT coalesce(is_portrait, false)"))["errors"] == []
    assert {r["persona_id"]: (r["mid_term"] == "mid", len(r["staging_pool"])) for r in e.store().filter("portrait_type = 'user'").collect()} == {"tight": (False, 0), "wide": (True, 2)}


def test_seams(spark):
    df = spark.createDataFrame([("p", "x")], "persona_id string, prompt string")
    assert ask(df, lambda p, w: [f"{a}/{b}" for a, b in zip(p, w)]).first()["raw"] == "x/p"
    assert hashed_encoder(8)(["a b", None]).shape == (2, 8)
    hits = spark.createDataFrame([(1, "q", "c", "a", 0.1), (1, "q", "d", "b", 0.9)], "query_id int, text string, content string, card_id string, energy double")
    assert [r["card_id"] for r in rerank(hits, None, 1).collect()] == ["b"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("p", f"c{i}", i, 1, n) for i in range(4) for n in ("tea", "cat")[: i + 1]], "persona_id string, card_id string, seq long, pos int, node string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "graph")
    q = stream.writeStream.foreachBatch(lambda b, i: [incremental.merge_graph(b, i, path) for _ in range(2)]).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()  # each batch twice
    q.awaitTermination()
    assert {r["name"]: r["df"] for r in incremental.merged_nodes(spark, path).collect()} == {"tea": 4, "cat": 3} and incremental.merged_edges(spark, path).first()["weight"] == 3
    q = incremental.node_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["node"]: r["cards"] for r in spark.table("counts").collect()} == {"tea": 4, "cat": 3}
    events = spark.createDataFrame([("s", "c1", "error", 10), ("s", "c1", "error", 20), ("s", "c2", "view", 700)], "session_id string, card_id string, event_type string, t long").withColumn("ts", F.timestamp_seconds("t"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    for name, df in (("once", incremental.first_shown(ev)), ("errs", incremental.errors_per_window(ev))):
        mode = "append" if name == "once" else "update"
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 2 and [r["errors"] for r in spark.table("errs").collect()] == [2]


def test_without_an_encoder_words_are_compared(spark, tmp_path):
    def broken(texts):
        raise RuntimeError("no model")

    e = MemoryEngine(spark, str(tmp_path), Seams(encode=broken), settings=Settings(general={"features": {"keyword_match": True}}, personas={"p": {"retrieve.region_count": 1}}))
    e.put(spark.createDataFrame([("p", f"k{i}", i, t) for i, t in enumerate(["green tea in lyon", "a grey cat", "tea again"])], "persona_id string, id string, seq long, content string"))
    found = e.search("p", ["green tea"], NOW)
    assert found["search_mode"] == "keyword" and found["cards"][0]["card_id"] == "k0"
    assert e.search("p", ["green tea", "cat"], NOW)["search_mode"] == "multi_keyword"
    assert len(e.retrieve("p", "tea and a cat", NOW)["card_ids"]) == 1  # the persona's own budget
    q = spark.createDataFrame([(1, "p", "tea cat")], "query_id long, persona_id string, text string")
    assert sorted(r["text"] for r in e.widened(q).collect()) == ["cat tea", "tea cat"] or e.widened(q).count() == 2
    e.save_portrait(spark.createDataFrame([("p", "user", "likes tea")], "persona_id string, portrait_type string, content string"))
    e.save_portrait(spark.createDataFrame([("p", "user", "likes coffee")], "persona_id string, portrait_type string, content string"))
    assert [(c["card_id"], c["content"]) for c in e.portrait("p")["cards"]] == [("p_user", "likes coffee")]
    e.settings.general["features.keyword_match"] = "0"
    assert not e.settings.enabled("keyword_match") and e.settings.enabled("anything else")
