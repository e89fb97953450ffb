import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import activation, fts, graph, maintain, region, store, vector
from mnemoframe.sources import cards as C
from mnemoframe.sources.logs import FeatureLog, new_trace_id, read_log

NOW = "2024-06-01 00:00:00"


def cards(spark, *rows):
    """Cards of dicts; id, seq and persona have defaults."""
    full = [{"persona_id": "p", "seq": i, "id": f"c{i}", "level": 0, "content": "", "legacy": False, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in C.CARD.names) for r in full], C.CARD)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_normalize(spark):
    df = spark.createDataFrame(
        [("p", 0, "a", "m2", "deleted", None), ("p", 1, "b", "0", "archived", [("c", "related", 1.0), ("c", "next", 1.0), ("x", "next", 1.0)]), ("p", 2, "c", None, None, None), ("p", 3, None, "1", None, None)],
        "persona_id string, seq long, id string, level string, status string, links array<struct<target_id:string,relation:string,weight:double>>",
    )
    got = {r["id"]: r for r in C.normalize(df).collect()}
    assert set(got) == {"b", "c"} and got["b"]["legacy"] and not got["c"]["legacy"]
    assert [(k["target_id"], k["relation"]) for k in got["b"]["links"]] == [("c", "next")]
    assert got["c"]["retention"] == 8.0 and got["c"]["card_type"] == "experience" and got["c"]["level"] == 0


def test_json_rows_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("p", 0, '{"id":"a","content":"x","created_at":"2024-01-01T00:00:00+08:00"}'), ("p", 1, "{bad")], "persona_id string, seq long, data string")
    got = C.from_json_rows(rows).collect()
    assert [r["id"] for r in got] == ["a"] and got[0]["created_at"] is not None
    C.write_jsonl(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "f"))
    C.write_jsonl(spark.createDataFrame([(2, "y")], "a int, b string"), str(tmp_path / "f"), append=True)
    (tmp_path / "f" / "bad.json").write_text("{oops\n")
    assert ids(C.read_jsonl(spark, str(tmp_path / "f"), "a int, b string"), "a") == [1, 2]


def test_bm25_follows_the_formula(spark):
    df = cards(spark, {"content": "cat dog cat"}, {"content": "dog"}, {"content": "bird dog", "keywords": ["cat"]}, {"content": "fish"}, {"content": "3.14 c++"})
    q = spark.createDataFrame([(1, "p", ["cat", "dog"]), (2, "p", ["dog"]), (3, "p", ["none"])], "query_id int, persona_id string, terms array<string>")
    got = {(r["query_id"], r["card_id"]): r["score"] for r in fts.bm25(fts.postings(df), fts.sizes(df), q).collect()}
    dl = {"c0": 3, "c1": 1, "c2": 3, "c3": 1, "c4": 3}
    avg = sum(dl.values()) / 5
    part = lambda n, tf, d: max(math.log((5 - n + 0.5) / (n + 0.5)), 1e-6 if n > 2 else -1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg))
    idf3 = math.log(2.5 / 3.5)
    assert idf3 < 0  # "dog" is in three of five cards: floored
    assert set(got) == {(1, "c0"), (1, "c2"), (2, "c0"), (2, "c1"), (2, "c2")}
    assert abs(got[1, "c0"] - part(2, 2, 3) - 1e-6 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avg))) < 1e-12
    assert ids(fts.orphans(fts.postings(df), df.filter("id <> 'c3'")), "card_id") == ["c3"]


def test_graph_from_subjects_and_keywords(spark):
    df = cards(spark, {"subject": "Ann、Bob", "keywords": ["tea / the"]}, {"subject": "ann", "keywords": ["Tea"]}, {"subject": "x"})
    led = graph.ledger(df, terms=graph.content_terms(df))
    assert {(r["card_id"], r["pos"], r["node"]) for r in led.collect()} == {("c0", 1, "ann"), ("c0", 2, "bob"), ("c0", 3, "tea"), ("c1", 1, "ann"), ("c1", 2, "tea")}
    n = {r["name"]: r["df"] for r in graph.nodes(led).collect()}
    e = {(r["a"], r["b"]): r["weight"] for r in graph.edges(led).collect()}
    assert n == {"ann": 2, "bob": 1, "tea": 2} and e == {("ann", "bob"): 1, ("ann", "tea"): 2, ("bob", "tea"): 1}
    assert all(w <= min(n[a], n[b]) for (a, b), w in e.items())


def test_summaries(spark):
    names = spark.createDataFrame([("p", "tea", 9), ("p", "the", 9), ("p", "a:b", 9), ("p", "3.5", 9), ("p", "common", 9), ("p", "few", 2)], "persona_id string, name string, df long")
    freq = spark.createDataFrame([("common", 1000)], "word string, gf long")
    had = spark.createDataFrame([("p", "common", "old", 4, 3, None, None)], "persona_id string, node_name string, content string, card_count long, new_since_write long, last_rewrite timestamp, edit_history array<struct<content:string,replaced_at:string>>")
    got = {r["name"]: r["action"] for r in graph.summary_candidates(names, had, freq).collect()}
    assert got == {"tea": "write", "the": "shell", "a:b": "shell", "3.5": "shell", "common": "reset"}
    new = spark.createDataFrame([("p", "common", "new", 9), ("p", "tea", "t", 9)], "persona_id string, node_name string, content string, card_count long")
    saved = {r["node_name"]: r for r in graph.save_summaries(had, new, NOW).collect()}
    assert saved["common"]["content"] == "new" and [h["content"] for h in saved["common"]["edit_history"]] == ["old"] and saved["tea"]["new_since_write"] == 0
    assert graph.prune_summaries(had, names.filter("name = 'tea'")).count() == 0 and graph.prune_summaries(had, names.limit(0)).count() == 1
    assert [r["passes"] for r in graph.migrate_summaries(had, freq).collect()] == [False]


def greedy(vecs, times, least):
    gone = set()
    for i in range(len(vecs)):
        for j in range(i + 1, len(vecs)):
            if i in gone:
                break
            if j not in gone and vecs[i] @ vecs[j] >= least:
                gone.add(i if times[i] <= times[j] else j)
    return gone


def test_dedup_replays_the_greedy_pass(spark):
    rng, np_rng = random.Random(1), np.random.default_rng(1)
    for odd in (False, True):
        v = np_rng.normal(size=(40, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        t = [rng.randint(0, 50) if odd else i // 2 for i in range(40)]
        rows = spark.createDataFrame([("p", i, [float(x) for x in v[i]], t[i]) for i in range(40)], "persona_id string, seq long, embedding array<double>, t long").withColumn("created_at", F.timestamp_seconds("t"))
        pairs = vector.pairs_over(rows, 0.9, part=7)
        want = {(i, j) for i in range(40) for j in range(i + 1, 40) if v[i] @ v[j] >= 0.9}
        assert {(r["seq_a"], r["seq_b"]) for r in pairs.collect()} == want
        assert set(ids(vector.superseded(rows, pairs), "seq")) == greedy(v, t, 0.9)


def test_vectors(spark):
    rows = spark.createDataFrame([("p", "a", [1.0, 0.0]), ("p", "b", [0.6, 0.8]), ("p", "z", [0.0, 0.0])], "persona_id string, card_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "p", [1.0, 0.0])], "query_id int, persona_id string, embedding array<double>")
    assert [(r["card_id"], r["sim"]) for r in vector.top_k(rows, q, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.6)]
    only = spark.createDataFrame([(1, "b"), (1, "z")], "query_id int, card_id string")
    assert [r["card_id"] for r in vector.top_k(rows, q, 1, only=only).collect()] == ["b"]
    assert rows.select(vector.normalize(F.col("embedding")).alias("n")).collect()[2]["n"] == [0.0, 0.0]
    assert abs(rows.filter("card_id = 'b'").select(vector.cosine(F.col("embedding"), F.array(F.lit(2.0), F.lit(0.0)))).first()[0] - 0.6) < 1e-12


def test_search_within_a_shared_column_is_cut_into_tiles(spark):
    v = np.random.default_rng(3).normal(size=(40, 3))
    rows = spark.createDataFrame([("p", f"{i:02}", i % 3 if i % 7 else None, [float(x) for x in v[i]]) for i in range(40)], "persona_id string, card_id string, label int, embedding array<double>")
    q = rows.select(F.col("card_id").alias("query_id"), "persona_id", "label", "embedding")
    got = {}
    for r in vector.top_k(rows, q, 4, block=3, span=5, same="label").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["card_id"])
    for i in range(40):
        near = [j for j in range(40) if i % 7 and j % 7 and j % 3 == i % 3]
        assert got.get(f"{i:02}", []) == [f"{j:02}" for j in sorted(near, key=lambda j: -round(float(v[i] @ v[j]), 9))[:4]]


def test_a_vector_goes_to_few_tiles(spark):
    n = spark.createDataFrame([(5,), (5000,), (100_000,), (600_000,)], "n long")
    assert [r[0] for r in n.select(vector.part_count(F.col("n"))).collect()] == [1, 3, 8, 37]


def test_spreading(spark):
    df = cards(spark, {"session_id": "s", "content": "tea", "created_at": None}, {"session_id": "s", "content": "x"}, {"source_time": "2024-01-01 上午", "content": "tea"}, {"retention": 0.0, "content": "y"})
    seeds = spark.createDataFrame([(1, "p", "c0", 1.0), (1, "p", "c1", 0.5), (1, "p", "c2", 0.4), (1, "p", "c3", 0.5), (2, "p", "c1", 0.01)], "query_id int, persona_id string, card_id string, sim double")
    pool = activation.energies(seeds, df, F.lit(NOW).cast("timestamp"))
    names = spark.createDataFrame([("p", "tea")], "persona_id string, name string")
    got = {(r["query_id"], r["card_id"]): r["energy"] for r in activation.spread(pool, names).collect()}
    a = np.array([[0, 0.3, 0.5], [0.3, 0, 0], [0.5, 0, 0]])
    a /= a.sum(axis=1, keepdims=True)
    e0 = np.array([1.0, 0.5, 0.4])
    e = e0 + 0.5 * a.T @ (e0 + 0.5 * a.T @ e0)
    assert {k: round(v, 9) for k, v in got.items()} == {(1, f"c{i}"): round(float(x), 9) for i, x in enumerate(e)} | {(2, "c1"): 0.01}  # a dormant weak match is left out; one card alone stays
    assert all(got[1, f"c{i}"] >= e0[i] for i in range(3))


def test_store(spark, tmp_path):
    df = cards(spark, {"content": "a", "links": [("c1", "next", 0.5), ("c2", "next", 0.1)]}, {"content": "b"}, {"content": "c", "legacy": True}, {"content": "d" * 1600})
    now = F.lit(NOW).cast("timestamp")
    one = lambda *x: spark.createDataFrame([("p", i) for i in x], "persona_id string, id string")
    good, bad = store.check_size(df)
    assert ids(bad) == ["c3"] and ids(good) == ["c0", "c1", "c2"]
    fitted = store.fit(df).filter("id = 'c3'").first()
    assert fitted["needs_review"] and len(fitted["content"].encode()) // 3 <= 500
    short = spark.createDataFrame([("p", "c3", "short")], "persona_id string, id string, text string")
    assert store.fit(df, condensed=short).filter("id = 'c3'").first()["content"] == "short"
    up = store.append(df, cards(spark, {"id": "c1", "seq": 99, "content": "B"}, {"id": "n", "seq": 100, "content": "N"}, {"id": "big", "content": "x" * 2000}))
    assert {r["id"]: (r["content"], r["seq"]) for r in up.filter("id IN ('c1', 'n', 'big')").collect()} == {"c1": ("B", 1), "n": ("N", 100)}
    patched = store.update(df, spark.createDataFrame([("p", "c0", "t", None)], "persona_id string, id string, topic string, content string"), now).filter("id = 'c0'").first()
    assert patched["topic"] == "t" and patched["content"] == "a" and str(patched["last_updated"]) == NOW
    cut = store.remove_links(df, one("c1"))
    assert {r["id"]: r["links_removed"] for r in cut.collect()} == {"c0": 1, "c1": 0, "c2": 0, "c3": 0}
    left, old = store.supersede(df, one("c1"))
    assert ids(left) == ["c0", "c2", "c3"] and ids(old) == ["c1"] and [x["target_id"] for x in left.filter("id = 'c0'").first()["links"]] == ["c2"]
    new = spark.createDataFrame([("p", "c0", "c1", "same", 0.9), ("p", "c0", "zz", "no", 1.0), ("p", "zz", "c0", "no", 1.0), ("p", "c1", "c0", "back", 1.0)], "persona_id string, from_id string, target_id string, relation string, weight double")
    linked = store.add_links(df, new)
    assert {(r["from_id"], r["target_id"], r["weight"]) for r in store.linked(linked, one("c0", "c1")).collect()} == {("c0", "c1", 0.9), ("c1", "c0", 1.0)}
    assert ids(store.linked_from(linked, one("c0"), 0.5), "from_id") == ["c1"]
    seen = {r["id"]: r["reference_count"] for r in store.reference(df, one("c0", "c2", "c0"), now).collect()}
    assert seen == {"c0": 1, "c1": 0, "c2": 0, "c3": 0}
    t = store.Table(spark, str(tmp_path / "t"))
    assert t.generation == 0 and t.load().count() == 0
    assert t.save(df) == 1 and t.save(store.remove(t.load(), one("c0"))) == 2
    t.vacuum(1)
    assert t.generation == 2 and ids(t.load()) == ["c1", "c2", "c3"]
    assert t.patch(t.load().filter("id = 'c1'").withColumns({"content": F.lit("new"), "seq": F.lit(99).cast("long")}), one("c2"), texts=False) == 3 and t.texts == 2
    seq = {r["id"]: r["seq"] for r in t.load(2).collect()}
    assert {r["id"]: (r["content"] == "new", r["seq"]) for r in t.load().collect()} == {"c1": (True, seq["c1"]), "c3": (False, seq["c3"])}
    assert t.patch(t.load(2).filter("id = 'c2'")) == 4 and ids(t.load()) == ["c1", "c2", "c3"] and ids(t.load(3)) == ["c1", "c3"] and t.texts == 4
    with pytest.raises(Exception, match="(?i)exist"):  # another writer was first
        t._point(4, "v4-other", 4)
    t.COMPACT = 3
    assert t.patch(gone=one("c3"), texts=False) == 6 and t.texts == 4 and t._parts(6)[1] == [] and ids(t.load()) == ["c1", "c2"]
    t.vacuum(1)
    assert ids(t.load()) == ["c1", "c2"]


def test_decay(spark):
    at = lambda s: __import__("datetime").datetime.fromisoformat(s)
    df = cards(spark, {"retention": 8.0, "created_at": at("2024-05-02")}, {"retention": 0.5, "created_at": at("2024-01-01")}, {"retention": -1.0, "created_at": at("2024-01-01")}, {"retention": 0.0}, {"retention": None}, {"retention": 8.0, "created_at": at("2024-07-01")}, {"retention": 8.0, "level": 1, "created_at": at("2024-01-01")})
    out = {r["id"]: r for r in maintain.decay(df, F.lit(NOW).cast("timestamp")).collect()}
    assert [out[f"c{i}"]["retention"] for i in range(7)] == [7.0, 0.0, -1.0, 0.0, None, 8.0, 8.0]
    assert [i for i in range(7) if out[f"c{i}"]["decayed"]] == [0, 1] and out["c1"]["zeroed"]
    twice = maintain.decay(maintain.decay(df, F.lit("2024-05-15 00:00:00").cast("timestamp")).drop("decayed", "zeroed"), F.lit(NOW).cast("timestamp"))
    assert abs(twice.filter("id = 'c0'").first()["retention"] - 7.0) <= 2e-4


def test_corrections(spark):
    df = cards(spark, {"content": "old", "is_portrait": True}, {"content": "she lives in Paris now"}, {"content": "lives in Paris"})
    fix = spark.createDataFrame([("p", 0, "lives in Paris", "lives in Lyon", "fact"), ("p", 1, "abc", "too short", None), ("p", 2, "nowhere to be found", "x", None), ("p", 3, "she lives in Lyon", "", None)], "persona_id string, pos int, original string, user_said string, nature string")
    out = {r["id"]: r for r in maintain.apply_corrections(df, fix, NOW).collect()}
    assert out["c1"]["content"] == "she lives in Lyon now" and [h["reason"] for h in out["c1"]["edit_history"]] == ["correction: fact"] and out["c2"]["content"] == "lives in Paris"
    events = spark.createDataFrame([(1, 0, None, "first"), (1, 1, "Ann", "Ann moved to Lyon")], "batch int, pos int, subject string, record string")
    asked = spark.createDataFrame([(1, 0, "Ann was there", "no"), (1, 1, "zzz", "y")], "batch int, pos int, original string, user_said string")
    assert {(r["correction"], r["event"]) for r in maintain.match_corrections(events, asked).collect()} == {(0, 1), (1, 0)}


def test_portrait_buffers(spark):
    day = lambda d: (f"d{d}", f"s{d}")
    df = cards(spark, {"is_portrait": True, "portrait_type": "user", "recent_buffer": [day(i) for i in range(1, 6)], "staging_pool": [day(100 + i) for i in range(9)]}, {"is_portrait": True, "portrait_type": "persona", "recent_buffer": [day(1)]})
    today = spark.createDataFrame([("p", "user", "d6", "new"), ("p", "persona", "d1", "again")], "persona_id string, portrait_type string, date string, summary string")
    out = {r["portrait_type"]: r for r in maintain.roll_buffers(df, today).collect()}
    assert [e["date"] for e in out["user"]["recent_buffer"]] == ["d2", "d3", "d4", "d5", "d6"] and out["user"]["staging_pool"][-1]["date"] == "d1" and out["user"]["due"]
    assert [(e["date"], e["summary"]) for e in out["persona"]["recent_buffer"]] == [("d1", "again")] and not out["persona"]["due"]
    text = spark.createDataFrame([("p", "user", "mid", "stable", "why")], "persona_id string, portrait_type string, new_mid string, new_stable string, reasoning string")
    done = {r["portrait_type"]: r for r in maintain.rewrite_portraits(maintain.roll_buffers(df, today).drop("due"), text, NOW).collect()}
    assert done["user"]["content"] == "stable\nmid" and done["user"]["staging_pool"] == [] and len(done["user"]["edit_history"]) == 2
    made = maintain.start_portraits(spark.createDataFrame([("p",), ("q",)], "persona_id string"), df.limit(0), F.lit(NOW).cast("timestamp"))
    assert made.count() == 6


def test_session_summary_drops_the_oldest(spark):
    e = spark.createDataFrame([("s", 1, None, "b" * 600 + "=== tail"), ("s", 2, "u", " "), ("l", 0, None, "c" * 2500)], "session_id string, pos int, topic string, record string")
    assert {r["session_id"]: r["summary"] for r in maintain.session_summary(e).collect()} == {"s": "b" * 600, "l": ""}
    before = spark.createDataFrame([("s", "old one\n---\n" + "o" * 1390), ("z", "kept")], "session_id string, summary string")
    assert {r["session_id"]: r["summary"] for r in maintain.session_summary(e, previous=before).collect()} == {"s": "o" * 1390 + "\n---\n" + "b" * 600, "l": "", "z": "kept"}


#: Sixteen memories and ten questions in other words, with near misses.
MEMORIES = {
    "coffee": "drinks black coffee every morning before work", "tea": "keeps green tea for quiet evenings", "cat": "has a grey cat called Miso", "dog": "walks the neighbour's dog on Sundays", "guitar": "plays guitar in a small band", "piano": "took piano lessons as a child",
    "hiking": "goes hiking in the Alps each summer", "job": "works as a nurse in a hospital", "allergy": "is allergic to peanuts", "sister": "has a younger sister in Lyon", "movie": "loves old science fiction movies", "travel": "plans to travel to Japan in spring",
    "cooking": "is learning to cook Thai curry", "fitness": "runs five kilometres before breakfast", "book": "reads crime novels at night", "weather": "dislikes hot humid weather",
}
ASKED = [("which coffee in the morning", "coffee"), ("green tea or not", "tea"), ("what is the name of the cat", "cat"), ("guitar with a band", "guitar"), ("summer hiking plans", "hiking"), ("nurse at which hospital", "job"), ("peanuts and food", "allergy"), ("sister lives where", "sister"), ("travel to Japan", "travel"), ("curry recipes", "cooking")]


def test_retrieval_quality(spark):
    df = cards(spark, *[{"id": k, "content": v, "subject": "U"} for k, v in MEMORIES.items()])
    q = spark.createDataFrame([(i, "p", t) for i, (t, _) in enumerate(ASKED)], "query_id int, persona_id string, text string")
    none = spark.createDataFrame([], "persona_id string, node_name string, content string")
    led = graph.ledger(df)
    freq = spark.createDataFrame([], "word string, gf long")
    got = region.region(q, df, none, graph.adjacency(graph.edges(led)), graph.nodes(led), graph.corpus_size(led), freq)
    ranks = {(r["query_id"], r["card_id"]): r["rank"] for r in got.collect()}
    rows = spark.createDataFrame([(t, ranks.get((i, k), 0)) for i, (t, k) in enumerate(ASKED)], "query string, rank int")
    m = maintain.retrieval_metrics(rows).first()
    assert m["hit_3"] >= 0.8 and m["queries"] == 10


def test_region_budget_and_prompt(spark):
    df = cards(spark, {"content": "Miso sleeps", "needs_review": True, "annotations": ["grey", ""]}, {"content": "Miso eats"}, {"content": "Miso plays"}, {"content": "Miso runs"}, {"content": "Miso", "legacy": True}, {"content": "Miso portrait", "is_portrait": True})
    s = spark.createDataFrame([("p", "miso", "a cat")], "persona_id string, node_name string, content string")
    q = spark.createDataFrame([(1, "p", "and Miso?"), (2, "p", "?!")], "query_id int, persona_id string, text string")
    led = graph.ledger(df)
    g = (graph.adjacency(graph.edges(led)), graph.nodes(led), graph.corpus_size(led), spark.createDataFrame([], "word string, gf long"))
    got = region.region(q, df, s, *g).orderBy("rank").collect()
    assert [(r["query_id"], r["source"]) for r in got] == [(1, "summary"), (1, "fts"), (1, "fts"), (1, "fts")] and got[0]["content"] == "[miso] a cat"
    shown = spark.createDataFrame([(1, "summary_miso"), (1, "c0")], "query_id int, card_id string")
    again = region.region(q, df, s, *g, excluded=shown).collect()
    assert len(again) == 3 and "c0" not in {r["card_id"] for r in again}
    text = region.prompt(region.region(q, df, s, *g), df, F.lit(NOW).cast("timestamp")).first()
    assert text["prompt_text"].startswith("[miso] a cat\n- ") and (region.REVIEW_NOTE in text["prompt_text"]) == ("c0" in text["card_ids"])


def test_feature_log(spark, tmp_path):
    log = FeatureLog(str(tmp_path / "log.jsonl"), size=2, most=200, keep=2)
    new_trace_id()
    for i in range(8):
        log.add("m" if i % 2 else "n", "e", i=i)
    assert len(log.recent) == 2 and [r["module"] for r in log.tail(module="m")] == ["m"]
    assert len(list(tmp_path.glob("log*.jsonl"))) <= 3 and read_log(spark, str(tmp_path / "log.jsonl")).count() >= 1


def test_many_questions_meet_only_the_postings_of_their_rarest_term(spark, tmp_path):
    rng = random.Random(4)
    cards = C.conform(spark.createDataFrame([(f"p{i % 2}", f"c{i}", i, " ".join(["all", *rng.choices("abcdefgh", k=rng.randint(1, 6))])) for i in range(60)], "persona_id string, id string, seq long, content string"))
    fts.postings(cards).write.parquet(str(tmp_path / "postings"))
    index, corpus = spark.read.parquet(str(tmp_path / "postings")), fts.sizes(cards)
    wants = [(p, sorted(t)) for p in ("p0", "p1") for t in (["all", "a"], ["a", "b"], ["all"], ["c", "d", "all"], ["all", "nowhere"])]
    asked = spark.createDataFrame(wants, "persona_id string, terms array<string>")
    got = {(r["persona_id"], tuple(r["terms"]), r["card_id"]): round(r["score"], 9) for r in fts.bm25_of_many(index, corpus, asked).collect()}
    plain = fts.bm25(index, corpus, spark.createDataFrame([(i, *w) for i, w in enumerate(wants)], "query_id int, persona_id string, terms array<string>"))
    assert got == {(r["persona_id"], tuple(wants[r["query_id"]][1]), r["card_id"]): round(r["score"], 9) for r in plain.collect()} and got
