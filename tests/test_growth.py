"""What keeps time and disk in bounds as the cards grow, against the plain way."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import asked, fts, graph, segments
from mnemoframe.operators.index import CLEAN_UP, Index
from mnemoframe.operators.segments import Segments
from mnemoframe.operators.store import Table
from mnemoframe.plans import catalog
from mnemoframe.sources.cards import conform


def made(spark, n, seed=1, cut=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(rng.choice("pqr"), f"c{i:03}", i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, cut)))) for i in range(n)]
    return conform(spark.createDataFrame(rows, "persona_id string, id string, seq long, content string").withColumn("created_at", F.timestamp_seconds(F.col("seq") * 3600)))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_a_large_change_makes_only_the_tables_that_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FEW", 3)
    cards = made(spark, 80)
    table = Table(spark, str(tmp_path / "cards"))
    table.save(cards.filter("seq < 50"))
    index = Segments(spark, table).refresh()
    table.patch(cards.filter("seq >= 50"))
    table.patch(cards.filter("seq < 9").withColumn("content", F.concat("content", F.lit(" w1 zebra"))), cards.filter("seq % 10 = 9").select("persona_id", "id"))
    assert rows(index.postings, "persona_id", "card_id", "term", "tf", "dl") == rows(fts.postings(table.load()), "persona_id", "card_id", "term", "tf", "dl")
    for folder in index.state()[2]:
        assert {n for n in os.listdir(f"{index.path}/{folder}") if n[0] not in "._"} <= {"cards", "touched", "before", "postings"}
    assert not os.path.exists(f"{index.path}/idf")
    # the weights are those of the cards that were there first, whenever they are asked for
    led = graph.ledger(table.load(), graph.content_terms(table.load(), idf=graph.idf_table(cards.filter("seq < 50")).localCheckpoint()))
    assert rows(index.edges, "persona_id", "a", "b", "weight") == rows(graph.edges(led), "persona_id", "a", "b", "weight")
    assert rows(index.nodes, "persona_id", "name", "df") == rows(graph.nodes(led), "persona_id", "name", "df")
    assert rows(index.size, "persona_id", "n") == rows(graph.corpus_size(led), "persona_id", "n")


def test_folding_makes_what_wasnt_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FEW", 0)
    monkeypatch.setattr(segments, "FOLD", 1)
    cards = made(spark, 40)
    table = Table(spark, str(tmp_path / "cards"))
    table.save(cards.filter("seq < 35"))
    index = Segments(spark, table).refresh()
    table.patch(cards.filter("seq >= 33").withColumn("content", F.lit("w1 w2 zebra")))
    index.refresh().vacuum()
    led = graph.ledger(table.load(), graph.content_terms(table.load(), idf=index.idf))
    assert rows(index.edges, "persona_id", "a", "b", "weight") == rows(graph.edges(led), "persona_id", "a", "b", "weight")


@pytest.mark.parametrize("known", [0, 5, 1000])
def test_terms_left_out_early_are_none_of_the_heaviest(spark, monkeypatch, known):
    cards = made(spark, 120, cut=120).localCheckpoint()
    idf = graph.idf_table(cards.filter("seq < 60")).localCheckpoint()
    plain = {}
    for n in (100, known):  # all terms are known to the tasks, or some, or none
        monkeypatch.setattr(graph, "KNOWN", max(n, 1))
        plain[n] = rows(graph.content_terms(cards, idf=idf), "card_id", "term", "rank")
    everything = graph.topic_counts(cards).join(idf, "term", "left").withColumn("_o", F.lit(idf.filter("term IS NULL").first()["idf"]))
    every = {(r["card_id"], r["term"]): round(r["tf"] * (r["_o"] if r["idf"] is None else r["idf"]), 6) for r in everything.collect()}
    best = {}
    for (card, term), weight in every.items():
        best.setdefault(card, []).append((-weight, term))
    assert plain[100] == plain[known] == sorted(((c, t, i + 1) for c, x in best.items() for i, (_, t) in enumerate(sorted(x)[:12])), key=repr)
    dfs = graph.term_cards(cards).localCheckpoint()
    assert rows(graph.content_terms(cards, dfs=dfs), "persona_id", "card_id", "term", "rank") == rows(graph.content_terms(cards), "persona_id", "card_id", "term", "rank")


def test_light_terms_arent_shuffled(spark, monkeypatch):
    seen = []
    plain = graph.term_counts
    monkeypatch.setattr(graph, "term_counts", lambda *a: seen.append((plain(*a[:3]), plain(*a))) or seen[-1][1])
    cards = made(spark, 60, cut=200)
    dfs = graph.term_cards(cards).localCheckpoint()
    seen.clear()
    graph.content_terms(cards, dfs=dfs)
    every, some = seen[-1]
    assert some.count() < 0.6 * every.count()


def test_an_index_leaves_no_shuffle_files(spark, tmp_path):
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",").count("shuffle_")
    index = Index(spark, str(tmp_path / "x"), lambda: made(spark, 60))
    before, was = blocks(), spark.conf.get(CLEAN_UP, "false")
    assert index.edges.count() and index.postings.count()
    index._table("again", lambda: index.edges.repartition(3, "a"))
    assert spark.conf.get(CLEAN_UP, "false") == was
    shuffled = blocks() - before
    fresh = Index(spark, str(tmp_path / "y"), lambda: made(spark, 60))
    count = blocks()
    fresh.postings  # written where it is made
    fresh._table("dealt", lambda: fresh.postings.repartition(3, "term"))
    assert blocks() <= count, shuffled  # others may go meanwhile


def test_best_of_many_equals_all_hits_ranked(spark, monkeypatch):
    monkeypatch.setattr(fts, "PART", 7)
    monkeypatch.setattr(fts, "BLOCK", 5)
    cards = made(spark, 90).localCheckpoint()
    index, corpus = fts.postings(cards).localCheckpoint(), fts.sizes(cards).localCheckpoint()
    rng = random.Random(3)
    wants = {(p, tuple(rng.sample([f"w{i}" for i in range(40)] + ["none"], rng.randint(1, 3)))) for p in "pqrs" for _ in range(25)}
    questions = spark.createDataFrame([(p, list(t)) for p, t in wants], "persona_id string, terms array<string>")
    hits = fts.ranked(fts.bm25_of_many(index, corpus, questions), 4, by=("persona_id", "terms"))
    want = {(r["persona_id"], tuple(r["terms"]), r["rank"]): (r["card_id"], round(r["score"], 9)) for r in hits.collect()}
    for buckets in (1, 1 << 21):
        monkeypatch.setattr(asked, "BUCKETS", buckets)
        got = {(r["persona_id"], tuple(r["terms"]), r["rank"]): (r["card_id"], round(r["score"], 9)) for r in fts.best_of_many(index, corpus, questions, 4).collect()}
        assert got == want and got


def test_a_question_shuffles_only_postings_that_may_hit(spark, tmp_path):
    fts.postings(made(spark, 90)).write.parquet(str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    terms = spark.createDataFrame([("p", "w1"), ("q", "w2")], "persona_id string, term string")
    some, exact = asked.asked_for(index, terms, ["persona_id", "term"]), index.join(terms, ["persona_id", "term"])
    assert exact.count() <= some.count() < 0.5 * index.count() and some.columns == index.columns
    assert rows(some.join(terms, ["persona_id", "term"]), "card_id", "term") == rows(exact, "card_id", "term")
    query = terms.select(F.col("term").alias("query_id"), "persona_id", F.array("term").alias("terms"))
    assert "_asked" in fts.bm25(index, fts.sizes(made(spark, 90)), query)._jdf.queryExecution().optimizedPlan().toString()


def test_index_cards_are_the_cards_without_their_labels(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i}", "en", "s0", 2) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cards = catalog._index_cards(spark, str(tmp_path))
    assert rows(cards, "id", "persona_id", "content", "created_at") == rows(catalog._cards(spark, str(tmp_path)), "id", "persona_id", "content", "created_at")
    assert "BroadcastHashJoin" in cards._jdf.queryExecution().executedPlan().toString()
