import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import fts, graph, segments
from mnemoframe.operators.segments import Segments
from mnemoframe.operators.store import Table
from mnemoframe.sources.cards import CARD, conform, searchable

NOW = "2024-06-01 00:00:00"


def made(spark, rng, ids, **more):
    words = ["tea", "cat", "lyon", "paris", "work", "train", "piano", "river", "garden", "winter"]
    rows = [(rng.choice(["p", "q"]) if i % 7 else "p", f"c{i}", i, " ".join(rng.choices(words, range(10, 0, -1), k=rng.randint(0, 12))), rng.choice([None, "Ann, Bob", "Tea"]), i % 9 == 0) for i in ids]
    df = spark.createDataFrame(rows, "persona_id string, id string, seq long, content string, subject string, is_portrait boolean")
    return conform(df.withColumn("created_at", F.timestamp_seconds(F.col("seq") * 3600)))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same_as_rebuilt(index, table):
    cards, idf = table.load(), index.idf
    plain = cards.filter("NOT coalesce(is_portrait, false)")
    led = graph.ledger(plain, graph.content_terms(plain, idf=idf))
    assert rows(index.postings, "persona_id", "card_id", "term", "tf", "dl") == rows(fts.postings(cards), "persona_id", "card_id", "term", "tf", "dl")
    assert rows(index.ledger, "persona_id", "card_id", "pos", "node", "when") == rows(led, "persona_id", "card_id", "pos", "node", "when")
    assert rows(index.nodes, "persona_id", "name", "df") == rows(graph.nodes(led), "persona_id", "name", "df")
    assert rows(index.edges, "persona_id", "a", "b", "weight") == rows(graph.edges(led), "persona_id", "a", "b", "weight")
    assert rows(index.size, "persona_id", "n") == rows(graph.corpus_size(led), "persona_id", "n")
    assert [(p, n, round(a, 9)) for p, n, a in rows(index.sizes, "persona_id", "n", "avgdl")] == [(p, n, round(a, 9)) for p, n, a in rows(fts.sizes(cards), "persona_id", "n", "avgdl")]


@pytest.mark.parametrize("fold", [2])
def test_segments_equal_a_rebuilt_index(spark, tmp_path, monkeypatch, fold):
    monkeypatch.setattr(segments, "FOLD", fold)
    rng = random.Random(1)
    table = Table(spark, str(tmp_path / "cards"))
    table.save(made(spark, rng, range(40)))
    index = Segments(spark, table, encode=lambda texts: [[float(len(t)), 1.0] for t in texts]).refresh()
    before = index.state()[2]
    table.patch(made(spark, rng, range(40, 42)))  # new cards
    table.patch(made(spark, rng, [3, 4, 50]).withColumn("persona_id", F.lit("p")))  # changed and new ones
    table.patch(None, table.load().filter("seq % 10 = 5").select("persona_id", "id"))  # removed ones
    table.patch(table.load().filter("seq = 8").withColumn("reference_count", F.lit(3)), texts=False)
    index.refresh()
    assert index.state()[2] != before and len(index.state()[2]) <= 3
    same_as_rebuilt(index, table)
    live = searchable(table.load())
    assert rows(index.vectors, "persona_id", "card_id") == rows(live, "persona_id", F.col("id").alias("card_id"))
    index.vacuum()
    assert rows(Segments(spark, table).nodes, "persona_id", "name", "df") == rows(index.nodes, "persona_id", "name", "df")


def test_one_card_makes_a_segment_of_its_own_rows(spark, tmp_path):
    rng = random.Random(2)
    table = Table(spark, str(tmp_path / "cards"))
    table.save(made(spark, rng, range(200)))
    index = Segments(spark, table).refresh()
    old = index.state()[2]
    last = index.nodes.agg(F.max("last_seen")).first()[0]
    table.patch(made(spark, rng, [901]).withColumn("content", F.lit("tea with the cat")))
    new = [f for f in index.refresh().state()[2] if f not in old]
    assert len(new) == 1
    read = lambda name: spark.read.parquet(f"{index.path}/{new[0]}/{name}")
    assert {r["card_id"] for r in read("postings").collect()} == {r["card_id"] for r in read("ledger").collect()} == {"c901"}
    assert all(r["df"] == 1 for r in read("nodes").collect()) and read("cards").count() == 1
    assert index.nodes.filter("name = 'cat'").agg(F.max("last_seen")).first()[0] > last
    assert rows(index.recorded(spark.createDataFrame([("p", "c901")], "persona_id string, card_id string")), "node") == rows(read("ledger").filter("persona_id = 'p'"), "node")


def test_words_that_come_later_count_as_rarest(spark):
    cards = conform(spark.createDataFrame([("p", "a", 0, "tea tea cat"), ("p", "b", 1, "tea")], "persona_id string, id string, seq long, content string"))
    idf = graph.idf_table(cards)
    later = conform(spark.createDataFrame([("p", "c", 2, "tea zebra")], "persona_id string, id string, seq long, content string"))
    assert [r["term"] for r in graph.content_terms(later, idf=idf).orderBy("rank").collect()] == ["zebra", "tea"]


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    index = Segments(spark, Table(spark, str(tmp_path / "cards"), CARD))
    assert index.postings.count() == index.nodes.count() == index.frequency.count() == index.size.count() == 0
