"""What an index costs: texts are read once, and only the tables that are asked for are made."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import text
from mnemoframe.operators import activation, graph
from mnemoframe.operators.index import Index
from mnemoframe.operators.segments import Segments
from mnemoframe.operators.store import Table
from mnemoframe.plans import catalog
from mnemoframe.sources.cards import conform


def made(spark, n=30):
    rng = random.Random(4)
    rows = [("p" if i % 3 else "q", f"c{i}", i, " ".join(rng.choices(["tea", "cat", "lyon", "paris", "work"], k=rng.randint(0, 9)))) for i in range(n)]
    return conform(spark.createDataFrame(rows, "persona_id string, id string, seq long, content string").withColumn("created_at", F.timestamp_seconds("seq")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString().replace("regexp_extract_all", "")


@pytest.mark.parametrize("at_once", [3, 1 << 19])
def test_terms_are_counted_over_any_number_of_rows_at_a_time(spark, monkeypatch, at_once):
    monkeypatch.setattr(text, "AT_ONCE", at_once)
    rng = random.Random(2)
    rows = [(i, [rng.choice(["a", "b", "é", "Z"]) for _ in range(rng.randint(0, 7))] if i % 5 else None) for i in range(40)]
    got = text.term_counts(spark.createDataFrame(rows, "i int, w array<string>").repartition(2), F.col("w"), ["i"]).collect()
    assert sorted((r["i"], r["term"], r["tf"], r["dl"]) for r in got) == sorted((i, t, n, len(w)) for i, w in rows for t, n in Counter(w or []).items())
    assert text.term_counts(spark.createDataFrame([], "i int, w array<string>"), F.col("w"), ["i"]).collect() == []


def test_content_terms_read_the_texts_once(spark):
    assert plan(graph.content_terms(made(spark))).count("regexp_extract_all") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_a_graph_query_makes_only_its_tables(spark, tmp_path, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setitem(catalog._INDEXES, (spark.sparkContext.applicationId, d), Index(spark, str(tmp_path), lambda: catalog._cards(spark, d)))
    assert catalog.QUERIES["graph_top_nodes"](spark, d).count()
    assert sorted(f.name for f in tmp_path.iterdir()) == ["ledger", "nodes"]



def test_keys_of_changed_cards_are_broadcast_whatever_spark_expects(spark, tmp_path):
    table = Table(spark, str(tmp_path / "cards"))
    table.save(made(spark))
    index = Segments(spark, table).refresh()
    table.patch(made(spark).filter("seq % 5 = 0"))
    index.refresh()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(index.postings)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_the_texts_of_asked_personas_are_cut_into_tokens(spark):
    q = spark.createDataFrame([(1, "p", "tea cat"), (2, "p", "work")], "query_id int, persona_id string, text string")
    hits = activation.keyword_fallback(made(spark), q, 3)
    assert "LeftSemi" in plan(hits)
    assert {r["persona_id"] for r in hits.collect()} == {"p"}
