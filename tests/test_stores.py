"""Folders of card stores: cards and persona files out and in."""

import json
import os
import sqlite3
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoframe.plans.engine import MemoryEngine
from mnemoframe.sources import cards as C
from mnemoframe.sources import stores


@pytest.fixture
def base(tmp_path):
    """Three personas, one without cards and one with a log beside its store, and folders that are none."""
    for name, n in (("ann", 7), ("Zoë b", 3), ("_old", 1), ("exports", 1)):
        folder = tmp_path / "base" / name
        folder.mkdir(parents=True)
        con = sqlite3.connect(folder / "cards.db")
        con.execute("CREATE TABLE cards (id TEXT PRIMARY KEY, data TEXT NOT NULL)")
        for i in range(n):
            state = {"status": "deleted"} if i == 2 else {"status": "legacy"} if i == 3 else {}
            con.execute("INSERT INTO cards VALUES (?, ?)", (f"{name}{i}", json.dumps({"id": f"{name}{i}", "content": f"text {i} 😀", "level": "m1"} | state)))
        con.execute("INSERT INTO cards VALUES ('bad', '{oops')")
        con.execute("INSERT INTO cards VALUES ('raw', ?)", (b'{"id": "raw", "content": "\xff"}',))
        con.commit()
        con.close()
    (tmp_path / "base" / "empty").mkdir()
    (tmp_path / "base" / "empty" / "persona_meta.json").write_text("{not json")
    return str(tmp_path / "base")


def read(spark, base, **options):
    stores.register(spark)
    return spark.read.format(stores.FORMAT).options(**options).load(base)


def test_scan_equals_rows_of_json(spark, base):
    got = read(spark, base)
    assert sorted((r["persona_id"], r["id"]) for r in got.collect()) == sorted([(p, f"{p}{i}") for p, n in (("ann", 7), ("Zoë b", 3)) for i in range(n)] + [(p, x) for p in ("ann", "Zoë b") for x in ("bad", "raw")])
    cards = {(r["persona_id"], r["id"]): r for r in stores.read_cards(spark, base).collect()}
    plain = [(p, i, json.dumps({"id": f"{p}{i}", "content": f"text {i} 😀", "level": "m1"} | ({"status": "legacy"} if i == 3 else {}))) for p, n in (("ann", 7), ("Zoë b", 3)) for i in range(n) if i != 2]
    want = {(r["persona_id"], r["id"]): r for r in C.from_json_rows(spark.createDataFrame(plain, "persona_id string, seq long, data string")).collect()}
    same = [c for c in C.CARD.names if c != "seq"]
    assert set(cards) == set(want) | {("ann", "raw"), ("Zoë b", "raw")}
    assert all([cards[k][c] for c in same] == [want[k][c] for c in same] for k in want)
    assert cards["ann", "raw"]["content"] == "�"


def test_ranges_of_a_store_hold_each_row_once(spark, base):
    whole = sorted(map(tuple, read(spark, base).collect()))
    cut = read(spark, base, splitBytes="1000")
    assert cut.rdd.getNumPartitions() > 4 and sorted(map(tuple, cut.collect())) == whole


def test_filters_and_columns_reach_the_stores(spark, base):
    df = read(spark, base)
    assert [r["id"] for r in df.filter("persona_id = 'ann' AND id = 'ann4'").collect()] == ["ann4"]
    assert sorted(r["id"] for r in df.filter(F.col("id").isin("ann1", "Zoë b0", "none")).collect()) == ["Zoë b0", "ann1"]
    assert df.filter("persona_id = 'ann' AND persona_id = 'Zoë b'").count() == 0
    assert df.filter("id = 'raw' AND data LIKE '%raw%'").count() == 2
    assert df.filter("NOT persona_id = 'ann'").count() == 5 and df.count() == 14
    # an unreadable store of another persona isn't opened
    torn = Path(base, "torn")
    torn.mkdir()
    (torn / "cards.db").write_bytes(b"this is no database" * 100)
    assert read(spark, base).filter("persona_id = 'ann'").count() == 9
    with pytest.raises(Exception, match="not a database"):
        read(spark, base).collect()
    stores.register(spark)
    assert spark.read.format(stores.FORMAT).schema("id string").load(base).filter("id = 'ann4'").columns == ["id"]


def test_a_store_that_is_being_written(spark, base):
    con = sqlite3.connect(f"{base}/ann/cards.db")
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("INSERT INTO cards VALUES ('new', '{}')")
    con.commit()
    assert read(spark, base).filter("id = 'new'").count() == 1
    con.close()


def test_only_stores_written_since(spark, base):
    os.utime(f"{base}/ann/cards.db", (1_700_000_000, 1_700_000_000))
    os.utime(f"{base}/Zoë b/cards.db", (1_800_000_000, 1_800_000_000))
    found = lambda t: {r["persona_id"] for r in read(spark, base, modifiedSince=t).collect()}
    assert found("2023-11-14T22:13:20") == {"ann", "Zoë b"} and found("2023-11-14T22:13:21+00:00") == {"Zoë b"} and found("2030-01-01") == set()
    assert {r["persona_id"] for r in stores.read_cards(spark, base, "2024-01-01").collect()} == {"Zoë b"}
    old = Path(base, "Zoë b", "cards-1.db")  # a persona's other store is read along, since links may lead there
    con = sqlite3.connect(old)
    con.execute("CREATE TABLE cards (id TEXT PRIMARY KEY, data TEXT NOT NULL)")
    con.execute("INSERT INTO cards VALUES ('other', '{}')")
    con.commit()
    con.close()
    os.utime(old, (1_700_000_000, 1_700_000_000))
    assert "other" in {r["id"] for r in read(spark, base, modifiedSince="2024-01-01").collect()}


def test_write_and_read_again(spark, tmp_path):
    base = str(tmp_path / "out")
    stores.register(spark)
    rows = [(f"p{i % 3}" if i % 2 else "hot", f"c{i}", "x" * i) for i in range(300)]
    df = spark.createDataFrame(rows, "persona_id string, id string, data string").withColumn("seq", F.lit("clash"))
    write = lambda df, mode: df.repartition(3).write.format(stores.FORMAT).mode(mode).save(base)
    write(df, "append")
    back = lambda: sorted(map(tuple, read(spark, base).select("persona_id", "id", "data").collect()))
    assert back() == sorted(rows)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    write(df.filter("id = 'c1'"), "overwrite")
    assert back() == [("p1", "c1", "x")]
    write(df.limit(0), "overwrite")
    assert back() == []
    for bad in ((None, "a", ""), ("_p", "a", ""), ("a/b", "a", ""), ("p", None, "")):
        with pytest.raises(Exception, match="can't be stored"):
            write(spark.createDataFrame([bad], "persona_id string, id string, data string"), "append")
    assert back() == [] and not list((tmp_path / "out").glob("_drafts*/*/*"))


def test_more_personas_than_a_task_holds_open(spark, tmp_path):
    rows = [(f"p{i % 90}", f"c{i}", "") for i in range(400)]
    stores.register(spark)
    spark.createDataFrame(rows, "persona_id string, id string, data string").coalesce(1).write.format(stores.FORMAT).mode("append").save(str(tmp_path / "out"))
    assert read(spark, str(tmp_path / "out")).count() == 400


def test_personas_with_profiles_and_rules(spark, base, tmp_path):
    rows = [("ann", "Ann", "Bo", None, '["big", "small"]', None, None, True), ("Zoë b", None, None, "u1", None, "cloud", "m9", None)]
    df = spark.createDataFrame(rows, "persona_id string, display_name string, user_display_name string, user_id string, profile string, provider string, model string, proactive boolean")
    stores.write_personas(df, base)
    meta = json.loads(open(f"{base}/ann/persona_meta.json").read())
    meta["profile"] = ["big", "small"]
    open(f"{base}/ann/persona_meta.json", "w").write(json.dumps(meta))
    (tmp_path / "profiles").mkdir()
    for name, text in (("a.yml", "name: big\nprovider: p1\nmodel: old"), ("b.yml", "name: big\nprovider: p1\nmodel: new"), ("small.yml", "provider: p2"), ("c.yml", "name: none"), ("d.yml", "a: [")):
        (tmp_path / "profiles" / name).write_text(text)
    profiles = stores.read_profiles(spark, str(tmp_path / "profiles"))
    assert sorted(map(tuple, profiles.collect())) == [("big", "p1", "new"), ("small", "p2", None)]
    got = {r["persona_id"]: r for r in stores.read_personas(spark, base, profiles).collect()}
    assert set(got) == {"ann", "Zoë b", "empty"}
    pick = lambda p: [got[p][c] for c in ("display_name", "user_display_name", "user_id", "provider", "model", "proactive", "inner_active", "visibility_default")]
    assert pick("ann") == ["Ann", "Bo", "default", "p1", "new", True, False, "visible"]
    assert pick("Zoë b") == ["Zoë b", "", None, "cloud", "m9", False, False, "visible"]
    assert pick("empty") == ["empty", "", None, "local", "", False, False, "visible"]


def test_the_engine_adopts_stores(spark, base, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "engine"))
    e.adopt(base)
    assert e.get("ann", "ann3")["legacy"] and e.get("ann", "ann2") is None and e.get("Zoë b", "Zoë b1")["content"] == "text 1 😀"
    assert {r["persona_name"] for r in e.names().collect()} == {"ann", "Zoë b", "empty"}


def test_a_writer_holds_few_rows_of_a_large_batch(spark, tmp_path):
    n, base = 6000, str(tmp_path / "large")
    cards = {"persona_id": [f"p{i % 3}" for i in range(n)], "id": [f"c{i}" for i in range(n)], "data": [f"{i:5000}" for i in range(n)]}
    batch = pa.record_batch(cards)
    del cards
    writer = stores.StoreWriter({"path": base}, spark.createDataFrame([], "persona_id string, id string, data string").schema, False)
    tracemalloc.start()
    try:
        drafts = writer.write(iter([batch]))
        assert tracemalloc.get_traced_memory()[1] < 10_000_000  # of 30 MB
    finally:
        tracemalloc.stop()
    writer.commit([drafts])
    got = read(spark, base)
    assert got.count() == n == got.selectExpr("int(trim(data)) AS i").distinct().count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= stores.BATCH
