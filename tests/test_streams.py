import random
from collections import Counter

from pyspark.sql import functions as F

from mnemoframe.streaming import incremental


def test_due_summaries_agree_with_a_batch_across_restarts(spark, tmp_path):
    rng = random.Random(7)
    rows = [("p", rng.choice("abc"), f"c{i}") for i in range(40)] + [("q", "a", f"d{i}") for i in range(7)]
    rng.shuffle(rows)
    schema = "persona_id string, node string, card_id string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        incremental.summaries_due(stream).writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()

    put = lambda part: spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    put(rows[:20])
    run()
    put(rows[20:])
    run()  # goes on from the checkpoint
    got = {(r["persona_id"], r["node"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("persona_id", "node").agg(F.sum("times").alias("n")).collect()}
    assert got == {k: n // 3 for k, n in Counter((p, n) for p, n, _ in rows).items() if n >= 3}


def test_sliding_error_windows_agree_with_a_batch(spark, tmp_path):
    rng = random.Random(8)
    at = [rng.randint(0, 3600) for _ in range(80)]
    rows = [(t, rng.choice(["error", "view"])) for t in at]
    df = spark.createDataFrame(rows, "t long, event_type string").select(F.timestamp_seconds("t").alias("ts"), "event_type")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = incremental.errors_per_window(stream, late="2 hours", slide=60)
    counts.writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode("complete").format("memory").queryName("sliding_errors").trigger(availableNow=True).start().awaitTermination()
    got = {int(r["s"]): r["errors"] for r in spark.table("sliding_errors").select(F.unix_seconds("window_start").alias("s"), "errors").collect()}
    errors = [t for t, kind in rows if kind == "error"]
    want = {s: sum(s <= t < s + 300 for t in errors) for s in range(-300, 3660, 60)}
    assert got == {s: n for s, n in want.items() if n}
