"""The pipeline against a brute-force version of its stages."""

import re
from collections import Counter

from pyspark.sql import functions as F

from mnemoframe.llm import mixing, sharding

import corpus_pipeline


def test_pipeline_keeps_what_the_stages_keep(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    words = docs.filter("doc_id = 135").first()["text"].split()
    spark.createDataFrame([(1, " ".join(words[50:70]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = [r for r in docs.collect() if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r["text"].encode().lower().split() for r in rows)]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and up[i] != up[j]:
                up = [up[j] if x == up[i] else x for x in up]
    first = {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1]["doc_id"] is None, x[1]["doc_id"])):
        first.setdefault(up[i], r)
    phrase = " ".join(words[50:60])
    kept = [r for r in first.values() if phrase not in r["text"] and r["doc_id"] != 135]
    plan = mixing.plan(spark.createDataFrame(kept, docs.schema)).collect()
    assert Counter(r["doc_id"] for r in got.collect()) == +Counter({r["doc_id"]: r["copies"] for r in plan})
    assert all(r["lang"] for r in got.collect())
    load = Counter()
    for r in got.collect():
        assert r["size"] == len(r["text"].encode()) + 1 and re.search(r"\w", r["text"])
        load[r["shard"]] += r["size"]
    assert set(load) <= set(range(16)) and got.columns == [*docs.columns, "size", "shard"]
    assert len({(r["text"], r["shard"]) for r in got.collect()}) == len({r["text"] for r in got.collect()})
    assert sharding.assign(got.limit(0)).count() == 0


def test_documents_without_any_language_and_empty_tables(spark, docs, nothing, tmp_path):
    plain = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("shard", F.lit("mine"))
    kept = corpus_pipeline.language_id(spark, plain, str(tmp_path))
    want = [r for r in plain.collect() if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in want) and kept.columns == plain.columns
    for _, stage in corpus_pipeline.STAGES:
        if stage is not corpus_pipeline.decontamination:
            assert stage(spark, nothing, str(tmp_path)).count() == 0
    assert corpus_pipeline.shards(spark, plain.filter("doc_id < 5"), str(tmp_path)).schema["shard"].dataType.simpleString() == "int"
