"""Mixing, exact dedup, sharding and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import decontaminate, exact, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_are_the_fixed_point_of_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 0, None: 300}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, fixed, left = {}, set(), sum(sizes.values())
    while True:
        total = sum(w[s] for s in order if s not in fixed)
        level = left / total if total else 0
        new = {s for s in order if s not in fixed and w[s] * level > 3 * sizes[s]}
        if not new:
            break
        for s in new:
            target[s] = 3 * sizes[s]
            left -= target[s]
        fixed |= new
    target |= {s: w[s] * level for s in order if s not in fixed}
    assert all(abs(got[s] - target[s]) < 1e-6 for s in order)


def test_mix_plan_and_copies_agree(docs, nothing):
    plan = mixing.plan(docs).collect()
    assert len(plan) == docs.count()
    for r in plan:
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 3
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixing.mix(docs.withColumn("rate", F.lit(1)).withColumn("size", F.lit("x"))).collect())
    assert got == +want
    taken = mixing.mix(docs.withColumns({c: F.lit(c) for c in ("_src", "_rate", "_n", "_copy", "row", "col")}))
    assert taken.columns == [*docs.columns, "_src", "_rate", "_n", "_copy", "row", "col"] and taken.filter("_src <> '_src' OR _rate <> '_rate' OR _n <> '_n' OR _copy <> '_copy' OR row <> 'row' OR col <> 'col'").count() == 0
    assert Counter(r["doc_id"] for r in taken.collect()) == +want
    assert sorted(map(tuple, mixing.plan(docs).collect()), key=str) == sorted(map(tuple, plan), key=str)
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_exact_dedup(docs, nothing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    ids, n = defaultdict(list), Counter(t for _, t in rows)
    for d, t in rows:
        if d is not None:
            ids[t].append(d)
    got = exact.dedup(docs.withColumn("kept", F.lit(1)).withColumn("recipe", F.lit("x"))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted((d is None, d, min(ids[t]), n[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert sum(r["kept"] for r in got) == len(n)
    assert exact.dedup(nothing).count() == 0


def test_chunks_join_to_the_text_and_resynchronise(spark):
    import random

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("adehilno") for _ in range(5)) + ("." if rng.random() < 0.2 else "") for _ in range(3000))
    a, b = spark.createDataFrame([(text,), ("new start " + text,)], "t string").select(exact.chunks(F.col("t")).alias("c")).collect()
    assert "".join(a["c"]) == text and len(a["c"]) > 5 and max(map(len, a["c"])) <= 4096
    assert len(set(a["c"]) & set(b["c"])) >= len(a["c"]) - 3
    for letters in (range(0x4E00, 0x4E00 + 600), range(0x430, 0x450), range(0x61, 0x7B), range(0x30, 0x3A)):  # no sentence ends
        text = "".join(chr(rng.choice(letters)) for _ in range(60_000))
        a, b = spark.createDataFrame([(text,), ("new " + text,)], "t string").select(exact.chunks(F.col("t")).alias("c")).collect()
        assert "".join(a["c"]) == text and "".join(b["c"]) == "new " + text and max(map(len, a["c"])) <= 4096
        assert len(set(a["c"]) & set(b["c"])) >= len(a["c"]) // 2


def test_clashing_chunk_ids_are_told_apart(spark):
    rows = spark.createDataFrame([(0, 10, "x", [1, 2], [b"p", b"q"]), (1, 11, "y", [1, 2], [b"p", b"r"]), (2, 12, "x", [1, 2], [b"p", b"q"])], "rid long, doc_id long, text_sha256 string, recipe array<long>, proofs array<binary>")
    fix = {r["rid"]: r["fix"] for r in exact.verified(rows).collect()}
    assert fix[0] == fix[2] != fix[1]


def test_greedy_and_least_capacity():
    sizes = [3, 1, 4, 1, 5, 9, 2, 6]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]

    def brute(k):
        return next(c for c in range(max(sizes), sum(sizes) + 1) if len(fill(c)) <= k)

    def fill(c):
        parts, now = [], 0
        for s in sizes:
            if now + s > c and now:
                parts.append(now)
                now = 0
            now += s
        return [*parts, now]

    for k in range(1, 9):
        assert sharding.least_capacity(ends, max(sizes), sum(sizes), k) == brute(k)


def test_shards_are_minimax(docs, nothing):
    for entries in (60_000, 64):  # the second refines its index again and again
        rows = sharding.shard(docs.withColumn("size", F.lit("x")), 4, part=7, entries=entries).collect()
        groups = defaultdict(int)
        for r in rows:
            groups[r["digest"]] += r["size"]
        order = sorted(groups)
        ends, run = [], 0
        for g in order:
            run += groups[g]
            ends.append(run)
        best = sharding.least_capacity(ends, max(groups.values()), run, 4)
        load = Counter()
        for r in rows:
            load[r["shard"]] += r["size"]
        assert max(load.values()) == best
        assert len({(r["digest"], r["shard"]) for r in rows}) == len(groups)
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(r["text_crc32"] is not None for r in rows)
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 133} == {zlib.crc32(b"")}
    assert sharding.shard(nothing).count() == 0
    one = sharding.assign(docs, 4).select("doc_id", "shard").distinct().count()
    assert one == len({(r["doc_id"], r["shard"]) for r in rows})


@pytest.mark.parametrize(("small", "hot"), [(100_000, 2000), (1, 40), (1, 1)])
def test_decontamination(spark, docs, nothing, monkeypatch, small, hot):
    """Terms broadcast; met by shuffle with some hot terms; met by shuffle without any."""
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", small)
    monkeypatch.setattr(decontaminate, "HOT", hot)
    long = docs.filter("doc_id = 135").first()["text"]
    words = long.split()
    items = [(1, " ".join(words[10:40])), (2, " ".join(words[5:9]).upper()), (3, None), (4, "..."), (5, " ".join(words[100:110])), (5, " ".join(words[100:110])), (6, "not there at all"), (None, " ".join(words[7:8]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for r in docs.collect():
        w, hit, found = low(r["text"]), set(), set()
        for i, t in items:
            x = low(t)
            if not x:
                continue
            n = min(10, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= {str(i)} if i is not None else set()
        want.append((str(r["doc_id"]), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(docs.withColumn("n_hit", F.lit(1)), bench)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    clean = {str(r["doc_id"]) for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {w[0] for w in want if not w[5]}
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    near = spark.createDataFrame([(1, "aa bb cc dd")], "item_id long, text string")
    far = spark.createDataFrame([(9, "dd x bb aa y cc", "en", "a", 1)], docs.schema)
    assert [tuple(r)[:2] for r in decontaminate.proximity(far, near, reach=6).collect()] == [(9, "1")]
