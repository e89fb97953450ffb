"""SimHash, language ID, lattice scoring, HTML extraction, token ids and suffix dedup against brute force."""

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import components, hostpaths, langid, lattice, queries, simhash, suffixes, tokenids

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    e = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(30)]
    got = {r["v"]: r["root"] for r in components.connected(spark.createDataFrame(e, "u long, v long")).collect()}
    want = roots({x for p in e for x in p}, e)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprint_by_its_definition():
    import xxhash

    text = "The quick  brown\tfox The quick brown"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_blocks_follow_the_number_of_fingerprints():
    rng = random.Random(4)
    assert len(simhash.block_masks(3)) == 10 and [len(simhash.block_widths(n, 3)) for n in (0, 10**9, 10**10, 10**12)] == [5, 5, 6, 7]
    for n in (0, 10**10, 10**12, 10**15):
        masks = simhash.block_masks(3, n)
        assert sum(simhash.block_widths(n, 3)) == 64
        for _ in range(300):
            far = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not far & m for m in masks)


def test_neighbours_lose_no_link(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    linked = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    want = roots(signed, linked)
    for part in (2000, 7):  # the second splits buckets into tiles
        found = [tuple(r) for r in simhash.neighbours(df, 3, part).collect()]
        assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in linked}
        assert roots(signed, found) == want


def test_near_duplicates(docs, nothing):
    rows = docs.collect()
    fps = [simhash.fingerprint(r["text"].encode() if r["text"] is not None else None) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    group = roots(range(len(rows)), linked)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[group[i]] = min(least.get(group[i], 1 << 60), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{fps[i]:016x}", least[group[i]]) for i, r in enumerate(rows))
    assert sorted((str(r[0]), r[1], r[2]) for r in simhash.near_duplicates(docs.withColumn("fp", F.lit("x"))).collect()) == want
    kept = simhash.deduplicate(docs, size=3).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least.values()))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


def test_copies_that_differ_more(spark):
    rng = random.Random(11)
    rows, near = [], {}
    for i in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(80, 300))]
        rows.append((2 * i, " ".join(words)))
        for _ in range(rng.randint(0, 1)):
            words[rng.randrange(10, 70)] = "changed"
            rows.append((2 * i + 1, " ".join(words)))
            near[2 * i + 1] = 2 * i
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert kept >= {2 * i for i in range(60)} and len(kept & set(near)) <= 1
    apart = [(0, "a b c d e f g h i j"), (1, "a b c d e f g h i k"), (2, None), (3, "")]
    assert {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(apart, "doc_id long, text string"), similarity=0.8).collect()} == {0, 1, 2}


def phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def test_cross_parsing_needs_the_phrases_of_greedy_longest_matches():
    rng = random.Random(4)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    text = "".join(rng.choice("abcd ") for _ in range(500))
    code = lambda t: np.array([" abcd".index(c) for c in t], np.uint8)
    steps = langid.Automaton(code(sample), 5).steps()
    assert langid.parse(steps, [code(text), code(""), code("abc")]).tolist() == [phrases(sample, text), 0, phrases(sample, "abc")]


@pytest.mark.parametrize("stretch", [3, 16, 1024])
def test_phrases_of_long_texts_go_on_across_stretches(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng = np.random.default_rng(0)
    learn = rng.integers(0, 6, 4000).astype(np.uint8)
    steps = langid.Automaton(learn, 8).steps()
    texts = [rng.integers(0, 7, n).astype(np.uint8) for n in (0, 1, 5, 100, 3000)] + [learn[:1500], learn[200:3900]]
    want = [phrases(learn.tobytes(), t.tobytes()) for t in texts]
    assert langid.parse(steps, texts).tolist() == want
    assert langid.parse(steps, [np.tile(learn, 250)]).sum() > 200  # a megabyte


def test_one_table_of_steps_is_held_whatever_the_number_of_languages():
    rng = random.Random(5)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    model = langid.Model({k: [text(v, 30) for _ in range(9)] for k, v in (("x", "abcd"), ("y", "cdef"), ("z", "efgh"))})
    one, two, three = model.steps()
    assert np.shares_memory(one, two) and np.shares_memory(two, three)
    asked = [text(v, n) for n in (3, 40) for v in ("abcd", "cdef", "efgh")]
    coded = [model.encode(langid.plain(t)) for t in asked]
    need = [langid.parse(a.steps(), coded) / own for a, own in zip(model.automata, model.own)]
    assert model.predict(asked)[0] == ["xyz"[i] for i in np.argmin(need, axis=0)] == list("xyzxyz")


def test_letters_of_all_scripts_are_told_apart():
    rng = random.Random(9)
    letters = {"han-a": range(0x4E00, 0x5200), "han-b": range(0x5200, 0x5600), "kana": range(0x3041, 0x3096), "arabic": range(0x620, 0x64B), "hangul": range(0xAC00, 0xAE00), "gothic": range(0x10330, 0x1034A)}
    words = {k: ["".join(chr(rng.choice(v)) for _ in range(rng.randint(1, 3))) for _ in range(120)] for k, v in letters.items()}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = langid.Model({k: [say(k, 100) for _ in range(30)] for k in words})
    want = [k for k in words for _ in range(10)]
    assert model.predict([say(k, 40) for k in want])[0] == want
    codes = langid.plain("aé 漢\U00010330")
    assert len(model.encode(codes)) == 1 + sum(1 if c in model.symbols else langid.DIGITS for c in codes.tolist() if c)


def test_language_id(spark, docs, nothing):
    rng = random.Random(6)
    say = {"aa": "kalo mina sore", "bb": "thrix wumpf grint", "cc": "éeau ouï ça"}
    text = lambda k, n: " ".join(rng.choice(say[k].split()) + rng.choice(say[k].split()) for _ in range(n))
    rows = [(i, text(k, rng.randint(3, 300)), k) for i, k in enumerate(rng.choice(list(say)) for _ in range(150))]
    rows += [(500, None, "aa"), (501, "12 !", "bb"), (502, "", None), (None, text("aa", 30), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "row": F.lit("x")})
    model = langid.fit(df.filter(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(df, model).select("row.doc_id", "row.lang", "lang_pred", "score").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 500)
    assert {r["lang_pred"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 500} == {"und"}
    assert [r["lang_pred"] for r in got if r["doc_id"] is None] == ["aa"] and all(0 <= r["score"] <= 1 for r in got)
    empty = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(nothing, model).count() == 0


def test_lattice_sums_all_segmentations_and_is_a_distribution():
    pieces = [(b"a", False, math.log(0.2)), (b"b", False, math.log(0.1)), (b"ab", False, math.log(0.1)), (b"a", True, math.log(0.2)), (b"b", True, math.log(0.2)), (b"ab", True, math.log(0.2))]
    score = {(p, f): s for p, f, s in pieces}

    def brute(w):
        if not w:
            return 0.0
        return sum(math.exp(score[(w[:k], k == len(w))]) * (1 if k == len(w) else brute(w[k:])) for k in range(1, len(w) + 1) if (w[:k], k == len(w)) in score)

    import itertools

    words = [bytes(x) for n in range(1, 9) for x in itertools.product(b"ab", repeat=n)]
    got = np.exp(lattice.Lattice(pieces, 1).marginal(words)[:, 0])
    assert np.allclose(got, [brute(w) for w in words]) and 0.95 < got.sum() <= 1
    full = lattice.vocabulary(VOCABULARY)
    assert abs(sum(math.exp(s) for *_, s in full) - 1) < 1e-9
    fitted = lattice.Lattice(full, 2)
    sample = [b"thething", b"thing", b"then"] * 5
    before = fitted.marginal(sample).sum()
    fitted.update(fitted.expected(sample, np.ones((15, 2))))
    assert fitted.marginal(sample).sum() > before and np.allclose(np.exp(fitted.scores).sum(axis=0), 1)
    assert max(len(p) for p, *_ in full) > 12  # no piece is left out


def test_expected_counts_and_long_words(monkeypatch):
    rng = random.Random(2)
    l = lattice.Lattice(lattice.vocabulary(VOCABULARY), 2)
    l.scores = l.scores + np.random.default_rng(1).normal(0, 0.5, l.scores.shape)
    words = ["".join(rng.choice(["the", "ing", "a", "é", "tion", "x"]) for _ in range(rng.randint(1, 9))).encode() for _ in range(40)]
    weights = np.random.default_rng(2).random((40, 2))
    one, counts = l.marginal(words), l.expected(words, weights)
    lengths = np.array([len(w) for w in words])
    monkeypatch.setattr(lattice, "LONG", 0)
    assert np.allclose(l.marginal(words), one) and np.allclose(l.expected(words, weights), counts)
    sizes = {k: len(p) for k, (p, f) in ((int(lattice._hashes(np.frombuffer(p, np.uint8)[None, :])[0, -1]) ^ (int(lattice.FINAL) if f else 0), (p, f)) for p, f, _ in lattice.vocabulary(VOCABULARY))}
    bytes_ = np.array([sizes[int(k)] for k in l.keys])
    assert np.allclose((bytes_[:, None] * counts).sum(axis=0), (lengths[:, None] * weights).sum(axis=0))  # every byte is in one piece of each segmentation
    start = time.time()
    assert l.marginal([b"internationally" * 20_000])[0, 0] < -10_000 and time.time() - start < 60


def plain_score(model, counts, text):
    """log10 probability of a text, token by token: each is drawn by the model, or from an urn that returns it with one more."""
    words = (text or "").encode().lower().split()
    k = len(model.ends)
    logs = model.words([*words, b"x"], np.array([counts.get(w, [0] * k) for w in [*words, b"x"]], float))[:-1]
    found = []
    for i in range(k):
        p = [*np.exp(logs[:, i]), math.exp(model.end()[i])]
        found.append(model.prior()[i] - math.log(2) + sum(map(math.log, p)))
        drawn, seen = 0.0, Counter()
        for at, (w, q) in enumerate(zip([*words, None], p)):
            drawn += math.log((seen[w] + lattice.CONCENTRATION * q) / (at + lattice.CONCENTRATION))
            seen[w] += 1
        found.append(model.prior()[i] - math.log(2) + drawn)
    return (max(found) + math.log(sum(math.exp(x - max(found)) for x in found))) / math.log(10)


def test_scores(docs, nothing):
    pieces = lattice.vocabulary(VOCABULARY)
    trains = F.expr("doc_id % 3 <> 1 OR doc_id IS NULL")
    train = docs.filter(trains)
    model, counts = lattice.learn(train, pieces)
    count = Counter()
    for r in train.collect():
        count.update((r["text"] or "").encode().lower().split())
        count[b" "] += 1
    n, v = sum(count.values()), len(count)
    assert (model.n, model.v) == (n, v)
    rows = [(str(r["doc_id"]), [*(r["text"] or "").encode().lower().split(), b" "], r["text"]) for r in docs.collect()]
    base = lambda t: math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1)))
    by_label = {bytes(r["word"]): [r[f"c{i}"] for i in range(len(model.ends))] for r in counts.collect()}
    want = sorted((d, len(t), sum(count[x] > 0 for x in t), round(sum(map(base, t)), 6), round(plain_score(model, by_label, x), 5)) for d, t, x in rows)
    old, results = lattice.HEAD_WORDS, []
    try:
        for lattice.HEAD_WORDS, listed in ((old, False), (3, False), (old, True), (3, True)):  # 3: nearly all words by shuffle
            m, c = lattice.learn(docs, pieces, trains) if listed else (model, counts)
            got = lattice.score(docs.withColumns({"word": F.lit(1), "n": F.lit("x"), "rid": F.lit(2)}), m, c, listed)
            results.append(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 5)) for r in got.collect()))
    finally:
        lattice.HEAD_WORDS = old
    for r in results:
        assert [x[:4] for x in r] == [x[:4] for x in want] and np.allclose([x[4] for x in r], [x[4] for x in want], atol=1e-4)
    assert lattice.score(nothing, model, counts).count() == 0
    none, counts = lattice.learn(nothing, pieces)
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in lattice.score(docs, none, counts).collect())


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
def test_held_out_text_is_likelier_than_by_the_base(spark):
    got = queries.QUERIES["op1_subword_lattice"](spark, SF).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=x>Home</a></header><nav><ul><li><a>m</a></ul></nav>
<div id="cookie-notice">We use cookies, a lot of cookies.</div><div class="wrap"><div class="post-content p{n}"><h1>Title &amp; {n}</h1><p>First   para <b>bold<p>Second&nbsp;para 1 < 2{more}<div class="ad-slot">Buy!</div><ul><li>one<li>two</ul><form>f</form></div>
<div class="talk">{talk}</div><aside>s</aside></div><footer>&copy;</footer><script>var t="</p>"</script></body>"""


def test_extraction_follows_the_hosts_paths(spark):
    long, talk = " and on" * 30, "<p>" + "I say so too. " * 40
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i, more=long, talk="")) for i in range(5)]
    rows += [(5, "https://H.example:80/x", PAGE.format(n=5, more="", talk=talk)), (6, "http://h.example/e", None), (7, None, ""), (8, "//other/", "<p>alone <br> here"), (8, "//other/", "<p>alone <br> here"), (9, "x", "<<>< &amp;lt; <!-- c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))
    got = [(r["page_id"], r["text"]) for r in hostpaths.extract(pages).collect()]
    text = lambda n, more: f"Title & {n}\nFirst para bold\nSecond para 1 < 2{more}\none\ntwo"
    want = [(i, text(i, long)) for i in range(5)] + [(5, text(5, "")), (6, ""), (7, ""), (8, "alone\nhere"), (8, "alone\nhere"), (9, "<<>< &lt;")]
    assert sorted(got) == sorted(want)
    assert hostpaths.extract(pages.limit(0)).count() == 0


def test_codes_read_at_random():
    rng = np.random.default_rng(1)
    for n in (0, 1, 8, 511, 512, 513, 3000):
        ids = np.concatenate([rng.integers(0, 300, n // 2), rng.integers(0, 1 << 32, n - n // 2)]).astype(np.uint32)
        rng.shuffle(ids)
        codes = tokenids.Codes(bytes(tokenids.Codes.of(ids)))
        assert (codes[:] == ids).all() and all(codes[i] == ids[i] for i in range(n))
        for _ in range(30):
            a, b = sorted(int(x) for x in rng.integers(0, n + 1, 2))
            assert (codes[a:b] == ids[a:b]).all()
    with pytest.raises(IndexError):
        codes[3000]
    with pytest.raises(ValueError):
        tokenids.Codes(b"none")


def test_encoder_agrees_with_the_library():
    e = tokenids.Encoder(VOCABULARY)
    words = "don't THE Été, , ß İstanbul <|endoftext|> x<|endoftext|>y a1b2 ''s --- é Å naïve… 日本語 🙂🙂 éa ΣΑΣ ǅ a\xa0b _x_ a_b ÀÉ** $$ \x00 ſ ŉ ĸ| ªº µ".split(" ")
    for w in words:
        assert np.frombuffer(e.text(w.encode()), "<u4").tolist() == e.tokenizer.encode(w, add_special_tokens=False).ids, w


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_library_on_whole_texts(file):
    e = tokenids.Encoder(public_tokenizers.path(file))
    texts = ["", " ", "Hello,  World's\n\n two\tlines \r\n", "<|EndOfText|> x <|endoftext|> Y<|STARTOFTEXT|>", "A\x1cb\u2028C\xa0d", "don't  DON'T " * 50, "日本語 テキスト 한국어 " * 20, "Ab 12*** " * 120_000]
    for t in texts:
        assert np.frombuffer(e.text(t.encode()), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:40]
    assert e.by_word == (file == "word_bpe_49k.json")


def test_token_ids(docs, nothing):
    e = tokenids.Encoder(VOCABULARY)
    ids = lambda t: [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    images = tokenids.write(docs, VOCABULARY, image_ids=50)
    got = sorted((r["start"], str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in tokenids.read(images).collect())
    rows = docs.collect()
    want = Counter((str(r["doc_id"]), len(ids(r["text"])), zlib.crc32(np.array(ids(r["text"]), "<u4").tobytes())) for r in rows)
    assert Counter(g[1:] for g in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    order = [-1 if g[1] == "None" else int(g[1]) for g in got]
    assert order == sorted(order)
    text = next(r["text"] for r in rows if r["doc_id"] == 135)
    assert tokenids.tokens(images, 135, 10, 20) == ids(text)[10:20]
    assert tokenids.encode(nothing, VOCABULARY).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(3)
    for _ in range(150):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 3, 16, 18, 25, 40]))) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.5:
            head = bytes(rng.choice(b"ab") for _ in range(30))
            strings = [head + x for x in strings] + [head]
        order, lcp = suffixes.deep_shallow(strings)
        line = [strings[i] for i in order]
        assert sorted(order) == list(range(len(strings))) and line == sorted(strings)
        assert lcp == [0] + [len(os.path.commonprefix(p)) for p in zip(line, line[1:])]


def removed(texts, n=400):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        yield len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("group", [2000, 3])
def test_suffix_dedup(spark, nothing, group):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh éß") for _ in range(n))
    passages = [text(420), text(400), text(900), text(395)]
    texts = []
    for _ in range(40):
        t = text(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.choice([0, rng.randint(0, 60)]) : len(p) - rng.choice([0, rng.randint(0, 60)])] + text(rng.randint(0, 200))
        texts.append(t)
    rows = list(enumerate([*texts, texts[0], "a" * 1500, "ab" * 500, None, ""])) + [(5, texts[5]), (None, texts[6])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    got = suffixes.remove(df, group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = [(d, *r) for (d, _), r in zip(rows, removed([(t or "").encode() for _, t in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffixes.remove(nothing).count() == 0


def in_passages(texts, n):
    count = Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[tuple(t[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        yield sum(gone)


def test_passages_are_counted_in_words(spark, nothing):
    rng = random.Random(8)
    text = lambda n: [rng.choice("abcdefgh") + rng.choice("iou") for _ in range(n)]
    shared = [text(60), text(51), text(50), text(140)]
    texts = [text(rng.randint(0, 60)) + rng.choice(shared) + text(rng.randint(0, 200)) for _ in range(30)] + [text(300) for _ in range(10)] + [["x"] * 80, [], ["y"] * 51]
    rows = [(i, "\n ".join(t)) for i, t in enumerate(texts)] + [(3, "\n ".join(texts[3])), (None, " ".join(texts[4])), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit("x")).repartition(3)
    got = suffixes.remove(df, words=51).select("doc_id", "n_passage_words").collect()
    want = [(d, n) for (d, _), n in zip(rows, in_passages([(t or "").split() for _, t in rows], 51))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffixes.remove(nothing, words=51).count() == 0


def test_long_texts_are_cut_into_stretches(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abc") for _ in range(5000)).encode()
    whole = [x.tolist() for x in next(suffixes.Anchors(400, 100).runs([text]))]
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    parts = [x.tolist() for x in next(suffixes.Anchors(400, 100).runs([text]))]
    assert parts == whole
