"""Queries of the card store's files, ids, links and texts, over cards made of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import segment, text
from mnemoframe.operators import activation, fts, graph, maintain, store
from mnemoframe.operators.index import shared_dir
from mnemoframe.operators.segments import Segments
from mnemoframe.sources import cards as C
from mnemoframe.sources import logs, stores

from .catalog import CARDS, GRAPH, INDEX, LINKS, NOW, OVERLAP, SPREAD, _ENTITIES, _cards, _index_cards, _Graph, _index, _linked, _questions, query, r6

TIME = f"TIMESTAMP '{NOW}'"


def _as_json(cards: DataFrame) -> DataFrame:
    """(persona_id, seq, data): cards as old stores hold them: a state, levels like "m2", dead fields; every eleventh can't be read."""
    state = F.element_at(F.array(*[F.lit(s) for s in ("active", "Deleted", "superseded", "merged", "legacy", "archived", "active")]), (F.col("seq") % 7 + 1).cast("int"))
    level = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("m"), (F.col("seq") % 4).cast("string"))).otherwise("0")
    body = F.to_json(F.struct("id", "content", "topic", "session_id", state.alias("status"), level.alias("level"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit(0.5).alias("clarity"), F.lit("x").alias("draft_id")))
    return cards.select("persona_id", "seq", F.when(F.col("seq") % 11 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("data"))


@query("card_json_scan", """, r AS (SELECT *, CASE WHEN seq % 3 = 0 THEN CAST(seq % 4 AS INTEGER) ELSE 0 END AS level, seq % 7 AS state FROM cards WHERE seq % 11 <> 0)
SELECT persona_id, id, md5(content) AS content_md5, topic, level, state IN (4, 5) AS legacy, CASE WHEN level = 0 THEN 'experience' END AS card_type, CASE WHEN level = 0 THEN CAST(8 AS DOUBLE) END AS retention, CAST(epoch(created_at) AS BIGINT) AS updated FROM r WHERE state NOT IN (1, 2, 3)""", CARDS)
def card_json_scan(spark, d):
    got = C.from_json_rows(_as_json(_cards(spark, d)))
    return got.select("persona_id", "id", F.md5("content").alias("content_md5"), "topic", "level", "legacy", "card_type", "retention", F.unix_seconds("last_updated").alias("updated"))


@query("card_stores_scan", """, r AS (SELECT *, CASE WHEN seq % 3 = 0 THEN CAST(seq % 4 AS INTEGER) ELSE 0 END AS level, seq % 7 AS state FROM cards WHERE seq % 11 <> 0 AND persona_id IS NOT NULL)
SELECT persona_id, id, md5(content) AS content_md5, topic, level, state IN (4, 5) AS legacy, CASE WHEN level = 0 THEN CAST(8 AS DOUBLE) END AS retention, CAST(epoch(created_at) AS BIGINT) AS updated FROM r WHERE state NOT IN (1, 2, 3)""", CARDS)
def card_stores_scan(spark, d):
    """Cards out to each persona's database files and in again, as today's cards."""
    base = f"{shared_dir(spark)}/mnemoframe-files/{uuid.uuid4().hex}"
    stores.register(spark)
    cards = C.of_documents(spark.read.parquet(f"{d}/documents.parquet")).filter("persona_id IS NOT NULL")
    rows = _as_json(cards).withColumn("id", F.concat(F.lit("c_"), F.lpad(F.col("seq").cast("string"), 8, "0")))
    rows.select("persona_id", "id", "data").write.format(stores.FORMAT).mode("append").save(base)
    return stores.read_cards(spark, base).select("persona_id", "id", F.md5("content").alias("content_md5"), "topic", "level", "legacy", "retention", F.unix_seconds("last_updated").alias("updated"))


@query("card_stores_lookup", """SELECT id, CAST(strlen(content) AS BIGINT) AS n_bytes FROM cards c WHERE persona_id IN (SELECT min(persona_id) FROM cards UNION SELECT max(persona_id) FROM cards)""", CARDS)
def card_stores_lookup(spark, d):
    """The cards of the first and the last persona; the other personas' files aren't opened."""
    base = f"{shared_dir(spark)}/mnemoframe-files/{uuid.uuid4().hex}"
    stores.register(spark)
    cards = C.of_documents(spark.read.parquet(f"{d}/documents.parquet")).filter("persona_id IS NOT NULL")
    cards.select("persona_id", "id", F.col("content").alias("data")).write.format(stores.FORMAT).mode("append").save(base)
    ends = cards.agg(F.min("persona_id").alias("a"), F.max("persona_id").alias("b")).first()
    read = spark.read.format(stores.FORMAT).schema("persona_id string, id string, data string").load(base)
    return read.filter(F.col("persona_id").isin(ends["a"], ends["b"])).select("id", F.octet_length("data").cast("long").alias("n_bytes"))


@query("persona_files", """, p AS (SELECT persona_id, count(*) AS n FROM cards WHERE persona_id IS NOT NULL GROUP BY ALL),
profiles AS (SELECT 'm' || n AS profile, 'served' AS provider, 'model-' || n AS model FROM (SELECT DISTINCT n % 3 AS n FROM p WHERE n % 3 > 0))
SELECT persona_id, coalesce('The ' || CASE WHEN n % 2 = 0 THEN persona_id END, persona_id) AS display_name, CASE WHEN n % 5 = 0 THEN '' ELSE 'u' || n END AS user_display_name, CASE WHEN n % 5 <> 0 THEN 'default' END AS user_id,
  CASE WHEN n % 4 = 0 THEN 'own' ELSE coalesce(f.provider, 'local') END AS provider, CASE WHEN n % 4 = 0 THEN '' ELSE coalesce(f.model, '') END AS model, n % 2 = 1 AS inner_active, CASE WHEN n % 2 = 1 THEN 'hidden' ELSE 'visible' END AS visibility_default
FROM p LEFT JOIN profiles f ON f.profile = 'm' || n % 3""", CARDS)
def persona_files(spark, d):
    """Personas out to their folders' files and in again, with what is missing taken from profiles and defaults."""
    base = f"{shared_dir(spark)}/mnemoframe-files/{uuid.uuid4().hex}"
    n = F.col("n")
    own = C.of_documents(spark.read.parquet(f"{d}/documents.parquet")).filter("persona_id IS NOT NULL").groupBy("persona_id").agg(F.count("*").alias("n"))
    rows = own.select(
        "persona_id", F.when(n % 2 == 0, F.concat(F.lit("The "), "persona_id")).alias("display_name"), F.when(n % 5 != 0, F.concat(F.lit("u"), n.cast("string"))).alias("user_display_name"),
        F.concat(F.lit("m"), (n % 3).cast("string")).alias("profile"), F.when(n % 4 == 0, "own").alias("provider"), F.when(n % 2 == 1, F.lit(True)).alias("inner_active"), F.when(n % 2 == 1, "hidden").alias("visibility_default"),
    )
    stores.write_personas(rows, base)
    k = (n % 3).cast("string")
    profiles = own.filter(n % 3 > 0).select(F.concat(F.lit("m"), k).alias("profile"), F.lit("served").alias("provider"), F.concat(F.lit("model-"), k).alias("model")).distinct()
    return stores.read_personas(spark, base, profiles).select("persona_id", "display_name", "user_display_name", "user_id", "provider", "model", "inner_active", "visibility_default")


@query("cards_jsonl", "SELECT persona_id, id, seq, md5(content) AS content_md5, topic, CAST(epoch(created_at) AS BIGINT) AS created, legacy FROM cards", CARDS)
def cards_jsonl(spark, d):
    """Out to JSON lines and in again; one file in each part holds a broken line, which is skipped."""
    path = f"{shared_dir(spark)}/mnemoframe-files/{uuid.uuid4().hex}"
    rows = _cards(spark, d).select("persona_id", "id", "seq", "content", "topic", "created_at", "legacy")
    C.write_jsonl(rows, path)
    spark.range(1).select(F.lit('{"id": "broken').alias("value")).write.mode("append").text(path)
    back = C.read_jsonl(spark, path, rows.schema)
    return back.select("persona_id", "id", "seq", F.md5("content").alias("content_md5"), "topic", F.unix_seconds("created_at").alias("created"), "legacy")


@query("persona_upsert", """, o AS (SELECT DISTINCT persona_id, 'Old ' || persona_id AS display_name, 'u' AS user_display_name FROM cards WHERE seq % 3 <> 0 AND persona_id IS NOT NULL),
n AS (SELECT persona_id, CASE WHEN n % 2 = 0 THEN 'New ' || n ELSE '' END AS display_name FROM (SELECT persona_id, count(*) AS n FROM cards WHERE persona_id IS NOT NULL GROUP BY ALL))
SELECT persona_id, coalesce(nullif(n.display_name, ''), o.display_name) AS display_name, o.user_display_name FROM o FULL JOIN n USING (persona_id)""", CARDS)
def persona_upsert(spark, d):
    cards = _cards(spark, d).filter("persona_id IS NOT NULL")
    old = cards.filter("seq % 3 <> 0").select("persona_id", F.concat(F.lit("Old "), "persona_id").alias("display_name"), F.lit("u").alias("user_display_name"), F.lit(None).cast("string").alias("system_prompt_template")).distinct()
    new = cards.groupBy("persona_id").agg(F.count("*").alias("n")).select("persona_id", F.when(F.col("n") % 2 == 0, F.concat(F.lit("New "), F.col("n").cast("string"))).otherwise("").alias("display_name"), F.lit("").alias("user_display_name"), F.lit("").alias("system_prompt_template"))
    return C.upsert_personas(old, new).select("persona_id", "display_name", "user_display_name")


@query("feature_log_scan", "SELECT event_type AS module, count(*) AS events, count(DISTINCT user_id % 50) AS traces, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY ALL")
def feature_log_scan(spark, d):
    """Events as a feature log's JSON lines, with a line that can't be read, scanned by module."""
    path = f"{shared_dir(spark)}/mnemoframe-files/{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("module"), F.lit("seen").alias("event"), (F.col("user_id") % 50).cast("string").alias("trace_id"), F.coalesce("props", F.lit("")).alias("data"))
    rows.write.json(path)
    log = logs.read_log(spark, path)
    return log.groupBy("module").agg(F.count("*").alias("events"), F.count_distinct("trace_id").alias("traces"), F.floor(F.max("ts")).alias("last"))


@query("errors_recent", "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error'")
def errors_recent(spark, d):
    return logs.recent_errors(spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'"), "ts").select("event_id", "recent")


@query("names_split", "SELECT doc_id, len(p) AS parts, md5(array_to_string(p, '/')) AS parts_md5 FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[、，,；;/|｜&＆+＋\\s]+'), lambda x: x <> '') AS p FROM documents)")
def names_split(spark, d):
    p = text.split_terms(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(p).cast("long").alias("parts"), F.md5(F.array_join(p, "/")).alias("parts_md5"))


_SAFE = "CASE WHEN {x} = '' THEN 'default' ELSE {x} END"


@query("safe_names", "SELECT doc_id, " + _SAFE.format(x="regexp_replace(regexp_replace(coalesce(nullif(text, ''), 'default'), '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9_.-]+', '_', 'g')") + " AS session, " + _SAFE.format(x="regexp_replace(replace(regexp_replace(regexp_replace(coalesce(nullif(text, ''), 'default'), '^\\s+|\\s+$', '', 'g'), '[^\\p{L}\\p{M}\\p{N}_.\\-]+', '_', 'g'), '..', '_'), '^[_. ]+|[_. ]+$', '', 'g')") + " AS file FROM documents")
def safe_names(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.safe_session_id(F.col("text")).alias("session"), text.safe_filename(F.col("text")).alias("file"))


@query("stable_ids", "SELECT id, 'c_' || substr(sha256(concat_ws(chr(31), coalesce(persona_id, ''), coalesce(session_id, ''), CAST(seq AS VARCHAR), content)), 1, 32) AS made FROM cards", CARDS)
def stable_ids(spark, d):
    return _cards(spark, d).select("id", text.stable_id("c_", F.col("persona_id"), F.col("session_id"), F.col("seq"), F.col("content")).alias("made"))


@query("cards_by_id", "SELECT c.persona_id, c.id, md5(c.content) AS content_md5 FROM cards c JOIN (SELECT persona_id, max(id) AS id FROM cards GROUP BY ALL) m ON m.persona_id = c.persona_id AND m.id = c.id", CARDS)
def cards_by_id(spark, d):
    cards = _cards(spark, d)
    return store.by_id(cards, cards.groupBy("persona_id").agg(F.max("id").alias("id"))).select("persona_id", "id", F.md5("content").alias("content_md5"))


@query("links_added", """, have AS (SELECT from_id, target_id, 'next' AS relation, weight FROM links), more AS (SELECT c.id AS from_id, n1 AS target_id, 'again' AS relation, 0.9 AS weight FROM nexts c WHERE seq % 2 = 0 AND n1 IS NOT NULL UNION ALL SELECT id, 'nowhere', 'again', 0.9 FROM nexts)
SELECT relation, count(*) AS links, round(sum(weight), 6) AS weight FROM (SELECT * FROM have ANTI JOIN (SELECT from_id, target_id FROM more) USING (from_id, target_id) UNION ALL SELECT * FROM more WHERE target_id <> 'nowhere') GROUP BY ALL""", LINKS)
def links_added(spark, d):
    """A second link to the next card replaces the first one; links to nowhere aren't made."""
    cards = _linked(_cards(spark, d))
    link = lambda target: cards.select("persona_id", F.col("id").alias("from_id"), target.alias("target_id"), F.lit("again").alias("relation"), F.lit(0.9).alias("weight"), "seq")
    to_next = link(F.get("links", F.lit(0))["target_id"]).filter("seq % 2 = 0 AND target_id IS NOT NULL")
    out = store.add_links(cards, to_next.unionByName(link(F.lit("nowhere"))).drop("seq"))
    return out.select(F.inline("links")).groupBy("relation").agg(F.count("*").alias("links"), r6(F.sum("weight")).alias("weight"))


@query("summaries_saved", "SELECT persona_id, node_name, CASE WHEN w THEN 'now ' || node_name ELSE content END AS content, CASE WHEN w THEN df ELSE 0 END AS card_count, CASE WHEN w THEN 0 ELSE new_since_write END AS new_since_write, CASE WHEN w AND content <> '' THEN 1 ELSE 0 END AS edits FROM (SELECT s.persona_id, s.node_name, s.content, s.new_since_write, n.df, n.df % 2 = 0 AS w FROM summaries s JOIN nodes n ON n.persona_id = s.persona_id AND n.name = s.node_name)", GRAPH)
def summaries_saved(spark, d):
    g = _Graph(spark, d)
    edits = "array<struct<content:string,replaced_at:string>>"
    old = g.summaries.withColumns({"card_count": F.lit(0).cast("long"), "last_rewrite": F.lit(None).cast("timestamp"), "edit_history": F.lit(None).cast(edits)})
    written = g.nodes.filter("df >= 3 AND df % 2 = 0").select("persona_id", F.col("name").alias("node_name"), F.concat(F.lit("now "), "name").alias("content"), F.col("df").alias("card_count"))
    out = graph.save_summaries(old, written, NOW)
    return out.select("persona_id", "node_name", "content", "card_count", "new_since_write", F.size("edit_history").alias("edits"))


@query("activation_above", "SELECT query_id, card_id, round(energy, 6) AS energy FROM cut WHERE gone = 0 AND round(energy, 9) >= 0.5", SPREAD)
def activation_above(spark, d):
    cards = _cards(spark, d)
    seeds = activation.keyword_fallback(cards, _questions(spark), 15).select("query_id", "persona_id", "card_id", F.col("score").alias("sim"))
    sleepy = cards.withColumn("retention", F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.col("retention")))
    pool = activation.energies(seeds, sleepy, F.lit(NOW).cast("timestamp"))
    spread = activation.spread(pool, spark.createDataFrame(_ENTITIES, "persona_id string, name string"))
    return activation.above(spread.withColumn("energy", F.round("energy", 9))).select("query_id", "card_id", r6("energy").alias("energy"))


@query("gate_excluded", "SELECT query_id, card_id, round(score, 6) AS score FROM over JOIN cards c ON c.id = card_id WHERE rank <= 15 AND score >= 0.35 AND c.seq % 2 = 0", OVERLAP)
def gate_excluded(spark, d):
    """Cards of odd numbers were shown to each question before."""
    cards = _cards(spark, d)
    hits = activation.keyword_fallback(cards, _questions(spark), 15)
    shown = hits.join(cards.filter("seq % 2 = 1").select(F.col("id").alias("card_id")), "card_id").select("query_id", "card_id")
    return activation.gate(hits, cards, shown).select("query_id", "card_id", r6("score").alias("score"))


@query("candidate_lines", "SELECT id, md5('  id=' || id || ' (L' || CAST(seq % 3 AS VARCHAR) || ') [' || '/' || coalesce(topic, '') || '] ' || content) AS line_md5 FROM cards", CARDS)
def candidate_lines(spark, d):
    cards = _cards(spark, d).withColumn("level", (F.col("seq") % 3).cast("int"))
    return cards.select("id", F.md5(activation.candidate_line()).alias("line_md5"))


@query("daily_drafts", "SELECT persona_id, md5(string_agg('- [/' || coalesce(topic, '') || '] ' || substr(content, 1, 200), chr(10) ORDER BY seq)) AS text_md5 FROM cards GROUP BY ALL", CARDS)
def daily_drafts(spark, d):
    return maintain.daily_drafts(_cards(spark, d)).select("persona_id", F.md5("text").alias("text_md5"))


@query("cards_fitted", """, t AS (SELECT id, content, strlen(content) > 1502 AS over_, seq % 2 = 0 AS helped FROM cards)
SELECT id, over_ AND NOT helped AS cut, CASE WHEN over_ AND helped THEN 'short ' || id END AS text FROM t WHERE over_""", CARDS)
def cards_fitted(spark, d):
    """Cards over the cap get a shorter text where there is one, and are cut and marked elsewhere."""
    cards = _cards(spark, d)
    short = cards.filter("seq % 2 = 0").select("persona_id", "id", F.concat(F.lit("short "), "id").alias("text"))
    fitted, was = store.fit(cards, 500, short), cards.filter(text.estimate_tokens(F.col("content")) > 500).select("id")
    cut = F.coalesce("needs_review", F.lit(False))
    return fitted.join(was, "id").select("id", cut.alias("cut"), F.when(~cut, F.col("content")).alias("text"))


@query("store_stats", "SELECT c.persona_id, count(*) AS total, CAST(sum(CASE WHEN legacy THEN 0 ELSE 1 END) AS BIGINT) AS active, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_links, bool_or(NOT legacy AND seq % 50 = 3) AS has_portrait FROM cards c LEFT JOIN (SELECT from_id, count(*) AS n FROM links GROUP BY ALL) l ON l.from_id = c.id GROUP BY ALL", LINKS)
def store_stats(spark, d):
    return store.stats(_linked(_cards(spark, d)).withColumn("is_portrait", F.col("seq") % 50 == 3))


EVAL = GRAPH + ",\n" + INDEX[len(CARDS) + 2 :].split("qterms AS")[0] + """asks AS (SELECT persona_id, card_id AS own, node AS term FROM ledger WHERE pos <= 2),
wants AS (SELECT persona_id, own, count(*) AS wanted FROM asks GROUP BY ALL),
dfs AS (SELECT persona_id, term, count(*) AS df FROM postings GROUP BY ALL),
found AS (SELECT own, persona_id, card_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS have
  FROM asks JOIN postings USING (persona_id, term) JOIN dfs USING (persona_id, term) JOIN corpus USING (persona_id) GROUP BY ALL),
places AS (SELECT own, card_id, row_number() OVER (PARTITION BY own ORDER BY round(score, 9) DESC, card_id) AS rank FROM found JOIN wants USING (persona_id, own) WHERE have = wanted),
ranks AS (SELECT w.own, CASE WHEN rank <= 5 THEN rank ELSE 0 END AS rank FROM wants w LEFT JOIN places p ON p.own = w.own AND p.card_id = w.own)"""


@query("eval_metrics", "SELECT count(*) AS queries, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM (SELECT own, coalesce(rank, 0) AS rank FROM ranks)", EVAL)
def eval_metrics(spark, d):
    """Each card is asked for by its two heaviest terms; its place among the first five full-text hits is what counts. Cards with equal terms ask once."""
    x = _index(spark, d)
    asked = x.ledger.filter("pos <= 2").groupBy("card_id", "persona_id").agg(F.sort_array(F.collect_set("node")).alias("terms"))
    own = fts.best_of_many(x.postings, x.sizes, asked.select("persona_id", "terms").distinct(), 5).select("persona_id", "terms", "card_id", "rank")
    m = maintain.retrieval_metrics(asked.join(own, ["persona_id", "terms", "card_id"], "left").select(F.coalesce("rank", F.lit(0)).alias("rank")))
    return m.select("queries", *[r6(c).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr")])


@query("stop_words_given", "SELECT persona_id, count(*) AS words FROM tokens WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (SELECT term FROM (SELECT term, count(*) AS n FROM tokens GROUP BY ALL) WHERE n >= 200) GROUP BY ALL", CARDS)
def stop_words_given(spark, d):
    """Stop words as a table: here the words that occur 200 times and more."""
    cards, x = _cards(spark, d), _index(spark, d)
    kept = text.without_stop_words(cards.select("persona_id", F.explode(text.topic_words(F.col("content"), stop=[""])).alias("word")), x.frequency.filter("gf >= 200").select("word"))
    return kept.groupBy("persona_id").agg(F.count("*").alias("words"))


@query("portraits_rewritten", "SELECT persona_id, portrait_type, CASE WHEN k % 3 = 0 THEN 'old' || chr(10) || 'mid' WHEN k % 3 = 1 THEN 'new ' || k || chr(10) || 'mid' ELSE 'old' || chr(10) || 'was' END AS content, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 2 ELSE 0 END AS edits, CASE WHEN k % 3 < 2 THEN 0 ELSE 1 END AS pool FROM (SELECT persona_id, unnest(['persona', 'user', 'relationship']) AS portrait_type, unnest([n, n + 1, n + 2]) AS k FROM (SELECT persona_id, count(*) AS n FROM cards GROUP BY ALL))", CARDS)
def portraits_rewritten(spark, d):
    """Each persona's three portraits get a new mid-term text, and a stable one as well, or nothing."""
    n = _cards(spark, d).groupBy("persona_id").agg(F.count("*").alias("n"))
    kinds = n.select("persona_id", F.posexplode(F.array(*[F.lit(p) for p in ("persona", "user", "relationship")])).alias("at", "portrait_type"), "n").withColumn("k", F.col("n") + F.col("at"))
    pool = F.array(F.struct(F.lit("d").alias("date"), F.lit("s").alias("summary")))
    have = C.conform(kinds.select("persona_id", "portrait_type", F.lit("p").alias("id"), F.lit(True).alias("is_portrait"), F.lit("old").alias("stable"), F.lit("was").alias("mid_term"), F.lit("old\nwas").alias("content"), pool.alias("staging_pool")))
    texts = kinds.filter("k % 3 < 2").select("persona_id", "portrait_type", F.lit("mid").alias("new_mid"), F.when(F.col("k") % 3 == 1, F.concat(F.lit("new "), F.col("k").cast("string"))).alias("new_stable"), F.lit("because").alias("reasoning"))
    out = maintain.rewrite_portraits(have, texts, NOW)
    return out.select("persona_id", "portrait_type", "content", F.size("edit_history").alias("edits"), F.size("staging_pool").alias("pool"))


GROWN = CARDS + f""",
versions AS (SELECT 0 AS v, persona_id, id, seq, content, seq % 10 <> 1 AND seq % 5 <> 0 AS live FROM cards WHERE seq % 5 <> 4
  UNION ALL SELECT 1, persona_id, id, seq, content || ' zebra zebra', true FROM cards WHERE seq % 5 = 0),
vt AS (SELECT v, persona_id, id, seq, live, unnest(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in text.ENGLISH_STOP_WORDS)}], x) AND NOT regexp_full_match(x, '[0-9]+'))) AS term FROM versions),
first_ AS (SELECT count(*) AS n FROM cards WHERE seq % 5 < 3),
idf AS (SELECT term, count(DISTINCT id) AS df FROM vt WHERE v = 0 AND seq % 5 < 3 GROUP BY term),
weighed AS (SELECT v, persona_id, id, seq, live, vt.term, round(count(*) * round(ln((n + 1) / (coalesce(any_value(df), 0) + 1)), 9), 6) AS weight FROM vt CROSS JOIN first_ LEFT JOIN idf ON idf.term = vt.term GROUP BY v, persona_id, id, seq, live, vt.term, n),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v, id ORDER BY weight DESC, term) AS pos FROM weighed) WHERE pos <= 12)"""


_GROWN: dict[tuple[str, str], Segments] = {}


def _grown(spark, d: str) -> Segments:
    """An index that grew: three fifths of the cards first, then another fifth; then some are changed and some removed. Made once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key in _GROWN:
        return _GROWN[key]
    cards = _index_cards(spark, d)
    table = store.Table(spark, f"{shared_dir(spark)}/mnemoframe-grown/{uuid.uuid4().hex}")
    table.save(cards.filter("seq % 5 < 3"))
    index = Segments(spark, table).refresh()
    table.patch(cards.filter("seq % 5 = 3"))
    table.patch(cards.filter("seq % 5 = 0").withColumn("content", F.concat("content", F.lit(" zebra zebra"))), cards.filter("seq % 10 = 1").select("persona_id", "id"))
    _GROWN[key] = index.refresh()
    return _GROWN[key]


@query("segment_nodes", "SELECT persona_id, term AS name, count(*) FILTER (live) AS df, 1704067200 + 3600 * max(seq) AS last_seen FROM kept GROUP BY ALL HAVING count(*) FILTER (live) > 0", GROWN)
def segment_nodes(spark, d):
    return _grown(spark, d).nodes.withColumn("last_seen", F.unix_seconds("last_seen"))


@query("segment_edges", "SELECT a.persona_id, a.term AS a, b.term AS b, count(*) FILTER (a.live) AS weight, 1704067200 + 3600 * max(a.seq) AS last_seen FROM kept a JOIN kept b ON a.v = b.v AND a.id = b.id AND a.term < b.term GROUP BY ALL HAVING count(*) FILTER (a.live) > 0", GROWN)
def segment_edges(spark, d):
    return _grown(spark, d).edges.withColumn("last_seen", F.unix_seconds("last_seen"))


@query("segment_postings", """, every AS (SELECT persona_id, id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS term FROM versions WHERE live)
SELECT persona_id, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT id) AS cards FROM (SELECT persona_id, id, term, count(*) AS tf FROM every GROUP BY ALL) GROUP BY ALL""", GROWN)
def segment_postings(spark, d):
    return _grown(spark, d).postings.groupBy("persona_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.count_distinct("card_id").alias("cards"))


_HAN = "".join(chr(0x4E00 + 7 * i) for i in range(26))
HAN = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), 1) - 1 AS i FROM documents),
d AS (SELECT word, count(*) AS freq FROM w WHERE length(word) <= 5 GROUP BY word HAVING count(*) >= 3),
t AS (SELECT CAST(sum(freq) AS BIGINT) AS total FROM d),
dw AS (SELECT word, CAST(round(ln(freq / total) * 1000000) AS BIGINT) AS w FROM d, t),
runs AS (SELECT doc_id, i // 2 AS run, string_agg(word, '' ORDER BY i) AS piece FROM w GROUP BY doc_id, i // 2),
pieces AS (SELECT piece, count(*) AS uses FROM runs GROUP BY piece),
subs AS (SELECT piece, k, n, substr(piece, CAST(length(piece) - k + 1 AS BIGINT), n) AS word FROM (SELECT piece, unnest(range(1, length(piece) + 1)) AS k FROM pieces), range(1, 6) x(n) WHERE n <= k),
cands AS (SELECT piece, k, list({{'w': CAST(coalesce(dw.w, round(ln(1 / total) * 1000000)) AS BIGINT), 'n': n}}) AS c FROM subs CROSS JOIN t LEFT JOIN dw ON dw.word = subs.word WHERE n = 1 OR dw.word IS NOT NULL GROUP BY piece, k),
walk AS (SELECT piece, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT)] AS score, [CAST(0 AS BIGINT)] AS words FROM pieces
  UNION ALL SELECT piece, k, list_append(score, b.s), list_append(words, 1 + words[k - b.n + 1]) FROM (SELECT walk.piece, c.k, score, words, list_max(list_transform(c.c, lambda x: {{'s': x.w + score[c.k - x.n + 1], 'n': x.n}})) AS b FROM walk JOIN cands c ON c.piece = walk.piece AND c.k = walk.k + 1)),
best AS (SELECT piece, score[-1] AS score, words[-1] AS words FROM walk WHERE k = length(piece))"""


@query("segment_words", f"WITH RECURSIVE {HAN}\nSELECT doc_id AS id, count(*) AS runs, CAST(sum(words) AS BIGINT) AS words, CAST(sum(score) AS BIGINT) AS weight FROM runs JOIN best USING (piece) GROUP BY doc_id")
def segment_words(spark, d):
    """Each two words of a document are written in Han characters, without a space, and cut again with a dictionary of the corpus's short words."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    latin = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    docs = docs.select(F.col("doc_id").alias("id"), latin.alias("l"))
    han = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", _HAN)
    each = docs.select(F.explode("l").alias("word"))
    docs = docs.repartition(spark.sparkContext.defaultParallelism, "id")
    known = each.filter(F.length("word") <= 5).groupBy("word").agg(F.count("*").alias("freq")).filter("freq >= 3").select(han(F.col("word")).alias("word"), "freq", F.lit("n").alias("flag")).persist()  # read several times
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("l") - 1, F.lit(0)), F.lit(2)), lambda i: F.concat(F.get("l", i), F.coalesce(F.get("l", i + 1), F.lit(""))))
    runs = docs.filter(F.size("l") > 0).select("id", F.array_join(pairs, " ").alias("text"))
    cut = segment.segment(runs.withColumn("text", han(F.col("text"))), known, unknown=False)
    return cut.groupBy("id").agg(F.count("*").alias("runs"), F.sum(F.size("words")).alias("words"), F.sum("weight").alias("weight"))
