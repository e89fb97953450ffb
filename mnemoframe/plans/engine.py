"""The engine: personas, retrieval, ingestion and the nightly review over stored tables, for many personas at once."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions import parsing
from mnemoframe.functions.text import estimate_tokens, time_period, words
from mnemoframe.operators import activation, expand, fts, graph, maintain, region, store, vector
from mnemoframe.operators.segments import Segments
from mnemoframe.sources.cards import CARD, conform, upsert_personas
from mnemoframe.sources.config import Settings
from mnemoframe.sources.stores import read_cards, read_personas

from .seams import Seams, ask, rerank

PERSONA = T.StructType([T.StructField(n, T.StringType()) for n in ("persona_id", "display_name", "user_display_name", "system_prompt_template")])
_history = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("replaced_at", T.StringType())]))
SUMMARY = T.StructType([
    T.StructField("persona_id", T.StringType()), T.StructField("node_name", T.StringType()), T.StructField("content", T.StringType()), T.StructField("card_count", T.LongType()),
    T.StructField("new_since_write", T.LongType()), T.StructField("last_rewrite", T.TimestampType()), T.StructField("edit_history", _history),
])


class MemoryEngine:
    """Facade. ``now`` is a parameter of everything that depends on time, as a timestamp string."""

    def __init__(self, spark: SparkSession, base_dir: str, seams: Seams | None = None, settings: Settings | None = None, frequency: DataFrame | None = None, idf: DataFrame | None = None):
        self.spark, self.seams, self.settings = spark, seams or Seams(), settings or Settings()
        tables = (("cards", CARD, ("persona_id", "id")), ("summaries", SUMMARY, ("persona_id", "node_name")), ("personas", PERSONA, ("persona_id",)))
        self.cards, self.summaries, self.personas = (store.Table(spark, f"{base_dir.rstrip('/')}/{n}", s, k) for n, s, k in tables)
        self._frequency, self._idf = frequency, idf

    def index(self) -> Segments:
        """Stored postings, graph and vectors of the present texts of the cards; what changed since it was last asked for is added first."""
        return Segments(self.spark, self.cards, self.seams.encode, self._idf).refresh()

    def frequency(self, index: Segments) -> DataFrame:
        """(word, gf): the given general frequencies, or the counts of all cards' words."""
        return index.frequency if self._frequency is None else self._frequency

    def register_persona(self, persona_id: str, display_name: str = "", user_display_name: str = "", system_prompt: str = "") -> DataFrame:
        """Upsert; empty values leave what is there."""
        new = self.spark.createDataFrame([(persona_id, display_name or None, user_display_name or None, system_prompt or None)], PERSONA)
        self.personas.save(upsert_personas(self.personas.load(), new))
        return self.personas.load()

    def adopt(self, base: str, profiles: DataFrame | None = None, since: str | None = None) -> DataFrame:
        """Take in the personas and cards of a folder of card stores; cards that are there under the same ids are replaced. Returns the personas found.

        since: only personas with a store written at that time (ISO) or later are read. Cards that a store no longer has stay.
        """
        found = read_personas(self.spark, base, profiles)
        self.personas.save(upsert_personas(self.personas.load(), found.select(*PERSONA.names)))
        self.cards.patch(read_cards(self.spark, base, since))
        return found

    def names(self) -> DataFrame:
        """(persona_id, persona_name, user_name) with fallbacks."""
        return self.personas.load().select("persona_id", F.coalesce("display_name", "persona_id").alias("persona_name"), F.coalesce("user_display_name", F.lit("用户")).alias("user_name"))

    def store(self, persona_id: str | None = None) -> DataFrame:
        cards = self.cards.load()
        return cards if persona_id is None else cards.filter(F.col("persona_id") == persona_id)

    def get(self, persona_id: str, card_id: str) -> dict | None:
        """One card, or None."""
        row = self.store(persona_id).filter(F.col("id") == card_id).first()
        return row.asDict(recursive=True) if row else None

    def retrieve_many(self, queries: DataFrame, now: str, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(chosen rows, prompts) for queries (query_id, persona_id, text)."""
        cards, x = self.cards.load(), self.index()
        budget = F.coalesce(self.settings.column("retrieve.region_count").cast("int"), F.lit(5))
        chosen = region.region(queries, cards, self.summaries.load(), x.adjacency, x.nodes, x.size, self.frequency(x), budget, excluded, index=(x.postings, x.sizes))
        return chosen, region.prompt(chosen, cards, F.lit(now).cast("timestamp"))

    def retrieve(self, persona_id: str, query: str, now: str, session_id: str = "") -> dict:
        q = self.spark.createDataFrame([(0, persona_id, query)], "query_id long, persona_id string, text string")
        shown = self.seams.injected(session_id)
        excluded = self.spark.createDataFrame([(0, c) for c in shown], "query_id long, card_id string") if shown else None
        chosen, prompts = self.retrieve_many(q, now, excluded)
        rows, text = chosen.orderBy("rank").collect(), prompts.first()
        return {"cards": [r.asDict() for r in rows], "card_ids": [r["card_id"] for r in rows], "prompt_text": text["prompt_text"] if text else "", "search_mode": "region", "total_raw": len(rows)}

    def _encodes(self) -> bool:
        """Whether the encoder answers; where it doesn't, words are compared instead of vectors."""
        if self.seams.encode is None:
            return False
        try:
            self.seams.encode(["?"])
        except Exception:  # noqa: BLE001  a host's model; the fallback is what the caller gets
            return False
        return True

    def _channels(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, str]:
        """Hits (query_id, persona_id, card_id, score) by vectors, or by shared words if there is no encoder, and by full text without legacy cards; the first one's kind."""
        x, cards = self.index(), self.cards.load()
        each = queries.withColumn("part", F.row_number().over(Window.partitionBy("query_id").orderBy("text"))).select(F.struct("query_id", "part").alias("query_id"), "persona_id", "text")
        if self._encodes():
            near, kind = vector.top_k(x.vectors, vector.embed(each, self.seams.encode), 3 * k).withColumnRenamed("sim", "score"), "vector"
        else:
            near, kind = activation.keyword_fallback(cards, each, 3 * k), "keyword"
        near = near.select("query_id.query_id", "persona_id", "card_id", "score")
        if not self.settings.enabled("keyword_match"):
            return near, near.limit(0), kind
        asked = each.select("query_id", "persona_id", words(F.col("text")).alias("terms"))
        literal = fts.bm25(x.postings, x.sizes, asked).select("query_id.query_id", "persona_id", "card_id", self.settings.column("retrieve.fts_score").alias("score"))
        return near, activation.live_hits(literal, cards), kind

    def _activated(self, near: DataFrame, literal: DataFrame, now: str, excluded: DataFrame | None) -> DataFrame:
        cards = self.cards.load()
        hits = activation.gate(activation.merge_channels(near, literal), cards, excluded, self.settings.column("retrieve.threshold"), self.settings.column("retrieve.legacy_threshold"))
        pool = activation.energies(hits.select("query_id", "persona_id", "card_id", F.col("score").alias("sim")), cards, F.lit(now).cast("timestamp"))
        return activation.spread(pool, activation.entity_names(cards))

    def search(self, persona_id: str, texts: list[str], now: str, k: int | None = None, excluded: set[str] | None = None) -> dict:
        """Hybrid retrieval of one host call: ``cards`` (the best k), ``activated`` (up to 2 k), ``search_mode`` and ``total_raw``, the hits before the thresholds.

        search_mode: vector, hybrid (full text has found something too) or keyword (there is no encoder), multi_ before it for several texts.
        """
        k = self.settings.get("retrieve.memory_count", persona_id) if k is None else k
        mode = "disabled" if k <= 0 else "no_query" if not texts else ""
        if mode:
            return {"cards": [], "activated": [], "search_mode": mode, "total_raw": 0}
        q = self.spark.createDataFrame([(0, persona_id, t) for t in texts], "query_id long, persona_id string, text string")
        out = self.spark.createDataFrame([(0, c) for c in excluded], "query_id long, card_id string") if excluded else None
        near, literal, mode = self._channels(q, k)
        mode = ("multi_" if len(texts) > 1 else "") + ("hybrid" if mode == "vector" and not literal.isEmpty() else mode)
        found = self._activated(near, literal, now, out).filter(F.col("rank") <= 2 * k)
        cards = self.store(persona_id).select("persona_id", F.col("id").alias("card_id"), "level", "content")
        rows = [r.asDict() for r in found.join(cards, ["persona_id", "card_id"]).orderBy("rank").collect()]  # 2 k rows
        best = rows[:k]
        if self.seams.rerank is not None and rows:
            full = self.spark.createDataFrame([(0, persona_id, r["card_id"], r["content"], r["energy"], "\n".join(texts)) for r in rows], "query_id long, persona_id string, card_id string, content string, energy double, text string")
            order = {r["card_id"]: r["rank"] for r in rerank(full, self.seams.rerank, k).collect()}
            best = sorted((r for r in rows if r["card_id"] in order), key=lambda r: order[r["card_id"]])
        return {"cards": best, "activated": rows, "search_mode": mode, "total_raw": activation.merge_channels(near, literal).count()}

    def hybrid_many(self, queries: DataFrame, now: str, k: int = 3, excluded: DataFrame | None = None) -> DataFrame:
        """(query_id, persona_id, card_id, energy, rank): vectors and full text merged, gated and spread; reranked if a reranker is there.

        queries: (query_id, persona_id, text); several rows may share a query_id.
        """
        cards = self.cards.load()
        out = self._activated(*self._channels(queries, k)[:2], now, excluded)
        if self.seams.rerank is None:
            return out.filter(F.col("rank") <= k)
        texts = queries.groupBy("query_id").agg(F.min("text").alias("text"))
        full = out.drop("rank").join(texts, "query_id").join(cards.select("persona_id", F.col("id").alias("card_id"), "content"), ["persona_id", "card_id"])
        return rerank(full, self.seams.rerank, k).select("query_id", "persona_id", "card_id", "energy", "rank")

    def widened(self, queries: DataFrame) -> DataFrame:
        """(query_id, persona_id, text): the queries, and for each a further one of its words and those the graph adds to them."""
        x = self.index()
        words_ = expand.build_queries(queries, x.adjacency, x.nodes, x.size)
        more = words_.groupBy("query_id", "persona_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("text"))
        return queries.select("query_id", "persona_id", "text").unionByName(more)

    def review_and_filter(self, persona_id: str, query: str, now: str, k: int = 15, rounds: int = 3) -> list[str]:
        """Ids that the sub-brain keeps of the candidates for a query.

        It may search on, up to ``rounds`` replies, for cards that aren't candidates yet; else the best k stay. Where it breaks off, the
        candidates with enough energy stay.
        """

        def ask_for(text: str) -> DataFrame:
            known = self.spark.createDataFrame([(0, c) for c in pool], "query_id long, card_id string") if pool else None
            return self.hybrid_many(self.spark.createDataFrame([(0, persona_id, text)], "query_id long, persona_id string, text string"), now, 10, known)

        info = self.store(persona_id).select("persona_id", F.col("id").alias("card_id"), activation.candidate_line().alias("line"))
        pool: dict[str, str] = {}
        energy: dict[str, float] = {}

        def add(hits: DataFrame) -> None:
            for r in hits.join(info, ["persona_id", "card_id"]).orderBy("rank").collect():
                energy.setdefault(r["card_id"], r["energy"])
                pool.setdefault(r["card_id"], r["line"])

        add(ask_for(query))
        kept = None
        for _ in range(rounds):
            try:
                said = self.seams.subbrain([query + "\n" + "\n".join(pool.values())], [persona_id])[0]
            except Exception:  # noqa: BLE001  a host's model; the fallback is what the caller gets
                least = self.settings.get("retrieve.fallback_threshold", persona_id)
                kept = [c for c in pool if energy[c] >= least]
                break
            if said is None:
                break
            row = self.spark.createDataFrame([(said, list(pool))], "raw string, ids array<string>").select(parsing.filter_reply(F.col("raw"), F.col("ids")).alias("a")).first()["a"]
            if row["type"] == "keep":
                kept = row["ids"]
                break
            if row["type"] == "search":
                add(ask_for(row["keywords"]))
        kept = list(pool)[:k] if kept is None else kept
        if kept:
            ids = self.spark.createDataFrame([(persona_id, c) for c in kept], "persona_id string, id string")
            shown = self.cards.load().join(ids, ["persona_id", "id"], "left_semi")
            self.cards.patch(store.reference(shown, ids, F.lit(now).cast("timestamp")), texts=False)
        return kept

    def hub_many(self, queries: DataFrame, k: int = 3) -> DataFrame:
        x = self.index()
        sims = vector.top_k(x.vectors, vector.embed(queries.select("query_id", "persona_id", "text"), self.seams.encode), 3 * k)
        return expand.hub_retrieve(queries, sims, x.ledger, x.adjacency, x.nodes, x.size, k)

    def portrait(self, persona_id: str) -> dict:
        rows = region.portraits(self.store(persona_id)).orderBy("at").collect()
        return {"cards": [r.asDict() for r in rows], "tokens": sum(r["tokens"] for r in rows)}

    def ingest(self, messages: DataFrame, now: str) -> dict:
        """Cards from evicted messages (persona_id, session_id, turn, role, content): prompts per session, replies, events, corrections.

        A reply without events changes nothing. Corrections are made after the new cards are there; ``matched`` says to which event of its
        session each one belongs.
        """
        stamp = F.lit(now).cast("timestamp")
        cards = self.cards.load()
        text = maintain.session_prompt(messages)
        who = messages.groupBy("session_id").agg(F.min("persona_id").alias("persona_id"))
        prompts = text.join(who, "session_id").select("session_id", "persona_id", F.concat(F.lit("Messages:\n"), "text").alias("prompt"))
        replies = ask(prompts, self.seams.main_brain).filter("raw IS NOT NULL").select("session_id", "persona_id", "raw")
        path = f"{self.cards.path}/harvest/{uuid.uuid4().hex}"
        replies.write.parquet(path)  # a model isn't asked twice
        replies = self.spark.read.parquet(path)
        events = parsing.memories(replies)
        fixes = parsing.corrections(replies).join(events.select("session_id").distinct(), "session_id", "left_semi")
        matched = maintain.match_corrections(events.withColumnRenamed("session_id", "batch"), fixes.withColumnRenamed("session_id", "batch"))
        last = cards.groupBy("persona_id").agg(F.max("seq").alias("last"))
        numbered = events.join(last, "persona_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("persona_id").orderBy("session_id", "pos")))
        said = F.concat(F.date_format(stamp, "yyyy-MM-dd"), F.lit(" "), time_period(stamp))
        drafts, cap = store.new_cards(numbered.withColumn("source_time", said), stamp), self.settings.column("card.max_tokens")
        long = drafts.filter(estimate_tokens(F.col("content")) > cap).select("persona_id", "id", F.concat(F.lit("Shorten this, keeping what matters:\n\n"), "content").alias("prompt"))
        short = ask(long, self.seams.subbrain).select("persona_id", "id", F.trim("raw").alias("text"))
        short.write.parquet(path := f"{self.cards.path}/harvest/{uuid.uuid4().hex}")
        new = store.fit(drafts, cap, self.spark.read.parquet(path))
        after = maintain.apply_corrections(store.append(cards, new), fixes.withColumn("pos", F.col("pos").cast("int")), now)
        made = [r["id"] for r in new.select("id").collect()]
        if made:
            self.cards.patch(after.filter(F.col("last_updated") == stamp))  # the new and the corrected ones
            self._news(new.select("persona_id", F.col("id").alias("card_id")))
        return {"card_ids": made, "corrections": fixes.count() if made else 0, "events": [r.asDict() for r in events.collect()], "matched": sorted(tuple(r) for r in matched.collect())}

    def _news(self, new: DataFrame) -> None:
        """Raises the counters of the summaries of new cards' (persona_id, card_id) nodes; the index reads the new cards only."""
        summaries = self.summaries.load()
        if not summaries.isEmpty():
            self.summaries.patch(graph.add_news(summaries, self.index().recorded(new), touched=True))

    def review(self, now: str, today: DataFrame | None = None, vectors: DataFrame | None = None) -> dict:
        """The nightly steps for all personas; a step that fails is reported and the next goes on (but for the daily summary).

        today: the day's cards; vectors: (persona_id, seq, embedding), by default from the encoder.
        """
        began, report = time.time(), {"dedup": 0, "archived": 0, "retention_decayed": 0, "retention_zeroed": 0, "summaries_written": 0, "errors": []}
        stamp = F.lit(now).cast("timestamp")
        daily = ask(maintain.daily_drafts(today).withColumnRenamed("text", "prompt"), self.seams.subbrain).filter("raw IS NOT NULL") if today is not None else None

        def dedup() -> None:
            cards = self.cards.load()
            live = cards.filter("NOT coalesce(legacy, false) AND NOT coalesce(is_portrait, false)")
            v = vectors if vectors is not None else self.index().vectors.filter("NOT legacy").select("persona_id", "seq", "embedding")
            gone = vector.superseded(live, vector.pairs_over(v.join(live.select("persona_id", "seq"), ["persona_id", "seq"], "left_semi"), self.settings.column("review.dedup_threshold")))
            ids = live.join(gone, ["persona_id", "seq"], "left_semi").select("persona_id", "id")
            report["dedup"] = ids.count()
            if report["dedup"]:
                ids.write.parquet(path := f"{self.cards.path}/superseded/{uuid.uuid4().hex}")
                ids = self.spark.read.parquet(path)
                self.cards.patch(store.remove(store.remove_links(cards, ids).filter("links_removed > 0"), ids), ids)

        def decay() -> None:
            out = maintain.decay(self.cards.load(), stamp)
            row = out.agg(F.sum(F.col("decayed").cast("long")), F.sum(F.col("zeroed").cast("long"))).first()
            report["retention_decayed"], report["retention_zeroed"] = row[0] or 0, row[1] or 0
            if row[0]:
                self.cards.patch(out.filter("decayed"), texts=False)

        def portraits() -> None:
            if daily is None or daily.isEmpty():
                return
            cards = self.cards.load()
            have = maintain.start_portraits(self.personas.load(), cards, stamp)
            parts = daily.select("persona_id", parsing.portrait_split(F.col("raw")).alias("s"))
            day = parts.select("persona_id", F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p in parsing.PORTRAITS]), F.array(*[F.col(f"s.{p}") for p in parsing.PORTRAITS]))).alias("portrait_type", "summary")).filter("summary IS NOT NULL").withColumn("date", F.lit(now[:10]))
            rolled = maintain.roll_buffers(have, day)
            which = ["persona_id", "portrait_type"]
            notes = F.concat_ws("\n", F.col("mid_term"), F.array_join(F.transform("staging_pool", lambda e: F.concat(F.lit("- ["), F.coalesce(e["date"], F.lit("?")), F.lit("] "), F.coalesce(e["summary"], F.lit("")))), "\n"))
            # a pool that isn't full yet is rewritten if the sub-brain finds that it matters
            unsure = rolled.filter("NOT due AND size(staging_pool) > 0").join(day.select(which), which, "left_semi")
            judged = ask(unsure.select(*which, F.concat(F.lit("Do these notes change the portrait?\n"), notes).alias("prompt")), self.seams.subbrain)
            judged = judged.filter(parsing.staging_judge(F.col("raw"))["should_rewrite"]).select(which)
            due = rolled.filter("due").unionByName(rolled.join(judged, which, "left_semi")).select(*which, notes.alias("prompt"))
            texts = ask(due, self.seams.subbrain, reply="new_mid").withColumn("prompt", F.concat_ws("\n", "new_mid"))
            texts = ask(texts, self.seams.subbrain).withColumn("r", parsing.stable_review(F.col("raw"))).select("persona_id", "portrait_type", "new_mid", F.when(F.col("r.should_update"), F.col("r.new_stable")).alias("new_stable"), F.col("r.reasoning").alias("reasoning"))
            self.cards.patch(self._fitting(conform(maintain.rewrite_portraits(rolled.drop("due"), texts, now))))

        def summaries() -> None:
            cards = self.cards.load()
            x = self.index()
            old = graph.prune_summaries(self.summaries.load(), x.nodes)
            due = graph.summary_candidates(x.nodes, old, self.frequency(x), self.settings.column("summary.min_df"), self.settings.column("summary.min_new"))
            todo = due.filter("action = 'write'")
            inputs = graph.summary_inputs(x.ledger, cards, todo.select("persona_id", F.col("name").alias("node")), self.settings.column("summary.cards"))
            inputs = inputs.join(old.select("persona_id", F.col("node_name").alias("node"), F.col("content").alias("was")), ["persona_id", "node"], "left")
            first, again = F.concat(F.lit("Summarise "), "node", F.lit(":\n"), "cards_text"), F.concat(F.lit("Rewrite the summary of "), "node", F.lit(":\n"), "was", F.lit("\nfrom these cards:\n"), "cards_text")
            prompts = inputs.withColumn("prompt", F.when(F.coalesce("was", F.lit("")) == "", first).otherwise(again))
            said = ask(prompts.select("persona_id", "node", "n_cards", "prompt"), self.seams.subbrain).filter("trim(coalesce(raw, '')) <> ''")
            new = said.select("persona_id", F.col("node").alias("node_name"), F.when(F.trim("raw").startswith("跳过"), "").otherwise(F.trim("raw")).alias("content"), F.col("n_cards").alias("card_count"))
            path = f"{self.summaries.path}/written/{uuid.uuid4().hex}"
            new.write.parquet(path)
            new = self.spark.read.parquet(path)
            report["summaries_written"] = new.filter("content <> ''").count()
            self.summaries.save(graph.save_summaries(graph.settle(old, due), new, now))

        for step in (dedup, decay, portraits, summaries):
            try:
                step()
            except Exception as e:  # noqa: BLE001  reported; the steps don't depend on each other
                report["errors"].append(f"{step.__name__}: {e}"[:200])
        report["elapsed_seconds"] = round(time.time() - began, 2)
        return report

    def migrate(self) -> dict:
        """Deletes the summaries with text that today's gate rejects."""
        old = self.summaries.load()
        judged = graph.migrate_summaries(old, self.frequency(self.index()))
        bad = judged.filter("NOT passes")
        row = judged.agg(F.sum((~F.col("passes")).cast("long")), F.sum(F.col("passes").cast("long"))).first()
        if row[0]:
            self.summaries.save(old.join(bad.select("persona_id", "node_name"), ["persona_id", "node_name"], "left_anti").select(*SUMMARY.names))
        return {"pruned": row[0] or 0, "kept": row[1] or 0}

    def _fitting(self, cards: DataFrame) -> DataFrame:
        """Cards within their persona's token caps."""
        return store.check_size(cards, self.settings.column("card.max_tokens"), self.settings.column("card.max_portrait_tokens"))[0]

    def save_portrait(self, portraits: DataFrame) -> int:
        """Portrait cards put in the place of those of the same persona and type, whose ids and numbers they take."""
        out = self._fitting(conform(store.as_portraits(self.cards.load(), portraits)))
        return self.cards.patch(out)

    def put(self, cards: DataFrame) -> int:
        """Append cards; returns the new generation."""
        before = self.cards.generation
        out = self.cards.patch(self._fitting(conform(cards)))
        had = self.cards.load(before)
        self._news(self.cards.load().join(had.select("persona_id", "id"), ["persona_id", "id"], "left_anti").select("persona_id", F.col("id").alias("card_id")))
        return out


