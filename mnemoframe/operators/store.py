"""Card store: an append-only change log of card versions, and what is done to the current view of it.

Every operator is a function from DataFrames to DataFrames. A table's versions and patches are Parquet folders; a pointer
file is written last, so readers see a whole generation or the one before it.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions.text import clamp, estimate_tokens
from mnemoframe.sources.cards import CARD, EDIT, LINK, conform


def current(log: DataFrame) -> DataFrame:
    """Cards in force of a change log (card columns, version, gone): of each id the last version; the first one's seq stays."""
    w = Window.partitionBy("persona_id", "id")
    rows = log.withColumn("_n", F.row_number().over(w.orderBy(F.desc("version")))).withColumn("seq", F.min("seq").over(w))
    return rows.filter("_n = 1 AND NOT coalesce(gone, false)").drop("_n", "version", "gone")


def _link_array(c: str = "links") -> Column:
    return F.coalesce(F.col(c), F.array().cast(f"array<{LINK}>"))


def check_size(cards: DataFrame, cap: int | Column = 500, portrait_cap: int | Column = 5000) -> tuple[DataFrame, DataFrame]:
    """(cards within the token cap of their kind, those over it)."""
    fits = estimate_tokens(F.col("content")) <= F.when(F.coalesce("is_portrait", F.lit(False)), portrait_cap).otherwise(cap)
    return cards.filter(fits), cards.filter(~fits)


def fit(cards: DataFrame, cap: int | Column = 500, condensed: DataFrame | None = None) -> DataFrame:
    """Cards whose content is over the cap get a condensed text that fits, (persona_id, id, text), or are cut and marked for review."""
    if condensed is not None:
        cards = cards.join(condensed.select("persona_id", "id", F.col("text").alias("_text")), ["persona_id", "id"], "left")
    else:
        cards = cards.withColumn("_text", F.lit(None).cast("string"))
    over = estimate_tokens(F.col("content")) > cap
    helps = over & F.col("_text").isNotNull() & (F.col("_text") != "") & (estimate_tokens(F.col("_text")) <= cap)
    return cards.withColumns({
        "needs_review": F.when(over & ~helps, True).otherwise(F.col("needs_review")),
        "content": F.when(helps, F.col("_text")).when(over, clamp(F.col("content"), cap)).otherwise(F.col("content")),
    }).drop("_text")


def append(cards: DataFrame, new: DataFrame, cap: int = 500, portrait_cap: int = 5000) -> DataFrame:
    """cards with new ones upserted by id; those over the token cap are refused."""
    good, _ = check_size(conform(new), cap, portrait_cap)
    log = cards.withColumns({"version": F.lit(0), "gone": F.lit(False)}).unionByName(good.withColumns({"version": F.lit(1), "gone": F.lit(False)}))
    return current(log)


def update(cards: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """cards with the columns of patches (persona_id, id, ...) set where they aren't null; last_updated is now unless it is patched."""
    cols = [c for c in patches.columns if c not in ("persona_id", "id")]
    p = patches.select("persona_id", "id", *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = cards.join(p, ["persona_id", "id"], "left")
    sets = {c: F.coalesce(F.col(f"_p_{c}"), F.col(c)).cast(CARD[c].dataType) for c in cols}
    stamp = F.when(F.col("_hit"), now).otherwise(F.col("last_updated"))
    sets["last_updated"] = F.coalesce(F.col("_p_last_updated"), stamp) if "last_updated" in cols else stamp
    return out.withColumns(sets).select(*CARD.names)


def remove(cards: DataFrame, ids: DataFrame) -> DataFrame:
    return cards.join(ids.select("persona_id", "id"), ["persona_id", "id"], "left_anti")


def remove_links(cards: DataFrame, ids: DataFrame) -> DataFrame:
    """cards without the links from or to the given (persona_id, id), plus column ``links_removed``."""
    mine = ids.select("persona_id", "id", F.lit(True).alias("_mine"))
    each = cards.select("persona_id", "id", F.posexplode(_link_array()).alias("pos", "link")).join(ids.select("persona_id", F.col("id").alias("_t")), ["persona_id"], "inner").filter(F.col("link.target_id") == F.col("_t"))
    dead = each.groupBy("persona_id", "id").agg(F.collect_set("_t").alias("_dead"))
    out = cards.join(mine, ["persona_id", "id"], "left").join(dead, ["persona_id", "id"], "left")
    none = F.array().cast(f"array<{LINK}>")
    kept = F.when(F.col("_mine"), none).otherwise(F.filter(_link_array(), lambda x: ~F.coalesce(F.array_contains("_dead", x["target_id"]), F.lit(False))))
    return out.withColumn("_kept", kept).withColumn("links_removed", F.size(_link_array()) - F.size("_kept")).withColumn("links", F.col("_kept")).select(*CARD.names, "links_removed")


def supersede(cards: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards without the given ones and the links to them, the old rows)."""
    old = cards.join(ids.select("persona_id", "id"), ["persona_id", "id"], "left_semi")
    return remove(remove_links(cards, ids).drop("links_removed"), ids), old


def add_links(cards: DataFrame, links: DataFrame) -> DataFrame:
    """cards with (persona_id, from_id, target_id, relation, weight) added; a link to the same target is replaced; both ends must be there."""
    there = cards.select("persona_id", F.col("id").alias("target_id"))
    good = links.join(there, ["persona_id", "target_id"], "left_semi")
    new = good.groupBy("persona_id", F.col("from_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("target_id", "relation", F.col("weight").cast("double").alias("weight")))).alias("_new"))
    out = cards.join(new, ["persona_id", "id"], "left")
    targets = F.transform("_new", lambda x: x["target_id"])
    kept = F.filter(_link_array(), lambda x: ~F.array_contains(targets, x["target_id"]))
    return out.withColumn("links", F.when(F.col("_new").isNull(), F.col("links")).otherwise(F.concat(kept, F.col("_new")))).select(*CARD.names)


def linked(cards: DataFrame, ids: DataFrame, least: float = 0.0) -> DataFrame:
    """(persona_id, from_id, target_id, relation, weight): outgoing links of the wanted cards to active cards."""
    out = cards.join(ids.select("persona_id", "id"), ["persona_id", "id"], "left_semi").select("persona_id", F.col("id").alias("from_id"), F.inline("links")).filter(F.col("weight") >= least)
    live = cards.filter("NOT coalesce(legacy, false)").select("persona_id", F.col("id").alias("target_id"))
    return out.join(live, ["persona_id", "target_id"], "left_semi").select("persona_id", "from_id", "target_id", "relation", "weight")


def linked_from(cards: DataFrame, ids: DataFrame, least: float = 0.0) -> DataFrame:
    """The same for incoming links, from active cards."""
    every = cards.filter("NOT coalesce(legacy, false)").select("persona_id", F.col("id").alias("from_id"), F.inline("links")).filter(F.col("weight") >= least)
    return every.join(ids.select("persona_id", F.col("id").alias("target_id")), ["persona_id", "target_id"], "left_semi").select("persona_id", "from_id", "target_id", "relation", "weight")


def reference(cards: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Active cards that were shown: last_referenced is now and the count goes up."""
    out = cards.join(ids.select("persona_id", "id", F.lit(True).alias("_hit")).distinct(), ["persona_id", "id"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.coalesce("legacy", F.lit(False))
    return out.withColumns({"last_referenced": F.when(hit, now).otherwise(F.col("last_referenced")), "reference_count": F.coalesce("reference_count", F.lit(0)) + hit.cast("long")}).select(*CARD.names)


def by_id(cards: DataFrame, ids: DataFrame) -> DataFrame:
    """The cards of (persona_id, id)."""
    return cards.join(ids.select("persona_id", "id").distinct(), ["persona_id", "id"], "left_semi")


def by_level(cards: DataFrame, level: int | None = None, least: int | None = None) -> DataFrame:
    cards = cards.filter("NOT coalesce(legacy, false)")
    cards = cards if level is None else cards.filter(F.col("level") == level)
    return cards if least is None else cards.filter(F.col("level") >= least)


def stats(cards: DataFrame) -> DataFrame:
    """(persona_id, total, active, total_links, has_portrait)."""
    live = ~F.coalesce("legacy", F.lit(False))
    return cards.groupBy("persona_id").agg(
        F.count("*").alias("total"), F.sum(live.cast("long")).alias("active"), F.sum(F.size(_link_array()).cast("long")).alias("total_links"),
        F.max(F.coalesce("is_portrait", F.lit(False)) & live).alias("has_portrait"),
    )


def level_counts(cards: DataFrame) -> DataFrame:
    return cards.filter("NOT coalesce(legacy, false)").groupBy("persona_id", "level").agg(F.count("*").alias("n"))


def new_cards(events: DataFrame, now: Column, source: str = "harvest") -> DataFrame:
    """Cards of (persona_id, seq, session_id, record, subject, topic, retention, source_time) rows; ids follow from what they hold."""
    from mnemoframe.functions.text import stable_id

    created = F.array(F.struct(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("").alias("old_content"), F.lit("created").alias("reason"))).cast(f"array<{EDIT}>")
    return conform(
        events.select(
            "persona_id", "seq", stable_id("c_", F.col("persona_id"), F.col("session_id"), F.col("seq"), F.col("record")).alias("id"), F.lit(0).alias("level"), F.trim("record").alias("content"),
            F.col("subject"), F.col("topic"), F.col("session_id"), F.col("source_time"), F.lit(source).alias("source"), now.alias("created_at"), now.alias("last_updated"),
            F.lit("experience").alias("card_type"), F.coalesce("retention", F.lit(8.0)).alias("retention"), F.lit(0).cast("long").alias("reference_count"), created.alias("edit_history"), F.lit(False).alias("legacy"),
        ).filter("content <> ''")
    )


def as_portraits(cards: DataFrame, portraits: DataFrame) -> DataFrame:
    """portraits (persona_id, portrait_type, content, ...) as cards: with id and seq of the active portrait of their persona and type, or p_<type> and 0."""
    have = cards.filter("is_portrait AND NOT coalesce(legacy, false)").groupBy("persona_id", "portrait_type").agg(F.min(F.struct("seq", "id")).alias("_had"))
    rows = portraits.drop("id", "seq").join(have, ["persona_id", "portrait_type"], "left")
    named = {"id": F.coalesce("_had.id", F.concat(F.lit("p_"), "portrait_type")), "seq": F.coalesce("_had.seq", F.lit(0).cast("long")), "is_portrait": F.lit(True), "legacy": F.lit(False), "level": F.lit(2)}
    return rows.withColumns(named).drop("_had")


class Table:
    """Change log of one table under a folder: whole versions and, after them, the rows that changed since.

    save() writes a whole version, patch() only changed rows; load() folds the patches into the last whole version. Folders
    have names of their own, and a generation's pointer, written last, names its folder; making it fails if the generation is
    there already, so of two writers one is told to try again and nothing is overwritten. ``texts`` is the generation that
    last changed what indexes are made of.
    """

    #: Patches after which the next one writes a whole version.
    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, schema=CARD, keys: tuple[str, ...] = ("persona_id", "id")):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _generations(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/current")):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path(f"{self.path}/current")) if s.getPath().getName().isdigit())

    def _pointer(self, g: int) -> tuple[str, int]:
        """(folder, generation of the texts) of a generation."""
        fs, path = self._fs()
        with_name = fs.open(path(f"{self.path}/current/{g}"))
        try:
            folder, texts = with_name.readUTF().split()
        finally:
            with_name.close()
        return folder, int(texts)

    @property
    def generation(self) -> int:
        return max(self._generations(), default=0)

    @property
    def texts(self) -> int:
        g = self.generation
        return self._pointer(g)[1] if g else 0

    def change(self, g: int) -> tuple[bool, DataFrame | None, DataFrame | None]:
        """(whether it is a whole version, its rows, the keys that are gone) of what generation g changed in the texts; None for no such change."""
        folder, texts = self._pointer(g)
        whole = folder.startswith("v")
        if texts != g:
            return whole, None, None
        if whole:
            return True, self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}"), None
        log = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType())])).parquet(f"{self.path}/{folder}")
        return False, log.filter("NOT gone").drop("gone"), log.filter("gone").select(*self.keys)

    def _parts(self, g: int) -> tuple[str | None, list[str]]:
        """Folder of the last whole version up to generation g and those of the patches since, oldest first."""
        patches: list[str] = []
        for k in range(g, 0, -1):
            folder = self._pointer(k)[0]
            if folder.startswith("v"):
                return folder, patches[::-1]
            patches.append(folder)
        return None, patches[::-1]

    def load(self, generation: int | None = None) -> DataFrame:
        whole, patches = self._parts(self.generation if generation is None else generation)
        base = self.spark.createDataFrame([], self.schema) if whole is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{whole}")
        if not patches:
            return base
        logged = T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType())])
        log = None
        for n, folder in enumerate(patches):
            part = self.spark.read.schema(logged).parquet(f"{self.path}/{folder}").withColumn("_version", F.lit(n))
            log = part if log is None else log.unionByName(part)
        of_key = Window.partitionBy(*self.keys)
        log = log.withColumn("_n", F.row_number().over(of_key.orderBy(F.desc("_version"))))
        if "seq" in self.schema.names:
            log = log.withColumn("seq", F.min("seq").over(of_key))
        log = log.filter("_n = 1").drop("_n", "_version")
        # the base's rows stay where they are: the patches are the small side of both joins
        touched = log.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])
        if "seq" in self.schema.names:
            first = base.join(touched, same, "left_semi").groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(F.min("seq").alias("_seq"))
            log = log.join(first, same, "left").withColumn("seq", F.least("seq", "_seq"))
        rows = log.filter("NOT coalesce(gone, false)").select(*self.schema.names)
        return base.join(touched, same, "left_anti").unionByName(rows)

    def _point(self, g: int, folder: str, texts: int) -> int:
        fs, path = self._fs()
        out = fs.create(path(f"{self.path}/current/{g}"), False)  # an error if another writer made this generation
        out.writeUTF(f"{folder} {texts}")
        out.close()
        return g

    def save(self, df: DataFrame) -> int:
        """A whole version; returns its generation."""
        g = self.generation + 1
        folder = f"v{g}-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        return self._point(g, folder, g)

    def patch(self, changed: DataFrame | None = None, gone: DataFrame | None = None, texts: bool = True) -> int:
        """Rows that are new or changed, whole, and the keys of those that are gone; texts: whether what is indexed may have changed."""
        g, had = self.generation + 1, self.texts
        folder = f"p{g}-{uuid.uuid4().hex}"
        log = self.spark.createDataFrame([], self.schema) if changed is None else changed.select(*self.schema.names)
        log = log.withColumn("gone", F.lit(False))
        if gone is not None:
            log = log.unionByName(gone.select(*self.keys).withColumn("gone", F.lit(True)), allowMissingColumns=True)
        log.write.parquet(f"{self.path}/{folder}")
        self._point(g, folder, g if texts else had)
        if len(self._parts(g)[1]) < self.COMPACT:
            return g
        whole = f"v{g + 1}-{uuid.uuid4().hex}"
        self.load(g).write.parquet(f"{self.path}/{whole}")
        return self._point(g + 1, whole, g if texts else had)

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that the last ``keep`` generations don't need."""
        fs, path = self._fs()
        g = self.generation
        needed = set()
        for k in range(max(1, g - keep + 1), g + 1):
            whole, patches = self._parts(k)
            needed |= {whole, *patches}
        for s in fs.listStatus(path(self.path)) if g else []:
            name = s.getPath().getName()
            if name[0] in "vp" and name.split("-")[0][1:].isdigit() and int(name.split("-")[0][1:]) <= g and name not in needed:
                fs.delete(s.getPath(), True)
