"""Index of a card table that grows with it: each change of the cards adds a segment made of the changed cards alone.

A segment holds the postings and ledger rows of its cards, the keys of the cards it replaces or removes, and what that changes in the
counts: of nodes, edges, words and sizes. Readers add the counts up and leave out rows that a later segment replaces. When there are many
segments, the late ones are folded into one, and all of them where the late ones have grown large. A term's weight comes from a fixed IDF
table, so cards that are in the index don't change when others come. A small change's tables are written with it, those of a large one
when they are first asked for, so that a question makes only the tables that it reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.text import card_text
from mnemoframe.sources.cards import searchable

from . import fts, graph, vector
from .index import cleaned
from .store import Table

KEYS = ["persona_id", "card_id"]
#: Segments after which they are folded; the share of the first one that the others may reach before all become one; keys that are looked for one by one; keys that
#: are broadcast (some 250 MB), so that postings needn't be shuffled to find those of changed cards.
FOLD, SHARE, FEW, MANY = 8, 0.25, 500, 2_000_000
COUNTS = {"nodes": (["persona_id", "name"], ["df"]), "edges": (["persona_id", "a", "b"], ["weight"]), "words": (["word"], ["gf"]), "sizes": (["persona_id"], ["n", "tokens", "graphed"])}
ROWS = ("postings", "ledger")


class Segments:
    """The index of the present generation of ``cards``.

    encode: gives vectors of texts. idf: (term, idf) as content_terms() takes it; by default it is made of the cards that are there
    first, and kept. tokens and terms: tokenizers of full text and of the graph.
    """

    def __init__(self, spark: SparkSession, cards: Table, encode: Callable | None = None, idf: DataFrame | None = None, tokens: Column | None = None, terms: Column | None = None):
        self.spark, self.cards, self.encode, self.path = spark, cards, encode, f"{cards.path}/index"
        self._idf, self.tokens, self.terms = idf, tokens, terms
        self._touched: dict[str, int] = {}
        self._lock = Lock()

    # -- files: a pointer is made last and never overwritten, so readers see whole segments only

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _point(self, name: str, text: str) -> bool:
        """Whether this call has made the pointer."""
        try:
            out = self._fs().create(self._path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.writeUTF(text)
        out.close()
        return True

    def _pointed(self, name: str) -> str | None:
        if not self._fs().exists(self._path(name)):
            return None
        f = self._fs().open(self._path(name))
        try:
            return f.readUTF()
        finally:
            f.close()

    def _kept(self, folder: str, name: str) -> DataFrame:
        """A table of a segment, which the first who asks for it makes."""
        path, fs = self._path(f"{folder}/{name}"), self._fs()
        if not fs.exists(path):
            draft = f"_{name}-{uuid.uuid4().hex}"
            self._write(folder, draft, self._made(folder, name))
            fs.rename(self._path(f"{folder}/{draft}"), path)  # if another writer was first, its table is as good
        return self.spark.read.parquet(f"{self.path}/{folder}/{name}")

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that the first who asks for it makes."""
        folder = self._pointed(name)
        if folder is None:
            draft = f"{name}-{uuid.uuid4().hex}"
            rows = make()
            with cleaned(self.spark):
                rows.write.parquet(f"{self.path}/{draft}")
            folder = draft if self._point(name, draft) else self._pointed(name)
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def state(self) -> tuple[int, int, list[str]]:
        """(number of the pointer, generation of the cards, folders of the segments, oldest first)."""
        fs, top = self._fs(), self._path("current")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(top) if s.getPath().getName().isdigit()] if fs.exists(top) else []
        if not numbers:
            return 0, 0, []
        generation, *folders = self._pointed(f"current/{max(numbers)}").split()
        return max(numbers), int(generation), folders

    # -- writing

    @property
    def idf(self) -> DataFrame:
        with self._lock:
            if self._idf is None:
                first = self._pointed("first")  # the segments that were there when the index began
                self._idf = self._once("idf", lambda: graph.idf_table(self.cards.load() if first is None else self._valid("cards", first.split()), self.terms))
            return self._idf

    def refresh(self) -> Segments:
        """Brings the index to the present generation; reads the cards that changed since, no others."""
        while True:
            number, at, folders = self.state()
            now = self.cards.generation
            if at == now:
                return self
            for g in range(at + 1, now + 1):
                whole, changed, gone = self.cards.change(g)
                if changed is None:
                    continue  # no texts changed
                folders = [self._segment(f"s{g}", changed, None, [])] if whole else [*folders, self._segment(f"s{g}", changed, gone, folders)]
                if len(folders) > FOLD:
                    folders = self._folded(folders)
            if not number and self._idf is None:
                self._point("first", " ".join(folders))
            self._point(f"current/{number + 1}", " ".join([str(now), *folders]))  # if another was first, its segments are as good

    def _write(self, folder: str, name: str, rows: DataFrame) -> None:
        with cleaned(self.spark):
            rows.write.option("parquet.bloom.filter.enabled#card_id", "true").parquet(f"{self.path}/{folder}/{name}")

    def _make_all(self, folders: list[str], names: tuple[str, ...]) -> None:
        """Side by side, as the jobs of a small change are short."""
        if "ledger" in names:
            self.idf
        with ThreadPoolExecutor(max(1, len(folders) * len(names))) as pool:
            list(pool.map(lambda t: self._kept(*t), [(f, n) for f in folders for n in names]))

    def _segment(self, name: str, changed: DataFrame, gone: DataFrame | None, before: list[str]) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        self._write(folder, "cards", changed)
        keys = self._read(folder, "keys")
        self._write(folder, "touched", keys if gone is None else keys.unionByName(gone.select("persona_id", F.col("id").alias("card_id"))).distinct())
        self._point(f"{folder}/before", " ".join(before))
        if self._count([folder]) <= FEW:
            self._make_all([folder], ROWS)
            self._make_all([folder], tuple(COUNTS))
        return folder

    def _made(self, folder: str, name: str) -> DataFrame:
        """A segment's table, from its cards and the segments before it."""
        before = (self._pointed(f"{folder}/before") or "").split()
        if name in ROWS:
            cards = self.spark.read.parquet(f"{self.path}/{folder}/cards")
            if name == "postings":
                return (fts.postings(cards) if self.tokens is None else fts.postings(cards, self.tokens)).sortWithinPartitions("persona_id", "term")
            plain = cards.filter("NOT coalesce(is_portrait, false)")
            return graph.ledger(plain, graph.content_terms(plain, tokens=self.terms, idf=self.idf)).sortWithinPartitions("persona_id", "node")
        new = lambda n: self._read(folder, n)
        if not before:
            return self._counted(name, new)
        # the rows of these cards that were valid so far, and the keys of those that were there
        touched, many = new("touched"), self._count([folder]) > MANY
        few = touched.limit(FEW + 1).collect()
        return self._delta(name, new, lambda n: self._of(n, before, touched, few, many))

    def _counted(self, name: str, of: Callable[[str], DataFrame]) -> DataFrame:
        """What the rows ``of`` gives add to the counts."""
        if name == "nodes":
            return graph.nodes(of("ledger"))
        if name == "edges":
            return graph.edges(of("ledger"))
        if name == "words":
            return of("postings").groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("gf"))
        n = of("keys").groupBy("persona_id").agg(F.count("*").alias("n"))
        tokens = of("postings").groupBy("persona_id").agg(F.sum("tf").alias("tokens"))
        graphed = of("ledger").groupBy("persona_id").agg(F.count_distinct("card_id").alias("graphed"))
        return n.join(tokens, "persona_id", "left").join(graphed, "persona_id", "left").na.fill(0)

    def _delta(self, name: str, new: Callable[[str], DataFrame], old: Callable[[str], DataFrame]) -> DataFrame:
        """What the new rows add to the counts and the old ones take from them. last_seen only ever goes up."""
        (by, sums), plus = COUNTS[name], self._counted(name, new)
        minus = self._counted(name, old).select(*[(-F.col(c)).alias(c) if c in sums else F.lit(None).cast("timestamp").alias(c) if c == "last_seen" else c for c in plus.columns])
        seen = [F.max("last_seen").alias("last_seen")] if "last_seen" in plus.columns else []
        return plus.unionByName(minus).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *seen)

    def _folded(self, folders: list[str]) -> list[str]:
        """The late segments as one; all as one where the late ones have more than a share of the first one's postings."""
        count = lambda fs: sum(self._kept(f, "postings").count() for f in fs)
        for names in (ROWS, tuple(COUNTS)):  # what is folded may be needed to make them
            self._make_all(folders, names)
        first = 0 if count(folders[1:]) > SHARE * count(folders[:1]) else 1
        some, folder = folders[first:], f"f-{uuid.uuid4().hex}"
        for name in ("cards", *ROWS):
            self._write(folder, name, self._valid(name, some))
        self._write(folder, "touched", reduce(DataFrame.unionByName, [self._read(f, "touched") for f in some]).distinct())
        for name in COUNTS:
            self._write(folder, name, self._summed(name, some))
        return [*folders[:first], folder]

    # -- reading

    def _read(self, folder: str, name: str) -> DataFrame:
        if name == "keys":
            return self.spark.read.parquet(f"{self.path}/{folder}/cards").select("persona_id", F.col("id").alias("card_id"))
        rows = self._kept(folder, name)
        return rows.withColumnRenamed("id", "card_id") if name == "cards" else rows

    def _count(self, folders: list[str]) -> int:
        """Keys that segments touch; their tables don't change."""
        for f in folders:
            if f not in self._touched:
                self._touched[f] = self._read(f, "touched").count()
        return sum(self._touched[f] for f in folders)

    def _of(self, name: str, folders: list[str], keys: DataFrame, few: list, many: bool = True) -> DataFrame:
        """The valid rows of some cards. Up to FEW are looked for by value, so that files and row groups without them aren't read. many: too many keys to broadcast."""
        rows = self._valid(name, folders)
        if len(few) <= FEW:
            rows = rows.filter(F.col("card_id").isin([r["card_id"] for r in few]))
        return rows.join(keys.hint("broadcast") if len(few) <= FEW or not many else keys, KEYS, "left_semi")

    def _left(self, rows: DataFrame, folders: list[str]) -> DataFrame:
        """rows with the number of their segment (_s), without those of cards that a later one replaces or removes."""
        if len(folders) > 1:
            late = reduce(DataFrame.unionByName, [self._read(f, "touched").withColumn("_t", F.lit(i)) for i, f in enumerate(folders) if i]).groupBy(*KEYS).agg(F.max("_t").alias("_t"))
            rows = rows.join(late.hint("broadcast") if self._count(folders[1:]) <= MANY else late, KEYS, "left").filter("_t IS NULL OR _t <= _s").drop("_t")
        return rows.drop("_s")

    def _valid(self, name: str, folders: list[str]) -> DataFrame:
        """Rows of all segments but those of cards that a later one replaces or removes."""
        each = [self._read(f, name).withColumn("_s", F.lit(i)) for i, f in enumerate(folders)]
        rows = self._left(reduce(DataFrame.unionByName, each), folders)
        return rows.withColumnRenamed("card_id", "id") if name == "cards" else rows

    def _summed(self, name: str, folders: list[str]) -> DataFrame:
        by, sums = COUNTS[name]
        rows = reduce(DataFrame.unionByName, [self._read(f, name) for f in folders])
        seen = [F.max("last_seen").alias("last_seen")] if "last_seen" in rows.columns else []
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *seen) if len(folders) > 1 else rows

    def _folders(self) -> list[str]:
        """The segments of the present generation."""
        folders = self.refresh().state()[2]
        if not folders:  # nothing was ever put in
            self.cards.save(self.cards.load())
            folders = self.refresh().state()[2]
        return folders

    def _table(self, name: str) -> DataFrame:
        folders = self._folders()
        self._make_all(folders, ROWS if name == "sizes" else ("postings",) if name in ("postings", "words") else ("ledger",))
        if name in ROWS:
            return self._valid(name, folders)
        self._make_all(folders, (name,))
        return self._summed(name, folders).filter(" OR ".join(f"{c} <> 0" for c in COUNTS[name][1]))

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def ledger(self) -> DataFrame:
        return self._table("ledger")

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def adjacency(self) -> DataFrame:
        return graph.adjacency(self.edges)

    @property
    def sizes(self) -> DataFrame:
        """(persona_id, n, avgdl)."""
        return self._table("sizes").filter("n > 0").select("persona_id", "n", (F.col("tokens") / F.col("n")).alias("avgdl"))

    @property
    def size(self) -> DataFrame:
        """(persona_id, n): cards in the graph."""
        return self._table("sizes").filter("graphed > 0").select("persona_id", F.col("graphed").alias("n"))

    @property
    def frequency(self) -> DataFrame:
        """(word, gf): how often the cards' texts hold each word."""
        return self._table("words")

    @property
    def vectors(self) -> DataFrame:
        """(persona_id, card_id, seq, legacy, embedding) of the searchable cards; a segment's cards are encoded when they are first asked for."""
        text = card_text(F.coalesce("content", F.lit("")), F.col("keywords"), F.col("tags"))

        def encoded(folder: str) -> DataFrame:
            rows = searchable(self.spark.read.parquet(f"{self.path}/{folder}/cards")).select("persona_id", F.col("id").alias("card_id"), "seq", F.coalesce("legacy", F.lit(False)).alias("legacy"), text.alias("text"))
            return self._once(f"{folder}/vectors", lambda: vector.embed(rows, self.encode).select("persona_id", "card_id", "seq", "legacy", "embedding"))

        folders = self._folders()
        each = [encoded(f).withColumn("_s", F.lit(i)) for i, f in enumerate(folders)]
        return self._left(reduce(DataFrame.unionByName, each), folders)

    def recorded(self, cards: DataFrame) -> DataFrame:
        """Ledger rows of (persona_id, card_id)."""
        folders = self._folders()
        self._make_all(folders, ("ledger",))
        keys = cards.select(*KEYS).distinct()
        return self._of("ledger", folders, keys, keys.limit(FEW + 1).collect())

    def vacuum(self) -> None:
        """Delete the folders and pointers that the present state doesn't need."""
        number, _, folders = self.state()
        fs = self._fs()
        if number:
            self.idf  # may yet have to be made of folders that go
        for s in fs.listStatus(self._path("")) if number else []:
            name = s.getPath().getName()
            if name[0] in "sf" and "-" in name and name not in folders:
                fs.delete(s.getPath(), True)
        for s in fs.listStatus(self._path("current")) if number else []:
            if s.getPath().getName().isdigit() and int(s.getPath().getName()) < number:
                fs.delete(s.getPath(), False)
