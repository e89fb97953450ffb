"""Stored indexes of a version of the cards: postings, ledger, graph and vectors, built once and read by every question."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.text import card_text, words
from mnemoframe.sources.cards import searchable

from . import fts, graph, vector


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="mnemoframe-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark setting: shuffle files of a query are deleted at its end, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing = Lock(), []


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that are begun meanwhile, by any thread, leave no shuffle files; the setting is as before when the last is done."""
    with _lock:
        _writing.append(_writing[0] if _writing else spark.conf.get(CLEAN_UP, "false"))
        spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            before = _writing.pop()
            if not _writing:
                spark.conf.set(CLEAN_UP, before)


class Index:
    """Tables under ``path``; each is written when it is first asked for, and found there by everyone after.

    cards: called for the version of the cards that the index is of. encode: gives vectors of the cards' texts.
    """

    def __init__(self, spark: SparkSession, path: str, cards: Callable[[], DataFrame], encode: Callable | None = None):
        self.spark, self.path, self.cards, self.encode = spark, path.rstrip("/"), cards, encode

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            draft = f"{self.path}/_{name}-{uuid.uuid4().hex}"
            rows = make()
            with cleaned(self.spark):
                rows.write.parquet(draft)
            fs.rename(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(draft), path)  # if another writer was first, its table is as good
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        """All cards' postings, sorted by persona and term within files, so that a question reads few row groups. Written where they are made: a shuffle would take twice their room."""
        return self._table("postings", lambda: fts.postings(self.cards()).sortWithinPartitions("persona_id", "term"))

    @property
    def sizes(self) -> DataFrame:
        return self._table("sizes", lambda: fts.sizes(self.cards(), index=self.postings))

    @property
    def ledger(self) -> DataFrame:
        scratch, made = f"dfs-{uuid.uuid4().hex}", []

        def make() -> DataFrame:
            cards = self.cards().filter("NOT coalesce(is_portrait, false)")
            made.append(scratch)
            return graph.ledger(cards, graph.content_terms(cards, dfs=self._table(scratch, lambda: graph.term_cards(cards))))

        out = self._table("ledger", make)
        if made:  # nothing else reads it
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{scratch}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return out

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes", lambda: graph.nodes(self.ledger))

    @property
    def edges(self) -> DataFrame:
        return self._table("edges", lambda: graph.edges(self.ledger))

    @property
    def adjacency(self) -> DataFrame:
        return graph.adjacency(self.edges)

    @property
    def size(self) -> DataFrame:
        return self._table("size", lambda: graph.corpus_size(self.ledger))

    @property
    def frequency(self) -> DataFrame:
        """(word, gf): how often the cards' contents hold each word."""
        return self._table("frequency", lambda: self.cards().select(F.explode(words(F.col("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("gf")))

    @property
    def vectors(self) -> DataFrame:
        """(persona_id, card_id, seq, legacy, embedding) of the searchable cards, from content, keywords and tags."""

        def make() -> DataFrame:
            text = card_text(F.coalesce("content", F.lit("")), F.col("keywords"), F.col("tags"))
            rows = searchable(self.cards()).select("persona_id", F.col("id").alias("card_id"), "seq", F.coalesce("legacy", F.lit(False)).alias("legacy"), text.alias("text"))
            return vector.embed(rows, self.encode).select("persona_id", "card_id", "seq", "legacy", "embedding")

        return self._table("vectors", make)
