"""Folders of card stores: a Spark data source over each persona's SQLite files, and the files that describe personas.

The folder and what lies in it must be visible to the driver and all executors under one path.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .cards import RESERVED, from_json_rows

FORMAT = "cardstores"
COLUMNS = {"persona_id": pa.string(), "seq": pa.int64(), "id": pa.string(), "data": pa.string()}
#: Bytes of stores that one task reads, about; rows of a batch; values of a filter that a store looks up; stores a task holds open.
SPLIT_BYTES, BATCH, LOOKED_UP, OPEN = 32 << 20, 500, 1000, 64
#: Bytes of a batch that a task writes, about; KB of pages that a store being written holds before they go to its file.
BATCH_BYTES, PAGES_KB = 4 << 20, 512


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it and cards coming to its writers in small batches."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(key, str(most))
    spark.dataSource.register(CardStores)


def local(path: str) -> Path:
    """path as one of the file system; SQLite can't open others."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"card stores lie in a file system, not under {url.scheme}:")
    return Path(unquote(url.path) if url.scheme else path)


def is_persona(name: str) -> bool:
    return bool(name) and not name.startswith(("_", ".")) and name not in RESERVED and "/" not in name


@dataclass
class Piece(InputPartition):
    """(persona, file, k, n): the k-th of n ranges of rows of each file."""

    stores: list[tuple[str, str, int, int]]


class CardStores(DataSource):
    """``spark.read.format("cardstores").load(base)``: persona_id, seq (the row's place in its file), id, data (JSON) of every card.

    Each folder of base is a persona but those whose name begins with an underscore or is reserved; its stores are the files
    cards*.db in it. A schema of some of the columns reads only these. Equalities on persona_id skip the other folders
    unopened, those on id are looked up by the stores' keys. The option ``modifiedSince`` (ISO time, UTC if it names no zone)
    leaves out the personas none of whose stores was written at that time or later; of others all stores are read, as cards link to each other. Small files share a task, large ones are read in ranges. A
    base without stores gives no rows, and a file that isn't a store fails the read. Bytes that aren't UTF-8 are replaced.

    Written cards (persona_id, id, data) go to one new file for each task and persona, so no persona has to fit into a task.
    Files appear when the whole write is done; a task that is run again leaves nothing twice
    (what tasks of a failed write leave lies in folders _drafts-*, which nobody reads). ``overwrite`` deletes the files that
    were there. Rows without id or with a persona that can't be a folder fail the write. Of rows of one persona and id
    within a task the last stays; rows spread over tasks all stay, so let keys be distinct.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "persona_id string, seq bigint, id string, data string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return StoreReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return StoreWriter(self.options, schema, overwrite)


def _open(file: str) -> sqlite3.Connection:
    """A store for reading only. Without a log beside it nobody writes, so it needs no lock files."""
    still = "" if os.path.exists(f"{file}-wal") else "&immutable=1"
    con = sqlite3.connect(f"{Path(file).absolute().as_uri()}?mode=ro{still}", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def modified(time: str) -> float:
    t = datetime.fromisoformat(time)
    return (t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp()


def last_write(file: Path) -> float:
    """When a store or the log beside it was written."""
    try:
        log = os.stat(f"{file}-wal").st_mtime
    except FileNotFoundError:
        log = 0.0
    return max(file.stat().st_mtime, log)


class StoreReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.base = str(local(options["path"]))
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        self.since = modified(options["modifiedsince"]) if "modifiedsince" in options else None
        self.columns = schema.fieldNames()
        if unknown := set(self.columns) - set(COLUMNS):
            raise ValueError(f"a card store has no columns {sorted(unknown)}")
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("persona_id",), ("id",)) or len(values) > LOOKED_UP:
                yield f
            else:
                at = f.attribute[0]
                self.only[at] = self.only.get(at, values) & values

    def partitions(self) -> list[Piece]:
        out, some, held = [], [], 0
        wanted = self.only.get("persona_id")
        with os.scandir(self.base) as entries:
            names = sorted(e.name for e in entries if is_persona(e.name) and (wanted is None or e.name in wanted) and e.is_dir())
        for name in names:
            files = sorted(Path(self.base, name).glob("cards*.db"))
            if self.since is not None and all(last_write(f) < self.since for f in files):
                continue
            for file in files:
                size = file.stat().st_size
                n = 1 if "id" in self.only else -(-size // self.size) or 1
                if n > 1:
                    out += [Piece([(name, str(file), k, n)]) for k in range(n)]
                    continue
                if some and held + size > self.size:
                    out.append(Piece(some))
                    some, held = [], 0
                some.append((name, str(file), 0, 1))
                held += size
        return out + [Piece(some)] if some or not out else out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        # SQLite's own names for what a row is read from; the persona is the folder's
        source = {"persona_id": "?", "seq": "rowid", "id": "CAST(id AS TEXT)", "data": "CAST(data AS TEXT)"}
        columns = ", ".join(source[c] for c in self.columns) or "1"
        schema = pa.schema([(c, COLUMNS[c]) for c in self.columns])
        ids = sorted(x for x in self.only.get("id", ()) if x is not None)
        for persona, file, k, n in piece.stores:
            con = _open(file)
            try:
                values = [persona] * self.columns.count("persona_id")
                if "id" in self.only:
                    where, values = f"id IN ({', '.join('?' * len(ids))})", values + ids
                else:
                    least, most = con.execute("SELECT min(rowid), max(rowid) FROM cards").fetchone()
                    if least is None:
                        continue
                    step = -(-(most - least + 1) // n)
                    where, values = "rowid BETWEEN ? AND ?", [*values, least + k * step, min(least + (k + 1) * step - 1, most)]
                rows = con.execute(f"SELECT {columns} FROM cards WHERE {where}", values)
                while batch := rows.fetchmany(BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in batch], t) for i, t in enumerate(schema.types)], schema=schema)
            finally:
                con.close()


@dataclass
class Drafts(WriterCommitMessage):
    files: list[tuple[str, str]]


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.base, self.overwrite = str(local(options["path"])), overwrite
        if missing := {"persona_id", "id", "data"} - set(schema.fieldNames()):
            raise ValueError(f"cards to store lack the columns {sorted(missing)}")
        self.drafts = f"{self.base}/_drafts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Drafts:
        task = uuid.uuid4().hex
        folder = Path(self.drafts, task)
        folder.mkdir(parents=True)
        files: dict[str, str] = {}
        held: dict[str, sqlite3.Connection] = {}

        def store(persona: str) -> sqlite3.Connection:
            if persona not in held:
                if len(held) >= OPEN:
                    close(next(iter(held)))
                file = files.setdefault(persona, str(folder / f"{len(files)}.db"))
                con = sqlite3.connect(file)
                con.execute("PRAGMA journal_mode=MEMORY")
                con.execute(f"PRAGMA cache_size=-{PAGES_KB}")
                con.execute("CREATE TABLE IF NOT EXISTS cards (id TEXT PRIMARY KEY, data TEXT NOT NULL)")
                held[persona] = con
            return held[persona]

        def close(persona: str) -> None:
            con = held.pop(persona)
            con.commit()
            con.close()

        try:
            for b in batches:
                for at in range(0, b.num_rows, BATCH):  # a batch may be larger than asked for
                    part = b.slice(at, BATCH)
                    for persona, card, data in zip(*(part[c].to_pylist() for c in ("persona_id", "id", "data"))):
                        if persona is None or not is_persona(persona) or card is None:
                            raise ValueError(f"card {card!r} of persona {persona!r} can't be stored")
                        store(persona).execute("INSERT OR REPLACE INTO cards VALUES (?, ?)", (card, data or ""))
            for persona in list(held):
                close(persona)
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Drafts(sorted(files.items()))

    def commit(self, messages: list[Drafts | None]) -> None:
        old = [f for d in Path(self.base).iterdir() if is_persona(d.name) for f in d.glob("cards*.db*")] if self.overwrite and os.path.isdir(self.base) else []
        for persona, draft in (f for m in messages if m for f in m.files):
            Path(self.base, persona).mkdir(parents=True, exist_ok=True)
            os.replace(draft, Path(self.base, persona, f"cards-{uuid.uuid4().hex}.db"))
        for f in old:
            f.unlink(missing_ok=True)
        shutil.rmtree(self.drafts, ignore_errors=True)

    def abort(self, messages: list[Drafts | None]) -> None:
        shutil.rmtree(self.drafts, ignore_errors=True)


def read_cards(spark: SparkSession, base: str, since: str | None = None) -> DataFrame:
    """Cards of all stores under base in today's schema (from_json_rows); what can't be read as JSON or has no id is skipped.

    With ``since``, of the personas with a store that was written at that time or later.
    """
    register(spark)
    reader = spark.read.format(FORMAT)
    return from_json_rows((reader if since is None else reader.option("modifiedSince", since)).load(base))


def _files(spark: SparkSession, base: str, names: str) -> DataFrame:
    """(persona_id, file, content) of the files of base's persona folders whose name matches; file is the path in the folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(base)
    inner = F.col("path").substr(F.lit(len(root) + 2), F.length("path"))
    df = df.select(F.split(inner, "/", 2).alias("at"), "content").filter(F.size("at") == 2)
    df = df.select(F.col("at")[0].alias("persona_id"), F.col("at")[1].alias("file"), "content")
    return df.filter(~F.col("persona_id").startswith("_") & ~F.col("persona_id").isin(*RESERVED))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(profile, provider, model) of the *.yml files of a folder; those that can't be read or name no provider are skipped.

    A profile without a name takes its file's; of several of one name, the last by path counts.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        text = lambda v: None if v is None else str(v)
        for frame in frames:
            out = []
            for at, content in zip(frame["path"], frame["content"]):
                try:
                    data = yaml.safe_load(bytes(content).decode("utf-8"))
                except (yaml.YAMLError, UnicodeDecodeError):
                    continue
                if isinstance(data, dict) and data.get("provider"):
                    out.append((at, text(data.get("name")) or Path(at).stem, text(data["provider"]), text(data.get("model"))))
            yield pd.DataFrame(out, columns=["path", "profile", "provider", "model"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yml").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "path string, profile string, provider string, model string")
    last = rows.groupBy("profile").agg(F.max_by(F.struct("provider", "model"), "path").alias("p"))
    return last.select("profile", "p.provider", "p.model")


META = "display_name string, user_display_name string, user_id string, provider string, model string, profile string, system_prompt_template string"
RULES = "inner_active boolean, proactive boolean, visibility_default string, social_active boolean"


def read_personas(spark: SparkSession, base: str, profiles: DataFrame | None = None, default_user: str = "default") -> DataFrame:
    """One row per persona: its folder's name with what persona_meta.json and reflection/config.json say, else the defaults.

    Every folder that holds a file is a persona, but those whose name begins with an underscore or is reserved. Files that
    can't be read count as missing. user_id is null where no user has a name. provider and model come from the
    persona, else from its (first) profile among ``profiles`` (profile, provider, model), else ``local`` and empty.
    """
    folders = _files(spark, base, "*").select("persona_id").distinct()
    files = _files(spark, base, "{persona_meta,config}.json").withColumn("text", F.decode("content", "UTF-8"))
    of = lambda name, schema, alias: files.filter(F.col("file") == name).select("persona_id", F.from_json("text", schema).alias(alias))
    df = folders.join(of("persona_meta.json", META, "m"), "persona_id", "left").join(of("reflection/config.json", RULES, "r"), "persona_id", "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    listed = F.from_json("m.profile", "array<string>")[0]
    df = df.withColumn("_profile", F.when(F.col("m.profile").startswith("["), listed).otherwise(given("m.profile")))
    if profiles is None:
        df = df.withColumn("_provider", F.lit(None).cast("string")).withColumn("_model", F.lit(None).cast("string"))
    else:
        df = df.join(profiles.select(F.col("profile").alias("_profile"), F.col("provider").alias("_provider"), F.col("model").alias("_model")), "_profile", "left")
    own, no = given("m.provider"), F.lit(False)
    return df.select(
        "persona_id", F.lit("persona").alias("kind"), F.coalesce("m.display_name", "persona_id").alias("display_name"),
        F.coalesce("m.user_display_name", F.lit("")).alias("user_display_name"),
        F.when(given("m.user_display_name").isNotNull(), F.coalesce(given("m.user_id"), F.lit(default_user))).alias("user_id"),
        F.coalesce("m.system_prompt_template", F.lit("")).alias("system_prompt_template"),
        F.coalesce(own, "_provider", F.lit("local")).alias("provider"),
        F.coalesce(given("m.model"), F.when(own.isNull(), F.col("_model")), F.lit("")).alias("model"),
        F.coalesce("r.inner_active", no).alias("inner_active"), F.coalesce("r.proactive", no).alias("proactive"),
        F.coalesce("r.visibility_default", F.lit("visible")).alias("visibility_default"), F.coalesce("r.social_active", no).alias("social_active"),
    )


def write_personas(personas: DataFrame, base: str) -> None:
    """Each persona's persona_meta.json, and reflection/config.json where it has such columns; null fields are left out, files replaced whole."""
    root = str(local(base))
    some = lambda schema: [c for c in (f.split()[0] for f in schema.split(", ")) if c in personas.columns]
    rules = some(RULES)
    rows = personas.select(
        "persona_id", F.to_json(F.struct(*some(META))).alias("meta"),
        F.to_json(F.struct(*rules)).alias("rules") if rules else F.lit(None).cast("string").alias("rules"),
    )

    def put(part: Iterator[Row]) -> None:
        for r in part:
            if r["persona_id"] is None or not is_persona(r["persona_id"]):
                raise ValueError(f"persona {r['persona_id']!r} can't have a folder")
            for name, text in (("persona_meta.json", r["meta"]), ("reflection/config.json", r["rules"])):
                if text is not None:
                    file = Path(root, r["persona_id"], name)
                    file.parent.mkdir(parents=True, exist_ok=True)
                    draft = file.with_name(f".{uuid.uuid4().hex}")
                    draft.write_text(json.dumps(json.loads(text), ensure_ascii=False), encoding="utf-8")
                    os.replace(draft, file)

    rows.foreachPartition(put)
