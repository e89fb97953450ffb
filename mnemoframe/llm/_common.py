"""What the training-data operators share: tables, shared storage, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark setting: shuffle files of a query are deleted at its end, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else (Spark's lower() also maps other scripts)."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session that names none gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="mnemoframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as a Parquet table in the shared folder and reread: cuts the lineage and survives lost executors.

    The write's shuffle files go when it is done, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemoframe/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def unstore(df: DataFrame) -> None:
    """Delete a table made by stored() which nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that stored() made in the shared folder; for the end of a job, when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mnemoframe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def look_up(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, total: int, most: int = 2000) -> DataFrame:
    """rows LEFT JOIN dim on keys, safe against hot keys.

    dim has one row per key, and ``weight`` says how many of the ``total`` rows carry it. Keys with over
    total/most rows are at most ``most`` by arithmetic: that head is broadcast. What is left has no key with
    more than total/most rows and is joined by shuffle (or as AQE sees fit). Both inputs are read twice, so
    they should be stored tables. Keys must not be null.
    """
    least = max(1, total // most + 1)
    hot = dim.filter(F.col(weight) >= least)
    cold = dim.filter(F.col(weight) < least)
    new = [c for c in dim.columns if c not in keys]
    with_hot = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    done = with_hot.filter("_hot").drop("_hot")
    rest = with_hot.filter("_hot IS NULL").drop("_hot", *new)
    return done.unionByName(rest.join(cold, keys, "left"))


def without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs whose (doc_id, xxhash64(text)) isn't in keys (doc_id, key)."""
    k = keys.select(F.col("doc_id").alias("_k_doc"), F.col("key").alias("_k_key"))
    return docs.join(k, docs["doc_id"].eqNullSafe(F.col("_k_doc")) & (F.xxhash64(docs["text"]) == F.col("_k_key")), how)


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Let Arrow batches of this session end after ``rows`` rows or ``size`` bytes: they are whole texts, held twice while they pass to a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        spark.conf.set(key, str(most))
