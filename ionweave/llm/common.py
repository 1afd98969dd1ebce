"""Helpers that the training-data operators share: shared tables, id filters, word rules, components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII spaces; `bytes.split()` follows the same rule.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Spark's setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an id and a hash that may be broadcast (about 30 MB as a hash table); above it the same join is shuffled.
BROADCAST_IDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "ionweave-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Sets smaller Arrow batches than Spark's 10,000 rows and 64 MB where these are unchanged: rows here hold whole texts."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


class Workspace:
    """Intermediate tables of one run, written as Parquet below the shared folder.

    A written table cuts the lineage: after a lost executor only reads are repeated. `drop` frees a table
    that nothing reads any more; what the returned DataFrame still reads stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ionweave/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes df; its shuffle files go as soon as it is written, as the table is read from then on."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished jobs, which nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by which rows are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def filter_by_id(docs: DataFrame, ids: DataFrame, id_col: str, keep: bool, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of docs whose id is (keep) or isn't (not keep) in ids, a written table with the one column id_col.

    The ids are broadcast only if they are counted at `limit` at most, so the texts don't move; with more of them
    the join is an ordinary shuffled one.
    """
    ids = ids.select(id_col).distinct()
    how = "left_semi" if keep else "left_anti"
    if ids.limit(limit + 1).count() <= limit:
        return docs.join(F.broadcast(ids), id_col, how)
    return docs.hint("shuffle_merge").join(ids, id_col, how)


def connected_components(space: Workspace, edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): component is the smallest node that can be reached over edges (a, b), all longs.

    Large-star and small-star rounds (Kiveris et al. 2014). Every round is aggregates and joins on node ids with
    map-side combining, written to the shared folder, and the number of rounds grows with the logarithm of a
    component's size. Nodes without an edge aren't returned. Nothing is collected but two counters a round.
    """
    rows = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rows = space.write(rows, f"{name}-0")
    last = f"{name}-0"
    before = None
    for k in range(1, max_rounds + 1):
        # large star: every larger neighbour of a node points to the smallest node among the node and its neighbours
        both = rows.select("a", "b").unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join deals both sides itself and a node with very many neighbours is split by the skew join
        least = space.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least-{k}")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours point to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        rows = space.write(small.distinct(), f"{name}-{k}")
        space.drop(last, f"{name}-least-{k}")
        last = f"{name}-{k}"
        mark = tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = rows.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(rows.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
