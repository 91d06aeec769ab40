"""Shared Spark helpers: stored intermediate tables and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where it is unset and the master local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined() and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors on other machines need a shared folder")
        folder = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="scratch-")
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def store(self, df: DataFrame, file_rows: int = 0) -> DataFrame:
        """Write the rows as Parquet, at most file_rows a file if given, and read them back.

        Parquet's writers and readers hold hundreds of rows at a time, so rows of some megabytes need files of few rows.
        """
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
        out = self.spark.read.schema(_nullable(df.schema)).parquet(path)
        out._scratch_path = path
        return out

    def release(self, size: int, least: int = 64 << 20) -> None:
        """Let Spark delete the shuffle files of jobs that are over, if they hold so many bytes: its cleaner does so once the driver has collected what refers to them, which may be long after."""
        if size < least:
            return
        for _ in range(2):  # the listeners of a job that has just ended may still refer to it
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def clear(self) -> None:
        """Delete all tables stored here; nothing still to be computed may read them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that nothing still to be computed reads."""
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def buckets(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle of packed rows: the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Keep the session's Arrow batches to some megabytes, whatever the texts' lengths.

    The setting stays, as the caller runs the plan later; a smaller one is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = str(spark.conf.get(name, str(64 << 20))).strip().lower().rstrip("b")
    if not have.isdigit() or int(have) > most:
        spark.conf.set(name, str(most))


def small_enough(df: DataFrame, limit_rows: int) -> bool:
    """Whether a stored table has at most so many rows: the check before a broadcast."""
    return df.count() <= limit_rows


def side(df: DataFrame, most_bytes: int = 32 << 20, row_bytes: int = 256) -> DataFrame:
    """A stored table as the side of a join: broadcast if its counted rows are few enough, else left to the planner."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df


def with_groups(rows: DataFrame, groups: DataFrame, on: str, value: str, hot: int = 4096, most_bytes: int = 32 << 20) -> DataFrame:
    """rows with `value` of their group; rows without a group go. groups (stored): on, n (rows of the group), value.

    Rows of a group of more than `hot` do not meet in one task: those groups are few, so they are broadcast if their counted size allows
    it, and their rows are dealt by a salt. Otherwise adaptive execution is left to split them.
    """
    large = groups.where(F.col("n") > hot).select(on, F.col(value).alias("_value"))
    if 64 * large.count() > most_bytes:
        return rows.join(groups.select(on, value), on)
    marked = rows.join(F.broadcast(large), on, "left")
    salt = F.when(F.col("_value").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(997))).cast("int")
    small = groups.where(F.col("n") <= hot).select(on, value, F.lit(0).alias("_salt"))
    out = marked.withColumn("_salt", salt).join(small, [on, "_salt"], "left").withColumn(value, F.coalesce(value, "_value"))
    return out.where(F.col(value).isNotNull()).select(*rows.columns, value)


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches.

    Alternating large-star and small-star steps, each a grouped minimum and a join,
    stored after every round; O(log n) rounds. `edges` has long columns a and b.
    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    cur = scratch.store(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(most_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour of u points to the smallest neighbour m
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.store(large)
        # small star: every smaller neighbour of u, and u, point to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = scratch.store(small)
        # done when every node has one parent and no parent has a parent
        roles = new.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "u").alias("child")) for c in ("u", "v")))))
        roles = roles.groupBy("node").agg(F.count(F.when(F.col("child"), 1)).alias("parents"), F.max(~F.col("child")).alias("parent"))
        done = roles.where("parents > 1 or (parents = 1 and parent)").isEmpty()
        scratch.drop(cur, large)
        cur = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while actions run inside: for rows of some megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
