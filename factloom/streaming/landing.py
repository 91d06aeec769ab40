"""Streaming landing: batch files become a table as they arrive, and the latest row of each key is kept up to date.

The same rows come out as from the batch scans; the stream adds restarts from a checkpoint and late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.files import BATCH


def batch_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Records of JSON batch files as they land. SRC-02, SRC-05."""
    files = spark.readStream.schema(BATCH).option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(path)
    return files.select("run_id", "fetched_at", F.inline("records"))


def land_first_copies(stream: DataFrame, key: str, time: str, wait: str, path: str, checkpoint: str) -> StreamingQuery:
    """The first copy of each key, appended once; copies later than the wait are dropped by the watermark. SET-02."""
    seen = stream.withWatermark(time, wait).dropDuplicatesWithinWatermark([key])
    return seen.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_stream(stream: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """The latest value of each key as an updating table. JOIN-15.

    A key whose latest values conflict, or whose latest value is empty (withdrawn), has a null value until a later one comes; those are the keys that the batch
    form leaves out. State is one row a key: the latest time with its smallest and its largest value.
    """
    high = F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    low = F.min(F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), F.col(value).alias("v")))
    both = stream.groupBy(*key).agg(high.alias("high"), low.alias("low"))
    return both.select(*key, F.col("high.t").alias(time), F.when(F.col("high.v").eqNullSafe(F.col("low.v")) & (F.trim(F.col("high.v").cast("string")) != ""), F.col("high.v")).alias(value))


def counts_by_window(stream: DataFrame, time: str, kind: str, size: str, slide: str | None, wait: str) -> DataFrame:
    """Rows by kind and sliding window, with late rows up to the wait."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, wait).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("since"), kind, "n")
