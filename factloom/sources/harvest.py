"""A catalog brought into a folder page by page, so that a run goes on where another one ended. SRC-02."""

from __future__ import annotations

import uuid
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.files import page_states
from factloom.sources.paged import SORT, PagedCatalog, fetch
from factloom.sources.sinks import delete, move, names_in

_PAGE = "rows int, sort string, position long, id string, record string"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """page, rows, sort, position, id, record of the pages in a folder."""
    if not any(n.startswith("page=") for n in names_in(spark, folder)):
        return spark.createDataFrame([], f"{_PAGE}, page long")
    return spark.read.schema(f"{_PAGE}, page long").json(folder)


def plan(spark: SparkSession, folder: str, count: int, rows: int) -> DataFrame:
    """start, state (fetch, again, keep, delete) of each page that the catalog or the folder has."""
    wanted = spark.range(0, count, rows).select(F.col("id").alias("start"), F.lit(rows).alias("rows"), F.lit(SORT).alias("sort"), F.least(F.lit(rows), F.lit(count) - F.col("id")).alias("due"))
    have = landed(spark, folder).groupBy(F.col("page").alias("start")).agg(F.max("rows").alias("rows"), F.max("sort").alias("sort"), F.count(F.lit(1)).alias("n_records"))
    return page_states(wanted, have)


def harvest(spark: SparkSession, url: str, folder: str, rows: int = 1000, at_once: int = 64, pause: float = 1.0) -> dict[str, int]:
    """The catalog's pages as folders page=<first record>; how many were fetched, fetched again, kept and deleted.

    Pages are fetched in waves through the paged source, a task each. A wave is written beside the pages; each of its pages then takes its place, the old
    one moving aside first. A run that ends early leaves whole pages only, and the next one fetches what is not there, or was asked
    for otherwise, or holds another number of records than the catalog now has. Folders that an ended run left behind are cleared. The plan is read
    page by page; no record comes to the driver.
    """
    spark.dataSource.register(PagedCatalog)
    for name in names_in(spark, folder):
        if name.startswith((".wave-", ".old-")):
            delete(spark, f"{folder}/{name}")
    count = int(fetch(url, 0, 0, pause=pause)["count"])
    states = plan(spark, folder, count, rows).cache()
    done = {r.state: r["count"] for r in states.groupBy("state").count().collect()}  # four states
    for r in states.where("state = 'delete'").orderBy("start").toLocalIterator():
        delete(spark, f"{folder}/page={r.start}")
    for wave in batched((r.start for r in states.where("state in ('fetch', 'again')").orderBy("start").toLocalIterator()), at_once):
        source = spark.read.format("paged_catalog").options(url=url, rows=rows, count=count, pause=pause, starts=",".join(map(str, wave))).load()
        page = (F.floor(F.col("position") / rows) * rows).alias("page")
        beside = f"{folder}/.wave-{uuid.uuid4().hex}"
        source.select(F.lit(rows).alias("rows"), F.lit(SORT).alias("sort"), "position", "id", "record", page).write.partitionBy("page").json(beside)
        for start in wave:
            aside = f"{folder}/.old-{uuid.uuid4().hex}"
            move(spark, f"{folder}/page={start}", aside)
            if not move(spark, f"{beside}/page={start}", f"{folder}/page={start}"):
                raise OSError(f"page {start} could not take its place")
            delete(spark, aside)
        delete(spark, beside)
    states.unpersist()
    return done
