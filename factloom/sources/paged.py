"""A paged catalog over HTTP as a Spark data source, one partition a page. SRC-01, SRC-02.

    spark.dataSource.register(PagedCatalog)
    spark.read.format("paged_catalog").option("url", ...).option("rows", 1000).option("count", n).load()

Option starts names the pages to read (first records, comma-separated) where not all are wanted. Pages are asked for in a total order, so their borders are stable; server errors are tried again with growing pauses. As a stream, the
offset is the first record of the next page, so a restart goes on where it stopped.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SORT = "metadata_created asc, id asc"
AGAIN = (429, 500, 502, 503, 504)


def page_parameters(start: int, rows: int, sort: str = SORT) -> dict[str, object]:
    """The query of one page."""
    return {"rows": rows, "start": start, "sort": sort}


def fetch(url: str, start: int, rows: int, tries: int = 5, pause: float = 1.0) -> dict:
    """The result of one page: {count, results}."""
    full = f"{url}?{urllib.parse.urlencode(page_parameters(start, rows))}"
    for turn in range(tries):
        try:
            with urllib.request.urlopen(full, timeout=120) as r:
                return json.load(r)["result"]
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or turn == tries - 1:
                raise
        except urllib.error.URLError:
            if turn == tries - 1:
                raise
        time.sleep(pause * 2**turn)
    raise AssertionError


def _rows(url: str, start: int, rows: int, pause: float, due: int | None = None) -> Iterator[tuple]:
    """The records of a page; fewer than are due is an error, so no scan loses records silently."""
    records = fetch(url, start, rows, pause=pause)["results"]
    if due is not None and len(records) < due:
        raise ValueError(f"page at {start}: {len(records)} records, {due} due")
    for place, record in enumerate(records):
        yield (start + place, str(record.get("id") or ""), json.dumps(record))


class Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.rows, self.pause = options["url"], int(options.get("rows", 1000)), float(options.get("pause", 1))
        self.count = int(options.get("count") or fetch(self.url, 0, 0, pause=self.pause)["count"])
        self.starts = [int(x) for x in options.get("starts", "").split(",") if x]

    def partitions(self) -> list[Page]:
        return [Page(s) for s in self.starts or range(0, self.count, self.rows)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _rows(self.url, partition.start, self.rows, self.pause, min(self.rows, self.count - partition.start))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.rows, self.pause = options["url"], int(options.get("rows", 1000)), float(options.get("pause", 1))

    def initialOffset(self) -> dict:
        return {"start": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        got = list(_rows(self.url, start["start"], self.rows, self.pause))
        return iter(got), {"start": start["start"] + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        size = end["start"] - start["start"]
        return _rows(self.url, start["start"], size, self.pause, size)


class PagedCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return "position long, id string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)
