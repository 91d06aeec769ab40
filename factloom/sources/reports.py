"""Markdown reports read back as rows: tables, counts and times. SRC-22."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.files import numbered_lines

_HEADING = r"^#{1,6}\s+(.+?)\s*#*\s*$"
_ROW = r"^\s*\|.*\|\s*$"
_RULE = r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"
_FACT = r"^\s*[-*]\s+([^:|]+?):\s+(.+?)\s*$"
_MOMENT = r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?)Z?"
_SPAN = r"(?:(\d+) h )?(?:(\d+) min )?(\d+(?:\.\d+)?) s\b"


def number(value: Column) -> Column:
    """The number a text begins with, thousands apart by commas; null if it does not begin with one."""
    return F.nullif(F.replace(F.regexp_extract(value, r"^([-+]?\d[\d,]*(?:\.\d+)?)(?!\w)", 1), F.lit(",")), F.lit("")).cast("double")


def seconds(value: Column) -> Column:
    """Seconds of a span of time ("1 h 2 min 3.5 s"); null if there is none."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(value, _SPAN, i), F.lit("")), F.lit("0")).cast("double")
    return F.when(value.rlike(_SPAN), part(1) * 3600 + part(2) * 60 + part(3))


def cells(row: Column) -> Column:
    """Cells of a table's line; an escaped bar is part of its cell."""
    inner = F.regexp_replace(row, r"^\s*\||\|\s*$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def report_cells(texts: DataFrame) -> DataFrame:
    """file, section, kind, place, row, column, value, number of reports (file, text).

    table: a cell each; place counts the report's tables from 1, row the table's rows below its rule; cells beyond the heads are named by their place. count: "- name: value" lines
    with a number, by line. time: moments (ISO, without zone) and spans (number in seconds) of other lines, by line, under the words before them.
    A report is read in one task; tables without a rule under their heads are not read.
    """
    by = Window.partitionBy("file").orderBy("line")
    lines = numbered_lines(texts).withColumn("section", F.last(F.when(F.col("value").rlike(_HEADING), F.regexp_extract("value", _HEADING, 1)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("is_row", F.col("value").rlike(_ROW))
    lines = lines.withColumn("place", F.sum((F.col("is_row") & ~F.coalesce(F.lag("is_row").over(by), F.lit(False))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))

    of = Window.partitionBy("file", "place").orderBy("line")
    rows = lines.where("is_row").withColumn("n", F.row_number().over(of)).withColumn("heads", F.first(cells(F.col("value"))).over(of))
    ruled = F.max(F.when(F.col("n") == 2, F.col("value").rlike(_RULE))).over(Window.partitionBy("file", "place"))
    rows = rows.withColumn("ruled", ruled).where("ruled and n > 2").select("file", "section", "place", "heads", (F.col("n") - 2).alias("row"), F.posexplode(cells(F.col("value"))).alias("k", "value"))
    column = F.coalesce(F.nullif(F.get("heads", F.col("k")), F.lit("")), F.concat(F.lit("column "), (F.col("k") + 1).cast("string")))
    table = rows.select("file", "section", F.lit("table").alias("kind"), "place", "row", column.alias("column"), "value", number(F.col("value")).alias("number"))

    other = lines.where("not is_row")
    fact = other.where(F.col("value").rlike(_FACT)).select("file", "section", F.col("line").alias("row"), F.regexp_extract("value", _FACT, 1).alias("column"), F.regexp_extract("value", _FACT, 2).alias("value"))
    timed = F.col("value").rlike(_MOMENT) | F.col("value").rlike(_SPAN)
    count = fact.where(~timed).withColumn("number", number(F.col("value"))).where("number is not null").select("file", "section", F.lit("count").alias("kind"), F.lit(0).alias("place"), "row", "column", "value", "number")

    found = F.concat(F.regexp_extract_all("value", F.lit(rf"([^\d,;|]*?)(?:{_MOMENT})"), F.lit(0)), F.regexp_extract_all("value", F.lit(rf"[A-Za-z][^\d,;|]*{_SPAN}"), F.lit(0)))
    times = other.where(timed).select("file", "section", F.col("line").alias("row"), F.explode(found).alias("x"))
    moment = F.nullif(F.regexp_extract("x", _MOMENT, 1), F.lit(""))
    name = F.trim(F.regexp_replace(F.regexp_replace("x", rf"{_MOMENT}|{_SPAN}", ""), r"^[\s*:\-]+|[\s*:\-]+$", ""))
    times = times.select("file", "section", F.lit("time").alias("kind"), F.lit(0).alias("place"), "row", name.alias("column"), F.coalesce(moment, F.regexp_extract("x", _SPAN, 0)).alias("value"), F.when(moment.isNull(), seconds(F.col("x"))).alias("number"))
    return table.unionByName(count).unionByName(times)
