"""Scans: JSON batches, JSONL, CSV with line numbers, text, e-mail, TSV, id lists, reports, snapshots of runs.

All go through Spark's readers, so any file system that Spark knows will do; a path may be a glob and read as one relation (SRC-09).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw catalog records. PRJ-01.
RECORD = (
    "id string, name string, title string, notes string, maintainer string, organization struct<title:string>, tags array<struct<name:string>>,"
    " resources array<struct<format:string>>, license_title string, url string, metadata_created string, metadata_modified string"
)
BATCH = f"request struct<rows:int,start:int,sort:string>, fetched_at string, http_status int, catalog_count long, run_id string, records array<struct<{RECORD.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array').replace(', ', ',')}>>"


def json_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of JSON batch files, with the batch's facts and `origin` (file#place). SRC-05, SET-01."""
    files = spark.read.schema(BATCH).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return files.select("file", "fetched_at", "http_status", "catalog_count", "run_id", F.posexplode("records").alias("place", "r")).select("file", "fetched_at", "http_status", "catalog_count", "run_id", F.concat_ws("#", "file", F.col("place").cast("string")).alias("origin"), "r.*")


def records(batches: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Typed columns of raw records: tag names, distinct formats in order, organisation's title, extra text columns. PRJ-01, PRJ-02, PRJ-08."""
    reserved = {"id", "name", "title", "notes", "maintainer", "organization", "tags", "formats", "license", "url", "metadata_created", "metadata_modified", "origin"}
    if bad := reserved & set(extra):
        raise ValueError(f"reserved column names: {sorted(bad)}")
    formats = F.array_distinct(F.array_compact(F.transform("resources", lambda r: F.when(F.trim(r.format) != "", r.format))))
    return batches.select(
        "id", "name", "title", "notes", "maintainer", F.col("organization.title").alias("organization"), F.array_compact(F.transform("tags", lambda t: t["name"])).alias("tags"), formats.alias("formats"),
        F.col("license_title").alias("license"), "url", "metadata_created", "metadata_modified", "origin", *extra,
    )


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a bad line stops the scan and is named. SRC-06, SRC-20, SRC-24."""
    kind = T._parse_datatype_string(schema)
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name")).where(F.trim("value") != "")
    row = F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    checked = lines.select("file", "value", row.alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    stop = F.raise_error(F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
    return checked.select(F.when(bad, stop.cast(kind)).otherwise(F.struct(*(F.col(f"r.{f.name}") for f in kind.fields))).alias("r")).select("r.*")


def _csv_rows(sep: str):
    import csv
    import io

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                text = bytes(content).decode("utf-8-sig").replace("\r\n", "\n")
                reader = csv.reader(io.StringIO(text), delimiter=sep)
                head, before = next(reader, []), reader.line_num
                for row in reader:
                    if any(cell.strip() for cell in row):
                        out.append((name, before + 1, [h.strip() for h in head], row))
                    before = reader.line_num
            yield pd.DataFrame(out, columns=["path", "line", "header", "cells"])

    return run


def csv_with_lines(spark: SparkSession, path: str, columns: Sequence[str], optional: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """columns, optional ones ('' if absent), file and physical line of each CSV row; byte-order marks dropped. SRC-07, SRC-14, SRC-15, SRC-21.

    A file that lacks a required column stops the scan.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(_csv_rows(sep), "path string, line int, header array<string>, cells array<string>")
    cells = F.map_from_arrays("header", F.expr("transform(header, (h, i) -> coalesce(get(cells, i), ''))"))
    missing = F.array_except(F.array(*(F.lit(c) for c in columns)), "header")
    ok = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.col("path"), F.lit(" lacks "), F.array_join(missing, ", "))).cast("map<string,string>")).otherwise(cells)
    rows = rows.withColumn("m", ok)
    return rows.select(*(F.col("m")[c].alias(c) for c in columns), *(F.coalesce(F.col("m")[c], F.lit("")).alias(c) for c in optional), F.element_at(F.split("path", "/"), -1).alias("file"), "line")


def utf8_text(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole files; byte-order mark dropped, CRLF folded; what is not UTF-8 stops the scan. SRC-08."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" is not UTF-8"))).cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), text.alias("text"))


def numbered_lines(texts: DataFrame) -> DataFrame:
    """file, line (from 1), value of texts read whole."""
    return texts.select("file", F.posexplode(F.split("text", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id, place: first column of each line, comments and blanks skipped, first mention kept. SRC-11."""
    lines = numbered_lines(utf8_text(spark, path)).where(~F.col("value").rlike(r"^\s*(#|$)"))
    ids = lines.select(F.trim(F.regexp_replace(F.split_part("value", F.lit(","), F.lit(1)), '"', "")).alias("id"), F.struct("file", "line").alias("at")).where("id <> '' and lower(id) <> 'id'")
    first = ids.groupBy("id").agg(F.min("at").alias("at"))
    return first.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")).alias("place"))  # a list that people wrote


def sectioned_items(texts: DataFrame, heading: str = r"^##\s+(?:(\d+)\.\s*)?(.+?)(?:\s*\((\d+)\))?\s*$", item: str = r"^\s*(?:[-*]|(\d+)\.)\s+(.*)$") -> DataFrame:
    """file, section, declared, number, item, notes of documents of headings, items and sub-lines. SRC-16, SRC-18, SRC-22."""
    lines = numbered_lines(texts)
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    is_head, is_item = F.col("value").rlike(heading), F.col("value").rlike(item)
    lines = lines.withColumn("section", F.last(F.when(is_head, F.regexp_extract("value", heading, 2)), ignorenulls=True).over(by))
    lines = lines.withColumn("declared", F.last(F.when(is_head, F.try_to_number(F.nullif(F.regexp_extract("value", heading, 3), F.lit("")), F.lit("999999")).cast("int")), ignorenulls=True).over(by))
    at = F.last(F.when(is_head, 0).when(is_item, F.col("line")), ignorenulls=True).over(by)  # an item ends with its section
    lines = lines.withColumn("at", at).where(F.col("section").isNotNull() & ~is_head & (F.col("at") > 0))
    rows = lines.groupBy("file", "section", "declared", "at").agg(
        F.max(F.when(is_item, F.regexp_extract("value", item, 1))).alias("number"), F.max(F.when(is_item, F.regexp_extract("value", item, 2))).alias("item"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_item & (F.trim("value") != ""), F.struct("line", F.trim("value").alias("t"))))), lambda x: x.t), " ").alias("notes"),
    )
    return rows.select("file", "section", "declared", F.nullif("number", F.lit("")).cast("int").alias("number"), "item", "notes", F.col("at").alias("line"))


def wrong_counts(items: DataFrame) -> DataFrame:
    """Sections that declare another number of items than they have. SRC-16."""
    n = items.groupBy("file", "section", "declared").agg(F.count(F.lit(1)).alias("items"))
    return n.where("declared is not null and declared <> items")


def _messages(frames):
    import email
    import email.policy

    import pandas as pd

    for pdf in frames:
        out = []
        for name, content in zip(pdf["path"], pdf["content"], strict=True):
            m = email.message_from_bytes(bytes(content), policy=email.policy.default)
            body = m.get_body(("plain", "html"))
            out.append((name, str(m["from"] or ""), str(m["date"] or ""), str(m["subject"] or ""), body.get_content() if body else ""))
        yield pd.DataFrame(out, columns=["path", "sender", "sent", "subject", "body"])


def emails(spark: SparkSession, path: str) -> DataFrame:
    """sender address, sent, subject, body of .eml files. SRC-19."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(_messages, "path string, sender string, sent string, subject string, body string")
    return out.withColumn("address", F.lower(F.coalesce(F.nullif(F.regexp_extract("sender", r"<([^<>]+)>", 1), F.lit("")), F.trim("sender"))))


def from_domains(address: Column | str, domains: Sequence[str]) -> Column:
    """Whether an address is of a domain or a subdomain. FLT-07."""
    host = F.lower(F.element_at(F.split(address, "@"), -1))
    out = F.lit(False)
    for d in domains:
        out |= (host == d.lower()) | host.endswith("." + d.lower())
    return out


def joined_parts(messages: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, body of messages sent in parts ('part 2 of 3' in the subject), whole ones only. SRC-19."""
    part = F.regexp_extract("subject", r"(?i)part (\d+) of (\d+)", 1)
    total = F.regexp_extract("subject", r"(?i)part (\d+) of (\d+)", 2)
    rows = messages.withColumn("n", F.coalesce(F.nullif(part, F.lit("")), F.lit("1")).cast("int")).withColumn("of", F.coalesce(F.nullif(total, F.lit("")), F.lit("1")).cast("int"))
    got = rows.groupBy(*key, "of").agg(F.array_sort(F.collect_set(F.struct("n", "body"))).alias("p"))
    return got.where(F.size("p") == F.col("of")).select(*key, F.array_join(F.transform("p", lambda x: x.body), "").alias("body"))


def run_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of tab-separated lists; lines that start with # are comments, a row that does not fit stops the scan. SRC-21."""
    return spark.read.schema(schema).csv(path, sep="\t", comment="#", mode="FAILFAST")


def as_of_run(catalog: DataFrame, run_id: str, file: str) -> DataFrame:
    """The path and hash of a file as a run wrote it. SRC-23. catalog: run_id, file, path, sha256."""
    return catalog.where((F.col("run_id") == run_id) & (F.col("file") == file)).select("path", "sha256")


def as_run_wrote(manifests: DataFrame, versions: DataFrame, run_id: str, name: str) -> DataFrame:
    """path, content: the bytes of an output as a run wrote it, found by hash; bytes that were not kept or have changed stop the scan. SRC-23.

    manifests: rows of `sinks.manifest`; versions: the table of `sinks.keep_versions`.
    """
    wrote = manifests.where((F.col("run_id") == run_id) & (F.col("role") == "output") & (F.col("name") == name)).select("path", "sha256")
    found = wrote.join(versions.select("sha256", "content").dropDuplicates(["sha256"]), "sha256", "left")
    same = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    stop = F.raise_error(F.concat(F.lit("not as written: "), F.col("path"))).cast("binary")
    return found.select("path", F.when(same, F.col("content")).otherwise(stop).alias("content"))


def missing_pages(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Pages still to fetch: not landed, or landed with another size or request. SRC-02, SRC-03."""
    good = landed.where("n_records = expected").select("start", "rows", "sort")
    return wanted.join(good, ["start", "rows", "sort"], "left_anti")


def page_states(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """start, state of each page: fetch (not landed), again (another request or number of records), keep, delete (out of the catalog's range). SRC-02.

    wanted: start, rows, sort, due (records it must have); landed: start, rows, sort, n_records.
    """
    both = wanted.alias("w").join(landed.alias("l"), "start", "full_outer")
    same = (F.col("w.rows") == F.col("l.rows")) & (F.col("w.sort") == F.col("l.sort")) & (F.col("n_records") == F.col("due"))
    state = F.when(F.col("w.rows").isNull(), "delete").when(F.col("l.rows").isNull(), "fetch").when(same, "keep").otherwise("again")
    return both.select("start", state.alias("state"))


def snapshots(batches: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """key, saved, reported, complete: a snapshot is complete if its batches hold as many records as its catalog reported. SRC-03.

    batches: key, n_records; reported: key, reported.
    """
    saved = batches.groupBy(key).agg(F.sum("n_records").alias("saved"))
    out = reported.join(saved, key, "left").withColumn("saved", F.coalesce("saved", F.lit(0)))
    return out.select(key, "saved", "reported", (F.col("saved") >= F.col("reported")).alias("complete"))
