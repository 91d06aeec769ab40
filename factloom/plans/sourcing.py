"""Queries of sources and sinks: tables are written as the files that people keep, scanned back by the sources and compared.

Files go to the folder that all executors share and stay there, as the results read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.plans.quality import table
from factloom.sources import files as S
from factloom.sources import questions as Q
from factloom.sources import reports as P
from factloom.sources import schema_text as D
from factloom.sources import sinks as K

#: Records of a batch file, and records of a page.
BATCH, PAGE = 500, 100


def _folder(spark) -> str:
    return f"{K.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def jsonl_scan(spark, sf_dir):
    """Documents as JSON lines and back, texts by their hash (SRC-06, SNK-01)."""
    path = _folder(spark)
    K.write_whole(table(spark, sf_dir, "documents"), path, "json")
    docs = S.jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_hash"))


def csv_scan(spark, sf_dir):
    """Customers as CSV and back, an absent optional column as empty text; the rows of each file stand line by line below its header (SRC-07, SRC-15)."""
    path = _folder(spark)
    K.write_whole(table(spark, sf_dir, "customer"), path, "csv", most_rows=50_000)
    rows = S.csv_with_lines(spark, path, ["c_custkey", "c_name", "c_mktsegment"], ["c_comment"])
    place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment", "c_comment", (F.col("line") == place + 1).alias("in_order"))


def split_parts(spark, sf_dir):
    """Orders in CSV parts of at most 1,000 rows, read by a wildcard as one relation; whether the row's part keeps the bound (SNK-08, SRC-09)."""
    path = _folder(spark)
    K.write_whole(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path, "csv", most_rows=1000)
    rows = spark.read.schema("o_orderkey long, o_custkey long, o_orderpriority string").csv(f"{path}/*.csv", header=True)
    n = F.count(F.lit(1)).over(Window.partitionBy("file"))
    return rows.withColumn("file", F.col("_metadata.file_name")).withColumn("fits", n <= 1000).drop("file")


def text_scan(spark, sf_dir):
    """The nations of each region as a text file with a byte-order mark and CRLF, and back with their lines (SRC-08)."""
    path = _folder(spark)
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    text = F.concat(F.lit("﻿"), F.array_join("names", "\r\n"))
    names.select("n_regionkey", text.alias("value")).write.partitionBy("n_regionkey").text(path)
    lines = S.numbered_lines(S.utf8_text(spark, f"{path}/*/*.txt"))
    return lines.where("value <> ''").select("line", F.col("value").alias("n_name"))


def id_list_scan(spark, sf_dir):
    """Documents on a list with comments, a header and every id twice (SRC-11)."""
    path = _folder(spark)
    ids = table(spark, sf_dir, "labels").select(F.concat_ws(",", F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("value"))
    spark.createDataFrame([("# for review",), ("id,quality",)], "value string").union(ids).union(ids).write.text(path)
    listed = S.id_list(spark, path).select(F.col("id").cast("long").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(listed, "doc_id", "left_semi")


def batch_scan(spark, sf_dir):
    """Documents as records of JSON batch files and back as typed columns, with their place in the file (SRC-05, PRJ-01, PRJ-08)."""
    path = _folder(spark)
    formats = F.array(*(F.struct(F.lit(x).alias("format")) for x in ("TXT", "TXT", " ", "CSV")))
    record = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("notes"), F.struct(F.col("source").alias("title")).alias("organization"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("tags"), formats.alias("resources"),
    )
    batch = F.floor(F.col("doc_id") / BATCH).alias("batch")
    of = table(spark, sf_dir, "documents").groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))).alias("x"))
    request = F.struct(F.lit(BATCH).alias("rows"), (F.col("batch") * BATCH).cast("int").alias("start"), F.lit("id asc").alias("sort"))
    whole = F.struct(request.alias("request"), F.lit("r1").alias("run_id"), F.transform("x", lambda e: e.r).alias("records"))
    of.select("batch", F.to_json(whole).alias("value")).write.partitionBy("batch").text(path)
    rows = S.records(S.json_batches(spark, f"{path}/*/*.txt"))
    return rows.select(
        F.col("id").cast("long").alias("doc_id"), "organization", F.array_join("tags", ",").alias("lang"), F.array_join("formats", ",").alias("formats"),
        F.sha2("notes", 256).alias("text_hash"), F.split_part("origin", F.lit("#"), F.lit(2)).cast("int").alias("place"),
    )


def harvest_pages(spark, sf_dir):
    """What becomes of each page of a catalog as large as the documents: fetched, fetched again, kept or deleted (SRC-02).

    Pages whose start 700 divides have not landed, those that 300 divides have landed in another order, and each has landed a second time beyond the catalog's end.
    """
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    wanted = spark.range(0, n, PAGE).select(F.col("id").alias("start"), F.lit(PAGE).alias("rows"), F.lit("id asc").alias("sort"), F.least(F.lit(PAGE), F.lit(n) - F.col("id")).alias("due"))
    pages = docs.groupBy((F.floor(F.col("doc_id") / PAGE) * PAGE).alias("start")).agg(F.count(F.lit(1)).alias("n_records"))
    order = F.when(F.col("start") % 300 == 0, "id desc").otherwise("id asc")
    landed = pages.select("start", F.lit(PAGE).alias("rows"), order.alias("sort"), "n_records")
    beyond = landed.withColumn("start", F.col("start") + F.ceil(F.lit(n) / PAGE) * PAGE)
    return S.page_states(wanted, landed.where("start % 700 <> 0").union(beyond))


def harvest_snapshot(spark, sf_dir):
    """Whether each source's batches hold as many records as the catalog reported, here the documents that have a label (SRC-03)."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    saved = labelled.groupBy("source", F.floor(F.col("doc_id") / BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("n_records"))
    reported = docs.groupBy("source").agg(F.count(F.lit(1)).alias("reported"))
    return S.snapshots(saved, reported, "source")


def as_run_wrote(spark, sf_dir):
    """Suppliers as the first of two runs wrote them, found by hash after the second replaced the file (SRC-23, SNK-05, SNK-06)."""
    path = _folder(spark)
    out, store, runs = f"{path}/out", f"{path}/versions", f"{path}/runs"
    suppliers = table(spark, sf_dir, "supplier")
    for run, rows in (("r1", suppliers.select("s_suppkey", "s_name")), ("r2", suppliers.select("s_suppkey", F.lower("s_name").alias("s_name")))):
        K.write_whole(rows, out, "json")
        K.manifest(spark, run, {}, {"suppliers": out}, {"seed": 1}, "suppliers").write.mode("append").parquet(runs)
        K.keep_versions(spark, out, store)
    files = S.as_run_wrote(spark.read.parquet(runs), spark.read.parquet(store), "r1", "suppliers")
    lines = files.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("value")).where("value <> ''")
    return lines.select(F.from_json("value", "s_suppkey long, s_name string").alias("r")).select("r.*")


def appended_rows(spark, sf_dir):
    """Regions appended to the nations by the names of the columns, in another order and with one absent (SNK-02)."""
    path = _folder(spark)
    K.write_whole(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    K.append_by_name(table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_nationkey")), path)
    return spark.read.parquet(path)


def write_once_report(spark, sf_dir):
    """What differs where customers would replace suppliers in an output that is written once (SNK-04)."""
    path = _folder(spark)
    K.write_once(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")), path, ["key"])
    return K.write_once(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")), path, ["key"])


def schema_edits(spark, sf_dir):
    """Nations after a plan of edits, one kind a region (rename, redefine, remove, none), regions added (SNK-10)."""
    nation = table(spark, sf_dir, "nation")
    op = F.element_at(F.array(*map(F.lit, ("rename", "redefine", "remove", "", ""))), F.col("n_regionkey") % 5 + 1)
    value = F.when(op == "rename", F.lower("n_name")).when(op == "redefine", F.concat(F.lit("new "), F.col("n_name")))
    edits = nation.select(op.alias("op"), F.col("n_name").alias("name"), value.alias("value")).where("op <> ''")
    added = table(spark, sf_dir, "region").select(F.lit("add").alias("op"), F.concat(F.lit("region "), F.col("r_name")).alias("name"), F.col("r_name").alias("value"))
    return K.edit_plan(nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("definition")), edits.union(added))


def merged_entries(spark, sf_dir):
    """Suppliers of each nation after the nations of a region were merged into its first one (SNK-10)."""
    nation = table(spark, sf_dir, "nation")
    first = nation.groupBy("n_regionkey").agg(F.min("n_name").alias("new"))
    merges = nation.join(first, "n_regionkey").where("n_name <> new").select(F.col("n_name").alias("old"), "new")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return K.rename_entries(rows, merges, ["n_name"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))


def run_list_scan(spark, sf_dir):
    """Suppliers as a tab-separated list with comments, and back (SRC-21)."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name").alias("value"))
    spark.createDataFrame([("# number\tname",)], "value string").union(rows).write.text(path)
    return S.run_list(spark, path, "s_suppkey long, s_name string")


def pool_design_scan(spark, sf_dir):
    """Sizes of the strata of a pool's design, kept as a JSON object (SRC-20)."""
    path = _folder(spark)
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    design = sizes.agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("strata"))
    K.write_whole(design, path, "json")
    return S.jsonl(spark, path, "strata map<string,bigint>").select(F.explode("strata").alias("stratum", "size"))


def sections_scan(spark, sf_dir):
    """Numbered nations under the headings of their regions, with sub-lines (SRC-16, SRC-18, SRC-22)."""
    path = _folder(spark)
    region = table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    items = rows.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    listed = F.array_join(F.transform("names", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n   note on "), x)), "\n")
    part = F.concat(F.lit("## "), (F.col("r_regionkey") + 1).cast("string"), F.lit(". "), "r_name", F.lit(" ("), F.size("names").cast("string"), F.lit(")\n\n"), listed, F.lit("\n"))
    doc = items.agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("value"))
    doc.select(F.concat(F.lit("# Left out\n\n"), F.col("value")).alias("value")).write.text(path)
    found = S.sectioned_items(S.utf8_text(spark, f"{path}/*.txt"))
    return found.join(S.wrong_counts(found).select("section"), "section", "left_anti").select("section", "declared", "number", "item", "notes")


def messages_scan(spark, sf_dir):
    """Messages of the nations, each in two parts, put together; whether they come from the first region (SRC-19, FLT-07)."""
    path = _folder(spark)
    name = F.lower("n_name")
    head = F.concat(F.lit("From: "), F.col("n_name"), F.lit(" <"), name, F.lit("@mail.region"), F.col("n_regionkey").cast("string"), F.lit(".example.org>\nSubject: notes part "), F.col("part").cast("string"), F.lit(" of 2\n\n"))
    rows = table(spark, sf_dir, "nation").withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
    text = F.concat(head, F.lit("part "), F.col("part").cast("string"), F.lit(" of "), F.col("n_name"))
    rows.select("n_nationkey", "part", text.alias("value")).write.partitionBy("n_nationkey", "part").text(path)
    whole = S.joined_parts(S.emails(spark, f"{path}/*/*/*.txt"), ["address"])
    return whole.select("address", "body", S.from_domains("address", ["region0.example.org"]).alias("ours"))


def report_scan(spark, sf_dir):
    """A Markdown report of each source written from its documents, its table, counts and times read back (SRC-22)."""
    path = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("source", F.coalesce("lang", F.lit("none")).alias("lang"), F.length("text").alias("size"))
    number = lambda c: F.format_number(c, 0)
    by = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.replace("lang", F.lit("|"), F.lit("\\|"))), number("n"), F.concat(number("chars"), F.lit(" |")))
    whole = by.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    text = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\nRun at 2024-05-01T10:20:30Z, took 1 min "), F.col("n"), F.lit(" s\n\n- documents: "), number("n"), F.lit("\n- characters: "), number("chars"),
        F.lit(" in all\n- note: none\n\n## By language\n\n| language | documents | characters |\n|:--|--:|--:|\n"), F.col("lines"),
    )
    whole.select("source", text.alias("value")).write.partitionBy("source").option("lineSep", "\n\n").text(path)
    files = spark.read.format("binaryFile").load(f"{path}/*/*.txt").select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    cells = P.report_cells(files)
    report = F.regexp_extract("file", "source=([^/]*)", 1)
    return cells.select(report.alias("report"), "section", "kind", F.col("row").cast("int").alias("row"), "column", "value", "number")


def question_problems(spark, sf_dir):
    """What is wrong with documents of questions, one a nation and one question a customer: some have another status, no priority, parts left out or in another order (SRC-17)."""
    path = _folder(spark)
    k = F.col("c_custkey")
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    asked = F.lit("### The question\nWhat of it?\n\n")
    read = F.lit("### My current reading\nSo far so good.\n\n")
    text = F.concat(
        F.lit("## Q"), n.cast("string"), F.lit(": About "), F.col("c_name"), F.lit("\n- status: "), F.when(k % 7 == 0, "shut").when(k % 17 == 0, "answered").otherwise("open"), F.lit("\n"),
        F.when(k % 5 == 0, "").otherwise("- priority: high\n"), F.lit("- question kind: general\n- in short: it\n\n"), F.when(k % 13 == 0, F.concat(read, asked)).otherwise(F.concat(asked, read)),
        F.when(k % 11 == 0, "").otherwise("### Affects\n- rule: 1\n"),
    )
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", text.alias("text"))
    docs = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "text"))), lambda x: x["text"]), "\n").alias("value"))
    docs.write.partitionBy("c_nationkey").text(path)
    files = spark.read.format("binaryFile").load(f"{path}/*/*.txt").select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).alias("file"), F.col("content").cast("string").alias("text"))
    return Q.problems(files).select(F.col("file").cast("int").alias("nation"), "question", "problem")


def schema_documents(spark, sf_dir):
    """A schema for each nation, every second one as JSON: its customers' segments as classes, order priorities as predicates with patterns and pins (SRC-12, SRC-13)."""
    path = _folder(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.initcap("c_mktsegment").alias("s"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "s", F.upper(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")).alias("p"))
    classes = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("s")).alias("classes"))
    uses = o.groupBy("c_nationkey", "p").agg(F.array_sort(F.collect_set("s")).alias("ss"))
    uses = uses.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("p", "ss"))).alias("ps"))
    pairs = lambda ss: F.transform(ss, lambda s: F.concat(s, F.lit(" -> Order")))
    plain = F.concat(
        F.lit("ENTITY CLASSES\n"), F.array_join(F.transform("classes", lambda s: F.concat(s, F.lit("  what buys as "), F.lower(s))), "\n"), F.lit("\nOrder  what is bought\n\nPREDICATES\n"),
        F.array_join(F.transform("ps", lambda x: F.concat(x["p"], F.lit("  buys so\n  "), F.array_join(pairs(x["ss"]), "; "), F.lit("\n  only: "), F.element_at(x["ss"], 1), F.lit(" -> Order"))), "\n"),
    )
    entry = lambda name, what: F.struct(name.alias("component_class"), what.alias("definition"))
    as_json = F.to_json(F.struct(
        F.concat(F.transform("classes", lambda s: entry(s, F.concat(F.lit("what buys as "), F.lower(s)))), F.array(entry(F.lit("Order"), F.lit("what is bought")))).alias("entity_classes"),
        F.transform("ps", lambda x: entry(x["p"], F.lit("buys so"))).alias("predicates"), F.flatten(F.transform("ps", lambda x: F.transform(x["ss"], lambda s: F.array(s, x["p"], F.lit("Order"))))).alias("patterns"),
        F.map_from_entries(F.transform("ps", lambda x: F.struct(x["p"], F.array(F.array(F.element_at(x["ss"], 1), F.lit("Order")))))).alias("pinned"),
    ))
    docs = classes.join(uses, "c_nationkey").select("c_nationkey", F.when(F.col("c_nationkey") % 2 == 0, plain).otherwise(as_json).alias("value"))
    docs.write.partitionBy("c_nationkey").text(path)
    files = spark.read.format("binaryFile").load(f"{path}/*/*.txt").select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).alias("file"), F.col("content").cast("string").alias("text"))
    return D.schema_rows(files).select(F.col("file").cast("int").alias("nation"), "kind", "name", "a", "b")


def kept_evaluations(spark, sf_dir):
    """Evaluations of runs kept as JSON lines, one run a day of orders, in the order of the runs' times whatever their files' names (SRC-24)."""
    path = _folder(spark)
    day = F.to_date("o_orderdate")
    runs = table(spark, sf_dir, "orders").groupBy(day.alias("day"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    # a name that sorts by the day of the month first
    run = F.concat(F.date_format("day", "dd"), F.lit("_"), F.date_format("day", "yyyyMMdd"), F.lit("-"), F.substring("o_orderpriority", 1, 1))
    K.write_whole(runs.select(run.alias("run_id"), F.date_format("day", "yyyy-MM-dd").alias("ran_at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("suffix"), "n", "total"), path, "json")
    kept = S.jsonl(spark, path, "run_id string, ran_at string, suffix int, n long, total double")
    return R.numbered(kept, "ran_at", "suffix").select("run_id", F.col("position").alias("turn"), "n", "total")


def extra_columns(spark, sf_dir):
    """Suppliers as batch records with an extra text column beside the usual ones (PRJ-02)."""
    s = table(spark, sf_dir, "supplier")
    empty = F.lit(None).cast("string")
    batch = s.select(
        F.col("s_suppkey").cast("string").alias("id"), empty.alias("name"), F.col("s_name").alias("title"), empty.alias("notes"), empty.alias("maintainer"), F.struct(F.lit("o").alias("title")).alias("organization"),
        F.array(F.struct(F.lit("t").alias("name"))).alias("tags"), F.array(F.struct(F.lit("CSV").alias("format"))).alias("resources"), empty.alias("license_title"), empty.alias("url"), empty.alias("metadata_created"),
        empty.alias("metadata_modified"), F.lit("f#0").alias("origin"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("place"),
    )
    return S.records(batch, ["place"]).select(F.col("id").cast("long").alias("s_suppkey"), "title", "place")


def restored_outputs(spark, sf_dir):
    """Suppliers and nations as a run wrote them, after a second run failed at the nations when it had replaced the suppliers (SNK-05)."""
    path = _folder(spark)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    with K.Run(spark, f"{path}/journal") as run:
        run.write(names, f"{path}/suppliers")
        run.write(nations, f"{path}/nations")
    try:
        with K.Run(spark, f"{path}/journal") as run:
            run.write(names.withColumn("name", F.lower("name")), f"{path}/suppliers")
            run.write(nations.withColumn("name", F.raise_error(F.lit("no names today")).cast("string")), f"{path}/nations")
    except Exception as e:
        if "no names today" not in str(e):
            raise
    kept = [spark.read.parquet(f"{path}/{x}").withColumn("output", F.lit(x)) for x in ("suppliers", "nations")]
    return kept[0].union(kept[1])


def unmarked_entries(spark, sf_dir):
    """Nations marked by the order priorities of their customers, less the marks of the first priority (SNK-10)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    marks = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("string").alias("name")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("marks"))
    edits = marks.select("name", F.element_at("marks", 1).alias("mark"))
    return K.unmark(marks, edits).select("name", F.array_join("marks", ",").alias("marks"))


def keyed_records(spark, sf_dir):
    """Orders, whose keys must be there once each; finished and open ones must share none (SRC-10, JOIN-03)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    R.require_disjoint(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_orderkey")
    return R.require_unique(orders, "o_orderkey")


QUERIES = {f.__name__: f for f in (
    jsonl_scan, csv_scan, split_parts, text_scan, id_list_scan, batch_scan, harvest_pages, harvest_snapshot, as_run_wrote, appended_rows,
    write_once_report, schema_edits, merged_entries, run_list_scan, pool_design_scan, sections_scan, messages_scan, report_scan, question_problems, schema_documents, kept_evaluations, extra_columns, restored_outputs, unmarked_entries, keyed_records,
)}

ORACLES = {
    "jsonl_scan": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_hash FROM documents",
    "csv_scan": "SELECT c_custkey, c_name, c_mktsegment, '' AS c_comment, true AS in_order FROM customer",
    "split_parts": "SELECT o_orderkey, o_custkey, o_orderpriority, true AS fits FROM orders",
    "text_scan": "SELECT (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name))::INT AS line, n_name FROM nation",
    "id_list_scan": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "batch_scan": f"""SELECT doc_id, source AS organization, coalesce(lang, '') AS lang, 'TXT,CSV' AS formats, sha256(text) AS text_hash,
      (row_number() OVER (PARTITION BY doc_id // {BATCH} ORDER BY doc_id) - 1)::INT AS place FROM documents""",
    "harvest_pages": f"""WITH n AS (SELECT count(*) AS n FROM documents),
      w AS (SELECT unnest(range(0, n, {PAGE})) AS start, n FROM n),
      p AS (SELECT doc_id // {PAGE} * {PAGE} AS start, count(*) AS k FROM documents GROUP BY 1),
      l AS (SELECT start, start % 300 = 0 AS other, k FROM p WHERE start % 700 <> 0
        UNION ALL SELECT p.start + ceil(n.n / {PAGE})::BIGINT * {PAGE}, p.start % 300 = 0, k FROM p, n)
      SELECT coalesce(w.start, l.start) AS start, CASE WHEN w.start IS NULL THEN 'delete' WHEN l.start IS NULL THEN 'fetch'
        WHEN other OR k <> least({PAGE}, n - w.start) THEN 'again' ELSE 'keep' END AS state FROM w FULL JOIN l ON w.start = l.start""",
    "harvest_snapshot": """SELECT d.source, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS saved, count(*) AS reported,
      count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) >= count(*) AS complete FROM documents d GROUP BY 1""",
    "as_run_wrote": "SELECT s_suppkey, s_name FROM supplier",
    "appended_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region",
    "write_once_report": """SELECT coalesce(s_suppkey, c_custkey) AS key, CASE WHEN s_suppkey IS NULL THEN 'added' WHEN c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM supplier FULL JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey IS NULL OR c_custkey IS NULL OR s_nationkey IS DISTINCT FROM c_nationkey""",
    "schema_edits": """SELECT CASE WHEN n_regionkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS name,
      CASE WHEN n_regionkey % 5 = 1 THEN 'new ' || n_name ELSE n_regionkey::VARCHAR END AS definition FROM nation WHERE n_regionkey % 5 <> 2
      UNION ALL SELECT 'region ' || r_name, r_name FROM region""",
    "merged_entries": """SELECT m.first AS n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN (SELECT n_regionkey, min(n_name) AS first FROM nation GROUP BY 1) m USING (n_regionkey) GROUP BY 1""",
    "run_list_scan": "SELECT s_suppkey, s_name FROM supplier",
    "pool_design_scan": "SELECT source AS stratum, count(*) AS size FROM documents GROUP BY 1",
    "sections_scan": """SELECT r_name AS section, (count(*) OVER (PARTITION BY n_regionkey))::INT AS declared,
      (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name))::INT AS number, n_name AS item, 'note on ' || n_name AS notes
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "messages_scan": """SELECT lower(n_name) || '@mail.region' || n_regionkey || '.example.org' AS address,
      'part 1 of ' || n_name || chr(10) || 'part 2 of ' || n_name || chr(10) AS body, n_regionkey = 0 AS ours FROM nation""",
    "report_scan": r"""WITH d AS (SELECT source, coalesce(lang, 'none') AS lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1, 2), w AS (SELECT source, sum(n)::BIGINT AS n, sum(chars)::BIGINT AS chars FROM d GROUP BY 1),
      k AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY lang))::INT AS row FROM d)
      SELECT source AS report, 'By language' AS section, 'table' AS kind, row, unnest(['language', 'documents', 'characters']) AS column, unnest([lang, format('{:,}', n), format('{:,}', chars)]) AS value, unnest([NULL, n, chars])::DOUBLE AS number FROM k
      UNION ALL SELECT source, source, 'count', unnest([5, 6])::INT, unnest(['documents', 'characters']), unnest([format('{:,}', n), format('{:,}', chars) || ' in all']), unnest([n, chars])::DOUBLE FROM w
      UNION ALL SELECT source, source, 'time', 3::INT, unnest(['Run at', 'took']), unnest(['2024-05-01T10:20:30', '1 min ' || n || ' s']), unnest([NULL, 60 + n])::DOUBLE FROM w""",
    "question_problems": """WITH c AS (SELECT c_nationkey AS nation, c_custkey AS k, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INT AS question FROM customer)
      SELECT nation, question, 'status is none of open, answered, withdrawn' AS problem FROM c WHERE k % 7 = 0
      UNION ALL SELECT nation, question, 'an answer is there if and only if the status is answered' FROM c WHERE k % 17 = 0 AND k % 7 <> 0
      UNION ALL SELECT nation, question, 'no priority' FROM c WHERE k % 5 = 0
      UNION ALL SELECT nation, question, 'part out of order: The question' FROM c WHERE k % 13 = 0
      UNION ALL SELECT nation, question, 'no part: Affects' FROM c WHERE k % 11 = 0""",
    "schema_documents": """WITH c AS (SELECT c_custkey, c_nationkey AS nation, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS s FROM customer),
      o AS (SELECT DISTINCT nation, s, upper(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS p FROM orders JOIN c ON o_custkey = c_custkey), n AS (SELECT DISTINCT nation FROM o)
      SELECT DISTINCT nation, 'class' AS kind, s AS name, 'what buys as ' || lower(s) AS a, NULL::VARCHAR AS b FROM c WHERE nation IN (SELECT nation FROM n)
      UNION ALL SELECT nation, 'class', 'Order', 'what is bought', NULL FROM n
      UNION ALL SELECT DISTINCT nation, 'predicate', p, 'buys so', NULL FROM o UNION ALL SELECT nation, 'pattern', p, s, 'Order' FROM o UNION ALL SELECT nation, 'pin', p, min(s), 'Order' FROM o GROUP BY nation, p""",
    "kept_evaluations": """WITH r AS (SELECT o_orderdate::DATE AS day, o_orderpriority[1] AS x, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderdate::DATE, o_orderpriority)
      SELECT strftime(day, '%d_%Y%m%d-') || x AS run_id, row_number() OVER (ORDER BY day, x) - 1 AS turn, n, total FROM r""",
    "extra_columns": "SELECT s_suppkey, s_name AS title, 'nation ' || s_nationkey AS place FROM supplier",
    "restored_outputs": "SELECT s_suppkey AS key, s_name AS name, 'suppliers' AS output FROM supplier UNION ALL SELECT n_nationkey, n_name, 'nations' FROM nation",
    "unmarked_entries": """WITH m AS (SELECT c_nationkey::VARCHAR AS name, list_sort(list(DISTINCT o_orderpriority)) AS marks FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
      SELECT name, array_to_string(marks[2:], ',') AS marks FROM m""",
    "keyed_records": "SELECT o_orderkey, o_orderstatus FROM orders",
}
