import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from factloom.operators import ledger as L
from factloom.sources import files as S
from factloom.sources import lookup as A
from factloom.sources import questions as Q
from factloom.sources import sinks as K
from factloom.sources import schema_text as P
from factloom.sources.paged import PagedCatalog
from factloom.streaming import landing as M


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def batch(tmp, name, ids, run="r1"):
    recs = [{"id": i, "title": f"T{i}", "notes": "n", "organization": {"title": "Org"}, "tags": [{"name": "a"}], "resources": [{"format": "CSV"}, {"format": "CSV"}, {"format": "PDF"}, {"format": ""}]} for i in ids]
    (tmp / name).write_text(json.dumps({"request": {"rows": 2, "start": 0, "sort": "x"}, "fetched_at": "2026-01-01T00:00:00", "http_status": 200, "catalog_count": 9, "run_id": run, "records": recs}))


def test_json_batches(spark, tmp_path):
    batch(tmp_path, "b0.json", ["1", "2"])
    batch(tmp_path, "b1.json", ["3"])
    got = S.records(S.json_batches(spark, str(tmp_path / "*.json"))).orderBy("id").collect()
    assert [r.origin for r in got] == ["b0.json#0", "b0.json#1", "b1.json#0"]
    assert got[0].formats == ["CSV", "PDF"] and got[0].organization == "Org" and got[0].tags == ["a"]
    with pytest.raises(ValueError, match="reserved"):
        S.records(S.json_batches(spark, str(tmp_path)), ["title"])


def test_jsonl_names_the_bad_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": "2", "n": 3}\n')
    assert rows(S.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int"), "id", "n") == [("1", 2), ("2", 3)]
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{broken\n')
    with pytest.raises(Exception, match="bad line in b.jsonl"):
        S.jsonl(spark, str(tmp_path / "b.jsonl"), "id string, n int").collect()


def test_csv_with_lines(spark, tmp_path):
    (tmp_path / "batch_000.csv").write_bytes('﻿id,subject,note\r\n1,"two\r\nlines",x\r\n\r\n2,s\r\n'.encode())
    got = rows(S.csv_with_lines(spark, str(tmp_path / "batch_*.csv"), ["id", "subject"], ["note", "rules"]), "id", "subject", "note", "rules", "file", "line")
    assert got == [("1", "two\nlines", "x", "", "batch_000.csv", 2), ("2", "s", "", "", "batch_000.csv", 5)]
    with pytest.raises(Exception, match="lacks missing"):
        S.csv_with_lines(spark, str(tmp_path / "batch_*.csv"), ["missing"]).collect()


def test_text_and_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_bytes("﻿# comment\r\nid\r\nb,1\r\na,2\r\nb,3\r\n\r\n".encode())
    assert S.utf8_text(spark, str(tmp_path / "ids.txt")).first().text.startswith("# comment\nid\nb")
    assert rows(S.id_list(spark, str(tmp_path / "ids.txt")), "place", "id") == [(1, "b"), (2, "a")]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    with pytest.raises(Exception, match="not UTF-8"):
        S.utf8_text(spark, str(tmp_path / "bad.txt")).collect()


def test_sectioned_items(spark, tmp_path):
    (tmp_path / "doc.md").write_text("# Head\n\n## 1. First (2)\n- one\n  more of one\n- two\n\n## Second (3)\n\n1. three\n")
    items = S.sectioned_items(S.utf8_text(spark, str(tmp_path / "doc.md")))
    assert rows(items, "line", "section", "item", "notes") == [(4, "First", "one", "more of one"), (6, "First", "two", ""), (10, "Second", "three", "")]
    assert rows(S.wrong_counts(items), "section", "declared", "items") == [("Second", 3, 1)]


def test_write_whole_keeps_the_old_output_of_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "out")
    K.write_whole(spark.range(3), path)
    with pytest.raises(Exception, match="no more"):
        K.write_whole(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(FileExistsError):
        K.write_whole(spark.range(1), path, replace=False)
    K.write_whole(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_changed_bytes_stop_the_scan_of_a_run(spark, tmp_path):
    out, store = str(tmp_path / "out"), str(tmp_path / "store")
    K.write_whole(spark.range(3), out, "json")
    runs = spark.createDataFrame(K.manifest(spark, "r1", {}, {"ids": out}, {}, "h").collect())
    K.keep_versions(spark, out, store)
    K.keep_versions(spark, out, store)
    kept = spark.read.parquet(store)
    assert kept.count() == kept.select("sha256").distinct().count() and S.as_run_wrote(runs, kept, "r1", "ids").count() == runs.count()
    with pytest.raises(Exception, match="not as written"):
        S.as_run_wrote(runs, kept.withColumn("content", F.lit("x").cast("binary")), "r1", "ids").collect()
    with pytest.raises(Exception, match="not as written"):
        S.as_run_wrote(runs, kept.limit(0), "r1", "ids").collect()


def test_page_states(spark):
    wanted = spark.createDataFrame([(s, 2, "x", 2 if s < 6 else 1) for s in (0, 2, 4, 6)], "start long, rows int, sort string, due int")
    landed = spark.createDataFrame([(0, 2, "x", 2), (2, 2, "x", 1), (6, 2, "x", 1), (8, 2, "x", 2)], "start long, rows int, sort string, n_records int")
    assert rows(S.page_states(wanted, landed), "start", "state") == [(0, "keep"), (2, "again"), (4, "fetch"), (6, "keep"), (8, "delete")]


def test_emails(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.eml").write_text(f"From: Ann <ann@lab.example.org>\nDate: Mon, 1 Jan 2026 00:00:00 +0000\nSubject: notes part {i} of 2\n\nbody{i}\n")
    m = S.emails(spark, str(tmp_path / "*.eml"))
    assert m.where(S.from_domains("address", ["example.org"])).count() == 2 and m.where(S.from_domains("address", ["ample.org"])).count() == 0
    assert rows(S.joined_parts(m, ["address"]), "address", "body") == [("ann@lab.example.org", "body1\nbody2\n")]
    assert S.joined_parts(m.where("subject like '%1 of%'"), ["address"]).count() == 0


SCHEMA = """# comment
ENTITY CLASSES
--------------
Instrument        a device
                  rule 19: standalone
Aqua
instrument        again

PREDICATES
----------
(some explanation)

ABOARD            is carried by
                  Instrument -> Spacecraft; Probe -> Spacecraft
                  only: Instrument -> Spacecraft; any -> Platform
                  source: text #3
                  held-out only
PATTERNS
--------
Instrument ABOARD Mission
                  source: mentor
!! nobody reads this line
"""


def test_schema_text(spark):
    s = P.parse_schema(SCHEMA)
    assert s.classes == {"Instrument": "a device", "Aqua": ""} and s.pins == {"ABOARD": [("Instrument", "Spacecraft"), ("any", "Platform")]}
    assert s.patterns == [("Instrument", "ABOARD", "Spacecraft"), ("Probe", "ABOARD", "Spacecraft"), ("Instrument", "ABOARD", "Mission")]
    assert s.sources == {"ABOARD": "text #3", "Instrument ABOARD Mission": "mentor"} and s.held_out == {"ABOARD"} and s.marks == {"Instrument": "rule 19: standalone"}
    assert [n for n, _ in s.unread] == [7, 11, 22]
    assert s.frames(spark)["pins"].count() == 2 and s.frames(spark)["marks"].count() == 2
    entries = [{"component_class": "A", "definition": "x"}, {"component_class": "a"}]
    j = P.parse_schema_json(json.dumps({"entity_classes": entries, "predicates": [], "patterns": [["A", "R", "A"]], "pinned": {"R": [["A", "any"]]}}))
    assert j.classes == {"A": "x"} and j.patterns == [("A", "R", "A")] and j.pins == {"R": [("A", "any")]} and j.unread
    for bad in ("[]", "{}", '{"entity_classes": [{}], "predicates": []}', '{"entity_classes": [], "predicates": [], "pinned": {"R": []}}'):
        with pytest.raises(ValueError):
            P.parse_schema_json(bad)


QUESTIONS = """intro - status: open
## Q1: Which sea?
- status: answered
- priority: high
- question kind: general
- in short: seas

### The question
Which?
- status: not a head

### My current reading
All.

### The answer
That one.

### Affects
- rule: 4
## Q1: Again
- status: shut
- status: open
- question kind: general
- in short: x

### Context

### The question
Q
### Options
o
### Example record
- record id: zz
- pool position: four
- title: t
- colour: red
- classed triple: "a" (A) HAS "b" (B)
- classed triple: a HAS b
### Example record
- record id: 0123abcd
- pool position: 4
- pool position: 5
- title: t
- notes: n
- source text: s
### Mine
### Context
c
"""


def test_question_documents(spark):
    df = spark.createDataFrame([("q.md", QUESTIONS), ("none.md", "no questions"), ("bare.md", "## Q7: T")], "file string, text string")
    got = {r.title: r for r in Q.questions(df).collect()}
    assert got["Which sea?"]["head"]["status"] == "answered" and [p.name for p in got["Which sea?"].parts] == ["The question", "My current reading", "The answer", "Affects"]
    assert got["Which sea?"].parts[0].text == "Which?\n- status: not a head" and got["T"]["head"] is None
    bad = sorted((r.line, r.problem) for r in Q.problems(df).where("file = 'q.md'").collect())
    assert bad == sorted([
        (20, "number is repeated or out of order"), (20, "status is there twice"), (20, "no priority"), (21, "status is none of open, answered, withdrawn"), (20, "no part: My current reading"), (20, "no part: Affects"),
        (20, "Options and Consequences come together"), (26, "part is empty: Context"), (28, "part out of order: The question"), (32, "part out of order: Example record"), (32, "record without notes"),
        (32, "record without source text"), (33, "not a record id"), (34, "pool position is no number"), (36, "no such field of a record"), (38, "not a classed triple"), (39, "part out of order: Example record"),
        (39, "pool position is there twice"), (46, "no such part: Mine"), (47, "part out of order: Context"),
    ])
    assert {r.problem for r in Q.problems(df).where("file = 'bare.md'").collect()} == {f"no {x}" for x in Q.HEAD} | {f"no part: {p}" for p, n in Q.PARTS.items() if n == "1"}


class Catalog(BaseHTTPRequestHandler):
    failures = [503]

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        start, n = int(q["start"][0]), int(q["rows"][0])
        if n and Catalog.failures:
            self.send_response(Catalog.failures.pop())
            self.end_headers()
            return
        body = json.dumps({"result": {"count": 7, "results": [{"id": f"r{i}"} for i in range(start, min(7, start + n))]}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture()
def server():
    s = HTTPServer(("127.0.0.1", 0), Catalog)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/search"
    s.shutdown()


def test_paged_catalog(spark, server, tmp_path):
    spark.dataSource.register(PagedCatalog)
    df = spark.read.format("paged_catalog").option("url", server).option("rows", 3).option("pause", 0.01).load()
    assert df.rdd.getNumPartitions() == 3 and rows(df, "position", "id") == [(i, f"r{i}") for i in range(7)]
    stream = spark.readStream.format("paged_catalog").option("url", server).option("rows", 3).option("pause", 0.01).load()
    q = stream.writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path)).trigger(processingTime="200 milliseconds").start()
    for _ in range(100):
        if spark.table("pages").count() >= 7:
            break
        q.awaitTermination(0.2)
    q.stop()
    assert rows(spark.table("pages"), "id") == [(f"r{i}",) for i in range(7)]


def test_missing_pages(spark):
    want = spark.createDataFrame([(0, 2, "s"), (2, 2, "s"), (4, 2, "s")], "start int, rows int, sort string")
    have = spark.createDataFrame([(0, 2, "s", 2, 2), (2, 2, "s", 1, 2)], "start int, rows int, sort string, n_records int, expected int")
    assert rows(S.missing_pages(want, have), "start") == [(2,), (4,)]


def test_lookup_cache_and_rows(spark):
    texts = spark.createDataFrame([(1, "MODIS is aboard Aqua"), (2, "MODIS is aboard Aqua"), (3, "nothing")], "id int, text string").withColumn("prompt", F.col("text")).withColumn("key", A.answer_key("prompt"))
    answers, new = A.with_cache(texts, spark.createDataFrame([], "key string, reply string"), A.pattern_extractor)
    assert new.count() == 2
    got = A.rows_of_replies(answers.select("id", "text", "reply"))
    assert rows(got, "id", "subject", "predicate", "object", "problem") == [(1, "MODIS", "ABOARD", "Aqua", None), (2, "MODIS", "ABOARD", "Aqua", None)]
    again, new2 = A.with_cache(texts, new, lambda p: 1 / 0)
    assert new2.count() == 0 and again.where("reply is null").count() == 0
    bad = spark.createDataFrame([(1, "abc", '{"triples": [{"subject": "abc", "predicate": "P", "object": "x", "source_text": "zzz"}, {"subject": 1}]}'), (2, "abc", "prose")], "id int, text string, reply string")
    assert rows(A.rows_of_replies(bad), "id", "problem") == [(1, "malformed"), (1, "source not in text"), (2, "reply malformed")]

    def fails(prompt):
        raise OSError("down")

    errors = A.ask_all(texts.limit(2), fails, most_failures=100)
    assert errors.where("error = 'down'").count() == 2


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    out = str(tmp_path / "out")
    assert K.write_once(a, out, ["k"]).count() == 0
    assert rows(K.write_once(a.where("k = 1").withColumn("v", F.lit("z")), out, ["k"]), "k", "change") == [(1, "changed"), (2, "removed")]
    K.append_by_name(spark.createDataFrame([(3,)], "k long"), out)
    assert rows(spark.read.parquet(out), "k", "v") == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(ValueError):
        K.append_by_name(a.withColumn("w", F.lit(1)), out)
    K.write_whole(spark.range(10), str(tmp_path / "csv"), "csv", most_rows=3)
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) >= 4
    m = K.manifest(spark, "run1", {"in": out}, {"csv": str(tmp_path / "csv")}, {"a": 1}, "ok")
    assert m.where("role = 'output'").count() >= 4 and m.where("length(sha256) <> 64").count() == 0
    r = K.rename_entries(spark.createDataFrame([("A", "R"), ("B", "R")], "s string, p string"), spark.createDataFrame([("A", "C")], "old string, new string"), ["s"])
    assert rows(r, "s", "p") == [("B", "R"), ("C", "R")]
    entries = spark.createDataFrame([("A", "d"), ("B", "e")], "name string, definition string")
    plan = spark.createDataFrame([("rename", "A", "Z"), ("remove", "B", None), ("add", "N", "new")], "op string, name string, value string")
    assert rows(K.edit_plan(entries, plan), "name", "definition") == [("N", "new"), ("Z", "d")]
    with pytest.raises(ValueError, match="cannot be carried out"):
        K.edit_plan(entries, spark.createDataFrame([("remove", "Q", None)], "op string, name string, value string"))
    old = spark.createDataFrame([("f", "p1", "h1"), ("f", "p2", "h2")], "file string, path string, sha256 string")
    assert rows(K.superseded(old, old.where("path = 'p2'")), "path") == [("p1",)]
    assert rows(S.as_of_run(old.withColumn("run_id", F.col("path")), "p1", "f"), "sha256") == [("h1",)]


def test_ledger(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    kept, ledger = L.split_by_reason(df, F.when(F.col("v").isNull(), "empty"), "clean", "record", "id")
    L.require_balance(df, kept, ledger)
    assert rows(ledger, "record_id", "reason", "action") == [("2", "empty", "dropped")]
    with pytest.raises(ValueError):
        L.require_balance(df, kept, ledger.limit(0))


def test_fuzz():
    assert L.fuzz_cleaning(300, 1) == []


def test_streaming_landing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    batch(src, "b0.json", ["1", "2"])
    batch(src, "b1.json", ["2", "3"])
    stream = M.batch_stream(spark, str(src)).withColumn("at", F.to_timestamp("fetched_at"))
    M.land_first_copies(stream, "id", "at", "1 hour", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id") == [("1",), ("2",), ("3",)]
    q = M.latest_stream(stream.select("id", "at", "title"), ["id"], "at", "title").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("latest"), "id", "title") == [("1", "T1"), ("2", "T2"), ("3", "T3")]
    w = M.counts_by_window(stream, "at", "id", "10 minutes", "5 minutes", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sum(r.n for r in spark.table("w").collect()) == 8


def test_latest_stream_leaves_conflicts_out(spark):
    df = spark.createDataFrame([("a", "2020-01-01", "x"), ("a", "2020-01-02", "y"), ("a", "2020-01-02", "z"), ("b", "2020-01-02", "p"), ("b", "2020-01-02", "p"), ("b", "2020-01-01", "q")], "k string, d string, v string")
    got = M.latest_stream(df.select("k", F.to_timestamp("d").alias("t"), "v"), ["k"], "t", "v")
    assert rows(got, "k", "v") == [("a", None), ("b", "p")]


def test_short_page_is_an_error(monkeypatch):
    from factloom.sources import paged

    monkeypatch.setattr(paged, "fetch", lambda *a, **k: {"count": 5, "results": [{"id": "1"}, {"id": "2"}]})
    assert len(list(paged._rows("u", 0, 3, 0.0))) == 2
    with pytest.raises(ValueError, match="2 records, 3 due"):
        list(paged._rows("u", 0, 3, 0.0, 3))
