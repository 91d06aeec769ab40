"""Runs that end early: harvests go on, outputs stand together, answers are asked for once, bootstraps stay distributed."""

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import stats
from factloom.sources import harvest as H
from factloom.sources import lookup as A
from factloom.sources import reports as R
from factloom.sources import sinks as K


class Catalog:
    """A stub catalog of `count` records that can be told to fail at some pages."""

    def __init__(self, count):
        self.count, self.broken, self.asked, self.word = count, set(), [], "r"
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = parse_qs(urlparse(self.path).query)
                start, n = int(q["start"][0]), int(q["rows"][0])
                if n:
                    outer.asked.append(start)
                if n and start in outer.broken:
                    self.send_response(404)
                    self.end_headers()
                    return
                body = {"result": {"count": outer.count, "results": [{"id": f"{outer.word}{i}"} for i in range(start, min(outer.count, start + n))]}}
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *args):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/search"


@pytest.fixture()
def catalog():
    c = Catalog(23)
    yield c
    c.server.shutdown()


def content(spark, folder):
    return sorted((r.page, r.position, r.id) for r in H.landed(spark, folder).collect())


def test_harvest_goes_on_where_it_stopped(spark, tmp_path, catalog):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert H.harvest(spark, catalog.url, whole, rows=5, pause=0.01) == {"fetch": 5}
    want = content(spark, whole)
    assert [p[1:] for p in want] == [(i, f"r{i}") for i in range(23)]

    catalog.broken, catalog.asked = {10}, []
    with pytest.raises(Exception, match="404"):
        H.harvest(spark, catalog.url, parts, rows=5, at_once=1, pause=0.01)
    assert {p for p, _, _ in content(spark, parts)} == {0, 5}
    (tmp_path / "parts" / f".wave-{uuid.uuid4().hex}").mkdir()  # what a killed run leaves
    catalog.broken, catalog.asked = set(), []
    assert H.harvest(spark, catalog.url, parts, rows=5, pause=0.01) == {"keep": 2, "fetch": 3}
    assert sorted(catalog.asked) == [10, 15, 20] and content(spark, parts) == want
    assert not [n for n in K.names_in(spark, parts) if n.startswith(".")]
    catalog.asked = []
    assert H.harvest(spark, catalog.url, parts, rows=5, pause=0.01) == {"keep": 5} and not catalog.asked


def test_harvest_of_a_catalog_that_shrank_and_of_another_page_size(spark, tmp_path, catalog):
    folder = str(tmp_path / "pages")
    H.harvest(spark, catalog.url, folder, rows=5, pause=0.01)
    catalog.count, catalog.word = 12, "s"
    # the last page is short now, two are out of range; whole pages that landed stay
    assert H.harvest(spark, catalog.url, folder, rows=5, pause=0.01) == {"keep": 2, "again": 1, "delete": 2}
    assert [x[2] for x in content(spark, folder)] == [f"r{i}" for i in range(10)] + ["s10", "s11"]
    assert H.harvest(spark, catalog.url, folder, rows=4, pause=0.01)["again"] == 1
    assert [x[2] for x in content(spark, folder)] == [f"s{i}" for i in range(12)]
    catalog.count = 0
    assert H.harvest(spark, catalog.url, folder, rows=4, pause=0.01) == {"delete": 3} and content(spark, folder) == []


def hashes(path):
    import hashlib

    return sorted(hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("part-*"))


def test_outputs_stand_together(spark, tmp_path):
    a, b, c, journal = (str(tmp_path / x) for x in ("a", "b", "c", "journal"))
    with K.Run(spark, journal) as run:
        run.write(spark.range(5), a)
        run.write(spark.range(7), b)
    before = hashes(a), hashes(b)
    fails = spark.range(1).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"), K.Run(spark, journal) as run:
        run.write(spark.range(50), a)
        run.write(spark.range(3), c)
        assert spark.read.parquet(a).count() == 50
        run.write(fails, b)
    assert (hashes(a), hashes(b)) == before and not K.exists(spark, c)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_outputs_of_a_killed_run_come_back_with_the_next(spark, tmp_path):
    a, c, journal = (str(tmp_path / x) for x in ("a", "c", "journal"))
    with K.Run(spark, journal) as run:
        run.write(spark.range(5), a)
    before = hashes(a)
    killed = K.Run(spark, journal).__enter__()
    killed.write(spark.range(50), a)
    killed.write(spark.range(50), a)  # the same output twice
    killed.write(spark.range(3), c)
    # nothing closed it; a roll back that itself is cut short goes on
    K.delete(spark, c)
    assert K.roll_back(spark, journal) == [c, a, a]
    assert hashes(a) == before and not K.exists(spark, c) and K.roll_back(spark, journal) == []
    killed = K.Run(spark, journal).__enter__()
    killed.write(spark.range(50), a)
    with K.Run(spark, journal) as run:
        run.write(spark.range(2), c)
    assert hashes(a) == before and spark.read.parquet(c).count() == 2


def test_an_output_is_never_gone(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    K.write_whole(spark.range(4), out)
    real = K.move
    monkeypatch.setattr(K, "move", lambda s, old, new: False if ".new-" in old else real(s, old, new))
    with pytest.raises(OSError, match="could not take"):
        K.write_whole(spark.range(9), out)
    assert spark.read.parquet(out).count() == 4


def test_answers_are_asked_for_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def ask(prompt):
        (log / uuid.uuid4().hex).write_text(prompt)
        return prompt + str(uuid.uuid4())

    texts = spark.range(40).select("id", F.concat(F.lit("p"), (F.col("id") % 20).cast("string")).alias("prompt")).withColumn("key", A.answer_key("prompt"))
    answers, new = A.with_cache(texts, spark.createDataFrame([], "key string, reply string"), ask)
    assert new.count() == 20 and answers.count() == 40 and answers.select("reply").distinct().count() == 20
    assert answers.join(new, ["key", "reply"], "left_semi").count() == 40 and len(list(log.iterdir())) == 20
    store = str(tmp_path / "store")
    first = A.answered(texts.where("id < 5"), store, ask)
    again = A.answered(texts, store, ask)
    assert first.count() == 5 and again.where("reply is null").isEmpty() and len(list(log.iterdir())) == 40
    assert A.answered(texts, store, lambda p: 1 / 0).where("reply is null").isEmpty()


REPORT = """# Run report

Run at 2024-05-01T10:20:30Z, took 1 h 2 min 3.5 s; checked at 2024-05-02 08:00

- texts: 1,234
- share: 12.5 % of all
- note: none

## Numbers *by* class ##

| class | found | share |
|:--|--:|---|
| Sea \\| Ice | 1,000 | 3.5 % |
| Land | -2 | |

| no | rule |
| 1 | 2 |

| a | |
|---|---|
| x | y | z |
"""


def test_report_cells(spark):
    df = spark.createDataFrame([("r.md", REPORT), ("empty.md", "")], "file string, text string")
    got = sorted((r.section, r.kind, r.place, r.row, r.column, r.value, r.number) for r in R.report_cells(df).collect())
    assert [x for x in got if x[1] == "count"] == [("Run report", "count", 0, 5, "texts", "1,234", 1234.0), ("Run report", "count", 0, 6, "share", "12.5 % of all", 12.5)]
    assert [(x[4], x[5], x[6]) for x in got if x[1] == "time"] == [("Run at", "2024-05-01T10:20:30", None), ("checked at", "2024-05-02 08:00", None), ("took", "1 h 2 min 3.5 s", 3723.5)]
    assert [x[2:] for x in got if x[1] == "table"] == [
        (1, 1, "class", "Sea | Ice", None), (1, 1, "found", "1,000", 1000.0), (1, 1, "share", "3.5 %", 3.5), (1, 2, "class", "Land", None), (1, 2, "found", "-2", -2.0), (1, 2, "share", "", None),
        (3, 1, "a", "x", None), (3, 1, "column 2", "y", None), (3, 1, "column 3", "z", None),
    ]


@pytest.mark.parametrize("leaf", [256, 4])
def test_bootstrap_has_the_distribution_of_resampled_records(spark, monkeypatch, leaf):
    """Mean, spread and quantiles of the redraws equal those of plain resampling, with one leaf and with a tree of many."""
    monkeypatch.setattr(stats, "LEAF_CLASSES", leaf)
    rng = np.random.default_rng(4)
    x = np.stack([rng.binomial(9, 0.6, 300), np.full(300, 9), rng.binomial(5, 0.5, 300), rng.integers(5, 9, 300)], 1)
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], "na long, da long, nb long, db long")
    got = stats.paired_bootstrap(spark, df, 4000, 1).head()
    sums = np.stack([x[rng.integers(0, 300, 300)].sum(0) for _ in range(4000)])
    plain = np.sort(sums[:, 0] / sums[:, 1] - sums[:, 2] / sums[:, 3])
    low, high = stats.percentile_range(list(plain), 300)
    spread = plain.std()
    assert got.used == 4000 and abs(got.value - (x[:, 0].sum() / x[:, 1].sum() - x[:, 2].sum() / x[:, 3].sum())) < 1e-12
    assert abs(got.low - low) < 0.25 * spread and abs(got.high - high) < 0.25 * spread
    assert got == stats.paired_bootstrap(spark, df.repartition(7), 4000, 1).head()
    none = stats.paired_bootstrap(spark, df.limit(0), 100, 1).head()
    assert (none.value, none.low, none.used) == (None, None, 0)


def test_unmark(spark):
    entries = spark.createDataFrame([("A", ["x", "y"], 1), ("B", ["x"], 2), ("C", None, 3)], "name string, marks array<string>, n int")
    edits = spark.createDataFrame([("A", "x"), ("B", "x")], "name string, mark string")
    assert sorted((r.name, r.marks, r.n) for r in K.unmark(entries, edits).collect()) == [("A", ["y"], 1), ("B", [], 2), ("C", None, 3)]
    for bad in (("C", "x"), ("A", "z"), ("Q", "x")):
        with pytest.raises(Exception, match="no such mark"):
            K.unmark(entries, spark.createDataFrame([bad], "name string, mark string")).collect()
