import pytest
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import relational as R


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pool_part(spark):
    df = spark.range(30).withColumn("part", R.pool_part(F.col("id")))
    assert [r.id for r in df.where("part = 'held-out'").orderBy("id").collect()] == [8, 11, 14, 17, 20, 23, 26, 29]


def test_positions(spark):
    df = spark.createDataFrame([(i * i,) for i in range(200)], "x long")
    got = R.positions(df, "x").orderBy("x").collect()
    assert [r.position for r in got] == list(range(200))
    assert R.positions(spark.createDataFrame([(5,)], "x long"), "x").first().position == 0


def test_first_and_best_copy(spark):
    df = spark.createDataFrame([("a", 2, False), ("a", 1, False), ("a", 3, True), ("b", 4, False)], "k string, id int, ok boolean")
    assert rows(R.first_copy(df, ["k"], ["id"]), "k", "id", "copies") == [("a", 1, 3), ("b", 4, 1)]
    assert rows(R.best_copy(df, ["k"], F.col("ok"), ["id"]), "k", "id") == [("a", 3), ("b", 4)]


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 1, "z"), ("c", 1, "x"), ("c", 2, ""), ("d", 1, "x"), ("d", 1, "x")], "k string, t int, v string")
    assert rows(R.latest_by_key(df, ["k"], "t", "v"), "k", "t", "v") == [("a", 2, "y"), ("d", 1, "x")]


def test_fold_and_vote(spark):
    df = spark.createDataFrame([("k", "B", 1), ("k", "A", 2), ("k", "B", 3), ("k", "A", 4), ("j", "C", 5)], "k string, s string, o int")
    assert rows(R.spelling_fold(df, ["k"], "s"), "k", "s", "spellings", "rows") == [("j", "C", 1, 1), ("k", "A", 2, 4)]
    assert rows(R.majority_vote(df, ["k"], "s", ["o"]), "k", "s", "disagree") == [("j", "C", False), ("k", "B", True)]


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    got = dict(rows(R.largest_remainder(df, "k", "n", 7), "k", "places"))
    assert got == {"a": 4, "b": 2, "c": 1} and sum(got.values()) == 7


def test_fair_prefix(spark):
    df = spark.createDataFrame([("t", 0, True), ("t", 1, True), ("t", 2, None), ("t", 3, True), ("h", 0, False), ("h", 1, True)], "p string, o int, ok boolean")
    assert rows(R.fair_prefix(df, "p", "o", F.col("ok")), "p", "o") == [("t", 0), ("t", 1)]


def test_diff_and_bags(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert rows(R.keyed_diff(a, b, ["k"]), "k", "change") == [(2, "changed"), (3, "removed"), (4, "added")]
    x = spark.createDataFrame([("t",), ("t",), ("u",)], "w string")
    y = spark.createDataFrame([("t",), ("v",)], "w string")
    assert rows(R.bag_difference(x, y, ["w"]), "w", "missing") == [("t", 1), ("u", 1)]


def test_twins(spark):
    df = spark.createDataFrame([("a", "snow", "daily snow"), ("b", "ice", "daily snow"), ("c", "snow", "weekly snow"), ("d", "fire", "burned"), ("e", "snow", "daily snow"), ("f", "", ""), ("g", None, "")], "id string, title string, notes string")
    assert rows(R.twin_kinds(df, "id", "title", "notes"), "id", "kind") == [("a", "whole text"), ("b", "notes only"), ("c", "title only"), ("e", "whole text")]


def test_unique_and_disjoint(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert R.require_unique(df, "k").count() == 2
    with pytest.raises(Exception, match="missing or repeated"):
        R.require_unique(df.union(df), "k").collect()
    with pytest.raises(ValueError):
        R.require_disjoint(df, df, "k")


def test_common_records(spark):
    df = spark.createDataFrame([("r1", 1, "f"), ("r2", 1, "f"), ("r1", 2, "f"), ("r1", 3, "f"), ("r2", 3, "g")], "run string, rec int, fp string")
    assert rows(R.common_records(df, "run", "rec", "fp"), "rec") == [(1,)]


def test_components_chains_walk(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(rows(G.connected_components(edges), "node", "component"))
    assert got[40] == 1 and got[101] == 100 and len(got) == 42
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string")
    assert rows(G.resolve_chains(merges), "old", "new") == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")]
    with pytest.raises(ValueError, match="cycle"):
        G.resolve_chains(spark.createDataFrame([("a", "b"), ("b", "a")], "old string, new string"))
    up = spark.createDataFrame([("c", "p"), ("p", "g"), ("z", "g")], "child string, parent string")
    assert rows(G.walk(up, spark.createDataFrame([("c",)], "node string")), "node", "depth") == [("c", 0), ("g", 2), ("p", 1)]
