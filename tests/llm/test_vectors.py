"""Operators on vectors against brute force, and on awkward tables."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import hnsw_dedup as H
from factloom.llm import topk_search as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(seed=0, n=400, dim=16):
    """Clusters of near and exact copies, with ties."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dim)) * rng.choice([0, 0.05, 0.2], (n, 1))
    x[1:6] = x[0]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), rng.integers(0, 3, n)


def table(spark, x, labels):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels, strict=True))], SCHEMA)


ODD = [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan"), 1.0], 1), (1003, [float("inf"), 1.0], 1), (1004, [], 1), (1005, [0.0] * 16, 0), (1006, [1.0] * 3, 0), (1007, [1.0] * 3, 0), (1008, [0.5] * 16, None), (None, [0.5] * 16, 0)]


def brute_topk(rows, k, every):
    v = {i: [int(np.floor(256 * float(np.float32(c)))) for c in e] for i, e, _ in rows if i is not None and e and all(c is not None and np.isfinite(c) for c in e) and len(e) == 16}
    out = []
    for q in sorted(i for i in v if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("scale", [1.0, 37.0])
def test_topk(spark, scale):
    x, labels = cloud()
    x = x * np.float32(scale)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels, strict=True))] + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in K.topk_search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 5, 20)
    again = sorted(tuple(r) for r in K.topk_search(df.union(df), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert again == got


def test_topk_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert K.topk_search(empty, F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)
    assert K.topk_search(one, F.col("vec_id") % 2 == 0).count() == 0
    three = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(3)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in K.topk_search(three, F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 2), (2, 1, 0), (2, 2, 1)]
    odd = spark.createDataFrame(ODD[:6], SCHEMA)
    assert K.topk_search(odd, F.col("vec_id") % 2 == 0).count() == 0


def test_topk_counts_repeated_rows_once(spark):
    """Four tight clusters of three, all but three rows ten-fold: copies near a pivot are one neighbour."""
    rng = np.random.default_rng(8)
    ids = [r.vec_id for r in spark.range(12).withColumnRenamed("id", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").collect()]
    rows = [(c, [float(v) for v in np.float32(np.eye(16)[i % 4] + rng.normal(size=16) * 0.01)], 0) for i, c in enumerate(ids)]
    # the pivots are the first four rows by hash: three single ones and a repeated one, one in each cluster
    df = spark.createDataFrame(rows[:3] + rows[3:] * 10, SCHEMA)
    got = sorted(tuple(r) for r in K.topk_search(df, F.col("vec_id") >= 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 5, 1)


@pytest.mark.parametrize("large", [1e4, 1e8, 1e17, 1e154, 1.7e308])
def test_topk_beyond_doubles_and_longs(spark, large):
    """Products that no double or long holds: ranks are exact, scores the nearest longs."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4).clip(-1, 1) * rng.choice([1.0, 1e-3, large / 1e3, large], 4)], 0) for i in range(60)]
    rows += [(100 + i, [large, -large, float(i), 0.5], 0) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in K.topk_search(df, F.col("vec_id") % 4 == 0).select("query_id", "rank", "vec_id", "score").collect())
    exact = {i: [Fraction(c) * 256 // 1 for c in e] for i, e, _ in rows}
    want = []
    for q in sorted(i for i in exact if i % 4 == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[c], strict=True)), c) for c in exact if c != q)[:5]
        want += [(q, r, c, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, c) in enumerate(best, 1)]
    assert got == want


def test_digits_sort_as_numbers():
    rng = np.random.default_rng(1)
    numbers = [int(a) ** int(b) * int(c) for a, b, c in zip(rng.integers(1, 99, 300), rng.integers(0, 60, 300), rng.choice([-1, 1], 300), strict=True)] + [0, -1, 1]
    assert sorted(numbers) == sorted(numbers, key=K._digits)


def test_graph_by_insertion():
    """Links of each node are few and lead everywhere; searches of both sides find what brute force does."""
    x, _ = cloud(5, 900, 24)
    ids = np.random.default_rng(6).permutation(10**6)[: len(x)].astype(np.int64)
    s = H.Setting(batch=32)
    order = H.order_of_insertion(ids, s.links)
    ids, unit = ids[order], H.unit_rows([list(map(float, r)) for r in x[order]])
    graph = H.Graph.build(ids, unit, s)
    assert [layer.shape for layer in graph.layers][0] == (900, 24) and all(len(a) > len(b) for a, b in zip(graph.layers, graph.layers[1:], strict=False))
    truth = (unit @ unit.T >= s.cosine) & ~np.eye(len(ids), dtype=bool)
    found = H.linked(graph, graph, s)
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.995 * truth.sum() > 0
    # a graph without links reaches nothing, so the audit turns to exact comparison
    lost = H.Graph(ids, unit, [np.full_like(layer, -1) for layer in graph.layers])
    assert (H.linked(lost, lost, s) == truth).all()


def brute_links(rows, cosine=0.93):
    ok = {i: (np.array(e, np.float64), c) for i, e, c in rows if i is not None and c is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)}
    links = {i: set() for i, *_ in rows}
    for i, (a, c) in ok.items():
        for j, (b, d) in ok.items():
            if i != j and c == d and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i].add(j)
    low = {i: i for i in links}
    while True:
        new = {i: min([low[i], *(low[j] for j in s)]) if i is not None else None for i, s in links.items()}
        if new == low:
            return {i: (len(links[i]), low[i]) for i in links}
        low = new


@pytest.mark.parametrize("setting", [H.Setting(), H.Setting(shard_rows=40, block_rows=16, links=4, beam=4), H.Setting(beam=2, links=3, recall=1.0)])
def test_hnsw(spark, setting):
    x, labels = cloud(4)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels, strict=True))] + [r for r in ODD if r[0] is not None]
    got = {r.vec_id: r for r in H.hnsw_dedup(spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit(1)).withColumn("n", F.lit(1)), setting).collect()}
    want = brute_links(rows)
    assert set(got) == set(want)
    found, true = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert 0.98 * true <= found <= true and all(r.n_links <= want[i][0] for i, r in got.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert np.mean([r.component_id == want[i][1] for i, r in got.items()]) >= 0.97


def test_hnsw_awkward(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.hnsw_dedup(empty).count() == 0
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in H.hnsw_dedup(odd).collect()}
    assert got[1006] == (1, 1006, True) and got[1007] == (1, 1006, False) and got[1000] == (0, 1000, True) and got[None] == (0, None, True)
    same = spark.createDataFrame([(i, [1.0, 2.0], 7) for i in range(50)], SCHEMA)
    assert {(r.n_links, r.component_id) for r in H.hnsw_dedup(same.union(same)).collect()} == {(49, 0)}
    opposite = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1e30, 1e10], 1)], SCHEMA)
    assert {r.vec_id: (r.n_links, r.component_id) for r in H.hnsw_dedup(opposite).collect()} == {0: (2, 0), 1: (0, 1), 2: (2, 0), 3: (0, 3), 4: (2, 0)}
