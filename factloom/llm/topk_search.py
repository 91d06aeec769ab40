"""Exact top-k inner-product search as a Voronoi kNN join.

Components become floor(256 x). With M the largest norm, the vectors (c, sqrt(M^2 - |c|^2)) and (q, 0) have
distances that fall as the inner product rises, so a metric join finds the largest products. Queries and rows
are grouped by the nearest of a bounded set of pivots. Summaries (largest radius of each group of queries, nearest distances of
each group of rows) bound the distance of the k-th neighbour for each group of queries; a row travels
only to the groups for which its distance to the pivot cannot exceed that bound. Groups are solved in blocks of
queries against blocks of rows with one matrix product each; tasks keep running results, so what a task returns is bounded
by its queries, and no group of rows must fit into one task.

Where products may pass 2^52 (or components the doubles), distances are taken of vectors scaled by a power of two, rows are narrowed by products
in double precision with their error bound, and what is left is multiplied in integers of any size: ranks follow these, and a score
beyond the range of a long is given as the nearest long.

Rows with equal vec_id count as one where their vectors agree, and never as one another's neighbours. Vectors that are null, empty,
hold null or non-finite components, or do not have the most common length take no part. Equal scores rank by
smaller vec_id. Fewer candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._spark import Scratch, buckets

SCALE = 256.0
#: Pivots at most, and queries of one block. Both bound what a task or the driver holds.
MOST_PIVOTS = 512
BLOCK = 512
EPS = 1e-6


def vectors(batch: pa.RecordBatch, column: str = "embedding", dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix in double precision) of a batch's whole, finite vectors of one length."""
    col = batch.column(column)
    n = len(col)
    offsets = np.asarray(col.offsets.to_numpy(), dtype=np.int64)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    size = np.diff(offsets)
    ok = np.asarray(col.is_valid()) & (size > 0)
    if dim is not None:
        ok &= size == dim
    rows = np.flatnonzero(ok)
    if dim is None:
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        rows = rows[bad[offsets[1:][rows]] == bad[offsets[:-1][rows]]] if n else rows
        return rows, size[rows]
    grid = flat[offsets[:-1][rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    fine = np.isfinite(grid).all(1)
    return rows[fine], grid[fine]


def _survey(batches):
    """Whole vectors, queries among them and the largest squared norm, by length."""
    for b in batches:
        rows, size = vectors(b)
        q = np.asarray(b.column("is_query").fill_null(False))[rows]
        for d in np.unique(size):
            _, x = vectors(b.take(pa.array(rows[size == d])), dim=int(d))
            with np.errstate(over="ignore"):
                y = np.floor(SCALE * x)
                y = np.where(np.abs(y) < 2.0**500, y, np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(d)], pa.int64()), pa.array([len(y)], pa.int64()), pa.array([int(q[size == d].sum())], pa.int64()), pa.array([float((y * y).sum(1).max(initial=0))]), pa.array([float(np.abs(x).max(initial=0))])],
                ["dim", "n", "n_q", "m2", "top"],
            )


def whole(x: np.ndarray) -> list[int]:
    """floor(256 x) of each component, as integers of any size."""
    return [int(v) * 256 if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.tolist()]


class Space:
    """The lifted space and its pivots. Narrow: all products fit a double exactly; else vectors are scaled by 2^-shift for distances."""

    def __init__(self, dim: int, m2: float, top: float, pivots: np.ndarray):
        self.dim, self.narrow, self.shift = dim, m2 < 2**52, 0
        if not self.narrow:
            self.shift = max(0, math.frexp(top)[1] + 8 - 400)
            m2 = dim * (math.ldexp(top, 8 - self.shift) + 1) ** 2
        self.m2, self.slack = m2, EPS * math.sqrt(m2)
        self.pivots = self.lift(np.unique(self.metric(pivots), axis=0))

    def metric(self, x: np.ndarray) -> np.ndarray:
        """floor(256 x), scaled."""
        if self.narrow:
            return np.floor(SCALE * x)
        large = np.abs(x) >= 2.0**53
        return np.where(large, np.ldexp(x, 8 - self.shift), np.ldexp(np.floor(SCALE * np.where(large, 0, x)), -self.shift))

    def sent(self, x: np.ndarray) -> np.ndarray:
        """What travels: integers as doubles, or else the vectors as they are."""
        return np.floor(SCALE * x) if self.narrow else x

    def lift(self, y: np.ndarray) -> np.ndarray:
        return np.concatenate([y, np.sqrt(np.maximum(0, self.m2 - (y * y).sum(1)))[:, None]], 1)

    def far(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances of rows, or of queries, to the pivots."""
        y = self.metric(x)
        y = np.concatenate([y, np.zeros((len(y), 1))], 1) if query else self.lift(y)
        d2 = (y * y).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * y @ self.pivots.T
        return np.sqrt(np.maximum(0, d2))


def _summaries(space: Space, k: int):
    """kind 0: near distance of a group of rows and the vec_id at it, each vec_id once; 1: radius of a group of queries."""

    def run(batches):
        for b in batches:
            rows, x = vectors(b, dim=space.dim)
            if not len(rows):
                continue
            out = []
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            d = space.far(x, False)
            own = d.argmin(1)
            best = d[np.arange(len(d)), own]
            for j in np.unique(own):
                at = np.flatnonzero(own == j)
                at = at[np.argsort(best[at], kind="stable")]
                at = at[np.sort(np.unique(ids[at], return_index=True)[1])[: k + 1]]
                out += [(0, int(j), int(c), float(v)) for c, v in zip(ids[at], best[at], strict=True)]
            q = np.asarray(b.column("is_query").fill_null(False))[rows]
            if q.any():
                d = space.far(x[q], True)
                own = d.argmin(1)
                best = d[np.arange(len(d)), own]
                out += [(1, int(j), None, float(best[own == j].max())) for j in np.unique(own)]
            a, c, i, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(i, pa.int64()), pa.array(v, pa.float64())], ["kind", "pivot", "vec_id", "value"])

    return run


def bounds(space: Space, near: dict[int, list[tuple[int, float]]], radius: dict[int, float], k: int) -> dict[int, float]:
    """For each group of queries, a distance that no query's k-th neighbour exceeds (the query itself may be one row).

    near: (vec_id, distance) by group of rows. Only distinct vec_ids are neighbours: k + 1 of them must lie within the bound.
    """
    gap = np.sqrt(np.maximum(0, ((space.pivots[:, None, :] - space.pivots[None, :, :]) ** 2).sum(2)))
    group, ids, value = (np.array(x, t) for x, t in zip(zip(*((j, c, v) for j, rows in near.items() for c, v in rows), strict=True), (np.int64, np.int64, np.float64), strict=True))
    out = {}
    for i, r in radius.items():
        ub = r + gap[i, group] + value
        order = np.argsort(ub, kind="stable")
        ub = ub[order][np.sort(np.unique(ids[order], return_index=True)[1])]
        out[i] = float(ub[k]) if len(ub) > k else float("inf")
    return out


def _queries(space: Space, salts: int):
    """Packed blocks of queries by group, one copy for each salt."""

    def run(batches):
        for b in batches:
            rows, x = vectors(b, dim=space.dim)
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            own = space.far(x, True).argmin(1) if len(rows) else np.zeros(0, int)
            for i in np.unique(own):
                at = np.flatnonzero(own == i)
                for lo in range(0, len(at), BLOCK):
                    part = at[lo : lo + BLOCK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(salts, i, np.int32)), pa.array(np.arange(salts, dtype=np.int32)), pa.array([ids[rows[part]].astype(np.int64).tobytes()] * salts, pa.binary()), pa.array([space.sent(x[part]).tobytes()] * salts, pa.binary())],
                        ["pivot", "salt", "q_ids", "q_vecs"],
                    )

    return run


def _replicas(space: Space, theta: dict[int, float], radius: dict[int, float], salts: int):
    """Packed rows for each group of queries that may need them."""

    def run(batches):
        turn = 0
        for b in batches:
            rows, x = vectors(b, dim=space.dim)
            if not len(rows):
                continue
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            d = space.far(x, False)
            turn += int(ids[0])
            for i, t in theta.items():
                # |q - s| >= |s - p| - |q - p| for every query of the group
                need = np.flatnonzero(d[:, i] - radius[i] <= t * (1 + EPS) + space.slack)
                for lo in range(0, len(need), 8192):
                    part = need[lo : lo + 8192]
                    turn += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([turn % salts], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([space.sent(x[part]).tobytes()], pa.binary())], ["pivot", "salt", "ids", "vecs"]
                    )

    return run


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids, equal (score, id) once."""
    if len(score) > 4 * k:
        # repeated rows may fill the first k places: the threshold counts distinct ids only if enough remain
        t = np.partition(score, len(score) - 4 * k)[len(score) - 4 * k]
        keep = score >= t
        if len(np.unique(ids[keep])) >= k:
            score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))
    score, ids = score[order], ids[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])]) if len(ids) else np.zeros(0, bool)
    return score[new][:k], ids[new][:k]


def _exact_scores(space: Space, q: np.ndarray, v: np.ndarray, name: int, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(-score, vec_id) of one wide query's best rows: those that the error of a product in doubles leaves possible, multiplied exactly."""
    at = np.flatnonzero(ids != name)
    a, b = space.metric(q[None, :])[0], space.metric(v[at])
    score, error = b @ a, 4e-16 * (space.dim + 4) * np.sqrt((a * a).sum() * (b * b).sum(1)) + 1e-300
    sure = np.sort(np.unique(ids[at], return_index=True)[1])
    low = (score - error)[sure]
    least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    mine = whole(q)
    return sorted({(-sum(x * y for x, y in zip(mine, whole(v[i]), strict=True)), int(ids[i])) for i in at[score + error >= least]})[:k]


def _digits(score: int) -> str:
    """Text that sorts as the numbers do, whatever their size: sign, number of digits, digits (turned for negative ones)."""
    if score >= 0:
        return f"1{len(str(score)):05d}{score}"
    text = str(-score)
    return f"0{99999 - len(text):05d}" + "".join("9876543210"[int(c)] for c in text)


def _solve_wide(space: Space, k: int):
    """As _solve, in integers of any size; turn is the score as text that sorts."""

    def run(batches):
        held: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for r in range(b.num_rows):
                q_ids, ids = (np.frombuffer(b.column(c)[r].as_buffer(), np.int64) for c in ("q_ids", "ids"))
                q, v = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(-1, space.dim) for c in ("q_vecs", "vecs"))
                for i, name in enumerate(q_ids.tolist()):
                    held[name] = sorted(set(held.get(name, [])) | set(_exact_scores(space, q[i], v, name, ids, k)))[:k]
        for name, got in held.items():
            near = [min(max(-s, -(2**63)), 2**63 - 1) for s, _ in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(got), pa.int64()), pa.array([c for _, c in got], pa.int64()), pa.array(near, pa.int64()), pa.array([_digits(-s) for s, _ in got], pa.string())], ["query_id", "vec_id", "score", "turn"]
            )

    return run


def _solve(dim: int, k: int):
    """Blocks of queries against blocks of rows; a running result for each query. Every partial sum is an integer that a double holds."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in range(b.num_rows):
                q_ids, ids = (np.frombuffer(b.column(c)[r].as_buffer(), np.int64) for c in ("q_ids", "ids"))
                q, v = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(-1, dim) for c in ("q_vecs", "vecs"))
                score = (q @ v.T).astype(np.int64)
                for i, name in enumerate(q_ids.tolist()):
                    s, c = best(score[i][ids != name], ids[ids != name], k)
                    if name in held:
                        s, c = best(np.concatenate([held[name][0], s]), np.concatenate([held[name][1], c]), k)
                    held[name] = (s, c)
        names = list(held)
        for lo in range(0, len(names), 10_000):
            part = names[lo : lo + 10_000]
            n = [len(held[x][0]) for x in part]
            ids, scores = (np.concatenate([held[x][c] for x in part]) for c in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, n), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array([""] * len(ids))], ["query_id", "vec_id", "score", "turn"])

    return run


def topk_search(table: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows."""
    spark = table.sparkSession
    scratch = Scratch(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query")).where("vec_id is not null and embedding is not null")
    result = "query_id long, vec_id long, score long, turn string"
    seen = rows.mapInArrow(_survey, "dim long, n long, n_q long, m2 double, top double").groupBy("dim")
    seen = seen.agg(F.sum("n").alias("n"), F.sum("n_q").alias("n_q"), F.max("m2").alias("m2"), F.max("top").alias("top"))
    top = seen.orderBy(F.desc("n"), "dim").first()
    if top is None or not top.n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = top.dim
    n_pivots = int(min(MOST_PIVOTS, max(4, -(-top.n_q // 256))))
    sample = rows.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sample = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("embedding").collect()
    space = Space(dim, top.m2, top.top, np.array([r.embedding for r in sample], dtype=np.float64))
    parts = rows.mapInArrow(_summaries(space, k), "kind int, pivot int, vec_id long, value double")
    near, radius = {}, {}
    turn = Window.partitionBy("pivot").orderBy("value", "vec_id")
    for r in parts.where("kind = 0").groupBy("pivot", "vec_id").agg(F.min("value").alias("value")).withColumn("i", F.row_number().over(turn)).where(F.col("i") <= k + 1).collect():
        near.setdefault(r.pivot, []).append((r.vec_id, r.value))
    for r in parts.where("kind = 1").groupBy("pivot").agg(F.max("value").alias("value")).collect():
        radius[r.pivot] = r.value
    theta = bounds(space, near, radius, k)
    n = buckets(spark)
    salts = max(1, -(-n // len(radius)))
    asked = rows.where("is_query").mapInArrow(_queries(space, salts), "pivot int, salt int, q_ids binary, q_vecs binary")
    sent = rows.mapInArrow(_replicas(space, theta, radius, salts), "pivot int, salt int, ids binary, vecs binary")
    pairs = sent.join(asked.hint("shuffle_hash"), ["pivot", "salt"]).select("q_ids", "q_vecs", "ids", "vecs")
    found = scratch.store(pairs.mapInArrow(_solve(dim, k) if space.narrow else _solve_wide(space, k), result)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
