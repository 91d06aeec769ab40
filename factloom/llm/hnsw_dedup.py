"""Near duplicates of embeddings by hierarchical navigable small-world graphs per shard.

Vectors are compared within a label. Equal vectors form one class, kept by its smallest id, so groups of copies of
any size cost one node. Classes of a label are dealt by hash to shards of about `shard_rows` nodes. Each shard gets a layered
graph (levels drawn by hash), built by insertion in small batches: new nodes search the graph of those before them, down the layers, link to
diverse ones among the nearest found, and those link back, giving up their least useful links where they have too many.
Every two shards of a label meet in one task: the nodes of each search the graph of the other, down the layers, then a beam over the lowest one.
A beam that is full of links is doubled until it reaches past the threshold. For each block of queries an audit compares some of them with
brute force, by their links and by their nearest nodes, and beams double until it passes; where even the whole graph does not, the block is
compared exactly. Cosines are verified in double precision. A link found from either side counts for both, and each task passes on
only counts and a spanning forest of its links.

Null vectors, null labels, zero vectors and vectors with null or non-finite components link with nothing and are kept; so are vectors of different
lengths with each other. Repeated rows (one vec_id, label and vector) count as one vector and get the same result. A vec_id with several labels or vectors
has a vector for each of them: each row tells the links of its own, and all of them are in one component, as they are one id. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import Scratch, batch_rows, buckets, components


@dataclass(frozen=True)
class Setting:
    """Least cosine; nodes of a shard, queries of a block, nodes inserted at once; links of a node; beams of the build and of the search.

    audits: queries of a block that are compared with brute force; recall: the least share of their links to be found, near: and of
    their three nearest nodes.
    """

    cosine: float = 0.93
    shard_rows: int = 4096
    block_rows: int = 1024
    batch: int = 256
    links: int = 12
    build_beam: int = 40
    beam: int = 32
    audits: int = 48
    recall: float = 0.995
    near: float = 0.9


def levels(ids: np.ndarray, links: int) -> np.ndarray:
    """The highest layer of each node, drawn by hash: each layer has 1 in `links` of the one below."""
    draw = (X.mix(ids.view(np.uint64) ^ np.uint64(0x5DEECE66D)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(12, np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(links))).astype(int)


def order_of_insertion(ids: np.ndarray, links: int) -> np.ndarray:
    """Nodes of high levels first, so that each layer holds a prefix of all nodes."""
    return np.lexsort((X.mix(ids.view(np.uint64)), -levels(ids, links)))


class Graph:
    """A layered graph over unit vectors in order of insertion: layer l has the links of its first nodes, padded with -1."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, layers: list[np.ndarray]):
        self.ids, self.unit, self.layers, self.size = ids, unit, layers, len(ids)
        self.short = unit.astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, unit: np.ndarray, s: Setting) -> "Graph":
        level = levels(ids, s.links)
        sizes = [int((level >= at).sum()) for at in range(int(level.max(initial=0)) + 1)]
        graph = cls(ids, unit, [np.full((n, s.links if at else 2 * s.links), -1, np.int32) for at, n in enumerate(sizes)])
        graph.size = min(1, len(ids))
        while graph.size < len(ids):
            graph.insert(min(len(ids), graph.size + max(1, min(s.batch, graph.size // 8))), s)
        return graph

    def nodes(self, layer: int) -> int:
        return min(len(self.layers[layer]), self.size)

    def insert(self, to: int, s: Setting) -> None:
        """Link the nodes from the present size up to `to` with nearest ones that a search finds."""
        new = np.arange(self.size, to)
        for layer, cand, sim in self.descend(self.short[new], s.build_beam, s.build_beam):
            here = new < len(self.layers[layer])
            if here.any():
                self.link(layer, new[here], cand[here], sim[here], s)
        self.size = to

    def descend(self, q: np.ndarray, upper: int, lowest: int, past: float | None = None):
        """(layer, places, similarities) of beams from the top layer down, each from what the one above found."""
        top = len(self.layers) - 1
        first = np.argmax(q @ self.short[: self.nodes(top)].T, axis=1)[:, None]
        for layer in range(top, -1, -1):
            cand, sim = self.beam(layer, q, first, lowest if layer == 0 else upper, past if layer == 0 else None)
            yield layer, cand, sim
            if layer:
                first = np.where(cand < self.nodes(layer), cand, self.nodes(layer - 1))

    def pick(self, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """m places a row, -1 beyond: one is passed over while a nearer chosen one is closer to it than the node is; then the nearest of those."""
        out = np.full((len(cand), m), -1, np.int32)
        for lo in range(0, len(cand), 512):
            turn = np.argsort(-sim[lo : lo + 512], axis=1, kind="stable")
            c, to = np.take_along_axis(cand[lo : lo + 512], turn, 1), np.take_along_axis(sim[lo : lo + 512], turn, 1)
            x = self.short[np.clip(c, 0, len(self.ids) - 1)]
            among = np.einsum("qad,qbd->qab", x, x)
            chosen = np.zeros(c.shape, bool)
            for i in range(c.shape[1]):
                hidden = (among[:, i, :i] > to[:, i, None]) & chosen[:, :i]
                chosen[:, i] = ~hidden.any(1) & (to[:, i] > -2)
            rank = np.argsort(np.where(to > -2, np.where(chosen, 0, 1), 2), axis=1, kind="stable")[:, :m]
            got = np.where(np.take_along_axis(to, rank, 1) > -2, np.take_along_axis(c, rank, 1), -1)
            out[lo : lo + 512, : got.shape[1]] = got
        return out

    def link(self, layer: int, new: np.ndarray, cand: np.ndarray, sim: np.ndarray, s: Setting) -> None:
        """Links of new nodes, and links back; a node with too many keeps those that pick prefers."""
        links = self.layers[layer]
        width = links.shape[1]
        forth = self.pick(cand, sim, s.links)
        links[new, : s.links] = forth
        b, a = forth.ravel(), np.repeat(new, s.links)
        a, b = a[b >= 0], b[b >= 0]
        like = np.einsum("kd,kd->k", self.short[a], self.short[b])
        order = np.lexsort((-like, b))
        a, b = a[order], b[order]
        old, start = np.unique(b, return_index=True)
        turn = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        back = np.full((len(old), width), -1, np.int64)
        fits = turn < width
        back[np.searchsorted(old, b[fits]), turn[fits]] = a[fits]
        every = np.concatenate([links[old], back], 1)
        to = np.einsum("qd,qkd->qk", self.short[old], self.short[np.maximum(every, 0)])
        links[old] = self.pick(every, np.where(every >= 0, to, -2), width)

    def beam(self, layer: int, q: np.ndarray, entry: np.ndarray, ef: int, past: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of the beams of all queries; with `past`, beams double while their last entry is that similar."""
        links, n, rows = self.layers[layer], self.nodes(layer), np.arange(len(q))
        x = self.short
        ef = min(ef, n)
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        cand = np.full((len(q), ef), n, np.int64)
        sim = np.full((len(q), ef), -2, np.float32)
        entry = entry[:, :ef]
        cand[:, : entry.shape[1]] = entry
        got = np.einsum("qd,qmd->qm", q, x[np.minimum(entry, n - 1)])
        sim[:, : entry.shape[1]] = np.where(entry < n, got, -2)
        np.put_along_axis(seen, entry, True, 1)
        done = cand == n
        live = rows
        step = 4
        while True:
            while len(live):
                s = np.where(done[live], -3, sim[live])
                take = np.argpartition(-s, min(step, ef) - 1, axis=1)[:, : min(step, ef)]
                open_ = np.take_along_axis(~done[live], take, 1)
                node = np.where(open_, np.take_along_axis(cand[live], take, 1), n)
                d = done[live]
                np.put_along_axis(d, take, True, 1)
                done[live] = d
                padded = np.where(node < n, node, 0)
                near = np.where((node < n)[:, :, None], links[padded], -1).reshape(len(live), -1).astype(np.int64)
                near[near < 0] = n
                near.sort(axis=1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = n
                fresh = ~seen[live[:, None], near]
                near[~fresh] = n
                seen[live[:, None], near] = True
                got = np.full(near.shape, -2, np.float32)
                r, c = np.nonzero(near < n)
                got[r, c] = np.einsum("kd,kd->k", q[live[r]], x[near[r, c]])
                all_c = np.concatenate([cand[live], near], 1)
                all_s = np.concatenate([sim[live], got], 1)
                all_d = np.concatenate([done[live], near == n], 1)
                best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
                cand[live], sim[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_c, all_s, all_d))
                live = live[~done[live].all(1)]
            if past is None or ef >= n:
                return cand, sim
            full = np.flatnonzero(sim.min(1) >= past)
            if not len(full):
                return cand, sim
            more = min(n, 2 * ef) - ef
            cand = np.concatenate([cand, np.full((len(q), more), n, np.int64)], 1)
            sim = np.concatenate([sim, np.full((len(q), more), -2, np.float32)], 1)
            done = np.concatenate([done, np.ones((len(q), more), bool)], 1)
            ef += more
            # what the narrow beam dropped may be reached again
            seen[full] = False
            seen[full, n] = True
            for i in full:
                seen[i, cand[i]] = True
            done[full] = cand[full] == n
            live = full

    def links_of(self, q_ids: np.ndarray, q: np.ndarray, s: Setting) -> np.ndarray:
        """A row for each query, true at the nodes it links with; beams widen until the audit passes."""
        audit = np.argsort(X.mix(q_ids.view(np.uint64)), kind="stable")[: s.audits]
        exact = q[audit] @ self.unit.T
        exact[q_ids[audit][:, None] == self.ids[None, :]] = -2
        truth, most = exact >= s.cosine, min(3, len(self.ids))
        nearest = np.argpartition(-exact, most - 1, axis=1)[:, :most]
        ef, short = s.beam, q.astype(np.float32)
        while ef < 2 * len(self.ids):
            *_, (_, cand, sim) = self.descend(short, 8, ef, s.cosine - 1e-3)
            r, c = np.nonzero((sim >= s.cosine - 1e-3) & (cand < len(self.ids)))
            node = cand[r, c]
            true = np.concatenate([np.einsum("kd,kd->k", q[r[i : i + 65536]], self.unit[node[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)]) >= s.cosine
            true &= q_ids[r] != self.ids[node]
            found = np.zeros((len(q), len(self.ids) + 1), bool)
            found[r[true], node[true]] = True
            reached = np.zeros((len(audit), len(self.ids) + 1), bool)
            np.put_along_axis(reached, cand[audit], True, 1)
            near = np.take_along_axis(reached, nearest, 1) | (np.take_along_axis(exact, nearest, 1) <= -2)
            if (found[audit, :-1] & truth).sum() >= s.recall * truth.sum() and near.mean() >= s.near:
                return found[:, :-1]
            ef *= 2
        # no beam over all of the graph passes: parts of it are out of reach
        return (q @ self.unit.T >= s.cosine) & (q_ids[:, None] != self.ids[None, :])


def unit_rows(lists: list[list[float]]) -> np.ndarray:
    x = np.array(lists, dtype=np.float64)
    # the largest component first, so that squares neither overflow nor vanish
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(s: Setting):
    """label, dim, g, rows (node, n, embedding) -> the shard: packed ids, counts, vectors and layers of its graph."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = b.column("rows")[i].as_py()
                ids = np.array([r["node"] for r in rows], np.int64)
                order = order_of_insertion(ids, s.links)
                ids, n = ids[order], np.array([r["n"] for r in rows], np.int64)[order]
                unit = unit_rows([rows[j]["embedding"] for j in order])
                layers = Graph.build(ids, unit, s).layers
                cols = [pa.array([x.tobytes()], pa.binary()) for x in (ids, n, unit)]
                cols += [pa.array([[x.tobytes() for x in layers]], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("label", "dim", "g")), *cols], ["label", "dim", "g", "ids", "n", "unit", "layers"])

    return run


def _shard(b: pa.RecordBatch, i: int, side: str, dim: int, s: Setting) -> tuple[Graph, np.ndarray]:
    get = lambda c, t: np.frombuffer(b.column(side + c)[i].as_buffer(), t)
    layers = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, s.links if at else 2 * s.links) for at, x in enumerate(b.column(side + "layers")[i].values)]
    return Graph(get("ids", np.int64), get("unit", np.float64).reshape(-1, dim), layers), get("n", np.int64)


def linked(queries: Graph, graph: Graph, s: Setting) -> np.ndarray:
    """Links of all nodes of one graph with those of another, by search."""
    return np.concatenate([graph.links_of(queries.ids[i : i + s.block_rows], queries.unit[i : i + s.block_rows], s) for i in range(0, len(queries.ids), s.block_rows)])


def _search(s: Setting):
    """Two shards, or one twice -> kind 0: (node, links), kind 1: (a, b) of a spanning forest."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column("dim")[i].as_py()
                (left, n), (right, m) = _shard(b, i, "l_", dim, s), _shard(b, i, "r_", dim, s)
                found = linked(left, right, s)
                same = b.column("g")[i].as_py() == b.column("h")[i].as_py()
                found |= found.T if same else linked(right, left, s).T
                ids, count, heads, tails = [left.ids], [], [], []
                for lo in range(0, len(found), 512):
                    part = found[lo : lo + 512]
                    count.append(part @ m.astype(np.float64))
                    r, c = np.nonzero(part)
                    x, y = forest(left.ids[lo + r], right.ids[c])
                    heads.append(x)
                    tails.append(y)
                if not same:
                    ids.append(right.ids)
                    count.append(sum(n[lo : lo + 512].astype(np.float64) @ found[lo : lo + 512] for lo in range(0, len(found), 512)))
                ids, count = np.concatenate(ids), np.concatenate(count).astype(np.int64)
                x, y = forest(np.concatenate(heads), np.concatenate(tails))
                ids, count = ids[count > 0], count[count > 0]
                kind = np.concatenate([np.zeros(len(ids), np.int32), np.ones(len(x), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([ids, x])), pa.array(np.concatenate([count, y]))], ["kind", "a", "b"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) with the components of the edges (a, b)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        np.minimum.at(new, low[x], m)
        np.minimum.at(new, low[y], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    keep = low != np.arange(len(names))
    return names[keep], names[low[keep]]


def hnsw_dedup(table: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable by links), kept (vec_id = component_id)."""
    s, spark = setting, table.sparkSession
    scratch = Scratch(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    fine &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # + 0.0 makes one zero of two
    rows = rows.withColumn("h", F.when(fine, F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0.0)))))
    own = scratch.store(rows.select("vec_id", "label", "h", F.size("embedding").alias("dim")))
    classes = own.where("h is not null").groupBy("label", "h", "dim").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n"))
    classes = scratch.store(classes.withColumn("node", F.xxhash64("label", "h", "dim")))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    first = classes.select(F.col("label").alias("_label"), F.col("h").alias("_h"), "dim", "rep", "n", "node")
    heads = rows.where("h is not null").join(first, (F.col("vec_id") == F.col("rep")) & (F.col("h") == F.col("_h")) & (F.col("label") == F.col("_label"))).dropDuplicates(["node"])
    heads = scratch.store(heads.select("label", "dim", "node", "n", "embedding").join(sizes, ["label", "dim"]))
    kind = table.schema["label"].dataType.simpleString()
    g = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("rows") / s.shard_rows)).cast("int")
    dealt = heads.groupBy("label", "dim", g.alias("g")).agg(F.collect_list(F.struct("node", "n", "embedding")).alias("rows"))
    packed = "ids binary, n binary, unit binary, layers array<binary>"
    with batch_rows(spark, 4):
        shards = scratch.store(dealt.mapInArrow(_pack(s), f"label {kind}, dim int, g int, {packed}"))
        # every two shards of a label, each pair once
        pairs = sizes.select("label", "dim", F.ceil(F.col("rows") / s.shard_rows).cast("int").alias("k"))
        pairs = pairs.select("label", "dim", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("g"))
        pairs = pairs.select("label", "dim", "g", F.explode(F.sequence("g", F.col("k") - 1)).alias("h"))
        names = ("ids", "n", "unit", "layers")
        left = shards.select("label", "dim", "g", *(F.col(c).alias(f"l_{c}") for c in names))
        right = shards.select("label", "dim", F.col("g").alias("h"), *(F.col(c).alias(f"r_{c}") for c in names))
        both = pairs.join(left, ["label", "dim", "g"]).join(right, ["label", "dim", "h"]).repartition(buckets(spark) * 2, "label", "dim", "g", "h")
        found = scratch.store(both.drop("label").mapInArrow(_search(s), "kind int, a long, b long"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    # an id in several classes unites them
    several = own.where("h is not null").join(classes.select("label", "h", "dim", "node"), ["label", "h", "dim"]).groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("all"))
    several = several.where("a <> z").select("a", F.explode("all").alias("b")).where("a <> b")
    comp = components(scratch, found.where("kind = 1").select("a", "b").union(several)).toDF("node", "group")
    grouped = scratch.store(comp.join(classes.select("node", "rep"), "node"))
    least = grouped.groupBy("group").agg(F.min("rep").alias("component"))
    named = classes.join(links, "node", "left").join(grouped.join(least, "group").select("node", "component"), "node", "left")
    named = named.select("label", "h", "dim", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = own.join(scratch.store(named), ["label", "h", "dim"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
