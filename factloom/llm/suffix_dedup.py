"""Removal of repeated byte strings with levels of sampled suffixes of geometric sizes, exact.

A byte goes if a string of `length` bytes that covers it also starts at another place.

* Sampled suffixes. In every window of `length` bytes the `gram`-byte substrings with the smallest hash are
  anchors; equal windows have equal anchors at equal offsets, so suffixes that start at anchors suffice
  (about 2 in `length`). A combining aggregate counts the grams; anchors whose gram occurs once match nothing and end here.
* The others travel with their surroundings (up to `length` bytes on either side) to the part that owns their gram.
  There, each batch becomes a level, a suffix array of its anchors (entries in the order of all bytes from the anchor on), is merge-scanned
  with the existing levels gram by gram, and levels of equal size merge, so a part of n suffixes is sorted O(log n) times. A match is
  the common stretch to the left and right of two anchors; it counts from `length` bytes. Parts are as many as bound their entries.
* Large groups of one gram within a part compare hashes of whole windows instead of pairs. The places of grams with over `hot` of them
  never meet in one task: they are marked by a join with the few hot grams, and their windows are hashed where the text is, merged per
  slice and counted by hash.

Null and empty texts keep nothing and lose nothing. Repeated rows are copies of one another, so all their bytes (from
`length` on) go. Rows with equal ids and different texts are told apart. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import Scratch, buckets, text_batches, with_groups

U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)
SLICE = 1 << 20


@dataclass(frozen=True)
class Setting:
    """length of a repeated string, gram of an anchor, places from which a gram is hot, entries of a group compared by pairs.

    batch and part: entries of a new level and of a part, about. broadcast_bytes: the largest side that is broadcast.
    """

    length: int = 400
    gram: int = 32
    hot: int = 4096
    pairs: int = 24
    batch: int = 4096
    part: int = 40_000
    broadcast_bytes: int = 48 << 20

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over x[i : i + w] for every i, past the end filled."""
    n = len(x)
    size = -(-(n + w) // w) * w
    y = np.full(size, fill, dtype=x.dtype)
    y[:n] = x
    rows = y.reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(prefix: np.ndarray, offsets: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors of all texts of a slice."""
    n = len(prefix) - 1
    if n < s.length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    start = np.arange(n - s.gram + 1)
    g = X.span_hash(prefix, start, start + s.gram)
    # a window counts if it lies in one text: g is full of TOP where a gram crosses an end, windows are masked
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    whole = size >= s.length
    np.add.at(ok, offsets[:-1][whole], 1)
    np.add.at(ok, (offsets[1:] - s.length + 1)[whole], -1)
    ok = np.cumsum(ok)[: len(g)] > 0
    low = _sliding(g, s.window, np.minimum, TOP)
    low[~ok] = 0
    # j is an anchor if some valid window that holds it has it as its minimum
    behind = np.concatenate([np.zeros(s.window - 1, U64), low])
    best = _sliding(behind, s.window, np.maximum, U64(0))[: len(g)]
    at = np.flatnonzero((best == g) & (best > 0))
    return at, g[at]


def _rows(part: np.ndarray, parts: int, *columns: np.ndarray):
    """Rows (part, bytes of each column) of packed arrays."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cut)):
        yield (int(p), *(c[cut[p] : cut[p + 1]].tobytes() for c in columns))


def _find_anchors(s: Setting):
    """key, text -> g, key, pos of every anchor."""

    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            for at, to, data, offsets in X.slices(b, "text", SLICE):
                pos, g = anchors(X.prefix_hash(data), offsets, s)
                doc = np.searchsorted(offsets, pos, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(key[at:to][doc]), pa.array((pos - offsets[doc]).astype(np.int32))], ["g", "key", "pos"])

    return run


def _surroundings(s: Setting, parts: int):
    """key, text, places -> packed rows: kind 0 anchors with surroundings, 1 windows of hot grams, 2 certain spans."""
    half, reach = s.window - 1, s.length

    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            for at, to, data, offsets in X.slices(b, "text", SLICE):
                prefix = X.prefix_hash(data)
                places = b.column("places").slice(at, to - at)
                doc = np.repeat(np.arange(to - at), places.value_lengths().to_numpy(zero_copy_only=False))
                if not len(doc):
                    continue
                pos = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                hot = pos < 0
                pos = np.where(hot, -1 - pos, pos) + offsets[doc]
                own = key[at:to]
                lo, hi = offsets[doc], offsets[doc + 1]
                left, right = np.minimum(pos - lo, half), np.minimum(hi - pos, reach)
                # equal whole surroundings in this slice are certain: one of them travels on
                h = X.mix(X.span_hash(prefix, pos - left, pos + right) + left.astype(U64))
                order = np.argsort(h, kind="stable")
                first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
                count = np.diff(np.append(np.flatnonzero(first), len(order)))
                sure = np.zeros(len(h), bool)
                sure[order] = np.repeat(count > 1, count)
                sure &= left + right >= s.length
                lead = np.zeros(len(h), bool)
                lead[order[first]] = True
                yield from _spans(own[doc[sure]], (pos - left - lo)[sure], (pos + right - lo)[sure], parts)
                go = lead & ~hot
                if go.any():
                    p, le, ri = pos[go], left[go], right[go]
                    grid = p[:, None] + np.arange(-half, reach)
                    inside = (grid >= (p - le)[:, None]) & (grid < (p + ri)[:, None])
                    ctx = np.where(inside, data[np.clip(grid, 0, len(data) - 1)], 0).astype(np.uint8)
                    g = X.span_hash(prefix, p, p + s.gram)
                    head = np.stack([own[doc[go]], p - lo[go], le, ri, sure[go].astype(np.int64)], 1).astype(np.int64)
                    for row in _rows((g >> U64(20)) % U64(parts), parts, head, ctx):
                        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary())], ["kind", "part", "head", "ctx"])
                if hot.any():
                    step = np.zeros(len(data) + 2, np.int32)
                    np.add.at(step, np.maximum(pos - half, lo)[hot], 1)
                    np.add.at(step, np.maximum(np.minimum(pos, hi - s.length) + 1, np.maximum(pos - half, lo))[hot], -1)
                    w = np.flatnonzero(np.cumsum(step)[: len(data)] > 0)
                    d = np.searchsorted(offsets, w, "right") - 1
                    w, d = w[w + s.length <= offsets[d + 1]], d[w + s.length <= offsets[d + 1]]
                    h = X.span_hash(prefix, w, w + s.length)
                    order = np.argsort(h, kind="stable")
                    first = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
                    count = np.diff(np.append(np.flatnonzero(first), len(order)))
                    many = np.zeros(len(h), bool)
                    many[order] = np.repeat(count > 1, count)
                    yield from _spans(own[d[many]], (w - offsets[d])[many], (w - offsets[d])[many] + s.length, parts)
                    f = order[first]
                    head = np.stack([own[d[f]], (w - offsets[d])[f], many[f].astype(np.int64)], 1).astype(np.int64)
                    for row in _rows((h[f] >> U64(20)) % U64(parts), parts, h[f], head):
                        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([row[0]], pa.int32()), pa.array([row[2]], pa.binary()), pa.array([row[1]], pa.binary())], ["kind", "part", "head", "ctx"])

    return run


def _joined(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, a row for each maximal span of a document."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    if not len(key):
        return key, lo, hi
    new = np.concatenate([[True], key[1:] != key[:-1]])
    # running maximum of the ends within a document
    group = np.cumsum(new)
    shift = group.astype(np.int64) << 40
    top = np.maximum.accumulate(hi + shift)
    new[1:] |= lo[1:] + shift[1:] > top[:-1]
    start = np.flatnonzero(new)
    return key[start], lo[start], np.maximum.reduceat(hi, start)


def _spans(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int):
    key, lo, hi = _joined(key.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64))
    if len(key):
        for row in _rows(key.view(U64) % U64(parts), parts, np.stack([key, lo, hi], 1)):
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary()), pa.array([b""], pa.binary())], ["kind", "part", "head", "ctx"])


@lru_cache(maxsize=64)
def _triangle(g: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(g, 1)


def _neighbour(rows: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row with any other row: with a neighbour in sorted order."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    y = rows[order]
    differ = y[1:] != y[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    out = np.zeros(len(rows), np.int64)
    out[order[1:]] = lcp
    out[order[:-1]] = np.maximum(out[order[:-1]], lcp)
    return out


class Family:
    """Suffix arrays of geometric sizes over the anchors of one part.

    An entry is (key, place, left, right, sure) and its surroundings; found[:, 0] and found[:, 1] are how far the
    matches reach to the left and right of the anchor (-1: none).
    """

    def __init__(self, s: Setting):
        self.s, self.levels, self.waiting, self.held = s, [], [], 0
        self.half = s.window - 1

    def push(self, head: np.ndarray, ctx: np.ndarray) -> None:
        self.waiting.append((head, ctx))
        self.held += len(head)
        if self.held >= self.s.batch:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        head = np.concatenate([h for h, _ in self.waiting])
        ctx = np.concatenate([c for _, c in self.waiting])
        self.waiting, self.held = [], 0
        found = np.full((len(head), 2), -1, np.int32)
        sure = head[:, 4] > 0
        found[sure] = head[sure, 2:4]
        level = self.sort(head, ctx, found)
        self.scan(level, None)
        for old in self.levels:
            self.scan(level, old)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(self.sort(*(np.concatenate([a[c], b[c]]) for c in range(3))))

    def sort(self, head, ctx, found):
        """A level: entries in the order of their bytes from the anchor on, and the name of each one's gram."""
        ahead = np.ascontiguousarray(ctx[:, self.half :])
        order = np.argsort(ahead.view(f"S{ahead.shape[1]}").ravel(), kind="stable")
        k = np.ascontiguousarray(ahead[:, : self.s.gram]).view(">u8").astype(U64)
        name = np.zeros(len(k), U64)
        for c in range(k.shape[1]):
            name = X.mix(name + k[:, c])
        return head[order], ctx[order], found[order], name[order]

    @staticmethod
    def groups(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        return start, np.diff(np.append(start, len(name)))

    def scan(self, new, old) -> None:
        """Match a new level with itself, or with an existing one: pairs of small groups of equal grams, window hashes of larger ones."""
        start, count = self.groups(new[3])
        left, right = [], []
        if old is None:
            for a, g in zip(start[count > 1].tolist(), count[count > 1].tolist(), strict=True):
                if g > self.s.pairs:
                    self.crowd(new, np.arange(a, a + g), None, None)
                else:
                    i, j = _triangle(g)
                    left.append(a + i)
                    right.append(a + j)
        else:
            begin, size = self.groups(old[3])
            _, x, y = np.intersect1d(new[3][start], old[3][begin], return_indices=True)
            for a, g, b, h in zip(start[x].tolist(), count[x].tolist(), begin[y].tolist(), size[y].tolist(), strict=True):
                if g * h > self.s.pairs**2 // 2:
                    self.crowd(new, np.arange(a, a + g), old, np.arange(b, b + h))
                else:
                    left.append(np.repeat(np.arange(a, a + g), h))
                    right.append(np.tile(np.arange(b, b + h), g))
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            other = new if old is None else old
            for i in range(0, len(left), 8192):
                self.compare(new, left[i : i + 8192], other, right[i : i + 8192])

    def compare(self, a, i, b, j) -> None:
        """Common stretches around the anchors of pairs of entries; blocks of 8 bytes rule most out."""
        half, reach = self.half, self.s.length
        skip = half % 8
        blocks = half // 8
        x, y = a[1], b[1]
        wide = (x.shape[1] - skip) // 8 * 8
        same = np.ascontiguousarray(x[i, skip : skip + wide]).view(U64) == np.ascontiguousarray(y[j, skip : skip + wide]).view(U64)
        back, ahead = ~same[:, :blocks][:, ::-1], ~same[:, blocks:]
        le = np.where(back.any(1), back.argmax(1), blocks + 1)
        ri = np.where(ahead.any(1), ahead.argmax(1), ahead.shape[1] + 1)
        maybe = 8 * (le + ri) + 14 >= reach
        i, j = i[maybe], j[maybe]
        if not len(i):
            return
        same = x[i] == y[j]
        back, ahead = ~same[:, :half][:, ::-1], ~same[:, half:]
        le = np.where(back.any(1), back.argmax(1), half)
        ri = np.where(ahead.any(1), ahead.argmax(1), reach)
        le = np.minimum(le, np.minimum(a[0][i, 2], b[0][j, 2]))
        ri = np.minimum(ri, np.minimum(a[0][i, 3], b[0][j, 3]))
        long = le + ri >= reach
        for side, at in ((a, i[long]), (b, j[long])):
            np.maximum.at(side[2][:, 0], at, le[long])
            np.maximum.at(side[2][:, 1], at, ri[long])

    def crowd(self, a, i, b, j) -> None:
        """A large group: who can reach far enough, by neighbours in two suffix orders; then windows by hash.

        b is None: within a. Otherwise only matches between the two sides are new, but all are true.
        """
        s, half = self.s, self.half
        head = a[0][i] if b is None else np.concatenate([a[0][i], b[0][j]])
        ctx = a[1][i] if b is None else np.concatenate([a[1][i], b[1][j]])
        most_left = np.minimum(_neighbour(np.ascontiguousarray(ctx[:, :half][:, ::-1])), head[:, 2])
        most_right = np.minimum(_neighbour(np.ascontiguousarray(ctx[:, half:])), head[:, 3])
        live = np.flatnonzero(most_left + most_right >= s.length)
        if len(live) < 2:
            return
        most_left, most_right = most_left[live], most_right[live]
        got = np.full((len(live), 2), -1, np.int32)
        first, last = int((s.length - most_right).clip(0).min()), int(most_left.max())
        ctx = ctx[live]
        step = 64 if len(live) <= 4096 else 8
        for lo in range(first, last + 1, step):
            shifts = np.arange(lo, min(lo + step, last + 1))
            able = (most_left[:, None] >= shifts) & (most_right[:, None] >= s.length - shifts)
            rows = np.flatnonzero(able.any(1))
            if len(rows) < 2:
                continue
            able = able[rows]
            h = self.sums(ctx[rows], half - shifts)
            # who cannot have a window gets a number of its own
            h = np.where(able, h, np.arange(len(rows), dtype=U64)[:, None])
            order = np.argsort(h, axis=0)
            y = np.take_along_axis(h, order, 0)
            same = np.zeros(y.shape, bool)
            same[1:] = y[1:] == y[:-1]
            same[:-1] |= same[1:]
            twice = np.zeros(y.shape, bool)
            np.put_along_axis(twice, order, same, 0)
            twice &= able
            hit = np.flatnonzero(twice.any(1))
            at, twice = rows[hit], twice[hit]
            got[at, 0] = np.maximum(got[at, 0], shifts[len(shifts) - 1 - twice[:, ::-1].argmax(1)])
            got[at, 1] = np.maximum(got[at, 1], s.length - shifts[twice.argmax(1)])
        at = i if b is None else np.concatenate([i, j])
        at, n = at[live], len(i)
        mine = live < n
        for side, pick in ((a, mine), (b, ~mine)):
            if side is not None and pick.any():
                side[2][at[pick]] = np.maximum(side[2][at[pick]], got[pick])

    def sums(self, ctx: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hashes of the windows from each start; comparable down a column."""
        out = np.empty((len(ctx), len(start)), U64)
        for r in range(0, len(ctx), 512):
            p = X.row_sums(ctx[r : r + 512])
            out[r : r + 512] = X.mix(p[:, start + self.s.length] - p[:, start])
        return out

    def spans(self):
        self.flush()
        for head, _, found, _ in self.levels:
            hit = found[:, 0] >= 0
            yield head[hit, 0], head[hit, 1] - found[hit, 0], head[hit, 1] + found[hit, 1]


def _match(s: Setting):
    """Packed rows of one part -> spans (key, lo, hi)."""
    width = s.window - 1 + s.length

    def run(batches):
        family, hashes, heads = Family(s), [], []
        for b in batches:
            kinds = b.column("kind").to_pylist()
            for i, kind in enumerate(kinds):
                head = np.frombuffer(b.column("head")[i].as_buffer(), np.int64)
                if kind == 0:
                    family.push(head.reshape(-1, 5), np.frombuffer(b.column("ctx")[i].as_buffer(), np.uint8).reshape(-1, width))
                elif kind == 1:
                    heads.append(head.reshape(-1, 3))
                    hashes.append(np.frombuffer(b.column("ctx")[i].as_buffer(), U64))
                else:
                    k, lo, hi = head.reshape(-1, 3).T
                    yield from _span_rows(k, lo, hi)
        for k, lo, hi in family.spans():
            yield from _span_rows(k, lo, hi)
        if hashes:
            h, head = np.concatenate(hashes), np.concatenate(heads)
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            hit = (count[inverse] > 1) & (head[:, 2] == 0)
            yield from _span_rows(head[hit, 0], head[hit, 1], head[hit, 1] + s.length)

    return run


def _span_rows(key, lo, hi):
    key, lo, hi = _joined(key, lo, hi)
    for i in range(0, len(key), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (key, lo, hi)], ["key", "lo", "hi"])


def _cut(whole: bool):
    """doc_id, text, spans -> n_bytes, n_removed, n_spans, kept_sha256 and, if whole, kept."""

    def run(batches):
        for b in batches:
            for at, to, data, offsets in X.slices(b, "text"):
                out = []
                for i in range(at, to):
                    kept = raw = data[offsets[i - at] : offsets[i - at + 1]]
                    removed = spans = 0
                    spans_of = b.column("spans")[i]
                    if spans_of.is_valid:
                        packed = spans_of.values.to_numpy(zero_copy_only=False)
                        lo, hi = packed >> 32, packed & 0xFFFFFFFF
                        _, lo, hi = _joined(np.zeros(len(lo), np.int64), lo, hi)
                        keep = np.ones(len(raw), bool)
                        for x, y in zip(lo, hi, strict=True):
                            keep[x:y] = False
                        kept, removed, spans = raw[keep], int((~keep).sum()), len(lo)
                    kept = kept.tobytes()
                    out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if whole else None))
                n, r, k, h, kept = zip(*out, strict=True)
                cols = [b.column("doc_id").slice(at, to - at), *(pa.array(c, pa.int64()) for c in (n, r, k)), pa.array(h)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if whole:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def repeated_places(docs: DataFrame, s: Setting, scratch: Scratch) -> DataFrame:
    """key, places of the anchors of each document whose gram occurs more than once; of a hot one, -1 - place. docs: key, text."""
    found = scratch.store(docs.mapInArrow(_find_anchors(s), "g long, key long, pos int"))
    grams = scratch.store(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    places = with_groups(found, grams.withColumn("hot", F.col("n") > s.hot), "g", "hot", s.hot, s.broadcast_bytes)
    place = F.when(F.col("hot"), -F.col("pos") - 1).otherwise(F.col("pos"))
    out = scratch.store(places.groupBy("key").agg(F.collect_list(place).alias("places")))
    scratch.drop(found, grams)
    return out


def repeated_spans(docs: DataFrame, setting: Setting = Setting(), scratch: Scratch | None = None) -> DataFrame:
    """key, spans (lo * 2^32 + hi; they may overlap) of the documents that lose bytes. docs: key, text."""
    s, spark = setting, docs.sparkSession
    scratch = scratch or Scratch(spark)
    lists = repeated_places(docs, s, scratch)
    total = lists.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(buckets(spark) * 2, -(-total // s.part))
    rows = _with(docs, lists, "places", "inner", s).select("key", "text", "places")
    near = rows.mapInArrow(_surroundings(s, parts), "kind int, part int, head binary, ctx binary").repartition(parts, "part")
    spans = near.mapInArrow(_match(s), "key long, lo long, hi long")
    out = scratch.store(spans.groupBy("key").agg(F.collect_list(F.shiftleft("lo", 32).bitwiseOR(F.col("hi"))).alias("spans")))
    scratch.drop(lists)
    return out


def _with(docs: DataFrame, lists: DataFrame, column: str, how: str, s: Setting) -> DataFrame:
    """docs joined with stored lists: broadcast if their counted bytes are few, else by a shuffled hash join."""
    size = lists.agg(F.sum(F.size(column) * 8 + 48)).first()[0] or 0
    return docs.join(F.broadcast(lists) if size <= s.broadcast_bytes else lists.hint("shuffle_hash"), "key", how)


def remove_repeats(docs: DataFrame, setting: Setting = Setting(), whole: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if whole, kept (the remaining bytes) of every document."""
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.select("key", "text"), setting, scratch)
    rows = _with(rows, spans, "spans", "left", setting).select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * whole
    return rows.mapInArrow(_cut(whole), schema)
