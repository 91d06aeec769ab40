"""N-gram Jaccard join: universe-partition pigeonhole, exact.

A document is the set of hashes of its word shingles. The hash universe is cut
into m ranges (segments); m follows the size band so that two sets of Jaccard
similarity t or more differ in fewer elements than there are segments, hence agree on
at least one whole segment. Equal segments meet in the index (a bucket per
segment value), candidates are verified exactly on the whole sets, and linked
documents form components.

* Documents with equal sets are one class; classes, not documents, are indexed.
* Bands grow by `BAND`; a set is indexed in its own band, and in the bands below
  whose sets can be similar to it.
* Allocation by cost: every segment first pays for an exact match. Empty segments
  cost too much and are skipped; `slack` extra segments stand in for them. Buckets
  with more than `small` classes are resolved by stars around changing centres; those
  that still hold several components are skipped too. A set that is left with too few paid segments
  takes the one-deletion neighbourhoods of its segments, which count twice. Sets that even
  those do not cover are compared in blocks, so no link is lost.

Null or empty texts are in the result with an empty set and no link. Repeated rows, ties and
extra columns are harmless; rows without an id are ignored; an empty table gives an empty result. Rows of one id with different texts
get a result each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import Scratch, buckets, components, text_batches

BAND = 1.5
#: Index entries that are sorted at a time, about.
PART_ENTRIES = 500_000
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Pairs that a task remembers, to give a pair that meets in many buckets once.
RECENT = 1 << 18
#: Stands for no segment: its bucket lists the sets with too few filled segments.
THIN = np.uint64(0)


@dataclass(frozen=True)
class Setting:
    """k words a shingle; similarity >= num/den; buckets of up to `small` classes give all pairs.

    Pairs whose sets have over round_bytes (None: what all sets have) are verified in up to so many rounds, by groups of about `group` pairs.
    """

    k: int = 5
    num: int = 80
    den: int = 100
    small: int = 8
    star_rounds: int = 2
    star_keys: int = 4
    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 48 << 20
    round_bytes: int | None = None
    rounds: int = 8
    group: int = 256


@lru_cache(maxsize=None)
def bands(num: int, den: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(lowest size of each band, segments of each band). Sets smaller than the first have only equal partners."""
    low = [max(1, -(-num // (den - num)))]
    while low[-1] < 1 << 31:
        low.append(max(low[-1] + 1, int(low[-1] * BAND)))
    counts = []
    for k in range(len(low) - 1):
        most = low[k + 1] - 1
        h = apart(most, num, den)
        m = h + 1
        for _ in range(3):
            empty = m * float(np.exp(-most / m))
            m = h + 1 + int(np.ceil(empty + 3 * np.sqrt(empty)))
        counts.append(m)
    return tuple(low), tuple(counts)


def apart(size: int, num: int, den: int) -> int:
    """Most elements in which a set of this size and a similar, not smaller set can differ.

    |Y| <= |X| den/num and |X & Y| >= (|X| + |Y|) num / (num + den).
    """
    other = size * den // num
    return (size + other) * (den - num) // (den + num)


def needed(size: int, own: bool, num: int, den: int) -> int:
    """Paid segments that suffice for a set in its own band, or as the larger side in the band below."""
    if own:
        return apart(size, num, den) + 1
    return 2 * size * (den - num) // (den + num) + 1


@lru_cache(maxsize=64)
def _edges(m: int) -> np.ndarray:
    return np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64)


def segments(hs: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(value of each segment, bounds): values are sums of mixed members, 0 only if empty."""
    cut = np.zeros(m + 1, np.int64)
    cut[1:m] = np.searchsorted(hs, _edges(m))
    cut[m] = len(hs)
    total = np.zeros(len(hs) + 1, np.uint64)
    np.cumsum(X.mix(hs + np.uint64(0x51ED270B)), out=total[1:])
    return total[cut[1:]] - total[cut[:-1]], cut


def schemes(n: int, s: Setting) -> list[tuple[int, bool]]:
    """(band, whether it is the set's own) in which a set of this size is indexed."""
    low, _ = bands(s.num, s.den)
    if n < low[0]:
        return []
    own = int(np.searchsorted(low, n, "right")) - 1
    out = [(own, True)]
    for band in range(own - 1, -1, -1):
        if (low[band + 1] - 1) * s.den < n * s.num:
            break
        out.append((band, False))
    return out


def _keys(values: np.ndarray, band: int) -> np.ndarray:
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
    return X.mix(values + X.mix(at))


def set_key(hs: np.ndarray) -> int:
    """A class's number: even, so that the lowest bit is free for the role."""
    with np.errstate(over="ignore"):
        x = X.mix(hs ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(hs)) * np.uint64(0x9FB21C651E98DF25)
        return int(X.mix(np.array([x], np.uint64))[0]) & 0x1FFFFFFFFFFFFFFE


def _sets_of(batch: pa.RecordBatch, s: Setting):
    """(row, sorted shingle hashes) of a batch's texts."""
    for at, to, data, offsets in X.slices(batch, "text"):
        hashes, first = X.word_hashes(data, offsets, X.BLANK_WORD)
        for i in range(to - at):
            yield at + i, X.shingle_set(hashes[first[i] : first[i + 1]], s.k)


def _pack(keys: np.ndarray, values: np.ndarray, parts: int):
    """Rows (part, keys, values) of one slice's index entries, each pair once."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    keys, values = keys[fresh], values[fresh]
    part = (keys >> np.uint64(40)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            take = order[cut[p] : cut[p + 1]]
            yield p, keys[take].tobytes(), values[take].tobytes()


_PACKED = "part int, keys binary, vals binary"


def _packed_batch(rows) -> pa.RecordBatch:
    p, k, v = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["part", "keys", "vals"])


def sketch(hs: np.ndarray) -> bytes:
    """How many members fall in each bin (at most 255); about 4 to 8 a bin, bins a power of two."""
    bins = 1 << int(np.clip(len(hs).bit_length() - 3, 4, 12))
    return np.minimum(np.bincount((hs & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def sketch_gap(a: bytes, b: bytes) -> int:
    """A lower bound on the number of elements in which two sets differ: the finer sketch is folded first."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    bins = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, bins).sum(0) - y.reshape(-1, bins).sum(0)).sum())


def digest(s: Setting):
    """doc_id, row, text -> doc_id, row, n_shingles, cls, sketch."""

    def run(batches):
        for b in batches:
            n, cls, bins = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            for i, hs in _sets_of(b, s):
                if len(hs):
                    n[i], cls[i], bins[i] = len(hs), set_key(hs), sketch(hs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n), pa.array(cls), pa.array(bins, pa.binary())], ["doc_id", "row", "n_shingles", "cls", "sketch"])

    return run


def _possible(s: Setting):
    """Pairs whose sketches don't rule the similarity out."""

    def run(batches):
        for b in batches:
            size = np.asarray(b.column("n_a")) + np.asarray(b.column("n_b"))
            most = size * (s.den - s.num) // (s.den + s.num)
            left, right = b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist()
            keep = [sketch_gap(x, y) <= m for x, y, m in zip(left, right, most.tolist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def index_entries(s: Setting, parts: int):
    """doc_id, text -> packed (segment key, class with role) entries; copies met again in a task add nothing."""

    def run(batches):
        seen: set[int] = set()
        keys, values, held = [], [], 0
        for b in batches:
            for _, hs in _sets_of(b, s):
                plans = schemes(len(hs), s)
                if not plans:
                    continue
                c = set_key(hs)
                if c in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                for band, own in plans:
                    v, _ = segments(hs, bands(s.num, s.den)[1][band])
                    k = _keys(v, band)[v != 0]
                    if len(k) < needed(len(hs), own, s.num, s.den):
                        k = np.append(k, THIN)
                    keys.append(k)
                    values.append(np.full(len(k), c | own, np.int64))
                    held += len(k)
                if held > 500_000:
                    yield _packed_batch(_pack(np.concatenate(keys), np.concatenate(values), parts))
                    keys, values, held = [], [], 0
        if held:
            yield _packed_batch(_pack(np.concatenate(keys), np.concatenate(values), parts))

    return run


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.append(start, len(keys)))


def _by_part(batches):
    """(keys, values) of each part of packed rows, which come in order of part: one part is held at a time."""
    at, ks, vs = None, [], []
    for b in batches:
        part = b.column("part").to_numpy()
        for lo, n in zip(*_runs(part), strict=True) if len(part) else ():
            if at != part[lo] and ks:
                yield np.concatenate(ks), np.concatenate(vs)
                ks, vs = [], []
            at = part[lo]
            # copies, as views would hold their whole batches
            ks.append(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("keys").slice(lo, n)]))
            vs.append(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in b.column("vals").slice(lo, n)]))
    if ks:
        yield np.concatenate(ks), np.concatenate(vs)


def _unseen(p: np.ndarray, recent: np.ndarray) -> np.ndarray:
    """The pairs that recent (a slot for each hash of a pair) doesn't hold; it then holds them, one a slot."""
    slot = (X.mix(p[:, 0].view(np.uint64) + X.mix(p[:, 1])) % np.uint64(len(recent))).astype(np.int64)
    new = (recent[slot] != p).any(1)
    p, slot = p[new], slot[new]
    slot, first = np.unique(slot, return_index=True)
    recent[slot] = p[first]
    return p


def bucket_pairs(small: int):
    """Packed entries, in order of part -> (kind 0: pair a, b | 1: class b of the large bucket a | 2: thin class b); b with role."""

    def run(batches):
        recent = np.zeros((RECENT, 2), np.int64)
        for keys, values in _by_part(batches):
            yield from of_part(keys, values, recent)

    def of_part(keys, values, recent):
        # values in order, so a run starts with its smallest
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (values[1:] >> 1 == values[:-1] >> 1) & (keys[1:] != THIN)
        if same.any():
            # one entry per class and key; own roles win (but a thin class keeps both, as its key names no band)
            owns = values & 1
            last = np.flatnonzero(~np.append(same[1:], False))
            first = np.flatnonzero(~same)
            role = np.maximum.reduceat(owns, first)
            keys, values = keys[first], (values[last] & ~1) | role
        start, count = _runs(keys)
        if keys[0] == THIN:
            for i in range(0, int(count[0]), 100_000):
                v = values[i : min(i + 100_000, int(count[0]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), 2, np.int32)), pa.array(np.zeros(len(v), np.int64)), pa.array(v)], ["kind", "a", "b"])
        keep = (count > 1) & (keys[start] != THIN)
        start, count = start[keep], count[keep]
        if not len(start):
            return
        pairs = []
        for g in range(2, small + 1):
            at = start[count == g]
            if not len(at):
                continue
            grid = values[at[:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            x, y = grid[:, i].ravel(), grid[:, j].ravel()
            live = ((x | y) & 1) == 1
            pairs.append(np.stack([x[live] & ~1, y[live] & ~1], 1))
        big = count > small
        for a, g in zip(start[big], count[big], strict=True):
            v = values[a : a + g] & ~1
            pairs.append(np.stack([np.full(g - 1, v[0]), v[1:]], 1))
        if pairs:
            p = np.concatenate(pairs)
            p = p[p[:, 0] != p[:, 1]]
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            if len(p):
                p = _unseen(p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])], recent)
            for i in range(0, len(p), 100_000):
                q = p[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(q), np.int32)), pa.array(q[:, 0]), pa.array(q[:, 1])], ["kind", "a", "b"])
        if big.any():
            take = np.concatenate([np.arange(a, a + g) for a, g in zip(start[big], count[big], strict=True)])
            k, v = keys[take].view(np.int64), values[take]
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k[i : i + 100_000]), np.int32)), pa.array(k[i : i + 100_000]), pa.array(v[i : i + 100_000])], ["kind", "a", "b"])

    return run


def _shipped(s: Setting):
    """cls, at, text -> owner, chunk, role, cls, hs: the whole set of a class, once for each group that asks for it."""
    names, kinds = ("owner", "chunk", "role", "cls", "hs"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        rows, held = [], 0
        for b in batches:
            cls, at = b.column("cls").to_pylist(), b.column("at").to_pylist()
            for i, hs in _sets_of(b, s):
                raw = hs.tobytes()
                for x in at[i]:
                    rows.append((x["owner"], x["chunk"], x["role"], cls[i], raw))
                    held += len(raw)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _verified(s: Setting):
    """owner, chunk, role, cls, hs, each group's owner first -> the pairs of similar ones; one owner's set is held at a time."""

    def run(batches):
        at, last, name = None, None, None
        for b in batches:
            low, high = [], []
            owner, chunk, role, cls = (b.column(c).to_pylist() for c in ("owner", "chunk", "role", "cls"))
            for i, raw in enumerate(b.column("hs")):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if role[i] == 0:
                    at, last, name = (owner[i], chunk[i]), other.copy(), cls[i]
                    continue
                if at != (owner[i], chunk[i]):
                    raise RuntimeError(f"no set of class {owner[i]}")
                short, long = (last, other) if len(last) < len(other) else (other, last)
                place = np.searchsorted(long, short)
                place[place == len(long)] = 0
                common = int((long[place] == short).sum())
                if s.den * common >= s.num * (len(last) + len(other) - common):
                    low.append(min(name, cls[i]))
                    high.append(max(name, cls[i]))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, s: Setting):
        self.s, self.spark, self.scratch = s, docs.sparkSession, Scratch(docs.sparkSession)
        text_batches(self.spark, BATCH_BYTES)
        text = F.col("text").cast("string")
        # row stands for an id and a text
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("row")).where("doc_id is not null")

    def dealt(self, packed: DataFrame) -> DataFrame:
        """Packed rows dealt by part; a task gets several parts, one after the other. Few tasks give a pair few times."""
        return packed.repartition(buckets(self.spark), "part").sortWithinPartitions("part")

    def met(self, asked: DataFrame) -> DataFrame:
        """owner, chunk, role, cls, hs of the pairs (owner, chunk, member), dealt by group and each group's owner first.

        A set is sent once for each group that asks for it, straight from its text.
        """
        asks = asked.select(F.col("member").alias("cls"), "owner", "chunk", F.lit(1).alias("role")).union(asked.select(F.col("owner").alias("cls"), "owner", "chunk", F.lit(0).alias("role")).distinct())
        lists = asks.groupBy("cls").agg(F.collect_list(F.struct("owner", "chunk", "role")).alias("at"))
        reps = self.scratch.store(self.classes.select("row", "cls").join(lists, "cls"))
        n, size = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("at") * 24 + 64), F.lit(0))).first()
        rows = self.docs.join(F.broadcast(reps) if n <= self.s.broadcast_rows and size <= self.s.broadcast_bytes else reps, "row").select("cls", "at", "text")
        sent = rows.mapInArrow(X.tidy(_shipped(self.s)), "owner long, chunk int, role int, cls long, hs binary")
        return sent.repartition(buckets(self.spark), "owner", "chunk").sortWithinPartitions("owner", "chunk", "role")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar; sizes and sketches first, then whole sets."""
        s = self.s
        size = self.classes.select("cls", "n_shingles", "sketch")
        pairs = pairs.join(size.toDF("a", "n_a", "sketch_a"), "a").join(size.toDF("b", "n_b", "sketch_b"), "b")
        pairs = pairs.where(F.least("n_a", "n_b") * s.den >= F.greatest("n_a", "n_b") * s.num)
        pairs = self.scratch.store(pairs.mapInArrow(X.tidy(_possible(s)), "a long, b long"))
        busy = self.scratch.store(pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n")))
        held = 8 * (busy.join(self.classes.select("cls", "n_shingles"), "cls").agg(F.sum(F.col("n") * F.col("n_shingles"))).first()[0] or 0)
        rounds = min(s.rounds, 1 + held // (s.round_bytes or max(self.size, 1)))
        # the sets of a pair meet at its busier end, in groups of some pairs
        count = pairs.join(busy.toDF("a", "n_a"), "a").join(busy.toDF("b", "n_b"), "b")
        asked = count.select(F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(F.col("n_a") >= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest("n_a", "n_b").alias("n"))
        asked = self.scratch.store(asked.select("owner", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / s.group)).cast("int").alias("chunk"), "member"))
        out = None
        for r in range(rounds):
            # large numbers of sets go in turn, so the disk holds one turn's
            part = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("owner"), F.lit(rounds)) == r)
            both = self.scratch.store(self.met(part).mapInArrow(X.tidy(_verified(s)), "a long, b long").dropDuplicates())
            self.scratch.release(held)
            out = both if out is None else out.union(both)
        self.scratch.drop(pairs, busy, asked)
        return out

    def run(self) -> DataFrame:
        s, scratch = self.s, self.scratch
        digests = scratch.store(self.docs.mapInArrow(X.tidy(digest(s)), "doc_id long, row long, n_shingles long, cls long, sketch binary"))
        self.classes = scratch.store(digests.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")).select("of.*", "cls", "n_shingles", "sketch"))
        # entries of the index: about one for two shingles
        shingles = self.classes.agg(F.sum("n_shingles")).first()[0] or 0
        self.size = 8 * shingles
        parts = max(buckets(self.spark) * 2, -(-shingles // (2 * PART_ENTRIES)))
        packed = self.docs.mapInArrow(X.tidy(index_entries(s, parts)), _PACKED)
        found = scratch.store(self.dealt(packed).mapInArrow(X.tidy(bucket_pairs(s.small)), "kind int, a long, b long"))
        scratch.release(self.size)  # the index has been read
        links = self.verify(found.where("kind = 0").select("a", "b").distinct())
        comp = scratch.store(components(scratch, links))
        members = scratch.store(found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").bitwiseAND(F.lit(-2)).alias("cls"), F.col("b").bitwiseAND(F.lit(1)).alias("own")))
        thin = scratch.store(found.where("kind = 2").select(F.col("b").bitwiseAND(F.lit(-2)).alias("cls"), F.col("b").bitwiseAND(F.lit(1)).alias("own")))
        scratch.drop(found)
        if s.star_rounds and not members.isEmpty():
            links, comp = self.more(links, comp, self.verify(self.apart(self.stars(members), comp)))
        unpaid = self.unpaid(members, thin, comp)
        if not unpaid.isEmpty():
            links, comp = self.more(links, comp, self.uncovered(unpaid, comp))
        label = digests.where("n_shingles > 0").select("cls", "doc_id").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
        label = label.select("doc_id", F.coalesce("component", "cls").alias("component"))
        heads = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        out = digests.select("doc_id", "n_shingles", "cls")
        by_class = comp.select(F.col("node").alias("cls"), "component")
        out = out.join(by_class, "cls", "left").withColumn("component", F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("cls"))))
        out = out.join(heads, "component", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def more(self, links: DataFrame, comp: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links with new ones, and their components."""
        if new.isEmpty():
            return links, comp
        links = self.scratch.store(links.union(new).distinct())
        return links, self.scratch.store(components(self.scratch, links))

    def apart(self, pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """The pairs of different components."""
        out = pairs.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
        return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def stars(self, members: DataFrame) -> DataFrame:
        """Pairs of large buckets' centres with their members, other centres in each round.

        A set asks the centres of `star_keys` of its buckets in each round: the rounds only spare the exact steps
        after them work, so no link depends on which.
        """
        out = None
        for r in range(self.s.star_rounds):
            turn = F.struct(F.xxhash64("cls", F.lit(r)).alias("h"), F.col("cls"))
            centre = members.groupBy("key").agg(F.min(turn).alias("c")).select("key", F.col("c.cls").alias("c"))
            by = Window.partitionBy("cls").orderBy(F.xxhash64("key", F.lit(r)), "key", "own")
            asked = members.withColumn("turn", F.row_number().over(by)).where(F.col("turn") <= self.s.star_keys).select("key", "cls")
            pairs = asked.join(centre, "key").where("cls <> c").select(F.least("c", "cls").alias("a"), F.greatest("c", "cls").alias("b"))
            out = pairs if out is None else out.union(pairs)
        return out.distinct()

    def unpaid(self, members: DataFrame, thin: DataFrame, comp: DataFrame) -> DataFrame:
        """cls, own, unpaid, crowded, row: how many large buckets of several components a set is in, and the keys of all its large ones; thin sets too.

        Counted as all its large buckets less those of one component, where nothing is left to find.
        """
        own = members.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        own = self.scratch.store(own)
        settled = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo = hi").select("key")
        less = own.join(settled, "key", "left_semi").groupBy("cls", "own").agg(F.count(F.lit(1)).alias("less"))
        n = members.groupBy("cls", "own").agg(F.count(F.lit(1)).alias("n"), F.collect_set("key").alias("crowded")).join(less, ["cls", "own"], "left")
        n = n.select("cls", "own", (F.col("n") - F.coalesce("less", F.lit(0))).alias("x"), "crowded").where("x > 0")
        n = n.union(thin.select("cls", "own", F.lit(0).cast("long").alias("x"), F.lit(None).cast("array<long>").alias("crowded"))).groupBy("cls", "own").agg(F.sum("x").cast("int").alias("unpaid"), F.max("crowded").alias("crowded"))
        return self.scratch.store(n.join(self.classes.select("cls", "row"), "cls"))

    def uncovered(self, unpaid: DataFrame, comp: DataFrame) -> DataFrame:
        """Links that only mixed buckets could show: one-deletion neighbourhoods, then blocks."""
        scratch, s = self.scratch, self.s
        size = unpaid.agg(F.sum(F.coalesce(F.size("crowded"), F.lit(0)) * 8 + 48)).first()[0] or 0
        side = F.broadcast(unpaid) if size <= s.broadcast_bytes else unpaid.hint("shuffle_hash")
        rows = self.docs.join(side, "row").select("text", "cls", "own", "unpaid", "crowded")
        heavy = scratch.store(rows.mapInArrow(X.tidy(_heavy(s)), _HEAVY))
        if heavy.isEmpty():
            return heavy.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
        # each member is deleted once, and each segment is there whole
        members = heavy.agg(F.sum(F.length("hs"))).first()[0] // 8
        parts = max(buckets(self.spark) * 2, -(-2 * members // PART_ENTRIES))
        packed = heavy.mapInArrow(X.tidy(_neighbourhoods(s, parts)), _PACKED)
        keys = scratch.store(self.dealt(packed).mapInArrow(X.tidy(_neighbours(s.small * 4)), "kind int, a long, b long"))
        scratch.release(self.size)
        found = keys.where("kind = 0").select("a", "b")
        # a segment whose neighbourhood meets a large bucket is not paid; who lacks paid segments goes to the blocks
        lost = keys.where("kind = 1").groupBy(F.col("b").alias("tag")).agg(F.countDistinct("a").alias("lost"))
        rest = heavy.join(lost, "tag", "left").where(F.col("worth") - 2 * F.coalesce("lost", F.lit(0)) < F.col("need"))
        rest = scratch.store(rest.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).select("cls", "band", "hs", "component"))
        pairs = self.verify(self.apart(found.distinct(), comp))
        return pairs.union(self.blocks(rest)).distinct()

    def blocks(self, rest: DataFrame, block: int = 256) -> DataFrame:
        """Links among the remaining sets of a band, block by block."""
        s, scratch = self.s, self.scratch
        n = rest.count()
        if n < 2:
            return rest.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
        sides = -(-n // block)
        rest = rest.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(sides)).cast("int"))
        packed = scratch.store(rest.groupBy("band", "block").agg(F.collect_list(F.struct("cls", "component", "hs")).alias("x")))
        # numbers of blocks are paired first, and dealt; each pair then fetches its blocks
        name = packed.select("band", "block")
        pairs = scratch.store(name.toDF("band", "i").join(name.toDF("band", "j"), "band").where("i <= j"))
        both = pairs.repartition(buckets(self.spark) * 4, "band", "i", "j").join(packed.toDF("band", "i", "x"), ["band", "i"]).join(packed.toDF("band", "j", "y"), ["band", "j"])
        return scratch.store(both.select("x", "y").mapInArrow(X.tidy(_block_links(s)), "a long, b long").distinct())


_HEAVY = "tag long, cls long, band int, own int, worth int, need int, crowded binary, hs binary"


def _heavy(s: Setting):
    """Sets whose paid segments (filled, not in a mixed bucket) are too few in a band."""

    def run(batches):
        for b in batches:
            rows = []
            cls, own, unpaid, crowded = (b.column(x).to_pylist() for x in ("cls", "own", "unpaid", "crowded"))
            for i, hs in _sets_of(b, s):
                for band, mine in schemes(len(hs), s):
                    if int(mine) != own[i]:
                        continue
                    v, cut = segments(hs, bands(s.num, s.den)[1][band])
                    held, need = np.diff(cut), needed(len(hs), mine, s.num, s.den)
                    if int((held > 0).sum()) - unpaid[i] < need:
                        # a neighbourhood counts twice, but a segment of one member has no neighbour without it; a crowded one counts for nothing
                        full = np.isin(_keys(v, band).view(np.int64), np.array(crowded[i] or [], np.int64)) & (held > 0)
                        worth = 2 * int(((held > 1) & ~full).sum()) + int(((held == 1) & ~full).sum())
                        rows.append((cls[i] | own[i], cls[i], band, own[i], worth, need, np.packbits(full).tobytes(), hs.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                names = ("tag", "cls", "band", "own", "worth", "need", "crowded", "hs")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _neighbourhoods(s: Setting, parts: int):
    """Packed (key, class with role, deleted, crowded) of the filled segments and all their one-deletions."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                keys, values = [], []
                part = b.slice(at, 256)
                for tag, band, bits, raw in zip(part.column("tag").to_pylist(), part.column("band").to_pylist(), part.column("crowded").to_pylist(), part.column("hs"), strict=True):
                    hs = np.frombuffer(raw.as_buffer(), np.uint64)
                    v, cut = segments(hs, bands(s.num, s.den)[1][band])
                    seg = np.repeat(np.arange(len(v)), np.diff(cut))
                    base = X.mix(np.arange(len(v), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
                    less = v[seg] - X.mix(hs + np.uint64(0x51ED270B))
                    keep = v != 0
                    keys += [X.mix(v + base)[keep], X.mix(less + base[seg])]
                    # the class's lowest bits: role, whether an element was deleted, whether the segment is crowded as it is
                    full = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(v)).astype(np.int64)
                    base_value = (tag >> 1) << 3 | (tag & 1) << 2
                    values += [base_value | full[keep], base_value | 2 | full[seg]]
                yield _packed_batch(_pack(np.concatenate(keys), np.concatenate(values), parts))

    return run


def _neighbours(small: int):
    """Pairs where one side is whole; large buckets name (key, tag) instead, for segments not known to be crowded. Packed rows come in order of part."""

    def run(batches):
        recent = np.zeros((RECENT, 2), np.int64)
        for keys, values in _by_part(batches):
            yield from of_part(keys, values, recent)

    def of_part(keys, values, recent):
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        start, count = _runs(keys)
        out = []
        for a, g in zip(start[count > 1], count[count > 1], strict=True):
            v = np.unique(values[a : a + g])
            tag, cls, deleted, full = (v >> 3) << 1 | (v >> 2 & 1), (v >> 3) << 1, v >> 1 & 1, v & 1
            if (deleted == 1).all() or len(np.unique(cls)) < 2:
                continue
            if g > small:
                out += [(1, int(keys[a].view(np.int64)), int(t)) for t in np.unique(tag[full == 0])]
                continue
            i, j = np.triu_indices(len(v), 1)
            ok = (cls[i] != cls[j]) & ~((deleted[i] == 1) & (deleted[j] == 1)) & (((tag[i] | tag[j]) & 1) == 1)
            out += [(0, int(min(x, y)), int(max(x, y))) for x, y in zip(cls[i][ok], cls[j][ok], strict=True)]
        out = sorted(set(out))
        pairs = _unseen(np.array([x[1:] for x in out if x[0] == 0], np.int64).reshape(-1, 2), recent).tolist()
        out = [(0, *x) for x in pairs] + [x for x in out if x[0]]
        for i in range(0, len(out), 100_000):
            k, a, b = zip(*out[i : i + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    return run


def _in_common(left: list[np.ndarray], right: list[np.ndarray], most: int = 2_000_000) -> np.ndarray:
    """How many elements each two sets of two lists share: elements of one side look up their run among the sorted ones of the other."""
    out = np.zeros(len(left) * len(right), np.int64)
    own, other = (np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right))
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.argsort(b, kind="stable")
    b, other = b[order], other[order]
    low = np.searchsorted(b, a)
    n = np.searchsorted(b, a, "right") - low
    hit = np.flatnonzero(n)
    low, n, own = low[hit], n[hit], own[hit]
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        k = n[at:to]
        place = np.repeat(low[at:to] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(int(k.sum()))
        out += np.bincount(np.repeat(own[at:to] * len(right), k) + other[place], minlength=len(out))
        at = to
    return out.reshape(len(left), len(right))


def _block_links(s: Setting):
    """Two blocks of sets (cls, component, hs) -> the pairs of similar ones of different components."""

    def run(batches):
        for b in batches:
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                (ca, pa_, ha), (cb, pb, hb) = (
                    (v.values.field("cls").to_numpy(), v.values.field("component").to_numpy(), [np.frombuffer(h.as_buffer(), np.uint64) for h in v.values.field("hs")]) for v in (x, y)
                )
                common = _in_common(ha, hb)
                size = np.array([len(h) for h in ha])[:, None] + np.array([len(h) for h in hb])[None, :]
                i, j = np.nonzero((s.den * common >= s.num * (size - common)) & (pa_[:, None] != pb[None, :]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ca[i], cb[j])), pa.array(np.maximum(ca[i], cb[j]))], ["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    return _Join(docs, setting).run()


def keep_one(docs: DataFrame, setting: Setting = Setting(), also: DataFrame | None = None) -> DataFrame:
    """The documents less all but the one with the smallest doc_id of each component.

    also: more texts (doc_id, text) of some of these, or of other documents, such as those that an earlier stage cut, as they came in. A document stands for
    each of its texts, so two documents belong together if any text of one is similar to any of the other; all texts are joined at once.
    Rows of one id are one document: the row with the smallest text hash stays. Rows without an id stay. docs may have columns of any names.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    join = _Join(texts if also is None else texts.unionByName(also.select("doc_id", "text")), setting)
    links = join.run().where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    links = scratch.store(links.distinct())
    join.scratch.clear()
    members = scratch.store(components(scratch, links)).join(docs.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    heads = members.groupBy("component").agg(F.min("node").alias("head"))
    gone = scratch.store(members.join(heads, "component").where("node <> head").select(F.col("node").alias("doc_id")))
    left = docs.join(gone, "doc_id", "left_anti")
    again = scratch.store(left.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return left
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    first = left.join(again, "doc_id", "left_semi").select(row, turn.alias("turn")).where("turn = 1").select("row.*")
    return left.join(again, "doc_id", "left_anti").unionByName(first)
