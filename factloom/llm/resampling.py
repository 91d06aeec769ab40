"""Target-distribution importance resampling with an integer word dictionary.

Documents are weighted by how much likelier the hashed n-grams of a target text are than those of the corpus, and a seeded Gumbel draw takes the
documents with the highest weight plus noise.

1. Texts are encoded in pages of some megabytes: each document as numbers of words with their counts, its longer n-grams as tuples of those
   numbers. The pages of a block share one numbering; a block ends when its task does, or with `BLOCK_WORDS` words. Pages and
   the words of the blocks are written once, so what follows reads numbers only.
2. The distinct words of all blocks get integer ids: the dictionary. A word reaches the shuffle once a block, however frequent it is.
3. Tuples of a block's numbers become tuples of dictionary ids; equal ones are added up over corpus and target.
4. Each distinct tuple's bytes (its words, joined by one space) are put together and hashed once: unsigned crc32 modulo `buckets`.
5. Gains of buckets join the tuples, go back to their blocks and pages, and are added up for each document there.
6. A range-partitioned sort numbers the documents by score, so no task holds them all.

weight: floored mean of the gains over a document's n-grams, repeats counted. gain: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) with s of S
corpus and t of T target n-grams in the bucket, B buckets. Of the N documents with at least `least_words` words, floor(percent N / 100) are drawn;
ties go to the smaller doc_id.

Null and empty texts have no words: no n-grams, weight 0, never drawn if least_words is above 0. Null doc_id: hashed as the empty string, last
among ties. Repeated rows are documents of their own with the same score. Empty tables: an empty result, or gains against nothing. Extra columns
are not read. A long document makes a block of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import Scratch, buckets, side, text_batches
from factloom.operators.relational import numbered

#: Bytes of text a page holds (a longer document is a page of its own), and words that a block holds (or those of one page, if it has more).
PAGE_BYTES = 2 << 20
BLOCK_WORDS = 1 << 18
#: Pages in a stored file.
FILE_PAGES = 8


@dataclass(frozen=True)
class Setting:
    """Runs of 1 to n words; crc32 buckets; percent drawn of documents with at least `least_words` words."""

    n: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"

    def __post_init__(self):
        if self.n < 1 or not 1 <= self.buckets <= 1 << 20 or not 0 <= self.percent <= 100:
            raise ValueError("n is 1 or more, buckets 1 to 2^20, percent 0 to 100")


def _word_array(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """All words in order; they are what is left without the bytes between them."""
    body = low[X.ALNUM_WORD[low]]
    offsets = np.append(0, np.cumsum(end - start, dtype=np.int64))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(body))


def _longer(ids: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Of the runs of 2 to n words: the tuple of each, its document, and the words of each tuple."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][doc] - np.arange(len(ids))  # words from here to the document's end
    number, at, many = ids, np.arange(len(ids)), int(ids.max(initial=0)) + 1
    numbers, docs, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for k in range(2, n + 1):
        more = left[at] >= k
        pair = number[more] * many + ids[at[more] + k - 1]
        at = at[more]
        _, one, number = np.unique(pair, return_index=True, return_inverse=True)
        numbers.append(number + len(words))
        docs.append(doc[at])
        words += [[int(x) for x in ids[p : p + k]] for p in at[one]]
    return np.concatenate(numbers), np.concatenate(docs), words


def _often(doc: np.ndarray, number: np.ndarray) -> list[pa.Array]:
    """document, number, times of the distinct pairs, by document."""
    most = int(number.max(initial=0)) + 1
    seen, often = np.unique(doc * most + number, return_counts=True)
    return [pa.array(x, pa.int32()) for x in (seen // most, seen % most, often)]


_PAGES = (
    "block long, page int, docs array<struct<doc_id:%s,n_words:long,n_features:long>>, w_doc array<int>, w_word array<int>, w_times array<int>, "
    "t_doc array<int>, t_tuple array<int>, t_times array<int>, tuples array<array<int>>, tuple_times array<long>, words array<string>, counts array<long>"
)
_COLUMNS = ("docs", "w_doc", "w_word", "w_times", "t_doc", "t_tuple", "t_times", "tuples", "tuple_times", "words", "counts")


def _encoded(n: int, target: int, kind: pa.DataType):
    """doc_id, text -> pages, and a row of the words of each block; the number of a block names its partition, its turn there and its side."""
    numbers = pa.list_(pa.int32())
    types = [pa.list_(pa.struct([("doc_id", kind), ("n_words", pa.int64()), ("n_features", pa.int64())])), *[numbers] * 6, pa.list_(numbers), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]

    def row(block: int, page: int, **lists: pa.Array) -> pa.RecordBatch:
        cols = [pa.ListArray.from_arrays(pa.array([0, len(lists[c])], pa.int32()), lists[c]).cast(t) if c in lists else pa.nulls(1, t) for c, t in zip(_COLUMNS, types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([page], pa.int32()), *cols], ["block", "page", *_COLUMNS])

    def run(batches):
        turn, page, known, counts = 0, 0, {}, np.zeros(0, np.int64)
        name = lambda: (TaskContext.get().partitionId() << 32) + 2 * turn + target
        for b in batches:
            for at, to, data, offsets in X.slices(b, "text", PAGE_BYTES):
                low = X.LOWER[data]
                start, end, first = X.words(low, offsets, X.ALNUM_WORD)
                coded = _word_array(low, start, end).dictionary_encode()
                local, vocabulary = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                if known and len(known) + len(vocabulary) > BLOCK_WORDS:
                    yield row(name(), -1, words=pa.array(known, pa.string()), counts=pa.array(counts))
                    turn, page, known, counts = turn + 1, 0, {}, np.zeros(0, np.int64)
                place = np.fromiter((known.setdefault(w, len(known)) for w in vocabulary), np.int64, len(vocabulary))
                counts = np.append(counts, np.zeros(len(known) - len(counts), np.int64))
                counts[place] += np.bincount(local, minlength=len(place))
                ids = place[local] if len(local) else np.zeros(0, np.int64)
                doc, tuples, tuple_doc, words = np.repeat(np.arange(to - at), np.diff(first)), *(_longer(ids, first, n) if n > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64), []))
                lists = {"tuples": pa.array(words, pa.list_(pa.int32())), "tuple_times": pa.array(np.bincount(tuples, minlength=len(words)), pa.int64())}
                if not target:  # no document of the target gets a weight
                    n_words = np.diff(first)
                    facts = pa.StructArray.from_arrays([b.column("doc_id").slice(at, to - at), pa.array(n_words, pa.int64()), pa.array(n_words + np.bincount(tuple_doc, minlength=to - at), pa.int64())], ["doc_id", "n_words", "n_features"])
                    lists |= {"docs": facts} | dict(zip(_COLUMNS[1:7], [*_often(doc, ids), *_often(tuple_doc, tuples)], strict=True))
                yield row(name(), page, **lists)
                page += 1
        if known:
            yield row(name(), -1, words=pa.array(known, pa.string()), counts=pa.array(counts))

    return X.tidy(run)


def _summed(kind: pa.DataType):
    """Pages with the gains of their block's words and of their tuples -> doc_id, n_words, n_features, weight."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) if b.column(c)[i].is_valid else np.zeros(0, np.int64)  # noqa: E731, B023
                docs = b.column("docs")[i].values
                total = np.zeros(len(docs), np.int64)
                for x, gains in (("w_word", get("gains")), ("t_tuple", get("tuple_gains"))):
                    at = get(x)
                    if len(at):
                        through = np.append(0, np.cumsum(get(f"{x[0]}_times") * gains[at]))
                        ends = np.searchsorted(get(f"{x[0]}_doc"), np.arange(len(docs) + 1))
                        total += through[ends[1:]] - through[ends[:-1]]
                n = docs.field("n_features").to_numpy(zero_copy_only=False)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([docs.field("doc_id").cast(kind), docs.field("n_words"), docs.field("n_features"), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return X.tidy(run)


def _listed(batches):
    """block, page, t, gain in order -> block, page, gains: the gains of one block, or page, are held at a time."""
    at, held = None, []

    def row() -> pa.RecordBatch:
        gains = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(gains)], pa.int32()), pa.array(gains))], ["block", "page", "gains"])

    for b in batches:
        block, page, gain = (np.asarray(b.column(c)) for c in ("block", "page", "gain"))
        starts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (page[1:] != page[:-1]))) if len(block) else []
        for x, y in zip(starts, np.append(starts[1:], len(block)), strict=True):
            here = (int(block[x]), int(page[x]))
            if at is not None and here != at:
                yield row()
                held = []
            at = here
            held.append(gain[x:y].copy())
    if at is not None:
        yield row()


def _by_number(rows: DataFrame, parts: int) -> DataFrame:
    """block, page, gains: the gains of a block's words, or of a page's tuples, in the order of their numbers (as many as those have).

    Sorted rows are cut into lists as they pass. An aggregate of lists would hold those of up to 128 blocks as objects.
    """
    dealt = rows.select("block", "page", "t", "gain").repartition(parts, "block", "page").sortWithinPartitions("block", "page", "t")
    return dealt.mapInArrow(X.tidy(_listed), "block long, page int, gains array<long>")


def weights(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document of docs (doc_id, text) against the texts of target (text)."""
    s, spark = setting, docs.sparkSession
    scratch = Scratch(spark)
    text_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if arrow is None:
        raise TypeError(f"doc_id is a long, an int or a string, not {kind}")
    text = F.col("text").cast("string").alias("text")
    pages = scratch.store(docs.select("doc_id", text).mapInArrow(_encoded(s.n, 0, arrow), _PAGES % kind), FILE_PAGES)
    aims = scratch.store(target.select(F.lit(None).cast(kind).alias("doc_id"), text).mapInArrow(_encoded(s.n, 1, arrow), _PAGES % kind), FILE_PAGES)
    both = pages.union(aims)

    words = both.where("page < 0").select("block", F.posexplode("words").alias("t", "word"), "counts").select("block", "t", "word", F.element_at("counts", F.col("t") + 1).alias("n"))
    dictionary = scratch.store(words.select("word").distinct().withColumn("id", F.monotonically_increasing_id()))
    named = scratch.store(words.join(dictionary, "word").select("block", "t", "n", F.col("id").alias("i0")))
    # a tuple is a column for each place, null behind its end
    keys = [f"i{k}" for k in range(s.n)]
    grams = named.select("block", F.lit(-1).alias("page"), "t", "n", "i0", *(F.lit(None).cast("long").alias(k) for k in keys[1:]))
    if s.n > 1:
        longer = both.where("page >= 0").select("block", "page", F.posexplode("tuples").alias("t", "w"), "tuple_times")
        longer = longer.select("block", "page", "t", F.element_at("tuple_times", F.col("t") + 1).alias("n"), *(F.get("w", F.lit(k)).alias(f"w{k}") for k in range(s.n)))
        for k in range(s.n):
            longer = longer.join(named.select("block", F.col("t").alias(f"w{k}"), F.col("i0").alias(f"i{k}")), ["block", f"w{k}"], "left")
        grams = scratch.store(grams.union(longer.select("block", "page", "t", "n", *keys)))

    of_target = F.col("block").bitwiseAND(F.lit(1).cast("long")) == 1
    tuples = grams.groupBy(*keys).agg(F.sum(F.when(~of_target, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(of_target, F.col("n")).otherwise(0)).alias("t"))
    spelt = tuples
    for k in range(s.n):
        spelt = spelt.join(dictionary.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"word{k}")), f"i{k}", "inner" if k == 0 else "left")
    gram = F.concat_ws(" ", *(f"word{k}" for k in range(s.n)))
    hashed = scratch.store(spelt.select(*keys, "s", "t", F.pmod(F.crc32(gram.cast("binary")), F.lit(s.buckets)).cast("int").alias("bucket")))

    size = hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = size.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + F.lit(float(s.buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + F.lit(float(s.buckets))))
    gains = scratch.store(size.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")))  # whole has one row, gains has `buckets` at most
    gained = hashed.join(side(gains), "bucket").select(*keys, "gain")
    if s.n == 1:
        back = grams.where(~of_target).join(gained, "i0")
    else:
        other = [F.col(k).alias(f"_{k}") for k in keys]
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        back = grams.where(~of_target).join(gained.select("gain", *other), same).drop(*(f"_{k}" for k in keys))
    parts = buckets(spark)
    of_words = _by_number(back.where("page < 0"), parts).drop("page")
    rows = pages.where("page >= 0").select("block", "page", "docs", *_COLUMNS[1:7]).join(of_words, "block", "left")
    if s.n > 1:
        rows = rows.join(_by_number(back.where("page >= 0"), parts).withColumnRenamed("gains", "tuple_gains"), ["block", "page"], "left")
    else:
        rows = rows.withColumn("tuple_gains", F.lit(None).cast("array<bigint>"))
    return rows.mapInArrow(_summed(arrow), f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, 3, ... of the documents drawn, else null) of every document."""
    s = setting
    rows = weights(docs, target, s)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = Scratch(docs.sparkSession).store(rows)  # a range-partitioned sort reads its rows twice
    rows = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= s.least_words).alias("_open"))
    placed = numbered(rows, F.desc("_open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), "n_features")
    most = placed.agg(F.floor(F.coalesce(F.sum(F.col("_open").cast("long")), F.lit(0)) * s.percent / 100).alias("_most"))  # one row
    rank = F.when(F.col("_open") & (F.col("position") < F.col("_most")), (F.col("position") + 1).cast("long"))
    return placed.crossJoin(F.broadcast(most)).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
