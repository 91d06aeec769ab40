"""Line dedup: runs of lines that occurred before are deleted, found by distributed prefix doubling over line-ID sequences.

A suffix is a place (document, line). Lines get names by hash; a suffix's name of length 2 h joins its name of length h with that of the
suffix h lines further on, one join and one grouped minimum for each doubling. Suffixes with equal names of length h are the intervals of the
suffix array whose longest common prefix has h lines or more (the array's order itself is not needed, so no suffixes are sorted). Suffixes
that are alone in their interval leave, so the work shrinks with each doubling.
In every interval all members but the first are later copies of h lines; overlapping and adjacent stretches unite to the maximal repeated
runs of a document, which are deleted. A run counts with `min_lines` lines (that length is one of the lengths named), or as a single line of
at least `line_chars` characters; with min_lines of 1 only single lines count.

Doubling ends at `min_lines`: each later copy of more lines is the union of later copies of min_lines lines, so the intervals of that length
already give every maximal run, and longer names would change no row. `repeats` goes on to the longest repeat, for those who want the
intervals themselves: how far a place repeats, how often, and where first.

The order is (doc_id, line number). The first copy of every line stays. Text is split at line feeds only; a kept
text joins its lines with line feeds. Null texts stay null, empty texts have one empty line and stay. Rows with equal id and equal
text are one document and get one result each; null ids sort first. Rows of a line that is everywhere are dealt by a salt, so they
meet in no task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._spark import Scratch, with_groups

BROADCAST_BYTES = 32 << 20


def lengths(min_lines: int, longest: int | None = None) -> Iterator[tuple[int, int]]:
    """(length of names, lines between the two joined names) of the doublings, `min_lines` among the lengths, up to `longest`."""
    have = 1
    while longest is None or have < longest:
        new = min(2 * have, min_lines) if have < min_lines else 2 * have
        yield new, new - have
        have = new


def _intervals(scratch: Scratch, suffixes: DataFrame) -> DataFrame:
    """The suffixes whose name is not theirs alone, with the first place of their interval and its size."""
    place = F.struct("doc_id", "key", "line")
    groups = scratch.store(suffixes.groupBy("name").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return with_groups(suffixes, groups, "name", "first")


def _named(docs: DataFrame, line_chars: int) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), (F.length(x) >= line_chars).alias("long"), F.xxhash64(x).alias("name")))
    return docs.where("text is not null").select("key", "doc_id", F.inline(lines))


def _doublings(live: DataFrame, min_lines: int, longest: int | None, scratch: Scratch) -> Iterator[tuple[int, DataFrame]]:
    """(length, suffixes of intervals of that length) from those of single lines on, until none is left."""
    for length, step in lengths(min_lines, longest):
        live = live.select("key", "doc_id", "line", "name")
        ahead = live.select("key", (F.col("line") - step).alias("line"), F.col("name").alias("ahead"))
        named = live.join(ahead, ["key", "line"]).select("key", "doc_id", "line", F.xxhash64("name", "ahead", F.lit(length)).alias("name"))
        live = scratch.store(_intervals(scratch, scratch.store(named)))
        if live.isEmpty():
            return
        yield length, live


def repeated_stretches(docs: DataFrame, min_lines: int = 2, line_chars: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """key, line, end: stretches of lines with an earlier copy. docs: key, doc_id, text."""
    scratch = scratch or Scratch(docs.sparkSession)
    every = scratch.store(_named(docs, line_chars))
    # a document of several equal rows counts once
    live = scratch.store(_intervals(scratch, every).dropDuplicates(["key", "line"]))
    later = F.struct("doc_id", "key", "line") > F.col("first")
    out = live.where(later & F.col("long")).select("key", "line", (F.col("line") + 1).alias("end"))
    for length, found in _doublings(live, min_lines, min_lines, scratch):
        if length == min_lines:
            out = out.unionByName(found.where(later).select("key", "line", (F.col("line") + length).alias("end")))
    return out.groupBy("key", "line").agg(F.max("end").alias("end"))


def repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, line, n_lines, first (doc_id, line): places of docs (doc_id, text) that repeat an earlier one, by the longest named interval they are later copies in.

    Lengths are 1, 2, 4, ...; a place that repeats 5 lines is in an interval of 4.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    live = scratch.store(_intervals(scratch, scratch.store(_named(rows, 0))).dropDuplicates(["key", "line"]))
    later = F.struct("doc_id", "key", "line") > F.col("first")
    found = [(1, live), *_doublings(live, 1, None, scratch)]
    every = None
    for length, at in found:
        part = at.where(later).select("key", "doc_id", "line", F.lit(length).alias("n_lines"), F.struct("first.doc_id", "first.line").alias("first"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("key", "doc_id", "line").agg(F.max(F.struct("n_lines", "first")).alias("x"))
    return best.select("doc_id", "line", "x.n_lines", "x.first")


def repeated_runs(docs: DataFrame, min_lines: int = 2, line_chars: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """key, gone (maximal runs to delete: line, end; in order) for the documents that lose lines. docs: key, doc_id, text."""
    scratch = scratch or Scratch(docs.sparkSession)
    by = Window.partitionBy("key").orderBy("line")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    found = repeated_stretches(docs, min_lines, line_chars, scratch)
    found = found.withColumn("new", F.coalesce(F.col("line") > F.max("end").over(before), F.lit(True)).cast("int"))
    runs = found.withColumn("run", F.sum("new").over(by)).groupBy("key", "run").agg(F.min("line").alias("line"), F.max("end").alias("end"))
    return scratch.store(runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("line", "end"))).alias("gone")))


def line_dedup(docs: DataFrame, min_lines: int = 2, line_chars: int = 40) -> DataFrame:
    """All columns of docs with the kept text, and n_lines, n_removed, n_runs (maximal runs of deleted lines)."""
    mine = ["_key", "_gone", "_lines"]
    clash = [c for c in docs.columns if c.lower() in mine]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    text = F.col("text").cast("string")
    rows = docs.withColumn("_key", F.xxhash64("doc_id", text, text.isNull()))
    gone = repeated_runs(rows.select(F.col("_key").alias("key"), "doc_id", text.alias("text")), min_lines, line_chars)
    gone = gone.select(F.col("key").alias("_key"), F.col("gone").alias("_gone"))
    size = gone.agg(F.sum(8 * F.size("_gone") + 32)).first()[0] or 0
    rows = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone.hint("shuffle_hash"), "_key", "left")
    rows = rows.withColumn("_lines", F.split(text, "\n", -1))
    # what stands between the runs, each stretch sliced once
    count = F.size("_gone")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("_gone", i - 1)["end"])
    stop = lambda i: F.when(i == count, F.size("_lines")).otherwise(F.get("_gone", i)["line"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), count), lambda i: F.slice("_lines", begin(i) + 1, stop(i) - begin(i))))
    removed = F.aggregate("_gone", F.lit(0), lambda n, run: n + run["end"] - run["line"])
    whole = F.col("_gone").isNull()
    return rows.select(
        *[F.when(whole, text).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.coalesce(F.when(text.isNotNull(), F.size("_lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(removed).cast("long").alias("n_removed"),
        F.when(whole, 0).otherwise(count).cast("long").alias("n_runs"),
    )
