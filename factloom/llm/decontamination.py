"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

1. Windows of `size` consecutive words of the benchmark's items; an item of fewer words is one window. Equal windows are one, so copies among the
   items cost nothing further.
2. The index: one posting (term, document, place) for every word of the corpus that some window holds, written once. Each document also has one
   posting of its length, under term -1, so its texts are split once.
3. From the index each term's frequency; a window with a term that the corpus lacks cannot occur. The others' terms are ordered, rarest first.
4. The postings of a window's rarest term, moved by its place in the window, are its candidate starts. They are intersected with the moved postings of
   the second rarest term, and those left with all of the rest. What is left are exact occurrences.
5. Proximity (slack given): the words of a window within a stretch of size + slack words, in any order. Postings of all its terms around those of the
   rarest one are gathered, a bounded number for each, and stretches are tested that begin at one of them.

Every step is a join or a grouped count on well spread keys (document and place); no list of a term's postings is ever held. A hot term's postings
are candidates only for windows that have nothing rarer. Terms, windows and frequencies grow with the benchmark: they are broadcast if their counted
size is small, else joined by a shuffle.

Null or empty texts have no words, nothing is hit. Repeated rows of documents get a result each; items without id go by the empty name; repeated
item_ids count once. Null doc_ids are kept. An empty benchmark hits nothing. Extra columns are not read. Documents are told apart by a 64-bit hash of
doc_id and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._spark import Scratch, side

#: What ends a word once A-Z are a-z: all ASCII but 0-9 and a-z. The words are the runs [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
BREAKS = "".join(chr(x) for x in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH = -1


@dataclass(frozen=True)
class Setting:
    """Words of a window; words more that a proximity match may hold (None: no proximity matches)."""

    size: int = 10
    slack: int | None = None

    def __post_init__(self):
        if self.size < 1 or (self.slack is not None and self.slack < 0):
            raise ValueError("size is 1 or more, slack 0 or more")


def split(text: Column) -> Column:
    """Words with A-Z as a-z. One pass makes every break a blank; cutting at one character needs no regular expression, which took most of the query's time."""
    flat = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.array_remove(F.split(flat, " "), "")


def windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(words) of distinct windows; (words, item) that holds it."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), split(F.col("text")).alias("ws")).where(F.size("ws") > 0).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - size + 1))
    rows = w.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at"), F.lit(size)).alias("words")).distinct()
    return rows.select("words").distinct(), rows


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, key, term, pos: the postings of the terms (word, term), and for each document one of its length, under term -1."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), F.concat(split(text), F.array(F.lit(""))).alias("ws"))
    words = rows.select("doc_id", "key", F.posexplode("ws").alias("pos", "word"))
    return words.join(side(terms), "word").select(F.when(F.col("term") == LENGTH, F.col("doc_id")).alias("doc_id"), "key", "term", "pos")


@dataclass
class Found:
    """What a search leaves: lengths (doc_id, key, n_words), exact (win, key, start, n), near (win, key, first, last), holders (win, item)."""

    lengths: DataFrame
    exact: DataFrame
    near: DataFrame | None
    holders: DataFrame


def search(docs: DataFrame, items: DataFrame, setting: Setting = Setting()) -> Found:
    """All occurrences of the items' windows in the documents."""
    s, spark = setting, docs.sparkSession
    scratch = Scratch(spark)
    distinct, holders = windows(items, s.size)
    wins = scratch.store(distinct.withColumn("win", F.monotonically_increasing_id()))
    holders = scratch.store(holders.join(wins, "words").select("win", "item"))
    placed = wins.select("win", F.size("words").alias("n"), F.posexplode("words").alias("off", "word"))
    terms = placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    # no word is empty: the empty one stands for the end of a text
    terms = scratch.store(terms.union(spark.range(1).select(F.lit("").alias("word"), F.lit(LENGTH).cast("long").alias("term"))))

    postings = scratch.store(index(docs, terms))
    lengths = postings.where(F.col("term") == LENGTH).select("doc_id", "key", F.col("pos").alias("n_words"))
    postings = postings.where(F.col("term") != LENGTH).select("key", "term", "pos")
    often = scratch.store(postings.groupBy("term").agg(F.count(F.lit(1)).alias("f")))

    ordered = placed.join(terms, "word").join(often, "term", "left").groupBy("win", "n").agg(F.array_sort(F.collect_list(F.struct("f", "off", "term"))).alias("ts"))
    ordered = scratch.store(ordered.where(~F.exists("ts", lambda t: t["f"].isNull())))

    def of(turn: int) -> DataFrame:
        """win, n, off, term of each window's turn-th rarest term."""
        return ordered.where(F.size("ts") >= turn).select("win", "n", F.element_at("ts", turn).alias("t")).select("win", "n", "t.off", "t.term")

    rarest = scratch.store(of(1))
    anchors = postings.join(side(rarest), "term").select("win", "key", "n", (F.col("pos") - F.col("off")).alias("start"))
    starts = scratch.store(anchors.where("start >= 0").distinct())

    def listed(terms: DataFrame, among: DataFrame) -> DataFrame:
        """The postings of some terms in documents that still have candidates."""
        some = postings.join(side(scratch.store(terms.select("term").distinct())), "term", "left_semi")
        return some.join(side(scratch.store(among.select("key").distinct())), "key", "left_semi")

    # the second rarest term's list, moved; windows of one word have none
    second = scratch.store(of(2).select("win", "off", "term"))
    goal = starts.join(side(second), "win").select("win", "key", "n", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    left = goal.join(listed(second, starts), ["key", "pos", "term"], "left_semi").select("win", "key", "n", "start").union(starts.where("n = 1").select("win", "key", "n", "start"))
    left = scratch.store(left)
    # all the others at once: the moved lists of a window meet in one start
    rest = ordered.select("win", F.explode(F.slice("ts", 3, s.size)).alias("t")).select("win", "t.off", "t.term")
    rest = scratch.store(rest)
    goal = left.join(side(rest), "win").select("win", "key", "n", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    met = goal.join(listed(rest, left), ["key", "pos", "term"], "left_semi").groupBy("win", "key", "n", "start").agg(F.count(F.lit(1)).alias("met"))
    exact = met.where("met = n - 2").drop("met").union(left.where("n <= 2"))
    exact = scratch.store(exact)
    near = None if s.slack is None else scratch.store(_near(scratch, postings, ordered, starts, s))
    return Found(lengths, exact, near, holders)


def _near(scratch: Scratch, postings: DataFrame, ordered: DataFrame, starts: DataFrame, s: Setting) -> DataFrame:
    """win, key, first, last: stretches of at most n + slack words that hold all words of a window, as often as it has them; the first around each of its rarest word's places.

    Postings near an anchor are found by stripes as wide as a stretch can be: its own and both neighbours.
    """
    wide = s.size + s.slack
    rarest = ordered.select("win", "n", F.col("ts")[0]["term"].alias("term"))
    anchors = postings.join(side(scratch.store(rarest)), "term").select("win", "key", F.col("pos").alias("at"), (F.col("n") + s.slack).alias("reach")).distinct()
    need = scratch.store(ordered.select("win", F.explode("ts").alias("t")).groupBy("win", F.col("t.term").alias("term")).agg(F.count(F.lit(1)).cast("int").alias("times")))
    count = need.groupBy("win").agg(F.count(F.lit(1)).alias("kinds"))
    stripes = anchors.withColumn("stripe", F.explode(F.sequence(F.floor((F.col("at") - F.col("reach")) / wide), F.floor((F.col("at") + F.col("reach")) / wide))))
    wanted = stripes.join(side(need), "win")
    there = postings.distinct().withColumn("stripe", F.floor(F.col("pos") / wide))
    close = wanted.join(there, ["key", "stripe", "term"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("reach"))
    group = close.groupBy("win", "key", "at", "reach").agg(F.array_sort(F.collect_set(F.struct("pos", "term", "times"))).alias("ps"))
    group = group.join(side(scratch.store(count)), "win")
    # places of a stretch that begins at a posting not after the anchor
    stretch = group.select("*", F.explode(F.filter("ps", lambda p: p["pos"] <= F.col("at"))).alias("b")).withColumn("first", F.col("b.pos"))
    inside = F.filter("ps", lambda p: (p["pos"] >= F.col("first")) & (p["pos"] < F.col("first") + F.col("reach")))
    held = stretch.where("at < first + reach").withColumn("ps", inside).select("win", "key", "at", "kinds", "first", F.explode("ps").alias("p"))
    enough = held.groupBy("win", "key", "at", "kinds", "first", "p.term").agg(F.min("p.times").alias("times"), F.array_sort(F.collect_list("p.pos")).alias("at_"))
    enough = enough.where(F.size("at_") >= F.col("times")).groupBy("win", "key", "at", "kinds", "first").agg(F.count(F.lit(1)).alias("have"), F.max(F.element_at("at_", F.col("times"))).alias("last"))
    return enough.where("have = kinds").groupBy("win", "key", "at").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("wide"), "first", "last")).alias("m")).select("win", "key", "m.first", "m.last").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences), n_items, items (sorted ids), contaminated, and with slack n_near (items with proximity matches only)."""
    found = search(docs, items, setting)
    hit = found.exact.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    names = found.exact.select("key", "win").distinct().join(side(found.holders), "win").select("key", "item").distinct()
    named = names.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per = hit.join(named, "key")
    out = found.lengths.join(per, "key", "left")
    columns = [
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    ]
    if found.near is not None:
        close = found.near.select("key", "win").distinct().join(side(found.holders), "win").select("key", "item").distinct()
        close = close.join(names, ["key", "item"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))
        out = out.join(close, "key", "left")
        columns.append(F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return out.select(*columns)
