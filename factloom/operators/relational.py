"""Relational kit: deduplication, latest rows, folds, votes, splits, samples, diffs.

Grouped minima of structs replace windows wherever one row per key is wanted: they combine before the shuffle, so a key with a third
of all rows costs no more than any other. Every choice has a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed


def _row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def first_copy(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, with `copies` (rows of the key). SET-02."""
    best = df.groupBy(*key).agg(F.min_by(_row(df), F.struct(*order)).alias("_r"), F.count(F.lit(1)).alias("copies"))
    return best.select("_r.*", "copies")


def best_copy(df: DataFrame, key: Sequence[str], passed: Column, order: Sequence[str]) -> DataFrame:
    """For each key the first row that passed, else the first; `copies` counts the rows. AGG-05."""
    ranked = F.struct((~F.coalesce(passed, F.lit(False))).alias("failed"), *order)
    return df.groupBy(*key).agg(F.min_by(_row(df), ranked).alias("_r"), F.count(F.lit(1)).alias("copies")).select("_r.*", "copies")


def latest_by_key(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """key, time, value of the latest row; keys whose latest time has several values are left out, as are empty (withdrawn) values. JOIN-15."""
    at = df.groupBy(*key, time).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max(F.col(value).isNull()).alias("gap"))
    last = at.groupBy(*key).agg(F.max(time).alias("_t"), F.max_by(F.struct("lo", "hi", "gap"), F.col(time)).alias("v"))
    settled = F.col("v.lo").isNotNull() & (F.col("v.lo") == F.col("v.hi")) & ~F.col("v.gap")
    out = last.where(settled).select(*key, F.col("_t").alias(time), F.col("v.lo").alias(value))
    return out.where(F.trim(F.col(value).cast("string")) != "")


def spelling_fold(df: DataFrame, key: Sequence[str], spelling: str) -> DataFrame:
    """key, spelling (most frequent, ties alphabetical), spellings, rows. AGG-03."""
    n = df.groupBy(*key, spelling).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*key).agg(F.min_by(spelling, F.struct(-F.col("n"), F.col(spelling))).alias(spelling), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows"))


def majority_vote(df: DataFrame, key: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """key, label with most rows (tie: named first), whether labels disagree. AGG-04."""
    n = df.where(F.col(label).isNotNull()).groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    return n.groupBy(*key).agg(F.min_by(label, F.struct(-F.col("n"), F.col("first"))).alias(label), (F.count(F.lit(1)) > 1).alias("disagree"))


def positions(df: DataFrame, order: str) -> DataFrame:
    """df with `position` (from 0) by a column of distinct values. WIN-01."""
    return numbered(df, order)


def pool_part(position: Column, head: int = 6, every: int = 3) -> Column:
    """tuning or held-out: the first `head` places are tuning, then every third one is held out. WIN-01."""
    out = (position >= head) & ((position - head) % every == every - 1)
    return F.when(out, "held-out").otherwise("tuning")


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with `position` (from 0) in a global order. WIN-02, WIN-03.

    A range-partitioned sort; each partition is numbered by itself from the count of rows before it, so no task holds all rows. Ties in the
    order are numbered as they come: name enough columns.
    """
    rows = checkpointed(df.sort(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(counts), "_part").withColumn("position", F.col("_first") + F.col("_place")).drop("_id", "_part", "_place", "_first")


def numbered_by_group(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """df with `position` (from 0) in its group's order; a group may span many tasks. WIN-03."""
    rows = numbered(df, group, *order)
    first = rows.groupBy(group).agg(F.min("position").alias("_start"))
    here = rows.join(first.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    return here.withColumn("position", F.col("position") - F.col("_start")).drop("_start", "_group")


def rank_groups(df: DataFrame, key: str) -> DataFrame:
    """key, rows, rank by rows descending, key ascending. WIN-02, WIN-14, WIN-16."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return numbered(n, F.desc("rows"), F.col(key)).select(key, "rows", (F.col("position") + 1).cast("int").alias("rank"))


def hash_order(seed: str, *columns: str) -> Column:
    """sha256 of the seed and the columns, joined by a bar."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)), 256)


def hash_sample(df: DataFrame, n: int, seed: str, *columns: str) -> DataFrame:
    """The n rows with the smallest hashes. WIN-07."""
    return df.withColumn("h", hash_order(seed, *columns)).orderBy("h", *columns).limit(n)


def stratified_sample(df: DataFrame, stratum: str, n: int, seed: str, *columns: str) -> DataFrame:
    """n rows of each stratum by hash, with their place; every prefix is a sample. WIN-03, WIN-06."""
    by = Window.partitionBy(stratum).orderBy("h", *columns)
    return df.withColumn("h", hash_order(seed, *columns)).withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def largest_remainder(sizes: DataFrame, key: str, size: str, places: int) -> DataFrame:
    """key, size, places: whole shares in proportion to size, the rest by largest remainder, ties by key. WIN-05."""
    total = sizes.agg(F.sum(size).alias("_t"))  # one row
    quota = F.col(size) * F.lit(places)
    out = sizes.crossJoin(F.broadcast(total))
    out = out.withColumn("_w", F.floor(F.try_divide(quota, "_t"))).withColumn("_m", quota % F.nullif("_t", F.lit(0)))
    out = numbered(out, F.desc("_m"), key)
    left = out.agg((F.lit(places) - F.sum("_w")).alias("_left"))
    return out.crossJoin(F.broadcast(left)).select(key, size, (F.col("_w") + F.when(F.col("position") < F.col("_left"), 1).otherwise(0)).cast("long").alias("places"))


def fair_prefix(df: DataFrame, part: str, order: str, taken: Column) -> DataFrame:
    """Rows before the first one of their part that is not taken. FLT-10."""
    marked = df.withColumn("_ok", F.coalesce(taken, F.lit(False)))
    gap = marked.groupBy(part).agg(F.min(F.when(~F.col("_ok"), F.col(order))).alias("_gap"))
    return marked.join(gap, part).where(F.col("_gap").isNull() | (F.col(order) < F.col("_gap"))).drop("_ok", "_gap")


def keyed_diff(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, change (added, removed, changed) between two versions. SET-05, SNK-04."""
    rest = [c for c in left.columns if c not in key]
    a = left.select(*key, F.struct(*rest).alias("_a"))
    b = right.select(*key, F.struct(*rest).alias("_b"))
    both = a.join(b, list(key), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*key, "change")


def bag_difference(expected: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns, missing: how many more of each row are expected than found. SET-03."""
    both = expected.select(*columns, F.lit(1).alias("_n")).unionByName(found.select(*columns, F.lit(-1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("missing")).where("missing > 0")


def twin_kinds(df: DataFrame, id_: str, title: str, notes: str) -> DataFrame:
    """id, kind: whole text, notes only or title only, if another record shares it; empty parts never match. JOIN-04.

    Texts are compared by 128-bit hashes, so only those travel; a hash that very many records share is counted before the shuffle.
    """

    def shared(*cols: str) -> Column:
        filled = F.lit(True)
        for c in cols:
            filled &= F.coalesce(F.trim(c), F.lit("")) != ""
        return F.when(filled, F.unhex(F.md5(F.to_json(F.array(*cols)).cast("binary"))))

    kinds = {"whole text": (title, notes), "notes only": (notes,), "title only": (title,)}
    marks = F.array(*(F.struct(F.lit(i).alias("rank"), shared(*c).alias("mark")) for i, c in enumerate(kinds.values())))
    rows = df.select(id_, F.inline(marks)).where("mark is not null")
    twins = rows.groupBy("rank", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank", "mark")
    best = rows.join(twins, ["rank", "mark"], "left_semi").groupBy(id_).agg(F.min("rank").alias("rank"))
    return best.select(id_, F.element_at(F.array(*map(F.lit, kinds)), F.col("rank") + 1).alias("kind"))


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of a total order. WIN-08."""
    return df.orderBy(*order).limit(n)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df; evaluating it fails if the key is missing or repeated. SRC-10."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).agg(F.count(F.lit(1)).alias("bad"))
    ok = bad.select(F.assert_true(F.col("bad") == 0, f"{key} is missing or repeated").alias("ok"))
    return df.crossJoin(F.broadcast(ok)).where("ok is null").drop("ok")  # ok has one row


def require_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """Stops if the two relations share a key. JOIN-03."""
    if not left.join(right, key, "left_semi").isEmpty():
        raise ValueError(f"both sides have rows with the same {key}")


def common_records(runs: DataFrame, run: str, record: str, fingerprint: str) -> DataFrame:
    """Records that every run has with one fingerprint. JOIN-21."""
    total = runs.agg(F.countDistinct(run).alias("_runs"))
    n = runs.groupBy(record).agg(F.countDistinct(run).alias("_n"), F.countDistinct(fingerprint).alias("_f"))
    return n.crossJoin(F.broadcast(total)).where("_n = _runs and _f = 1").select(record)  # total has one row
