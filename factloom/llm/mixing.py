"""Mixing sources to target weights by hierarchical budgets.

The tree has the levels domain, language, source. A budget of tokens goes down the tree in proportion to the weights, but no node gets more than
its leaves can give in `max_epochs` passes. What a saturated node cannot take goes to its siblings by their weights;
only when all siblings are full does an ancestor's capacity bind, and then the ancestor's siblings take it. Sorted by capacity over
weight, saturated nodes come first, so each level is one window over the (few) nodes.

A leaf takes whole epochs and a prefix of one more. Each epoch has its own seeded order, by md5 of seed, epoch and
doc_id; the prefix ends before the budget would be passed. Its end is found from running totals over 4096 ranges of the order and
a sort of the one range that holds it, so a leaf with a third of all rows is never sorted as a whole. The
documents themselves are not shuffled as long as the table of leaves is small (its rows are counted before each broadcast): each row
compares its place with its leaf's end. A larger table of leaves is joined by a shuffle.

Null values of a level form a node of their own, as the empty string. Null and empty texts have 0 tokens. Rows with equal
doc_id in a leaf stand at one place and are taken or left together. Nodes without a weight have weight 1, a weight of 0 gives nothing.
Columns of docs may have any names; one named _epoch gives way to the epoch.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._spark import Scratch, side
from factloom.llm.packing import n_words

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Setting:
    """Weights by level and node; the budget as a share of all tokens, or in tokens; most passes over a leaf; the seed."""

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    share: float = 0.6
    tokens: int | None = None
    max_epochs: int = 2
    seed: str = "0"


def domain_of(source: Column | str = "source") -> Column:
    """A domain for tables without one: three groups of sources by crc32."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source, F.lit(""))), F.lit(3)).cast("string"))


def _weight(level: str, s: Setting) -> Column:
    out = F.lit(1.0)
    for node, w in s.weights.get(level, {}).items():
        out = F.when(F.col(level) == node, float(w)).otherwise(out)
    return out


def _share_out(nodes: DataFrame, parents: list[str], level: str, s: Setting) -> DataFrame:
    """The budget of each node of a level from its parent's `budget`: columns parents, level, cap, budget."""
    nodes = nodes.withColumn("w", _weight(level, s)).withColumn("r", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    turn = by.orderBy(F.col("r").asc_nulls_last(), level)
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    nodes = nodes.withColumn("full", F.coalesce(F.col("r") * weight <= left, F.lit(False)) & (F.col("w") > 0))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(by)
    given = F.when(F.col("full"), F.col("cap")).when(open_weight > 0, F.greatest(F.lit(0.0), rest) * F.col("w") / open_weight).otherwise(0.0)
    return nodes.withColumn("given", given).drop("budget", "w", "r", "full").withColumnRenamed("given", "budget")


def budgets(leaves: DataFrame, s: Setting) -> DataFrame:
    """LEVELS, supply, budget (whole tokens) of every leaf. leaves: LEVELS, supply."""
    leaves = leaves.withColumn("cap", F.col("supply").cast("double") * s.max_epochs)
    # a subtree of weight 0 gives nothing, so it has no capacity either
    usable = F.lit(True)
    for level in LEVELS:
        usable &= _weight(level, s) > 0
    leaves = leaves.withColumn("cap", F.when(usable, F.col("cap")).otherwise(0.0))
    total = leaves.agg(F.sum("supply").alias("t")).select((F.lit(float(s.tokens)) if s.tokens is not None else F.floor(F.col("t") * s.share).cast("double")).alias("budget"))
    out = total
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = leaves.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap"))
        up = out.select(*parents, "budget")
        nodes = nodes.join(up, parents) if parents else nodes.crossJoin(F.broadcast(up))
        out = _share_out(nodes, parents, level, s)
    return leaves.drop("cap").join(out.select(*LEVELS, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget")), list(LEVELS))


def mix(docs: DataFrame, setting: Setting = Setting(), domain: Column | None = None) -> DataFrame:
    """The columns of docs, and _epoch (from 0; in place of a column of that name): one row for each time a document is taken."""
    s, spark = setting, docs.sparkSession
    scratch = Scratch(spark)
    levels = [F.coalesce(domain_of() if domain is None else domain, F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LEVELS[1:])]

    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def order(epoch: Column, own: Column = own) -> Column:
        return F.md5(F.concat_ws("|", F.lit(s.seed), epoch.cast("string"), own).cast("binary"))

    facts = docs.select("doc_id", *(c.alias(n) for c, n in zip(levels, LEVELS, strict=True)), n_words("text").cast("long").alias("n"))
    facts = scratch.store(facts)
    leaves = facts.groupBy(*LEVELS).agg(F.sum("n").alias("supply"))
    plan = budgets(leaves, s).withColumn("whole", F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.greatest("supply", F.lit(1))), F.lit(s.max_epochs))).otherwise(0))
    plan = plan.withColumn("left", F.col("budget") - F.col("whole") * F.col("supply"))
    plan = scratch.store(plan)
    # the end of each leaf's prefix
    placed = facts.join(side(plan), list(LEVELS)).where("whole < %d" % s.max_epochs).withColumn("h", order(F.col("whole")))
    placed = placed.select(*LEVELS, "left", "h", own.alias("id"), "n", F.substring("h", 1, 3).alias("range"))
    ranges = placed.groupBy(*LEVELS, "left", "range").agg(F.sum("n").alias("n"), F.max("h").alias("h"))
    by = Window.partitionBy(*LEVELS).orderBy("range")
    ranges = scratch.store(ranges.withColumn("through", F.sum("n").over(by)))
    ends = ranges.where("through <= left").groupBy(*LEVELS).agg(F.max("h").alias("end"))
    split = ranges.where("through > left").groupBy(*LEVELS).agg(F.min_by(F.struct("range", (F.col("through") - F.col("n")).alias("before")), "range").alias("x"))
    split = scratch.store(split.select(*LEVELS, F.col("x.range").alias("range"), F.col("x.before").alias("before")))
    inside = placed.join(side(split), [*LEVELS, "range"])
    inside = inside.withColumn("through", F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("h", "id")))
    inner = inside.where("through <= left").groupBy(*LEVELS).agg(F.max(F.struct("h", "id")).alias("inner"))
    plan = plan.join(ends, list(LEVELS), "left").join(inner, list(LEVELS), "left")
    end = F.coalesce(F.col("inner.h"), F.col("end"))
    plan = plan.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("whole").alias("_whole"), end.alias("_end"), F.col("inner.id").alias("_end_id"))
    plan = scratch.store(plan)
    # a row travels as one struct, so no name of docs meets one of the plan
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "_epoch"]
    rows = docs.select(F.struct(*kept).alias("_row"), own.alias("_own"), *(c.alias(f"_{n}") for c, n in zip(levels, LEVELS, strict=True)))
    rows = rows.join(side(plan), [f"_{n}" for n in LEVELS])
    h, own = order(F.col("_whole"), F.col("_own")), F.col("_own")
    partial = (F.col("_whole") < s.max_epochs) & F.coalesce((h < F.col("_end")) | ((h == F.col("_end")) & (F.col("_end_id").isNull() | (own <= F.col("_end_id")))), F.lit(False))
    times = F.col("_whole") + F.when(partial, 1).otherwise(0)
    rows = rows.withColumn("_times", times).where("_times > 0")
    return rows.select("_row.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)).alias("_epoch"))
