"""Graph operators on edge tables: components, chains of merges, lineage walks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that all executors share: spark.checkpoint.dir. Only a local master may do without."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors on other machines need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (smallest reachable node). SET-08.

    Labels fall to the smallest neighbour's label and then to their label's label, so long paths halve each round.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = checkpointed(both.union(both.select("y", "x")).where("x is not null and y is not null").distinct())
    label = checkpointed(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("c")))
    for _ in range(most_rounds):
        near = both.join(label, both.y == label.node).groupBy("x").agg(F.min("c").alias("m"))
        step = label.join(near, label.node == near.x, "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was"))
        parent = step.select(F.col("node").alias("p"), F.col("c").alias("pc"))
        step = step.join(parent, step.c == parent.p, "left").select("node", F.least("c", F.coalesce("pc", "c")).alias("c"), "was")
        step = checkpointed(step)
        label = step.select("node", "c")
        if step.where("c <> was").isEmpty():
            return label.select("node", F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def resolve_chains(merges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """old, new with chains followed to their end; a cycle is refused. SET-09.

    Doubling: each round jumps to the target's target.
    """
    cur = checkpointed(merges.select("old", "new").distinct())
    if not cur.groupBy("old").count().where("count > 1").isEmpty():
        raise ValueError("an entry merges into two others")
    for _ in range(most_rounds):
        nxt = cur.alias("m").join(cur.alias("n"), F.col("m.new") == F.col("n.old"), "left").select(F.col("m.old").alias("old"), F.coalesce("n.new", "m.new").alias("new"), F.col("n.new").isNotNull().alias("moved"))
        if not nxt.where("old = new").isEmpty():
            raise ValueError("merges form a cycle")
        nxt = checkpointed(nxt)
        if nxt.where("moved").isEmpty():
            return nxt.select("old", "new")
        cur = nxt.select("old", "new")
    raise ValueError("merges form a cycle")


def walk(edges: DataFrame, start: DataFrame, most_depth: int = 50) -> DataFrame:
    """node, depth of everything reached from the start nodes along child -> parent edges (least depth). JOIN-20.

    Ancestors deeper than most_depth are an error, not left out.
    """
    seen = checkpointed(start.select("node", F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, most_depth + 2):
        front = front.join(edges, front.node == edges.child).select(F.col("parent").alias("node")).distinct().join(seen, "node", "left_anti")
        front = checkpointed(front.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.union(front))
    raise RuntimeError("ancestors are deeper than most_depth")
