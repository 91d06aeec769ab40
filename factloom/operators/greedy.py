"""Greedy rules that are sequential by their wording, carried out in parallel rounds: draws in turn, filling of caps, first come first served, merging again, halving.

Each round decides every row whose decision no undecided row can change, so the result is that of the sequential rule. Tables are
stored between rounds (lineage is cut in the shared folder); what comes to the driver is whether rows are left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed, connected_components
from factloom.operators.relational import numbered, numbered_by_group

#: Rows that one task sums in order.
BLOCK = 16_384


def prefix_sums(rows: DataFrame, group: Sequence[str], place: str, values: Sequence[str], width: int = BLOCK) -> DataFrame:
    """rows with `before_v` for each value v: its sum over the rows of the group with a smaller place. group has no nulls; place is a whole number, distinct in a group.

    Blocks of `width` places are summed, then the blocks of a group, so a group with most of the rows is spread over many tasks.
    """
    dealt = rows.withColumn("_block", F.floor(F.col(place) / width))
    key = [*group, "_block"]
    until = (Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(*key).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    over = Window.partitionBy(*group).orderBy("_block").rowsBetween(*until)
    blocks = blocks.select(*key, *(F.coalesce(F.sum(f"_{v}").over(over), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy(*key).orderBy(place).rowsBetween(*until)
    own = dealt.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_own_{v}") for v in values))
    return own.join(blocks, key).select(*rows.columns, *((F.col(f"_own_{v}") + F.col(f"_{v}")).alias(f"before_{v}") for v in values))


def _placed(rows: DataFrame, group: str, order: Sequence[Column | str], *more: Column) -> DataFrame:
    """rows with the number of their group in its order (_g) and their place in it (_pos)."""
    groups = numbered(rows.select(F.col(group).alias("_name")).distinct(), "_name").withColumnRenamed("position", "_g")
    out = numbered_by_group(rows.select("*", *more), group, *order).withColumnRenamed("position", "_pos")
    return out.join(groups, F.col(group).eqNullSafe(F.col("_name"))).drop("_name")


def draw_in_turn(rows: DataFrame, group: str, order: Sequence[Column | str], keys: Sequence[Column], per_group: int | None = None) -> DataFrame:
    """The rows drawn, and `turn` (from 0): the groups take their next row in turn, in the order of their names; a row that shares a key with one taken before is skipped. WIN-04.

    keys: text columns; a null one cannot be shared. A group stops with per_group rows. The order within a group must be total.

    The turn of a row lies between the rows taken before it in its group and those plus the undecided ones. A row is taken when, in each
    of its keys, even its latest turn is before the earliest turn of all others, and it is sure to be reached; the others of these keys are
    skipped. The row that would be next is always decided; keys of one row only are left out at once, so most rows are taken in the first round.
    """
    names = F.array_compact(F.array(*(F.when(k.isNotNull(), F.xxhash64(F.lit(i), k)) for i, k in enumerate(keys))))
    base = checkpointed(_placed(rows, group, order, names.alias("_keys")))
    flat = base.select("_g", "_pos", F.explode("_keys").alias("key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    claims = checkpointed(flat.distinct().join(shared, "key", "left_semi"))
    most = F.lit(per_group if per_group is not None else (1 << 62))
    state = base.select("_g", "_pos", F.lit(0).alias("taken"), F.lit(1).alias("open"))
    while True:
        state = checkpointed(prefix_sums(state, ["_g"], "_pos", ["taken", "open"]))
        left = state.where((F.col("open") == 1) & (F.col("before_taken") < most))
        if left.isEmpty():
            break
        low = F.struct(F.col("before_taken").alias("t"), "_g", "_pos")
        high = F.struct((F.col("before_taken") + F.col("before_open")).alias("t"), "_g", "_pos")
        left = left.select("_g", "_pos", low.alias("low"), high.alias("high"))
        here = checkpointed(claims.join(left, ["_g", "_pos"]))
        first = here.groupBy("key").agg(F.min("low").alias("first"))
        second = here.join(first, "key").where("low > first").groupBy("key").agg(F.min("low").alias("second"))
        judged = here.join(first, "key").join(second, "key", "left")
        held = judged.where((F.col("low") > F.col("first")) | (F.col("high") >= F.col("second"))).select("_g", "_pos").distinct()
        won = left.where(F.col("high.t") < most).join(held, ["_g", "_pos"], "left_anti").select("_g", "_pos")
        won = checkpointed(won)
        spent = claims.join(won, ["_g", "_pos"], "left_semi").select("key").distinct()
        out = claims.join(spent, "key", "left_semi").select("_g", "_pos").distinct().join(won, ["_g", "_pos"], "left_anti")
        reached = left.select("_g", "_pos").join(out, ["_g", "_pos"], "left_anti").join(won.withColumn("won", F.lit(1)), ["_g", "_pos"], "left")
        reached = reached.select("_g", "_pos", F.coalesce("won", F.lit(0)).alias("taken"), (1 - F.coalesce("won", F.lit(0))).alias("open"))
        state = state.where("taken = 1").select("_g", "_pos", "taken", "open").union(reached)
    turns = state.where("taken = 1").select("_g", "_pos", F.col("before_taken").cast("long").alias("turn"))
    return base.join(turns, ["_g", "_pos"]).select(*rows.columns, "turn")


def fill(rows: DataFrame, group: str, order: Sequence[Column | str], size: str, caps: DataFrame) -> DataFrame:
    """The rows kept: each group goes through its rows in order and keeps every one that still fits its cap; later, smaller ones may fit where one did not. WIN-13.

    caps: group, cap. Sizes are whole numbers from 0; rows without a size, and rows of groups without a cap, are not kept.

    A round halves what is left of a cap. Rows larger than the rest are out. Of those above its half one at most can be kept: the first that
    fits behind the smaller rows before it. Either it comes and takes more than half, or the smaller rows fill up half before one of
    them fails, or all of them fit and the group is done.
    """
    base = checkpointed(_placed(rows, group, order))
    open_ = base.select("_g", "_pos", F.col(group).alias("_name"), F.col(size).cast("long").alias("size")).where("size >= 0")
    limits = caps.select(F.col(group).alias("_cap_of"), F.col("cap").cast("long").alias("rest")).where("rest >= 0")
    rest = checkpointed(open_.select("_g", "_name").distinct().join(limits, F.col("_name").eqNullSafe(F.col("_cap_of"))).select("_g", "rest"))
    open_, kept = open_.select("_g", "_pos", "size"), None
    while True:
        open_ = open_.join(rest, "_g").where("size <= rest").withColumn("small", F.when(F.col("size") * 2 <= F.col("rest"), F.col("size")).otherwise(0))
        open_ = checkpointed(prefix_sums(open_.withColumn("is_small", F.col("size") * 2 <= F.col("rest")), ["_g"], "_pos", ["small"]))
        if open_.isEmpty():
            break
        fits = F.col("before_small") + F.col("size") <= F.col("rest")
        point = F.struct("_pos", "before_small", "size")
        ends = open_.groupBy("_g").agg(F.min(F.when(~F.col("is_small") & fits, point)).alias("large"), F.min(F.when(F.col("is_small") & ~fits, point)).alias("over"), F.first("rest").alias("rest"))
        comes = F.col("large").isNotNull() & (F.col("over").isNull() | (F.col("large._pos") < F.col("over._pos")))
        end = F.when(comes, F.col("large._pos")).otherwise(F.col("over._pos"))
        after = F.when(comes, F.col("rest") - F.col("large.before_small") - F.col("large.size")).otherwise(F.col("rest") - F.col("over.before_small"))
        ends = checkpointed(ends.select("_g", end.alias("end"), comes.alias("comes"), after.alias("after")))
        judged = open_.drop("rest").join(ends, "_g")
        take = F.when(F.col("end").isNull(), F.col("is_small")).otherwise(F.when(F.col("is_small"), F.col("_pos") < F.col("end")).otherwise(F.col("comes") & (F.col("_pos") == F.col("end"))))
        now = checkpointed(judged.where(take).select("_g", "_pos"))
        kept = now if kept is None else kept.union(now)
        open_ = judged.where("_pos > end").select("_g", "_pos", "size")
        rest = ends.where("end is not null").select("_g", F.col("after").alias("rest"))
    return base.drop("_g", "_pos").limit(0) if kept is None else base.join(kept, ["_g", "_pos"], "left_semi").drop("_g", "_pos")


def first_come(claims: DataFrame) -> DataFrame:
    """turn of the claimants who are served: in the order of their turns, each who finds all its keys free gets them. claims: turn, key.

    A claimant who is first in all its keys is served, and whoever shares one of these is out; then the rest are looked at anew. A long
    chain of claims, each sharing a key with the next only, takes a round for every second link.
    """
    left, served = checkpointed(claims.select("turn", "key").where("key is not null").distinct()), None
    while not left.isEmpty():
        first = left.groupBy("key").agg(F.min("turn").alias("first"))
        waits = left.join(first, "key").where("turn > first").select("turn").distinct()
        now = checkpointed(left.select("turn").distinct().join(waits, "turn", "left_anti"))
        served = now if served is None else served.union(now)
        gone = left.join(left.join(now, "turn", "left_semi").select("key").distinct(), "key", "left_semi").select("turn").distinct()
        left = checkpointed(left.join(gone, "turn", "left_anti"))
    return claims.select("turn").limit(0) if served is None else served


def check_splits(replies: DataFrame, classes: DataFrame, predicates: DataFrame, least_texts: int = 1) -> DataFrame:
    """replies and `reason`: the first reason for rejecting one, null if it is accepted; earlier lines go first. SCA-40.

    replies: line (distinct), predicate, name, pairs (array of struct s, o), texts, all_pairs (whether it takes all pairs of the predicate): a new
    name for some pairs of a predicate. classes: class. predicates: predicate. Names and pairs of accepted replies are taken for later ones.
    """
    r = replies.select("*", F.trim(F.coalesce("name", F.lit(""))).alias("_n"), F.coalesce("pairs", F.array()).alias("_ps"))
    known = predicates.select(F.col("predicate").alias("_known")).where("_known is not null").distinct()
    r = r.join(known.withColumn("_p", F.lit(True)), F.col("predicate") == F.col("_known"), "left").drop("_known")
    r = r.join(known.withColumn("_t", F.lit(True)), F.col("_n") == F.col("_known"), "left").drop("_known")
    flat = r.select("line", "predicate", F.explode("_ps").alias("pair"))
    slots = flat.select("line", F.explode(F.array("pair.s", "pair.o")).alias("class"))
    strange = slots.join(classes.select("class").distinct(), "class", "left_anti").select("line").distinct().withColumn("_strange", F.lit(True))
    r = checkpointed(r.join(strange, "line", "left"))
    bad = [
        ("no name", F.col("_n") == ""),
        ("name not in capitals", ~((F.col("_n") == F.upper("_n")) & F.col("_n").rlike(r"^[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*$"))),
        ("unknown predicate", F.col("_p").isNull()),
        ("same name", F.col("_n") == F.col("predicate")),
        ("name taken", F.col("_t").isNotNull()),
        ("no pairs", F.size("_ps") == 0),
        ("pair repeated", F.size(F.array_distinct("_ps")) < F.size("_ps")),
        ("unknown class", F.col("_strange").isNotNull()),
        ("pair taken", F.lit(False)),
        ("too few texts", F.coalesce("texts", F.lit(0)) < least_texts),
        ("nothing left of the predicate", F.coalesce("all_pairs", F.lit(False))),
    ]
    fine = F.lit(True)
    for _, b in bad:
        fine &= ~F.coalesce(b, F.lit(False))
    able = r.where(fine)
    name = F.xxhash64(F.lit("name"), "_n")
    pair = F.xxhash64(F.lit("pair"), "predicate", "pair.s", "pair.o")
    claims = able.select(F.col("line").alias("turn"), name.alias("key")).union(able.select("line", "predicate", F.explode("_ps").alias("pair")).select("line", pair))
    claims = checkpointed(claims)
    owner = claims.join(first_come(claims), "turn", "left_semi").select("key", F.col("turn").alias("owner"))  # one claimant a key
    all_ = r.select("line", F.lit("name").alias("kind"), name.alias("key")).union(flat.select("line", F.lit("pair"), pair))
    lost = all_.join(owner, "key").where("owner < line").groupBy("line").agg(F.max(F.col("kind") == "name").alias("_lost_name"), F.max(F.col("kind") == "pair").alias("_lost_pair"))
    r = r.join(lost, "line", "left")
    more = {"name taken": F.col("_lost_name"), "pair taken": F.col("_lost_pair")}
    reason = F.lit(None).cast("string")
    for text, b in reversed(bad):
        b = F.coalesce(b, F.lit(False)) | F.coalesce(more[text], F.lit(False)) if text in more else b
        reason = F.when(b, text).otherwise(reason)
    return r.select(*replies.columns, reason.alias("reason"))


def strongest(pins: DataFrame, top: int = 2) -> DataFrame:
    """predicate, part, key: the pins of a part with most weight, ties alphabetical."""
    by = Window.partitionBy("predicate", "part").orderBy(F.desc("weight"), "pin")
    return pins.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= top).select("predicate", "part", F.col("pin").alias("key"))


def merge_again(parts: DataFrame, pins: DataFrame, keys: Callable[[DataFrame], DataFrame] = strongest) -> tuple[DataFrame, DataFrame]:
    """(predicate, part, into), (predicate, part, pin, weight): parts of one predicate that share a key are one again, under their smallest name; their pins unite, weights added. SET-10.

    parts: predicate, part; pins: predicate, part, pin, weight. keys gives (predicate, part, key) from the pins as they are now: uniting pins
    changes keys, so merging goes on until no two parts share one. Each round contracts all components at once; each but the last has a
    part less at least. Parts without pins stay.
    """
    into = checkpointed(parts.select("predicate", "part").where("predicate is not null and part is not null").distinct().withColumn("into", F.col("part")))
    held = pins.join(into, ["predicate", "part"], "left_semi").groupBy("predicate", "part", "pin").agg(F.sum("weight").alias("weight"))
    while True:
        held = checkpointed(held)
        named = checkpointed(keys(held).distinct())
        node = F.concat_ws("\u0001", "predicate", "part")
        least = named.groupBy("predicate", "key").agg(F.min("part").alias("low"))
        links = named.join(least, ["predicate", "key"]).where("part <> low").select(node.alias("a"), F.concat_ws("\u0001", "predicate", "low").alias("b")).distinct()
        links = checkpointed(links)
        if links.isEmpty():
            return into, held
        heads = connected_components(links).where("node <> component").select(F.split_part("node", F.lit("\u0001"), F.lit(1)).alias("predicate"), F.split_part("node", F.lit("\u0001"), F.lit(2)).alias("_was"), F.split_part("component", F.lit("\u0001"), F.lit(2)).alias("_now"))
        heads = checkpointed(heads)
        moved = into.join(heads.withColumnRenamed("_was", "into"), ["predicate", "into"], "left")
        into = checkpointed(moved.select("predicate", "part", F.coalesce("_now", "into").alias("into")))
        moved = held.join(heads.withColumnRenamed("_was", "part"), ["predicate", "part"], "left")
        held = moved.select("predicate", F.coalesce("_now", "part").alias("part"), "pin", "weight").groupBy("predicate", "part", "pin").agg(F.sum("weight").alias("weight"))


def ask_in_halves(items: DataFrame, ask: Callable[[list[str]], list[str]], refused: Callable[[Exception], bool]) -> DataFrame:
    """id, reply, refused, rounds: batches of items are asked about; a refused batch is asked again in halves, down to single items. OPS-04.

    items: id (long, distinct), batch (text), prompt; a batch is one call, so its size is bounded by the caller (see request_chunks).
    All batches of a round are asked at once in tasks, and its answers are stored before the next, so no batch is asked twice (but where a task is
    tried again). A batch of n takes at most 1 + ceil(log2 n) rounds. An item refused alone has no reply. Other errors stop the run.
    """
    schema = "id long, batch string, prompt string, n int, place int, reply string, refused boolean"

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        prompts = list(pdf["prompt"])
        try:
            replies, no = ask(prompts), False
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        except Exception as e:
            if not refused(e):
                raise
            replies, no = [None] * len(prompts), True
        return pd.DataFrame({"id": pdf["id"], "batch": pdf["batch"], "prompt": prompts, "n": len(prompts), "place": range(len(prompts)), "reply": replies, "refused": no})

    work, done, rounds = items.select("id", "batch", "prompt"), None, 0
    while True:
        rounds += 1
        asked = checkpointed(work.groupBy("batch").applyInPandas(call, schema))
        settled = asked.where("not refused or n = 1").select("id", "reply", "refused", F.lit(rounds).alias("rounds"))
        done = settled if done is None else done.union(settled)
        half = F.when(F.col("place") < F.floor(F.col("n") / 2), "0").otherwise("1")
        work = asked.where("refused and n > 1").select("id", F.concat("batch", F.lit("/"), half).alias("batch"), "prompt")
        if work.isEmpty():
            return done
