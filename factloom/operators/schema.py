"""Schema operators: support counts, labels, validation, rules, comparison, merging, saturation.

A schema is a few small relations (classes, predicates, patterns, pins, rules); facts are the large side. Small sides are broadcast
after their rows are counted, and joined plainly beyond the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb, lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def support_counts(facts: DataFrame, entry: Sequence[str], text: str, maintainer: str) -> DataFrame:
    """entry, support (distinct texts), maintainers (distinct). AGG-01, AGG-28."""
    return facts.groupBy(*entry).agg(F.countDistinct(text).alias("support"), F.countDistinct(maintainer).alias("maintainers"))


def breadth(support: DataFrame, least: int) -> DataFrame:
    """Entries of enough support by how many maintainers have them: 1, 2, 3 or more. AGG-28."""
    band = F.when(F.col("maintainers") == 1, "1").when(F.col("maintainers") == 2, "2").otherwise("3 or more")
    return support.where(F.col("support") >= least).groupBy(band.alias("found_in")).agg(F.count(F.lit(1)).alias("entries"))


def _expected(texts: int, least: int):
    def run(frames):
        import numpy as np

        log_choose = np.vectorize(lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) if 0 <= k <= n else -np.inf, otypes=[float])
        for pdf in frames:
            found, drawn = pdf["support"].to_numpy(), pdf["k"].to_numpy()
            all_ways = log_choose(texts, drawn)
            below = sum(np.exp(log_choose(found, x) + log_choose(texts - found, drawn - x) - all_ways) for x in range(least))
            yield pdf.assign(reach=np.where(found >= least, np.maximum(0.0, 1 - below), 0.0))[["k", "n", "reach"]]

    return run


def saturation(support: DataFrame, texts: int, points: Sequence[int], least: int) -> DataFrame:
    """texts, expected: entries expected to reach `least` texts in random subsets of so many texts, all at most. AGG-27.

    The hypergeometric lower tail has `least` terms; entries of equal support are counted once.
    """
    if any(not 0 < p <= texts for p in points):
        raise ValueError("a subset has between one and all texts")
    sizes = support.groupBy("support").agg(F.count(F.lit(1)).alias("n"))
    at = support.sparkSession.createDataFrame([(int(p),) for p in points], "k long")
    both = sizes.crossJoin(F.broadcast(at))  # the points are given
    reach = both.mapInPandas(_expected(texts, least), "k long, n long, reach double")
    return reach.groupBy(F.col("k").alias("texts")).agg(F.sum(F.col("n") * F.col("reach")).alias("expected"))


def representative(candidates: Sequence[dict], n: int, group: str = "group") -> list[dict]:
    """n diverse examples of one entry. AGG-02.

    Groups with more distinct texts come first (ties by name) and give one example a round, those with a text not yet shown before the others. A group
    gives first what has a new text and a new maintainer, then what has one of them, smaller texts first, and each text once. `texts` of a candidate is
    the number of its group's texts, where the candidates are a part of them.
    """
    key = lambda x: (x is not None, x)  # noqa: E731  nulls first
    held: dict = {}
    for c in candidates:
        held.setdefault(c[group], set()).add((c["text"], c["maintainer"]))
    size = {g: len({t for t, _ in rows}) for g, rows in held.items()} | {c[group]: c["texts"] for c in candidates if "texts" in c}
    order = sorted(held, key=lambda g: (-size[g], str(g)))
    out, texts, makers = [], set(), set()
    while len(out) < n and any(held.values()):
        waiting = [g for g in order if held[g]]
        while waiting and len(out) < n:
            g = next((g for g in waiting if any(t not in texts for t, _ in held[g])), waiting[0])
            waiting.remove(g)
            text, maker = min(held[g], key=lambda r: ((r[0] in texts) + (r[1] in makers), key(r[0]), key(r[1])))
            held[g] = {r for r in held[g] if r[0] != text}
            texts.add(text)
            makers.add(maker)
            out.append({group: g, "text": text, "maintainer": maker})
    return out


def representative_examples(df: DataFrame, entry: str, n: int, group: str, text: str, maintainer: str) -> DataFrame:
    """entry, place, text: representative examples of each entry, by the rule of `representative` over all of its rows.

    A frequent entry does not bring all its rows to one task: with n examples, fewer than n texts and n maintainers are taken at any time, so
    of a group's rows only the first n of each text, of these the first n of each maintainer and of these the first 2 n^2 can be chosen; and of an entry's groups
    only the first n, and the first n of each text's groups, of these the first n^2 + n. What is left out has earlier rows or groups to be chosen before it.
    """

    def first(rows: DataFrame, most: int, by: list[str], *order) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")

    rows = df.select(entry, group, text, maintainer).distinct()
    texts = rows.select(entry, group, text).distinct()
    turn = [F.desc("_n"), F.col("_s")]
    ranked = texts.groupBy(entry, group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.col(group).cast("string"), F.lit("None")))
    same = F.col(f"t.{entry}").eqNullSafe(F.col(f"r.{entry}")) & F.col(f"t.{group}").eqNullSafe(F.col(f"r.{group}"))
    named = texts.alias("t").join(ranked.alias("r"), same).select("t.*", "r._n", "r._s")
    groups = first(named, n, [entry, text], *turn).drop(text).unionByName(first(ranked, n, [entry], *turn)).distinct()
    groups = first(groups, n * n + n, [entry], *turn).select(entry, group, "_n")
    same = F.col(f"x.{entry}").eqNullSafe(F.col(f"g.{entry}")) & F.col(f"x.{group}").eqNullSafe(F.col(f"g.{group}"))
    rows = rows.alias("x").join(groups.alias("g"), same).select("x.*", "g._n")
    rows = first(rows, n, [entry, group, text], maintainer)
    rows = first(rows, n, [entry, group, maintainer], text)
    rows = first(rows, 2 * n * n, [entry, group], text, maintainer)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def pick(pdf):
        import pandas as pd

        found = representative([dict(zip(("group", "text", "maintainer", "texts"), r, strict=True)) for r in pdf[[group, text, maintainer, "_n"]].astype(object).where(pdf[[group, text, maintainer, "_n"]].notna(), None).itertuples(index=False, name=None)], n)
        return pd.DataFrame({entry: [pdf[entry].iloc[0]] * len(found), "place": range(1, len(found) + 1), text: [f["text"] for f in found]})

    return rows.groupBy(entry).applyInPandas(pick, f"{entry} {kinds[entry]}, place int, {text} {kinds[text]}")


def with_labels(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """triples with subject_label, predicate_label and object_label. labels: name, label. JOIN-06."""
    out, side = triples, small(labels)
    for slot in ("subject", "predicate", "object"):
        out = out.join(side.select(F.col("name").alias(slot), F.col("label").alias(f"{slot}_label")), slot, "left")
    return out


def validate(facts: DataFrame, classes: DataFrame, predicates: DataFrame, patterns: DataFrame, pins: DataFrame) -> DataFrame:
    """facts (s, p, o) with errors: unknown class or predicate, pattern not in the schema, pin not met ('any' fits all). JOIN-07, FLT-04, SCA-41."""
    c = small(classes.select(F.col("name").alias("_n"), F.lit(1).alias("_ok")))
    out = facts
    for slot in ("s", "o"):
        out = out.join(c.select(F.col("_n").alias(slot), F.col("_ok").alias(f"_{slot}")), slot, "left")
    out = out.join(small(predicates.select(F.col("name").alias("p"), F.lit(1).alias("_p"))), "p", "left")
    out = out.join(small(patterns.select("s", "p", "o", F.lit(1).alias("_pat"))), ["s", "p", "o"], "left")
    allowed = pins.groupBy(F.col("p").alias("p")).agg(F.collect_set(F.struct("ps", "po")).alias("_pins"))
    out = out.join(small(allowed), "p", "left")
    fits = F.exists("_pins", lambda x: x.ps.isin("any") & x.po.isin("any") | (x.ps == F.col("s")) & ((x.po == F.col("o")) | (x.po == "any")) | (x.ps == "any") & (x.po == F.col("o")))
    errors = F.array_compact(F.array(
        F.when(F.col("_s").isNull(), "subject class"), F.when(F.col("_o").isNull(), "object class"), F.when(F.col("_p").isNull(), "predicate"),
        F.when(F.col("_pat").isNull() & F.col("_pins").isNull(), "pattern"), F.when(F.col("_pins").isNotNull() & ~fits, "pin"),
    ))
    return out.select(*facts.columns, errors.alias("errors"))


def apply_rules(facts: DataFrame, rules: DataFrame, key: str = "p") -> DataFrame:
    """facts with `target`: of the rules of a predicate whose conditions hold, the one with most conditions, then the first line. JOIN-11.

    rules: predicate, if_s, if_o (null: any), target, line. The best rule of each (predicate, subject class, object class) is found once.
    """
    seen = facts.select(key, "s", "o").distinct()
    r = small(rules)
    ok = (F.col(key) == F.col("predicate")) & (F.col("if_s").isNull() | (F.col("if_s") == F.col("s"))) & (F.col("if_o").isNull() | (F.col("if_o") == F.col("o")))
    conditions = F.when(F.col("if_s").isNotNull(), 1).otherwise(0) + F.when(F.col("if_o").isNotNull(), 1).otherwise(0)
    best = seen.join(r, ok).groupBy(key, "s", "o").agg(F.min_by("target", F.struct(-conditions, F.col("line"))).alias("target"))
    return facts.join(best, [key, "s", "o"], "left")


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """predicate, left, right: two rules of one condition each that can both apply to one fact, with different targets, and no rule with both conditions. JOIN-14."""
    a = rules.where("if_s is not null and if_o is null").select("predicate", F.col("if_s").alias("s"), F.col("target").alias("ts"), F.col("line").alias("left"))
    b = rules.where("if_o is not null and if_s is null").select("predicate", F.col("if_o").alias("o"), F.col("target").alias("to"), F.col("line").alias("right"))
    both = rules.where("if_s is not null and if_o is not null").select("predicate", F.col("if_s").alias("s"), F.col("if_o").alias("o"))
    return a.join(b, "predicate").where("ts <> to").join(both, ["predicate", "s", "o"], "left_anti").select("predicate", "left", "right")


def translate(facts: DataFrame, entity: DataFrame, rules: DataFrame) -> DataFrame:
    """facts (s, p, o) as (ts, tp, to) in another schema, ends swapped where the rule says so; null where there is no counterpart. JOIN-12, PRJ-10.

    entity: source, target. rules as in apply_rules, with `swap`; the target '(none)' means none.
    """
    ruled = apply_rules(facts, rules.withColumn("target", F.struct(F.nullif("target", F.lit("(none)")).alias("tp"), F.coalesce("swap", F.lit(False)).alias("swap"))))
    e = small(entity)
    out = ruled.join(e.select(F.col("source").alias("s"), F.col("target").alias("_ts")), "s", "left").join(e.select(F.col("source").alias("o"), F.col("target").alias("_to")), "o", "left")
    swap = F.coalesce(F.col("target.swap"), F.lit(False))
    return out.select(*facts.columns, F.when(swap, F.col("_to")).otherwise(F.col("_ts")).alias("ts"), F.col("target.tp").alias("tp"), F.when(swap, F.col("_ts")).otherwise(F.col("_to")).alias("to"))


def reachability(truth: DataFrame, entity: DataFrame, rules: DataFrame) -> DataFrame:
    """truth (s, p, o) with `reachable` (a rule gives its predicate) and `strict` (its classes are reachable too). JOIN-13."""
    p = small(rules.where("target <> '(none)'").select(F.col("target").alias("p"), F.lit(True).alias("_p")).distinct())
    c = small(entity.select("target", F.lit(True).alias("_c")).distinct())
    out = truth.join(p, "p", "left").join(c.toDF("s", "_s"), "s", "left").join(c.toDF("o", "_o"), "o", "left")
    reach = F.coalesce("_p", F.lit(False))
    return out.select(*truth.columns, reach.alias("reachable"), (reach & F.coalesce("_s", F.lit(False)) & F.coalesce("_o", F.lit(False))).alias("strict"))


def compare(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, where: both, left or right. JOIN-17."""
    a = left.select(*key).distinct().withColumn("_a", F.lit(1))
    b = right.select(*key).distinct().withColumn("_b", F.lit(1))
    where = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, list(key), "full_outer").select(*key, where.alias("where"))


def same_schema(left: DataFrame, right: DataFrame) -> bool:
    """Whether two schemas have the same entries. SCA-45."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def merge(base: DataFrame, additions: DataFrame, key: str, spelling: str) -> DataFrame:
    """One spelling for each key: the base's, else the first addition's. Additions from held-out records are refused. JOIN-18, PRJ-09."""
    add = additions.where(~F.coalesce("held_out", F.lit(False))).select(key, spelling, F.lit(1).alias("_from"), F.col("line").alias("_line"))
    both = base.select(key, spelling, F.lit(0).alias("_from"), F.col("line").alias("_line")).unionByName(add)
    return both.groupBy(key).agg(F.min_by(spelling, F.struct("_from", "_line", spelling)).alias(spelling))


def reversal_doubts(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns of facts that fit the schema only the other way round. SCA-44."""
    used = facts.select("s", "p", "o").distinct()
    back = patterns.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return used.join(patterns.select("s", "p", "o"), ["s", "p", "o"], "left_anti").join(back, ["s", "p", "o"], "left_semi")


def deferred(entries: DataFrame, least: int, classes: DataFrame) -> DataFrame:
    """entries (s, p, o, support) with the first reason for leaving them out, null if kept. FLT-11."""
    c = small(classes.select("name", F.lit(True).alias("_ok")))
    out = entries.join(c.toDF("s", "_s"), "s", "left").join(c.toDF("o", "_o"), "o", "left")
    reason = F.when(F.col("support") < least, "too little support").when(F.col("_s").isNull(), "subject class left out").when(F.col("_o").isNull(), "object class left out")
    return out.select(*entries.columns, reason.alias("reason"))


def request_chunks(sizes: DataFrame, most_count: int, most_bytes: int, key: str, size: str) -> DataFrame:
    """key, chunk: requests in order, a new chunk when the count or the bytes would pass the cap. SCA-38.

    Order-dependent: a task forms the chunks of its own range of keys, so chunks are numbered within ranges.
    """

    def run(frames):
        import pandas as pd

        chunk = count = held = 0
        for pdf in frames:
            out = []
            for n in pdf[size]:
                if count and (count >= most_count or held + n > most_bytes):
                    chunk, count, held = chunk + 1, 0, 0
                count, held = count + 1, held + n
                out.append(chunk)
            yield pd.DataFrame({key: pdf[key], "part": pdf["part"], "chunk": out})

    parts = sizes.select(key, size).repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    return parts.mapInPandas(run, f"{key} {sizes.schema[key].dataType.simpleString()}, part int, chunk int")


def hypergeometric_tail(texts: int, found: int, drawn: int, least: int) -> float:
    """The exact value that `saturation` computes in logarithms; for tests."""
    return sum(comb(found, x) * comb(texts - found, drawn - x) for x in range(least, min(found, drawn) + 1) if drawn - x <= texts - found) / comb(texts, drawn)


def induced_support(triples: DataFrame, labels: DataFrame, titles: DataFrame) -> DataFrame:
    """kind, entry, support, maintainers of classes, predicates and patterns from labelled triples. AGG-01.

    triples: text, maintainer, subject, predicate, object. labels: name, label. titles: text, maintainer, label (the class a text describes).
    A slot without a label loses only its own entry and its pattern; a title counts once for its class; texts count, not occurrences.
    """
    t = with_labels(triples, labels)
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("entry"))
    s, p, o = (F.col(f"{x}_label") for x in ("subject", "predicate", "object"))
    whole = F.when(s.isNotNull() & p.isNotNull() & o.isNotNull(), F.concat_ws(" ", s, p, o))
    entries = F.array(entry("class", s), entry("class", o), entry("predicate", p), entry("pattern", whole))
    rows = t.select("text", "maintainer", F.inline(entries)).unionByName(titles.select("text", "maintainer", F.lit("class").alias("kind"), F.col("label").alias("entry")))
    return support_counts(rows.where("entry is not null"), ["kind", "entry"], "text", "maintainer")
