"""Record-level operators: describes rows, cleaned field columns, exports, pin keys, consolidation, status."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import keys as K
from factloom.functions import markup as M
from factloom.functions import text as X

ENTRY_CLASS, ENTRY_PREDICATE, ENTRY_SOURCE, UNDECIDED = "CatalogEntry", "DESCRIBES", "(record structure)", "X"


def describes_rows(records: DataFrame, title: str = "title", entity_class: str | None = None) -> DataFrame:
    """One synthetic fact a record: the entry describes the thing of its title. PRJ-05."""
    c = F.lit(UNDECIDED) if entity_class is None else F.coalesce(F.nullif(F.trim(entity_class), F.lit("")), F.lit(UNDECIDED))
    return records.select(
        "id", F.col("id").alias("subject"), F.lit(ENTRY_CLASS).alias("subject_class"), F.lit(ENTRY_PREDICATE).alias("predicate"), K.one_line(F.coalesce(title, F.lit(""))).alias("object"),
        c.alias("object_class"), F.lit(ENTRY_SOURCE).alias("source_text"),
    )


def describes_problems(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows of a record's facts with what is wrong with its describes rows: other subject, undecided or unknown class, several of them. SCA-21."""
    known = classes.select(F.col("name").alias("object_class"), F.lit(True).alias("_known"))
    is_it = (K.class_key_udf("subject_class") == K.class_key(ENTRY_CLASS)) & (K.class_key_udf("predicate") == K.class_key(ENTRY_PREDICATE))
    own = rows.where(is_it)
    n = own.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    out = own.join(n, "id").join(F.broadcast(known) if known.count() <= 100_000 else known, "object_class", "left")
    undecided = F.upper(F.trim("object_class")).isin("", UNDECIDED)
    problems = F.array_compact(F.array(
        F.when(F.col("subject") != F.col("id"), "subject is not the record"), F.when(undecided, "class undecided"), F.when(~undecided & F.col("_known").isNull(), "class not in the schema"), F.when(F.col("_n") > 1, "several describes rows"),
    ))
    return out.select(*rows.columns, problems.alias("problems"))


def cleaned_fields(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """records with <field>, <field>_clean and <field>_clean_method for each field. PRJ-06."""
    rest = [c for c in records.columns if c not in fields]
    out = records.select("*", *(M.clean_udf(c).alias(f"_{c}") for c in fields))
    return out.select(*rest, *(x for c in fields for x in (F.col(c), F.col(f"_{c}.text").alias(f"{c}_clean"), F.col(f"_{c}.tier").alias(f"{c}_clean_method"))))


def export_instances(facts: DataFrame) -> DataFrame:
    """id, place, slot, name: the instances of each fact in order. PRJ-13."""
    slots = F.array(*(F.struct(F.lit(s).alias("slot"), F.col(s).alias("name")) for s in ("subject", "predicate", "object")))
    return facts.select("id", F.posexplode(slots).alias("place", "x")).select("id", "place", "x.slot", "x.name")


def pin_key(subject_class: Column | str, object_class: Column | str) -> Column:
    """`Subject -> Object`, with any where a class is missing. SCA-39."""
    side = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("any"))
    return F.concat(side(subject_class), F.lit(" -> "), side(object_class))


def consolidate(names: DataFrame, key: Column, name: str) -> DataFrame:
    """key, name (most frequent), rows, spellings, merged: names folded to one. AGG-34."""
    n = names.select(key.alias("key"), F.col(name).alias("name")).groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("spellings"))
    return out.withColumn("merged", F.col("spellings") > 1)


def out_of_date(steps: DataFrame, inputs: DataFrame) -> DataFrame:
    """step, waiting: how many inputs changed since the step ran. AGG-40. steps: step, ran_at. inputs: step, changed_at."""
    j = steps.join(inputs, "step", "left")
    return j.groupBy("step").agg(F.count(F.when(F.col("changed_at") > F.col("ran_at"), 1)).alias("waiting"), F.max(F.col("ran_at").isNull()).alias("never_ran"))


def row_errors(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows with errors: incomplete, id unknown, no source text, source not in text, several describes rows. FLT-04.

    records: id, text. The text is joined once for each row and read in Arrow batches.
    """
    slots = ("subject", "subject_class", "predicate", "object", "object_class")
    blank = F.lit(False)
    for s in slots:
        blank |= F.coalesce(F.trim(s), F.lit("")) == ""
    is_it = K.class_key_udf("predicate") == K.class_key(ENTRY_PREDICATE)
    marked = rows.withColumn("_it", is_it)
    many = marked.where("_it").groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = marked.join(records.select("id", F.col("text").alias("_text"), F.lit(True).alias("_known")), "id", "left").join(many, "id", "left")
    no_source = F.coalesce(F.trim("source_text"), F.lit("")) == ""
    errors = F.array_compact(F.array(
        F.when(blank, "incomplete"), F.when(F.col("_known").isNull(), "id unknown"), F.when(no_source & ~F.col("_it"), "no source text"),
        F.when(~no_source & ~F.col("_it") & F.col("_known").isNotNull() & ~X.source_in_text_udf("source_text", "_text"), "source not in text"), F.when(F.col("_it") & F.col("_n").isNotNull(), "several describes rows"),
    ))
    return out.select(*rows.columns, errors.alias("errors"))


def unlinked_rows(rows: DataFrame) -> DataFrame:
    """Facts that no chain of shared instances links to their record's id. SET-08. rows: id, subject, object and more.

    A group is one record's facts.
    """
    def far(name, subjects, objects) -> list[bool]:
        ends = [(K.instance_key(s), K.instance_key(o)) for s, o in zip(subjects, objects, strict=True)]
        reached, grew = {K.instance_key(str(name))}, True
        while grew:
            before = len(reached)
            for a, b in ends:
                if a in reached or b in reached:
                    reached |= {a, b}
            grew = len(reached) > before
        return [a not in reached for a, _ in ends]

    @F.pandas_udf("array<boolean>")
    def far_udf(name: pd.Series, subjects: pd.Series, objects: pd.Series) -> pd.Series:
        return pd.Series([far(*r) for r in zip(name, subjects, objects, strict=True)], dtype=object)

    # many records a batch: a call for each record costs more than its walk
    packed = rows.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    marked = packed.select("_rows", far_udf("_id", F.col("_rows.subject"), F.col("_rows.object")).alias("_far"))
    return marked.select(F.inline(F.filter("_rows", lambda r, i: F.get("_far", i))))
