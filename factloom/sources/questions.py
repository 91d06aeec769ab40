"""Documents of questions to experts, read as rows and checked by rules. SRC-17.

A question begins with "## Q<number>: <title>"; "- status: ..." lines and others under it are its head; "### <part>" headings follow in a fixed
order. Rules are tables below; a broken one is a row (file, line, question, problem), so all documents are read whatever they hold. A document is read in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.files import numbered_lines

# Fields of a head with the values they may have (none: any).
HEAD = {
    "status": ("open", "answered", "withdrawn"),
    "priority": ("high", "medium", "low"),
    "question kind": ("records and triples", "schema entry", "rule", "translation table rows", "pipeline method", "general"),
    "in short": (),
}
# Parts of a question in their order, and how many there may be (1: one, ?: at most one, *: any number).
PARTS = {
    "The question": "1", "Context": "?", "Example record": "*", "Ground truth schema": "?", "Translation table": "?", "Annotation guidelines": "?", "Options": "?", "My current reading": "1",
    "The answer": "?", "My notes": "?", "Quoted for us": "?", "Consequences": "?", "Affects": "1", "Pipeline method": "?",
}
#: Parts of plain text, which must not be empty; nor may the list of what an answer changes.
PROSE = ("The question", "Context", "My current reading", "The answer", "My notes", "Affects")
#: Parts that come together: one is there if and only if the other is.
TOGETHER = (("Options", "Consequences"),)
# Fields of an example record; those it must have once, and those it may have.
RECORD = ("record id", "pool position", "title", "notes")
RECORD_MORE = ("in the ground truth", "source text", "classed triple")
_FIELD = r"^- ([^:]+): (.*)$"
_TRIPLE = r'^".+" \(\w+\) [A-Z][A-Z0-9_]* ".+" \(\w+\)$'


def _one_of(value: Column, names) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def question_lines(texts: DataFrame) -> DataFrame:
    """file, line, value, q (which question of its file), number, title, part_at (line of the part's heading, null in the head), part, field, said of the lines of questions."""
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head, part = F.regexp_extract("value", r"^## Q(\d+): (.*)$", 1), F.regexp_extract("value", r"^### (.+?)\s*$", 1)
    lines = numbered_lines(texts).withColumn("is_q", head != "").withColumn("is_p", part != "")
    lines = lines.withColumn("q", F.sum(F.col("is_q").cast("int")).over(by))
    lines = lines.withColumn("q_at", F.last(F.when(F.col("is_q"), F.col("line")), ignorenulls=True).over(by))
    lines = lines.withColumn("number", F.last(F.when(F.col("is_q"), head.cast("int")), ignorenulls=True).over(by))
    lines = lines.withColumn("title", F.last(F.when(F.col("is_q"), F.trim(F.regexp_extract("value", r"^## Q(\d+): (.*)$", 2))), ignorenulls=True).over(by))
    # the part of a line is the last one of its own question
    last = F.last(F.when(F.col("is_p"), F.struct(F.col("line").alias("at"), part.alias("name"))), ignorenulls=True).over(by)
    lines = lines.withColumn("p", F.when(last["at"] > F.col("q_at"), last)).where("q > 0")
    field = F.when(F.col("value").rlike(_FIELD), F.trim(F.regexp_extract("value", _FIELD, 1)))
    said = F.when(F.col("value").rlike(_FIELD), F.trim(F.regexp_extract("value", _FIELD, 2)))
    return lines.select("file", "line", "value", "q", "q_at", "number", "title", F.col("p.at").alias("part_at"), F.col("p.name").alias("part"), field.alias("field"), said.alias("said"), "is_q", "is_p")


def questions(texts: DataFrame) -> DataFrame:
    """file, number, title, head (map of its fields), parts (array of name, text in order)."""
    lines = question_lines(texts)
    head = lines.where("part is null and field is not null").groupBy("file", "q").agg(F.array_sort(F.collect_list(F.struct("line", "field", "said"))).alias("fs"))
    first = F.aggregate("fs", F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["field"]), m).otherwise(F.map_concat(m, F.create_map(x["field"], x["said"]))))
    head = head.select("file", "q", first.alias("head"))
    parts = lines.where("part is not null and not is_p").groupBy("file", "q", "part_at", "part").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n"), F.lit(" \n")).alias("text"))
    parts = parts.groupBy("file", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_at", F.col("part").alias("name"), "text"))), lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text"))).alias("parts"))
    own = lines.where("is_q").select("file", "q", "number", "title")
    return own.join(head, ["file", "q"], "left").join(parts, ["file", "q"], "left").drop("q")


def problems(texts: DataFrame) -> DataFrame:
    """file, line, question, problem: every rule that a document breaks."""
    lines = question_lines(texts)
    own = lines.where("is_q").select("file", "q", "q_at", "number")
    out = []

    def add(rows: DataFrame, line: str, problem: Column) -> None:
        out.append(rows.select("file", F.col(line).alias("line"), F.col("number").alias("question"), problem.alias("problem")).where("problem is not null"))

    before = Window.partitionBy("file").orderBy("q")
    add(own.withColumn("low", F.max("number").over(before.rowsBetween(Window.unboundedPreceding, -1))), "q_at", F.when(F.col("number") <= F.col("low"), "number is repeated or out of order"))

    heads = lines.where("part is null and field is not null").groupBy("file", "q", "field").agg(F.min(F.struct("line", "said")).alias("x"), F.count(F.lit(1)).alias("n"))
    needs = own.select("*", F.explode(F.array(*map(F.lit, HEAD))).alias("field")).join(heads, ["file", "q", "field"], "left")
    add(needs, "q_at", F.when(F.col("x").isNull(), F.concat(F.lit("no "), "field")).when(F.col("n") > 1, F.concat("field", F.lit(" is there twice"))))
    wrong = F.lit(None).cast("string")
    for field, allowed in HEAD.items():
        if allowed:
            wrong = F.when((F.col("field") == field) & ~_one_of(F.col("x.said"), allowed), F.concat("field", F.lit(" is none of "), F.lit(", ".join(allowed)))).otherwise(wrong)
    add(needs.where("x is not null").select("*", F.col("x.line").alias("at")), "at", wrong)

    parts = lines.where("is_p").select("file", "q", "number", "q_at", F.col("part_at").alias("at"), "part")
    parts = parts.withColumn("rank", F.array_position(F.array(*map(F.lit, PARTS)), F.col("part")))
    run = Window.partitionBy("file", "q").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("top", F.max("rank").over(run)).withColumn("seen", F.row_number().over(Window.partitionBy("file", "q", "part").orderBy("at")))
    many = [p for p, n in PARTS.items() if n == "*"]
    late = F.when(F.col("rank") == 0, "no such part").when(F.col("rank") < F.col("top"), "part out of order").when((F.col("seen") > 1) & ~_one_of(F.col("part"), many), "part is there twice")
    add(parts, "at", F.concat(late, F.lit(": "), "part"))
    have = own.join(parts.groupBy("file", "q").agg(F.collect_set("part").alias("have")), ["file", "q"], "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    for p in (p for p, n in PARTS.items() if n == "1"):
        add(have, "q_at", F.when(~F.array_contains("have", p), f"no part: {p}"))
    for a, b in TOGETHER:
        add(have, "q_at", F.when(F.array_contains("have", a) != F.array_contains("have", b), f"{a} and {b} come together"))
    status = needs.where("field = 'status' and x is not null").select("file", "q", F.col("x.said").alias("status"))
    add(have.join(status, ["file", "q"]), "q_at", F.when((F.col("status") == "answered") != F.array_contains("have", "The answer"), "an answer is there if and only if the status is answered"))

    bodies = parts.join(lines.where("part is not null and not is_p").groupBy("file", F.col("part_at").alias("at")).agg(F.max(F.trim("value") != "").alias("filled")), ["file", "at"], "left")
    add(bodies, "at", F.when(_one_of(F.col("part"), PROSE) & ~F.coalesce("filled", F.lit(False)), F.concat(F.lit("part is empty: "), "part")))

    record = parts.where("part = 'Example record'")
    fields = lines.where("part = 'Example record' and field is not null").select("file", F.col("part_at").alias("at"), "line", "number", "field", "said")
    count = fields.groupBy("file", "at", "field").agg(F.count(F.lit(1)).alias("n"))
    wanted = record.select("*", F.explode(F.array(*map(F.lit, (*RECORD, "source text")))).alias("field")).join(count, ["file", "at", "field"], "left")
    add(wanted, "at", F.when(F.col("n").isNull(), F.concat(F.lit("record without "), "field")).when((F.col("n") > 1) & (F.col("field") != "source text"), F.concat("field", F.lit(" is there twice"))))
    odd = F.when(~_one_of(F.col("field"), (*RECORD, *RECORD_MORE)), "no such field of a record").when((F.col("field") == "pool position") & ~F.col("said").rlike(r"^\d+$"), "pool position is no number")
    odd = odd.when((F.col("field") == "record id") & ~F.col("said").rlike("^[0-9a-f-]{8,}$"), "not a record id").when((F.col("field") == "in the ground truth") & ~F.col("said").startswith("not yet"), "in the ground truth is written for a record not yet in it")
    add(fields, "line", odd.when((F.col("field") == "classed triple") & ~F.col("said").rlike(_TRIPLE), "not a classed triple"))

    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every
